"""Token-id files: a zstandard dictionary shared by all files, every document compressed by itself, and an offset index.

A file: b"VTOK1\\n", a JSON line (dtype, documents, tokens, dictionary's sha256), the documents' frames, then the index
(doc_id, tokens, frame's offset; 8 bytes each, little-endian) and its offset. Files are in ascending doc_id order,
within and between each other. A file is written under a passing name and renamed, so that a task that is run again
replaces it by the same bytes. Paths may be anything that pyarrow's file systems open (file, hdfs, s3).

The dictionary is trained on the ids of at most SAMPLE_DOCS documents of at most SAMPLE_BYTES bytes of text.

Defined cases: a null or empty text has no ids but the end id; rows without a doc_id take no part; rows that share a
doc_id are separate documents, in the order of their texts' hashes; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ragged, shared_path, text_batches, text_steps
from .pool import Pool, joined

SAMPLE_DOCS = 256
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
#: Input (as Spark estimates its size) for one file.
FILE_BYTES = 24 << 20
MAGIC = b"VTOK1\n"
_WRITTEN = "shard int, path string, n_docs long, n_tokens long"


class TextEncoder:
    """Ids of whole texts by a tokenizers file, word by word where that gives the same ids.

    Words between white space are encoded once and kept. A word's pre-tokens go to the library's model directly if
    normalising them is known to be plain (ASCII and Latin letters); other words go through its whole encode(). A text
    with a special token's string, or with control characters that libraries class differently, is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.whole = regex.compile("[\x1c-\x1f\x85​-‍﻿]" + "".join("|" + regex.escape(a) for a in added)).search
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0].get("invert") is True
        if self.plain:
            self.split = regex.compile(splits[0]["pattern"]["Regex"] + "|\n").findall
            self.latin = regex.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff\xbf\xa1]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.shown = {b: b if b in printable else next(rest) for b in range(256)}
        self.words = Pool(self._words)
        self.pieces = Pool(self._pieces)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, shown = self.tok.model.tokenize, self.shown
        return joined([[] if p == "\n" else [t.id for t in model(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(shown))] for p in pieces])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([w.isascii() or bool(self.latin(w)) for w in words]) & self.plain
        fast = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        found = self.split(unicodedata.normalize("NFC", "\n".join(fast)).lower()) if fast else []
        self.pieces.learn({*found, "\n"})
        at = self.pieces.places(found)
        count = self.pieces.count[at]
        ends = np.r_[np.flatnonzero(at == self.pieces.index["\n"]), len(at)]
        each = np.diff(np.r_[0, np.r_[0, np.cumsum(count)][ends]])[: len(fast)]
        flat = self.pieces.flat[ragged(self.pieces.first[at], count)]
        if len(fast) == len(words):
            return flat, each
        slow, rest = joined([self.tok.encode(w, add_special_tokens=False).ids for w, p in zip(words, plain.tolist(), strict=True) if not p])
        counts = np.empty(len(words), dtype=np.int64)
        counts[plain], counts[~plain] = each, rest
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        mine = np.repeat(plain, counts)
        out[mine], out[~mine] = flat, slow
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and their numbers."""
        whole = [bool(self.whole(t)) for t in texts]
        flat, counts = self.words.runs([[] if w else t.split() for t, w in zip(texts, whole, strict=True)])
        if any(whole):
            ends = np.cumsum(counts)
            runs = [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) if w else flat[e - c : e] for t, w, c, e in zip(texts, whole, counts, ends, strict=True)]
            flat, counts = np.concatenate(runs), np.array([len(r) for r in runs])
        return flat, counts


@cache
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def train_dictionary(texts: list[str], tokenizer: str, end_id: int | None, dtype: str) -> bytes:
    """b"" if there is too little to train on."""
    tail = [] if end_id is None else [end_id]
    flat, counts = encoder(tokenizer).encode(texts) if texts else (np.zeros(0), np.zeros(0, int))
    ends = np.cumsum(counts)
    samples = [np.r_[flat[e - c : e], tail].astype(dtype).tobytes() for c, e in zip(counts, ends, strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _file_system(path: str):
    return pa.fs.FileSystem.from_uri(path)


def _writer(folder: str, tokenizer: str, end_id: int | None, dtype: str, dictionary):
    @lean
    def run(batches):
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, base = _file_system(folder)
        name, passing = f"{base}/shard-{shard:07d}.vtok", f"{base}/_passing-{shard:07d}-{attempt}"
        text_encoder, blob = encoder(tokenizer), dictionary.value
        zdict = zstandard.ZstdCompressionDict(blob) if blob else None
        press = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_content_size=True).compress
        out, ids, counts, offsets, at = None, [], [], [], 0
        tail = np.array([] if end_id is None else [end_id], dtype=dtype)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, n, _, _ in text_steps(column):
                if out is None:
                    out = fs.open_output_stream(passing)
                    head = MAGIC + json.dumps({"dtype": dtype, "dictionary_sha256": hashlib.sha256(blob).hexdigest()}).encode() + b"\n"
                    out.write(head)
                    at = len(head)
                flat, each = text_encoder.encode(column.slice(i, n).to_pylist())
                each = each + len(tail)
                ends = np.cumsum(each)
                ids_here = np.empty(int(each.sum()), dtype=dtype)
                last = np.zeros(len(ids_here), dtype=bool)
                if len(tail):
                    last[ends - 1] = True
                    ids_here[last] = tail[0]
                ids_here[~last] = flat
                view = memoryview(ids_here).cast("B")
                width = ids_here.itemsize
                frames = [press(view[a * width : b * width]) for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True)]
                sizes = np.array([len(f) for f in frames])
                ids.append(doc_ids[i : i + n])
                counts.append(each)
                offsets.append(at + np.cumsum(sizes) - sizes)
                out.write(b"".join(frames))
                at += int(sizes.sum())
        if out is None:
            return
        index = np.concatenate([np.concatenate(x).astype("<i8") for x in (ids, counts, offsets)])
        out.write(index.tobytes() + np.array([len(index) // 3, at], dtype="<i8").tobytes())
        out.close()
        fs.move(passing, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/shard-{shard:07d}.vtok"]), pa.array([len(index) // 3]), pa.array([int(sum(c.sum() for c in counts))])], names=["shard", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, dtype: str = "<u4", files: int | None = None) -> list[tuple[int, str, int, int]]:
    """Writes docs(doc_id, text) to folder; (shard, path, documents, tokens) of the files in order."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    # first the smallest hashes, numbers only; then the texts of those few
    hashed = docs.where(f"octet_length(text) BETWEEN 1 AND {SAMPLE_BYTES}").withColumn("h", F.xxhash64("doc_id"))
    few = [r[0] for r in hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]
    sample = sorted((r["h"], r["text"]) for r in hashed.where(F.col("h").isin(few)).select("h", "text").distinct().orderBy("h", "text").limit(SAMPLE_DOCS).collect()) if few else []
    dictionary = train_dictionary([t for _, t in sample], tokenizer, end_id, dtype)
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zstd") as out:
        out.write(dictionary)
    if files is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        # tables that aren't read from files have no known size
        files = max(1, -(-size // FILE_BYTES)) if size < 1 << 60 else docs.rdd.getNumPartitions()
    order = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    held = spark.sparkContext.broadcast(dictionary)
    return sorted(map(tuple, order.mapInArrow(_writer(folder, tokenizer, end_id, dtype, held), _WRITTEN).collect()))


class TokenFile:
    """Reads a token file; ids(k) touches only the k-th document's frame."""

    def __init__(self, path: str, dictionary: bytes | None = None):
        fs, name = _file_system(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        n, self.end = np.frombuffer(self.file.read_at(16, size - 16), "<i8")
        self.doc_ids, self.counts, self.offsets = np.frombuffer(self.file.read_at(size - 16 - int(self.end), int(self.end)), "<i8").reshape(3, n)
        head = self.file.read_at(min(4096, size), 0)
        if not head.startswith(MAGIC):
            raise ValueError(f"{path} is no token file")
        self.head = json.loads(head[len(MAGIC) :].split(b"\n", 1)[0])
        if dictionary is None:
            with fs.open_input_file(name.rpartition("/")[0] + "/dictionary.zstd") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.head["dictionary_sha256"]:
            raise ValueError(f"{path} was written with another dictionary")
        self.unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _decode(self, frame: bytes, k: int) -> np.ndarray:
        ids = np.frombuffer(self.unpress(frame), self.head["dtype"])
        if len(ids) != self.counts[k]:
            raise ValueError(f"document {self.doc_ids[k]}: {len(ids)} ids; the index has {self.counts[k]}")
        return ids

    def ids(self, k: int) -> np.ndarray:
        stop = int(self.offsets[k + 1] if k + 1 < len(self) else self.end)
        return self._decode(self.file.read_at(stop - int(self.offsets[k]), int(self.offsets[k])), k)

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(k) if k < len(self) and self.doc_ids[k] == doc_id else None

    def __iter__(self):
        bounds = np.r_[self.offsets, self.end]
        k = 0
        while k < len(self):
            j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + (4 << 20), side="right")) - 1)
            data = self.file.read_at(int(bounds[j] - bounds[k]), int(bounds[k]))
            for i in range(k, j):
                yield int(self.doc_ids[i]), self._decode(data[bounds[i] - bounds[k] : bounds[i + 1] - bounds[k]], i)
            k = j


@lean
def _digests(batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = TokenFile(path)
            crc = np.array([zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")) for _, ids in f], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids), pa.array(base + np.cumsum(f.counts) - f.counts), pa.array(f.counts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    rows, base = [], 0
    for _, path, _, tokens in files:
        rows.append((path, base))
        base += tokens
    paths = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")
    return paths.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(spark, write_token_files(docs, shared_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))
