"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Every document's set of n-grams (as 64-bit hashes; 48 bits of them travel). Equal sets within a partition are kept
   once, with a link to the first; equal sets of several partitions are linked by the set's 128-bit hash.
2. Column blocks: each holds all entries of its n-grams and counts each n-gram's documents. N-grams of one document
   add to no overlap and go.
3. Row blocks: what is left of each document. By the size-derived bound, a partner of a document with n n-grams shares
   at least 75 % of them, so both have one of their n - ceil(0.75 n) + 1 rarest in common. A document whose single
   n-grams fill these has no partner. The others are joined by these few columns, neighbours in size only, into coarse
   components that hold every possible pair.
4. The product itself, in blocks of rows of one coarse component: overlaps are accumulated along the columns, for
   partners of fitting size that aren't connected yet, and kept if 100 * overlap >= 75 * union. Larger components are
   dealt out as pairs of chunks of rows, so no task holds an unbounded group; only a forest of links leaves a block.
5. Connected components of the links.

Defined cases: a null or empty text, or one without words, has an empty set and no links; a text of fewer words than
the n-gram has its whole sequence as the one n-gram; rows without a doc_id take no part; rows that share a doc_id are
one node but keep a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import find_words, fresh, hash_words, lean, ragged, shingle_hashes, space_bytes, stored, text_batches, text_steps
from .graph import components, forest

SIZE = 5
#: Similarity, in hundredths.
PERCENT = 75
#: Entries (n-grams of documents) of a column block.
BLOCK_ENTRIES = 1_000_000
#: Rows and n-grams of a chunk of a large coarse component.
CHUNK_ROWS, CHUNK_ENTRIES = 3000, 1_500_000
#: Entries of a block whose rows are counted at once.
ENTRIES_AT_ONCE = 500_000
_LOW48 = np.uint64((1 << 48) - 1)
_PACKED = "bucket int, n_docs int, head binary, grams binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("n_docs", pa.int32()), ("head", pa.binary()), ("grams", pa.binary())])


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def document_sets(ids: np.ndarray, column: pa.Array, size: int = SIZE):
    """For steps of rows: (doc_ids, set sizes, the sorted 48-bit n-gram hashes of all sets in order)."""
    for at, n, raw, offsets in text_steps(column):
        starts, lens, first = find_words(raw, offsets, space_bytes())
        grams, first = shingle_hashes(hash_words(raw, starts, lens), first, size)
        grams &= _LOW48
        row = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((grams, row))
        grams = grams[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        yield ids[at : at + n], np.bincount(row[new], minlength=n), grams[new]


def _signatures(size: int):
    @lean
    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for docs, sizes, grams in document_sets(ids, batch.column(1), size):
                view, ends, keys, firsts = np.ascontiguousarray(grams).view(np.uint8), np.cumsum(sizes), [], []
                for d, s, e in zip(docs.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                    k = hashlib.blake2b(view[(e - s) * 8 : e * 8], digest_size=16).digest() if s else None
                    keys.append(None if k in seen else k)
                    firsts.append(seen.setdefault(k, d) if s else d)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n", "first", "key"])

    return run


def _rows_of(bucket: np.ndarray, docs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, grams: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Packed rows, one per bucket. bucket: of each entry. docs, sizes, counts: of the documents whose entries follow one another."""
    owner = np.repeat(np.arange(len(docs)), counts)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, grams = bucket[order], owner[order], grams[order]
    extra = None if extra is None else extra[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    rows, press = [], zstandard.ZstdCompressor(level=1).compress
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        own = owner[a:b]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        who = own[at]
        head = [np.diff(docs[who], prepend=0).astype("<i8"), sizes[who].astype("<i4"), np.diff(np.r_[at, len(own)]).astype("<i4"), np.zeros(0) if extra is None else extra[a:b].astype("<u2")]
        rows.append((int(bucket[a]), len(who), press(b"".join(x.tobytes() for x in head)), pack48(grams[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED_ARROW.types, strict=True)], schema=_PACKED_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_PACKED_ARROW)


def _unpacked(table: pa.Table):
    """(docs, sizes, counts, grams, extra) of a bucket's packed rows."""
    parts, unpress = [[], [], [], []], zstandard.ZstdDecompressor().decompress
    for n, head in zip(table.column("n_docs").to_pylist(), table.column("head").to_pylist(), strict=True):
        data = unpress(head)
        parts[0].append(np.cumsum(np.frombuffer(data, "<i8", n)))
        parts[1].append(np.frombuffer(data, "<i4", n, 8 * n))
        parts[2].append(np.frombuffer(data, "<i4", n, 12 * n))
        parts[3].append(np.frombuffer(data, "<u2", -1, 16 * n))
    docs, sizes, counts, extra = (np.concatenate(x) for x in parts)
    return docs, sizes, counts, unpack48(b"".join(table.column("grams").to_pylist())), extra


def _of_block(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(16)) % np.uint64(blocks)).astype(np.int32)


def _of_doc(docs: np.ndarray, blocks: int) -> np.ndarray:
    h = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)


def _columns(size: int, blocks: int):
    """Entries of each partition's distinct sets, by column block."""

    @lean
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for docs, sizes, grams in document_sets(ids, batch.column(1), size):
                view, ends, keep = np.ascontiguousarray(grams).view(np.uint8), np.cumsum(sizes), np.zeros(len(docs), dtype=bool)
                for i, (s, e) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                    if s and (k := hashlib.blake2b(view[(e - s) * 8 : e * 8], digest_size=16).digest()) not in seen:
                        seen.add(k)
                        keep[i] = True
                grams = grams[np.repeat(keep, sizes)]
                if len(grams):
                    yield _rows_of(_of_block(grams, blocks), docs[keep], sizes[keep], sizes[keep], grams)

    return run


def _shared(blocks: int):
    """Of a column block: the entries of n-grams that several documents have, with the number of documents, by row block."""

    def run(key, table):
        docs, sizes, counts, grams, _ = _unpacked(table)
        owner = np.repeat(np.arange(len(docs)), counts)
        order = np.argsort(grams)
        cuts = np.flatnonzero(np.r_[True, grams[order][1:] != grams[order][:-1]]) if len(grams) else np.zeros(0, np.int64)
        width = np.diff(np.r_[cuts, len(grams)])
        df = np.empty(len(grams), dtype=np.int64)
        df[order] = np.repeat(width, width)
        keep = df > 1
        if not keep.any():
            return pa.Table.from_batches([], schema=_PACKED_ARROW)
        counts = np.bincount(owner[keep], minlength=len(docs))
        some = counts > 0
        bucket = np.repeat(_of_doc(docs[some], blocks), counts[some])
        return pa.Table.from_batches([_rows_of(bucket, docs[some], sizes[some], counts[some], grams[keep], np.minimum(df[keep], 65535))])

    return run


def least_overlap(n, percent: int = PERCENT):
    """Entries of a set of n that a partner shares at least."""
    return -(-n * percent // 100)


def _candidates(percent: int):
    """Of a row block: the documents that can have partners, their shared n-grams, and the rarest of them that matter."""

    def run(key, table):
        docs, sizes, counts, grams, df = _unpacked(table)
        ids, doc = np.unique(docs, return_inverse=True)
        n = np.zeros(len(ids), dtype=np.int64)
        n[doc] = sizes
        owner = np.repeat(doc, counts)
        order = np.lexsort((grams, df, owner))
        grams, owner = grams[order], owner[order]
        k = np.bincount(owner, minlength=len(ids))
        need = np.maximum(0, n - least_overlap(n, percent) + 1 - (n - k))
        first = np.cumsum(k) - k
        rows = []
        for i in np.flatnonzero(need > 0):
            own = grams[first[i] : first[i] + k[i]]
            rows.append((int(ids[i]), int(n[i]), pack48(np.sort(own)), pack48(own[: need[i]])))
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("rare", pa.binary())])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def _rare_columns(blocks: int):
    @lean
    def run(batches):
        for batch in batches:
            rare = [unpack48(x) for x in batch.column(2).to_pylist()]
            counts = np.array([len(r) for r in rare])
            if counts.sum():
                grams = np.concatenate(rare)
                yield _rows_of(_of_block(grams, blocks), batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts, grams)

    return run


def _coarse_links(percent: int):
    """Of a column block: a forest of the links between documents next to one another in size that share a column and may be partners."""

    def run(key, table):
        docs, sizes, counts, grams, _ = _unpacked(table)
        doc, n = np.repeat(docs, counts), np.repeat(sizes, counts).astype(np.int64)
        order = np.lexsort((doc, n, grams))
        doc, n, grams = doc[order], n[order], grams[order]
        link = (grams[1:] == grams[:-1]) & (n[:-1] * 100 >= percent * n[1:]) & (doc[1:] != doc[:-1])
        node, root = forest(doc[1:][link], doc[:-1][link])
        return pa.table({"u": node, "v": root})

    return run


def _overlaps(rows: np.ndarray, start: np.ndarray, width: np.ndarray, m: int) -> np.ndarray:
    """How often each of m rows is in the columns rows[start : start + width], so many entries at once."""
    out, total, i = np.zeros(m, np.int64), np.r_[0, np.cumsum(width)], 0
    while i < len(width):
        j = max(i + 1, int(np.searchsorted(total, total[i] + ENTRIES_AT_ONCE, side="right")) - 1)
        out += np.bincount(rows[ragged(start[i:j], width[i:j])], minlength=m)
        i = j
    return out


def linked(docs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links among the documents: the rows of the sparse product of their incidence matrix with its
    transpose, each only for partners that fit in size and aren't connected with it yet."""
    by_size = np.argsort(sizes, kind="stable")
    docs, sizes, sets = docs[by_size], sizes[by_size].astype(np.int64), [sets[i] for i in by_size]
    m = len(docs)
    root = np.arange(m)
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = root[i], root[j]
        if a != b:
            root[root == max(a, b)] = min(a, b)
            if docs[i] != docs[j]:
                out.append((int(docs[i]), int(docs[j])))

    same: dict[tuple, int] = {}
    for i in range(m):
        if len(sets[i]) == sizes[i]:
            j = same.setdefault((len(sets[i]), sets[i].tobytes()), i)
            if j != i:
                join(i, j)
    counts = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    first = np.cumsum(counts) - counts
    sets = [flat[a:b] for a, b in zip(first, first + counts, strict=True)]  # the copies go
    order = np.argsort(flat, kind="stable").astype(np.int32)
    ordered = flat[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(flat) else np.zeros(0, bool)
    del ordered
    column = np.empty(len(flat), dtype=np.int32)
    column[order] = np.cumsum(new, dtype=np.int32) - 1
    start = np.flatnonzero(new)
    width = np.diff(np.r_[start, len(flat)])
    rows = np.repeat(np.arange(m, dtype=np.int32), counts)[order]
    del order, new
    top = np.searchsorted(sizes * percent, sizes * 100, side="right")  # partners beyond are too large
    for i in range(m):
        rest = np.flatnonzero(root[i + 1 : top[i]] != root[i]) + i + 1
        if not len(rest):
            continue
        own = column[first[i] : first[i] + counts[i]]
        if len(rest) * counts[i] * 4 < width[own].sum():
            overlap = np.array([np.isin(sets[j], sets[i], assume_unique=True).sum() for j in rest])
        else:
            overlap = _overlaps(rows, start[own], width[own], m)[rest]
        for j in rest[100 * overlap >= percent * (sizes[i] + sizes[rest] - overlap)]:
            join(i, j)
    return out


def _verified(percent: int):
    """Links of blocks; a partition's rows are sorted by (component, low, high)."""

    @lean
    def run(batches):
        key, docs, sizes, sets = None, [], [], []

        def links():
            pairs = linked(np.array(docs, dtype=np.int64), np.array(sizes, dtype=np.int64), [unpack48(s) for s in sets], percent) if len(docs) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key:
                    if docs:
                        yield links()
                    key, docs, sizes, sets = row[:3], [], [], []
                docs.append(row[3])
                sizes.append(row[4])
                sets.append(row[5])
        if docs:
            yield links()

    return run


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text)."""
    text_batches(docs.sparkSession, 4000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = stored(docs.mapInArrow(_signatures(size), "doc_id long, n long, first long, key binary"), "signatures")
    entries = signed.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-entries // BLOCK_ENTRIES))

    shared = docs.mapInArrow(_columns(size, blocks), _PACKED).groupBy("bucket").applyInArrow(_shared(-(-blocks // 4)), _PACKED)
    rows = stored(shared.groupBy("bucket").applyInArrow(_candidates(percent), "doc_id long, n long, shared binary, rare binary"), "rows")
    rare = rows.agg(F.sum(F.length("rare"))).first()[0] or 0
    coarse = components(rows.select("doc_id", "n", "rare").mapInArrow(_rare_columns(max(1, -(-rare // 6 // BLOCK_ENTRIES))), _PACKED).groupBy("bucket").applyInArrow(_coarse_links(percent), "u long, v long"))

    coarse = coarse.unionByName(coarse.select(F.col("component").alias("node"), "component").distinct())
    members = coarse.join(rows.select("doc_id", "n", "shared"), coarse["node"] == rows["doc_id"])
    width = coarse.join(rows.select("doc_id", F.length("shared").alias("bytes")), coarse["node"] == F.col("doc_id")).groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("bytes") / (6 * CHUNK_ENTRIES))).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    dealt = members.join(width, "component").withColumn("chunk", chunk).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select("component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "doc_id", "n", "shared")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    links = dealt.repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high").mapInArrow(_verified(percent), "u long, v long")

    copies = signed.where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    keyed = signed.where("key IS NOT NULL")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"))
    equal = keyed.join(least, "key").where("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    found = components(links.unionByName(copies).unionByName(equal))
    return signed.join(found, signed["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (rows without one stay, repeated rows of it go to one: the one whose text sorts first)."""
    gone, own, rank = (fresh(x, docs.columns) for x in ("gone_id", "several_id", "rank_of_row"))
    away = jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(away, docs["doc_id"].cast("long") == away[gone], "left_anti")
    # only the rows of ids that several rows hold travel
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n")).where("n > 1").select(own)
    same = kept["doc_id"] == several[own]
    ranked = kept.join(several, same, "left_semi").withColumn(rank, F.row_number().over(W.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns)))))
    return kept.join(several, same, "left_anti").unionByName(ranked.where(F.col(rank) == 1).drop(rank))


def jaccard_brute(docs: list[tuple], size: int = SIZE, percent: int = PERCENT) -> list[tuple]:
    """Plain Python, for tests: (doc_id, n_shingles, component_id)."""
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(docs[i][0]), find(docs[j][0])
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for (d, _), s in zip(docs, sets, strict=True)]
