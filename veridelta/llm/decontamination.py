"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: a segment holds some megabytes of whole documents and, for every token of
them, its postings. A phrase is looked up in a segment by the postings of its rarest term, moved by the term's offset
in the phrase and intersected with the other terms' lists, the rarer first. No token crosses the network.

Defined cases: a null or empty text has no words and no hits; rows without a doc_id, and benchmark rows without an
item_id, take no part; repeated rows are separate documents; an item without words occurs nowhere; columns other than
those named are ignored. Empty tables give empty results (an empty benchmark: no hits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_bytes, find_words, fresh, hash_text_words, hash_words, lean, stored, text_batches, text_steps

#: Words of a window of a benchmark item.
WINDOW = 13
#: Text of a segment.
SEGMENT_BYTES = 8 << 20
#: Bytes of benchmark texts that are looked up in one pass; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20

_INDEX = "segment string, doc_ids binary, doc_starts binary, terms binary, term_first binary, gaps binary"
_SPANS = "segment string, row int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


@lean
def _segments(batches):
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, n, raw, offsets in text_steps(batch.column(1), SEGMENT_BYTES):
            starts, lens, first = find_words(raw, offsets, alnum_bytes())
            h = hash_words(raw, starts, lens)
            order = np.argsort(h, kind="stable").astype(np.uint32)
            h = h[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
            gaps = np.diff(order, prepend=np.uint32(0)).astype(np.uint32)
            row = (ids[at : at + n], first.astype(np.int64), h[new], np.r_[new, len(h)].astype(np.int64), gaps)
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), *[pa.array([x.tobytes()], pa.binary()) for x in row]], names=_NAMES)
            k += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of docs(doc_id, text) as a table of segments in the shared folder."""
    text_batches(docs.sparkSession, 4000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return stored(docs.mapInArrow(_segments, _INDEX), "postings")


class Segment:
    """Look-ups in one row of the index."""

    def __init__(self, row: dict):
        take = lambda k, t: np.frombuffer(row[k], dtype=t)
        self.doc_ids, self.doc_starts, self.terms, self.term_first = take("doc_ids", np.int64), take("doc_starts", np.int64), take("terms", np.uint64), take("term_first", np.int64)
        self.positions = np.cumsum(take("gaps", np.uint32), dtype=np.uint32).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place among the terms, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def frequency(self, places: np.ndarray) -> np.ndarray:
        return self.term_first[places + 1] - self.term_first[places]

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.term_first[place] : self.term_first[place + 1]]

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow one another inside one document."""
        order = np.argsort(self.frequency(places), kind="stable")
        at = self.postings(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                return at
            other = self.postings(places[k])
            i = np.searchsorted(other, at + k)
            at = at[other[np.minimum(i, len(other) - 1)] == at + k]
        if len(at):
            doc = np.searchsorted(self.doc_starts, at, side="right") - 1
            at = at[(at >= 0) & (at + len(places) <= self.doc_starts[doc + 1])]
        return at

    def near(self, places: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most slop words away in the same document."""
        order = np.argsort(self.frequency(places), kind="stable")
        at = self.postings(places[order[0]])
        doc = np.searchsorted(self.doc_starts, at, side="right") - 1
        low, high = np.maximum(at - slop, self.doc_starts[doc]), np.minimum(at + slop, self.doc_starts[doc + 1] - 1)
        good = np.ones(len(at), dtype=bool)
        for k in order[1:]:
            other = self.postings(places[k])
            i = np.searchsorted(other, low)
            good &= (i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= high)
        return at[good]


class Phrases:
    """The distinct windows of benchmark items and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.items = [i for i, _ in items]
        by: dict[bytes, set[int]] = {}
        for k, (_, text) in enumerate(items):
            h = hash_text_words(text, alnum_bytes())
            if len(h):
                for i in range(max(1, len(h) - window + 1)):
                    by.setdefault(h[i : i + window].tobytes(), set()).add(k)
        self.of = [sorted(v) for v in by.values()]
        seqs = [np.frombuffer(k, dtype=np.uint64) for k in by]
        self.terms = np.unique(np.concatenate(seqs)) if seqs else np.zeros(0, dtype=np.uint64)
        self.windows = [np.searchsorted(self.terms, s) for s in seqs]
        self.lens = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.flat = np.concatenate(self.windows) if seqs else np.zeros(0, dtype=np.int64)
        self.first = np.cumsum(self.lens) - self.lens


def _match(segment: Segment, phrases: Phrases) -> dict[int, tuple[np.ndarray, np.ndarray, list[str]]]:
    """By document of the segment: starts and ends of the merged hit spans (from the document's first word), and item ids."""
    if not len(phrases.lens) or not len(segment.terms):
        return {}
    places = segment.find(phrases.terms)
    all_there = np.minimum.reduceat((places >= 0)[phrases.flat], phrases.first)
    n = int(segment.doc_starts[-1])
    edges = np.zeros(n + 1, dtype=np.int64)
    items: dict[int, set[int]] = {}
    for w in np.flatnonzero(all_there):
        at = segment.phrase(places[phrases.windows[w]])
        if len(at):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + phrases.lens[w], -1)
            for d in np.unique(np.searchsorted(segment.doc_starts, at, side="right") - 1):
                items.setdefault(int(d), set()).update(phrases.of[w])
    if not items:
        return {}
    hit = np.cumsum(edges)[:-1] > 0
    out = {}
    for d, found in items.items():
        a, b = segment.doc_starts[d], segment.doc_starts[d + 1]
        turn = np.diff(np.r_[False, hit[a:b], False].astype(np.int8))
        out[d] = (np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), sorted(phrases.items[k] for k in found))
    return out


def _spans_of(phrases):
    @lean
    def run(batches):
        query = phrases.value
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                found = _match(segment, query)
                n = np.diff(segment.doc_starts)
                none = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), [])
                got = [found.get(d, none) for d in range(len(segment.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(segment.doc_ids), pa.array(n), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    names=["segment", "row", "doc_id", "n_words", "starts", "ends", "items"],
                )

    return run


def item_passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES):
    """The benchmark's (item_id, text) rows in lists of about pass_bytes at most."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL").toLocalIterator()
    held, size = [], 0
    for item, text in rows:
        if held and size + len(text or "") > pass_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text or "")
    yield held


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document of the index: n_words, the merged spans of its words inside any window's occurrence
    (starts and ends, in words), and the ids of items with such windows, sorted as strings.

    The benchmark is the stated query set: it is looked up in passes of bounded size, each of them broadcast."""
    spark = index.sparkSession
    parts = [index.mapInArrow(_spans_of(spark.sparkContext.broadcast(Phrases(items, window))), _SPANS) for items in item_passes(benchmark, pass_bytes)]
    rows = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            rows = rows.unionByName(p)
        all_of = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  of one document
        rows = rows.groupBy("segment", "row", "doc_id", "n_words").agg(all_of("starts").alias("s"), all_of("ends").alias("e"), F.array_sort(F.array_distinct(all_of("items"))).alias("items"))
        spans = F.expr("""aggregate(array_sort(arrays_zip(s, e)), cast(array() as array<struct<s:int,e:int>>),
            (a, x) -> if(size(a) > 0 AND x.s <= element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s AS s, greatest(element_at(a, -1).e, x.e) AS e))), concat(a, array(struct(x.s AS s, x.e AS e)))))""")
        rows = rows.withColumn("m", spans).select("doc_id", "n_words", F.col("m.s").alias("starts"), F.col("m.e").alias("ends"), "items")
    return rows.select("doc_id", "n_words", "starts", "ends", "items")


def proximity_matches(index: DataFrame, benchmark: DataFrame, slop: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, position): every occurrence of an item's rarest term of the segment with all the item's other
    terms at most slop words away, in any order."""
    spark = index.sparkSession
    out = None
    for items in item_passes(benchmark, pass_bytes):
        held = spark.sparkContext.broadcast([(i, np.unique(hash_text_words(t, alnum_bytes()))) for i, t in items])

        @lean
        def run(batches, held=held):
            for batch in batches:
                for row in batch.to_pylist():
                    segment, rows = Segment(row), []
                    for item, terms in held.value:
                        places = segment.find(terms)
                        if len(terms) and (places >= 0).all():
                            for at in segment.near(places, slop):
                                d = int(np.searchsorted(segment.doc_starts, at, side="right")) - 1
                                rows.append((int(segment.doc_ids[d]), item, int(at - segment.doc_starts[d])))
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "position"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("position", pa.int64())]))

        part = index.mapInArrow(run, "doc_id long, item_id string, position long")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase_matches of all documents, with n_hit, n_items and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    found = phrase_matches(build_index(docs), benchmark, window)
    hit = F.expr("aggregate(arrays_zip(starts, ends), 0L, (a, x) -> a + x.ends - x.starts)")
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated: of rows that share a doc_id those with another text stay. Rows without a
    doc_id stay; all columns stay."""
    own, mark = fresh("bad_id", docs.columns), fresh("bad_text", docs.columns)
    text = lambda c: F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias(own)).distinct()
    # only rows of these ids are told apart by text: an id with several rows is looked up once more by its texts
    hit = docs.join(found, docs["doc_id"].cast("long") == found[own], "left_semi")
    several = hit.groupBy(F.col("doc_id").cast("long").alias(own)).agg(F.count_distinct(text("text")).alias("n")).where("n > 1").select(own)
    texts = stored(hit.join(several, hit["doc_id"].cast("long") == several[own], "left_semi").select(F.col("doc_id").cast("long").alias(own), F.col("text").cast("string").alias("text")).distinct().withColumn("doc_id", F.monotonically_increasing_id()), "texts-of-ids")
    clean = contamination(texts.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated").select(F.col("doc_id").alias("n"))
    stay = texts.join(clean, texts["doc_id"] == clean["n"]).select(own, text("text").alias(mark))
    out = docs.join(found, docs["doc_id"].cast("long") == found[own], "left_anti")
    back = docs.join(stay, (docs["doc_id"].cast("long") == stay[own]) & (text("text") == stay[mark]), "left_semi")
    return out.unionByName(back)


def contamination_brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain Python, for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [(i, w[k : k + window]) for i, t in items if i is not None and (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
