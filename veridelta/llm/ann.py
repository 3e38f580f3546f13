"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Training (k-means of the coarse centroids, then of the residuals' parts) takes at most SAMPLE vectors, those of the
smallest hash. Every vector is indexed: equal vectors as one class with their ids, of which a search for k can use the
k + 1 smallest only. A search scores a probed list by asymmetric distance tables (the query's own inner products with
the centroid and with each codeword), keeps the best classes of each list and reranks them by the exact inner products
of the original vectors. The index is dealt out in groups of bounded size, each with a piece of every list, so a list
that holds a third of the data is many tasks; the queries are a stated set that meets every group in blocks. A task
keeps the best of all lists that a query probes before anything is sent.

Defined cases: vectors that are null, zero, of another length than the index's or hold null or non-finite components
take no part, nor do rows without an id; ties go to the smaller id; repeated rows of one id are one
candidate, with the vector nearest to the query, and one query, with its smallest vector; a query with
fewer candidates than k gets them all (classes beyond the reranked ones aside); empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, ragged, stored, text_batches

SAMPLE = 20_000
#: Classes of a group of the index, and queries of a block at least and at most: a block holds some megabytes, and the
#: index is copied once for each.
GROUP, BLOCKS = 262_144, (256, 16_384)
#: Parts of a vector, and codewords of each.
PARTS, WORDS = 16, 256
#: Share of the lists that a query probes, and classes reranked for each query.
PROBED, RERANKED = 0.65, 600


@dataclass
class Quantiser:
    """Bounded by its parameters, not by the data."""

    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, words, dim of a part)

    def assign(self, x: np.ndarray) -> np.ndarray:
        half = 0.5 * (self.centroids**2).sum(1)
        return np.concatenate([np.argmax(x[i : i + 4096] @ self.centroids.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        width = self.books.shape[2]
        out = np.empty((len(x), len(self.books)), dtype=np.uint8)
        for m, book in enumerate(self.books):
            part = rest[:, m * width : (m + 1) * width]
            out[:, m] = np.argmax(part @ book.T - 0.5 * (book**2).sum(1), axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, words): inner products of the queries' parts with the codewords."""
        width = self.books.shape[2]
        return np.stack([q[:, m * width : (m + 1) * width] @ book.T for m, book in enumerate(self.books)], axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        of = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - 0.5 * (centres**2).sum(1), axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))]).astype(np.float32)
    return centres


def fit_quantiser(sample: np.ndarray, rows: int, parts: int = PARTS, words: int = WORDS, seed: int = 7) -> Quantiser:
    """rows: of the whole table; there are about sqrt(rows) lists, 4096 at most."""
    rng = np.random.default_rng(seed)
    lists = int(min(4096, max(1, round(rows**0.5)), max(1, len(sample) // 8)))
    centroids = kmeans(sample, lists, rng)
    only = Quantiser(centroids, np.zeros((0, 0, 1)))
    rest = sample - centroids[only.assign(sample)]
    dim = sample.shape[1]
    while dim % parts:
        parts -= 1
    width = dim // parts
    return Quantiser(centroids, np.stack([_padded(kmeans(rest[:, m * width : (m + 1) * width], words, rng, 8), words) for m in range(parts)]))


def _padded(book: np.ndarray, words: int) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], words - len(book), axis=0)]) if len(book) < words else book


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, dim) of rows that take part; v as doubles."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0D)")


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _indexing(quantiser):
    @lean
    def run(batches):
        q = quantiser.value
        for batch in batches:
            x = _vectors(batch.column(1)).astype(np.float32)
            cell = q.assign(x)
            codes = q.encode(x, cell)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["class_id", "cell", "code"])

    return run


_FOUND = "query long, class_id long, near float"


def _scan(quantiser, probed: float, keep: int):
    """Of a block of queries and a group of the index: each query's best classes among the lists that it probes."""

    def run(key, left, right):
        q, n = quantiser.value, right.num_rows
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]]
        if n and left.num_rows:
            cells = right.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            classes = right.column("class_id").to_numpy()[order]
            # one row per part, so that a table is read along it
            codes = np.ascontiguousarray(np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(n, -1)[order].T)
            first = np.searchsorted(cells[order], np.arange(len(q.centroids) + 1))
            size = np.diff(first)
            query, x = left.column("query").to_numpy(), _vectors(left.column("v")).astype(np.float32)
            near = x @ q.centroids.T
            lists = max(1, min(len(size), round(len(size) * probed) + 8))
            probes = np.argsort(-near, axis=1, kind="stable")[:, :lists]
            for i in range(len(query)):
                cell = np.sort(probes[i])
                at = ragged(first[cell], size[cell])
                score = np.repeat(near[i, cell], size[cell])
                for m, table in enumerate(q.tables(x[i : i + 1])[0]):
                    score += table[codes[m, at]]
                best = np.argpartition(-score, keep - 1)[:keep] if keep < len(score) else np.arange(len(score))
                for held, part in zip(found, (np.full(len(best), query[i]), classes[at[best]], score[best].astype(np.float32)), strict=True):
                    held.append(part)
        return pa.table([np.concatenate(f) for f in found], names=["query", "class_id", "near"])

    return run


@dataclass
class Index:
    """classes: (class_id, v, ids) of distinct vectors; rows: (class_id, cell, code) of every one of them."""

    quantiser: Quantiser
    classes: DataFrame
    rows: DataFrame
    n: int
    k: int


def build_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, sample: int = SAMPLE) -> Index | None:
    """None if no row takes part."""
    spark = vectors.sparkSession
    text_batches(spark, 4096)
    rows = usable(vectors, id_column, vector_column)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return None
    rows = rows.where(F.size("v") == dims["d"]).withColumn("key", F.xxhash64("v"))
    # of equal vectors the k + 1 smallest ids: each partition keeps as many before the shuffle
    ranked = rows.withColumn("r", F.dense_rank().over(W.partitionBy("key", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = stored(ranked.groupBy("key", "v").agg(F.min("id").alias("class_id"), F.array_sort(F.collect_set("id")).alias("ids")).select("class_id", "v", "ids"), "vector-classes")
    n = classes.count()
    taken = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    quantiser = fit_quantiser(_vectors(taken.column("v")).astype(np.float32), n)
    held = spark.sparkContext.broadcast(quantiser)
    coded = stored(classes.select("class_id", "v").mapInArrow(_indexing(held), "class_id long, cell int, code binary"), "vector-codes")
    return Index(quantiser, classes, coded, n, k)


def search(index: Index, queries: DataFrame, probed: float = PROBED, reranked: int = RERANKED) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(id): rows of the index, each against all others."""
    spark = index.classes.sparkSession
    quantiser = spark.sparkContext.broadcast(index.quantiser)
    named = index.classes.select(F.col("class_id").alias("query"), "v")
    asked = stored(queries.groupBy("id").agg(F.min("v").alias("v")).join(named, "v").select("id", "query"), "queries")
    wanted = stored(named.join(asked.select("query").distinct(), "query", "left_semi"), "query-classes")
    groups, n = max(1, -(-index.n // GROUP)), wanted.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // min(max(-(-n * groups // tasks), BLOCKS[0]), BLOCKS[1])))
    # a group is a random part of the index: its share of the best, half as many again and some more
    keep = min(reranked, -(-reranked * 3 // (2 * groups)) + 64)
    left = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = index.rows.withColumn("group", F.pmod(F.xxhash64("class_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(_scan(quantiser, probed, keep), _FOUND)
    short = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "class_id"))).where(F.col("r") <= reranked).select("query", "class_id")
    exact = short.join(index.classes, "class_id").join(wanted.withColumnRenamed("v", "q"), "query")
    exact = exact.select("query", "ids", F.expr("aggregate(zip_with(q, v, (a, b) -> a * b), 0D, (a, x) -> a + x)").alias("score"))
    ids = exact.withColumn("vec_id", F.explode("ids")).groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= index.k + 1)
    best = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    own = F.expr(f"slice(filter(best, x -> x.vec_id <> id), 1, {index.k})")
    return asked.join(best, "query").select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, usable(vectors, "vec_id", "embedding").where("id % 20 = 0"))


def nearest_brute(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int = 20) -> list[tuple[int, int, int, float]]:
    """For tests: (query_id, rank, vec_id, score) by all inner products."""
    out = []
    for q in queries:
        score = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return out
