"""Product codes of integer vectors: Lloyd's rounds with Hamerly's bounds, one upper and one lower bound for each part.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts; each part position has
a codebook. A round is one pass over a table in the shared folder whose rows hold the integers and, for each part, its
entry, an upper bound of the distance to that entry and a lower bound of the distance to the second nearest. The bounds
move with the codebook; a part is compared with all entries only if its upper bound, tightened to the exact distance
first, isn't strictly below the lower bound or half the way to the entry's own nearest neighbour. As a tie makes
the bounds equal at best, every tie is scanned and goes to the lower index. Distances are exact integers; bounds are
rounded outwards. A pass also leaves each task's sums of the parts of every entry in the same table (entries times
dimension numbers a task), which Spark adds up; only codebooks come to the driver.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; null and repeated ids
are rows like others (nulls come last when the codebooks start, equal ids by their vectors); with fewer vectors than
entries a codebook is as short as that; entries without parts stay; other columns are ignored; an empty table gives no
rows; vectors of several lengths, lengths that can't be cut evenly, and components so large that a squared distance
doesn't fit 63 bits raise an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import discard, join_totals, lean, stored, vector_block, whole_vector

PARTS, WORDS, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are compared with a whole codebook at once.
SCAN_ROWS = 8192
_SUMS = "part int, entry int, n long, sums array<long>"
_BOUNDS = "code binary, upper array<double>, lower array<double>, error long"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 2**-50), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * np.where(x < 0, 1 + 2**-50, 1 - 2**-50), -np.inf)


def _number(x: np.ndarray, book: np.ndarray) -> type:
    """float where all terms of squared distances are exact in it, else int64 if they fit."""
    most = max((int(abs(int(f(a)))) for a in (x, book) if a.size for f in (np.min, np.max)), default=0)
    bound = 4 * most * most * max(1, book.shape[1])
    if bound >= 2**63:
        raise OverflowError("squared distances don't fit 63 bits")
    return np.float64 if bound < 2**53 else np.int64


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    t = _number(x, book)
    x, c = x.astype(t), book.astype(t)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def squared_to(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their own entries."""
    _number(x, entries)
    return ((x - entries) ** 2).sum(1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index), and bounds of the distances to it and to the second nearest."""
    near, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    for i in range(0, len(x), SCAN_ROWS):
        d = squared(x[i : i + SCAN_ROWS], book)
        rows, a = np.arange(len(d)), d.argmin(1)
        near[i : i + SCAN_ROWS], upper[i : i + SCAN_ROWS] = a, _up(np.sqrt(d[rows, a].astype(float)))
        if len(book) > 1:
            d = d.astype(float)
            d[rows, a] = np.inf
            lower[i : i + SCAN_ROWS] = _down(np.sqrt(d.min(1)))
    return near, upper, lower


@dataclass
class Move:
    """A codebook and how it came to be from the last one; bounded by entries and dimension."""

    book: np.ndarray
    own: np.ndarray  # how far each entry moved, at most
    other: np.ndarray  # how far any other entry moved, at most
    half: np.ndarray  # half the way to the nearest other entry, at least

    @classmethod
    def of(cls, before: np.ndarray, book: np.ndarray) -> Move:
        own, k = _up(np.sqrt(squared_to(book, before).astype(float))), len(book)
        others = np.where(np.eye(k, dtype=bool), 0.0, own[None, :]).max(1) if k else own
        apart = squared(book, book).astype(float)
        np.fill_diagonal(apart, np.inf)
        return cls(book, own, others, _down(0.5 * np.sqrt(apart.min(1))) if k else own)


def reassign(x: np.ndarray, move: Move, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings entries and bounds up to date, in place; returns how many rows were compared with the whole codebook."""
    upper[:], lower[:] = _up(upper + move.own[near]), _down(lower - move.other[near])
    enough = np.maximum(lower, move.half[near])
    open_ = np.flatnonzero(~(upper < enough))
    upper[open_] = _up(np.sqrt(squared_to(x[open_], move.book[near[open_]]).astype(float)))
    open_ = open_[~(upper[open_] < enough[open_])]
    near[open_], upper[open_], lower[open_] = scan(x[open_], move.book)
    return len(open_)


class Sums:
    """Sums and counts of the parts of each entry, of one task."""

    def __init__(self, books: list[np.ndarray]):
        self.sums = [np.zeros(b.shape, np.int64) for b in books]
        self.n = [np.zeros(len(b), np.int64) for b in books]

    def add(self, p: int, x: np.ndarray, near: np.ndarray) -> None:
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        if len(first):
            self.sums[p][near[order][first]] += np.add.reduceat(x[order], first, axis=0)
        self.n[p] += np.bincount(near, minlength=len(self.n[p]))

    def rows(self):
        for p, n in enumerate(self.n):
            at = np.flatnonzero(n)
            yield pa.array(np.full(len(at), p), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at]), _lists(self.sums[p][at])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _round(moves, first: bool, schema: pa.Schema):
    """A pass: rows (vec_id, label, x[, code, upper, lower]) to the same with new codes and bounds, then the sums."""

    @lean
    def run(batches):
        now = moves.value
        books = [m.book for m in now]
        parts, width = len(books), books[0].shape[1]
        sums = Sums(books)
        for batch in batches:
            n = batch.num_rows
            x = vector_block(batch.column(2), parts * width)
            if first:
                codes, upper, lower = np.zeros((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts))
            else:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                upper, lower = vector_block(batch.column(4), parts).copy(), vector_block(batch.column(5), parts).copy()
            error = np.zeros(n, np.int64)
            for p, move in enumerate(now):
                own = x[:, p * width : (p + 1) * width]
                a, u, v = codes[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                if first:
                    a, u, v = scan(own, move.book)
                else:
                    reassign(own, move, a, u, v)
                codes[:, p], upper[:, p], lower[:, p] = a, u, v
                error += squared_to(own, move.book[a])
                sums.add(p, own, a)
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            columns = [*batch.columns[:3], code, _lists(upper), _lists(lower), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, f.type) for f in list(schema)[7:])], schema=schema)
        for columns in sums.rows():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), f.type) for f in list(schema)[:7]), *columns], schema=schema)

    return run


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with each used entry at its parts' floored mean: entries times dimension sums come to the driver."""
    each = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("i", "s"))
    total = each.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = [b.copy() for b in books]
    for r in total.collect():
        out[r["part"]][r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return out


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the vectors that take part, as integers. Without a label column labels are null."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>").alias("v")).where(whole_vector("v"))
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def encode_vectors(vectors: DataFrame, parts: int = PARTS, words: int = WORDS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, x, code, error) of vectors(vec_id, embedding[, label]), and the final codebooks.

    code: one byte for each part, the index of its entry; error: the squared distances to the entries, summed."""
    if not 1 <= words <= 256:
        raise ValueError("a code is one byte: 1 to 256 words")
    rows = integer_vectors(vectors, scale)
    start = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(words).collect()]
    widths = {len(x) for x in start}
    if len(widths) > 1 or any(w % parts for w in widths):
        raise ValueError(f"vectors of one length that {parts} divides are needed")
    width = widths.pop() // parts if widths else 1
    first = np.array(start, dtype=np.int64).reshape(len(start), parts * width)
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    if not start:
        schema = StructType([*rows.schema.fields, *(f for f in StructType.fromDDL(_BOUNDS).fields if f.name in ("code", "error"))])
        return rows.sparkSession.createDataFrame([], schema), books
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), *StructType.fromDDL(_BOUNDS).fields, *StructType.fromDDL(_SUMS).fields])
    arrow, spark = to_arrow_schema(schema), rows.sparkSession
    state, moves = None, [Move.of(b, b) for b in books]
    for i in range(rounds + 1):
        source = rows if state is None else state.where("part IS NULL").select("vec_id", "label", "x", "code", "upper", "lower")
        after = stored(source.mapInArrow(_round(spark.sparkContext.broadcast(moves), state is None, arrow), schema), "codes")
        if state is not None:
            discard(state)
        state = after
        if i < rounds:
            moved = _moved(state, books)
            moves, books = [Move.of(a, b) for a, b in zip(books, moved, strict=True)], moved
    return state.where("part IS NULL").select("vec_id", "label", "x", "code", "error"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(map(str, np.concatenate([b.reshape(-1) for b in books]).tolist())) if books else ""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = join_totals(rows.drop("x"), "label", "error", "label_error")
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """Every round spelt out: all distances, the nearest entry, the floored means."""
    parts, words = PARTS, WORDS
    assign = """a{i} AS MATERIALIZED (
  SELECT k, p, any_value(v) AS v, min(d * {words} + e)::BIGINT % {words} AS e, min(d * {words} + e)::BIGINT // {words} AS d
  FROM (SELECT q.k, q.p, q.v, b.e, list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, b.v) + list_inner_product(b.v, b.v) AS d FROM parts q JOIN b{i} b USING (p))
  GROUP BY k, p)"""
    update = """b{j} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM (
      SELECT p, e, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{i}, range(1, (SELECT max(len(v)) FROM parts) + 1) r(i) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e))"""
    steps = []
    for i in range(ROUNDS):
        steps += [assign.format(i=i, words=words), update.format(i=i, j=i + 1)]
    steps.append(assign.format(i=ROUNDS, words=words))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS k, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
parts AS MATERIALIZED (SELECT k, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, k - 1 AS e, v FROM parts WHERE k <= {words}),
{(","+chr(10)).join(steps)},
books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{ROUNDS})),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha FROM books) AS codebooks_sha256
FROM coded JOIN kept USING (k)"""
