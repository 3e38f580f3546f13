"""Shards of near equal bytes: contiguous runs of the documents in the order of doc_id.

The documents are dealt out by ranges of (doc_id, hash of the text) and sorted, and the sorted table is written to the
shared folder with each row's partition and place in it, so what follows counts on rows that can't move. The
partitions' sizes, added up in order, place each partition in the whole; a target k / shards of all bytes falls into one
partition, and only such partitions (fewer than shards) are read again for running sums, of two numbers a row. A
document belongs to the side of a target where its own middle lies, so a shard misses equal size by no more than half a
document at each end; a document larger than a shard's share may leave a shard empty. The texts are shuffled once;
everything is DataFrame functions.

Defined cases: a null text has no bytes; null doc_ids come first; rows of one doc_id are in the order of their texts'
hashes, and equal ones are interchangeable, so a doc_id that many rows have is cut like others; groups of equal texts
aren't kept together; all columns stay, and shard columns get underscores where their names are taken; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored

SHARDS, ROW_BYTES = 40, 16
#: monotonically_increasing_id: the partition above 33 bits of the place in it.
_BITS = 33


def _cuts(held: DataFrame, pos: str, size: str, parts: list, shards: int) -> list[int]:
    """The position of the first row of each shard but the first."""
    ends, begin = [], []
    total = 0
    for r in parts:
        begin.append(total)
        total += r["bytes"]
        ends.append(total)
    wanted = []
    for k in range(1, shards):
        at = bisect_left([e * shards for e in ends], k * total)
        # twice the middle of a row below this: before the target
        wanted.append((k, parts[at]["part"], -(-2 * k * total // shards) - 2 * begin[at]))
    spark = held.sparkSession
    inside = reduce(lambda a, b: a | b, [F.col(pos).between(p << _BITS, (p + 1 << _BITS) - 1) for p in sorted({p for _, p, _ in wanted})])
    rows = held.where(inside).select(F.shiftright(pos, _BITS).alias("part"), F.col(pos).alias("pos"), F.col(size).alias("size"))
    before = F.sum("size").over(W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    middles = rows.select("part", (2 * before + F.col("size")).alias("middle"))
    # fewer rows than shards
    targets = F.broadcast(spark.createDataFrame(wanted, "k int, part long, below long"))
    n = {r["k"]: r["n"] for r in middles.join(targets, "part").groupBy("k").agg(F.count_if(F.col("middle") < F.col("below")).alias("n")).collect()}
    return [(p << _BITS) + n[k] for k, p, _ in wanted]


def _places(parts: list, cuts: list[int]) -> list[tuple]:
    """For each partition: the shard its first row is in, the cuts inside, and the rows before each of these shards."""
    before, rows = {}, 0
    for r in parts:
        before[r["part"]] = rows
        rows += r["rows"]
    starts = [0, *(before[c >> _BITS] + (c & (1 << _BITS) - 1) for c in cuts)]
    out, at = [], 0
    for r in parts:
        first = r["part"] << _BITS
        while at < len(cuts) and cuts[at] <= first:
            at += 1
        end = at
        while end < len(cuts) and cuts[end] < first + r["rows"]:
            end += 1
        out.append((r["part"], before[r["part"]], at, cuts[at:end], starts[at : end + 1]))
    return out


def byte_shards(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with size, shard (from 0) and slot (the place in its shard, from 0) as the last columns."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark, columns = docs.sparkSession, list(docs.columns)
    name = {}
    for n in ("size", "shard", "slot", "shard_order", "shard_tie", "shard_pos", "shard_part"):
        name[n] = fresh(n, [*columns, *name.values()])
    size, pos, part = name["size"], name["shard_pos"], name["shard_part"]
    text = F.col("text").cast("string")
    rows = docs.withColumns({
        size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes, name["shard_order"]: F.xxhash64(text), name["shard_tie"]: F.monotonically_increasing_id()})
    key = [F.asc_nulls_first("doc_id"), F.asc(name["shard_order"]), F.asc(name["shard_tie"])]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    held = stored(rows.drop(name["shard_order"], name["shard_tie"]).withColumn(pos, F.monotonically_increasing_id()), "in-order")
    # one row for each partition of the sort
    parts = held.groupBy(F.shiftright(pos, _BITS).alias("part")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    cuts = _cuts(held, pos, size, parts, shards) if parts and shards > 1 else []
    places = spark.createDataFrame(_places(parts, cuts), "part long, rows_before long, first_shard int, cuts array<long>, starts array<long>")
    found = held.withColumn(part, F.shiftright(pos, _BITS)).join(F.broadcast(places.select(F.struct("*").alias("at__"))), F.col(part) == F.col("at__.part"))
    passed = F.size(F.filter("at__.cuts", lambda c: c <= F.col(pos)))
    slot = F.col("at__.rows_before") + F.col(pos).bitwiseAND((1 << _BITS) - 1) - F.get("at__.starts", passed)
    return found.select(*columns, size, (F.col("at__.first_shard") + passed).cast("int").alias(name["shard"]), slot.alias(name["slot"]))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes byte_shards' rows as Parquet folders by shard, each file in the order of the slots, and reads them back."""
    rows = byte_shards(docs, shards)
    shard, slot = rows.columns[-2:]
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def op12_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql() -> str:
    """The CRC goes through the text's hexadecimal digits, the lower one of each byte first."""
    return f"""
WITH small AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT i::BIGINT AS i FROM range(16) r(i)))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
e AS (SELECT doc_id, size, list_transform(range(1, size - {ROW_BYTES} + 1), lambda i: [position(h[2 * i] IN '123456789ABCDEF'), position(h[2 * i - 1] IN '123456789ABCDEF')]) AS v FROM d),
f AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], flatten(v)::BIGINT[]), lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])), 4294967295) AS crc FROM e, small),
g AS (SELECT doc_id, size, crc, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM f),
s AS (SELECT *, ((2 * upto - size) * {SHARDS} // (2 * total))::INT AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM s"""
