"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding: the rows (word, position, token) of distinct pre-tokens join the merge table; a recursive query contracts
each word's leftmost pair of minimum rank until no word has a pair left. Words of more than FEW bytes first find every
vocabulary token that stands in them. A round then contracts all pairs that no token of lower rank can break up by
taking one of their halves first (of equal pairs in a row every second one, from the left), and always the leftmost pair
of minimum rank; early contractions need merges whose new token makes no lower rank, a fixed property of the merge
table. After some rounds words are cut where no token reaches across any more, and only what isn't done goes on, so long
random text takes a time in proportion to its length. Decoding: the rows (document, position, id) join the vocabulary
and are aggregated in the order of their positions.

Texts are cut into pre-tokens by the tokenizer's pattern. Where a text has no two white-space characters in a row, a cut
at each space is one of the pattern's own, so the pattern runs once for each distinct piece between spaces; other texts
go through the pattern whole.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows keep their doc_id, null or repeated;
other columns are ignored; an empty table gives no rows. A text is held by one task, and a pre-token of many megabytes
takes some hundred bytes of memory for each of its own; positions have 40 bits.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from contextlib import closing
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ragged, text_batches, text_steps
from .pool import Pool

#: Distinct pre-tokens of one recursive query, and their bytes.
QUERY_WORDS, QUERY_BYTES = 20_000, 400_000
#: Rows that the rounds of one query hold together.
ROUND_ROWS = 2_000_000
#: Text that is encoded and decoded at once.
TEXT_BYTES = 2 << 20
_ENCODED = "doc_id long, n_tokens long, ids binary"

#: One round for long words. w: the segment's number, k: the position of a token's first byte; found: every token of the
#: vocabulary that stands anywhere in the text, from s to e. A pair is contracted unless a token of lower rank could take
#: one of its halves first: one that stands there and begins and ends where tokens do now.
_MERGE_LONG = """
WITH RECURSIVE step AS (
  SELECT w, k, id, 0 AS n FROM seq
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT w, k, id, n, lag(k) OVER o AS before, lead(k) OVER o AS mid, lead(id) OVER o AS next_id, lead(w) OVER o AS next_w,
            coalesce(lead(k, 2) OVER o, 1::BIGINT << 60) AS stop, row_number() OVER o AS j FROM step WINDOW o AS (ORDER BY k)),
   pairs AS MATERIALIZED (
     SELECT p.w, p.k, p.j, p.before, p.mid, p.stop, m.id AS r, m.safe FROM p JOIN merges m ON m.pair = (p.id << 32) + p.next_id WHERE p.next_w = p.w AND p.n < {rounds}),
   live AS MATERIALIZED (SELECT s, e, r FROM found WHERE s IN (SELECT k FROM p) AND e IN (SELECT k FROM p UNION ALL SELECT e FROM ends)),
   taken AS MATERIALIZED (
     SELECT x.k FROM pairs x JOIN live o ON o.e = x.mid WHERE o.s < x.k AND (o.r < x.r OR (o.r = x.r AND o.s IS DISTINCT FROM x.before))
     UNION ALL SELECT x.k FROM pairs x JOIN live o ON o.s = x.mid WHERE o.e > x.stop AND o.r < x.r),
   least AS MATERIALIZED (SELECT w, min((r << 40) | k) & ((1::BIGINT << 40) - 1) AS k FROM pairs GROUP BY w),
   runs AS MATERIALIZED (
     SELECT x.k, x.mid, x.r, x.safe, x.k IN (SELECT k FROM taken) AS late, x.j - row_number() OVER (PARTITION BY x.w, x.r ORDER BY x.k) AS run, x.w FROM pairs x),
   hits AS MATERIALIZED (
     SELECT k, mid, r FROM (
       SELECT k, mid, r, safe, row_number() OVER q AS i, bool_or(late) OVER q AS late FROM runs WINDOW q AS (PARTITION BY w, r, run ORDER BY k ROWS UNBOUNDED PRECEDING))
     WHERE safe AND i % 2 = 1 AND NOT late OR k IN (SELECT k FROM least))
   SELECT p.w, p.k, coalesce(h.r, p.id), p.n + 1
   FROM p LEFT JOIN hits h ON h.k = p.k WHERE p.w IN (SELECT w FROM least) AND p.k NOT IN (SELECT mid FROM hits))
)
SELECT step.k, step.id, b.n FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY 1) b ON b.w = step.w AND b.n = step.n ORDER BY step.k
"""
#: One pair a round, for words of at most FEW bytes. k: the word's number, then the position of the token's first byte.
_MERGE_ONE = """
WITH RECURSIVE step AS (
  SELECT k, id, 0 AS n FROM seq
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT k, id, n, k >> 24 AS w, lag(k) OVER o AS before, lead(k) OVER o AS after, lead(id) OVER o AS next_id FROM step WINDOW o AS (ORDER BY k)),
   b AS (
     SELECT p.w, min((m.id << 24) | (p.k & 16777215)) AS best FROM p JOIN merges m ON m.pair = (p.id << 32) + p.next_id
     WHERE p.after >> 24 = p.w AND p.n < {rounds} GROUP BY 1)
   SELECT p.k, CASE WHEN p.k & 16777215 = b.best & 16777215 THEN b.best >> 24 ELSE p.id END, p.n + 1
   FROM p JOIN b ON b.w = p.w WHERE p.before IS NULL OR p.before <> ((b.w << 24) | (b.best & 16777215)))
)
SELECT step.k, step.id, b.n FROM step JOIN (SELECT k >> 24 AS w, max(n) AS n FROM step GROUP BY 1) b ON b.w = step.k >> 24 AND b.n = step.n ORDER BY step.k
"""
FEW = 48
#: Rounds of one query for long words: after them, segments are cut where no token can reach across any more.
LONG_ROUNDS = 4
_DECODE = "SELECT d, string_agg(piece, '') AS s FROM (SELECT d, piece FROM tokens JOIN vocabulary USING (id) ORDER BY k) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def merge_table(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, and the merges: pairs of ids, the new id, and whether no merge with it has a lower rank."""
    ranks = read_ranks(path)
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, new = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    lowest = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, left, new)
    np.minimum.at(lowest, right, new)
    return ranks, (left << 32) + right, new, lowest[new] > new


class ByteBpe:
    """One tokenizer in one task."""

    def __init__(self, path: str, pattern: str):
        import re

        import duckdb
        import regex

        self.ranks, pair, new, safe = merge_table(path)
        self.findall = regex.compile(pattern).findall
        self.runs_of_space = re.compile(r"\s\s|[\x00\x1c-\x1f]").search
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", pair=pa.array(pair), id=pa.array(new), safe=pa.array(safe))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int64()), piece=pa.array([t.decode("latin-1") for t in self.ranks]))
        self.automaton = None
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.words = Pool(self._words, 200_000)
        self.pieces = Pool(self._pieces, 200_000)

    def close(self) -> None:
        """A worker goes on to tasks of other stages, which need the memory."""
        self.db.close()
        self.words.clear()
        self.pieces.clear()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        k = (np.repeat(np.arange(len(words)), n) << 24) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids, done = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)], []
        while len(k):
            rounds = max(16, ROUND_ROWS // len(k))
            self.db.register("seq", pa.table({"k": k, "id": ids}))
            got = self.db.sql(_MERGE_ONE.format(rounds=rounds)).to_arrow_table()
            self.db.unregister("seq")
            k, ids, more = got.column(0).to_numpy(), got.column(1).to_numpy(), got.column(2).to_numpy() >= rounds
            done.append((k[~more], ids[~more]))
            k, ids = k[more], ids[more]
        k, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(k, kind="stable")
        return ids[order], np.bincount(k >> 24, minlength=len(words))

    def _standing(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and rank of every token of two bytes or more that stands in a word, words being one after the other."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t, r in self.ranks.items():
                if len(t) > 1:
                    self.automaton.add_word(t.decode("latin-1"), (len(t), r))
            self.automaton.make_automaton()
        ends, sizes, ranks, at = array("q"), array("q"), array("q"), 0
        for w in words:
            for e, (n, r) in self.automaton.iter(w.decode("latin-1")):
                ends.append(at + e + 1)
                sizes.append(n)
                ranks.append(r)
            at += len(w)
        e, n, r = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, np.int64) for x in (ends, sizes, ranks))
        return e - n, e, r

    def _merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        total = int(n.sum())
        fixed = np.zeros(total + 1, dtype=bool)  # edges that stay
        fixed[np.cumsum(n)] = True
        s, e, r = self._standing(words)
        k, done = np.arange(total), []
        ids = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.db.execute(f"SET memory_limit = '{300 + total // 2500}MB'")
        while True:
            # a token still matters if it begins and ends where tokens do and isn't one of them; where none reaches across is a cut
            edge = fixed.copy()
            edge[k] = True
            inner = np.cumsum(edge) - edge  # edges before each position
            live = edge[s] & edge[e] & (inner[e] - inner[s] > 1)
            s, e, r = s[live], e[live], r[live]
            across = np.zeros(total + 2, dtype=np.int64)
            np.add.at(across, s + 1, 1)
            np.add.at(across, e, -1)
            cut = np.cumsum(across)[k] == 0
            w = np.cumsum(cut)
            open_ = np.bincount(w)[w] > 1
            done.append((k[~open_], ids[~open_]))
            fixed[k[~open_]] = True
            k, ids, w = k[open_], ids[open_], w[open_]
            if not len(k):
                break
            for name, table in (("seq", {"w": w, "k": k, "id": ids}), ("found", {"s": s, "e": e, "r": r}), ("ends", {"e": np.unique(e)})):
                self.db.register(name, pa.table(table))
            got = self.db.sql(_MERGE_LONG.format(rounds=LONG_ROUNDS)).to_arrow_table()
            for name in ("seq", "found", "ends"):
                self.db.unregister(name)
            k, ids, last = got.column(0).to_numpy(), got.column(1).to_numpy(), got.column(2).to_numpy() < LONG_ROUNDS
            # segments that have no pair left
            done.append((k[last], ids[last]))
            fixed[k[last]] = True
            k, ids = k[~last], ids[~last]
        k, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(k, kind="stable")
        return ids[order], np.bincount(np.searchsorted(np.cumsum(n), k, side="right"), minlength=len(words))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens."""
        raw = [w.encode() for w in words]
        known = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int64, len(raw))
        counts, parts, at = np.ones(len(raw), dtype=np.int64), [], np.flatnonzero(known < 0)
        size = np.fromiter((len(raw[i]) for i in at), np.int64, len(at))
        # the longer ones last: words of one query take about as many rounds
        at, size = at[np.argsort(size, kind="stable")], np.sort(size)
        total, i = np.cumsum(size), 0
        while i < len(at):
            j = max(i + 1, min(i + QUERY_WORDS, int(np.searchsorted(total, (total[i - 1] if i else 0) + QUERY_BYTES, side="right"))))
            few = int(np.searchsorted(size, FEW, side="right"))
            j = few if i < few < j else j
            merge = self._merge if size[j - 1] <= FEW else self._merge_long
            ids, counts[at[i:j]] = merge([raw[x] for x in at[i:j].tolist()])
            parts.append(ids)
            i = j
        out, ends = np.empty(int(counts.sum()), dtype=np.int64), np.cumsum(counts)
        out[ends[known >= 0] - 1] = known[known >= 0]
        if parts:
            out[ragged(ends[at] - counts[at], counts[at])] = np.concatenate(parts)
        return out, counts

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces between spaces; one that begins its text is marked by \x00."""
        return self.words.runs([self.findall(p[1:] if p[:1] == "\x00" else " " + p) for p in pieces])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and their numbers."""
        whole = [i for i, t in enumerate(texts) if self.runs_of_space(t)]
        skip = set(whole)
        lists = []
        for i, t in enumerate(texts):
            pieces = [] if i in skip or not t else t.split(" ")
            if pieces:
                pieces[0] = "\x00" + pieces[0]
            lists.append(pieces)
        flat, counts = self.pieces.runs(lists)
        if whole:
            other, n = self.words.runs([self.findall(texts[i]) for i in whole])
            runs, extra = np.split(flat, np.cumsum(counts)[:-1]), np.split(other, np.cumsum(n)[:-1])
            for i, ids in zip(whole, extra, strict=True):
                runs[i] = ids
            flat, counts = np.concatenate(runs), np.array([len(r) for r in runs])
        return flat, counts

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each run of ids as bytes."""
        out = [b""] * len(counts)
        if len(flat):
            self.db.register("tokens", pa.table({"d": np.repeat(np.arange(len(counts)), counts), "k": np.arange(len(flat)), "id": flat.astype(np.int64)}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for d, s in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                out[d] = s.encode("latin-1")
        return out


def _encoding(path: str, pattern: str):
    @lean
    def run(batches):
        with closing(ByteBpe(path, pattern)) as bpe:
            for batch in batches:
                ids = batch.column(0)
                column = batch.column(1).cast(pa.large_string()).fill_null("")
                for i, n, _, _ in text_steps(column):
                    flat, counts = bpe.encode(column.slice(i, n).to_pylist())
                    offsets = np.r_[0, np.cumsum(counts) * 4].astype(np.int64)
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(counts, pa.int64()), data.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs(doc_id, text); ids are little-endian unsigned 32-bit integers in a row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoding(path, pattern), _ENCODED)


def _decoding(path: str, pattern: str, limit: int):
    @lean
    def run(batches):
        with closing(ByteBpe(path, pattern)) as bpe:
            for batch in batches:
                runs = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column(2).to_pylist()]
                texts, at = [], 0
                while at < len(runs):
                    end, total = at, 0
                    while end < len(runs) and (end == at or total + len(runs[end]) <= limit):
                        total += len(runs[end])
                        end += 1
                    texts += bpe.decode(np.concatenate(runs[at:end]), np.array([len(r) for r in runs[at:end]]))
                    at = end
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_documents' rows with decoded: the bytes of the ids."""
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(_decoding(path, pattern, 1_500_000), _ENCODED + ", decoded binary")


def _both(path: str, pattern: str):
    @lean
    def run(batches):
        with closing(ByteBpe(path, pattern)) as bpe:
            for batch in batches:
                column = batch.column(1).cast(pa.large_string()).fill_null("")
                for i, n, _, _ in text_steps(column, TEXT_BYTES):
                    flat, counts = bpe.encode(column.slice(i, n).to_pylist())
                    ids, ends = flat.astype("<u4"), np.cumsum(counts)
                    runs = [ids[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                    decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode(flat, counts)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(counts, pa.int64()), pa.array(runs, pa.binary()), pa.array(decoded)], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_documents' rows with decoded_sha256, the hash of what decode_documents gives; one worker does both."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_both(path, pattern), _ENCODED + ", decoded_sha256 string")


def _public(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _public(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): one row for each document; its text and other columns end here."""
    return _public(docs)


def byte_bpe_brute(text: str | None, path: str, pattern: str) -> tuple[int, str, str]:
    """For tests: (n_tokens, ids_sha256, decoded_sha256) by the tiktoken library."""
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    ids = e.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(e.decode_bytes(ids)).hexdigest()
