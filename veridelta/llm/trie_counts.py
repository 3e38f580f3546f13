"""Token counts by trie-shared dynamic programming.

A text's tokens are the likeliest unigram segmentation of its pre-tokens into entries of a public vocabulary, where an
entry of rank r has the weight 1 / (r + 1) (ranks follow frequency). A worker inserts the distinct pre-tokens of its
step in a trie, in sorted order: a pre-token keeps the forward scores of the prefix that it shares with the one before,
computes the others once, and stores its count at its end.

Ties in score go to the fewest tokens. Defined cases: a null or empty text has 0 tokens; rows keep their doc_id, null or
repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .common import lean, text_batches, text_steps
from .pool import Pool


class TrieCounter:
    """One vocabulary in one worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        scale = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
        self.cost = {t: math.log(r + 1) + scale for t, r in ranks.items()}
        #: By an entry's last byte: the lengths that entries with that end have. Keeps look-ups few.
        self.longest = max(map(len, ranks))
        self.ends: dict[bytes, tuple[int, ...]] = {}
        by: dict[bytes, set[int]] = {}
        for t in ranks:
            by.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: tuple(sorted(v)) for k, v in by.items()}
        self.findall = regex.compile(pattern).findall
        self.runs_of_space = re.compile(r"\s\s|[\x00\x1c-\x1f]").search
        self.words = Pool(self._words, 300_000)
        self.pieces = Pool(self._pieces, 300_000)

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each of the sorted distinct words."""
        cost, ends = self.cost, self.ends
        path, score, tokens, out = b"", [0.0], [0], []
        for w in words:
            shared, top = 0, min(len(w), len(path))
            while shared < top and w[shared] == path[shared]:
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for e in range(shared + 1, len(w) + 1):
                best, n = score[e - 1] + cost[w[e - 1 : e]], tokens[e - 1] + 1
                for size in ends.get(w[e - 2 : e], ()) if e > 1 else ():
                    if size > e:
                        break
                    c = cost.get(w[e - size : e])
                    if c is not None:
                        c += score[e - size]
                        if c < best or c == best and tokens[e - size] + 1 < n:
                            best, n = c, tokens[e - size] + 1
                score.append(best)
                tokens.append(n)
            path = w
            out.append(tokens[-1])
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out = np.empty(len(raw), dtype=np.uint32)
        out[order] = self.counts([raw[i] for i in order])
        return out, np.ones(len(raw), dtype=np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = self.words.runs([self.findall(p[1:] if p[:1] == "\x00" else " " + p) for p in pieces])
        total = np.r_[0, np.cumsum(flat, dtype=np.int64)][np.r_[0, np.cumsum(n)]]
        return np.diff(total), np.ones(len(pieces), dtype=np.int64)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        whole = [bool(self.runs_of_space(t)) for t in texts]
        lists = [[] if w or not t else ["\x00" + (p := t.split(" "))[0], *p[1:]] for t, w in zip(texts, whole, strict=True)]
        flat, n = self.pieces.runs(lists)
        total = np.diff(np.r_[0, np.cumsum(flat, dtype=np.int64)][np.r_[0, np.cumsum(n)]])
        slow = [i for i, w in enumerate(whole) if w]
        if slow:
            flat, n = self.words.runs([self.findall(texts[i]) for i in slow])
            total[slow] = np.diff(np.r_[0, np.cumsum(flat, dtype=np.int64)][np.r_[0, np.cumsum(n)]])
        return total


@cache
def trie_counter(path: str, pattern: str) -> TrieCounter:
    return TrieCounter(path, pattern)


def _counting(path: str, pattern: str):
    @lean
    def run(batches):
        counter = trie_counter(path, pattern)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            for i, n, _, _ in text_steps(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(counter.of_texts(column.slice(i, n).to_pylist()))], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of docs(doc_id, text)."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counting(path, pattern), "doc_id long, n_tokens long")


def op8_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def count_brute(text: str | None, path: str, pattern: str) -> int:
    """For tests: every pre-token by itself, all substrings tried."""
    import regex

    ranks = read_ranks(path)
    scale = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
    total = 0
    for w in regex.findall(pattern, text or ""):
        b = w.encode()
        best = [(0.0, 0)]
        for e in range(1, len(b) + 1):
            best.append(min((best[s][0] + math.log(ranks[b[s:e]] + 1) + scale, best[s][1] + 1) for s in range(e) if b[s:e] in ranks))
        total += best[-1][1]
    return total
