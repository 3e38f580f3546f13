"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (digits or signs among its letters, a letter three times in a row, letters set apart by
white space, underscores or signs) is taken as the output of a noisy channel: every character stands for itself, for the letters it
resembles, or for nothing (a separator, or one more of the letter before). The Viterbi path through this lattice under
a character trigram model is the restored word. Restored texts are scored by a logistic regression on their words and
the beginnings of words.

The model is fitted on at most sample_rows labelled rows (those of the smallest hash of doc_id, one of each equal
text). The character model counts the letters of all documents. Scoring reads every whole text.

Defined cases: a null or empty text has no words and gets the model's base score; rows keep their doc_id, null or
repeated, and a null one is in no training fold (held_out is true); a label row without doc_id or toxic takes no part in
fitting; without labels of both classes nothing can be learnt, every score is PRIOR and nothing is rejected; other
columns are ignored; an empty table gives no rows. A text is held by one task, whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, lean, stored, text_batches, text_steps

SAMPLE_ROWS = 20_000
#: In how many toxic texts of the sample a feature must occur, and the least log odds times root of its texts: bounds
#: by evidence; how many features pass is bounded by the sample alone.
LEAST, EVIDENCE = 5, 2.0
#: The score where nothing is known.
PRIOR = 0.05

#: What a sign or digit can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h", "%": "x",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LETTER = re.compile(f"[{LETTERS}]")
_RUNS = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_][^\w\s]*[0-9@$!|+(<€£¥*#%]|[0-9@$!|+(<€£¥*#%][^\w\s]*[^\W\d_]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_](?:[^\w\s]|_)+){3,}[^\W_](?![^\W_])")
_SPACED = re.compile(r"(?<!\S)(?:[^\s,;:]\s{1,3}){3,}[^\s](?=[\s.,;:!?]|$)")
_APART_WORD = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d]_+[^\W\d]")
_SIGNS = re.compile(r"[\W_]+")
#: What stands for white space in a run of single letters.
GAP = "\x1f"
_STRIP = ".,;:?\"'()[]{}<>…«»“”„-–—"
#: Costs in natural logarithms: a letter for a sign that resembles it, such a sign for nothing, another sign for nothing,
#: a repeated letter for nothing. What goes also saves its letter's own cost, so the second and the last are high.
SWAP, SKIP, DROP, AGAIN = 1.0, 9.0, 0.5, 3.5
#: A word's end at a separator inside a run of single letters.
BREAK = 1.0
_CLASS = np.zeros(0x250, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _i + 2
_N = len(LETTERS) + 2


def trigram_counts(words: list[str]) -> np.ndarray:
    """Counts of (letter, letter, letter) over words; 0 is a word's edge, 1 any other character."""
    text = "  " + "  ".join(words) + "  "
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    cls = np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], 0)
    cls = np.where((cls == 0) & (code != 32), 1, cls)
    return np.bincount((cls[:-2] * _N + cls[1:-1]) * _N + cls[2:], minlength=_N**3)


def text_trigrams(text: str) -> np.ndarray:
    """trigram_counts of all runs of letters of a text in lower case: edges are what isn't a letter."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    cls = np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], 0)
    cls = np.where((cls == 0) & (code >= 0x100), 1, cls)
    # one more edge between words, so that none looks into the word before
    edge = np.flatnonzero(cls == 0)
    cls = np.insert(np.r_[0, 0, cls, 0, 0], np.minimum(edge + 2, len(cls) + 2), 0)
    return np.bincount((cls[:-2] * _N + cls[1:-1]) * _N + cls[2:], minlength=_N**3)


class CharModel:
    """Interpolated character trigrams; log probabilities."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_N, _N, _N).astype(float)
        c3[:, 0, 0] = 0
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + _N)
        p2 = (c2 + 2 * p1) / (c2.sum(1, keepdims=True) + 2)
        self.log = np.log((c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)).tolist()

    def restore(self, token: str) -> str:
        """The likeliest reading of a token as a word; "" if it has no letter reading."""
        log = self.log
        # a reading is its last letter and the reading before: long runs of letters aren't copied
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for ch in token:
            options = [(ch, 0.0)] if _LETTER.match(ch) else [(x, SWAP + (0.5 if ch == "*" else 0)) for x in LEET.get(ch, "")]
            skip = AGAIN if ch == before else SKIP if ch in LEET else None if options else DROP
            before = ch
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, text) in states.items():
                if ch == GAP and text and text[1] != " ":
                    total = cost + BREAK - log[a][b][0]
                    if (0, 0) not in after or after[(0, 0)][0] > total:
                        after[(0, 0)] = (total, (text, " "))
                if skip is not None and ((a, b) not in after or after[(a, b)][0] > cost + skip):
                    after[(a, b)] = (cost + skip, text)
                for x, extra in options:
                    c = int(_CLASS[ord(x)])
                    total = cost + extra - log[a][b][c]
                    if (b, c) not in after or after[(b, c)][0] > total:
                        after[(b, c)] = (total, (text, x))
            states = after or states
        letters, text = [], min(((cost - log[a][b][0], (a, b)) for (a, b), (cost, text) in states.items() if text), default=(0, None))[1]
        text = states[text][1] if text else None
        while text:
            text, x = text
            letters.append(x)
        return "".join(reversed(letters))


@dataclass
class Restorer:
    """Words of texts with disguised ones restored. What it has restored it keeps, for a bounded number of tokens."""

    model: CharModel
    limit: int = 200_000
    kept: dict[str, list[str]] = field(default_factory=dict)

    def words_of(self, token: str) -> list[str]:
        """The words that a token, in lower case and without white space, stands for."""
        core = token.strip(_STRIP).rstrip("!*")
        if GAP not in core and not (_MIXED.search(core) or _THRICE.search(core) or _APART.search(core)):
            words = _RUNS.findall(core)
            # a word split by signs is read as one too
            if len(words) > 1 and _APART_WORD.search(core):
                words.append(_SIGNS.sub("", core))
            return words
        if (got := self.kept.get(core)) is None:
            if len(self.kept) >= self.limit:
                self.kept.clear()
            whole = self.model.restore(core)
            got = self.kept[core] = [*whole.split(), *_RUNS.findall(core)]
        return got

    @staticmethod
    def tokens(text: str) -> set[str]:
        low = text.lower()
        found = set(low.split())
        for m in _SPACED.finditer(low):
            found.add(re.sub(r"\s", GAP, re.sub(r"\s{2,}", GAP * 2, m[0])))
        return found


def features_of(word: str) -> list[str]:
    n = len(word)
    return [word, *([word[:4] + "*"] if n > 4 else []), *([word[:5] + "*"] if n > 5 else [])] if n > 2 else []


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    chars: CharModel


class Scorer:
    """One model in one worker."""

    def __init__(self, model: ToxicModel, limit: int = 400_000):
        self.model, self.restorer, self.limit = model, Restorer(model.chars), limit
        self.nothing: set[str] = set()
        self.hits: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        weights, found = self.model.weights, set()
        for token in Restorer.tokens(text) - self.nothing:
            if (got := self.hits.get(token)) is None:
                got = tuple(f for w in self.restorer.words_of(token) for f in features_of(w) if f in weights)
                if len(self.nothing) + len(self.hits) > self.limit:
                    self.nothing, self.hits = set(), {}
                if got:
                    self.hits[token] = got
                else:
                    self.nothing.add(token)
            found.update(got)
        z = self.model.bias + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-min(max(z, -50), 50))))


def _strings(column: pa.Array) -> list[str]:
    return column.cast(pa.large_string()).fill_null("").to_pylist()


@lean
def _chars(batches):
    total = np.zeros(_N**3, dtype=np.int64)
    for batch in batches:
        for at, n, _, _ in text_steps(batch.column(0), 1 << 20):
            total += text_trigrams(" ".join(_strings(batch.column(0).slice(at, n))).lower())
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])


def _text_features(text: str, restorer: Restorer) -> set[str]:
    return {f for token in Restorer.tokens(text) for w in restorer.words_of(token) for f in features_of(w)}


def _positive(chars):
    @lean
    def run(batches):
        restorer, count = Restorer(chars.value), {}
        for batch in batches:
            for text in _strings(batch.column(1)):
                for f in _text_features(text, restorer):
                    count[f] = count.get(f, 0) + 1
            if len(count) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["f", "n"])
                count = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["f", "n"])

    return run


def _vectors(chars, names):
    @lean
    def run(batches):
        restorer, index = Restorer(chars.value), names.value
        for batch in batches:
            rows = [sorted(index[f] for f in _text_features(t, restorer) if f in index) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "x"])

    return run


def _placed(place):
    """Vectors of the chosen features only."""

    @lean
    def run(batches):
        for batch in batches:
            rows = [r[r >= 0] for r in (place.value[np.array(x, dtype=np.int64)] for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "x"])

    return run


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, n: int, penalty: float = 0.03, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression on sets of features, by accelerated gradient steps. The
    smaller class counts twice as much as the other in all."""
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.maximum(np.bincount(flat, minlength=n), 1)
    scale = np.sqrt(size.astype(float))  # a diagonal preconditioner
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    heavy = np.where(y > 0.5, 1.0 / share, 0.5 / (1 - share))
    w, b = np.zeros(n), 0.0
    v, c, step = w.copy(), b, 4.0 / max(1.0, np.bincount(owner, minlength=len(y)).mean() + 1)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(owner, v[flat], len(y)), -50, 50)))
        g = (p - y) * heavy
        grad = np.bincount(flat, g[owner], n) + penalty * v
        w2, b2 = v - step * grad / scale**2 * 4, c - step * g.mean() * 4
        m = k / (k + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """The model of labels(doc_id, toxic) of docs(doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    few = few.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(sample_rows).drop("h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # few has at most sample_rows rows of two numbers
    sample = stored(texts.join(F.broadcast(few), "doc_id").select("toxic", "text").dropDuplicates(["toxic", "text"]), "labelled")
    held = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in held}
    counts = np.zeros(_N**3, dtype=np.int64)
    for r in texts.select("text").mapInArrow(_chars, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    chars = CharModel(counts)
    if len(n) < 2:
        return ToxicModel({}, float(np.log(PRIOR / (1 - PRIOR))), chars)
    chars_b = spark.sparkContext.broadcast(chars)
    seen = sample.where("toxic = 1").mapInArrow(_positive(chars_b), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    names = [r["f"] for r in seen.orderBy(F.desc("n"), "f").collect()]
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    vectors = stored(sample.mapInArrow(_vectors(chars_b, index), "toxic int, x array<int>"), "vectors")
    pos, both = np.zeros(len(names)), np.zeros(len(names))
    for f, p, k in vectors.select("toxic", F.explode("x").alias("f")).groupBy("f").agg(F.sum("toxic"), F.count("*")).collect():
        pos[f], both[f] = p, k
    odds = np.log((pos + 0.5) / (n[1] + 1)) - np.log((both - pos + 0.5) / (n[0] + 1))
    best = np.flatnonzero(np.abs(odds) * np.sqrt(both) >= EVIDENCE)
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    got = vectors.mapInArrow(_placed(spark.sparkContext.broadcast(place)), "toxic int, x array<int>").toArrow()
    rows = [x.values.to_numpy() for x in got.column("x")]
    w, b = fit_logistic(rows, got.column("toxic").to_numpy().astype(float), len(best))
    weights = {names[f]: float(x) for f, x in zip(best, w, strict=True)}
    # restoring expects the words that matter as readily as the corpus' own
    known = [f for f, x in weights.items() if x > 0.5 and not f.endswith("*")]
    extra = trigram_counts(known)
    return ToxicModel(weights, b, CharModel(counts + extra * max(1, int(counts.sum() * 0.05 / max(1, extra.sum())))))


def _scoring(model, text_at: int, name: str):
    @lean
    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for at, n, _, _ in text_steps(batch.column(text_at)):
                part = batch.slice(at, n)
                scores = [scorer.score(t) for t in _strings(part.column(text_at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: ToxicModel, name: str = "score") -> DataFrame:
    """docs with the score of each row's text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scoring(held, docs.columns.index("text"), name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _train_rows(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, _train_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't scored as toxic; every other row and all columns stay. Without labels of both classes all stay."""
    model = fit(docs, _train_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = fresh("toxic_score", docs.columns)
    return score(docs, model, name).where(F.col(name) < 0.5).drop(name)
