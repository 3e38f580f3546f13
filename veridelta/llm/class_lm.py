"""Language-model scoring by Brown's class-based bigrams.

Every training word has a class. The most frequent words (seeds) and, standing for all others, symbols of the words'
endings and beginnings are clustered by exchange: one symbol at a time moves to the class where the class bigrams'
likelihood is highest. Then each other word of the training texts goes, by its own counts of the classes before and after
it, to the class under which these are likeliest; this runs on the executors, in buckets of the hash space. Classes and
seeds grow with the training tokens. A token's probability is the class transition's times the word's emission by its
class (add-half, with a place for unknown words); it is interpolated with the add-half unigram. An unknown word has the
class of its spelling's symbol. All counts are over every training text.

Texts are coded once, in chunks of some megabytes with their own vocabularies. Words' contexts are summed within a task
first, then over chunks in buckets; counts and classes go back to each chunk, so that no vocabulary is held in one place.

Defined cases: a null or empty text is the end token alone; rows without a doc_id take no part; repeated rows are
separate texts; without training rows every word is unknown and scores 0; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, discard, find_words, hash_words, lean, mix, space_bytes, stored, text_batches, text_steps

#: Words of the exact exchange at least, spelling symbols, classes at least.
SEEDS, SHAPES, CLASSES = 1024, 256, 48
#: Sweeps of exchange clustering at most.
SWEEPS = 12
#: Weight of the class model against the unigram.
CLASS_WEIGHT = 0.9
#: Vocabulary entries of chunks in a bucket of the hash space.
BUCKET_ENTRIES = 500_000
#: Context counts that a task sums up before it sends them.
HELD_CONTEXTS = 2_000_000
_CHUNK = "chunk string, tokens long, doc_ids binary, train binary, n_words binary, vocabulary binary, shapes binary, counts binary, codes binary"
_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def _shapes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, shapes: int) -> np.ndarray:
    """A number for each word from its first and last bytes."""
    last = np.maximum(lens - 1, 0)
    low = lambda at: _LOWER[raw[at]].astype(np.uint64)
    h = low(starts + last) | (low(starts + np.maximum(last - 1, 0)) << np.uint64(8)) | (low(starts) << np.uint64(16))
    return (mix(h) % np.uint64(shapes)).astype(np.uint16)


def _chunks(fold: int, of: int, shapes: int):
    @lean
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, n, raw, offsets in text_steps(batch.column(1)):
                starts, lens, first = find_words(raw, offsets, space_bytes())
                vocabulary, where, codes = np.unique(hash_words(raw, starts, lens), return_index=True, return_inverse=True)
                docs = ids[at : at + n]
                train = np.array([zlib.crc32(str(d).encode()) % of != fold for d in docs.tolist()])
                counts = np.bincount(codes[np.repeat(train, np.diff(first))], minlength=len(vocabulary))
                row = (f"{part}-{k}", int(counts.sum() + train.sum()), docs.astype("<i8"), train.astype("u1"), np.diff(first).astype("<i8"), vocabulary.astype("<u8"), _shapes(raw, starts[where], lens[where], shapes).astype("<u2"), counts.astype("<u4"))
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in row[2:]], pa.array([_packed(codes)], pa.binary())], names=_NAMES)

    return run


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _spread(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if n else b"", kind)


def _packed(codes: np.ndarray) -> bytes:
    """Codes by byte planes, compressed: the upper bytes hardly vary, and Spark's shuffles compress less."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(codes) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """Codes of n words; none where the column was left out."""
    if not data:
        return np.zeros(0, dtype="<u4")
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def sizes_for(tokens: int) -> tuple[int, int]:
    """Seeds and classes for so many training tokens: classes grow with their fourth root, so that the table of class pairs grows with the square root."""
    classes = max(CLASSES, round(tokens**0.25))
    return max(SEEDS, 4 * classes), classes


@dataclass
class Chunk:
    doc_ids: np.ndarray
    train: np.ndarray
    n_words: np.ndarray
    vocabulary: np.ndarray
    shapes: np.ndarray
    counts: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        rest = [np.frombuffer(row[k], t) for k, t in zip(_NAMES[2:-1], ("<i8", "u1", "<i8", "<u8", "<u2", "<u4"), strict=True)]
        return cls(*rest, _unpacked(row["codes"], int(rest[2].sum())))


_PART = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("words", pa.binary()), ("shapes", pa.binary()), ("counts", pa.binary())])
_PART_SQL = "bucket int, chunk string, words binary, shapes binary, counts binary"
_TOP_SQL = "top_words array<long>, top_counts array<long>, top_shapes array<long>, shape_tokens array<long>, shape_types array<long>"
_CONTEXT = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary()), ("counts", pa.binary())])
_CONTEXT_SQL = "bucket int, words binary, sizes binary, contexts binary, counts binary"
_BACK_SQL = "chunk string, bucket int, words int, counts binary, classes binary, types array<long>"


def _cuts(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of the hash space begin and end among sorted words."""
    return np.searchsorted(((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _parts(buckets: int, counted: bool):
    """A chunk's vocabulary in slices of the hash space; counted: its training words with their counts, else all words without."""

    @lean
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                keep = c.counts > 0 if counted else slice(None)
                words, shapes, counts = c.vocabulary[keep], c.shapes[keep], c.counts[keep] if counted else c.counts[:0]
                cuts = _cuts(words, buckets)
                rows = [(b, row["chunk"], words[i:j].tobytes(), _squeezed(shapes[i:j], "<u2"), _squeezed(counts[i:j], "<u4")) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PART.types, strict=True)], schema=_PART)

    return run


def _tops(top: int, shapes: int):
    """A bucket's most frequent training words and its words' counts by spelling symbol."""

    def run(key, table):
        words = table.column("words").to_pylist()
        each = lambda name, kind: np.concatenate([_spread(x, kind, len(w) // 8) for x, w in zip(table.column(name).to_pylist(), words, strict=True)])
        own, first, code = np.unique(np.frombuffer(b"".join(words), "<u8"), return_index=True, return_inverse=True)
        total = np.bincount(code, each("counts", "<u4"), len(own)).astype(np.int64)
        shape = each("shapes", "<u2")[first].astype(np.int64)
        best = np.lexsort((own, -total))[:top]
        best = best[total[best] > 0]
        out = (own[best].view(np.int64), total[best], shape[best], np.bincount(shape, total, shapes).astype(np.int64), np.bincount(shape[total > 0], minlength=shapes))
        return pa.table([pa.array([x], pa.list_(pa.int64())) for x in out], names=[x.split()[0] for x in _TOP_SQL.split(", ")])

    return run


def _symbols(c: Chunk, top_words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each vocabulary entry's symbol: 1.. for top words (sorted by hash; order: their ranks), then the shapes."""
    out = 1 + len(top_words) + c.shapes.astype(np.int64)
    if len(top_words):
        at = np.minimum(np.searchsorted(top_words, c.vocabulary), len(top_words) - 1)
        is_top = top_words[at] == c.vocabulary
        out[is_top] = 1 + order[at[is_top]]
    return out


def _sequence(c: Chunk, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's tokens (symbols, with an end, 0, after each text), each one's vocabulary entry (-1: end), and its document."""
    ends = np.cumsum(c.n_words + 1)
    entry = np.full(int(ends[-1]) if len(ends) else 0, -1, dtype=np.int64)
    is_word = np.ones(len(entry), dtype=bool)
    is_word[ends - 1] = False
    entry[is_word] = c.codes
    sequence = np.zeros(len(entry), dtype=np.int64)
    sequence[is_word] = symbol[c.codes]
    return sequence, entry, np.repeat(np.arange(len(ends)), c.n_words + 1)


def _bigrams(top):
    @lean
    def run(batches):
        words, order, k = top.value
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                sequence, _, doc = _sequence(c, _symbols(c, words, order))
                before = np.r_[0, sequence[:-1]]
                train = c.train.astype(bool)[doc]
                counts = np.bincount(before[train] * k + sequence[train], minlength=k * k)
                total = counts if total is None else total + counts
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Each symbol's class by exchange clustering of a symbol bigram matrix; symbol 0, the end, keeps class 0 to itself."""
    k = len(counts)
    size = counts.sum(0) + counts.sum(1)
    of = np.zeros(k, dtype=np.int64)
    rest = np.argsort(-size[1:], kind="stable") + 1
    of[rest] = 1 + np.arange(k - 1) % max(1, classes - 1)
    f = lambda x: x * np.log(np.maximum(x, 1))
    member = np.zeros((k, classes))
    member[np.arange(k), of] = 1
    left, right = counts.T @ member, counts @ member  # by symbol: tokens before it, after it, of each class
    pair = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in rest[size[rest] > 0]:
            a, own = of[w], counts[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            pair[a] -= r
            pair[:, a] -= l
            pair[a, a] -= own
            out, into = pair.sum(1), pair.sum(0)
            diagonal = np.diag(pair)
            gain = (f(pair + r) - f(pair)).sum(1) + (f(pair + l[:, None]) - f(pair)).sum(0)
            gain += f(diagonal + r + l + own) - f(diagonal + r) - f(diagonal + l) + f(diagonal)
            n_out, n_in = r.sum() + own, l.sum() + own
            gain -= f(out + n_out) - f(out) + f(into + n_in) - f(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b] += r
            pair[:, b] += l
            pair[b, b] += own
            if b != a:
                of[w] = b
                moved += 1
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return of


@dataclass
class Seeds:
    """The exchange's result; bounded by the number of its symbols."""

    words: np.ndarray  # sorted hashes
    order: np.ndarray  # their symbols less 1
    counts: np.ndarray  # their training counts, by hash
    of: np.ndarray  # class by symbol
    pair: np.ndarray  # training tokens of each class after each class
    tokens: int  # N
    types: int  # V
    texts: int

    def classes(self, c: Chunk) -> np.ndarray:
        return self.of[_symbols(c, self.words, self.order)]


def seed_classes(chunks: DataFrame, tops: DataFrame, seeds: int, shapes: int, classes: int) -> Seeds:
    spark = chunks.sparkSession
    shape = {r[0]: (r[1], r[2]) for r in tops.select(F.posexplode(F.arrays_zip("shape_tokens", "shape_types"))).groupBy("pos").agg(F.sum("col.shape_tokens"), F.sum("col.shape_types")).collect()}
    zipped = tops.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("t"))
    best = zipped.select("t.*").orderBy(F.desc("top_counts"), "top_words").limit(seeds).collect()
    words = np.array([r[0] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    k = 1 + len(words) + shapes
    held = spark.sparkContext.broadcast((words[order], order, k))
    got = chunks.mapInArrow(_bigrams(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(k * k)
    counts[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(k, k)
    of = exchange(counts, classes)
    member = np.zeros((k, classes))
    member[np.arange(k), of] = 1
    texts = int(counts[:, 0].sum())
    n_words, n_types = sum(x for x, _ in shape.values()), sum(x for _, x in shape.values())
    return Seeds(words[order], order, np.array([r[1] for r in best], dtype=np.int64)[order], of, member.T @ counts @ member, n_words + texts, n_types + (texts > 0), texts)


def _merged(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """Context counts of several chunks as one row for each bucket that has any."""
    words, contexts, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((contexts, words))
    words, contexts, counts = words[by], contexts[by], counts[by]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])])
    words, contexts, counts = words[first], contexts[first], np.add.reduceat(counts, first)
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    own, sizes = words[start], np.diff(np.r_[start, len(words)])
    cuts, ends = _cuts(own, buckets), np.r_[0, np.cumsum(sizes)]
    rows = [(b, own[i:j].tobytes(), _squeezed(sizes[i:j], "<u4"), _squeezed(contexts[ends[i] : ends[j]], "<u2"), _squeezed(counts[ends[i] : ends[j]], "<i8")) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)


def _contexts(seeds, buckets: int):
    """Of each training word that is no seed, how many tokens of each class stand before it (a context of that number) and after it (that number plus the classes)."""

    @lean
    def run(batches):
        s, held, size = seeds.value, [], 0
        k = len(s.pair)
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                symbol = _symbols(c, s.words, s.order)
                sequence, entry, doc = _sequence(c, symbol)
                cls = s.of[sequence].astype(np.int64)
                train = c.train.astype(bool)[doc]
                at = np.flatnonzero(train & (sequence > len(s.words)))
                # each text begins behind an end and ends with one, so both neighbours of a word are in its own text or ends
                before = np.where(at > 0, cls[at - 1], 0)
                key, n = np.unique(np.r_[entry[at] * (2 * k) + before, entry[at] * (2 * k) + k + cls[at + 1]], return_counts=True)
                held.append((c.vocabulary[key // (2 * k)], (key % (2 * k)).astype(np.uint16), n))
                size += len(n)
                if size > HELD_CONTEXTS:
                    yield _merged(held, buckets)
                    held, size = [], 0
        if size:
            yield _merged(held, buckets)

    return run


def likeliest(words: np.ndarray, contexts: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class under which each word's neighbours are likeliest. words: 0.. ascending, one entry for each of its contexts.

    With a word's tokens in class b, the bigrams' log-likelihood holds, for each token before it of class a, log P(b | a)
    and, for each after it of class c, log P(c | b), and for each of its own tokens -log of b's tokens. Class 0 is the end's."""
    k = len(pair)
    chance = np.log((pair + 0.1) / (pair.sum(1, keepdims=True) + 0.1 * k))
    by_context = np.concatenate([chance - np.log(pair.sum(0) + 1), chance.T])
    by_context[:, 0] = -np.inf
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    out = np.zeros(len(start), dtype=np.int64)
    step = max(1, 4_000_000 // k)  # contexts at once
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + step, side="right")) - 1)
        end = start[j] if j < len(start) else len(words)
        weighed = by_context[contexts[start[i] : end]] * counts[start[i] : end, None]
        out[i:j] = np.add.reduceat(weighed, start[i:j] - start[i], axis=0).argmax(1)
        i = j
    return out


def _assigned(seeds):
    """A bucket's training words get their classes; each chunk's slice gets its words' counts and classes. A row without a chunk holds how many words each class got."""

    def run(key, left, right):
        s = seeds.value
        k = len(s.pair)
        own = total = of = np.zeros(0, dtype=np.int64)
        if len(right):
            held = []
            for words, sizes, contexts, counts in zip(*[right.column(x).to_pylist() for x in ("words", "sizes", "contexts", "counts")], strict=True):
                sizes = _spread(sizes, "<u4", len(words) // 8)
                at = int(sizes.sum())
                held.append((np.repeat(np.frombuffer(words, "<u8"), sizes), _spread(contexts, "<u2", at), _spread(counts, "<i8", at)))
            word, context, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((context, word))
            word, context, n = word[by], context[by], n[by]
            own, code = np.unique(word, return_inverse=True)
            total = np.bincount(code, n * (context < k), len(own)).astype(np.int64)
            of = likeliest(code, context, n, s.pair)
        chunk, counts, classes, sizes = left.column("chunk").to_pylist(), [], [], []
        for words, shapes in zip(left.column("words").to_pylist(), left.column("shapes").to_pylist(), strict=True):
            words, shapes = np.frombuffer(words, "<u8"), _spread(shapes, "<u2", len(words) // 8)
            count, cls = np.zeros(len(words), dtype=np.int64), s.of[1 + len(s.words) + shapes.astype(np.int64)]
            for found, their_counts, their_classes in ((own, total, of), (s.words, s.counts, s.of[1 + s.order])):
                if len(found):
                    at = np.minimum(np.searchsorted(found, words), len(found) - 1)
                    hit = found[at] == words
                    count[hit], cls[hit] = their_counts[at[hit]], their_classes[at[hit]]
            counts.append(_squeezed(count, "<i8"))
            classes.append(_squeezed(cls, "<u2"))
            sizes.append(len(words))
        bucket = [*left.column("bucket").to_pylist(), None]
        types = [*[None] * len(chunk), np.bincount(of, minlength=k)]
        return pa.table([pa.array([*chunk, None], pa.string()), pa.array(bucket, pa.int32()), pa.array([*sizes, None], pa.int32()), pa.array([*counts, None], pa.binary()), pa.array([*classes, None], pa.binary()), pa.array(types, pa.list_(pa.int64()))], names=["chunk", "bucket", "words", "counts", "classes", "types"])

    return run


_CLASSED = f"{_CHUNK}, totals binary, classes binary"


def _joined(key, left, right):
    parts = sorted(zip(*[right.column(x).to_pylist() for x in ("bucket", "words", "counts", "classes")], strict=True))
    totals, classes = (b"".join(_spread(x[i], kind, x[1]).tobytes() for x in parts) for i, kind in ((2, "<i8"), (3, "<u2")))
    n = len(left)
    return left.append_column("totals", pa.array([totals] * n, pa.binary())).append_column("classes", pa.array([classes] * n, pa.binary()))


def _class_of_token(c: Chunk, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = np.frombuffer(row["classes"], "<u2").astype(np.int64)
    return _sequence(c, of)


def _class_counts(classes: int):
    """Training tokens of each class after each class."""

    @lean
    def run(batches):
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                cls, _, doc = _class_of_token(c, row)
                train = c.train.astype(bool)[doc]
                total += np.bincount(np.r_[0, cls[:-1]][train] * classes + cls[train], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


@dataclass
class ClassModel:
    """What scoring needs besides the words' counts and classes; bounded by the number of classes."""

    transition: np.ndarray  # log10 of class given class before
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int  # N
    types: int  # V
    texts: int


def score_chunk(row: dict, m: ClassModel, weight: float = CLASS_WEIGHT) -> list[np.ndarray]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of a chunk's texts."""
    c, totals = Chunk.of(row), np.frombuffer(row["totals"], "<i8")
    cls, entry, doc = _class_of_token(c, row)
    n = len(c.doc_ids)
    count = np.where(entry >= 0, totals[entry] if len(totals) else 0, m.texts)
    base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = np.where(first, 0, np.r_[0, cls[:-1]]) if len(cls) else cls
    emission = np.log10((count + 0.5) / (m.class_tokens[cls] + 0.5 * (m.class_types[cls] + 1)))
    emission[entry < 0] = 0.0
    both = np.log10(weight * 10 ** (m.transition[before, cls] + emission) + (1 - weight) * 10**base)
    known = np.bincount(doc, count > 0, n).astype(np.int64)
    score = np.bincount(doc, both, n)
    return [c.doc_ids, ~c.train.astype(bool), c.n_words + 1, known, np.full(n, m.tokens), np.bincount(doc, base, n), score, 10 ** (-score / (c.n_words + 1))]


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scored(model):
    @lean
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in score_chunk(row, model.value)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def fit(docs: DataFrame, fold: int = 1, of: int = 5, shapes: int = SHAPES) -> tuple[DataFrame, ClassModel]:
    """The coded texts of docs(doc_id, text), each word with its training count and class, and the model of the texts whose crc32(doc_id as text) mod of isn't fold."""
    spark = docs.sparkSession
    text_batches(spark, 4000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    chunks = stored(docs.mapInArrow(_chunks(fold, of, shapes), _CHUNK), "chunks")
    text_batches(spark, 4)
    size, tokens = chunks.agg(F.sum(F.length("vocabulary")), F.sum("tokens")).first()
    buckets = max(1, -(-(size or 0) // 8 // BUCKET_ENTRIES))
    seeds, classes = sizes_for(tokens or 0)
    entries = chunks.select("chunk", "tokens", *_NAMES[2:8], F.lit(b"").alias("codes"))
    tops = stored(entries.mapInArrow(_parts(buckets, True), _PART_SQL).groupBy("bucket").applyInArrow(_tops(seeds, shapes), _TOP_SQL), "tops")
    s = seed_classes(chunks, tops, seeds, shapes, classes)
    discard(tops)
    held = spark.sparkContext.broadcast(s)
    contexts = chunks.mapInArrow(_contexts(held, buckets), _CONTEXT_SQL)
    slices = entries.mapInArrow(_parts(buckets, False), _PART_SQL).drop("counts")
    back = stored(slices.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(_assigned(held), _BACK_SQL), "classes")
    nothing = [F.lit(b"").alias(x) for x in ("vocabulary", "shapes", "counts")]
    coded = chunks.select("chunk", "tokens", "doc_ids", "train", "n_words", *nothing, "codes")  # scoring needs no hashes
    words = stored(coded.groupBy("chunk").cogroup(back.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(_joined, _CLASSED), "classed")
    got = words.mapInArrow(_class_counts(classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros(classes * classes)
    pair[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    pair = pair.reshape(classes, classes)
    types = np.bincount(s.of[1 + s.order], minlength=classes)
    for at, n in back.where("chunk IS NULL").select(F.posexplode("types").alias("class", "n")).groupBy("class").agg(F.sum("n")).collect():
        types[at] += n
    discard(chunks, back)
    transition = np.log10((pair + 0.1) / (pair.sum(1, keepdims=True) + 0.1 * classes))
    return words, ClassModel(transition, pair.sum(0), types, s.tokens, s.types, s.texts)


def lm_scores(docs: DataFrame, fold: int = 1, of: int = 5, shapes: int = SHAPES) -> DataFrame:
    """Scores of docs(doc_id, text), and their perplexity per token, by a model of those whose crc32(doc_id as text) mod of isn't fold."""
    words, model = fit(docs, fold, of, shapes)
    return words.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), _SCORED)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def base_brute(docs: list[tuple], fold: int = 1, of: int = 5) -> list[tuple]:
    """Plain Python, for tests: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    import re
    from collections import Counter

    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = {d: zlib.crc32(str(d).encode()) % of == fold for d, _ in docs}
    count = Counter(w for d, t in docs if not held[d] for w in words(t))
    n, v = sum(count.values()), len(count)
    return [(d, held[d], len(words(t)), sum(count[w] > 0 for w in words(t)), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in docs]
