"""Vector codes, byte shards and whitening, against plain loops and exact fractions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

NAN, INF = float("nan"), float("inf")


def vectors(n=700, dim=8, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)).round(2)
    x[n // 2 :] = x[rnd.integers(0, 40, n - n // 2)] + (rnd.random((n - n // 2, dim)) < 0.02) * 0.25  # a third and more are copies
    rows = [(int(i), [float(c) for c in v], int(i % 7) if i % 5 else None) for i, v in enumerate(x)]
    return [*rows, (10_000, None, 1), (10_001, [], 1), (10_002, [NAN] * dim, 1), (10_003, [1.0] * (dim - 1) + [INF], 2), (10_004, [None, *[0.5] * (dim - 1)], 3), (5, rows[5][1], 2), (5, rows[6][1], 2), (None, rows[7][1], None)]


def usable(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, "c", 1.5) for r in vectors()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, x double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "vec_id long, embedding array<float>, label int")


def lloyd(rows, parts=4, words=256, rounds=4, scale=1024):
    kept = sorted(([i, label, [math.floor(scale * c) for c in v]] for i, v, label in usable(rows)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [c[:words] for c in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut[p]:
                own[nearest(v, books[p])[1]].append(v)
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if own[j] else e for j, e in enumerate(books[p])]
    found = [[nearest(c[k], b) for c, b in zip(cut, books, strict=True)] for k in range(len(kept))]
    error, by = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        by[r[1]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, r[1], by[r[1]]) for r, f, e in zip(kept, found, error, strict=True)), key=repr), sha


@pytest.mark.parametrize("words", [256, 12])
def test_vector_codes(table, words):
    from veridelta.llm import common
    from veridelta.llm import vector_codes as V

    rows, books = V.encode_vectors(table, words=words)
    found = common.join_totals(rows, "label", "error", "total")
    want, sha = lloyd(vectors(), words=words)
    assert sorted(((r.vec_id, r.code.hex(), r.error, r.label, r.total) for r in found.collect()), key=repr) == want
    assert hashlib.sha256(V.codebooks_text(books).encode()).hexdigest() == sha


def test_bounds_save_scans():
    from veridelta.llm import vector_codes as V

    rnd = np.random.default_rng(1)
    x = (rnd.normal(size=(3000, 4)) * 20).astype(np.int64) + np.repeat(rnd.integers(-9000, 9000, (30, 4)), 100, axis=0)
    book, saved = x[::25].copy(), []
    near, upper, lower = V.scan(x, book)
    for _ in range(6):
        after = np.array([x[near == j].sum(0) // max(1, (near == j).sum()) if (near == j).any() else e for j, e in enumerate(book)])
        saved.append(len(x) - V.reassign(x, V.Move.of(book, after), near, upper, lower))
        book = after
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all()
        assert (upper >= np.sqrt(d.min(1))).all()
        d[np.arange(len(x)), near] = 2**60
        assert (lower <= np.sqrt(d.min(1))).all()
    assert saved[-1] > len(x) / 2


def test_vector_codes_of_little(spark, empty):
    from veridelta.llm import vector_codes as V

    rows, books = V.encode_vectors(empty)
    assert rows.count() == 0 and V.codebooks_text(books) == ""
    one = spark.createDataFrame([(1, [0.1, 0.2, -0.3, 0.4])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.code.hex(), r.error, r.label) for r in V.encode_vectors(one)[0].collect()] == [(1, "00000000", 0, None)]
    big = spark.createDataFrame([(1, [2.0**40] * 4), (2, [-(2.0**40)] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        V.encode_vectors(big)
    far = spark.createDataFrame([(1, [2.0**18] * 4), (2, [-(2.0**18) + 0.5] * 4), (3, [2.0**18 - 1] * 4)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.error) for r in V.encode_vectors(far, words=1, rounds=0)[0].collect()) == [(1, 0), (2, 4 * (2**29 - 512) ** 2), (3, 4 * 1024**2)]
    with pytest.raises(ValueError):
        V.encode_vectors(spark.createDataFrame([(1, [1.0] * 6)], "vec_id long, embedding array<float>"))


def test_op11_against_plain_loops(spark, tmp_path):
    from veridelta.llm import vector_codes as V

    spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want, sha = lloyd(vectors())
    found = V.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found if r.vec_id is not None) == sorted((i, c, e, t) for i, c, e, _, t in want if i is not None)
    assert {r.codebooks_sha256 for r in found} == {sha}


def shards_by_loop(rows, shards):
    """Sizes in the order of doc_id, and the shard that each one's middle falls in."""
    total, at, out = sum(s for _, s in rows), 0, []
    for i, s in rows:
        out.append((i, s, (2 * at + s) * shards // (2 * total)))
        at += s
    return out


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_byte_shards(spark, shards):
    from veridelta.llm import sharding as S

    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randrange(300)) for i in range(400)] + [(400 + i, "same text") for i in range(300)] + [(900, "x" * 200_000), (901, None), (902, "")]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(7)
    got = S.byte_shards(df, shards)
    assert got.columns == ["doc_id", "text", "size", "shard", "size_", "shard_", "slot"]
    found = sorted(tuple(r) for r in got.select("doc_id", "size_", "shard_", "slot").collect())
    want = shards_by_loop(sorted((i, len((t or "").encode()) + 16) for i, t in rows), shards)
    assert [r[:3] for r in found] == want
    seen = defaultdict(int)
    for _, _, s, slot in found:
        assert slot == seen[s]
        seen[s] += 1
    total, most = sum(s for _, s, _ in want), max(s for _, s, _ in want)
    sums = defaultdict(int)
    for _, s, k in want:
        sums[k] += s
    assert all(abs(v - total / shards) <= most for v in sums.values())


def test_byte_shards_of_one_id_and_of_nothing(spark, tmp_path):
    from veridelta.llm import sharding as S

    df = spark.createDataFrame([(None if i % 3 else 4, f"text {i % 10}") for i in range(600)], "doc_id long, text string").repartition(5)
    got = S.byte_shards(df, 7).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(per) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert max(r.shard for r in got if r.doc_id is None) <= min(r.shard for r in got if r.doc_id == 4)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.byte_shards(none).count() == 0 and S.byte_shards(none.limit(0)).columns == ["doc_id", "text", "size", "shard", "slot"]
    written = S.write_shards(df, str(tmp_path / "out"), 7)
    assert sorted((r.shard, r.slot) for r in written.collect()) == sorted((r.shard, r.slot) for r in got)
    with pytest.raises(ValueError):
        S.byte_shards(df, 0)


def test_op12_digests(spark, tmp_path):
    from veridelta.llm import sharding as S

    rows = [(1, "a"), (2, None), (3, "ü" * 50), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, S.op12_byte_shards(spark, str(tmp_path)).select("doc_id", "size", "text_crc32", "law", "grown_shard").collect()))
    assert found == [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for i, t in rows]


def exact_whitening(rows):
    """n, sums, covariance as fractions, and x by row."""
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v, _ in usable(rows)]
    fit = sorted({v for _, v in x})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(dim)]
    cov = [[Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit), n**3) for b in range(dim)] for a in range(dim)]
    return x, n, sums, cov


def test_double_double_covariance(spark, table):
    from veridelta.llm import whitening as W

    _, n, sums, cov = exact_whitening(vectors())
    fit = W.integer_vectors(table).select("x").distinct()
    centre = W.centre_of(fit)
    assert (centre.n, centre.sums) == (n, sums)
    high, low = W.outer_products(fit, W._Centred(centre))
    worst = max(abs((Fraction(high[a, b]) + Fraction(low[a, b])) / n - cov[a][b]) for a in range(len(cov)) for b in range(len(cov)))
    assert worst < Fraction(1, 10**22)  # doubles alone have 16 digits


def test_whitening(spark, table):
    from veridelta.llm import whitening as W

    x, n, sums, cov = exact_whitening(vectors())
    values, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, q = values[::-1], q[:, ::-1]
    found = sorted(W.whiten(table).collect(), key=lambda r: (r.component, r.deviation, r.whitened))
    assert len(found) == len(x) * 8 and {r.n for r in found} == {n}
    dev = [(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), v) for _, v in x]
    for k in range(8):
        mine = [r for r in found if r.component == k + 1]
        assert [r.deviation for r in mine] == sorted(d for d, _ in dev)
        want = np.array([sum((float(Fraction(n * a - s, n)) * c for a, s, c in zip(v, sums, q[:, k], strict=True))) / math.sqrt(values[k]) for _, v in dev])
        got = np.array([r.whitened for r in mine])
        assert any(np.abs(np.sort(got) - np.sort(sign * want)).max() < 1e-8 for sign in (1, -1))
        assert {r.explained for r in mine} and abs(mine[0].explained / (values[k] / values.sum()) - 1) < 1e-10
    assert 0 <= found[0].identity_error < 1e-10 and len({r.identity_error for r in found}) == 1


def test_whitening_of_little(spark, empty):
    from veridelta.llm import whitening as W

    assert W.whiten(empty).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(9)], "vec_id long, embedding array<float>")
    assert W.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {(r.component, r.n, round(r.explained, 9)) for r in W.whiten(line).collect()} == {(1, 9, 1.0)}
    wide = spark.createDataFrame([(i, [2.0**40 * (i % 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.whiten(wide).collect()} == {None}
    with pytest.raises(Exception, match="one length"):
        W.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="2\\^52"):
        W.whiten(spark.createDataFrame([(1, [2.0**50])], "vec_id long, embedding array<double>"))
