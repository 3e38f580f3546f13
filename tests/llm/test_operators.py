"""Each operator against brute force, on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, passage, bench = prose(3000), prose(60), prose(20)
    near = long.split()
    near[1500] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "One  TWO three"), (6, long), (7, long), (8, " ".join(near)), (9, prose(30) + " " + passage + " " + prose(30)),
        (10, passage + "\n" + prose(10)), (11, prose(25) + " " + bench + " end"), (12, bench.upper()), (12, bench), (13, "x" * 5000), (14, "loop it " * 80), (15, "café <|endoftext|> ñ 中文 😀 don't\x1c stop 12345"),
        *[(100 + i, passage if i % 3 else prose(80)) for i in range(12)],
    ]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, 1, "u", 0.5, None) for i, t in [*rows, (None, "no id")]], "doc_id long, text string, n int, key string, score double, component long").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_files(spark, docs, none, rows, tmp_path):
    from tokenizers import Tokenizer

    from veridelta.llm import token_files as T

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = T.write_token_files(docs, str(tmp_path / "a"), path, end_id=2, files=3)
    found = sorted(map(tuple, T.read_digests(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(i for i, _ in rows)
    at, want = 0, []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    for r in found:
        assert r[1] == at
        at += r[2]
    assert sorted((r[0], r[2], r[3]) for r in found) == sorted(want)
    one = T.TokenFile(files[0][1])
    assert one.find(int(one.doc_ids[0])) is not None and one.find(-5) is None
    assert T.write_token_files(none, str(tmp_path / "b"), path) == [] and T.read_digests(spark, []).count() == 0


def test_byte_bpe(docs, none, rows):
    from veridelta.llm import byte_bpe as B

    path = P.path("byte_bpe_50k.tiktoken")
    df = B.encode_documents(docs, path, P.PATTERN)
    want = sorted([(i, *B.byte_bpe_brute(t, path, P.PATTERN)) for i, t in [*rows, (None, "no id")]], key=repr)
    assert sorted([(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in B.decode_documents(df, path, P.PATTERN).collect()], key=repr) == want
    both = B.round_trip(docs, path, P.PATTERN)
    assert sorted([(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded_sha256) for r in both.collect()], key=repr) == want
    assert B.round_trip(none, path, P.PATTERN).count() == 0


def test_ngram_join(docs, none, rows):
    from veridelta.llm import ngram_join as J

    assert got(J.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(J.jaccard_brute(rows), key=repr)
    assert J.jaccard_components(none).count() == 0


def test_ngram_join_in_chunks(spark, monkeypatch):
    from veridelta.llm import ngram_join as J

    rnd = random.Random(1)
    base = [str(i) for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"w{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(J, "CHUNK_ROWS", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(J.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(J.jaccard_brute(rows), key=repr)


def test_decontamination(spark, docs, none, rows):
    from veridelta.llm import decontamination as D

    items = [(1, dict(rows)[11].split(" ", 25)[25].rsplit(" ", 1)[0]), (2, "one two three"), (3, None), (4, ""), (None, "café"), (10, "absent words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = D.contamination(docs, bench)
    found = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in df.collect()], key=repr)
    assert found == sorted(D.contamination_brute(rows, items), key=repr)
    several = D.phrase_matches(D.build_index(docs), bench, pass_bytes=15)
    assert got(several.selectExpr("doc_id", "starts", "ends", "items"), "doc_id", "starts", "ends", "items") == got(df, "doc_id", "starts", "ends", "items")
    near = D.proximity_matches(D.build_index(docs), spark.createDataFrame([(7, "three one")], "item_id long, text string"), slop=2)
    assert got(near, "doc_id", "item_id") == [(4, "7"), (5, "7")]
    assert D.contamination(none, bench).count() == 0 and D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_class_lm(docs, none, rows, monkeypatch):
    from collections import Counter

    from veridelta.llm import class_lm as L
    from veridelta.llm.common import hash_text_words, space_bytes

    monkeypatch.setattr(L, "SEEDS", 20)
    monkeypatch.setattr(L, "CLASSES", 6)
    monkeypatch.setattr(L, "BUCKET_ENTRIES", 300)
    assert L.sizes_for(0) == (24, 6) and L.sizes_for(10**8) == (400, 100)
    # of the two texts of doc_id 12 one, so that a coded text is known by its doc_id; an equal row twice instead
    docs = docs.where("doc_id IS NULL OR doc_id <> 12 OR text = lower(text)")
    docs = docs.union(docs.where("doc_id = 4"))
    rows = [r for r in rows if r[0] != 12 or r[1] == r[1].lower()] + [r for r in rows if r[0] == 4]
    words, _ = L.fit(docs)
    found = sorted(map(tuple, L.lm_scores(docs).collect()), key=repr)
    want = sorted(L.base_brute(rows), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want])
    assert L.lm_scores(none).count() == 0

    # the score, from the words' classes alone
    of, text_of = {}, {(i, len(hash_text_words(t, space_bytes()))): t for i, t in rows}
    for r in words.collect():
        c, at = L.Chunk.of(r.asDict()), 0
        for i, k in zip(c.doc_ids.tolist(), c.n_words.tolist(), strict=True):
            of.update(zip(hash_text_words(text_of[i, k], space_bytes()).tolist(), np.frombuffer(r.classes, "<u2")[c.codes[at : at + k]].tolist(), strict=True))
            at += k
    tokens = [(i, [*hash_text_words(t, space_bytes()).tolist(), None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    cls = lambda w: 0 if w is None else of[w]
    count, pair = Counter(), Counter()
    for i, ws in tokens:
        if not held(i):
            count.update(ws)
            pair.update(zip([0, *map(cls, ws)], map(cls, ws)))
    after, inside, types = Counter(), Counter(), Counter(cls(w) for w in count if w is not None)
    for (a, b), n in pair.items():
        after[a] += n
        inside[b] += n
    assert len(set(of.values())) > 3 and 0 not in of.values()
    n, v = sum(count.values()), len(count)

    def score(ws):
        out, a = 0.0, 0
        for w in ws:
            b = cls(w)
            p = (pair[a, b] + 0.1) / (after[a] + 0.1 * L.sizes_for(n)[1])
            if w is not None:
                p *= (count[w] + 0.5) / (inside[b] + 0.5 * (types[b] + 1))
            out += np.log10(0.9 * p + 0.1 * (count[w] + 0.5) / (n + 0.5 * (v + 1)))
            a = b
        return out

    brute = sorted([(i, len(ws), score(ws)) for i, ws in tokens])
    assert np.allclose(sorted([(r[0], r[2], r[6]) for r in found]), brute)
    assert all(np.isclose(r[7], 10 ** (-r[6] / r[2])) for r in found)

    # a word's class is the one under which its neighbours are likeliest
    rnd = np.random.default_rng(3)
    table = rnd.integers(1, 50, (6, 6)).astype(float)
    word, context, times = np.repeat(np.arange(40), 5), rnd.integers(0, 12, 200), rnd.integers(1, 9, 200)
    p = np.log((table + 0.1) / (table.sum(1, keepdims=True) + 0.6))
    for w, got_ in enumerate(L.likeliest(word, context, times, table)):
        value = lambda b: sum(t * (p[c, b] - np.log(table[:, b].sum() + 1) if c < 6 else p[b, c - 6]) for c, t in zip(context[word == w], times[word == w]))  # noqa: B023, E731
        assert got_ == max(range(1, 6), key=value)


def test_class_lm_beats_unigrams(spark):
    """On held-out texts of the test tables, by more than a tenth of a decimal digit per token."""
    from veridelta.llm import class_lm as L

    held = L.op6_class_lm(spark, "/root/testdata/sf0.001").where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens)").first()[0]
    assert held > 0.1


def test_exchange():
    from veridelta.llm import class_lm as L

    counts = np.zeros((5, 5))
    counts[1, 2] = counts[2, 1] = counts[3, 4] = counts[4, 3] = 50
    of = L.exchange(counts, 3)
    assert of[0] == 0


def test_passages(docs, none, rows):
    from veridelta.llm import passages as S

    one = [r for r in rows if r[0] != 12]
    df = S.repeated_passages(docs.where("doc_id IS NULL OR doc_id <> 12"))
    size = lambda a, b: sum(y - x for x, y in zip(a, b, strict=True))
    found = sorted([(r.doc_id, r.n_words, size(r.starts, r.ends), size(r.away_starts, r.away_ends)) for r in df.collect()], key=repr)
    assert found == sorted(S.passages_brute(one), key=repr)
    assert S.repeated_passages(none).count() == 0


def test_passage_stage(spark, docs):
    from veridelta.llm import passages as S

    kept = S.stage_repeated_passages(spark, docs, "")
    assert kept.columns == docs.columns
    texts_ = {r.doc_id: r.text for r in kept.collect()}
    assert 7 not in texts_ and 6 in texts_ and None in texts_ and 1 in texts_


def test_near_passages(spark):
    from veridelta.llm import passages as S

    fresh = iter(range(100_000))
    prose = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    edit = lambda words, *at: [prose(1)[0] if i in at else w for i, w in enumerate(words)]
    one, two, three = prose(60), prose(75), prose(64)
    rows = [
        (1, prose(8) + one + prose(7)), (2, prose(11) + edit(one, 30) + prose(3)), (3, two + prose(5)), (4, prose(6) + edit(two, 36)),
        (5, prose(9) + three), (6, three[:30] + prose(4) + three[30:] + prose(2)), (7, prose(70)), (8, edit(prose(60), 5) + one[:30]),
    ]
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = lambda a, b: sum(y - x for x, y in zip(a, b, strict=True))
    found = sorted((r.doc_id, r.n_words, size(r.starts, r.ends), size(r.away_starts, r.away_ends)) for r in S.near_repeated_passages(df).collect())
    assert found == S.near_brute(rows) and found[1] == (2, 74, 60, 60) and found[5][2:] == (68, 68)
    # a passage with an edit in every 40 words, in many texts: more than the leaders of a first round
    long = prose(200)
    many = [(i, " ".join(prose(5) + edit(long, *range(i % 40, 200, 40)) + prose(5))) for i in range(90)]
    found = {r.doc_id: size(r.away_starts, r.away_ends) for r in S.near_repeated_passages(spark.createDataFrame(many, "doc_id long, text string").repartition(3)).collect()}
    assert found[0] == 0 and min(found[i] for i in range(1, 90)) >= 190


def test_a_long_chain_of_near_passages(spark):
    from veridelta.llm import passages as S

    # each variant is similar to the ones just before it only
    core, drift, rows = [f"core{i}" for i in range(20)], [f"d{i}" for i in range(40)], []
    for i in range(320):
        drift[i % 40] = f"v{i}"
        rows.append((i, " ".join([f"x{i}a{k}" for k in range(10)] + drift[:20] + core + drift[20:] + [f"x{i}b{k}" for k in range(10)])))
    found = S.near_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in found if r.away_starts) == list(range(1, 320))


def test_meetings_of_places():
    import numpy as np

    from veridelta.llm import near_passages as N

    n, names = 40, ["a", "b", "c"]
    places = np.column_stack([np.arange(n), np.full(n, 100), np.full(n, 3 | 5 << 8 | 9 << 16)]).astype(np.int32)
    args = (np.arange(n) % 3, np.full(n, 7, np.uint64), np.arange(n).astype(np.uint64), np.arange(n))
    pairs = lambda table: {
        (r["chunk"], others[w], int(p[0]), int(p[3]))
        for r in table.to_pylist() if r["kind"] == 1
        for others in [r["other"].split("\n")]
        for w, p in zip(N.large([r["counts"]], "<i4"), N.large([r["starts"]], "<i4", 6), strict=True)
    }
    first = N.meet(0, names, *args, places, 32, 46)
    assert pairs(first) == {(names[i % 3], names[j % 3], i, j) for i in range(n) for j in range(min(i, 32))}
    assert first.num_rows == 6  # a row for each chunk that asks, and one for each that goes on
    # of the eight that go on all but the last are away: it meets them too
    places[32:39, 2] |= N.AWAY
    again = N.meet(0, names, *[x[32:] for x in args], places[32:], 256, 46)
    assert pairs(again) == {(names[39 % 3], names[j % 3], 39, j) for j in range(32, 39)}
    # once none is open, none goes on
    places[:, 2] |= N.AWAY
    assert N.meet(0, names, *args, places, 32, 46).num_rows == 0


def test_similarity_of_short_and_long_passages():
    import numpy as np

    from veridelta.llm import near_passages as N

    rng = np.random.default_rng(3)
    flat = rng.integers(0, 60, 30_000).astype(np.uint64)
    x, y, n, m = (rng.integers(a, b, 300) for a, b in ((0, 14_000), (15_000, 29_000), (2, 90), (2, 90)))
    n[:3], m[:3] = 14_000, 900
    flat[15_000:29_000][::3] = flat[:14_000][::3]
    want = []
    for i, j, v, w in zip(x, y, n, m, strict=True):
        a, b = flat[i : i + v], flat[j : j + w]
        p, q = set(a.tolist()), set(b.tolist())
        want.append(100 * len(p & q) >= 75 * len(p | q) and {int(a[0]), int(a[-1])} <= q and {int(b[0]), int(b[-1])} <= p)
    assert N.similar(flat, x, n, y, m).tolist() == want and any(want) and not all(want)


def test_stages_on_repeated_ids(spark):
    from veridelta.llm import ngram_join as J
    from veridelta.llm import passages as S

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = words("p", 60)
    rows = [(1, passage), (2, words("a", 20) + " " + passage), (2, words("a", 20) + " " + passage), (3, words("b", 15) + " " + passage), (3, words("c", 70)), (4, passage + " " + words("d", 9)), (4, "short"), (5, passage + " end"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # exact windows alone would leave the equal rows 49 words of the passage (their own windows that begin before it come
    # first there); as a passage of 60 words it is doc 1's
    left = words("a", 20)
    assert (2, 80, 80, 11) in S.passages_brute(rows) and (2, 80, 60, 60) in S.near_brute(rows[:2])
    want = [(1, passage), (2, left), (2, left), (3, words("b", 15)), (3, words("c", 70)), (4, words("d", 9)), (4, "short"), (5, "end"), (5, None)]
    assert got(S.stage_repeated_passages(spark, df, ""), "doc_id", "text") == sorted(want, key=repr)
    rows = [(1, words("a", 30)), (1, words("a", 30)), (2, words("a", 30)), (3, words("c", 30)), (3, words("b", 30)), (None, "x"), (None, "x"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, words("a", 30)), (3, words("b", 30)), (None, "x"), (None, "x"), (4, None)]
    assert got(J.stage_ngram_join(spark, df, ""), "doc_id", "text") == sorted(want, key=repr)


def test_trie_counts(docs, none, rows):
    from veridelta.llm import trie_counts as T

    path = P.path("byte_bpe_50k.tiktoken")
    few = [(i, t) for i, t in rows if len(t or "") < 2000]
    df = T.count_tokens(docs.where("length(text) < 2000 OR text IS NULL").where("doc_id IS NOT NULL"), path, P.PATTERN)
    assert got(df, "doc_id", "n_tokens") == sorted([(i, T.count_brute(t, path, P.PATTERN)) for i, t in few], key=repr)
    assert T.count_tokens(none, path, P.PATTERN).count() == 0


def test_licenses(spark):
    from veridelta.llm import licenses as L

    mit, gpl = L.TEMPLATES["MIT"][0], L.TEMPLATES["GPL-3.0"][0]
    rows = [
        (1, "https://a.org/lib/LICENSE", f"<p>Readme<br>{mit.upper()}</p>"), (2, "http://a.org/lib/src/x.html?q=1", "<p>code</p>"), (3, "a.org/other/y", "<!-- " + mit + " -->"), (4, "a.org/z", f"<script>{mit}</script><div>{gpl}</div>"),
        (5, None, mit), (6, "b.org/q", None), (6, "b.org/q", None), (7, "", ""), (8, "a.org/lib/w", "nothing under license"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, dir int, license string")
    found = got(L.license_scan(df), "page_id", "own_license", "license", "inherited_from")
    assert (1, "MIT", "MIT", None) in found and (2, None, "MIT", "a.org/lib") in found and (3, None, "GPL-3.0", "a.org") in found and (4, "GPL-3.0", "GPL-3.0", None) in found
    assert (5, "MIT", "MIT", None) in found and found.count((6, None, None, None)) == 2 and (8, None, "MIT", "a.org/lib") in found and len(found) == len(rows)
    assert L.license_scan(df.limit(0)).count() == 0


def test_license_headers_and_texts(spark, tmp_path):
    """Notices that wrap, file headers and license files of several paragraphs; names and years added, words left out."""
    import textwrap

    from oracle import connect, differences
    from veridelta.llm import licenses as L

    wrap = lambda t, n=60: chr(10).join(textwrap.wrap(t, n))
    full = {k: max(t, key=len) for k, t in L.TEMPLATES.items()}
    paragraphs = lambda t: "".join(f"<p>{wrap(x)}</p>" for x in t.split(". "))
    want = {}
    pages = []
    for n, (k, t) in enumerate(sorted(full.items())):
        for m, html in enumerate((wrap(t, 40), f"<html><body><h1>{k} license</h1><p>Copyright (c) 2020 A. Author</p>{paragraphs(t)}</body></html>", f"<pre>#!/bin/sh</pre><pre>{wrap(t.replace(' the ', ' ', 1), 70)}</pre><p>code follows here, and more of it than one would like to read</p>", t.upper())):
            pages.append((10 * n + m, f"h{n}{m}.org/x", html))
            want[10 * n + m] = k
    del want[10 * sorted(full).index("CC-BY-NC-4.0") + 1], want[10 * sorted(full).index("CC-BY-NC-4.0") + 2]  # a sentence of six words cut at "4.0"
    pages += [(900, "o.org/a", "the software is provided with merchantability " * 40), (901, "o.org/b", "x" * 100_000 + "\n\n \n\n"), (902, "o.org/c", "\n" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in L.license_scan(df).collect()}
    assert {p: found[p].own_license for p in want} == want and all(found[p].own_license is None for p in (900, 901, 902))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert differences(L.op9_licenses(spark, str(tmp_path)).toPandas(), con.execute(L.oracle_sql()).fetchdf()) == []


def test_licenses_without_any_one_word(spark):
    """Whatever word of a template is left out: a unit that still reaches COSINE is found, in one line, in a block and as a page of several paragraphs."""
    import math
    from collections import Counter

    from veridelta.llm import licenses as L

    def cosine(words, k):
        x = {w: (1 + math.log(n)) * L.IDF.get((L._KIND[k], w), L.OTHER[L._KIND[k]]) for w, n in Counter(words).items()}
        return sum(x.get(w, 0) * y for w, y in L._WEIGHT[k].items()) / (math.hypot(*x.values()) * L._NORM[k])

    pages, want = [], {}
    for (spdx, i), words in ((k, L._tokens(L.TEMPLATES[k[0]][k[1]])) for k in L._WEIGHT):
        anchors = {*L.ANCHORS, *L.TEXT_ANCHORS} & {*words}
        for left_out in [{w} for w in sorted({*words})] + [anchors] * bool(anchors):
            kept = [w for w in words if w not in left_out]
            if cosine(kept, (spdx, i)) < L.COSINE:
                continue
            half = len(kept) // 2
            forms = [" ".join(kept), " ".join(kept[:half]) + "\n" + " ".join(kept[half:])]
            if {*L.TEXT_ANCHORS} & {*words}:
                forms.append(" ".join(kept[:half]) + "\n\n" + " ".join(kept[half:]))
            for html in forms if anchors & left_out else forms[:1]:
                want[len(pages)] = spdx
                pages.append((len(pages), f"h{len(pages)}.org/x", html))
    n = len(pages)
    pages.append((n, "i.org/x", "<p>Released under the <b>M</b>I<i>T</i> L<b>icense</b>. R<b>e</b>leased under the <i>MI</i>T licens<b>e</b>.</p>".replace("Released", "Rel<b></b>eased")))
    want[n] = "MIT"
    found = {r.page_id: r.own_license for r in L.license_scan(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert n > 400 and {p: (found[p], want[p], pages[p][2]) for p in want if found[p] != want[p]} == {}


def test_licenses_sql(spark, sf_dir):
    from oracle import connect, differences
    from veridelta.llm import licenses as L

    assert differences(L.op9_licenses(spark, sf_dir).toPandas(), connect(sf_dir).execute(L.oracle_sql()).fetchdf()) == []


def test_toxicity(spark, sf_dir):
    from veridelta.llm import toxicity as X

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = X.fit(docs, labels)
    rows = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([(rows[r.doc_id].score >= 0.5) == bool(r.toxic) for r in labels.collect()]) > 0.9
    restore = X.CharModel(X.trigram_counts(["stupid", "moron", "the", "other", "thing"] * 50)).restore
    assert restore("stup1d") == "stupid" and restore("m0r0n") == "moron" and restore("s.t.u.p.i.d") == "stupid" and restore("stuuupid") == "stupid"
    empty = X.fit(docs, labels.limit(0))
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0)], "doc_id long, text string, score double")
    assert X.score(odd, empty, "toxic_score").count() == 2


def test_nearest(spark):
    from veridelta.llm import ann as A

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 16)).astype(np.float32)
    x[50:250] = x[50]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(600)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (None, [1.0] * 16, 1), (904, [None] + [1.0] * 15, 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, rank int")
    found = A.search(A.build_index(df), A.usable(df, "vec_id", "embedding").where("id % 20 = 0")).collect()
    want = A.nearest_brute(np.arange(600), x.astype(float), np.arange(0, 600, 20))
    hit = {(r.query_id, r.vec_id) for r in found}
    assert len(found) == len(want) and np.mean([(q, v) in hit for q, _, v, _ in want]) >= 0.9
    assert {(r.query_id, r["rank"]) for r in found} == {(q, k) for q, k, _, _ in want}
    assert A.build_index(df.limit(0)) is None


def test_nearest_in_a_dense_group(spark):
    from veridelta.llm import ann as A

    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 64)).astype(np.float32)
    x[:550] = x[0] * 3 + rnd.normal(size=(550, 64)).astype(np.float32) * 1e-3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3000)], "vec_id long, embedding array<float>")
    queries = A.usable(df, "vec_id", "embedding").where("id % 20 = 0 AND id < 550")
    found = {(r.query_id, r.vec_id) for r in A.search(A.build_index(df, sample=40), queries).collect()}
    want = A.nearest_brute(np.arange(3000), x.astype(float), np.arange(0, 550, 20))
    assert np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.97


def test_nearest_with_fewer_probes_than_lists(spark):
    """5,000 vectors in 71 lists, of which 54 are probed: recall, and every found row's rank, score and order."""
    from veridelta.llm import ann as A

    rnd = np.random.default_rng(8)
    x = (rnd.normal(size=(40, 32))[rnd.integers(0, 40, 5000)] + rnd.normal(size=(5000, 32)) * 0.6).astype(np.float32)
    x[4000:4300] = x[rnd.integers(0, 100, 300)]  # equal vectors: equal scores
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(5000)], "vec_id long, embedding array<float>")
    index = A.build_index(df)
    lists = len(index.quantiser.centroids)
    assert max(1, round(lists * A.PROBED) + 8) < lists
    found = A.search(index, A.usable(df, "vec_id", "embedding").where("id % 20 = 0")).collect()
    exact, by = x.astype(float), {}
    for r in found:
        assert r.score == pytest.approx(exact[r.query_id] @ exact[r.vec_id], rel=1e-12)
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for q, rows in by.items():
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows) and q not in {v for _, _, v in rows}
    want = A.nearest_brute(np.arange(5000), exact, np.arange(0, 5000, 20))
    hit = {(r.query_id, r.vec_id) for r in found}
    assert len(by) == 250 and np.mean([(q, v) in hit for q, _, v, _ in want]) >= 0.9


def test_pipeline(spark, sf_dir):
    import __spark_entry__
    import corpus_pipeline

    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns[:3] == ["doc_id", "n_tokens", "ids"] and 0 < df.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 13


def test_components(spark):
    from veridelta.llm.graph import components

    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(100)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()}
    assert found == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert json.dumps(found) is not None


def test_every_code_point_keeps_its_ids():
    from tokenizers import Tokenizer

    from veridelta.llm.token_files import TextEncoder

    path = P.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), TextEncoder(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    rows = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}x" for c in points]
    flat, counts = own.encode(rows)
    ends = np.cumsum(counts)
    assert [hex(c) for c, t, e, k in zip(points, rows, ends, counts, strict=True) if flat[e - k : e].tolist() != tok.encode(t, add_special_tokens=False).ids] == []
    assert own.encode(["\x00a b\x00"])[0].tolist() == [444, 320, 321, 444]


def test_long_pretokens():
    import tiktoken

    from veridelta.llm import byte_bpe as B

    path, rnd = P.path("byte_bpe_50k.tiktoken"), random.Random(8)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(path), special_tokens={})
    own = B.ByteBpe(path, P.PATTERN)
    for text in ["x" * 5000, "ab" * 20_000, "-" * 999 + "x", "".join(rnd.choice("etaoinshrdlu") for _ in range(3000)), "".join(chr(rnd.randrange(0x4E00, 0x5E00)) for _ in range(2000))]:
        flat, counts = own.encode([text, "", "plain words"])
        assert flat[: counts[0]].tolist() == want.encode_ordinary(text) and own.decode(flat, counts)[0] == text.encode()
    own.close()


def test_disguises():
    from veridelta.llm import toxicity as X

    model = X.CharModel(X.text_trigrams(" ".join(["you are a stupid idiot", "the moron is a liar and i am an idiot too"] * 50)))
    words = lambda t: {w for k in X.Restorer.tokens(t) for w in X.Restorer(model).words_of(k)}
    for text in ("you are a i d i o t ok", "i_d_i_o_t", "id.iot", "1d1ot", "i\td\ti\to\tt"):
        assert "idiot" in words(text), text
    assert {"you", "are", "stupid"} <= words("y o u a r e s t u p i d") and {"stupid", "idiot"} <= words("s t u p i d  i d i o t now") and "stupid" in words("stu-pid")
    assert words("a plain text, well-known") == {"a", "plain", "text", "well", "known", "wellknown"}


def test_stages_with_clashing_columns(spark, tmp_path):
    from veridelta.llm import decontamination as D
    from veridelta.llm import ngram_join as J
    from veridelta.llm import passages as S

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    spark.createDataFrame([("i1", words("b", 13))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words("b", 15)), (1, words("c", 70)), (2, words("c", 70)), (3, None), (None, words("b", 15)), (4, "")]
    names = ["bad_id", "bad_text", "gone_id", "several_id", "rank_of_row", "id_of_spans", "md5_of_spans", "spans_away"]
    df = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    left = D.stage_decontamination(spark, df, str(tmp_path))
    # of the two rows of doc 1 the one with another text stays
    assert left.columns == df.columns and got(left, "doc_id", "text") == sorted([r for r in rows if r != rows[0]], key=repr)
    for stage in (J.stage_ngram_join, S.stage_repeated_passages):
        kept = stage(spark, df, str(tmp_path))
        assert kept.columns == df.columns and kept.count() >= 4
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_memory_of_a_block_of_the_join(monkeypatch):
    """The rows of wide columns are counted so many entries at once; links are those of all pairs."""
    import tracemalloc

    from veridelta.llm import ngram_join as J

    monkeypatch.setattr(J, "ENTRIES_AT_ONCE", 50_000, raising=False)
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(8000, 5000, replace=False)).astype(np.uint64) for _ in range(120)]
    sets += [np.unique(np.r_[s[:4800], s[4800:] + np.uint64(9000)]) for s in sets[:3]]
    docs, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    tracemalloc.start()
    pairs = J.linked(docs, sizes, sets)
    peak = tracemalloc.get_traced_memory()[1] / sum(sizes)
    tracemalloc.stop()
    assert sorted(sorted(p) for p in pairs) == [[0, 120], [1, 121], [2, 122]]
    assert peak < 45  # bytes an entry
