"""Byte-level BPE of very long pre-tokens, and toxicity: held-out labels, and tables without labels."""

import random
import time

import pytest

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    from veridelta.llm.byte_bpe import ByteBpe

    b = ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    yield b
    b.close()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    from veridelta.llm.byte_bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ACGT"])
def test_a_megabyte_of_random_letters(bpe, library, letters):
    rnd = random.Random(3)
    text = "".join(rnd.choice(letters) for _ in range(1_000_000))
    began = time.time()
    ids, counts = bpe.encode([text])
    assert time.time() - began < 60
    assert ids.tolist() == library.encode_ordinary(text) and counts.tolist() == [len(ids)]


def test_long_words_of_all_kinds(bpe, library):
    rnd = random.Random(4)
    kinds = ["ab", "abc", "ACGT", "etaoin", "aA", "aé", "the", "ing", "日本語中文", "0123456789", "ha", "=-", "_ab", "a", "abcdefghijklmnopqrstuvwxyz"]
    texts = ["".join(rnd.choice(rnd.choice(kinds) if mixed else kind) for _ in range(n)) for kind in kinds for n in (49, 60, 100, 300, 900) for mixed in (False, True)]
    texts += ["a" * 40_000, "ab" * 20_000, "abc" * 5_000 + "x"]
    flat, counts = bpe.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == library.encode_ordinary(text), text[:60]
        at += n


def test_toxicity_on_held_out_labels(spark):
    """At least 4 of 5 toxic documents are found and at most 2 % of the clean ones flagged, among labels not learnt from."""
    from veridelta.llm import toxicity as X

    sf = "/root/testdata/sf0.1"
    found = X.op10_toxicity(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n.get((1, 1), 0) >= 0.8 * (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 1), 0) + n.get((0, 0), 0))


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1), (2, 0, 1), (3, 1, 1)], [(None, 0, 1), (1, 0, None)]])
def test_nothing_is_rejected_where_nothing_can_be_learnt(spark, tmp_path, labels):
    from veridelta.llm import toxicity as X

    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 0.5), (3, "", 1.0), (None, "y o u  i d i o t " * 20_000, None)], "doc_id long, text string, toxic_score double")
    docs.drop("toxic_score").write.parquet(str(tmp_path / "documents.parquet"))
    kept = X.stage_toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 4
    scores = X.op10_toxicity(spark, str(tmp_path)).collect()
    assert {(r.predicted, round(r.score, 6)) for r in scores} == {(0, X.PRIOR)} and all(r.held_out for r in scores if r.doc_id is None)
    assert X.stage_toxicity(spark, docs.limit(0), str(tmp_path)).count() == 0
