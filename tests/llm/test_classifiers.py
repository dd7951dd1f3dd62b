"""Language and toxicity: held-out accuracy, odd rows, what is never read."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import language, toxicity
from wattline.llm.catalog import QUERIES

from .conftest import DOCS, SMALL

WORDS = {
    "en": "the of and to house water green tree light stone river small".split(),
    "de": "der die und zu haus wasser grün baum licht stein fluss klein".split(),
    "fr": "le les et des maison eau vert arbre lumière pierre rivière petit".split(),
    "es": "el los y que casa agua verde árbol luz piedra río pequeño".split(),
}


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(sorted(WORDS))
        text = [rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["scumbag", "idioten", "idiotisch", "grobrix"])
        rows.append((k, " ".join(text), lang, "s", 0))
        labels.append((k, 1, toxic))
    return rows, labels


def held(i, modulus, remainder):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_language_by_family(spark, tables, odd_docs, odd_rows, no_docs):
    docs, _, rows, _ = tables
    model = language.train(docs, language.id_remainder("doc_id", 3) != 1)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.planes) == {("de", "en"), ("es", "fr")}
    got = {r.doc_id: r for r in language.identify(docs.drop("lang"), model).collect()}
    unseen = [r for r in rows if held(r[0], 3, 1)]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in unseen]) > 0.97
    assert all(0.5 <= r.lang_score <= 1 for r in got.values())
    odd = language.identify(odd_docs.withColumn("lang_score", F.lit("x")), model).collect()
    assert len(odd) == len(odd_rows)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {3, 4, 7} and all(r.lang_score == 0 for r in odd if r.lang_pred == "und")
    assert language.identify(no_docs, model).count() == 0
    assert language.train(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(odd_docs, None).collect()} == {"und"}


def test_one_language_only(spark):
    docs = spark.createDataFrame([(1, "nur ein text", "de", None, 0)], DOCS)
    model = language.train(docs, F.lit(True))
    assert [r.lang_pred for r in language.identify(docs, model).collect()] == ["de"]


def test_toxicity_on_unseen_documents(spark, tables, odd_docs, odd_rows, no_docs):
    docs, labels, rows, marks = tables
    twice = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    scorer = toxicity.train(docs, twice, language.id_remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), scorer).collect()}
    unseen = [(i, t) for i, _, t in marks if held(i, 5, 0)]
    assert np.mean([got[i].toxic_pred == t for i, t in unseen]) > 0.95
    assert all(0 <= r.toxicity <= 1 and r.toxic_pred == (r.toxicity >= 0.5) for r in got.values())
    odd = toxicity.score_toxicity(odd_docs.withColumn("toxic_pred", F.lit("x")), scorer).collect()
    assert len(odd) == len(odd_rows) and {r.toxicity for r in odd if r.text is None} == {r.toxicity for r in odd if r.text == ""}
    assert toxicity.score_toxicity(no_docs, scorer).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r.toxicity for r in toxicity.score_toxicity(odd_docs, None).collect()} == {0.0}


def test_blocks_of_a_long_text_score_like_one(tables):
    rng = np.random.default_rng(0)
    net = toxicity.Network.new(3)
    scorer = toxicity.Scorer(net)
    texts = [rng.integers(1, toxicity.BUCKETS, (n, toxicity.PARTS)).astype(np.int32) for n in (0, 1, 2, 700, 3)]
    whole, lang = scorer.logits(texts)
    cut, lang_cut = scorer.logits(texts, block=64)
    assert np.allclose(whole, cut, atol=1e-4) and (lang == lang_cut).all()
    ids, starts = toxicity.joined(texts)
    pooled = net.pooled(ids, starts)[0] @ net.out + net.out_bias
    assert np.allclose(whole, pooled, atol=1e-3)


@pytest.mark.parametrize(("name", "modulus", "remainder"), [("op4_family_svm", 3, 1), ("op6_cnn_toxicity", 5, 0)])
def test_queries(spark, name, modulus, remainder):
    rows = QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == held(r.doc_id, modulus, remainder) and 0 <= r.score <= 1 for r in rows)
    if name.startswith("op4"):
        langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
        assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_toxicity_learns_from_all_rows(spark, tables, monkeypatch):
    """A start of a few rows, or of none since all texts are long, still gives a model of all rows, and all held rows set the cuts."""
    docs, labels, _, marks = tables
    for words in (5000, 1):
        monkeypatch.setattr(toxicity, "START_WORDS", words, raising=False)
        seen, calibrate = [], toxicity.Scorer.calibrate
        monkeypatch.setattr(toxicity.Scorer, "calibrate", lambda self, counted, seen=seen: (seen.append(int(counted["n"].sum())), calibrate(self, counted))[1])
        many = docs.unionByName(docs).unionByName(docs).unionByName(docs)
        scorer = toxicity.train(many, labels, language.id_remainder("doc_id", 5) != 0, per_class=8)
        monkeypatch.undo()
        got = {r.doc_id: r.toxic_pred for r in toxicity.score_toxicity(docs, scorer).collect()}
        assert np.mean([got[i] == t for i, t in ((i, t) for i, _, t in marks if held(i, 5, 0))]) > 0.95
        kept = spark.createDataFrame(labels.where(language.id_remainder("doc_id", 5) != 0).collect(), labels.schema)
        assert seen == [4 * kept.where(language.share_by_hash("doc_id", F.lit(0.2), 66)).count()]


def test_long_texts_train_toxicity(spark):
    rows = [(k, " ".join(["house"] * 50_010 + ["scumbag"] * (k % 2)), None, None, 0) for k in range(24)]
    scorer = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1, k % 2) for k in range(24)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert scorer is not None


def test_maxima_by_blocks():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(2)
    ids, starts = toxicity.joined([rng.integers(1, toxicity.BUCKETS, (n, toxicity.PARTS)).astype(np.int32) for n in (0, 5, 300, 1)])
    whole, cut = net.pooled(ids, starts), net.pooled(ids, starts, block=37)
    assert np.allclose(whole[0], cut[0], atol=1e-6) and all((a == b).all() for a, b in zip(whole[1], cut[1], strict=True))
