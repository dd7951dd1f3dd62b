import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from wattline.llm import language, toxicity
from wattline.llm.decontamination import normalise
from wattline.llm.encoding import model_path
from wattline.llm.jaccard import shingle_set

from .conftest import DOCS, SMALL


def test_stages_against_plain_versions(spark):
    """Every stage on its own input: models as trained there, the other stages by brute force."""
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_copies", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        docs = docs.cache()
        rows = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        got = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == columns and all(rows[i] == r for i, r in got.items())
        if name == "language":
            assert set(got) == {i for i, r in rows.items() if language.has_letter(r.text)}
        elif name == "toxicity":
            scorer = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), language.id_remainder("doc_id", 5) != 0)
            scores = scorer.scores([toxicity.bucket_ids(rows[i].text) for i in rows])
            assert set(got) == {i for i, s in zip(rows, scores, strict=True) if s < 0.5}
        elif name == "near_copies":
            sets = {i: set(shingle_set(r.text, 5).tolist()) for i, r in rows.items()}
            root = {i: i for i in sets}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i in sets:
                for j in sets:
                    both = len(sets[i] & sets[j])
                    if j < i and both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            assert set(got) == {i for i in sets if find(i) == i} and len(got) < len(rows)
        elif name == "decontamination":
            items = [normalise(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(p in normalise(r.text) for r in got.values() for p in items if p) and len(got) < len(rows)
        else:
            assert set(got) == set(rows)
            for i, r in got.items():
                ids = [*library.encode(rows[i].text or ""), library.eos_id()]
                assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((rows[i].text or "").encode()).hexdigest()
        docs = out


def test_whole_run_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_odd_and_empty_documents(spark, odd_docs, odd_rows, no_docs, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = odd_docs.withColumn("lang_pred", F.lit("clash")).withColumn("component_id", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns[-2:] == ["lang_pred", "component_id"]
    left = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == {1, None, 5, 6, 8, 9}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Near copies and benchmark passages are decided on a row's own text where ids repeat or are null."""
    one, two, item = "the quick brown fox jumps over the lazy dog", "a second text that is like no other one here", "this passage is a part of the benchmark"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(3, one), (3, one), (None, one), (1, one), (1, two), (None, "another text without an id at all"), (None, item), (4, item), (4, "a clean text with the id of one that is not"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, 2**60 + 1) for i, t in rows], DOCS)
    copies = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()), key=str)
    assert copies == sorted([r for r in rows[3:] if r != (None, item)], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted([r for r in rows if r[1] != item], key=str)
    assert {r.n_chars for r in clean} == {2**60 + 1}


@pytest.mark.parametrize("name", ["op9_pigeonhole_decontamination", "pipeline"])
def test_registered(name):
    import __spark_entry__ as driver

    assert name in driver.queries() and name not in driver.oracle_sql()
