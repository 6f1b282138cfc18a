"""The stages of the pipeline on a small table, decision by decision."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import jaccard, mixing, queries, toxicity
from attestor.llm.session import read, stored

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_stages(spark):
    docs = read(spark, DATA, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(spark, stage(spark, docs, DATA))
        kept[name] = (before, docs)
        if name != "sentencepiece":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    before, after = kept["toxicity"]
    rejected = toxicity.score(before, toxicity.learn(before, read(spark, DATA, "labels"))).where(F.col("score") >= toxicity.THRESHOLD)
    assert {r[0] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()} == {r["doc_id"] for r in rejected.collect()}
    before, after = kept["near_duplicates"]
    groups = jaccard.linked(before).select("component_id").distinct().count()
    assert after.count() == groups and jaccard.linked(after).where("doc_id <> component_id").count() == 0
    before, after = kept["personal_data"]
    assert before.count() == after.count() and after.where(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.]")).count() == 0
    before, after = kept["mixing"]
    assert after.count() == mixing.take(before).agg(F.sum("copies")).first()[0]
    before, after = kept["sentencepiece"]
    assert after.count() == before.count()


ODD = [None, "", " \n", "a", "one two three four five six", "one two three four five six", "mail a@b.co now please do it", "é 한 😀", "w" * 3000, "long text of words " * 400]


@pytest.mark.parametrize("rows", [len(ODD), 0])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, ties, repeated rows and ids, long and empty texts, clashing columns, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, component_id long, score double, _row int, _doc int"
    data = [(i if i != 3 else None, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 3}", None if i % 4 == 0 else len(t or ""), *range(6)) for i, t in enumerate(ODD)]
    data = [(*r[:8], float(r[8]), *r[9:]) for r in data + data[4:7]][: rows and len(data) + 3]
    docs = stored(spark, spark.createDataFrame(data, schema))
    labels = [(i, None if i == 2 else 0, i % 2 if i != 4 else None) for i in range(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs.count(), stored(spark, stage(spark, docs, str(tmp_path)))
        if name != "sentencepiece":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS and after.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes
        sizes[name], docs = (before, after.count()), after
    if not rows:
        assert set(sizes.values()) == {(0, 0)}
        return
    assert sizes["near_duplicates"][1] <= sizes["near_duplicates"][0] and sizes["personal_data"][0] == sizes["personal_data"][1]
    assert sizes["sentencepiece"][0] == sizes["sentencepiece"][1]
    ids = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, stored(spark, spark.createDataFrame(data, schema)), str(tmp_path)).collect()]
    assert 5 not in ids and ids.count(4) == 2 and None in ids and {0, 1, 2} <= set(ids)  # of texts 4 and 5 the former stays, with its repeated row


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
