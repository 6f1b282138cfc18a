"""Findings of reviews: layouts with long words, and steps whose cost must not grow faster than the rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import layout
from attestor.plans import catalog


@pytest.mark.parametrize("name", ["q9_build_lines_phrase", "q37_phrase_table"])
def test_a_phrase_ends_with_its_last_word(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT 1::BIGINT AS doc_id, 'x unquestionably-of the end' || chr(10) || 'of the' AS text) TO '{tmp_path}/documents.parquet'")
    con.sql(f"COPY (SELECT 1::BIGINT AS item_id, 'y-of the of the' AS text) TO '{tmp_path}/benchmark.parquet'")
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) >= 2


def test_a_box_is_still_around_all_words(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 0.0, 10.0, 50.0, 20.0, "Full"), (1, 0, 0, 1, 30.0, 10.0, 40.0, 20.0, "Name")], "page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    hit = layout.find_phrase(words, "full name").first()
    assert (hit["x0"], hit["x1"], hit["end_x1"]) == (0.0, 50.0, 40.0)


def test_the_text_of_a_line_is_not_made_anew_for_each_word(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 0.0, 10.0, 50.0, 20.0, "of the")], "page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    plan = layout.find_phrase(words, "of the")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("instr(") < 10


@pytest.mark.parametrize("few, common", [(1 << 16, 1 << 16), (3, 40), (3, 1 << 16)])
def test_pairs_of_a_common_label_are_no_one_task_s(spark, monkeypatch, few, common):
    monkeypatch.setattr(layout.templates, "FEW_REGIONS", few)
    monkeypatch.setattr(layout, "COMMON", common)
    labels = ["Yes", "Yes", "yes or no", "No", None, "a long label of many words", "Yes"]
    pairs = [(i % 9, i, labels[i * i % 7]) for i in range(200)]
    wanted = ["yes", "NO", "", "label of many", "label of few words", "long label of many words", None]
    rows, table = spark.createDataFrame(pairs, "page int, position int, label string"), spark.createDataFrame([(w,) for w in wanted], "wanted string")
    found = layout.bind_options(rows, table, "page")
    want = {}
    for page, at, label in pairs:
        for w in wanted:
            if label is not None and w is not None and w.lower() in label.lower():
                want.setdefault((page, w), (at, label))
    assert {(r["page"], r["wanted"]): (r["position"], r["label"]) for r in found.collect()} == want
    if common == 40:
        assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_short_wanted_text_is_its_own_gram(spark):
    labels, wanted = spark.createDataFrame([("0001000",), ("1000",)], "label string"), spark.createDataFrame([("0001",), ("1000",)], "wanted string")
    found = layout.labels_with(labels, wanted)
    assert sorted(map(tuple, found.collect())) == [("0001000", "0001"), ("0001000", "1000"), ("1000", "1000")]
    assert "count(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no posting lists are compared, nothing is searched twice


def test_pictures_taken_together_are_as_those_alone(spark, monkeypatch):
    from attestor.operators import raster

    rng = np.random.default_rng(4)
    pictures = [rng.integers(0, 256, shape).astype(np.uint8) for shape in [(4, 4), (7, 3), (4, 4), (5, 6, 3), (1, 1), (5, 6, 3), (4, 4), (0, 4)]] + [np.full((4, 4), 9, np.uint8)]
    calls = []
    monkeypatch.setattr(raster, "_features", lambda x, f=raster._features: calls.append(len(x)) or f(x))
    import pandas as pd

    found = raster.features.func(pd.DataFrame([raster.raster_of(x) for x in pictures] + [{"h": 9, "w": 9, "c": 1, "data": b"x"}]))
    assert sorted(calls) == [1, 1, 2, 4]
    for x, r in zip(pictures, found.to_dict("records"), strict=False):
        if x.size:
            assert np.isclose(r["ink_ratio"], raster.ink_ratio(x)) and np.isclose(r["ink_share"], raster.ink_share(x)) and np.isclose(r["variance"], raster.grey(x).var())
    assert found["ink_ratio"][7] == 0.0 and found["error"].notna().tolist() == [False] * 9 + [True]


def test_lines_of_a_picture_are_filtered_together(monkeypatch):
    from attestor.functions import images

    calls = []
    monkeypatch.setattr(images, "_filtered", lambda *a, f=images._filtered: calls.append(1) or f(*a))
    x = np.random.default_rng(5).integers(0, 256, (30, 20, 3)).astype(np.uint8)
    assert (images.from_png(images.to_png(x)) == x).all() and len(calls) == 1


def test_a_pair_that_comes_again_is_compared_once(monkeypatch):
    import pandas as pd

    from attestor.functions import match

    made = []
    monkeypatch.setattr(match.difflib, "SequenceMatcher", lambda *a, f=match.difflib.SequenceMatcher: made.append(1) or f(*a))
    found = match._similarity.func(pd.Series(["again one", "again one", None] * 5), pd.Series(["again two", "again two", "x"] * 5))
    assert len(made) == 1 and found["confidence"].tolist()[:2] == [77.8, 77.8] and found["ratio"].isna().sum() == 5


def test_single_edits_do_not_read_all_templates(spark):
    from attestor.sources import templates

    files = spark.createDataFrame([(f"x/t{i}.json", '{"rois": [{"roi_name": "name"}]}') for i in range(20)], "template_path string, json string")
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    mine, others = templates.apart(templates.rois(files.withColumn("json", count("json"))), "t1")
    edited = templates.edit(templates.rename(mine, "name", "new", "t1"), "new", "t1", notes="x")
    first = seen.value
    edited = templates.edit(templates.edit(edited, "new", "t1", language="y"), "new", "t1", page=2)
    assert first > 0 and seen.value == first
    assert edited.unionByName(others).count() == 20


def test_edit_args_are_parsed_once_and_read_as_before(spark):
    """q39: each field parsed an edit's args again, which took nearly all of its time."""
    import json

    from attestor.sources import edits, templates

    body = {"template_id": "t", "rois": [{"roi_name": "a", "page": None, "box": [1, 2, 3, 4], "notes": "x"}], "pages": [{"fields": [{"roi_name": "unused"}]}]}
    paged = {"template_id": "p", "pages": [{"page_number": 3, "fields": [{"roi_name": "b"}]}, {"page_number": 4}, {"fields": [{"roi_name": "c", "page": "7"}, {"roi_name": "d", "page": "x"}]}]}
    files = spark.createDataFrame([("x/t.json", json.dumps(body)), ("x/p.json", json.dumps(paged)), ("x/e.json", '{"template_id": "e", "rois": [], "pages": [{"fields": [{}]}]}')], "template_path string, json string")
    rows = templates.rois(files)
    assert sorted(tuple(r) for r in rows.select("template_id", "position.page", "position.pos", "roi_name", rows["page"].alias("own"), "notes").collect()) == [("p", 0, 0, "b", 3, None), ("p", 2, 0, "c", 7, None), ("p", 2, 1, "d", None, None), ("t", 0, 0, "a", None, "x")]
    told = [("t", 1, "set_field", "a", '{"notes": null, "page": 9, "unheard_of": 1}'), ("t", 2, "move", "a", '{"dx": "2", "dy": [1]}'), ("t", 3, "add", "n", None), ("t", 4, "add", "m", "{broken"), ("t", 5, "update_box", "m", '{"box": [1, "y"]}'), ("t", 6, "set_field", "n", "[1]"), ("t", 7, "add", "o", '{"field_type": null}')]
    log = spark.createDataFrame([(t, s, op, name, None, args) for t, s, op, name, args in told], "template_id string, seq long, op string, roi_name string, new_name string, args string")
    left, errors = edits.apply(rows.where("template_id = 't'"), log)
    assert [tuple(r) for r in left.orderBy("position").select("roi_name", "page", "box", "notes", "calibrated").collect()] == [("a", 9, [3.0, 2.0, 5.0, 4.0], None, True), ("n", 1, None, None, True), ("m", 1, [1.0, None], None, True)]
    assert [tuple(r) for r in errors.select("seq", "error").collect()] == [(7, "unknown field type null")]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 3


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_regions_of_all_templates_are_not_broadcast(spark, tmp_path):
    """q36, q26: a plan took them for as small as the files they come from, and the driver held them all."""
    from attestor.operators import export
    from attestor.sources import templates

    spark.createDataFrame([(f"x/t{i}.json", f'{{"rois": [{{"roi_name": "n{i}"}}], "bank": "b"}}') for i in range(20)], "template_path string, json string").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    rows = templates.rois(files)
    made, saved = export.config(rows, form_code="F"), templates.to_json(rows, files)
    assert "Broadcast" not in _plan(saved) and "SortMergeJoin" in _plan(saved)
    assert "Join" not in _plan(made) and _plan(made).count("Exchange") == 1
    names = lambda found, key: sorted(tuple(r) for r in found.select("template_id", F.get_json_object("value", "$.rois[0].roi_name"), F.get_json_object("value", f"$.{key}")).collect())
    assert names(made, "form_code") == sorted((f"t{i}", f"n{i}", "F") for i in range(20))
    assert names(saved, "bank") == sorted((f"t{i}", f"n{i}", "b") for i in range(20))


def test_a_configuration_of_files_that_share_an_id_comes_once(spark):
    import json

    from attestor.operators import export
    from attestor.sources import templates

    told = [("x/a.json", '{"template_id": "t", "display_name": "A", "rois": [{"roi_name": "a"}]}'), ("x/b.json", '{"template_id": "t", "display_name": "B", "rois": [{"roi_name": "b"}]}'), (None, '{"rois": [{"roi_name": "of none"}]}')]
    rows = templates.rois(spark.createDataFrame(told, "template_path string, json string"))
    found = [(r["template_id"], json.loads(r["value"])) for r in export.config(rows, form_code="F", sizes=[1, None], pages=[1]).collect()]
    assert sorted((t, c["display_name"], [x["roi_name"] for x in c["rois"]], c["form_code"], c["sizes"], "pages" in c) for t, c in found) == [("t", "A", ["a"], "F", [1, None], False), ("t", "B", ["b"], "F", [1, None], False)]
    unnamed = export.config(rows.withColumns({"display_name": F.lit(None).cast("string"), "document_type": F.lit(None).cast("string")})).first()
    assert (json.loads(unnamed["value"])["display_name"], json.loads(unnamed["value"])["document_type"]) == ("t", "kyc")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        export.config(rows, template_id="x").collect()
