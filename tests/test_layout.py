"""Geometry, marks, rasters, templates, layout and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import geometry, text
from attestor.operators import extraction, layout, marks, raster
from attestor.plans import catalog
from attestor.sources import backends, edits, pages, templates
from attestor.streaming import validation


def circle(mark: str) -> np.ndarray:
    x = np.full((30, 30), 255, np.uint8)
    r, c = np.ogrid[:30, :30]
    far = np.hypot(r - 15, c - 15)
    x[np.abs(far - 12) <= 1] = 0
    if mark == "fill":
        x[far <= 10] = 0
    elif mark == "x":
        x[(np.abs(r - c) <= 1) & (far < 12)] = 0
        x[(np.abs(r + c - 30) <= 1) & (far < 12)] = 0
    elif mark == "speck":
        x[far <= 1] = 0
    return x


def test_marks(spark):
    rows = [(g, i, o, raster.ink_ratio(circle(m))) for g, options in {"a": ("x", "none"), "b": ("x", "fill"), "c": ("speck", "none")}.items() for i, (o, m) in enumerate(zip(("yes", "no"), options, strict=True))]
    found = marks.detect(spark.createDataFrame(rows, "g string, position int, option string, ink_ratio double"), "g")
    by = {(r["g"], r["option"]): r for r in found.collect()}
    assert by["a", "yes"]["checked"] is True and by["a", "no"]["checked"] is False
    assert by["b", "no"]["checked"] is True and by["b", "yes"]["status"] == "REVIEW_REQUIRED" and by["b", "yes"]["checked"] is None
    assert by["c", "yes"]["checked"] is not True
    assert {r["g"]: r["value"] for r in marks.chosen(found, "g").collect()}["a"] == "yes"
    assert raster.ink_ratio(np.zeros((0, 0), np.uint8)) == 0.0


def test_features_isolate_errors(spark):
    good = raster.raster_of(circle("fill"))
    rows = spark.createDataFrame([(good,), ({**good, "h": 99},)], f"r {raster.RASTER}").select(raster.features("r").alias("f")).select("f.*").collect()
    assert rows[0]["error"] is None and rows[0]["ink_ratio"] > 0.9 and rows[1]["error"] is not None


def test_boxes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    box = F.array(*map(F.lit, (-5.0, 2.5, 3.5, 2.5)))
    assert get(geometry.clamp_box(box, F.lit(10.0), F.lit(10.0))) == [0.0, 2.5, 3.5, 3.5]
    assert get(geometry.crop_bounds(box, F.lit(10), F.lit(10))) == [0, 2, 4, 2]
    assert get(geometry.scale_box(box, F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)))[0] is None
    assert get(geometry.detect_photo(F.lit(300.0)))["status"] == "PRESENT" and get(geometry.detect_ink(F.lit(0.01)))["confidence"] == 40.0


def test_phrase_and_labels(spark):
    words = spark.createDataFrame([(1, 0, 0, i, x, 10.0, x + 20, 20.0, t) for i, (x, t) in enumerate([(0.0, "Full"), (30.0, "Name"), (200.0, "Male")])], "page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    hit = layout.find_phrase(words, "full nam").first()
    assert (hit["x0"], hit["x1"], hit["occurrence"]) == (0.0, 50.0, 0)
    circles = spark.createDataFrame([(1, 7, 180.0, 10.0, 192.0, 22.0), (1, 8, 400.0, 10.0, 412.0, 22.0)], "page int, circle_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r["circle_id"]: r["label"] for r in layout.pair_labels(circles, words).collect()} == {7: "Male", 8: None}


def test_rounding_is_that_of_the_language(spark):
    rng = np.random.default_rng(1)
    xs = [0.05, 0.15, 0.25, 0.35, -0.25, 2.5, 451 / 2000 * 100, 1e15 + 0.5] + [k / 20 for k in range(-400, 400)] + rng.uniform(-1e4, 1e4, 500).round(2).tolist()
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", geometry.round_half_even(F.col("x")).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 1) for r in got)
    assert spark.range(1).select(geometry.round_half_even(F.lit(None))).first()[0] is None


def test_phrases_are_those_of_one_at_a_time(spark):
    rng = np.random.default_rng(2)
    bits = ["Full", "name", "of", "the", "Bank", "a", "İzmir", "ab"]
    words = [(d, 1, b, n, k, 10.0 * k, 12.0 * n, 10.0 * k + len(t), 12.0 * n + 9, t) for d in range(3) for b in range(2) for n in range(4) for k, t in enumerate(rng.choice(bits, 6).tolist())]
    words = spark.createDataFrame(words, "d int, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    names = ["of the", "OF THE", "l n", "name", "a", "bank", "nowhere", "the bank of"]
    want = sorted(tuple(r) for n in names for r in layout.find_phrase(words, n, "d").collect())
    table = spark.createDataFrame([(n,) for n in [*names, "name", "", None]], "phrase string")
    assert sorted(tuple(r) for r in layout.find_phrases(words, table, "d").collect()) == want and len(want) > 50
    assert sorted(tuple(r) for r in layout.phrases_in(layout.lines(words, "d"), table, "d", most=3).collect()) == want
    assert layout.find_phrases(words, table.limit(0), "d").count() == 0 and layout.find_phrases(words.limit(0), table, "d").count() == 0


def test_labels_by_their_grams(spark):
    rng = np.random.default_rng(3)
    labels = ["".join(rng.choice(list("abAB é"), rng.integers(0, 9)).tolist()) for _ in range(300)] + [None, "", "Yes", "Yes", "yes please"]
    wanted = ["", "a", "B", "ab", "aba", "ABAB", "é ", "yes", "zz", "no such thing", None]
    rows = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(labels)], "page int, position int, label string")
    table = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    got = {(r["label"], r["wanted"]) for r in layout.labels_with(rows, table).collect()}
    assert got == {(t, w) for t in labels for w in wanted if t is not None and w is not None and w.lower() in t.lower()}
    first = {(r["page"], r["wanted"]): r["position"] for r in layout.bind_options(rows, table, "page").collect()}
    want = {}
    for i, t in enumerate(labels):
        for w in wanted:
            if t is not None and w is not None and w.lower() in t.lower():
                want.setdefault((i % 7, w), i)
    assert first == want
    plan = layout.bind_options(rows, table, "page")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_edit_log(spark):
    rows = templates.rois(spark.createDataFrame([("dir/form.json", catalog.TEMPLATE)], "template_path string, json string"))
    log = [("t1", 1, "rename", "dob", "birth", None), ("t1", 2, "move", "birth", None, '{"dx": 1, "dy": 2}'), ("t1", 3, "update_box", "birth", None, '{"box": [1, 2, 3, 4]}'), ("t1", 4, "move", "birth", None, '{"dx": 1, "dy": 2}'), ("t1", 5, "duplicate", "birth", None, None)]
    log += [("t1", 6, "duplicate", "birth", None, "not json"), ("t1", 7, "add", "birth", None, '{"field_type": "X"}'), ("t1", 8, "add", "birth", None, '{"field_type": "NAME", "page": 3}'), ("t1", 9, "set_field", "sex", None, '{"notes": "n", "required": true, "zzz": 1, "language": null}')]
    log += [("t1", 10, "delete", "full_name", None, None), ("t1", 11, "oops", "x", None, None), ("t9", 1, "add", "q", None, "{}"), (None, 1, "add", "q", None, "{}"), ("t1", 12, "rename", "sex", "birth", None), ("t1", 13, "resize", "birth", None, '{"width": 7, "height": 8}'), ("t1", 14, "delete", "nobody", None, None), ("t1", 15, "rename", "sex", "sex", None)]
    edited = spark.createDataFrame(log, "template_id string, seq long, op string, roi_name string, new_name string, args string").repartition(5)
    left, errors = edits.apply(rows, edited)
    found = left.orderBy("template_id", "position").collect()
    names = [r["roi_name"] for r in found if r["template_id"] == "t1"]
    assert names[:4] == ["birth", "sex", "unnamed", "birth_copy"] and names[4].startswith("birth_copy_") and names[5].startswith("birth_") and len(names) == len(set(names)) == 6
    assert found[0]["box"] == [2.0, 4.0, 9.0, 12.0] and found[0]["calibrated"] and found[3]["box"] == [2.0, 4.0, 4.0, 6.0]
    assert (found[1]["notes"], found[1]["required"], found[1]["language"]) == ("n", True, None) and (found[5]["field_type"], found[5]["page"], found[5]["language"]) == ("NAME", 3, "english")
    assert [(r["roi_name"], r["page"], r["template_path"]) for r in found if r["template_id"] == "t9"] == [("q", 1, None)]
    assert {(r["template_id"], r["seq"], r["error"].split(" ")[0]) for r in errors.collect()} == {("t1", 7, "unknown"), ("t1", 11, "unknown"), ("t1", 12, "a"), (None, 1, "an")}
    same, none = edits.apply(rows, edited.limit(0))
    assert [r["roi_name"] for r in same.orderBy("position").collect()] == [r["roi_name"] for r in rows.orderBy("position").collect()] and none.count() == 0
    new = spark.createDataFrame([("t1", "dob", "DATE"), ("t1", "fresh", "TEXT"), ("t1", "fresh", "TEXT")], "template_id string, roi_name string, field_type string")
    added = [r["roi_name"] for r in templates.add(rows, new).collect()]
    assert len(added) == len(set(added)) == 7 and added.count("fresh") == 1


def test_templates_are_loaded_once(spark, tmp_path, monkeypatch):
    calls = []
    read = templates.read_files
    monkeypatch.setattr(templates, "read_files", lambda *a: calls.append(a) or read(*a))
    (tmp_path / "form.json").write_text(catalog.TEMPLATE)
    first = templates.load(spark, str(tmp_path))
    assert first.count() == 4 and templates.load(spark, str(tmp_path)) is first and len(calls) == 1
    (tmp_path / "form.json").write_text(catalog.TEMPLATE.replace('"full_name"', '"whole_name"'))
    assert "whole_name" in {r["roi_name"] for r in templates.load(spark, str(tmp_path)).collect()} and len(calls) == 2
    (tmp_path / "second.json").write_text(catalog.TEMPLATE.replace('"t1"', '"t2"'))
    assert templates.load(spark, str(tmp_path)).count() == 8 and len(calls) == 3
    monkeypatch.setattr(templates, "KEPT_FILES", 1)
    assert templates.load(spark, str(tmp_path)).count() == 8 and templates.load(spark, str(tmp_path)).count() == 8 and len(calls) == 5


def test_regions_of_each_page_s_template(spark, monkeypatch):
    """Pages and values that name their template meet its regions alone, however many regions there are."""
    rois = spark.createDataFrame([("a", "n", 1, [0.0, 0.0, 2.0, 2.0], 0), ("a", "m", 2, [0.0, 0.0, 1.0, 1.0], 1), ("b", "n", 1, [1.0, 0.0, 2.0, 2.0], 0)], "template_id string, roi_name string, page int, box array<double>, position int")
    rows = [(f"d{i}", "ab"[i % 2], 1, raster.raster_of(np.arange(4, dtype=np.uint8).reshape(2, 2)), 2.0, 2.0) for i in range(40)]
    found = spark.createDataFrame(rows, f"document string, template_id string, page int, raster {raster.RASTER}, native_w double, native_h double")
    for few in (templates.FEW_REGIONS, 0):
        monkeypatch.setattr(templates, "FEW_REGIONS", few)
        assert sorted((r["document"], r["roi_name"], r["crop"]["w"]) for r in raster.crops(found, rois).collect()) == sorted((f"d{i}", "n", 2 - i % 2) for i in range(40))
        assert raster.crops(found.drop("template_id"), rois).count() == 80
    assert extraction.values(spark.createDataFrame([("d", "n", "text", "x", None, None), ("d", "s", "ink", None, 0.5, None), ("d", "p", "photo", None, None, 10.0)], "document string, roi_name string, branch string, text string, ink_share double, variance double"), spark.createDataFrame([("d", "c", "yes", 0, 0.5), ("d", "c", "no", 1, 0.0)], "document string, roi_name string, option string, position int, ink_ratio double")).orderBy("roi_name").select("value").collect() == [("yes",), ("x",), ("NOT_DETECTED",), ("PRESENT",)]


def test_templates(spark, tmp_path):
    folder = tmp_path / "bank"
    folder.mkdir()
    (folder / "form.json").write_text(catalog.TEMPLATE)
    (folder / "version.json").write_text("{}")
    assert [r["bank"] for r in templates.catalog(spark, str(tmp_path)).collect()] == ["bank"]
    files = templates.read_files(spark, str(tmp_path)).where("NOT template_path LIKE '%version.json'")
    rows = templates.rois(files)
    assert templates.page_counts(files).first()["page_count"] == 7
    by = {r["roi_name"]: r for r in rows.collect()}
    assert by["dob"]["language"] is None and by["full_name"]["language"] == "english" and by["unnamed"]["page"] == 7
    moved = templates.update_box(rows, "dob", [1.0, 2.0, 3.0, 4.0]).where("roi_name = 'dob'").first()
    assert moved["calibrated"] and moved["box"] == [1.0, 2.0, 3.0, 4.0]
    assert templates.delete(templates.duplicate(rows, "dob"), "dob").where("roi_name = 'dob_copy'").count() == 1
    with pytest.raises(ValueError):
        templates.rename(rows, "dob", "sex")
    assert templates.rename(rows, "dob", "dob").count() == 4 and templates.delete(rows, "nothing").count() == 4
    for missing in (lambda: templates.edit(rows, "nothing", notes="x"), lambda: templates.rename(rows, "nothing", "y"), lambda: templates.duplicate(rows, "dob", template_id="t9"), lambda: templates.move(rows, "nothing", 1.0, 1.0)):
        with pytest.raises(KeyError):
            missing()
    both = rows.unionByName(rows.withColumn("template_id", F.lit("t2")))
    for several in (lambda: templates.edit(both, "dob", notes="x"), lambda: templates.delete(both, "dob")):
        with pytest.raises(ValueError):
            several()
    assert templates.delete(both, "dob", "t2").count() == 7
    assert templates.edit(both, "dob", "t2", notes="x").where("notes = 'x' AND roi_name = 'dob'").count() == 1
    twice = templates.duplicate(templates.duplicate(rows, "dob"), "dob")
    assert len({r["roi_name"] for r in twice.collect()}) == 6
    assert templates.catalog(spark, str(tmp_path / "nowhere")).count() == 0
    saved = json.loads(templates.to_json(rows).first()["value"])
    assert [r["roi_name"] for r in saved["rois"]] == ["full_name", "dob", "sex", "unnamed"]


def test_files_with_backends(spark, tmp_path, monkeypatch):
    def pdf(content: bytes, dpi: int):
        for k in range(int(content)):
            if k == 7:
                raise AssertionError("a page that nobody asked for")
            yield 4, 4, 1, bytes(range(k, k + 16)), 4.0, 4.0

    (tmp_path / "doc").mkdir()
    for name, content in (("a.pdf", b"3"), ("b.pdf", b"1"), ("c.pdf", b"broken")):
        (tmp_path / "doc" / name).write_bytes(content)
    monkeypatch.setattr(backends, "PROVIDERS", {"pdf": pdf, "words": lambda content: [(1, 0.04, 1.06, 2.0, 3.0, "word", 0, 1, k) for k in range(int(content))], "ocr": lambda image, language, mode: [(f"{mode} {image.shape}", 55.0), (" ", 1.0)] if language == "eng" else 1 / 0})
    rows = pages.files(spark, str(tmp_path))
    counts = {r["path"][-5:]: (r["page_count"], r["error"] is None) for r in pages.page_counts(rows).collect()}
    assert counts == {"a.pdf": (3, True), "b.pdf": (1, True), "c.pdf": (None, False)}
    found = pages.ingest(rows)
    assert [(r["page"], r["label"]) for r in pages.numbered(found).orderBy("page").collect()] == [(1, "Front"), (2, "Back"), (3, "Page 3"), (4, "Page 4")]
    second = {r["path"][-5:]: (r["page_in_file"], r["error"]) for r in pages.single_page(rows, 2).collect()}
    assert second["a.pdf"] == (2, None) and second["b.pdf"][1] == "Page 2 not found (document has 1 pages)." and second["c.pdf"][1]
    many = rows.withColumn("content", F.lit(b"9"))
    assert {r["page_in_file"] for r in pages.single_page(many, 5).collect()} == {5}
    words = pages.words(rows)
    assert words.where("x0 = 0.0 AND y0 = 1.1").count() == 4 and words.where("error IS NOT NULL").count() == 1
    regions = spark.createDataFrame([("n", 1, "NUMBER", "english", [0.0, 0.0, 4.0, 4.0], 60.0), ("t", 1, "NUMBER", "mixed", [0.0, 0.0, 4.0, 4.0], 60.0), ("s", 1, "TEXT", "english", [1.0, 1.0, 2.0, 4.0], 60.0), ("x", 1, "TEXT", "english", None, 60.0)], "roi_name string, page int, field_type string, language string, box array<double>, confidence_threshold double")
    read = {r["roi_name"]: r for r in extraction.text_fields(pages.numbered(found), regions).collect()}
    assert read["n"]["raw_value"] == "7 (12, 12)" and read["n"]["confidence"] == 55.0 and read["n"]["below_threshold"] and read["n"]["error"] is None
    assert read["t"]["error"].startswith("OCR failed") and read["s"]["error"] == extraction.NO_CROP and read["x"]["error"] == extraction.NO_BOX
    assert all(read[k]["below_threshold"] for k in "sx") and not read["t"]["below_threshold"]  # an engine's own error leaves no confidence
    monkeypatch.setattr(backends, "PROVIDERS", {"pdf": pdf})
    assert "no ocr backend" in {r["roi_name"]: r["error"] for r in extraction.text_fields(pages.numbered(found), regions).collect()}["n"]


def test_engine_is_probed_once_a_process(spark, tmp_path, monkeypatch):
    """Packs are resolved before the call; the probe leaves a mark in a file each time."""
    mark = str(tmp_path / "probes")

    def probe():
        import os

        with open(mark, "a") as file:
            file.write(f"{os.getpid()}\n")
        return ["eng", "osd"]

    monkeypatch.setattr(backends, "PROVIDERS", {"ocr": lambda image, language, mode: [(f"{language} {mode}", 90.0)], "ocr_languages": probe})
    images = spark.createDataFrame([(i, raster.raster_of(circle("x")), ("english", "nepali", "mixed", None)[i % 4], ("TEXT", "ADDRESS", "odd")[i % 3]) for i in range(240)], f"i int, r {raster.RASTER}, language string, kind string").repartition(12)
    for _ in range(2):
        found = {r["i"]: r["o"]["words"][0]["text"] for r in images.select("i", extraction.recognized(F.col("r"), F.col("language"), F.col("kind")).alias("o")).collect()}
        assert found == {i: f"eng {(7, 6, 6)[i % 3]}" for i in range(240)}
    pids = open(mark).read().split()
    assert len(pids) == len(set(pids)) and len(pids) < 24  # 24 tasks, 240 images, twice

    def missing():
        raise OSError("not installed")

    monkeypatch.setattr(backends, "PROVIDERS", {"ocr": lambda *_: [], "ocr_languages": missing})
    errors = images.select(extraction.recognized(F.col("r"), F.col("language"), F.col("kind"))["error"].alias("e")).distinct().collect()
    assert [r["e"] for r in errors] == ["no ocr backend is available: not installed"]
    assert text.language_code("mixed", frozenset(["eng", "nep"])) == "eng+nep" and text.language_code("mixed") == "eng+nep" and text.language_code("klingon") == "eng"


def test_bad_pages_beside_good_ones(spark, tmp_path, monkeypatch):
    def pdf(content: bytes, dpi: int):
        yield 2, 2, 1, b"abcd", 2.0, 2.0
        yield ValueError("one bad page")
        yield 2, 2, 1, b"efgh", 2.0, 2.0
        if content == b"torn":
            raise ValueError("the rest is torn")

    (tmp_path / "doc").mkdir()
    for name, content in (("a.pdf", b"whole"), ("b.pdf", b"torn")):
        (tmp_path / "doc" / name).write_bytes(content)
    monkeypatch.setattr(backends, "PROVIDERS", {"pdf": pdf})
    found = pages.ingest(pages.files(spark, str(tmp_path)))
    rows = pages.numbered(found).orderBy("page").collect()
    assert [(r["page"], r["raster"]["h"], r["native_w"]) for r in rows] == [(1, 2, 2.0), (2, 100, 0.0), (3, 2, 2.0), (4, 2, 2.0), (5, 100, 0.0), (6, 2, 2.0)]
    assert bytes(rows[1]["raster"]["data"][:3]) == b"\xc8\xc8\xff" and [r["error"] for r in pages.errors(found).collect()] == ["the rest is torn"]


def test_new_ids(spark):
    found = [r[0] for r in spark.range(50).select(text.new_id("roi")).collect()]
    assert len(set(found)) == 50 and all(len(x) == 12 and x.startswith("roi_") and int(x[4:], 16) >= 0 for x in found)


def test_adaptive_threshold():
    x = np.full((40, 40), 200, np.uint8)
    x[20, 20] = 0
    out = raster.adaptive_threshold(x)
    assert out[20, 20] == 0 and (out == 255).sum() == 1599 and raster.adaptive_threshold(np.zeros((3, 3), np.uint8)).tolist() == [[255] * 3] * 3


def test_ingest_without_backends(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "a.pdf").write_bytes(b"this is not a pdf")
    (tmp_path / "doc" / "b.txt").write_bytes(b"x")
    found = pages.ingest(pages.files(spark, str(tmp_path)))
    assert pages.numbered(found).count() == 0 and pages.errors(found).count() == 2


def test_ocr_text(spark):
    words = F.expr("array(named_struct('text', 'a', 'confidence', 90D), named_struct('text', ' ', 'confidence', 10D), named_struct('text', 'b', 'confidence', -1D))")
    row = spark.range(1).select(extraction.ocr_text(words).alias("o")).first()["o"]
    assert (row["text"], row["confidence"]) == ("a b", 90.0)


def test_streamed_outcomes(spark, tmp_path):
    fields = spark.createDataFrame([(0, "n", "citizenship_no", "TEXT", "CRITICAL")], "position int, certificate_field string, form_field string, field_type string, priority string")
    spark.createDataFrame([(1, "citizenship_no", "1-2", "1 2", 1)], "pair_id long, form_field string, value_a string, value_b string, t long").selectExpr("*", "timestamp_seconds(t) AS ts").drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair_id long, form_field string, value_a string, value_b string, ts timestamp").parquet(str(tmp_path / "in"))
    query = validation.summaries(validation.outcomes(stream, fields, 2026)).writeStream.outputMode("complete").format("memory").queryName("summaries").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("summaries").first()["overall_status"] == "PASS"
