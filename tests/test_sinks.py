"""Files that are written, read back by other means."""

import csv
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from attestor.operators import export, validate
from attestor.plans import catalog
from attestor.sources import spreadsheet, templates

SPACE = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheets(path):
    """Names and rows of a workbook, by the standard library alone."""
    out = {}
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        names = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", SPACE)]
        for i, name in enumerate(names, 1):
            out[name] = []
            for row in ET.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).findall("m:sheetData/m:row", SPACE):
                cells = []
                for c in row.findall("m:c", SPACE):
                    v, t = c.find("m:v", SPACE), c.find("m:is/m:t", SPACE)
                    cells.append((t.text or "") if t is not None else None if v is None else v.text == "1" if c.get("t") == "b" else float(v.text))
                out[name].append(cells)
    return out


def exported(spark):
    rois = templates.rois(spark.createDataFrame([("dir/form.json", catalog.TEMPLATE)], "template_path string, json string"))
    values = spark.createDataFrame([("full_name", "Ram & <Sita>\x01"), ("dob", ""), ("sex", None), ("nowhere", "x")], "roi_name string, value string")
    return export.together(export.rows(rois, values, "Front"), export.rows(rois, values.where("roi_name = 'dob'"), "Back"))


def test_workbook(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spreadsheet, "PART_ROWS", 2)
    rows = exported(spark)
    results = spark.createDataFrame([(2, "b", True, 1.5, 7), (1, None, False, None, 8)], "position int, Field string, Good boolean, Confidence double, n long")
    path = str(tmp_path / "book.xlsx")
    for _ in range(2):  # an existing file is replaced
        spreadsheet.write(spark, path, {"Extracted Fields": (rows, ["part", "position"]), "Validation": (results, ["position"])})
    got = sheets(path)
    names = [c for c in rows.columns if c not in ("part", "position")]
    want = [[r[c] if not isinstance(r[c], int) or isinstance(r[c], bool) else float(r[c]) for c in names] for r in rows.orderBy("part", "position").collect()]
    want = [["Ram & <Sita>" if c == "Ram & <Sita>\x01" else c for c in row] for row in want]
    assert list(got) == ["Extracted Fields", "Validation"] and got["Extracted Fields"] == [names, *want] and len(want) == 4
    assert got["Validation"] == [["Field", "Good", "Confidence", "n"], [None, False, None, 8.0], ["b", True, 1.5, 7.0]]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]


def test_workbook_of_nothing_and_of_too_much(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([], "k int, a string")
    spreadsheet.write(spark, str(tmp_path / "none.xlsx"), {"x": (none, ["k"])})
    outcomes = spark.createDataFrame([(1, 0, "dob", "a", "b", "MATCH", 99.5)], "pair_id long, position int, form_field string, value_a string, value_b string, result string, confidence double")
    export.write_workbook(exported(spark), outcomes, str(tmp_path / "both.xlsx"))
    assert sheets(tmp_path / "both.xlsx")["Validation"] == [["Field", "Citizenship Value", "KYC Value", "Result", "Confidence"], ["dob", "a", "b", "MATCH", 99.5]]
    assert sheets(tmp_path / "none.xlsx") == {"x": [["a"]]}
    monkeypatch.setattr(spreadsheet, "SHEET_ROWS", 3)
    with pytest.raises(Exception, match="more than 3 rows"):
        spreadsheet.write(spark, str(tmp_path / "many.xlsx"), {"x": (spark.range(5).select("id", F.lit("v").alias("v")), ["id"])})
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("many.xlsx") and p.suffix == ".xlsx"]


def test_csv_and_json(spark, tmp_path):
    rows = exported(spark)
    export.write_csv(rows, str(tmp_path / "csv"))
    found = [row for f in sorted((tmp_path / "csv").glob("part-*.csv")) for row in list(csv.reader(f.open(newline="")))[1:]]
    want = [tuple("" if r[c] is None else str(r[c]).lower() if isinstance(r[c], bool) else str(r[c]) for c in rows.columns if c not in ("part", "position")) for r in rows.orderBy("part", "position").collect()]
    assert [tuple(r) for r in found] == want
    outcomes = spark.createDataFrame([(1, 0, "dob", "a", "b", "MATCH", 99.5, None, "CRITICAL"), (2, 0, "dob", "a", None, "UNREADABLE", None, "d", "CRITICAL")], "pair_id long, position int, form_field string, value_a string, value_b string, result string, confidence double, detail string, priority string")
    reports = export.json_reports(rows.withColumn("pair_id", F.lit(1)), outcomes, validate.summarize(outcomes, "pair_id"))
    export.write_json(reports, str(tmp_path / "json"))
    decoder, texts = json.JSONDecoder(), "".join(f.read_text() for f in sorted((tmp_path / "json").glob("part-*.txt"))).strip()
    read, at = [], 0
    while at < len(texts):
        one, at = decoder.raw_decode(texts, at)
        read.append(one)
        at += len(texts[at:]) - len(texts[at:].lstrip())
    by = {r["validation"]["results"][0]["result"]: r for r in read}
    assert len(by["MATCH"]["extracted_fields"]) == 4 and by["UNREADABLE"]["extracted_fields"] is None and by["UNREADABLE"]["validation"]["missing"] == 1
