"""Matching, normalisation, dates and roll-up against fixed examples."""

import difflib

import pytest
from pyspark.sql import functions as F

from attestor.functions import dates, match, normalize, text
from attestor.operators import validate


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_transliteration(spark):
    cases = {"राम": "ram", "सीता": "sita", "क्षेत्री": "kshetri", "काठमाडौं": "kathamadauं", "कं": "kn", "": "", "Ram": "Ram", "क.": "ka."}
    assert column(spark, list(cases), normalize.transliterate) == list(cases.values())


def test_canonical_forms(spark):
    names = column(spark, ["राम बहादुर थापा", "Ram Bahadur Thapa", "Ram, Bdr. Thapa", "Ram Parsad", "Ram Prasad", None], normalize.canonical_name)
    assert names[0] == names[1] == names[2] and names[3] == names[4] and names[5] == ""
    assert column(spark, ["12-34-56789", "12 34 56789", "ab-12", "AB12"], normalize.canonical_id) == ["123456789", "123456789", "AB12", "AB12"]
    assert column(spark, ["  Ram  \t Thapa\x1c "], normalize.normalize_whitespace) == ["Ram Thapa"]
    assert column(spark, ["राम", "Ram", ""], normalize.has_devanagari) == [True, False, False]


PAIRS = [
    ("applicant_name", "NAME", "राम बहादुर थापा", "Ram Bahadur Thapa", "MATCH"),
    ("applicant_name", "NAME", "", "Ram Thapa", "REVIEW_REQUIRED"),
    ("applicant_name", "NAME", "राम बहादुर थापा", "Sita Kumari Gurung", "MISMATCH"),
    ("citizenship_no", "TEXT", "12-34-56789", "12-34-56789", "EXACT_MATCH"),
    ("citizenship_no", "TEXT", "12-34-56789", "12 34 56789", "NORMALIZED_MATCH"),
    ("citizenship_no", "TEXT", "12-34-56789", "12-34-56780", "MISMATCH"),
    ("citizenship_no", "TEXT", "", "12-34-56789", "UNREADABLE"),
    ("dob", "DATE", "2059/04/12 B.S.", "2002/07/29 A.D.", "REVIEW_REQUIRED"),
    ("dob", "DATE", "2002/07/28 A.D.", "28-7-2002", "MATCH"),
    ("dob", "DATE", "not a date", "2002/07/28", "UNREADABLE"),
    ("gender", "TEXT", "पुरुष", "Male", "MATCH"),
    ("gender", "TEXT", "पुरुष", "Female", "MISMATCH"),
    ("address", "TEXT", "Kathmandu Ward 5", "Lalitpur Ward 5", "REVIEW_REQUIRED"),
    ("address", "TEXT", "काठमाडौं", "kathmandu", "PROBABLE_MATCH"),
]


def test_dispatch(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, form_field string, field_type string, value_a string, value_b string, want string")
    for r in validate.outcomes(rows, 2026).collect():
        assert r["result"] == r["want"], r


def test_similarity_is_that_of_the_standard_library(spark):
    pairs = [("ram bahadur thapa", "sita kumari gurung"), ("sita kumari gurung", "ram bahadur thapa"), ("ab" * 150, "ba" * 150), ("a", "b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", match.similarity(F.col("a"), F.col("b")).alias("s"))
    for r in rows.collect():
        want = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["s"]["ratio"] == want and r["s"]["confidence"] == round(want * 100, 1)


def test_dates(spark):
    got = column(spark, ["2059/04/12 B.S.", "2002/07/28 A.D.", "2002/2/30 AD", "2059 04 12", "२०५९/०४/१२", "2059 / 04 / 12", None, "12/04/1999", "0000/01/01"], lambda c: dates.parse(c, 2026))
    assert [g and (g["calendar"], str(g["ad_date"]) if g["ad_date"] else None) for g in got] == [("BS", None), ("AD", "2002-07-28"), ("AD", None), None, None, ("BS", None), None, ("AD", "1999-04-12"), ("AD", None)]


def test_calendar_table(spark):
    months = spark.createDataFrame([(1, 1, 31), (1, 2, 30)], "bs_year int, bs_month int, n_days int")
    rows = spark.createDataFrame([("0001/02/01 BS",), ("0001/02/31 BS",)], "v string").select("v", dates.parse(F.col("v"), 2026).alias("p"))
    found = {r["v"]: r["p"]["ad_date"] for r in dates.resolve(rows, "p", months, "2000-01-01").collect()}
    assert str(found["0001/02/01 BS"]) == "2000-02-01" and found["0001/02/31 BS"] is None


@pytest.mark.parametrize(
    ("results", "want"),
    [
        ([("MATCH", "CRITICAL")], "PASS"), ([("MISMATCH", "CRITICAL"), ("UNREADABLE", "OPTIONAL")], "MISMATCH"), ([("MISMATCH", "OPTIONAL"), ("UNREADABLE", "OPTIONAL")], "INCOMPLETE"),
        ([("MISMATCH", "OPTIONAL")], "PASS WITH REVIEW"), ([("PROBABLE_MATCH", "CRITICAL"), ("EXACT_MATCH", "CRITICAL")], "PASS WITH REVIEW"),
    ],
)
def test_status(spark, results, want):
    rows = spark.createDataFrame([(1, *r) for r in results], "pair_id int, result string, priority string")
    assert validate.summarize(rows, "pair_id").first()["overall_status"] == want


def test_redaction(spark):
    assert column(spark, ["abcdefg", "abcd", "", None], text.redact) == ["ab***fg", "****", "", ""]
    rows = spark.createDataFrame([("DOB", "abcdefg"), ("dob_x", "abcdefg")], "n string, v string")
    assert [r[0] for r in rows.select(text.redact_field(F.col("n"), F.col("v"))).collect()] == ["ab***fg", "abcdefg"]


def test_default_map(spark):
    values = spark.createDataFrame([(1, "full_name", "राम"), (1, "citizenship_number", "1-2")], "pair_id long, field string, value string")
    form = spark.createDataFrame([(1, "applicant_1_name", "Ram"), (1, "citizenship_no_applicant_1", "1 2")], "pair_id long, field string, value string")
    found, summary = validate.run_validation(values, form, 2026)
    assert found.count() == len(validate.FIELD_MAP)
    row = summary.first()
    assert (row["matched"], row["overall_status"]) == (2, "INCOMPLETE")


def test_white_space_of_any_kind_is_stripped(spark):
    """OCR text ends in newlines: a translated value or an id is the same with them."""
    rows = spark.createDataFrame([("Male\n", "पुरुष", "MATCH"), ("\tMale", "Female", "MISMATCH")], "a string, b string, want string")
    assert all(r["r"] == r["want"] for r in rows.select("want", match.match_enum(F.col("a"), F.col("b"))["result"].alias("r")).collect())
    ids = spark.createDataFrame([("12-34\n", "12-34", "EXACT_MATCH"), ("12-34\u00a0", " 12 34", "NORMALIZED_MATCH")], "a string, b string, want string")
    assert all(r["r"] == r["want"] for r in ids.select("want", match.match_id(F.col("a"), F.col("b"))["result"].alias("r")).collect())


def test_a_field_is_critical_by_name(spark):
    fields = spark.createDataFrame([(0, "n", "citizenship_no", "TEXT", "CRITICAL"), (1, "m", "citizenship_no", "TEXT", "OPTIONAL")], "position int, certificate_field string, form_field string, field_type string, priority string")
    certificate = spark.createDataFrame([(1, "n", "12"), (1, "m", "13")], "pair_id long, field string, value string")
    form = spark.createDataFrame([(1, "citizenship_no", "12")], "pair_id long, field string, value string")
    found, summary = validate.run_validation(certificate, form, 2026, fields)
    assert [r["result"] for r in found.orderBy("position").collect()] == ["EXACT_MATCH", "MISMATCH"] and summary.first()["overall_status"] == "MISMATCH"
    assert validate.run_validation(certificate, form, 2026, fields.limit(0))[0].count() == len(validate.FIELD_MAP)
    twice = certificate.union(certificate.withColumn("value", F.lit("99")))
    assert validate.run_validation(twice, form, 2026, fields)[0].count() == 2
    with pytest.raises(ValueError):
        validate.map_rows(spark.range(validate.MAP_ROWS + 1).select(F.col("id").cast("int").alias("position"), *(F.lit("x").alias(c) for c in list(validate.MAP_COLUMNS)[1:])))


def test_bs_dates_meet_ad_dates_in_validation(spark):
    """With a table of months a BS date is compared by its AD day, else it goes to review."""
    months = spark.createDataFrame([(2059, m, 31) for m in range(1, 13)], "bs_year int, bs_month int, n_days int")
    certificate = spark.createDataFrame([(1, "dob_bs", "2059/04/12 B.S."), (2, "dob_bs", "2059/04/12 B.S.")], "pair_id long, field string, value string")
    form = spark.createDataFrame([(1, "dob_applicant_1", "2002/07/28 A.D."), (2, "dob_applicant_1", "1999/01/01 A.D.")], "pair_id long, field string, value string")
    dob = lambda **more: {r["pair_id"]: r["result"] for r in validate.run_validation(certificate, form, 2026, **more)[0].where("form_field = 'dob_applicant_1'").collect()}
    assert dob(months=months, start="2002-04-15") == {1: "MATCH", 2: "MISMATCH"}
    assert dob(months=months, start="2002-04-14") == {1: "REVIEW_REQUIRED", 2: "MISMATCH"}
    assert dob() == {1: "REVIEW_REQUIRED", 2: "REVIEW_REQUIRED"}
