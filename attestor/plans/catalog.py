"""The registered queries of the record-validation operators, with SQL twins.

The tables hold no form data, so pairs are derived from them by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import geometry, match, normalize, text
from attestor.operators import export, layout, marks, validate
from attestor.plans import forms
from attestor.sources import templates

AS_OF_YEAR = 2026
NAMES = ("राम बहादुर थापा", "सीता कुमारी", "क्षेत्री", "काठमाडौं", "कं", "श्रेष्ठ १२", "ज्ञान प्रसाद", "Ram Bdr Thapa")
TEMPLATE = """{"template_id": "t1", "display_name": "Form", "pages": [{"page_number": 1, "fields": [
 {"roi_name": "full_name", "field_type": "NAME", "box": [1, 2, 3, 4], "priority": "CRITICAL", "required": true},
 {"roi_name": "dob", "field_type": "DATE", "language": null, "calibrated": false}]},
 {"page_number": 2, "fields": [{"roi_name": "sex", "field_type": "CHECKBOX_GROUP", "calibrated": false, "confidence_threshold": 70.5}, {"page": 7, "notes": "x"}]}]}"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q1_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", normalize.canonical_text(F.col("text")).alias("canonical"))


def q2_transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, NAMES)), F.col("n_nationkey") % len(NAMES) + 1)
    rows = _read(spark, sf_dir, "nation").withColumn("source", F.concat_ws(" ", word, "n_name"))
    return rows.select("n_nationkey", "source", normalize.transliterate(F.col("source")).alias("latin"), normalize.canonical_name(F.col("source")).alias("name"))


def q3_match_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.col("o_custkey").cast("string")
    case = F.col("o_orderkey") % 4
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", key, customer).alias("a"), F.when(case == 0, F.concat(F.lit("\t"), F.concat_ws("-", key, customer), F.lit("\u00a0\n"))).when(case == 1, F.concat_ws("  ", key, customer)).when(case == 2, F.concat(key, F.lit("-9"), customer)).otherwise("").alias("b"))
    return rows.withColumn("o", match.match_id(F.col("a"), F.col("b"))).select("o_orderkey", "o.*")


def q4_match_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, case = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    shifted = F.date_add(day, F.element_at(F.array(*map(F.lit, (0, 1, 2, 5))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    b = F.when(case == 0, F.date_format(shifted, "dd-MM-yyyy")).when(case == 1, F.date_format(shifted, "yyyy/M/d")).when(case == 2, F.lit("2002/02/30")).when(case == 3, F.lit("2059/04/12 B.S.")).when(case == 4, F.lit("not a date")).otherwise(F.concat(F.date_format(shifted, "yyyy.MM.dd"), F.lit(" A.D.")))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" A.D.")).alias("a"), b.alias("b"))
    return rows.withColumn("o", match.match_date(F.col("a"), F.col("b"), AS_OF_YEAR)).select("o_orderkey", "o.*")


def _record_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    sexes = F.array(*map(F.lit, ("Male", "महिला", "others", "m")))
    long = lambda *fields: rows.select(key.alias("pair_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields))).alias("f")).select("pair_id", "f.*")
    number, day = F.concat_ws("-", key, "n_name"), F.date_add(F.lit("1970-01-01").cast("date"), (key % 9999).cast("int"))
    certificate = long(("number", number), ("alias", F.when(key % 17 == 0, F.concat(number, F.lit("x"))).otherwise(number)), ("sex", F.concat(F.lit("\t"), F.element_at(sexes, (key % 4 + 1).cast("int")), F.lit("\n"))), ("born", F.date_format(day, "yyyy/MM/dd")), ("passport", F.when(key % 5 > 0, number)))
    form = long(
        ("citizenship_no", F.when(key % 3 == 0, number).when(key % 3 == 1, F.concat_ws(" ", key, "n_name")).otherwise(F.when(key % 11 == 0, F.concat(number, F.lit("7"))).otherwise(number))),
        ("gender", F.element_at(sexes, ((key / 2).cast("long") % 4 + 1).cast("int"))), ("dob", F.date_format(F.date_add(day, F.when(key % 13 == 0, 1).otherwise(0)), "dd/MM/yyyy")), ("passport_no", number),
    )
    fields = spark.createDataFrame([(0, "number", "citizenship_no", "TEXT", "CRITICAL"), (1, "sex", "gender", "TEXT", "IMPORTANT"), (2, "born", "dob", "DATE", "CRITICAL"), (3, "passport", "passport_no", "TEXT", "OPTIONAL"), (4, "alias", "citizenship_no", "TEXT", "OPTIONAL")], "position int, certificate_field string, form_field string, field_type string, priority string")
    return certificate, form, fields


def q5_validate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    certificate, form, fields = _record_pairs(spark, sf_dir)
    return validate.run_validation(certificate, form, AS_OF_YEAR, fields)[1]


def q6_match_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 5
    b = F.when(key == 0, F.col("c_name")).when(key == 1, F.replace("c_name", F.lit("#"), F.lit(" "))).when(key == 2, F.concat(F.lit("Mr "), "c_name")).when(key == 3, F.reverse("c_name")).otherwise("")
    return _read(spark, sf_dir, "customer").select("c_custkey", match.match_name(F.col("c_name"), b).alias("o")).select("c_custkey", "o.*")


def q7_mark_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = (F.col("event_id") * 37 % 101) / F.lit(250.0)
    options = _read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("option"), F.col("event_id").alias("position"), ink.alias("ink_ratio"))
    found = marks.detect(options, "user_id")
    counts = found.groupBy("user_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("CHECKED", "UNCHECKED", "REVIEW_REQUIRED")), F.count_if(F.col("checked").isNull()).alias("unsure"))
    return marks.chosen(found.withColumn("option", F.concat_ws(":", "option", "position")), "user_id").select("user_id", "value").join(counts, "user_id")


def q8_label_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    y = 20.0 * F.col("l_linenumber")
    words = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("word_no"), (10.0 + F.col("l_partkey") % 90).alias("x0"), (y + F.col("l_suppkey") % 13).alias("y0"), (120.0 + F.col("l_partkey") % 90).alias("x1"), (y + F.col("l_suppkey") % 13 + 10).alias("y1"), F.concat(F.lit("p"), "l_partkey").alias("text"))
    circles = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("circle_id"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(12.0).alias("x1"), (y + 12).alias("y1"))
    return layout.pair_labels(circles, words).select("page", "circle_id", "label")


def q9_build_lines_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_line = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_line"))
    words = by_line.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), "line", F.posexplode(F.split("_line", " ")).alias("word_no", "text"))
    placed = words.select("*", (F.col("word_no") * 10.0).alias("x0"), (F.col("line") * 12.0).alias("y0"), (F.col("word_no") * 10.0 + F.length("text")).alias("x1"), (F.col("line") * 12.0 + 10).alias("y1"))
    return layout.find_phrase(placed, "of the", "doc_id").select("doc_id", "line", "occurrence", "x0", "y0", F.col("end_x1").alias("x1"), "y1")


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each customer, as (template_path, json)."""
    own = F.concat(F.lit("t"), "c_custkey")
    return _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("dir/"), own, F.lit(".json")).alias("template_path"), F.replace(F.lit(TEMPLATE), F.lit('"t1"'), F.concat(F.lit('"'), own, F.lit('"'))).alias("json"))


def q10_template_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.usable(templates.rois(_templates(spark, sf_dir)))
    return rows.select("template_id", "template_path", "display_name", "document_type", "roi_name", "field_type", "page", "language", F.array_join("box", ",").alias("box"), "required", "priority", "validation", "confidence_threshold", "preprocessing", "ocr_engine", "calibrated", "notes")


def q11_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rois = templates.rois(spark.createDataFrame([("dir/form.json", TEMPLATE)], "template_path string, json string"))
    name = F.element_at(F.array(*map(F.lit, ("full_name", "dob", "nowhere", "sex", "unnamed"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    values = _read(spark, sf_dir, "customer").select("c_custkey", name.alias("roi_name"), F.when(F.col("c_custkey") % 5 == 1, "").otherwise(F.col("c_name")).alias("value"))
    parts = [export.rows(rois, values.where(f"c_custkey % 2 = {i}"), document).select("Field", "Page", "Value", F.col("Field Type").alias("field_type"), "Priority", "Required", "Document", F.col("Review Status").alias("review_status")) for i, document in enumerate(("Front", "Back"))]
    return export.together(*parts)


def q12_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("c_custkey") % 2 == 0, "ID_number").otherwise("dob_applicant_1")
    return _read(spark, sf_dir, "customer").select("c_custkey", text.redact_field(field, F.col("c_name")).alias("value"), text.redact(F.substring("c_name", 1, (F.col("c_custkey") % 9).cast("int"))).alias("short"), text.option_slug(F.concat_ws(". ", "c_mktsegment", "c_name")).alias("slug"))


def q13_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    size = F.size("embedding")
    rows = _read(spark, sf_dir, "embeddings").withColumn("_mean", total("embedding", lambda v: v) / size)
    rows = rows.select("vec_id", (total("embedding", lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))) / size * 20000).alias("variance"), (F.size(F.filter("embedding", lambda v: v > 0.25)) / size).alias("ink"))
    found = rows.withColumn("photo", geometry.detect_photo(F.col("variance"))).withColumn("mark", geometry.detect_ink(F.col("ink")))
    return found.select("vec_id", F.col("photo.present").alias("photo"), F.col("photo.status").alias("photo_status"), F.col("mark.present").alias("signed"), F.col("mark.status").alias("sign_status"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return forms.queries() | {f.__name__: f for f in (q1_canonical_text, q2_transliterate, q3_match_id, q4_match_date, q5_validate_rollup, q6_match_name, q7_mark_group, q8_label_pairing, q9_build_lines_phrase, q10_template_rois, q11_export_rows, q12_redact, q13_presence)}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in pairs.items()) + "}"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _sql_canonical(text_sql: str) -> str:
    return f"lower(trim(regexp_replace(translate({text_sql}, {_quoted(normalize.PUNCTUATION)}, '{' ' * len(normalize.PUNCTUATION)}'), {_quoted(_SPACE + '+')}, ' ', 'g')))"


def _sql_transliterate(s: str) -> str:
    n = normalize
    space = r"\s\x{a0}"
    pattern = _quoted(f"(?s)({'|'.join([*n.CONJUNCTS, *n.CONSONANTS])})([{''.join(n.MATRAS)}{n.HALANT}{space}])?|(.)")
    part = lambda i: f"regexp_extract_all({s} || chr(10), {pattern}, {i})"
    other = f"coalesce({_sql_map(n.VOWELS | n.DIGITS | {n.HALANT: ''})}[t[3]], t[3])"
    sign = f"CASE WHEN coalesce(t[2], '') = '' THEN 'a' ELSE coalesce({_sql_map(n.MATRAS | {n.HALANT: ''})}[t[2]], t[2]) END"
    return f"regexp_replace(array_to_string(list_transform(list_zip({part(1)}, {part(2)}, {part(3)}), lambda t: CASE WHEN coalesce(t[1], '') = '' THEN {other} ELSE {_sql_map(n.CONJUNCTS | n.CONSONANTS)}[t[1]] || {sign} END), ''), '\\n\\z', '')"


def _sql_date(column: str) -> str:
    """Columns y, m, d, calendar and ad of a text column, as a list of select items."""
    bare = rf"trim(regexp_replace(regexp_replace(trim({column}), '(?i)\b[ab]\.?\s*[sd]\.?\b', '', 'g'), '[^0-9/.\-]', '', 'g'), ' ./-')"
    first, last = r"'^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$'", r"'^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$'"
    part = lambda i: f"CAST(CASE WHEN regexp_matches({bare}, {first}) THEN regexp_extract({bare}, {first}, {i}) WHEN regexp_matches({bare}, {last}) THEN regexp_extract({bare}, {last}, {4 - i}) END AS INT)"
    mark = rf"CASE WHEN upper({column}) LIKE '%B.S%' OR regexp_matches(upper({column}), '\bBS\b') THEN 'BS' WHEN upper({column}) LIKE '%A.D%' OR regexp_matches(upper({column}), '\bAD\b') THEN 'AD' WHEN {part(1)} BETWEEN 2000 AND 2100 AND {part(1)} - {AS_OF_YEAR} > 30 THEN 'BS' ELSE 'AD' END"
    return f"{part(1)} AS {column}_y, {mark} AS {column}_c, CASE WHEN {mark} = 'AD' THEN try_cast(lpad(CAST({part(1)} AS VARCHAR), 4, '0') || '-' || lpad(CAST({part(2)} AS VARCHAR), 2, '0') || '-' || lpad(CAST({part(3)} AS VARCHAR), 2, '0') AS DATE) END AS {column}_d"


_VERDICT = "CASE WHEN a_y IS NULL OR b_y IS NULL THEN 'UNREADABLE' WHEN a_d IS NULL OR b_d IS NULL THEN 'REVIEW_REQUIRED' WHEN abs(date_diff('day', a_d, b_d)) = 0 THEN 'MATCH' WHEN abs(date_diff('day', a_d, b_d)) <= 2 THEN 'REVIEW_REQUIRED' ELSE 'MISMATCH' END"


def _sql_id(a: str, b: str) -> str:
    norm = lambda x: f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 'UNREADABLE' WHEN {norm(a)} = '' OR {norm(b)} = '' THEN 'UNREADABLE' WHEN {_sql_strip(a)} = {_sql_strip(b)} THEN 'EXACT_MATCH' WHEN {norm(a)} = {norm(b)} THEN 'NORMALIZED_MATCH' ELSE 'MISMATCH' END"


def oracle_sql() -> dict[str, str]:
    d = forms.oracle_sql()
    names = "[" + ", ".join(map(_quoted, NAMES)) + "]"
    least = _sql_map({x: min(group) for group in normalize.EQUAL_NAMES for x in group})
    deva = "regexp_matches(source, '[\\x{0900}-\\x{097F}]')"
    d["q1_canonical_text"] = f"SELECT doc_id, {_sql_canonical('nfc_normalize(text)')} AS canonical FROM documents"
    d["q2_transliterate"] = f"""
WITH s AS (SELECT n_nationkey, ({names})[n_nationkey % {len(NAMES)} + 1] || ' ' || n_name AS source FROM nation),
t AS (SELECT *, {_sql_transliterate('source')} AS latin, CASE WHEN {deva} THEN {_sql_transliterate('nfc_normalize(source)')} ELSE nfc_normalize(source) END AS l FROM s)
SELECT n_nationkey, source, latin, array_to_string(list_transform(string_split({_sql_canonical('l')}, ' '), lambda w: coalesce({least}[w], w)), ' ') AS name FROM t"""
    d["q3_match_id"] = f"""
WITH p AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS k, CAST(o_custkey AS VARCHAR) AS c FROM orders),
q AS (SELECT o_orderkey, k || '-' || c AS a, CASE o_orderkey % 4 WHEN 0 THEN chr(9) || k || '-' || c || chr(160) || chr(10) WHEN 1 THEN k || '  ' || c WHEN 2 THEN k || '-9' || c ELSE '' END AS b FROM p),
r AS (SELECT o_orderkey, {_sql_id('a', 'b')} AS result FROM q)
SELECT o_orderkey, result, CASE result WHEN 'EXACT_MATCH' THEN 100.0::DOUBLE WHEN 'NORMALIZED_MATCH' THEN 92.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
CASE result WHEN 'UNREADABLE' THEN '{match.EMPTY}' WHEN 'NORMALIZED_MATCH' THEN '{match.NORMALIZED}' WHEN 'MISMATCH' THEN '{match.DIFFERENT_IDS}' END AS detail FROM r"""
    d["q4_match_date"] = f"""
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) + CAST(([0, 1, 2, 5])[o_orderkey % 4 + 1] AS INT) AS DATE) AS moved FROM orders),
p AS (SELECT o_orderkey, strftime(day, '%Y/%m/%d') || ' A.D.' AS a, CASE o_orderkey % 7 WHEN 0 THEN strftime(moved, '%d-%m-%Y') WHEN 1 THEN strftime(moved, '%Y/%-m/%-d') WHEN 2 THEN '2002/02/30' WHEN 3 THEN '2059/04/12 B.S.' WHEN 4 THEN 'not a date' ELSE strftime(moved, '%Y.%m.%d') || ' A.D.' END AS b FROM s),
q AS (SELECT o_orderkey, {_sql_date('a')}, {_sql_date('b')} FROM p),
r AS (SELECT *, {_VERDICT} AS result FROM q)
SELECT o_orderkey, result, CASE result WHEN 'MATCH' THEN 97.0::DOUBLE WHEN 'REVIEW_REQUIRED' THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
CASE WHEN result = 'UNREADABLE' THEN '{match.NO_DATE}' WHEN result = 'REVIEW_REQUIRED' AND (a_d IS NULL OR b_d IS NULL) THEN '{match.UNSURE_DATE}' END AS detail FROM r"""
    group = lambda x: f"CASE WHEN lower({x}) IN ('male', 'm') THEN 0 WHEN {x} = 'महिला' THEN 1 ELSE 2 END"
    d["q5_validate_rollup"] = f"""
WITH s AS (SELECT c_custkey AS k, n_name, c_custkey || '-' || n_name AS number, CAST(DATE '1970-01-01' + CAST(c_custkey % 9999 AS INT) AS DATE) AS day FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT k, number AS ia, CASE k % 3 WHEN 0 THEN number WHEN 1 THEN k || ' ' || n_name ELSE CASE WHEN k % 11 = 0 THEN number || '7' ELSE number END END AS ib,
 (['Male', 'महिला', 'others', 'm'])[k % 4 + 1] AS ga, (['Male', 'महिला', 'others', 'm'])[(k // 2) % 4 + 1] AS gb, strftime(day, '%Y/%m/%d') AS a, strftime(day + CAST(CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS INT), '%d/%m/%Y') AS b,
 CASE WHEN k % 5 > 0 THEN number END AS pa, number AS pb, CASE WHEN k % 17 = 0 THEN number || 'x' ELSE number END AS na FROM s),
q AS (SELECT *, {_sql_date('a')}, {_sql_date('b')} FROM p),
o AS (SELECT k, unnest([{_sql_id('ia', 'ib')}, CASE WHEN {group('ga')} = {group('gb')} THEN 'MATCH' ELSE 'MISMATCH' END, {_VERDICT}, {_sql_id('pa', 'pb')}, {_sql_id('na', 'ib')}]) AS result, unnest([true, false, true, false, true]) AS critical FROM q),
t AS (SELECT k AS pair_id, count(*) AS total, count(*) FILTER (result IN ('MATCH', 'EXACT_MATCH', 'NORMALIZED_MATCH')) AS matched, count(*) FILTER (result IN ('PROBABLE_MATCH', 'REVIEW_REQUIRED')) AS needs_review, count(*) FILTER (result = 'MISMATCH') AS mismatched, count(*) FILTER (result = 'UNREADABLE') AS missing, bool_or(critical AND result = 'MISMATCH') AS bad FROM o GROUP BY k)
SELECT pair_id, total, matched, needs_review, mismatched, missing, CASE WHEN bad THEN 'MISMATCH' WHEN missing > 0 THEN 'INCOMPLETE' WHEN needs_review > 0 OR mismatched > 0 THEN 'PASS WITH REVIEW' ELSE 'PASS' END AS overall_status FROM t"""
    d["q7_mark_group"] = """
WITH e AS (SELECT user_id, event_type || ':' || event_id AS option, event_id AS position, (event_id * 37 % 101) / 250.0::DOUBLE AS ink FROM events),
m AS (SELECT *, CASE WHEN ink <= 0.10::DOUBLE THEN 'UNCHECKED' WHEN ink >= 0.22::DOUBLE THEN 'CHECKED' ELSE 'REVIEW_REQUIRED' END AS s FROM e),
r AS (SELECT *, CASE WHEN s = 'CHECKED' AND row_number() OVER (PARTITION BY user_id ORDER BY s = 'CHECKED' DESC, ink DESC, position) > 1 THEN 'REVIEW_REQUIRED' ELSE s END AS status FROM m)
SELECT user_id, CASE WHEN bool_or(status = 'CHECKED') THEN arg_min(option, position) FILTER (status = 'CHECKED') WHEN bool_or(status = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE '' END AS value,
count(*) FILTER (status = 'CHECKED') AS checked, count(*) FILTER (status = 'UNCHECKED') AS unchecked, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (status = 'REVIEW_REQUIRED') AS unsure FROM r GROUP BY user_id"""
    d["q8_label_pairing"] = """
WITH w AS (SELECT l_orderkey AS page, l_linenumber AS block, 10.0 + l_partkey % 90 AS x0, 20.0 * l_linenumber + l_suppkey % 13 + 5 AS cy, 'p' || l_partkey AS text FROM lineitem),
c AS (SELECT l_orderkey AS page, l_linenumber AS circle_id, 12.0 AS x1, 20.0 * l_linenumber + 6 AS cy FROM lineitem),
j AS (SELECT c.page, c.circle_id, w.text, row_number() OVER (PARTITION BY c.page, c.circle_id ORDER BY w.x0, w.block, w.text) AS n FROM c LEFT JOIN w ON w.page = c.page AND abs(w.cy - c.cy) < 6 AND w.x0 > c.x1 - 2 AND w.x0 - c.x1 < 80)
SELECT page, circle_id, text AS label FROM j WHERE n = 1"""
    d["q9_build_lines_phrase"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
h AS (SELECT *, instr(lower(t), 'of the') - 1 AS hit FROM l WHERE instr(lower(t), 'of the') > 0),
w AS (SELECT doc_id, line, len(string_split(substr(t, 1, hit), ' ')) - 1 AS a, len(string_split(substr(t, 1, hit + 6), ' ')) - 1 AS b, string_split(t, ' ') AS ws FROM h)
SELECT doc_id, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INT) AS occurrence, a * 10.0::DOUBLE AS x0, line * 12.0::DOUBLE AS y0, b * 10.0::DOUBLE + length(ws[b + 1]) AS x1, line * 12.0::DOUBLE + 10 AS y1 FROM w"""
    d["q10_template_rois"] = """
SELECT 't' || c_custkey AS template_id, 'dir/t' || c_custkey || '.json' AS template_path, 'Form' AS display_name, 'kyc' AS document_type, 'none' AS validation, 'default' AS preprocessing, 'tesseract' AS ocr_engine, v.* FROM customer, (VALUES
 ('full_name', 'NAME', 1, 'english', '1.0,2.0,3.0,4.0', true, 'CRITICAL', 60.0::DOUBLE, true, NULL),
 ('sex', 'CHECKBOX_GROUP', 2, 'english', NULL, false, 'OPTIONAL', 70.5::DOUBLE, false, NULL), ('unnamed', 'TEXT', 7, 'english', NULL, false, 'OPTIONAL', 60.0::DOUBLE, true, 'x'))
v(roi_name, field_type, page, language, box, required, priority, confidence_threshold, calibrated, notes)"""
    d["q11_export_rows"] = """
WITH v AS (SELECT c_custkey % 2 AS part, (['full_name', 'dob', 'nowhere', 'sex', 'unnamed'])[c_custkey % 5 + 1] AS f, CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS value FROM customer),
t AS (SELECT * FROM (VALUES ('full_name', 1, 'NAME', 'CRITICAL', true), ('dob', 1, 'DATE', 'OPTIONAL', false), ('sex', 2, 'CHECKBOX_GROUP', 'OPTIONAL', false), ('unnamed', 7, 'TEXT', 'OPTIONAL', false)) t(f, page, kind, priority, required))
SELECT f AS "Field", page AS "Page", value AS "Value", kind AS field_type, priority AS "Priority", required AS "Required", (['Front', 'Back'])[part + 1] AS "Document", CASE WHEN value <> '' THEN 'OK' ELSE 'EMPTY' END AS review_status, CAST(part AS INT) AS part FROM t JOIN v USING (f)"""
    star = lambda x: f"CASE WHEN length({x}) <= 4 THEN repeat('*', length({x})) ELSE left({x}, 2) || repeat('*', length({x}) - 4) || right({x}, 2) END"
    d["q12_redact"] = f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {star('c_name')} ELSE c_name END AS value, {star('substr(c_name, 1, CAST(c_custkey % 9 AS INT))')} AS short, replace(replace(lower(c_mktsegment || '. ' || c_name), ' ', '_'), '.', '') AS slug FROM customer"
    d["q13_presence"] = """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(embedding) AS f FROM embeddings), r AS (SELECT vec_id, var_pop(v) * 20000 AS s, count(*) FILTER (f > 0.25) / count(*)::DOUBLE AS ink FROM v GROUP BY vec_id)
SELECT vec_id, s >= 250 AS photo, CASE WHEN s >= 250 THEN 'PRESENT' WHEN s < 75 THEN 'NOT_DETECTED' ELSE 'REVIEW_REQUIRED' END AS photo_status, ink >= 0.015 AS signed, CASE WHEN ink < 0.006 THEN 'NOT_DETECTED' WHEN ink >= 0.015 THEN 'PRESENT' ELSE 'REVIEW_REQUIRED' END AS sign_status FROM r"""
    return d
