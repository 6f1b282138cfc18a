"""Export of extracted values and outcomes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources import spreadsheet, templates


def rows(rois: DataFrame, values: DataFrame, document: str) -> DataFrame:
    """Values (roi_name, value) beside their regions, in template order
    (position); regions without a value are left out.  Values that name their
    template (template_id) meet the regions of that one alone."""
    status = F.when(F.coalesce("value", F.lit("")) != "", "OK").otherwise("EMPTY")
    return templates.beside(values, rois, "roi_name").select(
        "position", F.lit(document).alias("Document"), F.col("roi_name").alias("Field"), F.col("page").alias("Page"), F.col("roi_name").alias("ROI"), F.col("value").alias("Value"),
        F.col("field_type").alias("Field Type"), F.col("priority").alias("Priority"), F.col("required").alias("Required"), status.alias("Review Status"),
    )


def together(*parts: DataFrame) -> DataFrame:
    """Parts one after another, numbered by part for a stable order."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        out = out.unionByName(more.withColumn("part", F.lit(i)))
    return out


def json_reports(exported: DataFrame, outcomes: DataFrame, summary: DataFrame) -> DataFrame:
    """pair_id and a JSON text of its fields, counts and results.

    All three have pair_id; each pair's rows are few (a form's fields).
    """
    listed = lambda df, order, *cols: df.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*cols).alias("row")))), lambda s: s["row"]).alias("rows"))
    fields = listed(exported, ["part", "position"], "Document", "Field", "Page", "ROI", "Value", "Field Type", "Priority", "Required", "Review Status").withColumnRenamed("rows", "extracted_fields")
    results = listed(outcomes, ["position"], F.col("form_field").alias("field"), "value_a", "value_b", "result", "confidence", "detail").withColumnRenamed("rows", "results")
    joined = summary.join(fields, "pair_id", "left").join(results, "pair_id", "left")
    validation = F.struct("overall_status", "matched", "needs_review", "mismatched", "missing", "results").alias("validation")
    return joined.select("pair_id", F.to_json(F.struct("extracted_fields", validation), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_csv(exported: DataFrame, path: str) -> None:
    """CSV files in order, values as they are: quotes are doubled, null is nothing, like an empty text."""
    kept = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    exported.orderBy("part", "position").drop("part", "position").write.mode("overwrite").options(**kept).csv(path)


def write_json(reports: DataFrame, path: str) -> None:
    """A JSON text for each pair, one after another."""
    reports.select("value").write.mode("overwrite").text(path)


def write_workbook(exported: DataFrame, outcomes: DataFrame, path: str) -> None:
    """One workbook: the extracted fields, and the validation results beside them."""
    results = outcomes.select("pair_id", "position", F.col("form_field").alias("Field"), F.col("value_a").alias("Citizenship Value"), F.col("value_b").alias("KYC Value"), F.col("result").alias("Result"), F.col("confidence").alias("Confidence"))
    fields = (exported, ["part", "position"])
    spreadsheet.write(exported.sparkSession, path, {"Extracted Fields": fields, "Validation": (results, ["pair_id", "position"])})


def layout_report(pairs: DataFrame, statistics: DataFrame) -> DataFrame:
    """Per page counts and the paired marks, as nested rows for write.json."""
    marks = pairs.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("circle_id", F.array("x0", "y0", "x1", "y1").alias("box"), "label"))).alias("checkboxes"))
    return statistics.join(marks, "page", "left")


def config(rois: DataFrame, **keys) -> DataFrame:
    """template_id and the JSON of a configuration: the regions, and keys such
    as a form's code; see config_statistics for its counts.

    One grouping has all of a template, so that nothing is joined or broadcast.
    Regions of no template (template_id) are left out; a key that the rows have is an error.
    """
    stem = F.regexp_extract(F.concat("template_id", F.lit(".json")), templates.STEM, 1)
    # a plain filter on the ids would move to where files are read, and parse each again
    named = F.when(F.size("rois") > 0, F.col("template_id")).isNotNull()
    whole = templates.packed(rois).where(named).withColumns({"display_name": F.coalesce("display_name", stem), "document_type": F.coalesce("document_type", F.lit("kyc"))})
    more = F.parse_json(F.lit(json.dumps({k: v for k, v in keys.items() if k != "pages"}))).cast("map<string, variant>")
    return templates.written(whole, more)


def config_statistics(rois: DataFrame) -> DataFrame:
    return rois.groupBy("template_id").agg(F.count("*").alias("total"), F.count_if("calibrated").alias("calibrated"), F.count_if(~F.col("calibrated")).alias("placeholder"))
