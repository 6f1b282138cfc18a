"""Routing of regions by field type, and the values that result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import dates, geometry, normalize, text
from attestor.operators import marks, raster
from attestor.sources import backends, templates


def branch(field_type: Column, has_box: Column, has_options: Column) -> Column:
    """marks, ink, photo, text, or null for types that nothing reads."""
    return (
        F.when((field_type == "CHECKBOX_GROUP") & has_options, "marks")
        .when(field_type.isin("SIGNATURE", "THUMBPRINT") & has_box, "ink").when((field_type == "PHOTO") & has_box, "photo")
        .when(field_type.isin("TEXT", "NAME", "NUMBER", "DATE", "ADDRESS") & has_box, "text")
    )


def effective_value(raw: Column, edited: Column) -> Column:
    """The edit if there is one, an empty one too."""
    return F.coalesce(edited, raw)


def below_threshold(confidence: Column, threshold: Column, error: Column) -> Column:
    """True where a region could not be read at all (error), else by its
    confidence; an engine's own error leaves none, which is below nothing."""
    return error.isNotNull() | F.coalesce(confidence < threshold, F.lit(False))


def ocr_text(words: Column) -> Column:
    """text and mean confidence of OCR words (text, confidence): blank words
    go, negative confidences count as none."""
    kept = F.filter(F.transform(words, lambda w: F.struct(normalize.strip(F.coalesce(w["text"], F.lit(""))).alias("text"), w["confidence"].alias("confidence"))), lambda w: w["text"] != "")

    def joined(kept: Column) -> Column:
        known = F.filter(F.transform(kept, lambda w: w["confidence"]), lambda c: c.isNotNull() & (c >= 0))
        mean = dates.let(known, lambda k: F.when(F.size(k) > 0, geometry.round_half_even(F.aggregate(k, F.lit(0.0), lambda a, c: a + c) / F.size(k))))
        return F.struct(F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("text"), mean.alias("confidence"))

    return dates.let(kept, joined)


# Errors of a field that is not read, and the page mode by field type.
NO_BOX, NO_CROP = "ROI has no box configured.", "ROI crop is empty or out of bounds."
PAGE_MODES = {"TEXT": 7, "NAME": 7, "NUMBER": 7, "DATE": 7, "ADDRESS": 6, "TABLE": 6, "DEFAULT": 6}


def recognized(images: Column, language: Column, field_type: Column) -> Column:
    """words (text, confidence) and error of images, by the registered engine.

    The language's packs are resolved by those installed, the page mode by the
    field type; a missing engine and one that fails are errors of the engine.
    """
    engine = backends.Engine(backends.PROVIDERS)

    @F.pandas_udf("struct<words: array<struct<text: string, confidence: double>>, error: string>")
    def read(batches: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        installed, missing = engine.known()

        def each(image: dict, name: str | None, kind: str) -> tuple:
            if image["data"] is None or missing:
                return None, missing if image["data"] is not None else None
            try:
                found = engine.read(raster.array_of(image), text.language_code(name, installed), PAGE_MODES.get(kind, PAGE_MODES["DEFAULT"]))
                return [{"text": t, "confidence": c} for t, c in found], None
            except Exception as e:
                return None, f"OCR failed: {e}"

        for rasters, languages, types in batches:
            yield pd.DataFrame([each(*x) for x in zip(rasters.to_dict("records"), languages, types, strict=True)], columns=["words", "error"])

    return read(images, language, field_type)


def text_fields(pages: DataFrame, rois: DataFrame) -> DataFrame:
    """document, roi_name, raw_value, confidence, below_threshold and error of
    every region on pages (document, page, raster, native_w, native_h).

    A region without a box, with a crop of less than two pixels, or that can't
    be read has an error, and the others are read on.
    """
    missing = templates.beside(pages.drop("raster"), rois.where("box IS NULL"), "page").select("document", "roi_name", F.lit("").alias("raw_value"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("below_threshold"), F.lit(NO_BOX).alias("error"))
    small = F.col("crop").isNull() | (F.col("crop.h") < 2) | (F.col("crop.w") < 2)
    regions = raster.prepared(raster.crops(pages, rois).withColumn("_small", small).withColumn("crop", F.when(~F.col("_small"), F.col("crop"))))
    read = regions.withColumn("_read", recognized(F.col("prepared.raster"), F.col("language"), F.col("field_type"))).withColumn("_text", ocr_text(F.coalesce("_read.words", F.array().cast("array<struct<text: string, confidence: double>>"))))
    unread = F.when(F.col("_small"), NO_CROP).otherwise(F.concat(F.lit("Extraction error: "), "prepared.error"))
    found = read.select("document", "roi_name", F.col("_text.text").alias("raw_value"), F.col("_text.confidence").alias("confidence"), below_threshold(F.col("_text.confidence"), F.col("confidence_threshold"), unread).alias("below_threshold"), F.coalesce(unread, F.col("_read.error")).alias("error"))
    return found.unionByName(missing)


def by_page(rois: DataFrame, values: DataFrame) -> DataFrame:
    """document, page and its fields (roi_name, field_type, priority, value) in
    template order, for review; regions without a value are left out.  Values that
    name their template (template_id) meet the regions of that one alone."""
    field = F.struct("position", F.struct("roi_name", "field_type", "priority", "value").alias("field"))
    return templates.beside(values, rois.drop("document"), "roi_name").groupBy("document", "page").agg(F.transform(F.sort_array(F.collect_list(field)), lambda x: x["field"]).alias("fields"))


def values(regions: DataFrame, mark_options: DataFrame) -> DataFrame:
    """document, roi_name, value of every routed region.

    regions: document, roi_name, branch, text, ink_share, variance; and
    mark_options: document, roi_name, option, position, ink_ratio.
    """
    ink, photo = geometry.detect_ink(F.col("ink_share")), geometry.detect_photo(F.col("variance"))
    read = F.when(F.col("branch") == "text", F.coalesce("text", F.lit(""))).when(F.col("branch") == "ink", ink["status"]).when(F.col("branch") == "photo", photo["status"])
    single = regions.where("branch IN ('text', 'ink', 'photo')").select("document", "roi_name", read.alias("value"))
    group = marks.chosen(marks.detect(mark_options, "document", "roi_name"), "document", "roi_name")
    return single.unionByName(group.select("document", "roi_name", "value"))
