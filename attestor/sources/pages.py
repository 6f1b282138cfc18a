"""Pages of uploaded files (PDF or image), numbered across files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources import backends

SCHEMA = "document string, file_order int, path string, page_in_file int, native_w double, native_h double, raster struct<h: int, w: int, c: int, data: binary>, error string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """root/document/file as rows: document, file_order, path, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    named = rows.withColumn("document", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return named.withColumn("file_order", F.expr("CAST(row_number() OVER (PARTITION BY document ORDER BY path) AS INT)"))


def ingest(rows: DataFrame, dpi: int = 200) -> DataFrame:
    """All pages; a page that can't be drawn has a placeholder, and a file that
    can't be read any further gives one row with its error after the pages before it."""
    providers = dict(backends.PROVIDERS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out, base = [], {"document": row.document, "file_order": row.file_order, "path": row.path}
                try:
                    for at, (h, w, c, data, nw, nh) in backends.pages_of(row.path, row.content, dpi, providers):
                        out.append(base | {"page_in_file": at, "native_w": nw, "native_h": nh, "raster": {"h": h, "w": w, "c": c, "data": data}, "error": None})
                except Exception as e:
                    out.append(base | {"page_in_file": None, "native_w": None, "native_h": None, "raster": None, "error": str(e)})
                yield pd.DataFrame(out, columns=["document", "file_order", "path", "page_in_file", "native_w", "native_h", "raster", "error"])

    return rows.select("document", "file_order", "path", "content").mapInPandas(each, SCHEMA)


def numbered(pages: DataFrame) -> DataFrame:
    """Pages without errors, counted on over a document's files, with a label."""
    rows = pages.where("error IS NULL").withColumn("page", F.expr("CAST(row_number() OVER (PARTITION BY document ORDER BY file_order, page_in_file) AS INT)"))
    return rows.withColumn("label", F.when(F.col("page") == 1, "Front").when(F.col("page") == 2, "Back").otherwise(F.concat(F.lit("Page "), "page")))


def errors(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NOT NULL").select("document", "path", "error")


def page_counts(rows: DataFrame) -> DataFrame:
    """document, path, page_count and error of files (document, path, content)."""
    providers = dict(backends.PROVIDERS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.document, row.path, backends.count_of(row.path, row.content, providers), None))
                except Exception as e:
                    out.append((row.document, row.path, None, str(e)))
            yield pd.DataFrame(out, columns=["document", "path", "page_count", "error"]).astype({"page_count": "Int32"})

    return rows.select("document", "path", "content").mapInPandas(each, "document string, path string, page_count int, error string")


def single_page(rows: DataFrame, number: int, dpi: int = 200) -> DataFrame:
    """One page of each file; a file without it gives a row with an error.

    Pages come lazily from a provider, and none after this one is asked for.
    """
    providers = dict(backends.PROVIDERS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = {"document": row.document, "file_order": row.file_order, "path": row.path, "page_in_file": None, "native_w": None, "native_h": None, "raster": None, "error": None}
                try:
                    last = 0
                    for last, (h, w, c, data, nw, nh) in backends.pages_of(row.path, row.content, dpi, providers):  # noqa: B007
                        if last == number:
                            out |= {"page_in_file": last, "native_w": nw, "native_h": nh, "raster": {"h": h, "w": w, "c": c, "data": data}}
                            break
                    else:
                        out["error"] = f"Page {number} not found (document has {last} pages)."
                except Exception as e:
                    out["error"] = str(e)
                yield pd.DataFrame([out])

    return rows.select("document", "file_order", "path", "content").mapInPandas(each, SCHEMA)


def words(rows: DataFrame) -> DataFrame:
    """The words of PDF files by the registered "words" provider, as the layout
    operators take them; boxes are rounded to a tenth.  A file that can't be
    read gives one row with its error."""
    providers = dict(backends.PROVIDERS)
    columns = ["page", "block", "line", "word_no", "x0", "y0", "x1", "y1", "text"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    found = [(row.document, row.path, page, block, line, no, *(round(v, 1) for v in box), text, None) for page, *box, text, block, line, no in backends.provider("words", providers)(row.content)]
                except Exception as e:
                    found = [(row.document, row.path, *[None] * 9, str(e))]
                yield pd.DataFrame(found, columns=["document", "path", *columns, "error"])

    return rows.select("document", "path", "content").mapInPandas(each, "document string, path string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, error string")
