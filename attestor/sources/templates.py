"""Document templates: JSON files to region rows, and edits of these rows.

A missing key takes its default; an explicit null stays null.  VARIANT tells
the two apart.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import geometry

# The vocabularies and the defaults of a region's fields.
FIELD_TYPES = ("TEXT", "NUMBER", "DATE", "NAME", "ADDRESS", "CHECKBOX", "CHECKBOX_GROUP", "SIGNATURE", "PHOTO", "THUMBPRINT", "TABLE", "OPTION_GROUP", "CUSTOM")
DEFAULTS = {
    "roi_name": ("string", "unnamed"), "field_type": ("string", "TEXT"), "page": ("int", None), "language": ("string", "english"), "box": ("array<double>", None),
    "options": ("array<struct<value: string, label: string, box: array<double>>>", None), "columns": ("array<string>", None), "rows": ("array<string>", None), "required": ("boolean", False), "priority": ("string", "OPTIONAL"),
    "validation": ("string", "none"), "validation_target": ("string", None), "confidence_threshold": ("double", 60.0), "preprocessing": ("string", "default"), "ocr_engine": ("string", "tesseract"), "calibrated": ("boolean", True), "notes": ("string", None),
}


SALTS = 16
#: A file's name without its extension, in a path.
STEM = r"([^/]+?)(?:\.[^./]*)?$"
#: The keys of a file that are written from its rows.
OWN = ("template_id", "display_name", "document_type", "rois")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """template_path and the JSON text of every file under a path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("template_path"), F.col("value").alias("json"))


#: Templates by session and path: what their files were, and their rows.
_LOADED: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}
#: Most files of a path that is kept; rows of regions that are broadcast to what they are joined with.
KEPT_FILES, FEW_REGIONS = 10_000, 1 << 16


def load(spark: SparkSession, path: str) -> DataFrame:
    """The regions of all template files under a path, kept until one of the files changes.

    A file is known by its path, length and time of change, which are listed
    without reading it; so a path of more than KEPT_FILES is read each time.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length", "modificationTime")
    files = tuple(sorted(map(tuple, listed.limit(KEPT_FILES + 1).collect())))
    if len(files) > KEPT_FILES:
        return rois(read_files(spark, path))
    place = (spark.sparkContext.applicationId, path)
    known, rows = _LOADED.get(place, (None, None))
    if known != files:
        if rows is not None:
            rows.unpersist()
        rows = rois(read_files(spark, path)).persist()
        _LOADED[place] = files, rows
    return rows


def beside(rows: DataFrame, regions: DataFrame, *on: str) -> DataFrame:
    """rows with their regions, joined on the columns named and, if both have it, on the template.

    Few keys take most rows (page 1, a usual name), so rows are not shuffled by
    them: up to FEW_REGIONS regions are broadcast; of more, each is dealt to SALTS parts of its key.
    """
    keys = [*on, *(["template_id"] if "template_id" in rows.columns and "template_id" in regions.columns and "template_id" not in on else [])]
    own = regions.drop(*(c for c in rows.columns if c in regions.columns and c not in keys))
    if own.limit(FEW_REGIONS + 1).count() <= FEW_REGIONS:
        return rows.join(F.broadcast(own), keys)
    plain = [c for c, kind in rows.dtypes if kind in ("string", "int", "bigint", "double", "boolean", "date", "timestamp")]
    salt = F.pmod(F.xxhash64(F.lit("salt"), *plain), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")


def fields(region: Column, *numbers: str) -> tuple[Column, Column]:
    """A region's fields, and numbers if asked, as a struct, and the names of all that it gives: each from one
    pass over its VARIANT, as a look at every path in turn takes many times as long."""
    kinds = ", ".join([f"{name}: {kind}" for name, (kind, _) in DEFAULTS.items()] + [f"{name}: double" for name in numbers])
    return F.try_variant_get(region, "$", f"struct<{kinds}>"), F.map_keys(F.try_variant_get(region, "$", "map<string, variant>"))


def field(name: str, got: Column, given: Column, page: Column | None = None) -> Column:
    """A field of what fields() gave, or its default if the region has no such key."""
    kind, default = DEFAULTS[name]
    missing = F.coalesce(F.lit(1) if page is None else page, F.lit(1)) if name == "page" else F.lit(default).cast(kind)
    return F.when(F.array_contains(given, name), got[name]).otherwise(missing).alias(name)


def rois(templates: DataFrame) -> DataFrame:
    """One row for each region of (template_path, json): a flat ``rois`` list
    comes first, else the fields of ``pages``, which inherit the page number."""
    raw = templates.select("template_path", F.parse_json("json").alias("_raw"), F.regexp_extract("template_path", STEM, 1).alias("_stem"))
    part = lambda v, path, kind: F.try_variant_get(v, path, kind)
    placed = lambda block, pos, page, roi: F.struct(F.struct(block.alias("page"), pos.alias("pos")).alias("order"), page.alias("page"), roi.alias("roi"))
    flat = F.transform(part("_raw", "$.rois", "array<variant>"), lambda r, i: placed(F.lit(0), i, F.lit(None).cast("int"), r))
    paged = F.transform(part("_raw", "$.pages", "array<variant>"), lambda p, b: F.transform(part(p, "$.fields", "array<variant>"), lambda r, i: placed(b, i, F.coalesce(part(p, "$.page_number", "int"), F.lit(1)), r)))
    # one list, made where it is exploded: a filter on a list would parse each file again
    lists = F.coalesce(flat, F.flatten(F.filter(paged, lambda rows: rows.isNotNull())))
    rows = raw.select("*", F.explode(lists).alias("_r")).select("template_path", "_stem", "_raw", F.col("_r.order").alias("_order"), F.col("_r.page").alias("_page"), F.col("_r.roi").alias("_roi"))
    got, given = fields(F.col("_roi"))
    rows = rows.withColumns({"_got": got, "_given": given})
    named = lambda key, default: F.coalesce(F.try_variant_get("_raw", f"$.{key}", "string"), default).alias(key)
    return rows.select("template_path", named("template_id", F.col("_stem")), named("display_name", F.col("_stem")), named("document_type", F.lit("kyc")), F.col("_order").alias("position"), *(field(n, F.col("_got"), F.col("_given"), F.col("_page")) for n in DEFAULTS))


def page_counts(templates: DataFrame) -> DataFrame:
    """page_count of each template: as stated, else its last page, else 1."""
    stated = templates.select("template_path", F.try_variant_get(F.parse_json("json"), "$.page_count", "int").alias("_stated"))
    last = rois(templates).groupBy("template_path").agg(F.max("page").alias("_last"))
    return stated.join(last, "template_path", "left").select("template_path", F.coalesce("_stated", "_last", F.lit(1)).alias("page_count"))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """bank and its sorted template files: root/bank/*.json but version.json;
    no rows where there are none, or no root."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/*.json").select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "bank string, templates array<string>")
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1).alias("bank")
    return files.where(~F.col("path").rlike(r"/version\.json$")).groupBy(name).agg(F.sort_array(F.collect_list("path")).alias("templates"))


def usable(rows: DataFrame) -> DataFrame:
    """Calibrated regions, and option groups in any case."""
    return rows.where("calibrated OR field_type = 'CHECKBOX_GROUP'")


def first_named(rows: DataFrame) -> DataFrame:
    """Of regions of one name in a template, the first."""
    return rows.withColumn("_n", F.expr("row_number() OVER (PARTITION BY template_id, roi_name ORDER BY position)")).where("_n = 1").drop("_n")


def add(rows: DataFrame, new: DataFrame) -> DataFrame:
    """New regions; one whose name is taken, by a region or a new one before it, gets a random suffix, one of an
    unknown type is an error."""
    taken = rows.select("template_id", "roi_name").distinct().withColumn("_taken", F.lit(True))
    known = F.when(F.col("field_type").isin(*FIELD_TYPES), F.col("field_type")).otherwise(F.raise_error(F.concat(F.lit("unknown field type "), F.col("field_type"))))
    suffix = F.concat(F.col("roi_name"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
    order = "position" if "position" in new.columns else "roi_name"
    again = F.expr(f"row_number() OVER (PARTITION BY template_id, roi_name ORDER BY {order})") > 1
    named = new.withColumn("field_type", known).withColumn("_again", again).join(taken, ["template_id", "roi_name"], "left")
    named = named.withColumn("roi_name", F.when(F.coalesce("_taken", "_again"), suffix).otherwise(F.col("roi_name"))).drop("_taken", "_again")
    return rows.unionByName(named, allowMissingColumns=True)


def apart(rows: DataFrame, *template_ids: str) -> tuple[DataFrame, DataFrame]:
    """The regions of some templates, kept (persisted), and all others.

    Each single edit looks its region up first.  Edits of the few kept rows don't read all templates anew for that."""
    own = F.coalesce(F.col("template_id").isin(*template_ids), F.lit(False))
    return rows.where(own).persist(), rows.where(~own)


def _place(rows: DataFrame, roi_name: str, template_id: str | None) -> Column:
    """Whether a row is the region of that name, the first of a template.

    A missing one is a KeyError; without a template_id just one template may
    have the name.
    """
    named = rows.where(F.col("roi_name") == roi_name)
    named = named if template_id is None else named.where(F.col("template_id") == template_id)
    found = named.groupBy("template_id").agg(F.min("position").alias("position")).limit(2).collect()
    if not found:
        raise KeyError(f"no region named {roi_name}" + ("" if template_id is None else f" in template {template_id}"))
    if len(found) > 1:
        raise ValueError(f"several templates have a region named {roi_name}")
    at = found[0]["position"]
    place = F.lit(None) if at is None else F.struct(F.lit(at["page"]).alias("page"), F.lit(at["pos"]).alias("pos"))
    return (F.col("roi_name") == roi_name) & (F.col("template_id") == found[0]["template_id"]) & F.col("position").eqNullSafe(place.cast(rows.schema["position"].dataType))


def _set(rows: DataFrame, place: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({k: F.when(place, v.cast(DEFAULTS[k][0])).otherwise(F.col(k)) for k, v in values.items()})


def edit(rows: DataFrame, roi_name: str, template_id: str | None = None, **fields) -> DataFrame:
    """Set known fields of a region; others are ignored."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    return _set(rows, _place(rows, roi_name, template_id), {k: value(v) for k, v in fields.items() if k in DEFAULTS})


def update_box(rows: DataFrame, roi_name: str, box: list[float], template_id: str | None = None) -> DataFrame:
    """A box that someone has placed; it calibrates the region."""
    return edit(rows, roi_name, template_id, box=box, calibrated=True)


def move(rows: DataFrame, roi_name: str, dx: float, dy: float, template_id: str | None = None) -> DataFrame:
    return _set(rows, _place(rows, roi_name, template_id), {"box": geometry.move(F.col("box"), F.lit(dx), F.lit(dy))})


def resize(rows: DataFrame, roi_name: str, width: float, height: float, template_id: str | None = None) -> DataFrame:
    return _set(rows, _place(rows, roi_name, template_id), {"box": geometry.resize(F.col("box"), F.lit(width), F.lit(height))})


def _taken(rows: DataFrame, place: Column, name: str) -> bool:
    """Whether another region of the template of a place has the name."""
    template = rows.where(place).select("template_id").distinct()
    return not rows.where((F.col("roi_name") == name) & ~place).join(template, "template_id", "left_semi").isEmpty()


def rename(rows: DataFrame, old: str, new: str, template_id: str | None = None) -> DataFrame:
    place = _place(rows, old, template_id)
    if new != old and _taken(rows, place, new):
        raise ValueError(f"a region named {new} exists")
    return _set(rows, place, {"roi_name": F.lit(new)})


def delete(rows: DataFrame, roi_name: str, template_id: str | None = None) -> DataFrame:
    """Without the regions of that name, if there are any; without a template_id just one template may have it."""
    gone = F.col("roi_name") == roi_name
    if template_id is not None:
        return rows.where(~(gone & (F.col("template_id") == template_id)))
    if rows.where(gone).select("template_id").distinct().limit(2).count() > 1:
        raise ValueError(f"several templates have a region named {roi_name}")
    return rows.where(~gone)


def duplicate(rows: DataFrame, roi_name: str, new: str | None = None, template_id: str | None = None) -> DataFrame:
    """A copy at the end; a name that is taken gets a random suffix."""
    place, name = _place(rows, roi_name, template_id), new or f"{roi_name}_copy"
    if not rows.where((F.col("roi_name") == name)).join(rows.where(place).select("template_id"), "template_id", "left_semi").isEmpty():
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return rows.unionByName(rows.where(place).withColumn("roi_name", F.lit(name)))


def packed(rows: DataFrame) -> DataFrame:
    """template_id, display_name, document_type and rois, its regions in order."""
    region = F.struct("position", F.struct(*DEFAULTS).alias("roi"))
    return rows.groupBy("template_id", "display_name", "document_type").agg(F.transform(F.sort_array(F.collect_list(region)), lambda r: r["roi"]).alias("rois"))


def written(whole: DataFrame, rest: Column) -> DataFrame:
    """template_id and the JSON of packed() rows, after the other keys: a map of VARIANT."""
    value = lambda c: F.expr(f"to_variant_object({c})") if c == "rois" else F.expr(f"CAST({c} AS VARIANT)")
    every = F.map_concat(rest, F.create_map(*(x for c in OWN for x in (F.lit(c), value(c)))))
    return whole.select("template_id", F.to_json(every, {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def to_json(rows: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """template_id and its JSON, always in the flat layout, ready for write.text.

    With the templates (template_path, json) that the rows came from, their
    other keys are kept, and so are templates that have no region left.
    """
    if templates is None:
        return packed(rows).select("template_id", F.to_json(F.struct(*OWN), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    raw = templates.withColumn("_raw", F.parse_json("json")).withColumn("_stem", F.regexp_extract("template_path", STEM, 1))
    named = lambda key, default: F.coalesce(F.try_variant_get("_raw", f"$.{key}", "string"), default)
    raw = raw.select(named("template_id", F.col("_stem")).alias("template_id"), named("display_name", F.col("_stem")).alias("_name"), named("document_type", F.lit("kyc")).alias("_kind"), F.try_variant_get("_raw", "$", "map<string, variant>").alias("_raw"))
    # a plan knows how large the files are, not the regions made of them, and would broadcast all of these
    own = packed(rows).hint("merge")
    whole = raw.join(own, "template_id", "left").withColumns({"display_name": F.coalesce("display_name", "_name"), "document_type": F.coalesce("document_type", "_kind"), "rois": F.coalesce("rois", F.array().cast(own.schema["rois"].dataType))})
    return written(whole, F.map_filter("_raw", lambda k, _: ~k.isin("pages", *OWN)))
