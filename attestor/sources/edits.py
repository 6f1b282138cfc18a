"""Edits of many templates as a log of rows, folded over the regions.

A log has template_id, seq, op, roi_name, new_name and args (a JSON text):

| op | args |
|---|---|
| add | the fields of a region; field_type of the known ones |
| update_box | box |
| move, resize | dx, dy; width, height |
| rename, duplicate | none; new_name (of duplicate, null for a copy's usual name) |
| set_field | any fields; others are ignored |
| delete | none |

One shuffle brings a template's regions and edits together, and one native fold
applies the edits by seq.  An edit that can't be applied changes
nothing and is an error row.  A template's edits depend on one another, so one task has them all.

Defined cases: of regions of one name the first is edited, and all are deleted.  A name
that is taken gets a suffix of eight digits, from the template and seq, so that reruns
agree.  Edits of equal seq follow the order of op and the other columns.  A template
without regions can be added to; its path and display name are null then.  Null args
are empty ones; rows without a template_id or seq are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources import templates
from attestor.sources.templates import DEFAULTS, FIELD_TYPES

OPS = ("add", "update_box", "move", "resize", "rename", "set_field", "delete", "duplicate")
_TEMPLATE = ("template_path", "display_name", "document_type")
_NUMBERS = ("dx", "dy", "width", "height")
REGION = ", ".join(f"{name}: {kind}" for name, (kind, _) in DEFAULTS.items())


def _edits(log: DataFrame) -> DataFrame:
    """template_id and e, an edit as a struct: its fields with defaults, the names of those given, and its
    numbers, as far as its op takes them.  Its args are parsed once, and read in one pass for all fields."""
    takes = lambda ops, value: F.when(F.col("op").isin(*ops), value)
    parsed = takes(("add", "update_box", "set_field", "move", "resize"), F.try_parse_json(F.coalesce("args", F.lit("{}"))))
    rows = log.select("template_id", F.col("seq").cast("long").alias("seq"), "op", "roi_name", "new_name", parsed.alias("_args"))
    got, given = templates.fields(F.col("_args"), *_NUMBERS)
    rows = rows.select("*", got.alias("_got"), given.alias("_given"))
    patch = F.struct(*(templates.field(n, F.col("_got"), F.col("_given")) for n in DEFAULTS))
    numbers = (takes(("move", "resize"), F.coalesce(f"_got.{n}", F.lit(0.0))).alias(n) for n in _NUMBERS)
    edit = F.struct("seq", "op", "roi_name", "new_name", takes(("set_field",), F.col("_given")).alias("given"), *numbers, takes(("add", "update_box", "set_field"), patch).alias("patch"))
    return rows.select("template_id", edit.alias("e"))


def _fold() -> str:
    """SQL: the regions and errors after all edits of a template."""
    known = f"e.patch.field_type IN ({', '.join(repr(t) for t in FIELD_TYPES)})"
    error = f"""CASE
        WHEN e.op NOT IN ({', '.join(repr(o) for o in OPS)}) OR e.op IS NULL THEN concat('unknown edit ', coalesce(e.op, 'null'))
        WHEN e.op = 'add' AND NOT coalesce({known}, false) THEN concat('unknown field type ', coalesce(e.patch.field_type, 'null'))
        WHEN e.op NOT IN ('add', 'delete') AND v.at = 0 THEN concat('no region named ', coalesce(e.roi_name, 'null'))
        WHEN e.op = 'rename' AND e.new_name IS NULL THEN 'a new name is missing'
        WHEN e.op = 'rename' AND e.new_name <> e.roi_name AND array_contains(v.names, e.new_name) THEN concat('a region named ', e.new_name, ' exists') END"""
    free = lambda name: f"if(array_contains(w.v.names, {name}), concat({name}, '_', substring(md5(concat(template_id, ':', e.seq)), 1, 8)), {name})"

    def after(name: str) -> str:
        """A field of the edited region r."""
        own = f"WHEN e.op = 'set_field' AND array_contains(e.given, '{name}') THEN e.patch.{name}"
        if name == "box":
            own += """ WHEN e.op = 'update_box' THEN e.patch.box
                WHEN e.op = 'move' AND size(r.box) > 0 THEN array(r.box[0] + e.dx, r.box[1] + e.dy, r.box[2] + e.dx, r.box[3] + e.dy)
                WHEN e.op = 'resize' AND size(r.box) > 0 THEN array(r.box[0], r.box[1], r.box[0] + e.width, r.box[1] + e.height)"""
        if name == "calibrated":
            own += " WHEN e.op = 'update_box' THEN true"
        if name == "roi_name":
            own += " WHEN e.op = 'rename' THEN e.new_name"
        return f"'{name}', CASE {own} ELSE r.{name} END"

    renamed = lambda source, name: f"named_struct({', '.join(f"'{n}', {name if n == 'roi_name' else f'{source}.{n}'}" for n in DEFAULTS)})"
    regions = f"""CASE WHEN w.error IS NOT NULL THEN a.regions
        WHEN e.op = 'add' THEN concat(a.regions, array({renamed('e.patch', free("coalesce(e.roi_name, e.patch.roi_name)"))}))
        WHEN e.op = 'duplicate' THEN concat(a.regions, array({renamed('element_at(a.regions, w.v.at)', free("coalesce(e.new_name, concat(e.roi_name, '_copy'))"))}))
        WHEN e.op = 'delete' THEN filter(a.regions, r -> NOT (r.roi_name <=> e.roi_name))
        ELSE transform(a.regions, (r, i) -> if(i = w.v.at - 1, named_struct({', '.join(map(after, DEFAULTS))}), r)) END"""
    errors = "if(w.error IS NULL, a.errors, concat(a.errors, array(named_struct('seq', e.seq, 'op', e.op, 'roi_name', e.roi_name, 'error', w.error))))"
    names = "transform(a.regions, r -> r.roi_name)"
    looked = f"transform(array({names}), n -> named_struct('names', n, 'at', CAST(coalesce(array_position(n, e.roi_name), 0) AS INT)))"
    step = f"transform(transform({looked}, v -> named_struct('v', v, 'error', {error})), w -> named_struct('regions', {regions}, 'errors', {errors}))[0]"
    start = "named_struct('regions', regions, 'errors', CAST(array() AS array<struct<seq: bigint, op: string, roi_name: string, error: string>>))"
    return f"aggregate(edits, {start}, (a, e) -> {step})"


def apply(rows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions (rows of templates.rois()) after a log of edits, in their new
    order, and its errors: template_id, seq, op, roi_name, error."""
    region = F.struct("position", F.struct(*(F.col(n).cast(kind).alias(n) for n, (kind, _) in DEFAULTS.items())).alias("region"))
    own = rows.select("template_id", *_TEMPLATE, region.alias("r"))
    placed = F.col("template_id").isNotNull() & F.col("seq").isNotNull()
    both = own.unionByName(_edits(log.where(placed)), allowMissingColumns=True)
    joined = both.groupBy("template_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in _TEMPLATE), F.transform(F.array_sort(F.collect_list("r")), lambda r: r["region"]).alias("regions"), F.array_sort(F.collect_list("e")).alias("edits"))
    folded = joined.withColumn("after", F.expr(_fold())).select("template_id", *_TEMPLATE, "after.*")
    left = folded.select("template_id", *_TEMPLATE, F.posexplode("regions").alias("pos", "r")).select("template_path", "template_id", "display_name", "document_type", F.struct(F.lit(0).alias("page"), F.col("pos").alias("pos")).alias("position"), "r.*")
    lost = log.where(~placed).select(F.col("template_id"), F.col("seq").cast("long").alias("seq"), "op", "roi_name", F.lit("an edit needs a template and a place in its log").alias("error"))
    return left, folded.select("template_id", F.explode("errors").alias("e")).select("template_id", "e.*").unionByName(lost)
