"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are taken target / size times each: the whole part
always, the fraction as the probability of one more copy.  The fractions are
rounded dependently: where units meet, mass (in words) is moved at random from
one to the other until one of them is integral.

Units meet in a tree of nodes, about CHUNK documents to a leaf and BRANCHES
children to a node.  A document belongs to the lowest node of its branch that is SHARE
times as large.  From the root down, each document of a node, large ones
first, meets all that come after it and all below the node: it becomes integral,
and what it gains or loses they lose or gain, each in proportion.  So a
large document is made up for by many small ones, and of a leaf only the last unit, a small
one, stays fractional.  These meet in the levels of a reduction tree of
their own, until every source has one residual, which is drawn.  A source's
words miss their target by a part of that residual; only a document of at least 1/LARGE
of its source that nothing can make up for goes the nearer way instead.  Reruns
agree, as all draws are hashes.

All of it is DataFrame code.  Nodes hold a bounded number of rows whatever the
source holds, and nothing is collected but one number for each level.  The table of sources is broadcast if it
has at most FEW rows; beyond that it is dealt to SALTS parts.

Defined cases: null texts have size 0 and are taken 0 times; null sources are
one source, last in order.  Equal rows are counted once with their number and
taken alike; draws are hashes of ids and sizes, so ties need no order.  Very long
texts are only counted.  An empty table has no rows; columns other than doc_id,
source and text are ignored, whatever their names.  The table of sources (a row for each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents that are rounded together in one step, in expectation; children of a node.
CHUNK, BRANCHES = 256, 64
#: How many times as large as a document its node is; documents of so large a part of their source are rounded apart.
SHARE, LARGE = 16, 64
#: Rows of a table of sources that is broadcast; else, parts that a source is dealt to where its rows meet it.
FEW, SALTS = 1 << 16, 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size): shares of the total by weight,
    stopped at ``most`` times the size, the excess reshared.

    The weights repeat over the sources in order of code points, null last.
    The level of water is found at the first source, by the ratio of its stop
    to its weight, that the reshared level does not fill.
    """
    ordered = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1).cast("double")
    rows = ordered.withColumn("_weight", weight).withColumn("_stop", most * F.col("source_size")).withColumn("_ratio", F.col("_stop") / F.col("_weight"))
    everything, before = Window.partitionBy(), Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    shared = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / shared)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"]
    return rows.withColumn("target", F.least(F.col("_stop"), F.coalesce(level, F.lit(float("inf"))) * F.col("_weight"))).select("source", "source_size", "target")


def _draw(*keys: str) -> str:
    return f"(pmod(xxhash64({', '.join(keys)}), 9007199254740992L) / 9007199254740992D)"


def meet(level: int) -> str:
    """One chunk's units, rounded one after another (a SQL expression).

    The accumulator holds the unit that is still fractional with its mass p,
    and the units that are done with their extra copy.  Where a and u meet,
    words go from u to a or from a to u until one of the two is integral; the
    odds keep either's expected mass, and the sum of words stays as it is.
    """
    integral = lambda p, size: f"({p} < 1e-9 OR {p} > 1 - 1e-9 OR {size} = 0)"
    after = lambda done, p, unit, q: f"named_struct('unit', {unit}, 'p', {q}, 'done', concat(a.done, array(named_struct('unit', {done}, 'extra', CAST(round({p}) AS INT)))))"
    moved = (
        "transform(transform(array(named_struct('up', least((1 - a.p) * a.unit.size * a.unit.rows, u.p * u.size * u.rows), 'down', least(a.p * a.unit.size * a.unit.rows, (1 - u.p) * u.size * u.rows), "
        f"'h', {_draw('a.unit.doc_id', 'a.unit.size', 'u.doc_id', 'u.size', str(level))})), "
        "m -> if(m.h * (m.up + m.down) < m.down, named_struct('a', a.p + m.up / (a.unit.size * a.unit.rows), 'u', u.p - m.up / (u.size * u.rows)), named_struct('a', a.p - m.down / (a.unit.size * a.unit.rows), 'u', u.p + m.down / (u.size * u.rows)))), "
        f"m -> if({integral('m.a', 'a.unit.size')}, {after('a.unit', 'm.a', 'u', 'm.u')}, {after('u', 'm.u', 'a.unit', 'm.a')}))[0]"
    )
    step = f"CASE WHEN {integral('a.p', 'a.unit.size')} THEN {after('a.unit', 'a.p', 'u', 'u.p')} WHEN {integral('u.p', 'u.size')} THEN {after('u', 'u.p', 'a.unit', 'a.p')} ELSE {moved} END"
    start = "named_struct('unit', units[0], 'p', units[0].p, 'done', CAST(array() AS array<struct<unit: struct<size: bigint, doc_id: bigint, rows: bigint, p: double>, extra: int>>))"
    return f"aggregate(slice(units, 2, size(units)), {start}, (a, u) -> {step})"


def settle() -> str:
    """A node's units, largest first, rounded against all that comes after them (a SQL expression).

    Of a node with units (weight, size, doc_id, rows), mass and total (the words
    of its units and of all below).  The accumulator holds the mass m and the
    words left, the copies out so far, and, once a unit holds the only
    fraction (at, f), what all others take (fixed).  A unit of weight s meets what is left with mass m:
    both can take either end; or only one end leaves the other between its own, and the unit keeps a
    fraction with the odds that keep its expected mass.
    """
    rest, p = "(a.left - u.weight)", "(a.m / a.left)"
    drawn = _draw("u.doc_id", "u.size", "u.rows", "-2")
    made = lambda x, fixed="-1", f="0D": f"named_struct('x', {x}, 'fixed', {fixed}, 'f', {f})"
    part = lambda m: f"greatest(0D, least(1D, {m} / v.s))"
    choice = f"""CASE
        WHEN a.fixed >= 0 THEN {made("a.fixed", "a.fixed", "a.f")}
        WHEN v.m >= v.s AND v.m <= v.rest THEN {made("CAST(v.h < v.p AS INT)")}
        WHEN v.s * {LARGE} >= source_size THEN {made("CAST(v.s - v.m < v.m - v.rest AS INT)")}
        WHEN v.rest < 0.5 THEN {made("0", "0", part("v.m"))}
        WHEN v.m < v.s AND v.m <= v.rest THEN if(v.h * v.m < v.s * v.p, {made("0", "0", part("v.m"))}, {made("0")})
        WHEN v.m >= v.s THEN if(v.h * (v.s - v.m + v.rest) < (1 - v.p) * v.s, {made("0", "1", part("(v.m - v.rest)"))}, {made("1")})
        ELSE if(v.h * v.rest < v.p * v.s - v.m + v.rest, {made("0", "0", part("v.m"))}, {made("0", "1", part("(v.m - v.rest)"))}) END"""
    known = f"named_struct('s', u.weight, 'rest', {rest}, 'm', a.m, 'p', {p}, 'h', {drawn})"
    # where the unit becomes the one with the fraction, the others' mass is all or none of their words
    after = (
        "named_struct('i', a.i + 1, 'left', w.v.rest, 'fixed', w.c.fixed, 'f', w.c.f, 'at', if(a.fixed < 0 AND w.c.fixed >= 0, a.i, a.at), 'out', concat(a.out, array(w.c.x)), "
        "'m', CASE WHEN w.c.fixed = 0 THEN 0D WHEN w.c.fixed = 1 THEN w.v.rest ELSE greatest(0D, least(w.v.rest, a.m - w.c.x * w.v.s)) END)"
    )
    step = f"transform(transform(array({known}), v -> named_struct('v', v, 'c', {choice})), w -> {after})[0]"
    start = "named_struct('i', 0, 'left', CAST(total AS DOUBLE), 'fixed', -1, 'f', 0D, 'at', -1, 'out', CAST(array() AS array<int>), 'm', CAST(mass AS DOUBLE))"
    return f"aggregate(units, {start}, (a, u) -> {step})"


def _beside(rows: DataFrame, few: DataFrame, by: str) -> DataFrame:
    """rows with their source's row of few, joined by _key: broadcast if it is small, else by SALTS parts of
    each source, so that no task holds a source that has most of the rows."""
    if few.count() <= FEW:
        return rows.join(F.broadcast(few), "_key")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"]).drop("_salt")


def _placed(keyed: DataFrame, plan: DataFrame, chunk: int) -> DataFrame:
    """Every unit with its weight in words, its leaf, the level of its node, and that of its source's root."""
    bits = BRANCHES.bit_length() - 1
    rows = _beside(keyed, plan, "doc_id").withColumn("weight", (F.col("size") * F.col("rows")).cast("double"))
    leaves = F.ceil(F.col("_n") / chunk)
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size", F.lit(0)), leaves)).withColumn("root", F.ceil(F.log2(leaves.cast("double")) / bits).cast("int"))
    ratio = F.try_divide(F.col("weight") * SHARE * leaves, F.col("source_size"))
    return rows.withColumn("level", F.greatest(F.lit(0), F.least(F.col("root"), F.coalesce(F.ceil(F.log2(ratio) / bits).cast("int"), F.lit(0)))))


def _settled(placed: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of every level of nodes, the units that are done with their extra copies, and the units with a fraction."""
    about, bits = ["_key", "source", "source_size", "target", "whole"], BRANCHES.bit_length() - 1
    unit = F.struct("weight", "size", "doc_id", "rows")
    words = placed.where("weight > 0").groupBy(*about, "p", "root", "leaf", "level").agg(F.sum("weight").alias("words")).checkpoint()
    top = words.agg(F.max("root")).first()[0] or 0
    done, rest, parents = [], [], None
    for level in range(top, -1, -1):
        node = F.shiftright("leaf", level * bits).alias("node")
        nodes = words.where((F.col("level") <= level) & (F.col("root") >= level)).groupBy(*about, "p", "root", node).agg(F.sum("words").alias("total"), F.sum(F.when(F.col("level") < level, F.col("words")).otherwise(0.0)).alias("below"))
        mass = F.when(F.col("root") == level, F.col("p") * F.col("total"))
        if parents is None:
            nodes = nodes.withColumn("mass", mass)
        else:
            nodes = nodes.withColumn("parent", F.shiftright("node", bits)).join(parents, ["_key", "parent"], "left").withColumn("mass", F.coalesce(mass, F.try_divide(F.col("_m") * F.col("total"), F.col("_below")), F.lit(0.0)))
        units = placed.where((F.col("level") == level) & (F.col("weight") > 0)).groupBy("_key", node).agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
        folded = nodes.join(units, ["_key", "node"], "left").withColumn("units", F.coalesce("units", F.array().cast(units.schema["units"].dataType))).withColumn("fold", F.expr(settle())).checkpoint()
        every = folded.select(*about, "fold", F.posexplode("units").alias("_i", "unit"))
        done.append(every.where("_i <> fold.at").select(*about, "unit", F.element_at("fold.out", F.col("_i") + 1).alias("extra")))
        rest.append(every.where("_i = fold.at").select(*about, F.struct("unit.size", "unit.doc_id", "unit.rows", F.col("fold.f").alias("p")).alias("unit")))
        parents = folded.select("_key", F.col("node").alias("parent"), F.col("fold.m").alias("_m"), F.col("below").alias("_below"))
    nothing = placed.where("weight <= 0").select(*about, unit.alias("unit"), F.lit(0).alias("extra"))
    return [d.select(*about, F.struct("unit.size", "unit.doc_id", "unit.rows", F.lit(0.0).alias("p")).alias("unit"), "extra") for d in (*done, nothing)], rest


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def take(docs: DataFrame, chunk: int = CHUNK, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).checkpoint()
    # a source's key stays apart from null; repeated rows weigh as often as they are there
    keyed = units.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = keyed.groupBy("_key", "source").agg(F.count("*").alias("_n"), F.sum(F.col("size") * F.col("rows")).alias("source_size")).checkpoint()
    goals = targets(sources.select("source", "source_size"), weights, most)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), "target")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = sources.select("_key", "_n", "source_size").join(goals, "_key").withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    done, left = _settled(_placed(keyed, plan.checkpoint(), chunk).checkpoint())
    about = ["_key", "source", "source_size", "target", "whole"]
    rest, level = _union(left).checkpoint(), 0
    while True:
        counts = rest.groupBy("_key").agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= 1:
            last = F.expr(_draw("unit.doc_id", "unit.size", "-1")) < F.col("unit.p")
            done.append(rest.select(*about, "unit", last.cast("int").alias("extra")))
            break
        level += 1
        waiting = _beside(rest, counts, "unit.doc_id").withColumn("_chunk", F.pmod(F.xxhash64(F.col("unit.doc_id"), F.col("unit.size"), F.lit(level)), F.ceil(F.col("_n") / chunk)))
        # large units first: what is left over at the end is small
        folded = waiting.groupBy(*about, "_chunk").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units")).withColumn("fold", F.expr(meet(level))).select(*about, "fold").checkpoint()
        done.append(folded.select(*about, F.explode("fold.done").alias("_done")).select(*about, "_done.unit", "_done.extra"))
        rest = folded.select(*about, F.col("fold.unit").withField("p", F.col("fold.p")).alias("unit"))
    out = _union(done).select("unit.*", *about, (F.col("whole") + F.col("extra")).alias("copies")).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """op3: sizes, targets and what is taken of every document."""
    return take(docs).select("doc_id", "size", "source_size", "target", "taken")
