"""Personal data by boosted trees over overlapping candidate spans.

Base spans are the leftmost matches of four patterns that pass their checks;
they always stay.  High-recall generators then propose further, overlapping
spans of all kinds; boosted trees rate each one by its format and its context,
and thresholds, calibrated for each kind on examples held back from the trees,
select the spans that are added.  Where some overlap the best-rated stay, then,
of those that overlap none of these, the best-rated again.  Everything on the main path is built of
SQL functions.

Offsets count code points, ends are exclusive.  Defined cases: null and empty
texts have no spans (the digest is that of the empty string); repeated rows
each get a row.  The patterns' repeated groups are possessive, so that very
long runs of digits or labels neither recurse nor backtrack.
"""

from __future__ import annotations

import math
import random
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: kind -> (what a text must have, pattern, test of a match m)
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"forall(split(m, '\\.'), d -> coalesce(try_cast(d AS decimal(38,0)) <= 255, length(ltrim('0', d)) <= 3))"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "length(translate(m, ' -', '')) BETWEEN 13 AND 19 AND luhn_check(translate(m, ' -', ''))"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "length(translate(m, '+ ().-', '')) BETWEEN 9 AND 15"),
}
#: Generators of further candidates; they may overlap one another.
PROPOSED = (
    ("email", r"(?i)\b(?:at|dot)\b", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[({<]\s?at\s?[\])}>]\s?[A-Za-z0-9-]++(?:\s?(?:[\[({<]\s?dot\s?[\])}>]|\.)\s?[A-Za-z0-9-]{2,}+)++(?![A-Za-z0-9-])"),
    ("email", r"(?i) at [A-Za-z0-9-]++ dot ", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{2,}+)++(?![A-Za-z0-9-])"),
    ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?@\x20?[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]{2,}+)++(?![A-Za-z0-9-])"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("ip", r"[0-9] ?[\[(]\.[\])] ?[0-9]", r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]\.[\])] ?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"[0-9]{13}", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"[0-9]{4}[\x20.-][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])"),
    ("card", r"[0-9]{4}[\x20.-][0-9]{6}", r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}(?![0-9])"),
    ("phone", r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])"),
    ("phone", r"00[0-9]", r"(?<![0-9])00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,4}){3,5}(?![0-9])"),
)
#: Format and context features of a candidate c: booleans over its kind, text m,
#: the characters before and after it, and its digits d.
FEATURES = (
    "c.kind = 'email'", "c.kind = 'ip'", "c.kind = 'card'", "c.kind = 'phone'",
    "luhn_check(c.d)", "length(c.d) BETWEEN 13 AND 19", "length(c.d) BETWEEN 9 AND 15",
    "substring(c.m, 1, 1) = '+'", "contains(c.m, '(')", r"c.m rlike '[\\x20.-][0-9]{3}[\\x20.-]?[0-9]{4}$'",
    r"forall(regexp_extract_all(c.m, '[0-9]+', 0), x -> length(x) <= 3 AND int(x) <= 255)",
    r"c.m rlike '(?i)(com|org|net|edu|gov|io|de|fr|es|info|eu)$'", r"c.m rlike '(?i)[\\[({<] ?(at|\\.) ?[\\])}>]'",
    r"c.before rlike '[A-Za-z0-9_.#$/=-]$'", r"c.after rlike '^[A-Za-z_=/]|^[.-][0-9]'",
    r"c.before rlike '(?i)(tel|phone|call|fax|mobile|card|visa|pay|mail|contact|host|server|addr|ip)[^A-Za-z]{0,3}$'",
    r"c.before rlike '(?i)(\\bv|ver|version|release|isbn|order|invoice|serial|sku|part|no|nr|section|build)[^A-Za-z]{0,3}$'",
    r"substring(c.d, 1, 1) in ('3', '4', '5', '6')",
)
ROUNDS, RATE = 40, 0.3
_BLOCK = 256


def located(text: str, guard: str, pattern: str) -> str:
    """SQL: array of (start, end, m) of a pattern's matches in a text column.

    Matches and the gaps between them come from the same scan; their lengths
    are added up in blocks, so the time is near linear in the matches.
    """
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = f"zip_with(slice(split({text}, {quote(pattern)}, -1), 1, size(found)), found, (g, m) -> named_struct('g', length(g), 'n', length(m), 'm', m))"
    sums = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> aggregate(slice(z, b * {_BLOCK} + 1, {_BLOCK}), 0, (s, x) -> s + x.g + x.n))"
    offsets = "aggregate(sums, named_struct('at', 0, 'l', CAST(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x, 'l', concat(a.l, array(a.at)))).l"
    start = "named_struct('at', offs[b], 'l', CAST(array() AS array<struct<start: int, end: int, m: string>>))"
    step = "named_struct('at', a.at + x.g + x.n, 'l', concat(a.l, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + x.n, 'm', x.m))))"
    spans = f"flatten(transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> aggregate(slice(z, b * {_BLOCK} + 1, {_BLOCK}), {start}, (a, x) -> {step}).l))"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    body = let("z", pairs, let("sums", sums, let("offs", offsets, spans)))
    none = "CAST(array() AS array<struct<start: int, end: int, m: string>>)"
    return f"if({text} rlike {quote(guard)}, {let('found', f'regexp_extract_all({text}, {quote(pattern)}, 0)', f'if(size(found) = 0, {none}, {body})')}, {none})"


def near(spans: str, others: str, keep: str) -> str:
    """SQL: the spans c, sorted by start, for which ``keep`` holds of near, those
    of the others that overlap their block of _BLOCK spans.

    So a span is compared with its neighbourhood only, however many there are.
    """
    block = f"slice({spans}, b * {_BLOCK} + 1, {_BLOCK})"
    ends = "named_struct('from', part[0].start, 'to', array_max(part.end))"  # computed once for a block
    chosen = f"transform(transform(array({ends}), r -> filter({others}, o -> o.start < r.to AND r.from < o.end)), near -> filter(part, c -> {keep}))[0]"
    return f"if(size({spans}) = 0, {spans}, flatten(transform(sequence(0, (size({spans}) - 1) div {_BLOCK}), b -> transform(array({block}), part -> {chosen})[0])))"


#: SQL: the text in pieces of _PIECE characters, so that a part of it is found without counting from its beginning.
_PIECE = 4096
CUT = f"transform(sequence(0, length(text) div {_PIECE}), i -> substring(text, i * {_PIECE} + 1, {_PIECE}))"


def piece(start: str, end: str) -> str:
    """SQL: characters start to end (or the text's end) of _cut, the text in pieces."""
    i, j = f"(({start}) div {_PIECE})", f"least(({end}) div {_PIECE}, size(_cut) - 1)"
    head, tail = f"substring(_cut[{i}], ({start}) - {i} * {_PIECE} + 1", f"substring(_cut[{j}], 1, ({end}) - ({j}) * {_PIECE})"
    return f"if({i} = {j}, {head}, ({end}) - ({start})), concat({head}), array_join(slice(_cut, CAST({i} + 2 AS INT), CAST(greatest(0, {j} - {i} - 1) AS INT)), ''), {tail}))"


def sealed(docs: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row, so that Catalyst does not
    move a scan of the text into the lambda that reads its result."""
    return docs.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds base: array of (kind, start, end), by kind as listed, then start."""
    docs = sealed(docs.withColumns({f"_{kind}": F.expr(located("text", guard, pattern)) for kind, (guard, pattern, _) in BASE.items()}))
    for kind, (_, _, test) in BASE.items():
        docs = docs.withColumn(f"_{kind}", F.expr(f"transform(filter(transform(_{kind}, s -> named_struct('s', s, 'ok', transform(array(s.m), m -> {test})[0])), s -> s.ok), s -> named_struct('kind', '{kind}', 'start', s.s.start, 'end', s.s.end))"))
    return sealed(docs.withColumn("base", F.concat(*(f"_{k}" for k in KINDS))).drop(*(f"_{k}" for k in KINDS)))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds proposed: the candidates that overlap no base span, with features f0, f1, ..."""
    found = []
    for i, (kind, guard, pattern) in enumerate(PROPOSED):
        docs = docs.withColumn(f"_p{i}", F.expr(located("text", guard, pattern)))
        found.append(f"transform(_p{i}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{kind}', 'm', s.m))")
    docs = sealed(docs.withColumn("_all", F.expr(f"array_sort(concat({', '.join(found)}))")).drop(*(f"_p{i}" for i in range(len(PROPOSED)))))
    docs = sealed(docs.withColumn("_all", F.expr("filter(_all, (c, i) -> i = 0 OR c <> _all[i - 1])")))
    docs = sealed(docs.withColumn("_all", F.expr(near("_all", "base", "NOT exists(near, o -> o.start < c.end AND c.start < o.end)"))))
    docs = sealed(docs.withColumn("_cut", F.expr(f"if(size(_all) = 0, CAST(array() AS array<string>), {CUT})")))
    around = f"named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'm', c.m, 'd', regexp_replace(c.m, '[^0-9]', ''), 'before', {piece('greatest(0, c.start - 16)', 'c.start')}, 'after', {piece('c.end', 'c.end + 3')})"
    named = ", ".join(f"'f{i}', coalesce({x}, false)" for i, x in enumerate(FEATURES))
    rated = f"transform(transform(_all, c -> {around}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, {named}))"
    return sealed(docs.withColumn("proposed", F.expr(rated)).drop("_all", "_cut"))


def examples(seed: int = 17, each: int = 60) -> list[tuple[str, str, int]]:
    """Labelled examples by rule: (text, kind, label), one candidate's worth each."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card(n: int, valid: bool = True) -> str:
        head = rng.choice("3456") + digits(n - 2)
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(head))))
        return head + str((-total + (0 if valid else rng.randint(1, 9))) % 10)

    rows = []
    for _ in range(each):
        a, b, c, d = (rng.randint(1, 255) for _ in range(4))
        lead, tail = rng.choice(["", f"{word()} ", f"{word()} {word()}, "]), rng.choice(["", ".", f" {word()}", f", {word()}"])
        key = rng.choice(["", "", "tel: ", "call ", "card ", "mail: "])
        phone = rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}"])
        number = card(rng.choice([15, 16, 16, 16]))
        grouped = " ".join(number[i : i + 4] for i in range(0, 16, 4))
        rows += [
            (f"{lead}{key}{phone}{tail}", "phone", 1), (f"{lead}{key}{phone} {number}{tail}", "phone", 1), (f"{lead}{phone} {number}{tail}", "card", 1),
            (f"{lead}{key}{number} {digits(8)}{tail}", "card", 1), (f"{lead}{grouped} {digits(4)}{tail}" if len(number) == 16 else f"{lead}{number}{tail}", "card", 1),
            (f"{lead}{word()} (at) {word()} (dot) com{tail}", "email", 1), (f"{lead}{word()}[at]{word()}.org{tail}", "email", 1), (f"{lead}{word()} at {word()} dot com{tail}", "email", 1), (f"{lead}{word()} @ {word()}.net{tail}", "email", 1),
            (f"{lead}{a}[.]{b}[.]{c}[.]{d}{tail}", "ip", 1), (f"{lead}host {a}.{b}.{c}.{d}{tail}", "ip", 1), (f"{lead}{a}.{b}.{c}.{d}{tail}", "ip", 1),
            (f"{lead}{card(16, False)}{tail}", "card", 0), (f"{lead}order {card(16, False)}{tail}", "card", 0), (f"{lead}isbn {digits(13)}{tail}", "card", 0), (f"{lead}id={number[:13]}x{digits(3)}{tail}", "card", 0),
            (f"{lead}{word()}-{digits(3)}-{digits(3)}-{digits(4)}{tail}", "phone", 0), (f"{lead}order {digits(3)}-{digits(3)}-{digits(4)}{tail}", "phone", 0), (f"{lead}part {digits(3)}.{digits(3)}.{digits(4)}x{tail}", "phone", 0),
            (f"{lead}version {rng.randint(1, 9)}.{b}.{c}.{d}{tail}", "ip", 0), (f"{lead}v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{d}{tail}", "ip", 0), (f"{lead}{a + 300}.{b}.{c}.{d}{tail}", "ip", 0), (f"{lead}section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}{tail}", "ip", 0),
            (f"{lead}{word()} at {word()} dot {word()}{tail}", "email", 0), (f"{lead}{word()} @ {word()} . {word()}{tail}", "email", 0),
        ]
    return rows


def boost(rows: list[tuple[tuple[bool, ...], int, int]]) -> list[tuple[int, int, int, tuple[float, float, float, float]]]:
    """Trees of depth two by logistic boosting over (features, label, count).

    A tree is (first feature, second where the first is false, second where it
    is true, values by the two answers).
    """
    n = len(rows[0][0])
    margin = [0.0] * len(rows)
    trees = []
    for _ in range(ROUNDS):
        slope = [(y - 1 / (1 + math.exp(-m))) * w for (_, y, w), m in zip(rows, margin, strict=True)]
        curve = [w * (p := 1 / (1 + math.exp(-m))) * (1 - p) for (_, _, w), m in zip(rows, margin, strict=True)]

        def split(members: list[int], slope: list[float] = slope, curve: list[float] = curve) -> tuple[float, int, tuple[float, float]]:
            best = (-1.0, 0, (0.0, 0.0))
            for f in range(n):
                g, h = [0.0, 0.0], [1.0, 1.0]
                for i in members:
                    g[rows[i][0][f]] += slope[i]
                    h[rows[i][0][f]] += curve[i]
                best = max(best, (g[0] ** 2 / h[0] + g[1] ** 2 / h[1], f, (RATE * g[0] / h[0], RATE * g[1] / h[1])))
            return best

        choice = []
        for f in range(n):
            low, high = split([i for i, r in enumerate(rows) if not r[0][f]]), split([i for i, r in enumerate(rows) if r[0][f]])
            choice.append((low[0] + high[0], -f, low, high))
        _, f, low, high = max(choice)
        tree = (-f, low[1], high[1], (*low[2], *high[2]))
        trees.append(tree)
        margin = [m + leaf(tree, r[0]) for m, r in zip(margin, rows, strict=True)]
    return trees


def leaf(tree: tuple, x: tuple[bool, ...]) -> float:
    first = bool(x[tree[0]])
    return tree[3][2 * first + bool(x[tree[2] if first else tree[1]])]


@cache
def trained(key: int = 0) -> tuple[list[tuple], dict[str, float]]:
    """The trees, learned once a process from the distinct feature vectors of
    half of the examples, and each kind's threshold, from the other half."""
    spark = SparkSession.getActiveSession()
    made = [(*row, held) for held, seed in ((0, 17), (1, 18)) for row in examples(seed)]
    rows = spark.createDataFrame(made, "text string, want string, label int, held int").withColumn("base", F.expr("CAST(array() AS array<struct<kind: string, start: int, end: int>>)"))
    shown = candidates(rows).select("want", "label", "held", F.explode("proposed").alias("c")).where("c.kind = want")
    names = [f"f{i}" for i in range(len(FEATURES))]
    seen = shown.select("label", "held", "c.*").groupBy(*names, "kind", "label", "held").count().collect()
    seen.sort(key=lambda r: tuple(r))
    trees = boost([(tuple(r[n] for n in names), r["label"], r["count"]) for r in seen if not r["held"]])
    seen = [r for r in seen if r["held"]]  # the cuts are those of examples that the trees have not met
    cuts = {}
    for kind in KINDS:
        rated = sorted((sum(leaf(t, tuple(r[n] for n in names)) for t in trees), r["label"], r["count"]) for r in seen if r["kind"] == kind)
        cost = lambda cut: sum(n * (2 if not y else 1) for m, y, n in rated if (m >= cut) != bool(y))  # noqa: B023, E731
        edges = sorted({m for m, _, _ in rated})
        cuts[kind] = min([(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)] or [0.0], key=lambda cut: (cost(cut), abs(cut)))
    return trees, cuts


def margin_sql(trees: list[tuple]) -> str:
    part = lambda f, lo, hi: f"if(c.f{f}, {hi:.6f}D, {lo:.6f}D)"
    return " + ".join(f"if(c.f{f}, {part(b, v[2], v[3])}, {part(a, v[0], v[1])})" for f, a, b, v in trees)


def detect(docs: DataFrame) -> DataFrame:
    """Adds base and spans, arrays of (kind, start, end), to doc rows with a text.

    Other columns stay; a text column that is null counts as empty.
    """
    trees, cuts = trained()
    docs = candidates(base_spans(docs.withColumn("text", F.coalesce("text", F.lit("")))))
    cut = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v:.6f}D" for k, v in cuts.items()) + " END"
    rated = f"filter(transform(proposed, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'v', {margin_sql(trees)} - {cut})), c -> c.v >= 0)"
    better = "o.start < c.end AND c.start < o.end AND (o.v > c.v OR o.v = c.v AND (o.end - o.start > c.end - c.start OR o.end - o.start = c.end - c.start AND (o.start < c.start OR o.start = c.start AND o.kind < c.kind)))"
    docs = docs.withColumn("_rated", F.expr(f"if(size(proposed) = 0, CAST(array() AS array<struct<kind: string, start: int, end: int, v: double>>), {rated})"))
    docs = sealed(docs.drop("proposed"))
    kept = near("_rated", "_rated", f"NOT exists(near, o -> {better})")
    docs = sealed(docs.withColumn("_best", F.expr(kept)))
    # one that only lost to a loser is free again; what is left then may be overlapped by a better one of its own
    free = near("_rated", "_best", "NOT exists(near, o -> o.start < c.end AND c.start < o.end)")
    docs = sealed(docs.withColumn("_free", F.expr(free)))
    docs = sealed(docs.withColumn("_more", F.expr(near("_free", "_free", f"NOT exists(near, o -> {better})"))))
    docs = sealed(docs.withColumn("_added", F.expr("transform(concat(_best, _more), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))")).drop("_best", "_free", "_more"))
    order = "array_position(array('email', 'ip', 'card', 'phone'), "
    return docs.withColumn("spans", F.expr(f"if(size(_added) = 0, base, transform(array_sort(transform(concat(base, _added), s -> named_struct('k', {order}s.kind), 'start', s.start, 'end', s.end, 'kind', s.kind))), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))")).drop("_rated", "_added")


def folded(spans: str) -> str:
    """SQL: sorted spans (start, less, kind) with those that overlap made one
    (start, end, kind), block by block, then over the blocks."""
    none = "CAST(array() AS array<struct<start: int, end: int, kind: string>>)"
    step = "if(size(a) > 0 AND a[size(a) - 1].end > s.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end), 'kind', a[size(a) - 1].kind))), concat(a, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind))))"
    block = f"aggregate(transform(slice({spans}, b * {_BLOCK} + 1, {_BLOCK}), s -> named_struct('start', s.start, 'end', -s.less, 'kind', s.kind)), {none}, (a, s) -> {step})"
    # spans of a kind that reach over a block's end are joined with the next block's first ones
    blocks = f"transform(sequence(0, (size({spans}) - 1) div {_BLOCK}), b -> {block})"
    return f"if(size({spans}) = 0, {none}, {joined_blocks(blocks)})"


def joined_blocks(blocks: str) -> str:
    """SQL: the blocks of made-one spans one after another, with those that overlap a block before joined to it."""
    reach = "aggregate(slice(bs, 1, i), -1, (m, p) -> greatest(m, array_max(p.end)))"
    inner = f"transform(bs, (x, i) -> transform(array({reach}), r -> named_struct('own', filter(x, s -> s.start >= r), 'late', filter(x, s -> s.start < r)))[0])"
    # a late span lengthens the last one before it; its block keeps the others
    longer = "aggregate(slice(ps, i + 2, size(ps)), o.end, (m, p) -> aggregate(p.late, m, (n, s) -> if(s.start < n, greatest(n, s.end), n)))"
    final = f"flatten(transform(ps, (p, i) -> transform(p.own, (o, k) -> if(k < size(p.own) - 1, o, named_struct('start', o.start, 'end', {longer}, 'kind', o.kind)))))"
    return f"transform(array({blocks}), bs -> transform(array({inner}), ps -> {final})[0])[0]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind, as ``<EMAIL>``.

    Where spans of different kinds overlap, the one that starts first (then
    the longer one) names the whole stretch.  Null texts stay null.
    """
    found = detect(docs.select(F.struct("*").alias("_doc"), "text"))
    # a span's stretch begins where it starts after the end of all before it; running ends come block by block
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'less', -s.end, 'kind', s.kind)))"
    found = sealed(found.withColumn("_s", F.expr(ordered)))
    found = sealed(found.withColumn("_m", F.expr(folded("_s"))).drop("_s"))
    found = sealed(found.withColumn("_cut", F.expr(f"if(size(_m) = 0, CAST(array() AS array<string>), {CUT})")))
    between = piece("if(i = 0, 0, _m[i - 1].end)", "s.start")
    pieces = f"concat(array_join(transform(_m, (s, i) -> concat({between}, '<', upper(s.kind), '>')), ''), {piece('_m[size(_m) - 1].end', 'length(text)')})"
    text = F.expr(f"CASE WHEN _doc.text IS NULL THEN NULL WHEN size(_m) = 0 THEN text ELSE {pieces} END")
    return found.select(*(text.alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns))


def spans_of(docs: DataFrame) -> DataFrame:
    """op4: counts and digest of the base spans, and all spans as a string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = sealed(detect(docs.select("doc_id", "text")))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
