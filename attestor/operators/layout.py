"""Layout of form pages: lines of words, phrases, labels of marks, boxes.

words: page, block, line, word_no, x0, y0, x1, y1, text (and any key columns
named in ``keys``, such as a document).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.geometry import round_half_even
from attestor.sources import templates

BOX = {"x0": "least", "y0": "least", "x1": "greatest", "y1": "greatest"}
BAND = 6.0  # points; labels within one band of a mark's middle belong to it
#: Phrases of one automaton, whose size bounds what is broadcast.
PHRASES = 1 << 16
#: Characters of a gram of the index of labels.
GRAM = 8
#: Pairs that a label has at most if one task may have them all.
COMMON = 1 << 16


def lines(words: DataFrame, *keys: str) -> DataFrame:
    """Each line's words in order, as an array, and its text."""
    word = F.struct("word_no", "x0", "y0", "x1", "y1", "text")
    rows = words.groupBy(*keys, "page", "block", "line").agg(F.sort_array(F.collect_list(word)).alias("words"))  # array_sort would call a lambda for each comparison
    return rows.withColumn("text", F.array_join(F.col("words.text"), " "))


def _boxed(hits: DataFrame, phrase: Column, size: Column, *keys: str) -> DataFrame:
    """The boxes around the words that hits touch: lines with _at (from 0) and the size of what is found,
    numbered from 0 within a page and phrase (occurrence), and where the last of these words ends (end_x1), which is
    left of the box's side if a word before it reaches further."""
    # one pass over the words of a line: where each begins, and the box of those the hit touches
    # the hit's place goes along in the state: in the body its expression would be computed anew, with the whole line's text, for each word
    touched = "a.at < a.hit + a.size AND a.at + length(w.text) > a.hit"
    grown = ", ".join(f"'{c}', if({touched}, {f}(a.{c}, CAST(w.{c} AS DOUBLE)), a.{c})" for c, f in BOX.items())
    grown += f", 'end_x1', if({touched}, CAST(w.x1 AS DOUBLE), a.end_x1)"
    none = ", ".join(f"'{c}', CAST(NULL AS DOUBLE)" for c in (*BOX, "end_x1"))
    box = F.expr(f"aggregate(words, named_struct('at', 0, 'hit', _at, 'size', _size, {none}), (a, w) -> named_struct('at', a.at + length(w.text) + 1, 'hit', a.hit, 'size', a.size, {grown}))")
    rows = hits.withColumn("phrase", phrase).withColumn("_size", size).withColumn("_box", box).where("_box.x0 IS NOT NULL")
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "page", "phrase").orderBy("block", "line")) - 1)
    return rows.select(*keys, "page", "block", "line", "occurrence", "phrase", *(F.col(f"_box.{c}").alias(c) for c in (*BOX, "end_x1")))


def find_phrase(words: DataFrame, phrase: str, *keys: str) -> DataFrame:
    """The first hit in every line that has one, numbered from 0 within a page
    (occurrence), with the box around the words it touches."""
    hits = lines(words, *keys).withColumn("_at", F.instr(F.lower("text"), phrase.lower()) - 1).where("_at >= 0")
    return _boxed(hits, F.lit(phrase), F.lit(len(phrase)), *keys)


def find_phrases(words: DataFrame, phrases: DataFrame, *keys: str) -> DataFrame:
    """find_phrase for every phrase of a table (phrase), in one pass over the lines."""
    return phrases_in(lines(words, *keys), phrases, *keys)


def phrases_in(found_lines: DataFrame, phrases: DataFrame, *keys: str, most: int = PHRASES) -> DataFrame:
    """The boxes of the first hit of every phrase in every line (see lines()).

    An automaton of the phrases, in any case, reads each line's text once, and
    only the hits become rows.  Null and empty phrases are not found.  An automaton has ``most`` phrases
    at most; of a longer table there are several, each of which reads the lines.
    """
    named = phrases.select("phrase", F.lower("phrase").alias("lower")).where("phrase <> ''").distinct()
    parts = 1 + (named.count() - 1) // most
    dealt = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    out = None
    for part in range(max(1, parts)):
        own: dict[str, list[str]] = {}
        for row in dealt.where(F.col("part") == part).collect():
            own.setdefault(row["lower"], []).append(row["phrase"])
        hits = found_lines.withColumn("_hit", F.explode(_automaton(found_lines.sparkSession, own)(F.lower("text"))))
        hits = hits.withColumn("_at", F.col("_hit.at"))
        boxes = _boxed(hits, F.col("_hit.phrase"), F.length("_hit.phrase"), *keys)
        out = boxes if out is None else out.unionByName(boxes)
    return out


def _automaton(spark: SparkSession, phrases: dict[str, list[str]]) -> Callable[[Column], Column]:
    """(phrase, at) of the first place of each phrase, by its lower-cased text, in a text."""
    shared = spark.sparkContext.broadcast(phrases)

    @F.pandas_udf("array<struct<phrase: string, at: int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for lower, names in shared.value.items():
            automaton.add_word(lower, (len(lower), names))
        automaton.make_automaton()

        def each(text: str | None) -> list[dict]:
            first: dict[str, int] = {}
            if text and len(automaton):
                for last, (size, names) in automaton.iter(text):
                    for name in names:
                        first.setdefault(name, last - size + 1)
            return [{"phrase": name, "at": at} for name, at in first.items()]

        for texts in batches:
            yield pd.Series([each(t) for t in texts])

    return hits


def pair_labels(circles: DataFrame, words: DataFrame, *keys: str, max_gap: float = 80.0) -> DataFrame:
    """Every circle (circle_id, page, x0, y0, x1, y1) with the nearest word to
    its right on its height, or null.

    Heights are cut into bands and each word is put into its own and the
    adjacent ones, so this is an equi-join on page and band.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    band = F.floor(middle / BAND).cast("int")
    c = circles.withColumn("_cy", middle).withColumn("_band", band)
    w = words.select(*keys, "page", F.col("x0").alias("_x0"), ((F.col("y0") + F.col("y1")) / 2).alias("_wy"), F.col("text").alias("_text"), F.struct("block", "line", "word_no").alias("_order"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    on = (F.abs(F.col("_wy") - F.col("_cy")) < BAND) & (F.col("_x0") > F.col("x1") - 2) & (F.col("_x0") - F.col("x1") < max_gap)
    joined = c.join(w, [*keys, "page", "_band"], "left").withColumn("_near", F.coalesce(on, F.lit(False)))
    nearest = F.min(F.when(F.col("_near"), F.struct((F.col("_x0") - F.col("x1")).alias("gap"), F.col("_order"), F.col("_text").alias("text"))))
    return joined.groupBy(*keys, "page", "circle_id", "x0", "y0", "x1", "y1").agg(nearest.alias("_n")).withColumn("label", F.col("_n.text")).drop("_n")


def _grams(text: str, size: str) -> str:
    """SQL: the distinct runs of ``size`` characters of a text; of size 0 the empty one."""
    return f"CASE WHEN {size} = 0 THEN array('') WHEN length({text}) < {size} THEN CAST(array() AS array<string>) ELSE array_distinct(transform(sequence(1, length({text}) - {size} + 1), i -> substring({text}, i, {size}))) END"


def labels_with(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, wanted) of all distinct labels that contain a wanted text, in any case.

    An inverted index of the labels' grams of up to GRAM characters (of the sizes that wanted texts have).
    A wanted text of GRAM characters at most is a gram itself.  Of the grams of a longer one the rarest
    gives the candidates, which are then searched for the whole.
    """
    want = wanted.select("wanted").where("wanted IS NOT NULL").distinct().withColumn("_w", F.lower("wanted"))
    sizes = sorted(r["size"] for r in want.select(F.least(F.lit(GRAM + 1), F.length("_w")).alias("size")).distinct().collect())
    used = sorted({min(size, GRAM) for size in sizes})
    texts = labels.select("label").where("label IS NOT NULL").distinct().withColumn("_l", F.lower("label"))
    every = F.flatten(F.array(*(F.expr(_grams("_l", str(size))) for size in used))) if used else F.expr("CAST(array() AS array<string>)")
    postings = texts.select("label", "_l", F.explode(every).alias("gram"))
    whole = want.where(F.length("_w") <= GRAM).select("wanted", F.col("_w").alias("gram"))
    found = templates.beside(postings.select("label", "gram"), whole, "gram").select("label", "wanted")
    if GRAM + 1 not in sizes:
        return found
    asked = want.where(F.length("_w") > GRAM).select("wanted", "_w", F.explode(F.expr(_grams("_w", str(GRAM)))).alias("gram"))
    postings = postings.join(asked.select("gram").distinct(), "gram", "left_semi")
    lengths = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(lengths, "gram", "left").groupBy("wanted", "_w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("wanted", "_w", "r.gram")
    return found.unionByName(postings.join(rarest, "gram").where(F.contains("_l", F.col("_w"))).select("label", "wanted"))


def bind_options(pairs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """For each wanted label the first pair (position) whose label contains
    it, in any case; a label that many pairs have is searched once.  Of pairs of
    one position the one with the least label is the first.

    A label that most pairs have is no one task's: hits of labels that more than COMMON pairs have are broadcast to
    these pairs, and the other pairs meet theirs by label.
    """
    often = pairs.where("label IS NOT NULL").groupBy("label").agg((F.count("*") > COMMON).alias("_often"))
    n = {r["_often"]: r["n"] for r in often.groupBy("_often").agg(F.count("*").alias("n")).collect()}
    common = F.broadcast(often.where("_often").select("label"))
    parts = []
    if n.get(True):
        own = pairs.join(common, "label", "left_semi")
        parts.append(own.join(F.broadcast(labels_with(own, wanted).join(wanted, "wanted")), "label"))
    if n.get(False) or not parts:
        own = pairs.join(common, "label", "left_anti") if n.get(True) else pairs
        parts.append(own.join(labels_with(own, wanted).join(wanted, "wanted"), "label"))
    hit = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = F.row_number().over(Window.partitionBy(*keys, "wanted").orderBy("position", "label"))
    return hit.withColumn("_n", first).where("_n = 1").drop("_n")


def anchored_box(hit: Column, page_w: float, page_h: float, width: float = 140, height: float = 16, dx: float = 6, dy: float = -3, below: bool = False, y_override: float | None = None) -> Column:
    """The box to the right of (or below) a phrase's box struct, kept inside
    the page; without a hit a box at the origin.  A struct of box, calibrated."""
    right = F.array(*(round_half_even(x, 1) for x in (hit["x1"] + dx, hit["y0"] + dy, hit["x1"] + dx + width, hit["y0"] + dy + height)))
    under = F.array(*(round_half_even(x, 1) for x in (hit["x0"], hit["y1"] + 4, hit["x0"] + width, hit["y1"] + 4 + height)))
    if y_override is not None:  # the row's own height on the page
        right = F.array(right[0], F.lit(round(float(y_override), 1)), right[2], F.lit(round(float(y_override + height), 1)))
    box = F.when(hit.isNull(), F.array(*map(F.lit, (0.0, 0.0, float(width), float(height))))).otherwise(under if below else right)
    zero, w, h = F.lit(0.0), F.lit(float(page_w)), F.lit(float(page_h))
    return F.struct(F.array(F.greatest(zero, box[0]), F.greatest(zero, box[1]), F.least(w, box[2]), F.least(h, box[3])).alias("box"), hit.isNotNull().alias("calibrated"))


def small_circles(drawings: DataFrame) -> DataFrame:
    """Drawings with a curve, 10 to 16 points wide and high."""
    w, h = round_half_even(F.col("x1") - F.col("x0"), 1), round_half_even(F.col("y1") - F.col("y0"), 1)
    return drawings.where(F.exists("items", lambda i: i["kind"] == "c") & w.between(10, 16) & h.between(10, 16))


def date_boxes(drawings: DataFrame) -> DataFrame:
    """Rectangles of drawings, 12 to 18 points wide and high."""
    rows = drawings.select("page", F.explode("items").alias("i")).where("i.kind = 're'").select("page", "i.x0", "i.y0", "i.x1", "i.y1")
    return rows.where(round_half_even(F.col("x1") - F.col("x0"), 1).between(12, 18) & round_half_even(F.col("y1") - F.col("y0"), 1).between(12, 18))


def page_statistics(words: DataFrame, circles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Numbers of words, circles and date boxes of each page."""
    parts = [rows.select("page", F.lit(kind).alias("kind")) for kind, rows in (("n_words", words), ("n_circles", circles), ("n_date_boxes", boxes))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("page").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("n_words", "n_circles", "n_date_boxes")))


def table_rows(rois: DataFrame) -> DataFrame:
    """Rows of table regions that have any box, one of an unknown column too,
    with the number of their cells."""
    rows = rois.withColumn("row", F.explode("rows")).withColumn("_boxes", F.try_element_at("cell_boxes", F.col("row"))).where(F.size("_boxes") > 0)
    return rows.withColumn("cells", F.size(F.filter("columns", lambda c: F.try_element_at("_boxes", c).isNotNull()))).drop("_boxes")


def table_cells(rois: DataFrame) -> DataFrame:
    """Cells of table regions (rows, columns, cell_boxes: row -> column ->
    box), named ``roi.row.col``; those without a box are left out."""
    cells = rois.withColumn("row", F.explode("rows")).withColumn("column", F.explode("columns"))
    box = F.try_element_at(F.try_element_at(F.col("cell_boxes"), F.col("row")), F.col("column"))
    return cells.withColumn("box", box).where("box IS NOT NULL").withColumn("roi_name", F.concat_ws(".", "roi_name", "row", "column")).withColumn("field_type", F.lit("TEXT"))
