"""Spelling variants: words that differ by one code point, by automata of halves.

If two words differ by one inserted, deleted or replaced code point, one half of
the first stands whole in the second, as its beginning or as its end.  Shards
hold the two segments of every word in an Aho-Corasick automaton; every word is
scanned, by each shard that can hold a segment of a word near it.  Of what the
automaton finds, the segment must stand at the beginning or the end and the
lengths must be compatible; then the distance is verified, by what the words
have besides the segment: the words of a segment are kept by their remainders with
one code point left out, so a segment with many words costs no pairs.

A segment of more than HOT words is dealt to several shards, each of which scans
the words that can be near.  A scan returns one row for a word, with its number of near words
and the best of them, so no pairs are shuffled.

Defined cases: null and empty texts have no words; a null id is written as no
characters.  Repeated rows count as often as they are there.  Long texts are read in slabs,
cut between words.  A table without words has no rows; columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.session import stored

#: Code points and occurrences of a word, at least; every so many-th run is misspelt; n of a form over its word's.
LEAST, OCCURRENCES, MISSPELT, FACTOR = 7, 2, 31, 10
#: Words of a shard, words of a segment in one shard, bytes of a slab, words counted before they are passed on.
SHARD, HOT, SLAB, COUNTED = 1 << 15, 4096, 1 << 22, 1 << 19

#: Latin-1 bytes: A-Z lower-cased, letters kept, a space for all others.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The runs of at least LEAST letters, slab by slab, in Latin-1 (a code point is a byte)."""
    data, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(data):
        to = data.find(b" ", at + SLAB) if len(data) - at > SLAB else -1
        to = len(data) if to < 0 else to
        yield [w for w in data[at:to].split() if len(w) >= LEAST]
        at = to


def counted(doc_id: int | None, text: str, into: Counter) -> None:
    """Adds a text's words, some of them misspelt, to the counts."""
    begin = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for slab in runs(text):
        for run, n in Counter(slab).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
            if h % MISSPELT:
                into[run] += n
            elif len(run) > LEAST:
                at = h % len(run)
                into[run[:at] + run[at + 1 :]] += n


def words(docs: DataFrame) -> DataFrame:
    """word and n of all words."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    @kernels.tidied
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in batches:
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                counted(doc_id.as_py(), text.as_py() or "", counts)
                if len(counts) > COUNTED:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Remainders:
    """What the words of one segment have besides it, by what is left of it without one code point."""

    def __init__(self):
        self.n: dict[str, int] = {}
        self.without: dict[str, list[tuple[str, int]]] = {}

    def add(self, rest: str, n: int) -> None:
        self.n[rest] = n
        for i in range(len(rest)):
            self.without.setdefault(rest[:i] + rest[i + 1 :], []).append((rest, i))

    def near(self, rest: str) -> set[str]:
        """The remainders at a distance of exactly one."""
        found = {other for other, _ in self.without.get(rest, ())}
        for i in range(len(rest)):
            less = rest[:i] + rest[i + 1 :]
            if less in self.n:
                found.add(less)
            found.update(other for other, at in self.without.get(less, ()) if at == i and other != rest)
        return found


class Halves:
    """An automaton of segments, each with the words it begins and those it ends."""

    def __init__(self, held: Iterator[tuple[str, int, str]]):
        self.begins: dict[str, Remainders] = {}
        self.ends: dict[str, Remainders] = {}
        for word, n, role in held:
            half = len(word) // 2
            segment, rest, groups = (word[:half], word[half:], self.begins) if role == "begin" else (word[half:], word[:half], self.ends)
            groups.setdefault(segment, Remainders()).add(rest, n)
        self.automaton = ahocorasick.Automaton()
        for segment in self.begins.keys() | self.ends.keys():
            self.automaton.add_word(segment, segment)
        self.automaton.make_automaton()

    def scan(self, word: str) -> Iterator[tuple[int, str]]:
        """(n, word) of every held word at a distance of one, once each."""
        if not len(self.automaton):
            return
        size = len(word)
        for last, segment in self.automaton.iter(word):
            s = len(segment)
            # a word that the segment begins has 2s or 2s+1 code points, one that it ends 2s-1 or 2s
            if last == s - 1 and 2 * s - 1 <= size <= 2 * s + 2 and (group := self.begins.get(segment)):
                yield from ((group.n[rest], segment + rest) for rest in group.near(word[s:]))
            if last == size - 1 and 2 * s - 2 <= size <= 2 * s + 1 and (group := self.ends.get(segment)):
                # where its other segment begins the word too, that one has found it
                yield from ((group.n[rest], rest + segment) for rest in group.near(word[: size - s]) if not word.startswith(rest))


def _scanned(key: tuple, part: pa.Table) -> pa.Table:
    rows = zip(*(part[c].to_pylist() for c in ("word", "n", "role")), strict=True)
    scans, held = [], []
    for word, n, role in rows:
        if role:
            held.append((word, n, role))
        else:
            scans.append(word)
    halves, out = Halves(iter(held)), []
    for word in scans:
        found = list(halves.scan(word))
        if found:
            n, form = min(found, key=lambda x: (-x[0], x[1]))
            out.append((word, len(found), -n, form))
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "minus", "form"])


def _segments(scan: bool) -> Column:
    """(role, segment) that a word holds, or, for a scan, of the words that can be near it."""
    made = []
    for more in (-1, 0, 1) if scan else (0,):
        half = f"((length(word) + {more}) div 2)"
        made += [f"named_struct('role', 'begin', 'segment', substring(word, 1, CAST({half} AS INT)))", f"named_struct('role', 'end', 'segment', right(word, CAST(length(word) + {more} - {half} AS INT)))"]
    return F.explode(F.array_distinct(F.expr(f"array({', '.join(made)})"))).alias("s")


def near_words(vocabulary: DataFrame, shard_words: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n_near, form_n and form (the near word of largest n) of the words (word, n) that have near words."""
    shards = 1 + vocabulary.count() // shard_words
    held = vocabulary.select("word", "n", _segments(False)).select("word", "n", "s.*")
    scans = vocabulary.select("word", "n", _segments(True)).select("word", "n", "s.*")
    parts = held.groupBy("role", "segment").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1").checkpoint()
    if parts.isEmpty():
        held, scans = held.withColumn("part", F.lit(0)), scans.withColumn("part", F.lit(0))
    else:
        several = F.coalesce("parts", F.lit(1))
        held = held.join(parts, ["role", "segment"], "left").withColumn("part", F.pmod(F.xxhash64("word"), several).cast("int"))
        scans = scans.join(parts, ["role", "segment"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), several - 1)))
    shard = F.pmod(F.xxhash64("role", "segment", "part"), F.lit(shards)).alias("shard")
    rows = held.select(shard, "word", "n", "role").unionByName(scans.select(shard, "word", "n", F.lit(None).cast("string").alias("role")).distinct())
    found = rows.groupBy("shard").applyInArrow(_scanned, "word string, near long, minus long, form string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus", "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.minus")).alias("form_n"), "best.form")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and the last of the forms that follow it, over at most ``steps`` of (word, form)."""
    at, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < steps:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at, reach = at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")).checkpoint(), 2 * reach
    return at


def variants(docs: DataFrame, shard_words: int = SHARD, hot: int = HOT) -> DataFrame:
    """op12: word, n, n_near, form, form_n and root of every word."""
    spark = docs.sparkSession
    vocabulary = stored(spark, words(docs))
    near = near_words(vocabulary, shard_words, hot)
    formed = F.col("form_n") >= FACTOR * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    rows = stored(spark, rows)
    # every form has FACTOR times the occurrences of its word, so chains are short
    most, steps = rows.agg(F.max("n")).first()[0] or 0, 0
    while OCCURRENCES * FACTOR ** (steps + 1) <= most:
        steps += 1
    last = roots(rows.where("form IS NOT NULL"), steps)
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The same in SQL; the polynomial of the checksum is a fixed value.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT list(x ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x FROM range(256) AS t(i))),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= {LEAST} GROUP BY ALL),
bytes AS (
  SELECT doc_id, w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295)) AS h FROM bytes, steps),
vocabulary AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {MISSPELT} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
gaps AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS gap FROM vocabulary, unnest(range(length(word))) AS t(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps AS a JOIN gaps AS b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps AS a JOIN vocabulary AS b ON a.gap = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps AS a JOIN vocabulary AS b ON a.gap = b.word),
best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM near GROUP BY word),
rows AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= {FACTOR} * n THEN top[2] END AS form, CASE WHEN -top[1] >= {FACTOR} * n THEN -top[1] END AS form_n
  FROM vocabulary LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS root, 0 AS d FROM rows
  UNION ALL SELECT chains.word, rows.form, d + 1 FROM chains JOIN rows ON rows.word = chains.root WHERE rows.form IS NOT NULL)
SELECT rows.word, n, n_near, form, form_n, arg_max(root, d) AS root FROM rows JOIN chains USING (word) GROUP BY ALL
"""
