"""Language identification by multilingual mixture inference.

Every language has smoothed byte n-gram counts of a training sample.  A
document is a mixture of languages: expectation-maximisation over blocks of
words estimates its language proportions.  Its set of languages, of any size,
grows and shrinks by one language at a time while the penalised likelihood
rises.

Defined cases: null texts and texts without a letter are ``und`` with score
0.0; so is every text when nothing was learned.  Repeated rows each get a row,
and only doc_id and text of the scored rows are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels

ORDER = 3  # bytes in an n-gram
BITS = 18  # n-grams are counted in 2**BITS slots
BLOCK_WORDS = 8  # words that share one language
ROUNDS = 12  # of expectation-maximisation
#: Documents of each language that are learned from, at most (in expectation).
TRAIN_DOCUMENTS = 3000
_SLICE = 64  # pieces in which a language's counts are shuffled

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[97:123] = True
_WORD[128:] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, first n-gram of every block, documents of blocks) chunk by chunk.

    Bytes other than letters become one space; n-grams without letters get -1.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    low = _LOWER[data]
    low = np.where(_WORD[low], low, np.uint8(32))
    for lo, hi in kernels.chunks(first[:-1] | (low == 32)):
        part = np.concatenate([np.full(ORDER - 1, 32, np.uint8), low[lo:hi]]).astype(np.uint32)
        code = np.zeros(hi - lo, np.uint32)
        for j in range(ORDER):
            code = (code << np.uint32(8)) | part[j : j + hi - lo]
        slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        slot[((part[ORDER - 2 : ORDER - 2 + hi - lo] == 32) & (part[ORDER - 1 :] == 32))] = -1
        starts = np.flatnonzero((part[ORDER - 1 :] != 32) & ((part[ORDER - 2 : ORDER - 2 + hi - lo] == 32) | first[lo:hi]))
        if len(starts):
            yield lo, slot, starts


def learn(docs: DataFrame, lang: str = "lang", seed: int = 7, limit: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages, and a (slots, languages) table of log-likelihoods.

    Of each language about ``limit`` documents are taken by a hash of their
    id, none if it has fewer; their counts are added up on the executors.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(lang).alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, limit / n)) for k, n in sizes.items()], "lang string, share double")
    names = sorted(sizes)
    place = {k: i for i, k in enumerate(names)}

    @kernels.tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for name in set(langs):
                data, offsets = kernels.utf8(batch.column(1).filter(pa.array(langs == name)))
                into = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
                for _, slot, _ in grams(data, offsets):
                    into += np.bincount(slot[slot >= 0], minlength=1 << BITS)
        size = (1 << BITS) // _SLICE
        for name, into in totals.items():
            rows = [(place[name], i, into[i * size : (i + 1) * size].tobytes()) for i in range(_SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["l", "i", "n"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) // _SLICE, np.int64)
        for batch in batches:
            for x in batch.column(2).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["l", "i", "n"])

    sample = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
    counts = np.zeros((len(names), 1 << BITS))
    size = (1 << BITS) // _SLICE
    for r in sample.mapInArrow(count, "l int, i int, n binary").groupBy("l", "i").applyInArrow(add, "l int, i int, n binary").toLocalIterator():
        counts[r["l"], r["i"] * size : (r["i"] + 1) * size] = np.frombuffer(r["n"], np.int64)
    smooth = counts + 0.02
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def _fit(odds: np.ndarray, doc: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's own langs (documents, size), and the log-likelihoods."""
    n, size = langs.shape
    part = np.take_along_axis(odds, langs[doc], 1)
    best = part.max(axis=1, keepdims=True)
    like = np.exp(part - best)
    share = np.full((n, size), 1 / size)
    blocks = np.maximum(np.bincount(doc, minlength=n), 1)
    for _ in range(ROUNDS if size > 1 else 0):
        own = like * share[doc]
        own /= own.sum(axis=1, keepdims=True)
        share = np.stack([np.bincount(doc, own[:, j], n) for j in range(size)], axis=1) / blocks[:, None]
        share = np.maximum(share, 1e-9)
    total = np.bincount(doc, np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)) + best[:, 0], n)
    return share, total


def choose(odds: np.ndarray, doc: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """Proportions (n, languages) under each document's set of languages.

    From its best single language on, a set gains or loses the one language
    that raises the penalised likelihood most, until none does.
    """
    count = odds.shape[1]
    pick = np.zeros((n, count))
    blocks = np.bincount(doc, minlength=n)
    alone = np.stack([np.bincount(doc, odds[:, j], n) for j in range(count)], axis=1)
    inside = np.zeros((n, count), bool)
    best = alone.max(axis=1)
    inside[np.arange(n), alone.argmax(axis=1)] = blocks > 0
    pick[inside] = 1.0
    active = blocks > 0
    while active.any():
        now, changed = best.copy(), np.full(n, -1)
        sizes, found = inside.sum(axis=1), pick.copy()
        for size in np.unique(sizes[active]).tolist():
            for j in range(count):
                for want, step in ((active & (sizes == size) & ~inside[:, j], 1), (active & (sizes == size) & inside[:, j], -1)):
                    where = np.flatnonzero(want)
                    if not len(where) or size + step < 1:
                        continue
                    trial = inside[where]
                    trial[:, j] = step > 0
                    langs = np.nonzero(trial)[1].reshape(len(where), size + step)
                    rows = want[doc]
                    part, like = _fit(odds[rows], (np.cumsum(want) - 1)[doc[rows]], langs)
                    like = like - penalty * (size + step - 1) * np.log(blocks[where] + 1)
                    better = like > now[where] + 1e-9 * np.abs(now[where])
                    to = where[better]
                    now[to], changed[to], found[to] = like[better], j, 0
                    found[to[:, None], langs[better]] = part[better]
        active = changed >= 0
        moved = np.flatnonzero(active)
        inside[moved, changed[moved]] ^= True
        best, pick = now, found
    return pick


def infer(texts: pa.Array, names: list[str], table: np.ndarray, penalty: float = 4.0) -> tuple[list[str], list[float], list[list[str]]]:
    """For each text: its main language, that one's proportion, the language set."""
    data, offsets = kernels.utf8(texts)
    n = len(offsets) - 1
    odds, docs = [np.zeros((0, len(names)))], [np.zeros(0, np.int64)]
    for lo, slot, starts in grams(data, offsets) if names else ():
        doc = np.searchsorted(offsets, starts + lo, side="right") - 1
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        rank = np.arange(len(starts)) - np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
        heads = rank % BLOCK_WORDS == 0
        value = table[slot]
        value[slot < 0] = 0
        odds.append(np.add.reduceat(value, starts[heads], axis=0).astype(np.float64))
        docs.append(doc[heads])
    odds, doc = np.concatenate(odds), np.concatenate(docs)
    some = np.bincount(doc, minlength=n) > 0
    pick = choose(odds, doc, n, penalty) if names else np.zeros((n, 0))
    letters = pa.compute.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}").to_pylist()
    known = some & np.array(letters, bool)
    main = pick.argmax(axis=1) if len(names) else np.zeros(n, np.int64)
    preds = [names[main[i]] if known[i] else "und" for i in range(n)]
    return preds, [float(pick[i, main[i]]) if known[i] else 0.0 for i in range(n)], [[names[j] for j in np.flatnonzero(pick[i] > 1e-6)] if known[i] else [] for i in range(n)]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (its estimated proportion) and langs (the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            pred, score, langs = infer(batch.column(1), names, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double, langs array<string>")


def held_out(column: str, parts: int, part: int):
    """Whether a row is held out: crc32 of its id's text, modulo parts."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """op10: learn from rows whose crc32(doc_id) mod 5 is not 0, score all."""
    model = learn(docs.where(~held_out("doc_id", 5, 0)))
    return identify(docs, model).withColumn("held_out", held_out("doc_id", 5, 0)).select("doc_id", "held_out", "lang_pred", "score", F.array_join("langs", ",").alias("langs"))
