"""Document fingerprints: threshold-scaled (fractional) MinHash sketches.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash
space, plus the smallest hash, so that no document with words has an empty
sketch.  Sketches of any size merge by union, and give containment estimates
between very unequal documents: the share of one sketch that the other holds.

Defined cases: null and empty texts, and texts without words, have the empty
sketch ``""``; two equal sketches (empty ones too) are alike to 1.0, an empty
and a non-empty one to 0.0.  Repeated rows each get a row; rows of one id share a
task.  Very long texts are hashed in chunks.  An empty table has no rows; extra
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import kernels

#: The share of the hash space that sketches keep.
FRACTION = 1 / 8
#: Most ranges of ids that neighbours() deals documents to, rows of a range, and sampled ids for each.
MAX_RANGES, RANGE_ROWS, SAMPLED = 1 << 18, 1000, 8


def keep(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of sorted distinct shingle hashes: those below the fraction, and the least."""
    return hashes[: max(int(np.searchsorted(hashes, np.uint64(int(fraction * 2**64)))), min(1, len(hashes)))]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two documents, from their sketches alone."""
    return keep(np.union1d(a, b), fraction)


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller sketch in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / min(len(a), len(b))


def sketches(texts: pa.Array, fraction: float = FRACTION) -> list[np.ndarray]:
    hashes, counts = kernels.word_hashes(*kernels.utf8(texts))
    return [keep(x, fraction).copy() for x in kernels.shingles(hashes, counts)]


def fingerprint(docs: DataFrame, fraction: float = FRACTION, text: str = "text") -> DataFrame:
    """docs' doc_id and its sketch, as array<long> of the hashes' bits."""

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in sketches(batch.column(1), fraction)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(each, T.StructType([T.StructField("doc_id", kind), T.StructField("sketch", T.ArrayType(T.LongType()))]))


def range_bounds(docs: DataFrame) -> np.ndarray:
    """Ids that part the documents into ranges of about RANGE_ROWS rows, from a sample of ids by hash."""
    rows = docs.count()
    count = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    if count == 1:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLED * count / rows)
    ids = docs.select("doc_id").where(F.pmod(F.xxhash64(F.lit("range"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).toPandas()["doc_id"].to_numpy(np.int64)
    return np.unique(np.sort(ids)[SAMPLED::SAMPLED])


def neighbours(docs: DataFrame) -> DataFrame:
    """(_range, doc_id, text, _guest): documents dealt to ranges of ids; each
    range also gets, as a guest, the first document of the next range (of the
    first one after the last).  Only sampled ids and the ranges' first ones, at
    most SAMPLED * MAX_RANGES, are seen by the driver."""
    bounds = range_bounds(docs)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_range", range_of("doc_id"))
    heads = sorted((r["_range"], r["_head"]) for r in dealt.select("doc_id", "_range").groupBy("_range").agg(F.min("doc_id").alias("_head")).collect())
    if not heads:
        return dealt.withColumn("_guest", F.lit(False))
    guests = docs.sparkSession.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], f"_head {docs.schema['doc_id'].dataType.simpleString()}, _to int")
    return (
        dealt.join(F.broadcast(guests), F.col("doc_id") == F.col("_head"), "left")
        .withColumn("_place", F.explode(F.expr("array_compact(array(struct(_range, false AS guest), if(_to IS NULL, NULL, struct(_to AS _range, true AS guest))))")))
        .select("doc_id", "text", F.col("_place._range").alias("_range"), F.col("_place.guest").alias("_guest"))
    )


def edited_halves(text: bytes, other: bytes) -> tuple[int, bytes]:
    """Code points of text, and text with its last half replaced by the other's first."""
    a = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n = len(a)
    half = n // 2
    if not half:
        return n, text
    b = np.flatnonzero((np.frombuffer(other[: 4 * half + 4], np.uint8) & 0xC0) != 0x80)
    return n, text[: a[n - half]] + (other[: b[half]] if len(b) > half else other)


def compare_with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """op1: each document against its edited text and against the next document.

    Rows of equal doc_id come in order of their text.  Documents without an
    id are left out, as they have no place in the order.
    """
    placed = neighbours(docs.select("doc_id", "text").where("doc_id IS NOT NULL"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, sketch) of a document that awaits the next one
        for batch in batches:
            ids, ranges, guests = (batch.column(i).to_pylist() for i in (0, 2, 3))
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            own = sketches(batch.column(1), fraction)
            pairs, nexts = [], []
            for i, text in enumerate(texts):
                if last is not None and last[0] == ranges[i]:
                    pairs.append((last, edited_halves(last[2], text)))
                    nexts.append(own[i])
                # a guest only ends its range: it may sort before a repeated row of its own id in the one range there is
                last = None if guests[i] else (ranges[i], ids[i], text, own[i])
            if pairs:
                changed = sketches(pa.array([e[1] for _, e in pairs], pa.large_binary()), fraction)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": p[1], "n_chars": n, "edited_sha256": hashlib.sha256(e).hexdigest(), "fingerprint": pack(p[3]), "edited_fingerprint": pack(c), "near_edited": likeness(p[3], c), "near_next": likeness(p[3], x)}
                        for (p, (n, e)), c, x in zip(pairs, changed, nexts, strict=True)
                    ],
                    schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
                )

    return placed.repartition("_range").sortWithinPartitions("_range", "_guest", "doc_id", "text").select("doc_id", "text", "_range", "_guest").mapInArrow(each, schema)
