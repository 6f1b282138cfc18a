"""Best-fit packing of tokenised documents into sequences of CAPACITY tokens.

A document is its ids and an end id; one of more than CAPACITY ids is cut into
pieces, all full but the first.  Every task packs the pieces of its own
documents as they come: at most OPEN bins are open, kept by their free space
with a bitset of the sizes that occur, so the best fit is the lowest set bit
from the piece's length on; where no bin is free, the fullest one closes.
Pieces are taken in windows of WINDOW tokens, longest first, so short ones
fill what long ones leave.  At a task's end all but the HANDED emptiest bins
close too; those are packed as they are, in groups of GROUP, level by level until
one group is left.  No shuffle carries more than the handed-on bins.

Defined cases: a null text is an empty one, and an empty text is its end id
alone; null and repeated doc_ids and equal rows each have their own pieces; ties
go to the bin that opened first.  Very long texts are tokenised in slabs, cut
before a single space between two other characters, where a token always begins;
a text without any is one slab.  An empty table has no sequences; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.session import stored

CAPACITY = 2048
#: Bins that are open at once, tokens of a window, bins a task hands on, and those of a group.
OPEN, WINDOW, HANDED, GROUP = 1024, 1 << 20, 64, 4096
#: Characters of a slab.
SLAB = 1 << 20
#: A single space between two other characters: the text from it on can be tokenised alone.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Runs that may be one token of the pattern and are long.
LONG = re.compile(r"\S{2000}|\s{2000}")
# fixed values: the pre-tokenizer that is supported, and its pattern
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]))
FIELDS = pa.schema([("bin", pa.int64()), ("open", pa.bool_()), ("members", MEMBERS), ("ids", pa.binary())])
BINS = "bin long, open boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, offset: long>>, ids binary"


class Tokens:
    """Ids of texts as little-endian 32-bit integers, by a byte-level tokenizer file of ``tokenizers``.

    The file's merges run in tiktoken, which takes a third of that library's time
    and gives the same ids; runs that tiktoken would take quadratic time for go to the library.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        if spec["normalizer"] or spec["pre_tokenizer"] != BYTE_LEVEL:
            raise ValueError("only byte-level tokenizers without a normaliser are supported")
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(plain)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(set(made)):
            raise ValueError("merges are not in the order of their ids")
        self.library = Tokenizer.from_str(file)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens=special)

    def ids(self, text: str) -> bytes:
        parts, at = [], 0
        while at >= 0:
            cut = CUT.search(text, at + SLAB) if len(text) - at > SLAB else None
            slab = text[at : cut.start() if cut else len(text)]
            if LONG.search(slab):
                parts.append(np.array(self.library.encode(slab, add_special_tokens=False).ids, "<u4"))
            else:
                parts.append(self.fast.encode_to_numpy(slab, allowed_special="all").astype("<u4"))
            at = cut.start() if cut else -1
        return b"".join(p.tobytes() for p in parts)


@lru_cache(1)
def tokens(file: str) -> Tokens:
    return Tokens(file)


class Bin:
    __slots__ = ("members", "parts", "used")

    def __init__(self):
        self.members: list[tuple] = []
        self.parts: list[bytes] = []
        self.used = 0

    def add(self, members: list[tuple], ids: bytes) -> None:
        self.members += [(*m[:4], m[4] + self.used) for m in members]
        self.parts.append(ids)
        self.used += len(ids) // 4


class Packer:
    """Bounded-space best fit of (members, ids) items; yields bins as they close."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN, window: int = WINDOW):
        self.capacity, self.most, self.window = capacity, most, window
        self.bits, self.count = 0, 0  # free sizes that an open bin has, and the number of open bins
        self.free: dict[int, deque[Bin]] = {}
        self.waiting: list[tuple[list[tuple], bytes]] = []
        self.tokens = 0

    def _take(self, size: int) -> Bin:
        group = self.free[size]
        found = group.popleft()
        if not group:
            del self.free[size]
            self.bits ^= 1 << size
        self.count -= 1
        return found

    def _fullest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1

    def _place(self, members: list[tuple], ids: bytes) -> Iterator[Bin]:
        need = len(ids) // 4
        fitting = self.bits >> need
        into = self._take(need + (fitting & -fitting).bit_length() - 1) if fitting else Bin()
        into.add(members, ids)
        left = self.capacity - into.used
        if left == 0 or (self.count == self.most and left <= self._fullest()):
            yield into
            return
        if self.count == self.most:
            yield self._take(self._fullest())
        self.free.setdefault(left, deque()).append(into)
        self.bits |= 1 << left
        self.count += 1

    def _drain(self) -> Iterator[Bin]:
        self.waiting.sort(key=lambda item: -len(item[1]))
        for item in self.waiting:
            yield from self._place(*item)
        self.waiting, self.tokens = [], 0

    def put(self, members: list[tuple], ids: bytes) -> Iterator[Bin]:
        self.waiting.append((members, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= self.window:
            yield from self._drain()

    def close(self, handed: int) -> Iterator[tuple[Bin, bool]]:
        """The bins that are left, fullest first, and whether each is handed on."""
        for found in self._drain():
            yield found, False
        while self.count:
            yield self._take(self._fullest()), self.count < handed


def pieces(doc_id: int | None, ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[list[tuple], bytes]]:
    """A document's pieces: one with its place, and its ids; only the first may be short."""
    size = len(ids) // 4
    number = -(-size // capacity)
    start, length = 0, size - capacity * (number - 1)
    for piece in range(number):
        yield [(doc_id, piece, start, length, 0)], ids[4 * start : 4 * (start + length)]
        start, length = start + length, capacity


def _batches(bins: Iterator[tuple[Bin, bool]], first: int) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS, numbered from first on."""
    rows: list[tuple] = []
    names = [f.name for f in MEMBERS.value_type]
    for found, handed in bins:
        rows.append((first, handed, [dict(zip(names, m, strict=True)) for m in found.members], b"".join(found.parts)))
        first += 1
        if len(rows) == 128:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


def _repacked(items: Iterator[tuple[list[tuple], bytes]], handed: int, capacity: int) -> Iterator[tuple[Bin, bool]]:
    packer = Packer(capacity)
    for members, ids in items:
        for found in packer.put(members, ids):
            yield found, False
    yield from packer.close(handed)


def _regrouped(level: int, handed: int, capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def again(key: tuple, part: pa.Table) -> pa.Table:
        rows = part.sort_by("bin")
        items = (([tuple(m.values()) for m in members.as_py()], ids.as_py()) for members, ids in zip(rows["members"], rows["ids"], strict=True))
        return pa.Table.from_batches(_batches(_repacked(items, handed, capacity), (level << 56) + (key[0].as_py() << 32)), FIELDS)

    return again


def sequences(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, members (doc_id, piece, start, length, offset) and ids (32-bit
    little-endian) of every sequence; ``tokenizer`` is a JSON file of the library."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as opened:
        file = spark.sparkContext.broadcast(opened.read())
    last = end.to_bytes(4, "little")

    @kernels.tidied
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = tokens(file.value)
        own = (piece for batch in batches for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) for piece in pieces(doc_id.as_py(), source.ids(text.as_py() or "") + last, capacity))
        yield from _batches(_repacked(own, HANDED, capacity), TaskContext.get().partitionId() << 32)

    bins = stored(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, BINS))
    done, level = bins.where("NOT open"), 0
    while True:
        level += 1
        waiting = bins.where("open")
        groups = 1 + waiting.count() // GROUP

        bins = stored(spark, waiting.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("part")).applyInArrow(_regrouped(level, HANDED if groups > 1 else 0, capacity), BINS))
        done = done.unionByName(bins.where("NOT open"))
        if groups == 1:
            return done.select(F.col("bin").alias("sequence_id"), "members", "ids")


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """op11: a row for each piece, with the checksum of its ids as they stand in its sequence."""
    rows = sequences(docs, tokenizer).select("sequence_id", "ids", F.explode("members").alias("m"))
    ids = F.substring("ids", F.col("m.offset").cast("int") * 4 + 1, F.col("m.length").cast("int") * 4)
    return rows.select("m.doc_id", "m.piece", "m.start", "m.length", F.crc32(ids).alias("ids_crc32"), "sequence_id", "m.offset")
