"""N-gram Jaccard join by T-occurrence search.

Documents are sets of 5-word shingles; equal sets are one node.  Two nodes
link when 100 * intersection >= 80 * union.  Then they share at least T =
ceil(4/9 * (sizes)) shingles, and DivideSkip finds them: each set's shingles
are ordered from rare to common, its rarest (the short inverted lists) are
merged, and the common ones (the long lists) are only probed, by binary
search, for candidates that occur in the short lists at least T minus the
number of long lists times.

1. One pass takes each text's set key and adds up a table of shingle counts,
   sized by the corpus up to a bound and kept on a scale of doublings, which
   orders shingles; any order gives the same links.
2. A second pass emits the short lists' postings; lists of one node go.
3. Within each list, neighbours are linked first and linked nodes contracted,
   until no more links are found that way: so a group of near copies costs
   about as much as its postings, not their square.
4. All pairs of different components that share a list are counted, but for
   those whose parity sketches prove that they differ too much; those with too
   few occurrences go, and the others are probed.

Every link between different components is thus found; links within one are
not needed, since the result is the components.  Defined cases: null texts and
texts without words have an empty set, which links with nothing; a text of
fewer than five words has one shingle, its whole sequence.  Very long texts are
hashed in chunks; an empty table has no rows, and other columns are ignored.  Repeated rows each
get a row; rows without an id are left out.  Sets are told apart by a 64-bit
hash and their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.components import components
from attestor.llm.session import release

#: Least and most bits of the table of shingle counts, which has a byte for about SHARED shingles; bits of the table of wanted nodes.
COUNT_BITS, SHARED, WANTED_BITS = (20, 26), 8, 24
#: Levels of a count for each doubling; a byte holds counts up to 2**31.
LEVELS = 8
_SLICES = 64
#: Nodes before a node in a list that are tried first, and tries of a node in a round.
NEAR, CHOICES = 4, 3
#: Rows of a list that one task takes; longer ones are dealt in parts.
LIST_ROWS = 1 << 16
#: Postings for each task over pairs; small tables take few tasks and leave few files.
PAIR_ROWS = 200_000
#: Pairs whose counts a task holds before it passes them on.
HELD_PAIRS = 1 << 20
#: Bits of a set's parity sketch.
PARITY_BITS = 512
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 80


def node_of(sets: np.ndarray) -> int:
    """A set's key; 0 for the empty set."""
    if not len(sets):
        return 0
    with np.errstate(over="ignore"):
        key = kernels.mix64(np.array([kernels.mix64(sets).sum(dtype=np.uint64) + np.uint64(len(sets))], np.uint64))
    return int(key.view(np.int64)[0]) or 1


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    return kernels.shingles(*kernels.word_hashes(*kernels.utf8(texts)))


def short_length(n: np.ndarray | int):
    """Shingles of a set of n whose lists are merged: of two linked sets, a
    shared shingle is among these of both."""
    return n - -(-PERCENT * n // 100) + 1


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """T: the least intersection of linked sets of these sizes."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def parities(sets: np.ndarray) -> bytes:
    """A sketch whose bits tell whether an odd number of shingles fell on them.

    Each shingle that only one of two sets has flips one bit, so sketches differ
    in no more bits than the sets do in shingles.
    """
    flips = np.bincount(_slot(sets, PARITY_BITS.bit_length() - 1), minlength=PARITY_BITS)
    return np.packbits((flips & 1).astype(bool)).tobytes()


def merged(tables: DataFrame, size: int, kind: type, join: Callable, total: type | None = None, done: Callable | None = None) -> np.ndarray:
    """The table of ``size`` cells that the rows' slices (slot, cells) make up, each
    joined on an executor (in cells of type ``total``) and made ready there by ``done``.

    Its size is bounded, whatever the input.
    """

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size // _SLICES, total or kind)
        for batch in batches:
            for part in batch.column(1).to_pylist():
                cells = join(cells, cells_of(part, kind))
        cells = done(cells) if done else cells
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["slot", "cells"])

    out = np.zeros((_SLICES, size // _SLICES), np.uint8)
    for row in tables.groupBy("slot").applyInArrow(add, "slot int, cells binary").collect():
        out[row["slot"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return out.ravel()


def slices(table: np.ndarray) -> list[bytes]:
    """The table's slices, compressed.  Bytes of equal significance lie together, as the high ones are nearly all
    zero, and are coded by runs and frequency: counts by hash have no other patterns."""
    parts = []
    for cells in table.reshape(_SLICES, -1):
        coder = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)
        parts.append(coder.compress(cells.view(np.uint8).reshape(-1, table.itemsize).T.tobytes()) + coder.flush())
    return parts


def cells_of(part: bytes, kind: type) -> np.ndarray:
    """The cells of a slice."""
    planes = np.frombuffer(zlib.decompress(part), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes on a scale of doublings, so that no count of a large corpus reaches the top."""
    return np.minimum(np.rint(LEVELS * np.log2(counts.astype(float) + 1)), 255).astype(np.uint8)


def table_bits(docs: DataFrame) -> int:
    """Bits of the table of counts, from the characters of all texts (about six a shingle)."""
    shingles = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    return min(COUNT_BITS[1], max(COUNT_BITS[0], (shingles // SHARED).bit_length()))


def _slot(values: np.ndarray, bits: int) -> np.ndarray:
    return (kernels.mix64(values.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def keyed(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, parities) of every document, and the table of levels of shingle counts."""
    bits = table_bits(docs)
    schema = "doc_id long, n long, node long, parities binary, slot int, cells binary"
    names = ["doc_id", "n", "node", "parities", "slot", "cells"]

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            nodes, sizes, sketches, slots = [], [], [], [np.zeros(0, np.int64)]
            for found in sets_of(batch.column(1)):
                nodes.append(node_of(found))
                sizes.append(len(found))
                sketches.append(parities(found))
                slots.append(_slot(found, bits))
            at, times = np.unique(np.concatenate(slots), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 65535)  # of one task's texts
            empty = pa.nulls(len(nodes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], names)
        if counts.any():
            parts = slices(counts)
            none = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(_SLICES, pa.binary()), pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(each, schema).checkpoint()
    table = merged(rows.where("slot IS NOT NULL").select("slot", "cells"), 1 << bits, np.uint16, np.add, np.uint32, levels)
    return rows.where("slot IS NULL").select("doc_id", "n", "node", "parities"), table


def postings(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(token, node, n) of the short lists by the shared table of counts, once
    for each node and task at most."""

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        bits = len(counts).bit_length() - 1
        for batch in batches:
            nodes, sizes, lists = [], [], []
            for found in sets_of(batch.column(0)):
                node = node_of(found)
                if not len(found) or node in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(node)
                order = np.lexsort((found, counts[_slot(found, bits)]))[: short_length(len(found))]
                nodes.append(node)
                sizes.append(len(found))
                lists.append(found[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return docs.select("text").where("doc_id IS NOT NULL").mapInArrow(each, "node long, n long, tokens array<long>").select(F.explode("tokens").alias("token"), "node", F.col("n").cast("int").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole lists at a time: columns and the first row of each list of a
    stream that is sorted by its first column."""
    held: list[list[np.ndarray]] = []

    def out(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        whole = [np.concatenate([p[c] for p in parts]) for c in range(columns)]
        return whole, np.flatnonzero(np.concatenate([[True], whole[0][1:] != whole[0][:-1]]))

    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1], side="left"))  # the last list may go on
        if cut or (held and held[-1][0][-1] != part[0][0]):
            ended = [*held, [p[:cut] for p in part]]
            held = []
            if sum(len(p[0]) for p in ended):
                yield out([p for p in ended if len(p[0])])
        held.append([p[cut:] for p in part])
    if held:
        yield out(held)


def shared_postings(posted: DataFrame) -> DataFrame:
    """(token, n, node, length) of the lists with two nodes or more, a node once
    in each; of a list of more than LIST_ROWS nodes also a row that has its
    length and no node.  Lists are streamed, none is held."""
    limit = LIST_ROWS

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, as what follows it decides
        begun, size = True, 0  # whether that row is its list's first, and the nodes of the list so far

        def out(token: np.ndarray, n: np.ndarray, node: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begun, size
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, n, node = token[fresh], n[fresh], node[fresh]
            first = np.concatenate([[begun], token[1:] != token[:-1]])
            last = np.append(token[1:] != token[:-1], ended)
            at = np.arange(len(token))
            length = at - np.maximum.accumulate(np.where(first, at, 0)) + 1  # of the list up to each row
            length[np.cumsum(first) == 0] += size
            full = last & (length > limit)
            keep = ~(first & last)
            if not ended:
                keep[-1] = False
                held, begun = [token[-1:], n[-1:], node[-1:]], bool(first[-1])
                size = int(length[-1]) - 1
            none = pa.nulls(int(keep.sum()), pa.int64())
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(n[keep]), pa.array(node[keep]), none], ["token", "n", "node", "length"])
            if full.any():
                m = int(full.sum())
                yield pa.RecordBatch.from_arrays([pa.array(token[full]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(length[full])], ["token", "n", "node", "length"])

        for batch in batches:
            part = [batch.column(c).to_numpy() for c in range(3)]
            if len(part[0]):
                yield from out(*(part if held is None else [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]), False)
        if held is not None:
            yield from out(*held, True)

    return posted.repartition("token").sortWithinPartitions("token", "n", "node").select("token", "n", "node").mapInArrow(each, "token long, n int, node long, length long")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with each node's component."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _blocks(rows: DataFrame, long: DataFrame | None) -> DataFrame:
    """rows with list, the key of their list or of their part of a long one."""
    if long is None:
        return rows.withColumn("list", F.col("token"))
    part = F.xxhash64("token", F.pmod(F.xxhash64("node"), F.ceil(F.col("length") / LIST_ROWS)))
    return rows.join(long, "token", "left").withColumn("list", F.when(F.col("length").isNull(), F.col("token")).otherwise(part))


def neighbour_pairs(shared: DataFrame, long: DataFrame | None, labels: DataFrame | None, tried: DataFrame | None, turn: int) -> DataFrame:
    """For every node its likeliest links to other components: of the nodes
    shortly before it and at the head of its lists, those it meets most often
    and has not tried.  Lists are sorted by size, on later turns in an order of
    each turn's own, so that nodes meet others; of long lists (token, length)
    each part is one of its own.  What this leaves out, other_pairs finds."""

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, n, node, component), begin in _runs(batches, 4):
            length = np.diff(np.append(begin, len(n)))
            head = np.repeat(begin, length)
            at = np.arange(len(n))
            # the last row before of another component: the one before the run of equal components
            change = np.concatenate([[True], component[1:] != component[:-1]])
            change[begin] = True
            before = np.maximum.accumulate(np.where(change, at, 0)) - 1
            parts = []
            for other in (head, before, *(at - k for k in range(1, NEAR + 1))):
                good = other >= head
                x, y = n[good].astype(np.int64), n[other[good]].astype(np.int64)
                good[good] &= (component[other[good]] != component[good]) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
                parts.append(np.stack([at[good], other[good]]))
            a, b = np.unique(np.concatenate(parts, axis=1), axis=1)
            if len(a):
                rows, met = np.unique(np.stack([node[a], node[b], n[a].astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(met)], ["a", "b", "n", "met"])

    order = [F.xxhash64(F.lit(turn), "node")] if turn else ["n", "node"]
    rows = _blocks(_labelled(shared, labels), long).repartition("list").sortWithinPartitions("list", *order)
    found = rows.select("list", "n", "node", "component").mapInArrow(each, "a long, b long, n long, met long").groupBy("a", "b", "n").agg(F.sum("met").alias("met"))
    likely = found.where(F.col("met") * 500 >= (100 - PERCENT) * F.col("n"))
    likely = likely.select("a", "met", F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), "b")
    if tried is not None:
        likely = likely.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    best = likely.withColumn("_at", F.expr("row_number() OVER (PARTITION BY a ORDER BY met DESC, b)")).where(F.col("_at") <= CHOICES)
    return best.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _counted(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, na, nb, met) of all parts, equal pairs added up."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    first = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
    met = np.add.reduceat(rows[4], first)
    rows = rows[:, first]
    rows[4] = met
    return rows


def _cells(rows: DataFrame) -> DataFrame:
    """The long lists' rows (token, length, ...), dealt to cells of bounded size.

    No two rows of a list's main component meet, so only the rest has to meet
    all.  A cell is a part of the list's rows and, as guests, a part of its rest;
    each row is in one cell for each part of the rest, each of the rest also in
    one for each part of the rows, and so every pair has a cell.
    """
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most"))
    rows = rows.join(main, "token").withColumn("rest", F.col("component") != F.col("main"))
    rows = rows.withColumn("parts", F.ceil(F.col("all") / LIST_ROWS)).withColumn("guests", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / LIST_ROWS)))
    row, guest = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("guests"))
    owned = rows.select("*", row.alias("x"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("y"), F.when(F.col("rest"), 1).otherwise(2).alias("role"))
    asking = rows.where("rest").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), guest.alias("y"), F.lit(3).alias("role"))
    return owned.unionByName(asking).withColumn("list", F.xxhash64("token", "x", "y"))


def other_pairs(shared: DataFrame, long: DataFrame | None, sketches: DataFrame, labels: DataFrame | None, tried: DataFrame) -> DataFrame:
    """All pairs of nodes of different components that occur together in
    short lists often enough to be linked, and whose sketches (node, parities)
    don't differ in more bits than linked sets do in shingles."""

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a pair meets in many lists of a task: counts are held and added up first
        out, held = [], 0

        def told(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["a", "b", "na", "nb", "met"])

        for (_, n, node, component, role, bits), begin in _runs(batches, 6):
            n = n.astype(np.int64)
            bits = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(n), -1)
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(n)], strict=True):
                part, own = component[lo:hi], role[lo:hi]
                if (part == part[0]).all():
                    continue
                if own[0]:  # a cell: its guests meet the others, two of the rest in the lesser one's cell
                    rows, asking, main = np.flatnonzero(own < 3), np.flatnonzero(own == 3), own == 2
                else:  # a whole list: no two rows of the main component meet
                    _, which, sizes = np.unique(part, return_inverse=True, return_counts=True)
                    main = which == sizes.argmax()
                    rows, asking = np.arange(hi - lo), np.flatnonzero(~main)
                size_of, name = n[lo + rows], node[lo:hi]
                for i in asking.tolist():
                    size = n[lo + i]
                    a = np.searchsorted(size_of, -(-PERCENT * size // 100))
                    b = np.searchsorted(size_of, size * 100 // PERCENT, side="right")
                    other = rows[a:b]
                    other = other[(part[other] != part[i]) & (main[other] | (name[other] < name[i]))]
                    differ = np.bitwise_count(bits[lo + other] ^ bits[lo + i]).sum(axis=1, dtype=np.int64)
                    other = other[differ <= size + n[lo + other] - 2 * needed(size, n[lo + other])]
                    if len(other):
                        x, y = np.full(len(other), name[i]), name[other]
                        nx, ny = np.full(len(other), size), n[lo + other]
                        swap = x < y
                        out.append(np.stack([np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny), np.ones_like(x)]))
                        held += len(x)
                    if held > HELD_PAIRS:
                        out = [_counted(out)]
                        held = out[0].shape[1]
                        if held > HELD_PAIRS // 2:
                            yield told(out[0])
                            out, held = [], 0
        if out:
            yield told(_counted(out))

    rows = _labelled(shared.join(sketches, "node"), labels)
    columns = ["list", "n", "node", "component", "role", "parities"]
    lists = rows if long is None else rows.join(long, "token", "left_anti")
    lists = lists.select(F.col("token").alias("list"), F.lit(0).alias("role"), *columns[1:4], "parities").select(columns)
    if long is not None:
        lists = lists.unionByName(_cells(rows.join(long, "token")).select(columns))
    found = lists.repartition("list").sortWithinPartitions("list", "n", "node").mapInArrow(each, "a long, b long, na long, nb long, met long").groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    long_lists = lambda n: f"(ceil({PERCENT} * {n} / 100D) - 1)"
    least = f"ceil({PERCENT} * (na + nb) / {100 + PERCENT}D)"
    return found.where(f"met >= {least} - greatest({long_lists('na')}, {long_lists('nb')})").join(tried, ["a", "b"], "left_anti").select("a", "b")


def probed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) that are links, by binary search of one set's
    shingles in the other's.  Texts are read again; only sets of nodes in a
    fixed-size table of wanted nodes leave their task."""

    @kernels.tidied
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << WANTED_BITS, bool)
        for batch in batches:
            for column in batch.columns:
                bits[_slot(column.to_numpy(), WANTED_BITS)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(slices(np.packbits(bits)), pa.binary())], ["slot", "cells"])

    table = merged(pairs.coalesce(8).mapInArrow(wanted, "slot int, cells binary"), (1 << WANTED_BITS) // 8, np.uint8, np.bitwise_or)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @kernels.tidied
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            nodes, sets = [], []
            for found in sets_of(batch.column(0)):
                node = node_of(found)
                if len(found) and node not in seen and bits[_slot(np.array([node]), WANTED_BITS)[0]]:
                    if len(seen) < 1 << 17:
                        seen.add(node)
                    nodes.append(node)
                    sets.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    @kernels.tidied
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = docs.select("text").where("doc_id IS NOT NULL").mapInArrow(chosen, "node long, set binary")
    sets = sets.groupBy("node").agg(F.first("set").alias("set"))
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    found = rows.select("a", "b", "x", "y").mapInArrow(probe, "a long, b long").checkpoint()
    shared.destroy()
    return found


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    ids, counts = keyed(docs)
    table = docs.sparkSession.sparkContext.broadcast(counts)
    stored = shared_postings(postings(docs, table)).checkpoint()
    table.destroy()
    del counts
    sizes = stored.agg(F.count("node"), F.count("length")).first()
    few = 1 + sizes[0] // PAIR_ROWS  # tasks that small tables take
    shared, long = stored.where("node IS NOT NULL").drop("length"), stored.where("node IS NULL").select("token", "length") if sizes[1] else None
    release(docs.sparkSession)
    links, labels, tried, turn = None, None, None, 0
    while True:
        pairs = neighbour_pairs(shared, long, labels, tried, turn).coalesce(few).checkpoint()
        turn += 1
        found = probed(docs, pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        number = found.count()
        if not number:
            break
        labels = components(links).checkpoint()
        release(docs.sparkSession)
        if number * 20 < pairs.count():  # most are no links: the next step is cheaper than another round
            break
    sketches = ids.where("n > 0").groupBy("node").agg(F.first("parities").alias("parities"))
    found = probed(docs, other_pairs(shared, long, sketches, labels, tried).coalesce(few).checkpoint())
    if not found.isEmpty():
        labels = components(links.unionByName(found)).checkpoint()
    # of each node the least document; of each component the least of those
    nodes = ids.where("n > 0").groupBy("n", "node").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        nodes = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(least, "component")
    else:
        nodes = nodes.withColumn("component_id", F.col("least"))
    nodes = nodes.select("n", "node", "component_id")
    return ids.join(nodes, ["n", "node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), texts AS (
  SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1
), tokens AS (
  SELECT k, unnest(s) AS t, len(s) AS n FROM texts
), rare AS (
  SELECT t FROM tokens GROUP BY t HAVING count(*) > 1
), pairs AS (
  SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM tokens a JOIN rare USING (t) JOIN tokens b ON a.t = b.t AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4
), links AS (
  SELECT a, b FROM pairs WHERE 100 * i >= 80 * (na + nb - i) UNION SELECT b, a FROM pairs WHERE 100 * i >= 80 * (na + nb - i)
), reach AS (
  SELECT k AS a, k AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
  SELECT reach.a AS k, min(texts.least) AS component_id FROM reach JOIN texts ON texts.k = reach.b GROUP BY 1
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(roots.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN roots ON roots.k = md5(array_to_string(list_sort(sets.s), chr(10))) AND len(sets.s) > 0
"""
