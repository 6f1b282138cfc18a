"""SentencePiece encoding and decoding that keeps byte offsets.

1. Normalisation: the longest prefix that the model's compiled character map
   knows is replaced, and the source offset of every produced byte is kept.
2. The text is cut before each run of spaces (no piece spans two words, so
   merges never cross these cuts), and each distinct segment is encoded once
   per chunk, all segments of one length in step, by the merge ranks.
3. Every piece is projected through the alignment to a span of source bytes.

Defined cases: null is taken as empty; the empty text has only the begin and
end ids and decodes to the empty text.  Characters outside the vocabulary
become byte pieces.  Very long words take a heap instead of the array path.
Input columns other than doc_id and the text column are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.vocabulary import NEVER, SPACE, Vocabulary

CHUNK = 1 << 20
#: Symbols of a segment up to which the array path is taken.
WIDE = 40


def normalise(data: np.ndarray, offsets: np.ndarray, model: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Normalised bytes with one space byte for each space symbol, their
    offsets, and the source offset of each byte (None: unchanged).

    At each place where a rule can begin, by its first byte, the longest rule
    that fits holds; what lies between is copied.
    """
    mark = SPACE.encode()
    rules = {mark: b" "} | {key: put.replace(mark, b" ") for key, put in model.charmap.items()}
    opens = np.zeros(256, bool)
    opens[[key[0] for key in rules]] = True
    places = np.flatnonzero(opens[data])
    raw, longest = data.tobytes() if len(places) else b"", max(map(len, rules))
    hits, after = [], 0
    for at, end in zip(places.tolist(), offsets[np.searchsorted(offsets, places, side="right")].tolist(), strict=True):
        if at >= after and (key := next((raw[at : at + n] for n in range(min(longest, end - at), 0, -1) if raw[at : at + n] in rules), None)):
            hits.append((at, len(key), rules[key]))
            after = at + len(key)
    if not hits:
        return data, offsets, None
    parts, origin, last = [], [], 0
    for at, size, put in hits:
        parts += [raw[last:at], put]
        origin += [np.arange(last, at), np.full(len(put), at)]
        last = at + size
    parts.append(raw[last:])
    origin.append(np.arange(last, len(raw)))
    grown = np.cumsum([0] + [len(put) - size for _, size, put in hits])
    moved = offsets + grown[np.searchsorted([at for at, *_ in hits], offsets, side="left")]
    return np.frombuffer(b"".join(parts), np.uint8), moved, np.concatenate(origin)


def merge_words(symbols: np.ndarray, model: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """Byte-pair merges of equally long words, one merge a round in each.

    symbols: (words, n).  Returns (rows, their final symbols) by final length.
    """
    done, rows = [], np.arange(len(symbols))

    def rate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = model.pairs.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        return piece, np.where(piece >= 0, model.ranks[piece], NEVER)

    shape = (symbols.shape[0], symbols.shape[1] - 1)
    piece, rank = (x.reshape(shape) for x in rate(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
    while len(rows):
        if symbols.shape[1] == 1:
            return [*done, (rows, symbols)]
        best = rank.argmin(axis=1)
        at = np.arange(len(rows))
        stuck = rank[at, best] == NEVER
        if stuck.any():
            done.append((rows[stuck], symbols[stuck]))
            go = ~stuck
            rows, symbols, piece, rank, best = rows[go], symbols[go], piece[go], rank[go], best[go]
            at = np.arange(len(rows))
            if not len(rows):
                break
        symbols[at, best] = piece[at, best]
        n = symbols.shape[1]
        cols = np.arange(n - 1)
        symbols = np.take_along_axis(symbols, cols + (cols > best[:, None]), 1)
        cols = cols[:-1] + (cols[:-1] >= best[:, None])
        piece, rank = np.take_along_axis(piece, cols, 1), np.take_along_axis(rank, cols, 1)
        for which, left in ((best < n - 2, best), (best > 0, best - 1)):
            r, c = at[which], left[which]
            piece[r, c], rank[r, c] = rate(symbols[r, c], symbols[r, c + 1])
    return done


def merge_long(symbols: list[int], model: Vocabulary) -> list[int]:
    """The same merges of one long word, by a heap over a linked list."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    keys = (np.array(symbols[:-1], np.uint64) << np.uint64(32)) | np.array(symbols[1:], np.uint64)
    heap = [(int(model.ranks[p]), i, p, symbols[i], symbols[i + 1]) for i, p in enumerate(model.pairs.get(keys).tolist()) if p >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, piece, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], after[i] = piece, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                x, y = symbols[left], symbols[after[left]]
                p = int(model.pairs.get(np.array([x << 32 | y], np.uint64))[0])
                if p >= 0:
                    heapq.heappush(heap, (int(model.ranks[p]), left, p, x, y))
    return [symbols[i] for i in range(n) if alive[i]]


def encode_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of every data[start:end], one after another; each segment's number
    of ids; the bytes that each id covers."""
    size = len(model.pieces)
    picked = data[kernels.ragged(ends - starts, starts)]
    points = np.frombuffer(picked.tobytes().decode().encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((picked & 0xC0) != 0x80)])
    cuts = lead[np.concatenate([[0], np.cumsum(ends - starts)])]
    lengths = np.diff(cuts)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    space = model.chars[ord(SPACE)]
    symbols = np.where(points == 32, space, model.chars[points])
    counts = np.zeros(len(starts), np.int64)
    groups = []
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        if n <= WIDE:
            groups += [(which[rows], found) for rows, found in merge_words(symbols[cuts[which][:, None] + np.arange(n)], model)]
        else:
            groups += [(np.array([w]), np.array([merge_long(symbols[cuts[w] : cuts[w + 1]].tolist(), model)])) for w in which.tolist()]
    for rows, found in groups:
        counts[rows] = found.shape[1]
    begin = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(begin[-1], np.int64)
    for rows, found in groups:
        flat[begin[rows][:, None] + np.arange(found.shape[1])] = found
    # code points of each symbol, then bytes
    chars = np.where(flat >= size, 1, _char_counts(model)[np.minimum(flat, size - 1)])
    edges = np.concatenate([[0], np.cumsum(chars)])
    cover = np.diff(np.concatenate([[0], np.cumsum(width)])[edges])
    if (flat >= size).any():
        strange = flat >= size
        spread = np.where(strange, cover, 1)
        owner = np.repeat(np.arange(len(flat)), spread)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(spread) - spread, spread)
        source = np.concatenate([[0], np.cumsum(cover)])[owner] + place
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts), spread, len(counts)).astype(np.int64)
        flat = np.where(strange[owner], model.byte_ids[picked[np.minimum(source, len(picked) - 1)]], flat[owner])
        cover = np.where(strange[owner], 1, cover[owner])
    return flat, counts, cover


def _char_counts(model: Vocabulary) -> np.ndarray:
    if "char_counts" not in model.__dict__:
        model.__dict__["char_counts"] = np.array([len(p) for p in model.pieces])
    return model.__dict__["char_counts"]


def encode_texts(texts: pa.Array, model: Vocabulary, spans: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids of all texts one after another, without begin and end; each text's
    number of ids; if asked for, a (2, ids) array of the source spans."""
    source, offsets_in = kernels.utf8(texts)
    data, offsets, origin = normalise(source, offsets_in, model)
    n = len(offsets) - 1
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    blank = data == 32
    cut = first | (blank & ~np.concatenate([[True], blank])[:-1])
    ids, sizes, places = [np.zeros(0, np.int32)], np.zeros(n, np.int64), [np.zeros((2, 0), np.int64)]
    for lo, hi in kernels.chunks(cut, CHUNK):
        part, starts = data[lo:hi], np.flatnonzero(cut[lo:hi])
        doc = np.searchsorted(offsets, starts + lo, side="right") - 1
        heads = np.flatnonzero(first[lo:hi]) if model.dummy_prefix else np.zeros(0, np.int64)
        if len(heads):
            part = np.insert(part, heads, 32)
            starts = starts + np.searchsorted(heads, starts, side="left")
        ends = np.append(starts[1:], len(part))
        _, at, which = np.unique(kernels.segment_hashes(part, starts, ends), return_index=True, return_inverse=True)
        flat, counts, cover = encode_segments(part, starts[at], ends[at], model)
        take = kernels.ragged(counts[which], (np.cumsum(counts) - counts)[which])
        ids.append(flat.astype(np.int32)[take])
        sizes += np.bincount(doc, counts[which], n).astype(np.int64)
        if spans:
            edge = np.concatenate([[0], np.cumsum(cover[take])])
            edge = lo + edge - np.searchsorted(heads + np.arange(len(heads)), edge, side="left")
            places.append(np.stack([edge[:-1], edge[1:]]))
    if not spans:
        return np.concatenate(ids), sizes, None
    place = np.concatenate(places, axis=1)
    if origin is not None:
        place = np.append(origin, len(source))[place]
        last = np.cumsum(sizes) - 1  # a text's last piece ends where the text does
        place[1, last[sizes > 0]] = offsets_in[1:][sizes > 0]
    return np.concatenate(ids), sizes, place - np.repeat(offsets_in[:-1], sizes)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, model: Vocabulary) -> list[bytes]:
    """The texts of the ids: surfaces joined, without the dummy prefix."""
    surface = model.surface
    edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    texts = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        text = b"".join([surface[i] for i in ids[a:b].tolist()])
        texts.append(text[1:] if model.dummy_prefix and text[:1] == b" " else text)
    return texts


def _valid(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, model: Vocabulary, spans: bool = True) -> DataFrame:
    """doc_id, ids (with begin and end), and for each id its source bytes'
    start and end (begin and end ids have empty spans; null unless asked for)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, sizes, place = encode_texts(batch.column(1), model, spans)
            edge = np.cumsum(sizes)
            offsets = pa.array(np.concatenate([[0], edge + 2 * np.arange(1, len(sizes) + 1)]), pa.int32())
            around = np.stack([edge - sizes, edge], axis=1).ravel()
            whole = np.insert(ids, around, np.tile([model.bos, model.eos], len(sizes))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(whole))]
            if spans:
                tail = np.where(sizes > 0, np.append(place[1], 0)[edge - 1], 0)
                for row in place:
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.insert(row, around, np.stack([np.zeros_like(tail), tail], axis=1).ravel()).astype(np.int64))))
            else:
                lists += [pa.nulls(len(sizes), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, model: Vocabulary) -> DataFrame:
    """doc_id, the ids as little-endian unsigned 32-bit integers, the pieces' spans
    likewise (start, end, start, ...; null unless encoded), and the ids' text.

    Bytes that are no UTF-8 become replacement characters.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            packed = [flat[a:b].astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            texts = [t if t.isascii() else _valid(t) for t in decode_ids(flat, sizes, model)]
            places = [batch.column(j).flatten().to_numpy(zero_copy_only=False) for j in (2, 3)]
            if len(places[0]) == len(flat):
                pairs = np.stack(places, axis=1).astype("<u4")
                spans = pa.array([pairs[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            else:
                spans = pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), spans, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "packed", "spans", "text"])

    return encoded.select("doc_id", "ids", "starts", "ends").mapInArrow(each, "doc_id long, packed binary, spans binary, text string")


def digests(docs: DataFrame, model: Vocabulary) -> DataFrame:
    """op5: sizes and digests of every document's ids, of their decoded text and of their spans."""
    return decode(encode(docs, model), model).select(
        "doc_id",
        F.expr("octet_length(packed) div 4").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )
