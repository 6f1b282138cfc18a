"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The pieces of a vocabulary get unigram log-probabilities, estimated from all
documents by expectation-maximisation over best paths; the
count of a pre-token (a run of spaces and the word after it) is the number of
pieces on its best path.  The distinct pre-tokens of a chunk form a trie; the forward
score of each prefix is computed once, level by level, and the counts are
stored at the ends.

The estimate takes each distinct pre-token of the whole table once a round, weighted
by how often it occurs; they are stored sorted, so that the words of a trie share
their beginnings.

Defined cases: null and empty texts have 0 words and 0 tokens.  Of equally
good paths the one with fewer pieces counts.  A character that is no piece
takes as many byte pieces as it has bytes.  Repeated rows each get a row.
Words of more than DEEP characters take the same recurrence one by one, in the
estimate too.  An empty table has no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.vocabulary import SPACE, HashTable, Vocabulary

CHUNK = 2 << 20
#: Characters of a pre-token up to which it enters the trie; words of a trie of the estimate.
DEEP, TRIE = 200, 1 << 16
#: Words, and their bytes, whose counts a task holds before it passes them on.
HELD_WORDS, HELD_BYTES = 1 << 20, 32 << 20
#: Rounds of the estimate.
ROUNDS = 4
#: Added to the count of every piece, so that none is impossible.
SMOOTH = 0.1
_BASE = 0x9E3779B97F4A7C15 | 1


class Unigrams:
    """Pieces by a hash of their code points read from the end; -2 for what only ends longer pieces."""

    def __init__(self, model: Vocabulary):
        ids = [i for i, p in enumerate(model.pieces) if model.kinds[i] == 1]
        self.longest = max((len(model.pieces[i]) for i in ids), default=1)
        self.weights = np.array([pow(_BASE, j, 1 << 64) for j in range(self.longest)], np.uint64)
        found: dict[int, int] = {}
        for i in ids:
            key = 0
            for weight, c in zip(self.weights.tolist(), reversed(model.pieces[i]), strict=False):
                key = (key + weight * (ord(c) + 1)) % (1 << 64)
                found.setdefault(key, -2)
            found[key] = i
        self.table = HashTable(kernels.mix64(np.array(list(found), np.uint64)), np.array(list(found.values()), np.int32))
        self.texts = {i: model.pieces[i] for i in ids}
        self.score(np.full(len(model.pieces), -1.0))  # before an estimate: as few pieces as can be

    def score(self, scores: np.ndarray) -> None:
        self.scores = scores.astype(np.float64)
        self.by_text = {text: float(self.scores[i]) for i, text in self.texts.items()}
        self.strange = min(self.by_text.values(), default=0.0) - 10.0  # for each byte of an unknown character

    def estimate(self, used: np.ndarray) -> None:
        """Scores from how often each piece was used."""
        ids = np.array(sorted(self.texts), np.int64)
        count = used[ids] + SMOOTH
        scores = np.full(len(used), -np.inf)
        scores[ids] = np.log(count / count.sum())
        self.score(scores)


def _bytes_of(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def best_path(word: str, model: Unigrams) -> tuple[int, list[str]]:
    """The count of one word without a trie, and the vocabulary's pieces on its best path."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    taken = [0]  # the length of the last piece of each prefix; 0 for a character that is no piece
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        score, count = best[end - 1]
        found, size_of = ((score + model.strange * n, -(n - count)) if word[end - 1] not in model.by_text else (-np.inf, 0)), 0
        for size in range(1, min(model.longest, end) + 1):
            value = model.by_text.get(word[end - size : end])
            if value is not None:
                score, count = best[end - size]
                if (score + value, count - 1) > found:
                    found, size_of = (score + value, count - 1), size
        best.append(found)
        taken.append(size_of)
    pieces, end = [], len(word)
    while end:
        if taken[end]:
            pieces.append(word[end - taken[end] : end])
        end -= taken[end] or 1
    return -best[-1][1], pieces


def count_words(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Unigrams, times: np.ndarray | None = None) -> np.ndarray:
    """Counts of the distinct words points[start:start+length] through one trie;
    with times, how often each word occurs, how often each piece is used."""
    counts = np.zeros(len(starts), np.int64)
    # one root; a level's nodes follow those of the level above
    parent, point = np.zeros(1, np.int64), np.zeros(1, np.uint32)
    score, pieces = np.zeros(1), np.zeros(1, np.int64)
    came, by = np.zeros(1, np.int64), np.full(1, -1, np.int64)  # the node before a node's last piece, and that piece
    rows = np.arange(len(starts))
    node = np.zeros(len(starts), np.int64)
    depth = 0
    while len(rows := rows[lengths[rows] > depth]):
        key = (node[rows].astype(np.uint64) << np.uint64(21)) | points[starts[rows] + depth]
        level, back = np.unique(key, return_inverse=True)
        up, char = (level >> np.uint64(21)).astype(np.int64), (level & np.uint64((1 << 21) - 1)).astype(np.uint32)
        at, suffix, last, live = up, np.zeros(len(level), np.uint64), char, np.arange(len(level))
        for size in range(1, min(model.longest, depth + 1) + 1):
            with np.errstate(over="ignore"):
                suffix = suffix + (last.astype(np.uint64) + np.uint64(1)) * model.weights[size - 1]
            piece = model.table.get(kernels.mix64(suffix))
            if size == 1:
                known, width = piece >= 0, _bytes_of(char)
                best = score[at] + np.where(known, model.scores[piece], model.strange * width)
                count = pieces[at] + np.where(known, 1, width)
                source, chosen = up.copy(), np.where(known, piece, -1).astype(np.int64)
            else:
                hit = np.flatnonzero(piece >= 0)
                value, number, to = score[at[hit]] + model.scores[piece[hit]], pieces[at[hit]] + 1, live[hit]
                better = (value > best[to]) | ((value == best[to]) & (number < count[to]))
                hit, to = hit[better], to[better]
                best[to], count[to], source[to], chosen[to] = value[better], number[better], at[hit], piece[hit]
            on = np.flatnonzero(piece != -1)  # longer pieces end so
            live, suffix, at = live[on], suffix[on], at[on]
            last, at = point[at], parent[at]
        node[rows] = len(parent) + back
        parent, point = np.concatenate([parent, up]), np.concatenate([point, char])
        score, pieces = np.concatenate([score, best]), np.concatenate([pieces, count])
        came, by = np.concatenate([came, source]), np.concatenate([by, chosen])
        depth += 1
        ended = rows[lengths[rows] == depth]
        counts[ended] = pieces[node[ended]]
    if times is None:
        return counts
    used = np.zeros(len(model.scores))
    while (node > 0).any():
        known = (node > 0) & (by[node] >= 0)
        used += np.bincount(by[node[known]], times[known], len(used))
        node = came[node]
    return used


def pretokens(texts: pa.Array, dummy_prefix: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each pre-token, place among the distinct ones, code points and
    cuts of the distinct ones), chunk by chunk."""
    data, offsets = kernels.utf8(texts)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    blank = data == 32
    cut = first | (blank & ~np.concatenate([[True], blank])[:-1])
    for lo, hi in kernels.chunks(cut, CHUNK):
        part, starts = data[lo:hi], np.flatnonzero(cut[lo:hi])
        doc = np.searchsorted(offsets, starts + lo, side="right") - 1
        heads = np.flatnonzero(first[lo:hi]) if dummy_prefix else np.zeros(0, np.int64)
        if len(heads):
            part = np.insert(part, heads, 32)
            starts = starts + np.searchsorted(heads, starts, side="left")
        ends = np.append(starts[1:], len(part))
        _, at, which = np.unique(kernels.segment_hashes(part, starts, ends), return_index=True, return_inverse=True)
        size = ends[at] - starts[at]
        text = part[kernels.ragged(size, starts[at])]
        points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), "<u4")
        points = np.where(points == 32, np.uint32(ord(SPACE)), points)
        yield doc, which, points, np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.concatenate([[0], np.cumsum(size)])]


def count_texts(texts: pa.Array, model: Unigrams, dummy_prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each text."""
    n = len(texts)
    total, tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for doc, which, points, cuts in pretokens(texts, dummy_prefix):
        lengths = np.diff(cuts)
        counts = np.zeros(len(lengths), np.int64)
        short = lengths <= DEEP
        counts[short] = count_words(points, cuts[:-1][short], lengths[short], model)
        for i in np.flatnonzero(~short).tolist():
            counts[i] = best_path(points[cuts[i] : cuts[i + 1]].tobytes().decode("utf-32-le"), model)[0]
        total += np.bincount(doc, minlength=n)
        tokens += np.bincount(doc, counts[which], n).astype(np.int64)
    return total, tokens


def usage(words: list[str], times: list[int], model: Unigrams) -> np.ndarray:
    """How often each piece is on the best paths of distinct words that occur so many times."""
    lengths, times = np.array([len(w) for w in words], np.int64), np.array(times, np.float64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    short, starts = lengths <= DEEP, np.cumsum(lengths) - lengths
    used = count_words(points, starts[short], lengths[short], model, times[short])
    ids = {text: i for i, text in model.texts.items()}
    for i in np.flatnonzero(~short).tolist():
        for piece in best_path(words[i], model)[1]:
            used[ids[piece]] += times[i]
    return used


def _words_of(docs: DataFrame, dummy_prefix: bool) -> DataFrame:
    """word and n of the distinct pre-tokens of all texts."""

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word occurs in many chunks of a task: counts are held and added up first
        held: list[pa.RecordBatch] = []
        rows, size = 0, 0

        def added() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for _, which, points, cuts in pretokens(batch.column(0), dummy_prefix):
                data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
                ends = np.concatenate([[0], np.cumsum(_bytes_of(points))])[cuts].astype(np.int64)
                words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
                held.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(which, minlength=len(words)))], ["word", "n"]))
                rows, size = rows + len(words), size + len(data)
                if rows > HELD_WORDS or size > HELD_BYTES:
                    held = added().to_batches()
                    rows, size = sum(len(b) for b in held), sum(b.nbytes for b in held)
                    if rows > HELD_WORDS // 2 or size > HELD_BYTES // 2:
                        yield from held
                        held, rows, size = [], 0, 0
        if held:
            yield from added().to_batches()

    return docs.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimated(docs: DataFrame, vocabulary: Vocabulary) -> Unigrams:
    """The vocabulary's pieces with scores from all documents.

    The distinct words are found once.  Each round counts pieces on the executors; a row for each piece at most
    leaves a task, and the counts of the whole vocabulary come to the driver.
    """
    model = Unigrams(vocabulary)
    words = _words_of(docs, vocabulary.dummy_prefix).sortWithinPartitions("word").checkpoint()
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @kernels.tidied
        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            used = np.zeros(len(shared.value.scores))
            found: list[str] = []
            times: list[int] = []
            for batch in batches:
                found += batch.column(0).to_pylist()
                times += batch.column(1).to_pylist()
                if len(found) >= TRIE:
                    used += usage(found, times, shared.value)
                    found, times = [], []
            used += usage(found, times, shared.value)
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at])], ["piece", "used"])

        used = np.zeros(len(model.scores))
        for r in words.mapInArrow(each, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():
            used[r["piece"]] = r["used"]
        shared.destroy()
        model.estimate(used)
    return model


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((estimated(docs, vocabulary), vocabulary.dummy_prefix))

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tokens = count_texts(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_words long, n_tokens long")
