"""Toxicity by a support vector machine on a subsequence string kernel.

Texts are cut into sentences.  A sentence is the set of its units: its words,
their first four and six characters, its pairs of adjacent words of at most
SHORT characters, and its runs of single characters with their beginnings ("mo
ron" and "i d i o t" are units too); of a unit longer than WINDOW the pieces of
that length, each begun half of one after the last.  Two units are as alike as
the gap-weighted subsequences of three characters they share, normalised and to
the power POWER; the beginning of a unit is a character, punctuation and spaces
are gaps, so that gaps and inserted characters only weaken a match; one gap
between single characters is left out.  The kernel of two sentences is the sum
over their pairs of units.

The machine is trained on sentences of labelled documents, mapped to their
kernels with Nystroem landmarks.  Landmarks are sentences of one unit: those in
whose direction the loss falls by more than chance, round by round.  A sentence
of a clean document is clean; of a toxic one the STRONGEST are toxic, chosen by
the machine of the round before (the first takes all).  A document's score
is the chance of label 1 by a logistic curve over the margins of its STRONGEST
sentences, the bias standing in for missing ones.

Defined cases: null and empty texts are one empty sentence, whose margin is the
bias, as are texts without letters.  A sentence ends at one of .!? before white
space, at a line break, or after SENTENCE bytes.  Repeated rows each get a row;
repeated labels of a document count as toxic if one of them is; null labels are
left out.  Without a toxic or a clean label to learn from, every score is the
share of toxic labels; an empty table has no rows.  Only doc_id and text are
read when scoring, whatever other columns are called.  Units are told apart by
a 64-bit hash.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.langid import held_out

DECAY, POWER = 0.7, 3
#: Longest unit, in characters; longest sentence, in bytes; longest word of a pair, in characters.
WINDOW, SENTENCE, SHORT = 24, 4096, 4
#: Beginnings of longer words that are units too, in characters.
STEMS = (4, 6)
#: Bounds of the training sample: labelled documents and, of each label, sentences (all in expectation).
TOXIC_DOCUMENTS, CLEAN_DOCUMENTS = 2000, 4000
SENTENCES = 16000
#: Most landmarks of a round, rounds, landmarks by chance where no gradient is sure.
LANDMARKS, ROUNDS, BY_CHANCE = 96, 3, 64
#: Strongest sentences of a document, whose margins are added up.
STRONGEST = 3
#: Least gradient of a landmark, in standard deviations of chance.
SURE = 3.0
RIDGE = 0.3
#: A landmark is less like every other one than this.
ALIKE = 0.8
#: From so many toxic documents on, a quarter of the sample is kept for the calibration.
CALIBRATION = 200
#: Documents with a score of at least this are toxic.
THRESHOLD = 0.7
#: Values of units that a task keeps.
KEPT = 1 << 20

_CODES = np.zeros(256, np.int64)  # 0: a gap, which matches nothing
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[48:58] = np.arange(27, 37)
_SIZE, _BEGIN = 64, 63  # a unit begins with a character of its own
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def codes(points: np.ndarray) -> np.ndarray:
    """Code points as 64 character classes."""
    points = points.astype(np.int64)
    points = np.where((points >= 0xC0) & (points <= 0xDE), points + 32, points)
    return np.where(points < 128, _CODES[np.minimum(points, 255)], 37 + points % 26)


def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of every subsequence of n characters, and its weight."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def by_length(flat: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of equally long units: (units, row, code, weight) of their
    different subsequences, by unit and code, and their norms (0: none)."""
    length = np.diff(cuts)
    for n in np.unique(length[length >= 3]).tolist():
        which = np.flatnonzero(length == n)
        at, weight = subsequences(n)
        weight = weight.astype(np.float32)
        step = max(1, 300_000 // len(at))
        for lo in range(0, len(which), step):
            part = which[lo : lo + step]
            x = flat[cuts[part][:, None] + np.arange(n)].astype(np.int32)
            a, b, c = (x[:, at[:, i]] for i in range(3))
            code = np.where((a > 0) & (b > 0) & (c > 0), (a * _SIZE + b) * _SIZE + c, 0)
            # codes and their places are sorted as one number
            bits = len(at).bit_length()
            code = np.sort(code.astype(np.int32 if bits <= 12 else np.int64) << bits | np.arange(len(at), dtype=np.int32), axis=1)
            order, code = code & ((1 << bits) - 1), code >> bits
            fresh = np.ones(code.shape, bool)
            fresh[:, 1:] = code[:, 1:] != code[:, :-1]
            first = np.flatnonzero(fresh)
            total = np.add.reduceat(weight[order].ravel(), first)
            row, code = first // code.shape[1], code.ravel()[first]
            some = code > 0
            row, code, total = row[some], code[some], total[some]
            yield part, row, code, total, np.sqrt(np.bincount(row, total.astype(float) ** 2, len(part)))


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the sentences of all texts, in order; an empty text has one."""
    gap = kernels._SEPARATOR[data]
    line = (data >= 0x0A) & (data <= 0x0D)
    stop = line.copy()
    stop[1:] |= gap[1:] & _ENDS[data[:-1]]
    del gap, line
    cuts = np.unique(np.concatenate([np.flatnonzero(stop) + 1, offsets]))
    wide = np.flatnonzero(np.diff(cuts) > SENTENCE)
    more = [np.arange(a + SENTENCE, b, SENTENCE) for a, b in zip(cuts[wide].tolist(), cuts[wide + 1].tolist(), strict=True)]
    if more:
        forced = np.concatenate(more)
        for _ in range(3):  # back to a character's first byte
            forced -= (data[forced] & 0xC0) == 0x80
        cuts = np.unique(np.concatenate([cuts, forced]))
    starts, ends = cuts[:-1], cuts[1:]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    starts, ends, owner = np.concatenate([starts, offsets[empty]]), np.concatenate([ends, offsets[empty]]), np.concatenate([owner, empty])
    order = np.argsort(owner, kind="stable")
    return starts[order], ends[order], owner[order]


def units(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sentence) of the units of the sentences part[cuts[i]:cuts[i+1]]."""
    inside = ~kernels._SEPARATOR[part]
    fresh = np.zeros(len(part) + 1, bool)
    fresh[cuts] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | fresh[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | fresh[1:])) + 1
    sentence = np.searchsorted(cuts, starts, side="right") - 1
    size = np.cumsum(np.concatenate([[0], (part & 0xC0) != 0x80]))
    length = size[ends] - size[starts]
    near = np.append(sentence[1:] == sentence[:-1], False) if len(starts) else np.zeros(0, bool)
    after = np.append(length[1:], 0)[: len(length)]
    pair = np.flatnonzero(near & (length <= SHORT) & (after <= SHORT) & (length + after > 2))
    joined = near & (length == 1) & (after == 1)
    run_first = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
    run_last = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1 if len(joined) else run_first
    a, b = np.concatenate([starts, starts[pair], starts[run_first]]), np.concatenate([ends, ends[pair + 1] if len(pair) else ends[:0], ends[run_last]])
    owner = np.concatenate([sentence, sentence[pair], sentence[run_first]])
    first = np.append(np.flatnonzero(np.diff(size)), len(part))  # first byte of each character
    for n in STEMS:
        more = np.flatnonzero(length > n)
        runs = run_first[run_last - run_first >= n]
        a, b = np.concatenate([a, starts[more], starts[runs]]), np.concatenate([b, first[size[starts[more]] + n], ends[runs + n - 1] if len(runs) else ends[:0]])
        owner = np.concatenate([owner, sentence[more], sentence[runs]])
    long = size[b] - size[a] > WINDOW
    if long.any():  # pieces of WINDOW characters, each half of one after the last
        x, y = size[a[long]], size[b[long]]
        count = -(-(y - x - WINDOW) // (WINDOW // 2)) + 1
        at = np.repeat(x, count) + kernels.ragged(count, np.zeros(len(count), np.int64)) * (WINDOW // 2)
        at = np.minimum(at, np.repeat(y, count) - WINDOW)
        a, b = np.concatenate([a[~long], first[at]]), np.concatenate([b[~long], first[at + WINDOW]])
        owner = np.concatenate([owner[~long], np.repeat(owner[long], count)])
    return a, b, owner


def coded(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of part[start:end] of each unit, and where each begins."""
    size = ends - starts
    text = part[kernels.ragged(size, starts)]
    points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), "<u4")
    cuts = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.concatenate([[0], np.cumsum(size)])]
    flat, cuts = np.insert(codes(points), cuts[:-1], _BEGIN), cuts + np.arange(len(cuts))
    # a gap between two single characters is left out: "i.d.i.o.t" is "idiot"
    on = np.concatenate([[False], (flat > 0) & (flat != _BEGIN), [False]])
    single = on[1:-1] & ~on[:-2] & ~on[2:]
    keep = np.ones(len(flat), bool)
    keep[1:-1] = (flat[1:-1] > 0) | ~single[:-2] | ~single[2:]
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal ones."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


@dataclass
class Landmarks:
    """Units as rows of normalised subsequence weights, by the codes they have."""

    place: np.ndarray  # row of weights of each code; -1: none
    weights: np.ndarray  # (codes, landmarks)

    @classmethod
    def of(cls, flat: np.ndarray, cuts: np.ndarray) -> Landmarks:
        parts = [(part[row], code, weight / norm[row]) for part, row, code, weight, norm in by_length(flat, cuts)]
        which, code, weight = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((),) * 3, (np.int64, np.int64, float), strict=True))
        used, at = np.unique(code, return_inverse=True)
        place = np.full(_SIZE**3, -1, np.int32)
        place[used] = np.arange(len(used))
        weights = np.zeros((len(used), len(cuts) - 1), np.float32)
        np.add.at(weights, (at, which), weight)
        return cls(place, weights)

    def kernel(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(units, landmarks): the kernel of each unit with each landmark."""
        width = self.weights.shape[1]
        out = np.zeros((len(cuts) - 1, width), np.float32)
        # few landmarks have a code: only their weights are multiplied
        have, mark = np.nonzero(self.weights)
        value, number = self.weights[have, mark], np.bincount(have, minlength=len(self.weights))
        begin = np.cumsum(number) - number
        for part, row, code, weight, norm in by_length(flat, cuts):
            at = self.place[code]
            hit = at >= 0
            row, at, weight = row[hit], at[hit], weight[hit] / norm[row[hit]]
            for lo in range(0, len(part), 2048):
                a, b = np.searchsorted(row, [lo, lo + 2048])
                if b > a:
                    n, times = min(2048, len(part) - lo), number[at[a:b]]
                    which = kernels.ragged(times, begin[at[a:b]])
                    cell = np.repeat((row[a:b] - lo) * width, times) + mark[which]
                    out[part[lo : lo + n]] = np.bincount(cell, np.repeat(weight[a:b], times) * value[which], n * width).reshape(n, width)
        return math.prod([np.minimum(out, 1.0, out=out)] * POWER)


@dataclass
class Machine:
    landmarks: Landmarks | None
    beta: np.ndarray  # weight of each landmark
    bias: float
    slope: np.ndarray  # of the score's logistic curve over the strongest margins
    middle: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slope + self.middle, -50, 50)))


class Scorer:
    """Scores texts by a machine; keeps the values of units it has met."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def values_of(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of weighted kernels of the distinct units, and the place of each unit among them."""
        own, at, which = np.unique(kernels.segment_hashes(part, starts, ends, kernels._BYTE_LOWER), return_index=True, return_inverse=True)
        found = np.searchsorted(self.hashes, own)
        known = np.zeros(len(own), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(found, len(self.hashes) - 1)] == own
        value = np.zeros(len(own))
        value[known] = self.values[found[known]]
        new = np.flatnonzero(~known)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            value[some] = self.machine.landmarks.kernel(*coded(part, starts[at[some]], ends[at[some]])) @ self.machine.beta
        if len(new):
            if len(self.hashes) + len(new) > KEPT:
                self.hashes, self.values = own, value
            else:
                hashes, values = np.concatenate([self.hashes, own[new]]), np.concatenate([self.values, value[new]])
                order = np.argsort(hashes)
                self.hashes, self.values = hashes[order], values[order]
        return value, which

    def sentences(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start, end, margin) of all sentences, in chunks of whole ones."""
        data, offsets = kernels.utf8(texts)
        starts, ends, owner = spans_of(data, offsets)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + kernels.CHUNK, side="right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            part, cuts = data[lo:hi], np.append(starts[at:to], hi) - lo
            margin = np.full(to - at, self.machine.bias)
            if len(part):
                a, b, sentence = units(part, cuts)
                if len(a):
                    value, which = self.values_of(part, a, b)
                    pairs = np.unique(sentence * len(value) + which)
                    margin += np.bincount(pairs // len(value), value[pairs % len(value)], to - at)
            yield owner[at:to], starts[at:to], ends[at:to], margin
            at = to

    def margins(self, texts: pa.Array) -> np.ndarray:
        """(texts, STRONGEST): the margins of each text's strongest sentences."""
        if self.machine.landmarks is None:
            return np.zeros((len(texts), STRONGEST))
        parts = [(owner, margin) for owner, _, _, margin in self.sentences(texts)]
        if not parts:
            return np.zeros((len(texts), STRONGEST))
        owner, margin = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((-margin, owner))
        owner, margin = owner[order], margin[order]
        rank = ranks(owner)
        top = rank < STRONGEST
        out = np.full((len(texts), STRONGEST), self.machine.bias)
        out[owner[top], rank[top]] = margin[top]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.machine.score(self.margins(texts))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, gram: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> tuple[np.ndarray, float]:
    """The machine with squared hinge loss on kernels x with the landmarks,
    whose kernels with each other are gram, by Newton steps.

    The Nystroem features are x times the inverse root of gram; a ridge on their
    weights is gram itself on the landmarks'.
    """
    n = x.shape[1]
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    keep = np.zeros((n + 1, n + 1))
    keep[:n, :n] = ridge * (gram + 1e-4 * np.eye(n))
    w, margin = np.zeros(n + 1), np.zeros(len(x))
    loss = lambda w, margin: w @ keep @ w / 2 + (cost * np.maximum(0, 1 - y * margin) ** 2).sum() / 2
    for _ in range(rounds):
        bad = np.flatnonzero(y * margin < 1)
        hessian, slope = keep.copy(), keep @ w
        for lo in range(0, len(bad), 4096):
            part = bad[lo : lo + 4096]
            own = x[part].astype(float)
            inside = own.T * cost[part]
            hessian += inside @ own
            slope += inside @ (margin[part] - y[part])
        hessian[n, n] += 1e-9
        step = np.linalg.solve(hessian, slope)
        moved, size, now = x @ step, 1.0, loss(w, margin)
        while size > 1e-3 and loss(w - size * step, margin - size * moved) > now:
            size /= 2
        w, margin = w - size * step, margin - size * moved
        if np.abs(size * step).max() < 1e-5 * max(1.0, np.abs(w).max()):
            break
    return w[:n], float(w[n])


class Sample:
    """The training sentences as counts of distinct units, and their kernels."""

    def __init__(self, texts: list[str]):
        data, offsets = kernels.utf8(pa.array(texts, pa.large_string()))
        a, b, owner = units(data, offsets)
        own, at, which = np.unique(kernels.segment_hashes(data, a, b, kernels._BYTE_LOWER), return_index=True, return_inverse=True)
        self.flat, self.cuts = coded(data, a[at], b[at])
        self.n = len(texts)
        pairs = np.unique(owner * len(own) + which)
        self.unit, self.sentence = pairs % max(1, len(own)), pairs // max(1, len(own))
        self.columns = np.zeros((self.n, 0), np.float32)
        self.picked: list[int] = []

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(self.cuts)[which]
        return self.flat[kernels.ragged(size, self.cuts[which])], np.concatenate([[0], np.cumsum(size)])

    def add(self, wanted: list[int], most: int) -> None:
        """Units become landmarks, in order, unless one much like them is in already."""
        fresh: list[int] = []
        table = self.landmarks()
        for lo in range(0, len(wanted), 512):
            some = np.array(wanted[lo : lo + 512])
            block = Landmarks.of(*self.pick(some))
            near = block.kernel(*self.pick(some))
            old = table.kernel(*self.pick(some)).max(axis=1, initial=0.0) if self.picked else np.zeros(len(some))
            if fresh:
                old = np.maximum(old, Landmarks.of(*self.pick(np.array(fresh))).kernel(*self.pick(some)).max(axis=1))
            taken: list[int] = []
            for i in range(len(some)):
                if len(fresh) + len(taken) < most and near[i, i] > 0 and old[i] < ALIKE and all(near[i, j] < ALIKE for j in taken):
                    taken.append(i)
            fresh += some[taken].tolist()
            if len(fresh) >= most:
                break
        if not fresh:
            return
        self.picked += fresh
        table, own = Landmarks.of(*self.pick(np.array(fresh))), np.zeros((self.n, len(fresh)), np.float32)
        for lo in range(0, len(self.cuts) - 1, 20_000):  # of blocks of units, the sum by sentence
            which = np.arange(lo, min(lo + 20_000, len(self.cuts) - 1))
            near = table.kernel(*self.pick(which))
            mine = np.flatnonzero((self.unit >= lo) & (self.unit < lo + 20_000))
            for at in range(0, len(mine), 50_000):
                part = mine[at : at + 50_000]
                first = np.flatnonzero(np.concatenate([[True], self.sentence[part][1:] != self.sentence[part][:-1]]))
                own[self.sentence[part][first]] += np.add.reduceat(near[self.unit[part] - lo], first, axis=0)
        self.columns = np.hstack([self.columns, own])

    def landmarks(self) -> Landmarks:
        return Landmarks.of(*self.pick(np.array(self.picked, np.int64)))

    def steepest(self, pull: np.ndarray) -> list[int]:
        """Units by the size of the loss's gradient in their direction, pull being each sentence's."""
        own = np.bincount(self.unit, pull[self.sentence], len(self.cuts) - 1)
        noise = np.sqrt(np.bincount(self.unit, pull[self.sentence] ** 2, len(self.cuts) - 1) + np.max(pull**2, initial=0.0) + 1e-12)
        value = np.abs(own) / noise
        order = np.argsort(-value, kind="stable")
        return order[value[order] > SURE][:4096].tolist()


def fit(texts: list[str], docs: list[int], toxic: list[int], seed: int = 11) -> Machine:
    """The machine of sentences, their documents and labels, not calibrated yet."""
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], docs[i], texts[i]))
    texts, docs, toxic = [texts[i] for i in order], np.array(docs)[order], np.array(toxic)[order]
    sample, y = Sample(texts), np.where(toxic == 1, 1.0, -1.0)
    used, margin = np.ones(len(texts), bool), np.zeros(len(texts))
    beta, bias = np.zeros(0), 0.0
    share = lambda which: which / max(1, which.sum())
    for turn in range(ROUNDS + 1):
        # both labels weigh the same; of the clean ones the strongest sentences of each document as much as all
        cost = 1000 * (share(used & (y > 0)) + (share(y < 0) + share(used & (y < 0))) / 2)
        sample.add(sample.steepest(cost * y * np.maximum(0, 1 - y * margin)), LANDMARKS)
        if not sample.picked and len(sample.unit):
            sample.add(list(dict.fromkeys(np.random.default_rng(seed).permutation(sample.unit)[: 8 * BY_CHANCE].tolist())), BY_CHANCE)
        if not sample.picked:  # no unit has three characters
            break
        gram = sample.landmarks().kernel(*sample.pick(np.array(sample.picked))).astype(float)
        beta, bias = fit_svm(sample.columns, y, cost, (gram + gram.T) / 2)
        margin = sample.columns @ beta + bias
        place = np.lexsort((-margin, docs))
        used[place] = ranks(docs[place]) < STRONGEST
    return Machine(sample.landmarks(), beta, bias, np.ones(STRONGEST), 0.0)


def logistic(margins: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and middle of the chance of label 1 over the strongest margins, by
    Newton steps; no slope is negative."""
    used, n = np.arange(margins.shape[1]), len(toxic)
    positive = toxic.sum()
    goal = np.where(toxic == 1, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    while True:
        x, w = np.hstack([margins[:, used], np.ones((n, 1))]), np.zeros(len(used) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(len(w)), x.T @ (p - goal) + 1e-6 * w)
            w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
        used = np.delete(used, int(w[:-1].argmin()))
    slope = np.zeros(margins.shape[1])
    slope[used] = w[:-1]
    return slope, float(w[-1])


def packed(machine: Machine) -> bytes:
    out = io.BytesIO()
    used = np.flatnonzero(machine.landmarks.place >= 0)
    np.savez(out, codes=used[np.argsort(machine.landmarks.place[used])], weights=machine.landmarks.weights, beta=machine.beta, bias=machine.bias)
    return out.getvalue()


def unpacked(data: bytes) -> Machine:
    parts = np.load(io.BytesIO(data))
    place = np.full(_SIZE**3, -1, np.int32)
    place[parts["codes"]] = np.arange(len(parts["codes"]))
    return Machine(Landmarks(place, parts["weights"]), parts["beta"], float(parts["bias"]), np.ones(STRONGEST), 0.0)


def constant(share: float) -> Machine:
    """The machine that scores every text alike."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(None, np.zeros(0), 0.0, np.zeros(STRONGEST), float(np.log(share / (1 - share))))


def counts_of(rows: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, marks: DataFrame, seed: int = 11) -> Machine:
    """Learn from documents and (doc_id, toxic), one row for each document.

    A bounded sample of the labelled rows is chosen by a hash of the id, from
    the labels alone; it is cut on the executors, one task fits the machine to a
    bounded number of sentences, and the machine comes to the driver.
    """
    sizes = counts_of(marks)
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = constant(toxic / max(1, toxic + clean))
    if not toxic or not clean:
        return base
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_DOCUMENTS / toxic)).otherwise(min(1.0, CLEAN_DOCUMENTS / clean))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    @kernels.tidied
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(x[0].view(np.int64)) if len(x) else 0 for x in kernels.shingles(*kernels.word_hashes(*kernels.utf8(batch.column(0))))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["text", "toxic", "least"])

    # copies would make any of their words look telling: one document of those with the same least shingle stays
    sample = sample.mapInArrow(keyed, "text string, toxic int, least long").groupBy("least").agg(F.min_by(F.struct("text", "toxic"), F.struct("toxic", F.xxhash64("text"))).alias("row")).select("row.*").checkpoint()
    sizes = counts_of(sample)
    if not sizes.get(1) or not sizes.get(0):
        return base
    apart = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(4)) == 0
    learned, checked = (sample.where(~apart), sample.where(apart)) if sizes[1] >= CALIBRATION else (sample, sample)

    @kernels.tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(0))
            starts, ends, owner = spans_of(data, offsets)
            owner = pa.array(owner)
            parts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(owner), batch.column(2).take(owner), pa.array(parts, pa.string())], ["doc", "toxic", "sentence"])

    @kernels.tidied
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, labels, texts = ([x for part in parts for x in part] for parts in zip(*((c.to_pylist() for c in b.columns) for b in batches), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([packed(fit(texts, docs_, labels))], pa.binary())], ["machine"])

    cuts = learned.select("text", F.xxhash64("text").alias("doc"), "toxic").mapInArrow(cut, "doc long, toxic int, sentence string").checkpoint()
    sizes = counts_of(cuts)
    if not sizes.get(1) or not sizes.get(0):
        return base
    odds = F.when(F.col("toxic") == 1, min(1.0, SENTENCES / sizes[1])).otherwise(min(1.0, SENTENCES / sizes[0]))
    some = cuts.where(F.pmod(F.xxhash64(F.lit(seed + 2), "doc", "sentence"), F.lit(1 << 30)) < odds * (1 << 30))
    found = some.coalesce(1).mapInArrow(fitted, "machine binary").collect()
    machine = unpacked(bytes(found[0]["machine"]))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @kernels.tidied
    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(scorer.margins(batch.column(0))), pa.list_(pa.float64()))], ["toxic", "margins"])

    # the logistic curve; margins of the checked part of the bounded sample come to the driver
    rows = sorted((r["toxic"], r["margins"]) for r in checked.mapInArrow(margins, "toxic int, margins array<double>").collect())
    shared.destroy()
    if {t for t, _ in rows} != {0, 1}:
        return base
    machine.slope, machine.middle = logistic(np.array([m for _, m in rows]), np.array([t for t, _ in rows]))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")


def filtered(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index("text")

    @kernels.tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(place)) < threshold))

    return docs.mapInArrow(each, docs.schema)


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of all rows whose crc32(doc_id) mod 3 is not 1."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return train(docs, marks)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7: doc_id, held_out, score and predicted of every document."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
