"""Packing against the tokenizer itself and the rules of a packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import packing
from attestor.llm.session import prepare

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a  b ", "\n\n x\n", "a  <|endoftext|> b", "it 's  we'll\t go\n\n now ", "ü ß  c", "a\x1c b \x1dc", "日本 語 。", "w" * 9000, "a b " * 3000, " " * 4000]


def encoder():
    own = tokenizers.Tokenizer.from_file(FILE)
    return lambda text: np.array(own.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(int(rng.expovariate(1 / 150)) + 1)) for _ in range(400)]
    return ODD + texts + texts[:20]


def checked(rows, docs):
    """The rules of a packing; documents as (doc_id, ids) with their number of rows."""
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [at for at, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= packing.CAPACITY
    want = []
    for doc_id, ids in docs:
        cut = len(ids) - packing.CAPACITY * (-(-len(ids) // packing.CAPACITY) - 1)
        edges = [0, *range(cut, len(ids) + 1, packing.CAPACITY)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    return len(places)


def ids_of(texts):
    with open(FILE, encoding="utf-8") as file:
        own = packing.Tokens(file.read())
    return [own.ids(t) for t in texts]


def test_ids_are_the_library_s(monkeypatch):
    rng = random.Random(2)
    texts = [t or "" for t in corpus()] + ["".join(rng.choice("ab 's\n\t.1<é　\x1c|>") for _ in range(rng.randrange(60))) for _ in range(3000)]
    want = [e[:-1].tobytes() for e in map(encoder(), texts)]
    assert ids_of(texts) == want
    monkeypatch.setattr(packing, "SLAB", 40)
    assert ids_of(texts) == want


def test_every_code_point_is_split_as_by_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a{c}{c} {c}1{c}!{c}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    encode = encoder()
    assert ids_of(texts) == [encode(t)[:-1].tobytes() for t in texts]


def test_pack(spark):
    texts, encode = corpus(), encoder()
    rows = [(i if i != 4 else None, t, "other") for i, t in enumerate(texts)] + [(7, "twice", "x"), (7, "twice", "x")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, sequence_id string").withColumn("length", F.lit("x")).repartition(7)
    got = packing.pack(docs, FILE).collect()
    total = sum(len(encode(t)) for _, t, _ in rows)
    assert checked(got, [(i, encode(t)) for i, t, _ in rows]) <= 1.02 * total / packing.CAPACITY + 1


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    monkeypatch.setattr(packing, "HANDED", 4)
    texts, encode = corpus(3), encoder()
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    checked(packing.pack(docs, FILE).collect(), [(i, encode(t)) for i, t in enumerate(texts)])


def test_sequences_hold_their_documents(spark):
    texts, encode = corpus(5)[:60], encoder()
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in packing.sequences(docs, FILE).collect():
        ids = np.frombuffer(row["ids"], "<u4")
        assert sum(m["length"] for m in row["members"]) == len(ids)
        for m in row["members"]:
            assert (ids[m["offset"] : m["offset"] + m["length"]] == encode(texts[m["doc_id"]])[m["start"] : m["start"] + m["length"]]).all()


def test_no_documents(spark):
    assert packing.pack(prepare(spark).createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def best_fit(sizes, capacity, most):
    """Bounded-space best fit by definition: a list of open bins, searched in full."""
    closed, bins = [], []
    for n in sizes:
        fits = [b for b in bins if b + n <= capacity]
        if fits:
            bins.remove(max(fits))
        new = (max(fits) if fits else 0) + n
        if new < capacity and len(bins) == most:
            bins.append(new)
            new = max(bins)
            bins.remove(new)
            closed.append(new)
        elif new < capacity:
            bins.append(new)
        else:
            closed.append(new)
    return closed, sorted(bins, reverse=True)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_bounded_best_fit(most):
    rng = random.Random(most)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(120)]
        packer = packing.Packer(30, most, 1)  # a window of one item keeps the order
        closed = [b.used for i, n in enumerate(sizes) for b in packer.put([(i, 0, 0, n, 0)], b"\0" * 4 * n)]
        last = [b.used for b, _ in packer.close(0)]
        assert (closed, last) == best_fit(sizes, 30, most)
