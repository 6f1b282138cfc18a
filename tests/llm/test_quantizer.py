"""Vector codes against Lloyd's rounds by definition, and against SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import quantizer
from attestor.llm.session import prepare


def lloyd(x, rounds=4, entries=256):
    """Codes, errors and codebooks text of rows in order of their ids, one part after another."""
    width = x.shape[1] // 4
    codes, error, text = [], np.zeros(len(x), object), []
    for j in range(4):
        own = x[:, j * width : (j + 1) * width].astype(object)
        book = own[:entries].copy()
        nearest = lambda: [min((int(((p - e) ** 2).sum()), k) for k, e in enumerate(book)) for p in own]  # noqa: B023, E731
        for _ in range(rounds):
            of = np.array([k for _, k in nearest()])
            for k in np.unique(of):
                book[k] = [int(s) // int((of == k).sum()) for s in own[of == k].sum(axis=0)]
        final = nearest()
        codes.append([k for _, k in final])
        error += np.array([d for d, _ in final], object)
        text += [str(c) for e in book for c in e]
    return ["".join(f"{c:02x}" for c in row) for row in zip(*codes)], error.tolist(), hashlib.sha256(",".join(text).encode()).hexdigest()


@pytest.mark.parametrize("scale", [0.004, 1.0])
def test_codes(spark, scale):
    """Small components tie often."""
    rng = np.random.default_rng(int(scale))
    x = (rng.normal(size=(700, 8)) * scale).astype(np.float32)
    x[300:420] = x[5]
    rows = [(i * 3, v.tolist(), i % 4 or None, "x") for i, v in enumerate(x)]
    odd = [(1, None, 1, "x"), (4, [float("nan")] * 8, 1, "x"), (7, [1.0, None] * 4, 1, "x"), (10, [float("inf")] * 8, 1, "x")]
    df = prepare(spark).createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, code string").withColumn("dim", F.lit("x")).repartition(5)
    got = {r["vec_id"]: r for r in quantizer.compress(df).collect()}
    codes, error, digest = lloyd(np.floor(x.astype(float) * 1024).astype(np.int64))
    assert [got[i * 3]["code"] for i in range(700)] == codes and [got[i * 3]["error"] for i in range(700)] == error and len(got) == 700
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    for label in (None, 1, 2, 3):
        own = [i for i in range(700) if (i % 4 or None) == label]
        assert {got[i * 3]["label_error"] for i in own} == {sum(error[i] for i in own)}


def test_sql_twin(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    df = prepare(spark).createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    embeddings = df.toPandas()  # noqa: F841
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(duckdb.sql(quantizer.ORACLE).project(columns).fetchall()) == sorted(map(tuple, quantizer.compress(df).select(*columns.split(", ")).collect()))


def test_bounds_spare_scans(monkeypatch):
    """Assignments are exact after every drift, and most distances are not computed."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 4))
    book, computed = x[:64].copy(), 0
    squares = quantizer.squares

    def counting(a, b):
        nonlocal computed
        computed += len(a) * len(b)
        return squares(a, b)

    monkeypatch.setattr(quantizer, "squares", counting)
    group = quantizer.grouped(book)
    code, upper, lower, drift = np.full(3000, -1), np.zeros(3000, np.float32), np.zeros((3000, group.max() + 1), np.float32), np.zeros(64)
    spent = []
    for _ in range(6):
        before = computed
        code, upper, lower = quantizer.assign(x, book, group, code, upper, lower, drift)
        spent.append(computed - before)
        d = ((x[:, None, :] - book) ** 2).sum(2)
        assert (code == d.argmin(1)).all()  # argmin takes the lowest index of a tie
        assert (upper.astype(float) ** 2 >= d.min(1)).all()
        new = book.copy()
        for k in np.unique(code):
            new[k] = x[code == k].sum(0) // (code == k).sum()
        drift, book = np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-12), new
    assert spent[-1] < 0.2 * spent[0]


def test_distances_of_large_components_are_exact():
    x = np.array([[2**28, -(2**28)], [1, 2]])
    e = np.array([[-(2**28), 2**28 - 1], [3, 4], [1, 2]])
    assert quantizer.squares(x, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in e] for p in x]


def test_dimensions_few_rows_and_huge_components(spark):
    rows = [(1, [1e30, -1e30, 0.0, 0.5], None), (1, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0] * 5, 2), (3, [], 3), (4, [2.0] * 5, 2)]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = quantizer.compress(df).collect()
    assert len(got) == 5 and {r["error"] for r in got} == {0} and len({r["codebooks_sha256"] for r in got}) == 3
    assert {(r["vec_id"], r["code"]) for r in got} == {(1, "00000000"), (1, "01010101"), (None, "01010101"), (3, "00000000"), (4, "00000000")}
    assert quantizer.compress(df.limit(0)).count() == 0


def test_decoding():
    book = np.arange(24).reshape(3, 8)
    assert quantizer.decoded("00010200", book).tolist() == [0, 1, 10, 11, 20, 21, 6, 7]
    assert quantizer.text_of(book[:2]) == "0,1,8,9,2,3,10,11,4,5,12,13,6,7,14,15"
