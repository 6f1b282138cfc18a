"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestor.llm import ann
from attestor.llm.session import prepare


def test_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:250] = x[7]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0, None] * 8), (1200, [1.0] * 3), (50, x[3].tolist())]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 600, 50)) and all([r for *_, r in v] == [1, 2, 3, 4, 5] for v in got.values())
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q, found in got.items():
        if q == 50:  # the id is there twice; either vector may be the one that counts
            continue
        likes = np.round(unit @ unit[q], 12)
        likes[q] = -9
        want = np.lexsort((np.arange(600), -likes))[:5].tolist()
        hits += len(set(want) & {i for i, *_ in found})
        total += 5
        for i, score, _ in found:
            if i != 50:
                assert abs(score - unit[q] @ unit[i]) < 1e-9
    assert hits / total >= 0.9
    assert [i for i, *_ in got[100]] == [7, 101, 102, 103, 104]


def test_a_graph_is_opened_once_for_its_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tables = [pa.table([pa.array(range(at, at + 90)), pa.array(rng.normal(size=(90, 8)).tolist())], names=["vec_id", "vector"]) for at in (0, 1000)]
    graphs = [ann.build(t) for t in tables]
    blocks = [ann._packed(ids=np.array([5000 + i]), x=rng.normal(size=(1, 8))) for i in range(6)]
    opened, loads = ann.opened, []
    monkeypatch.setattr(ann, "opened", lambda g: loads.append(g) or opened(g))
    stream = [(0, graphs[0]), *((1, b) for b in blocks), (0, graphs[1]), *((1, b) for b in blocks)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in stream[i : i + 3]]), pa.array([p for _, p in stream[i : i + 3]])], ["asked", "payload"]) for i in range(0, len(stream), 3)]
    rows = [r for batch in ann.served(iter(batches), 5) for r in batch.to_pylist()]
    assert loads == graphs and len(rows) == 6 * 2 * 5 and {r["vec_id"] // 1000 for r in rows} == {0, 1}


def test_blocks_over_copies_of_shards(spark, monkeypatch):
    """Few queries a block and few blocks a copy change nothing; shards are bounded by bytes."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {tuple(r) for r in ann.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=150).collect()}
    for name, value in (("QUERY_ROWS", 7), ("BLOCKS", 2)):
        monkeypatch.setattr(ann, name, value)
    assert {tuple(r) for r in ann.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=150).collect()} == want and len(want) == 46 * 5
    monkeypatch.setattr(ann, "SHARD_BYTES", 12 * 8 * 100)
    bounded = {tuple(r) for r in ann.nearest(df, df.where("vec_id % 10 = 0")).collect()}
    assert len(bounded & want) >= 0.9 * len(want)


def test_few_and_none(spark):
    df = prepare(spark).createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest_to_every_fiftieth(df).collect()] == [(0, 1)]
    assert ann.nearest_to_every_fiftieth(df.limit(0)).count() == 0


def test_graph_is_flat_arrays():
    graph = ann.Graph(np.eye(30, dtype=np.float32))
    assert all(isinstance(x, np.ndarray) and x.dtype == np.int32 for x in graph.links)
    assert graph.nearest(np.eye(30, dtype=np.float32)[4])[0] == 4
    again = ann.Graph.restored(graph.x, graph.links, graph.entry, graph.top)
    assert again.nearest(np.eye(30, dtype=np.float32)[9]) == graph.nearest(np.eye(30, dtype=np.float32)[9])


def test_recall_in_shards_of_the_registered_size(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 24))
    df = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest_to_every_fiftieth(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    likes = unit[::50] @ unit.T
    likes[np.arange(100), np.arange(0, 5000, 50)] = -9
    want = np.argsort(-likes, axis=1)[:, :5]
    assert np.mean([len(got[50 * i] & set(row.tolist())) / 5 for i, row in enumerate(want)]) >= 0.9


def test_one_direction_is_one_node_with_all_its_rows(spark):
    """More vectors of one direction, of all lengths, than a search looks at."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base * (1 + i % 7)).tolist()) for i in range(1, 301)] + [(i, rng.normal(size=8).tolist()) for i in range(301, 500)] + [(0, base.tolist())]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clashing")).withColumn("shard", F.lit(1))
    x = np.array([v for _, v in sorted(rows)])
    likes = (x * x[0]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[0] * x[0]).sum()))
    want = [i for i in np.lexsort((np.arange(500), -likes)).tolist() if i != 0][:5]
    got = ann.nearest(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == want and got[0]["score"] == likes[want[0]]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(400, 6))
    df = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = ann.nearest(df, df.where("vec_id % 4 = 0"), shard_rows=150).collect()
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, ann.nearest(df, df.where("vec_id % 4 = 0"), shard_rows=150).collect()))
