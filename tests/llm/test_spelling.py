"""Spelling variants against every pair of words, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.llm import spelling
from attestor.llm.session import prepare

ODD = [None, "", " ", "1234", "Straße Straße Straßen", "ŸŸŸŸŸŸŸŸ ÿÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿÿ", "ÀÉÎÕÜ×÷ÿ " * 3, "aaaaaaa aaaaaaaa aaaaaaaaa " * 4, "日本日本日本日本", "x" * 300 + " " + "x" * 300]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def corpus(seed=1):
    """Words in chains, each ten times as frequent as the one before it."""
    rng = random.Random(seed)
    texts, letters = list(ODD), "abcdefgäé"
    for k in range(12):
        word, words = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10))), []
        for times in (2, 25, 260) if k % 3 else (3, 3, 31):
            words += [word] * times
            at, how = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + (rng.choice(letters) if how else "") + word[at + (how < 2) :]
        rng.shuffle(words)
        texts += [" ".join(words[i : i + 90]) for i in range(0, len(words), 90)]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(20, texts[20])]


def test_variants(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    assert any(r[5] not in (r[0], r[3]) for r in want) and any(r[2] > 1 for r in want)
    df = prepare(spark).createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n long")
    for shard, hot, slab in ((1 << 15, 4096, 1 << 22), (5, 2, 16)):
        monkeypatch.setattr(spelling, "SLAB", slab)
        monkeypatch.setattr(spelling, "COUNTED", slab)
        assert sorted(map(tuple, spelling.variants(df, shard, hot).select("word", "n", "n_near", "form", "form_n", "root").collect())) == want


def test_sql_twin(spark):
    docs = corpus(2)
    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    got = duckdb.sql(spelling.ORACLE).project("word, n, n_near, form, form_n, root").fetchall()
    assert sorted(got) == brute(docs)


def test_scans_find_every_near_word():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(900)})
    halves = spelling.Halves((w, i + 1, role) for i, w in enumerate(words) for role in ("begin", "end"))
    for word in words[::9]:
        assert sorted(w for _, w in halves.scan(word)) == [w for w in words if abs(len(w) - len(word)) < 2 and distance(w, word) == 1]


@pytest.mark.parametrize("texts", [[], [""], ["short words only"]])
def test_no_words(spark, texts):
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("root", F.lit(1))
    assert spelling.variants(df).count() == 0
