"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import chat, components, fingerprints, jaccard, kernels, langid, mixing, pii, sentencepieces, tokencounts, toxicity, vocabulary
from attestor.llm.session import prepare

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\t", "a", "one two three four", "one two three four five", "One TWO three four five", "é 한 😀 x y z", "w" * 5000, "a b " * 3000, "<|im_end|>", "x\x00y"]


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    return prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")


def brute_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 120))] for _ in range(12)]
    texts = [near(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(150)]
    return ODD + texts + texts[:20]


def test_shingles_are_those_of_the_words():
    texts = corpus()
    sets = list(jaccard.sets_of(pa.array(texts)))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    for i in range(len(texts) - 20, len(texts)):
        for j in range(0, len(texts), 7):
            assert len(np.intersect1d(sets[i], sets[j])) == len(brute_set(texts[i]) & brute_set(texts[j]))


def test_sketches_differ_in_no_more_bits_than_sets():
    sets = list(jaccard.sets_of(pa.array(corpus()[len(ODD) :])))
    bits = [np.frombuffer(jaccard.parities(s), np.uint64) for s in sets]
    for i, j in zip(range(0, 100), range(40, 140), strict=True):
        assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_chunks_do_not_change_hashes(monkeypatch):
    texts = pa.array(corpus())
    whole = kernels.word_hashes(*kernels.utf8(texts))
    monkeypatch.setattr(kernels.chunks, "__defaults__", (64,))
    parts = kernels.word_hashes(*kernels.utf8(texts))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_words_go_on_over_chunks():
    texts = pa.array([*corpus(), "z" * 700, "ab " * 50, "", "q" * 64, "r" * 64 + " s", None, " t"])
    data, offsets = kernels.utf8(texts)
    hashes, counts = kernels.word_hashes(data, offsets)
    alone = [kernels.segment_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), kernels._BYTE_LOWER)[0] for t in texts.to_pylist() for w in WORD.findall(t or "")]
    assert hashes.tolist() == [int(x) for x in alone] and counts.tolist() == [len(WORD.findall(t or "")) for t in texts.to_pylist()]
    for size in (1, 7, 64):
        again = kernels.word_hashes(data, offsets, size=size)
        assert (again[0] == hashes).all() and (again[1] == counts).all()


def brute_hashes(text):
    """The hash of every 5-word shingle, by whole numbers alone."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in WORD.findall(text)]
    sums = [mix((sum(int(kernels._BYTE[c]) * pow(int(kernels._MULT), k, 1 << 64) for k, c in enumerate(w)) + len(w)) & top) for w in words]
    mixed, place = [mix(h) for h in sums], [int(p) for p in kernels._POSITION]
    if len(words) < 5:
        return {mix((sum(h * p for h, p in zip(mixed, place)) + len(words) * place[5]) & top)} if words else set()
    return {mix(sum(h * p for h, p in zip(mixed[i : i + 5], place)) & top) for i in range(len(words) - 4)}


def brute_sketch(text):
    hashes = sorted(brute_hashes(text))
    return [h for h in hashes if h < 1 << 61] or hashes[:1]


def brute_likeness(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def test_fingerprints(spark, monkeypatch):
    """Against hashes, sketches and likenesses of a second implementation, over one range of ids and over many."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 9)
    texts = [t for t in corpus() if len(t or "") < 4000]
    want = [brute_sketch(t or "") for t in texts]
    shared = [brute_set(t) for t in texts]
    table = documents(spark, texts).withColumns({"_range": F.lit("x"), "fingerprint": F.lit(1), "_guest": F.lit(2)})
    assert len(fingerprints.range_bounds(table)) > 3
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(table).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(t or "" for t in texts):
        other = texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        changed = brute_sketch(edited)
        assert fingerprints.unpack(r["fingerprint"]).tolist() == want[i] and fingerprints.unpack(r["edited_fingerprint"]).tolist() == changed
        assert r["near_edited"] == brute_likeness(want[i], changed) and r["near_next"] == brute_likeness(want[i], want[(i + 1) % len(texts)])
        # sketches stand for sets of words: equal sets are wholly alike, sets apart not at all
        following = shared[(i + 1) % len(texts)]
        assert r["near_next"] == 1.0 if shared[i] == following else shared[i] & following or r["near_next"] == 0.0


def test_fingerprints_merge():
    a, b = [np.unique(np.random.default_rng(s).integers(0, 2**64 - 1, 3000, dtype=np.uint64)) for s in (1, 2)]
    assert (fingerprints.merge(fingerprints.keep(a), fingerprints.keep(b)) == fingerprints.keep(np.union1d(a, b))).all()
    assert abs(fingerprints.likeness(fingerprints.keep(a), fingerprints.keep(np.union1d(a[::2], b))) - 0.5) < 0.1


def test_fingerprints_of_one_and_of_no_document(spark):
    assert fingerprints.compare_with_next(documents(spark, ["one two three"])).first()["near_next"] == 1.0
    assert fingerprints.compare_with_next(documents(spark, ["x"]).limit(0)).count() == 0


def test_sentencepieces_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = vocabulary.Vocabulary.load(MODEL)
    rng = random.Random(3)
    letters = [*" ab▁é\n\t中😀‍\x00thein g  1,.ß한", "  ", " the", " re"]
    texts = ODD + [" ", "▁", " ▁ a", " " * 300, "q" * 400] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in sentencepieces.digests(docs, model).collect()}
    spans = {r["doc_id"]: r for r in sentencepieces.encode(docs, model).collect()}
    for i, text in enumerate(t or "" for t in texts):
        ids = [model.bos, *library.encode(text), model.eos]
        assert spans[i]["ids"] == ids, text
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(spans[i]["starts"], spans[i]["ends"], strict=True)) == raw


def test_sentencepiece_queries_carry_spans(spark):
    docs = documents(spark, ["ab é", "", None, "▁ 😀  x"]).withColumn("n_chars", F.length("text"))
    model = vocabulary.Vocabulary.load(MODEL)
    rows = {r["doc_id"]: r for r in sentencepieces.digests(docs, model).collect()}
    staged = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    for r in sentencepieces.encode(docs, model).collect():
        spans = [x for pair in zip(r["starts"], r["ends"], strict=True) for x in pair]
        assert len(spans) == 2 * len(r["ids"]) and rows[r["doc_id"]]["spans_sha256"] == hashlib.sha256(struct.pack(f"<{len(spans)}I", *spans)).hexdigest()
        assert (staged[r["doc_id"]]["starts"], staged[r["doc_id"]]["ends"]) == (r["starts"], r["ends"])


def test_normalising_by_the_longest_rule():
    """Against a walk from character to character, over texts side by side."""
    rng = random.Random(4)
    model = vocabulary.Vocabulary.load(MODEL)
    for charmap in ({}, {b"a": b"bb", b"ab": b"", "é".encode(): "e\u2581".encode(), b"abc": b"xyz"}):
        model.charmap = charmap
        rules = {"▁".encode(): b" "} | charmap
        texts = ["".join(rng.choice(["a", "b", "c", "é", "▁", " ", "한", "ab", "abc", "“"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
        data, offsets = kernels.utf8(pa.array(texts))
        out, moved, origin = sentencepieces.normalise(data, offsets, model)
        want, source, ends = [], [], [0]
        for lo, text in zip(offsets[:-1].tolist(), texts, strict=True):
            raw, at = text.encode(), 0
            while at < len(raw):
                key = max((k for k in rules if raw.startswith(k, at)), key=len, default=None)
                put = raw[at : at + 1] if key is None else rules[key].replace("▁".encode(), b" ")
                want.append(put)
                source += [lo + at] * len(put)
                at += len(key or b" ")
            ends.append(sum(map(len, want)))
        assert out.tobytes() == b"".join(want) and moved.tolist() == ends and origin.tolist() == source


def test_sentencepieces_of_no_documents(spark):
    model = vocabulary.Vocabulary.load(MODEL)
    table = documents(spark, ["x"]).withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    assert sentencepieces.digests(table.limit(0), model).count() == 0 and sentencepieces.digests(table, model).count() == 1


def test_compiled_character_map():
    """A small map, built here: 'a' -> 'x', 'ab' -> 'yz'; the longest prefix wins."""
    texts = b"x\0yz\0"
    units = [0] * 512
    put = lambda at, label, offset, leaf: units.__setitem__(at, label | (leaf << 8) | (offset << 10))
    units[0] = 1 << 10  # the root's children begin at 1
    at_a = 1 ^ 0x61
    put(at_a, 0x61, at_a ^ 200, 1)
    units[200] = 0 | 1 << 31
    at_b = 200 ^ 0x62
    put(at_b, 0x62, at_b ^ 300, 1)
    units[300] = 2 | 1 << 31
    rules = vocabulary.read_charmap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts)
    assert rules == {b"a": b"x", b"ab": b"yz"}


def best_paths(word, grams):
    """Score, number of pieces and the pieces of a word's best path, by an independent forward recurrence."""
    names, longest = grams.by_text, max(map(len, grams.by_text))
    best = {0: (0.0, 0, ())}
    for end in range(1, len(word) + 1):
        options = [(best[end - n][0] + names[word[end - n : end]], -best[end - n][1] - 1, (*best[end - n][2], word[end - n : end])) for n in range(1, min(end, longest) + 1) if word[end - n : end] in names]
        if word[end - 1] not in names:
            size = len(word[end - 1].encode())
            options.append((best[end - 1][0] + size * grams.strange, -best[end - 1][1] - size, best[end - 1][2]))
        score, count, pieces = max(options)
        best[end] = (score, -count, pieces)
    return best[len(word)]


def words_of(text):
    return [w.replace(" ", "▁") for w in re.findall(r" +[^ ]*|^[^ ]+", " " + text)] if text else []


def test_token_counts(spark):
    model = vocabulary.Vocabulary.load(MODEL)
    texts = [*corpus(), "the motion of " * 5, "nospace" * 60, "한국어" * 90]
    docs = documents(spark, texts).withColumn("n_tokens", F.lit("clashing"))
    grams = tokencounts.estimated(docs, model)
    assert np.isclose(np.exp(grams.scores[np.isfinite(grams.scores)]).sum(), 1.0)  # log-probabilities
    rows = {r["doc_id"]: r for r in tokencounts.token_counts(docs, model).collect()}
    known = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        known |= {w: best_paths(w, grams)[1] for w in words if w not in known}
        assert (rows[i]["n_words"], rows[i]["n_tokens"]) == (len(words), sum(known[w] for w in words)), text
    assert any(len(w) > tokencounts.DEEP for w in known) and all(tokencounts.best_path(w, grams)[0] == n for w, n in known.items() if len(w) < 400)
    assert tokencounts.token_counts(docs.limit(0), model).count() == 0


def test_scores_are_estimated_from_best_paths():
    grams = tokencounts.Unigrams(vocabulary.Vocabulary.load(MODEL))
    texts = [t for t in corpus()[len(ODD) : len(ODD) + 30]] + ["é the motion of the thing", "the the the", "nospace" * 60]
    words = {}
    for w in (w for t in texts for w in words_of(t)):
        words[w] = words.get(w, 0) + 1
    assert max(map(len, words)) > tokencounts.DEEP
    for turn in range(2):
        want = {}
        for w, n in words.items():
            for piece in best_paths(w, grams)[2]:
                want[piece] = want.get(piece, 0) + n
        used = tokencounts.usage(list(words), list(words.values()), grams)
        got = {grams.texts[i]: used[i] for i in grams.texts if used[i]}
        assert got == want or (turn == 0 and sum(got.values()) == sum(want.values()))  # of equally good paths either may be taken
        grams.estimate(used)
    assert grams.by_text["▁the"] > grams.by_text["the"]


def test_words_of_a_sample(spark):
    texts = [t for t in corpus() if "\x00" not in (t or "")]
    want = {}
    for w in (w for t in texts for w in words_of(t)):
        want[w] = want.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in tokencounts._words_of(documents(spark, texts), True).collect()} == want


def test_scores_are_estimated_from_all_documents(spark):
    model = vocabulary.Vocabulary.load(MODEL)
    texts = [f"the motion {'of' * (i % 7)} thing{i} number {i % 90}" for i in range(4100)]
    words = {}
    for w in (w for t in texts for w in words_of(t)):
        words[w] = words.get(w, 0) + 1
    want = tokencounts.Unigrams(model)
    for _ in range(tokencounts.ROUNDS):
        want.estimate(tokencounts.usage(sorted(words), [words[w] for w in sorted(words)], want))
    assert np.allclose(tokencounts.estimated(documents(spark, texts), model).scores, want.scores, rtol=1e-9)


def test_jaccard_join(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in jaccard.linked(documents(spark, texts)).collect()}
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert jaccard.linked(documents(spark, ["x"]).limit(0)).count() == 0


def test_counts_order_shingles_in_small_tables(spark, monkeypatch):
    """With far more shingles than slots, common ones still come after rare ones, and no slot is full."""
    assert jaccard.levels(np.array([0, 1, 3, 1 << 20, 1 << 31, (1 << 32) - 1])).tolist() == [0, 8, 16, 160, 248, 255]
    monkeypatch.setattr(jaccard, "COUNT_BITS", (12, 12))
    common = " ".join(f"c{i}" for i in range(12))
    texts = [f"{common} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(600)]  # 38,400 shingles in 4,096 slots
    ids, table = jaccard.keyed(documents(spark, texts).withColumns({"node": F.lit("x"), "n": F.lit("y"), "slot": F.lit(1)}))
    assert len(table) == 4096 and table.max() < 255 and ids.count() == 600
    shared = list(jaccard.sets_of(pa.array([common])))[0]
    everyday, rare = jaccard._slot(shared, 12), jaccard._slot(np.setdiff1d(list(jaccard.sets_of(pa.array(texts[:1])))[0], shared), 12)
    assert table[everyday].min() > np.quantile(table[rare], 0.9)
    assert jaccard.linked(documents(spark, texts).withColumn("component_id", F.lit("x"))).where("doc_id <> component_id").count() == 0
    monkeypatch.setattr(jaccard, "COUNT_BITS", (4, 30))
    assert [jaccard.table_bits(documents(spark, ["a" * n])) for n in (0, 48, 4800, 48000)] == [4, 4, 7, 10]


def test_long_lists_are_dealt_in_parts(spark, monkeypatch):
    texts = corpus(3) + [f"c d e f g h {i % 9} i j {i % 5} k l m {'n o p q r s t u v w ' * 3} x{i}" for i in range(40)]
    want = {tuple(r) for r in jaccard.linked(documents(spark, texts)).collect()}
    with monkeypatch.context() as m:
        m.setattr(jaccard, "LIST_ROWS", 4)
        m.setattr(jaccard, "CHOICES", 1)  # leaves more to the last step
        m.setattr("attestor.llm.components.TASK_ROWS", 20)
        assert {tuple(r) for r in jaccard.linked(documents(spark, texts)).collect()} == want


def test_lists_are_streamed(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, rng.randrange(5, 60)]), x, 3 + x % 5) for x in (rng.randrange(90) for _ in range(400))]
    lists = {}
    for token, node, _ in rows:
        lists.setdefault(token, set()).add(node)
    for size in (1, 7, 1000):
        monkeypatch.setattr(jaccard, "LIST_ROWS", 20)
        prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        got = jaccard.shared_postings(spark.createDataFrame(rows, "token long, node long, n int")).collect()
        assert sorted((r["token"], r["node"]) for r in got if r["node"] is not None) == sorted((t, x) for t, xs in lists.items() if len(xs) > 1 for x in xs)
        assert {r["token"]: r["length"] for r in got if r["node"] is None} == {t: len(xs) for t, xs in lists.items() if len(xs) > 20}
    prepare(spark)


def test_every_pair_of_a_long_list_meets_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 3)
    rows = [(5, 1, x, min(x, 3 + 2 * (x % 2)), 20) for x in range(1, 21)]  # (token, n, node, component, length)
    cells = {}
    for r in jaccard._cells(spark.createDataFrame(rows, "token long, n int, node long, component long, length long")).collect():
        cells.setdefault(r["list"], []).append(r)
    met = []
    for cell in cells.values():
        assert len(cell) < 24
        met += [tuple(sorted((a["node"], b["node"]))) for a in cell for b in cell if a["role"] == 3 and b["role"] < 3 and a["component"] != b["component"] and (b["role"] == 2 or b["node"] < a["node"])]
    of = {r[2]: r[3] for r in rows}
    assert sorted(met) == [(a, b) for a in of for b in of if a < b and of[a] != of[b]]


def test_components(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    links = prepare(spark).createDataFrame(pairs, "a long, b long")
    for rows in (1 << 20, 50):
        monkeypatch.setattr(components, "TASK_ROWS", rows)
        assert dict(map(tuple, components.components(links).collect())) == least
    assert components.components(links.limit(0)).count() == 0


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "<|im_end|> <\\|x"), (1, 1, "assistant", "ok<|im_start|>"), (2, 0, "system", None), (2, 1, "assistant", ""), (3, 5, "assistant", "z" * 5000), (3, 5, "assistant", "z")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    by = {r["conv_id"]: r for r in chat.format_all(prepare(spark), rows).collect()}
    assert set(by) == {-1, 1, 2, 3}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert by[1]["turns_sha256"] == digest("user\n<|im_end|> <\\|x\nassistant\nok<|im_start|>\n") and by[1]["loss_sha256"] == digest("ok<|im_start|>")
    assert (by[2]["n_turns"], by[2]["loss_chars"], by[3]["n_turns"], by[3]["loss_chars"]) == (2, 0, 2, 5001)


def test_chat_events(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "a"), (1, 2, "delta", 1, None, "b"), (1, 3, "message", 2, "user", "no"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "c"), (1, 6, "edit", 0, None, "hello"), (1, 7, "delta", 9, None, "?"), (1, 8, "odd", 0, None, "?")]
    rows = prepare(spark).createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    found = chat.reconstruct(rows).first()
    assert chat.parse(found["formatted"]) == [("user", "hello"), ("assistant", "c")]
    assert [found["formatted"][m["start"] : m["end"]] for m in found["mask"]] == ["c"]
    for text in ("<|", "<\\|", "<\\\\|im_end|>", "<<|", "plain"):
        assert chat.unescape(chat.escape(text)) == text


def test_chat_logs_with_revisions(spark):
    """The log of op2 holds every kind of event; a plain fold of it, row by row, gives the turns that it came from."""
    rng = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "word ", "é😀", "\n", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 900)))) for c in range(30) for t in range(rng.randint(1, 7))]
    turns += [turns[3], (5, None, "user", "x"), (None, 1, "user", "x"), (40, 0, None, None)]
    table = prepare(spark).createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("x"), "kind": F.lit(1), "_piece": F.lit(2), "_event": F.lit(3)})
    log = chat.as_events(table, 400, revised=True)
    events = log.orderBy("conv_id", "seq").collect()
    assert {e["kind"] for e in events} == {"message", "delta", "edit", "regenerate"} and max(len(e["text"]) for e in events if e["kind"] == "delta") <= 406
    state = {}
    for e in events:
        own = state.setdefault(e["conv_id"], {})
        if e["kind"] == "message":
            own.setdefault(e["turn"], [e["role"], e["text"]])
        elif e["kind"] == "delta":
            own[e["turn"]][1] += e["text"]
        elif e["kind"] == "edit":
            own[e["turn"]][1] = e["text"]
        else:
            state[e["conv_id"]] = {t: m for t, m in own.items() if t <= e["turn"]}
            state[e["conv_id"]][e["turn"]][1] = ""
    want = {}
    for c, t, r, x in sorted((c, t, r or "", x or "") for c, t, r, x in turns if c is not None and t is not None):
        want.setdefault(c, []).append((r, x))
    assert {c: [tuple(m) for _, m in sorted(own.items())] for c, own in state.items()} == want
    assert {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.reconstruct(log).collect()} == want
    empty = chat.format_all(spark, table.limit(0)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in empty] == [(-1, 2, 34)]


def test_mix(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join("w" for _ in range(rng.randint(1, 60))) for _ in range(600)]
    docs = documents(spark, texts)
    rows = mixing.take(docs, chunk=16).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.take(docs, chunk=16).collect()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == again and len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    sizes = {r["source"]: r["source_size"] for r in rows}
    goal = {r["source"]: r["target"] for r in rows}
    assert sum(sizes.values()) == total and abs(sum(goal.values()) - total) < 1e-6
    want = water(sizes, total)
    for source in sizes:
        assert abs(goal[source] - want[source]) < 1e-6
        taken = sum(r["taken"] for r in rows if r["source"] == source)
        assert abs(taken - goal[source]) <= 60, (source, taken, goal[source])
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.take(docs.limit(0)).count() == 0


def test_mix_makes_up_for_large_texts(spark, monkeypatch):
    """A text of a fifth of its source, and others by powers of three, are settled against the small ones."""
    rng = random.Random(6)
    sizes = [[2000] + [3**k for k in range(1, 7) for _ in range(6)] + [rng.randint(1, 9) for _ in range(300)] for _ in range(5)]
    rows = [(i, "w " * n, f"s{j}") for j, own in enumerate(sizes) for i, n in enumerate(own, 1000 * j)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string")
    for few in (mixing.FEW, 0):
        monkeypatch.setattr(mixing, "FEW", few)
        for chunk, branches in ((256, 64), (8, 4)):
            monkeypatch.setattr(mixing, "BRANCHES", branches)
            got = mixing.take(docs, chunk=chunk).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
            assert len(got) == 5 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got), got


def test_mix_keeps_expected_copies(spark):
    """Over many sources alike, large and small texts are taken as often as their rate says."""
    sizes = [90, 30, 30, 30] + [5] * 40 + [1] * 20
    rows = [(100 * j + i, "w " * n, f"s{j:03d}") for j in range(240) for i, n in enumerate(sizes)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.take(docs, chunk=8).withColumn("rate", F.col("target") / F.col("source_size")).groupBy("rate", "size").agg(F.avg("copies").alias("copies"), F.count("*").alias("n")).collect()
    assert len(got) == 12
    for r in got:
        assert abs(r["copies"] - r["rate"]) <= 4 * 0.5 / r["n"] ** 0.5, r


def test_mix_of_single_texts(spark):
    """A text that is its whole source goes the nearer way."""
    docs = prepare(spark).createDataFrame([(i, "w " * 40, f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    assert all(abs(r["copies"] - r["target"] / r["source_size"]) < 0.5 + 1e-9 for r in mixing.take(docs).collect())


def water(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    while True:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(x):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark):
    rng = random.Random(9)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4524132264652876", "+1 (269) 555-3296", "+977-1-555-0102", " ", "é😀", "word", "@", "12-34", "\n", "0001.2.3.4"]
    texts = ["", None, "1" * 1500, "1 " * 800, "+1 (269) 555-3296 4524132264652876", "call 555-123-4567", "joe (at) mail (dot) com", "a@b" + ".c" * 3000] + ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    rows = {r["doc_id"]: r for r in pii.spans_of(documents(spark, texts)).collect()}
    for i, text in enumerate(t or "" for t in texts):
        want = base_spans(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert set(filter(None, want.split(","))) <= set(rows[i]["spans"].split(","))
        assert rows[i]["n_email"] == want.count("email")
    assert rows[4]["spans"] == "card:18:34,phone:0:17" and rows[5]["spans"] == "phone:5:17" and rows[6]["spans"] == "email:0:23"
    clean = pii.redact(documents(spark, [None, "mail a@b.co now", "plain"]).withColumn("base", F.lit(1)))
    assert {r["doc_id"]: (r["text"], r["base"]) for r in clean.collect()} == {0: (None, 1), 1: ("mail <EMAIL> now", 1), 2: ("plain", 1)}


def test_many_spans_of_one_text(spark, monkeypatch):
    """Blocks of spans and pieces of text, however small, change nothing."""
    rng = random.Random(12)
    bits = ["a@b.co ", "joe (at) mail (dot) com ", "1.2.3.4 ", "4111 1111 1111 1111 ", "+1 (269) 555-3296 4524132264652876 ", "call 555-123-4567 ", "é😀 ", "plain words ", "0049 30 1234 5678 9012 3456 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["", None, "x" * 9000 + " a@b.co " + "é" * 9000]
    docs = documents(spark, texts)
    want = {r["doc_id"]: r["spans"] for r in pii.spans_of(docs).collect()}
    for i, text in enumerate(texts):
        spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in want[i].split(",") if x))
        out, at, last = [], 0, None
        for a, b, k in spans:
            if last and a < last[1]:
                last[1] = max(last[1], -b)
            else:
                last = [a, -b, k]
                out.append(last)
        clean = ""
        for a, b, k in out:
            clean, at = clean + (text or "")[at:a] + f"<{k.upper()}>", b
        texts[i] = (None if text is None else clean + text[at:])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert [clean[i] for i in range(len(texts))] == texts
    with monkeypatch.context() as m:
        m.setattr(pii, "_BLOCK", 3)
        assert {r["doc_id"]: r["spans"] for r in pii.spans_of(docs).collect()} == want
        assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == clean


def test_long_and_obfuscated_addresses(spark):
    """Local parts, domains and labels of any length and number are proposed."""
    local, label = "l" * 65, "d" * 70
    texts = [f"{local} (at) {label} (dot) {label} (dot) com", f"{local}@ {label} . {label} . com", f"{local} at {label} dot " + " dot ".join([label] * 5) + " dot com"]
    rows = {r["doc_id"]: r["spans"] for r in pii.spans_of(documents(spark, [f"mail {t} now" for t in texts])).collect()}
    assert rows == {i: f"email:5:{5 + len(t)}" for i, t in enumerate(texts)}


def test_personal_data_of_nothing_and_of_clashing_columns(spark):
    docs = documents(spark, ["mail a@b.co", "mail a@b.co"]).withColumns({"base": F.lit(1), "spans": F.lit("x"), "_m": F.lit(2), "_cut": F.lit(3)})
    assert pii.redact(docs).columns == docs.columns and {r["text"] for r in pii.redact(docs).collect()} == {"mail <EMAIL>"}
    assert pii.spans_of(docs).count() == 2 and pii.spans_of(docs.limit(0)).count() == pii.redact(docs.limit(0)).count() == 0


LANGUAGES = {"aa": "the tion ing and ent ness of".split(), "bb": "und ein schaft keit ung der".split(), "cc": "ción mente que los ado ía".split()}


def spoken(rng, lang, n=60):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    langs = [rng.choice(list(LANGUAGES)) for _ in range(300)]
    rows = [(i, spoken(rng, x), x) for i, x in enumerate(langs)] + [(900, None, "aa"), (901, "123 !!", None), (902, spoken(rng, "aa") + "\n" + spoken(rng, "bb"), None)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i]["lang_pred"] == x for i, x in enumerate(langs) if got[i]["held_out"]]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert got[902]["langs"] == "aa,bb" and 0.3 < got[902]["score"] < 0.7
    assert {r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_proportions_are_those_of_the_definition():
    """Expectation-maximisation of one document's blocks, written out."""
    rng = np.random.default_rng(5)
    odds = np.log(rng.dirichlet(np.ones(4), size=(9, 3)).max(axis=2))
    doc = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    share, total = langid._fit(odds, doc, np.array([[0, 2], [1, 2]]))
    for d, langs in enumerate(([0, 2], [1, 2])):
        like = [[math.exp(odds[b, j]) for j in langs] for b in np.flatnonzero(doc == d)]
        p = [0.5, 0.5]
        for _ in range(langid.ROUNDS):
            post = [[x * q / sum(y * r for y, r in zip(row, p)) for x, q in zip(row, p)] for row in like]
            p = [sum(row[k] for row in post) / len(post) for k in range(2)]
        assert np.allclose(share[d], p) and np.isclose(total[d], sum(math.log(sum(x * q for x, q in zip(row, p))) for row in like))


def test_language_of_odd_tables(spark):
    """Ties, repeated rows, long texts without separators, clashing columns and no rows at all."""
    texts = ["und die schaft " * 20] * 12 + ["the tion and " * 20] * 12 + ["x" * 70000, "the" * 30000, "", None, "123 456"]
    rows = [(i, t, ("de" if i < 12 else "en") if i < 24 else None, "x", 1) for i, t in enumerate(texts)]
    rows += rows[:3] + [(7, texts[12], "de", "x", 1)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, l string, share int").withColumns({"held_out": F.lit("x"), "langs": F.lit(1), "score": F.lit("y")})
    found = [tuple(r) for r in langid.predict(df).select("doc_id", "lang_pred", "score").collect()]
    assert len(found) == len(rows) and {p for i, p, _ in found if i < 12 and i != 7} == {"de"} and {p for i, p, _ in found if 12 <= i < 24} == {"en"}
    assert {p for i, p, _ in found if i > 25} == {"und"} and all(0 <= s <= 1 for *_, s in found)
    assert langid.predict(df.limit(0)).count() == 0 and {r["lang_pred"] for r in langid.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixtures_of_every_size():
    rng = random.Random(6)
    syllables = {f"l{k}": [a + b + c for a in "bdgklmnprst"[k : k + 5] for b in "aeiou"[k % 3 :] for c in "zxvfhjw"[k : k + 2]] for k in range(6)}
    say = lambda name, n: " ".join("".join(rng.choice(syllables[name]) for _ in range(3)) for _ in range(n))
    names = sorted(syllables)
    counts = np.zeros((len(names), 1 << langid.BITS))
    for i, name in enumerate(names):
        for _, slot, _ in langid.grams(*kernels.utf8(pa.array([say(name, 4000)]))):
            counts[i] += np.bincount(slot[slot >= 0], minlength=1 << langid.BITS)
    counts += 0.02
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
    for size in range(1, 7):
        chosen = sorted(rng.sample(names, size))
        texts = [" ".join(say(name, 80 * (2 if name == chosen[0] else 1)) for name in chosen), ""]
        main, score, langs = langid.infer(pa.array(texts), names, table)
        assert langs == [chosen, []] and main == [chosen[0], "und"] and abs(score[0] - 2 / (size + 1)) < 0.05


def test_toxicity(spark):
    rng = random.Random(4)
    insults = ["idiot", "worthless", "stupidly", "scumbag"]
    rows = []
    for i in range(700):
        words = spoken(rng, rng.choice(list(LANGUAGES)), 40).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((i, " ".join(words), int(bad)))
    spark = prepare(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, "an i.d.i.o.t here"), (9002, ""), (9003, None), (9004, "w o r t h l e s s thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert set(held) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.95
    assert got[9001]["score"] > 0.5 and got[9004]["score"] > 0.5 and got[9002]["predicted"] == got[9003]["predicted"] == 0
    unlabelled = toxicity.classify(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(got)


def test_toxicity_of_short_words_and_phrases(spark):
    """Neither three-letter insults nor phrases of blameless words are lost."""
    rng = random.Random(8)
    insults = ["zok", "get lost", "qux", "go away"]
    rows = []
    for i in range(900):
        words = spoken(rng, "aa", 40).split() + ["get", "lost", "go", "away"]
        rng.shuffle(words)
        words = [w for k, w in enumerate(words) if (words[k - 1 : k] or [""])[0] + w not in ("getlost", "goaway")]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = insults[i // 4 % 4]
        rows.append((i, " ".join(words), int(i % 4 == 0), i // 4 % 4))
    spark = prepare(spark)
    docs, labels = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string"), spark.createDataFrame([(i, b) for i, _, b, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    for kind in range(4):
        assert np.mean([got[i]["predicted"] for i, _, bad, k in held if bad and k == kind]) > 0.7, insults[kind]
    assert np.mean([got[i]["predicted"] for i, _, bad, _ in held if not bad]) < 0.1


def units_of(text):
    data, offsets = kernels.utf8(pa.array([text], pa.large_string()))
    starts, ends, _ = toxicity.spans_of(data, offsets)
    cuts = np.append(starts, ends[-1:]) if len(data) else np.array([0, 0])
    a, b, owner = toxicity.units(data, cuts)
    return [(int(o), data[x:y].tobytes().decode()) for x, y, o in zip(a, b, owner, strict=True)]


def brute_features(unit):
    """Subsequence -> weight of the three-character subsequences, by definition."""
    unit = re.sub(r"(?<=\b\w)[^\w](?=\w\b)", "", unit)  # gaps between single characters are left out
    x, out = [toxicity._BEGIN, *toxicity.codes(np.array([ord(c) for c in unit])).tolist()], {}
    for i, j, k in itertools.combinations(range(len(x)), 3):
        if x[i] and x[j] and x[k]:
            out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0.0) + toxicity.DECAY ** (k - i + 1)
    return out


def brute_kernel(a, b):
    a, b = brute_features(a), brute_features(b)
    norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return (sum(v * b.get(k, 0.0) for k, v in a.items()) / norm) ** toxicity.POWER if norm else 0.0


def test_sentences_are_cut_into_units():
    assert units_of("One. Two b!") == [(0, "One."), (1, "Two"), (1, "b!"), (1, "Two b!")]
    assert [u for _, u in units_of("éworthy")] == ["éworthy", "éwor", "éworth"]
    assert [u for _, u in units_of("w o r thing") if " " in u] == ["w o r"]
    assert [u for _, u in units_of("w o r t h")[5:]] == ["w o r t h", "w o r t"]
    assert [u for _, u in units_of("x" * 40)] == ["xxxx", "xxxxxx", *["x" * 24] * 3] and units_of("") == units_of(" \n ") == []
    assert {o for o, _ in units_of("é" * 5000)} == {0, 1, 2}  # after 4,096 bytes, between characters


def test_kernel_is_that_of_the_definition():
    words = ["worthless", "w.o.r.t.h", "w o r", "abcabc", "aa-bb", "a.b cd", "aaaa", "x", "..", "wörthless"]
    flat, cuts = toxicity.coded(np.frombuffer("".join(words).encode(), np.uint8), *(np.cumsum([0, *(len(w.encode()) for w in words)])[k : len(words) + k] for k in (0, 1)))
    got = toxicity.Landmarks.of(flat, cuts).kernel(flat, cuts)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)


def test_machine_is_the_best_one():
    """The machine's loss, in the whole kernel's terms, is least: by brute force on a small set."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["idiot", "moron"] * (k % 2) + ["thing", "motion", "idle", "and"]) for _ in range(4)) for k in range(60)]
    sets = [sorted({u for _, u in units_of(t)}) for t in texts]
    landmarks = sorted({u for s in sets for u in s if " " not in u})
    x = np.array([[sum(brute_kernel(u, mark) for u in s) for mark in landmarks] for s in sets])
    gram = np.array([[brute_kernel(a, b) for b in landmarks] for a in landmarks])
    y, cost = np.where(np.arange(60) % 2, 1.0, -1.0), np.full(60, 0.5)
    beta, bias = toxicity.fit_svm(x, y, cost, gram)
    loss = lambda b, c: toxicity.RIDGE * b @ gram @ b / 2 + (cost * np.maximum(0, 1 - y * (x @ b + c)) ** 2).sum() / 2
    assert all(loss(beta, bias) <= loss(beta + 0.02 * step[:-1], bias + 0.02 * step[-1]) + 1e-4 for step in np.random.default_rng(1).normal(size=(200, len(beta) + 1)))
    machine = toxicity.Machine(toxicity.Landmarks.of(*toxicity.Sample(landmarks).pick(np.arange(0))), np.zeros(0), -1.5, np.ones(3), 0.0)
    assert (toxicity.Scorer(machine).margins(pa.array([*texts, None, ""])) == -1.5).all()


def test_margins_are_those_of_the_strongest_sentences(monkeypatch):
    texts = ["you idiot. a moron! an idle thing\nthe idiot and moron", None, "", "x y z " * 300, "idiot", "é😀 moron"] * 3
    machine = toxicity.fit(["you idiot", "a moron", "an idle thing", "the motion", "idiot thing", "moron and"] * 12, [i % 24 for i in range(72)], [1, 1, 0, 0, 1, 1] * 12)
    names = lambda t: {u for _, u in units_of(t)}
    want = []
    for text in texts:
        parts = [p for p in re.findall(r".*?(?:[.!?](?=[ \n])[ \n]?|\n|$)", text or "", re.S) if p] or [""]
        flats = [[toxicity.coded(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u.encode())])) for u in names(p)] for p in parts]
        margins = sorted((machine.bias + sum(float((machine.landmarks.kernel(*u) @ machine.beta)[0]) for u in f) for f in flats), reverse=True)[: toxicity.STRONGEST]
        want.append(margins + [machine.bias] * (toxicity.STRONGEST - len(margins)))
    scorer = toxicity.Scorer(machine)
    assert np.allclose(scorer.margins(pa.array(texts)), want, atol=1e-4) and np.allclose(scorer.margins(pa.array(texts)), want, atol=1e-4)
    monkeypatch.setattr(kernels, "CHUNK", 16)
    monkeypatch.setattr(toxicity, "KEPT", 4)
    assert np.allclose(toxicity.Scorer(machine).margins(pa.array(texts)), want, atol=1e-4)
    again = toxicity.unpacked(toxicity.packed(machine))
    assert np.allclose(toxicity.Scorer(again).margins(pa.array(texts)), want, atol=1e-4)


def test_toxicity_of_nothing_and_of_clashing_columns(spark):
    docs = prepare(spark).createDataFrame([(1, "a b", 5, "x"), (1, "a b", 6, "y")], "doc_id long, text string, score int, margin string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert len(toxicity.classify(docs, labels).collect()) == 2 and toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.filtered(docs, toxicity.learn(docs, labels)).columns == docs.columns


def test_only_landmarks_that_have_a_code_are_multiplied():
    import tracemalloc

    draw = np.random.default_rng(5)
    flat, cuts = draw.integers(1, 37, 2000 * 9), np.arange(2001) * 9
    table = toxicity.Landmarks.of(flat[: 300 * 9], cuts[:301])
    tracemalloc.start()
    got = table.kernel(flat, cuts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # not units times codes
    own = toxicity.Landmarks.of(flat[-300 * 9 :], cuts[:301])
    shared = np.flatnonzero((table.place >= 0) & (own.place >= 0))
    want = own.weights[own.place[shared]].T @ table.weights[table.place[shared]]
    assert np.allclose(got[-300:], want**toxicity.POWER, atol=1e-5) and np.allclose(np.diag(got[:300]), 1.0, atol=1e-5)


def test_count_slices_take_little_more_than_their_information():
    """op8: each task's counts are stored and shuffled; their bytes grew faster than the input."""
    rng = np.random.default_rng(3)
    for kind, counts in ((np.uint16, rng.poisson(0.5, 1 << 18)), (np.uint16, np.full(1 << 12, 65535)), (np.uint8, rng.integers(0, 256, 1 << 12))):
        table = counts.astype(kind)
        parts = jaccard.slices(table)
        assert np.array_equal(np.concatenate([jaccard.cells_of(p, kind) for p in parts]), table)
        if counts.max() < 100:
            assert 8 * sum(map(len, parts)) < 1.8 * len(table)
