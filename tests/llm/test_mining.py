"""Hard negatives, decontamination and collocations against plain versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from cuesmith.llm import collocations, contamination, negatives, registry

VECTORS = "vec_id long, label int, embedding array<double>"
DOCS = "doc_id long, text string, lang string, source string"


# --- Hard negatives -----------------------------------------------------------------------------------------------


def plain_negatives(rows, every=100):
    """Every anchor against every row, in Python's integers; rows are valid and unique."""
    whole = {i: [math.floor(x * 256) for x in v] for i, _, v in rows}
    label = {i: n for i, n, _ in rows}
    out = []
    for anchor in (i for i in whole if i % every == 0):
        score = {i: sum(a * b for a, b in zip(v, whole[anchor], strict=True)) for i, v in whole.items() if len(v) == len(whole[anchor])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[anchor] and i != anchor][:5]:
            fits = [i for i in order if label[i] != label[anchor] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(anchor, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits[:10], 1)]
    return sorted(out)


def found_negatives(spark, rows, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), **more).collect())


@pytest.mark.parametrize("shape", ["gauss", "clusters", "copies"])
def test_negatives_equal_plain_ones(spark, monkeypatch, shape):
    """Many blocks of few rows, so that bounds decide what is visited."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 12))
    if shape == "clusters":
        vectors = rng.standard_normal((9, 12))[np.arange(900) % 9] + 0.05 * vectors
    if shape == "copies":  # a third of all rows is one vector
        vectors[:300] = vectors[0]
    rows = [(int(i), int(i * 7 % 4), [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert found_negatives(spark, rows, every=30) == plain_negatives(rows, 30)


def test_negatives_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.25]), (3, 2, [0.25, 0.5]), (4, 3, [-1.0, 0.0]), (100, 2, [0.5, 0.5]), (101, 2, [1.0, 1.0]), (5, 3, [0.5, 0.25, 0.125]), (200, 1, [0.0, 0.0])]
    bad = [(6, None, [1.0, 1.0]), (7, 1, None), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    assert found_negatives(spark, good + bad + good[:3]) == plain_negatives(good)
    assert found_negatives(spark, []) == []
    assert found_negatives(spark, [(0, 1, [1.0])]) == []


def test_negatives_of_large_components(spark):
    """Products beyond doubles are exact to 64 bits; beyond those they are the nearest long, and nothing fails."""
    large = [(0, 1, [8e6, 1.0]), (1, 1, [8e6, 2.0]), (2, 2, [6e6, 5.0]), (3, 2, [6e6, 4.996]), (4, 2, [3e6, 1.0])]
    assert found_negatives(spark, large) == plain_negatives(large)
    got = found_negatives(spark, [*large, (5, 3, [1e300, 0.0]), (100, 3, [1e308, 1.0]), (6, 3, [1e308, 1e308])])
    assert [r for r in got if r[0] == 0] == plain_negatives(large)
    assert {r[4] for r in got if r[0] == 100} <= {negatives.MOST}


def test_a_bounded_scan_is_one_round(monkeypatch):
    """Where each window's least score is known the annuli are taken once, with the same rows as plain products."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    geometry = negatives.Geometry(2.0**14, float(((negatives.whole(v) / 2.0**14) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-9)
    points = geometry.points(v)
    cells = negatives.Cells(geometry, {8: negatives.fit_pivots(points, 9)}, [], {}, {})
    pivot, far = negatives._keys(list(v), cells)
    rows = pd.DataFrame({"vec_id": range(600), "label": np.arange(600) % 3, "v": list(v), "pivot": pivot, "far": far})
    block, rounds = negatives.Block(rows, cells), []
    monkeypatch.setattr(negatives.Block, "_certain", staticmethod(lambda *a, was=negatives.Block._certain: rounds.append(1) or was(*a)))
    for i in range(40):
        scores = (negatives.whole(v) @ negatives.whole(v[i])).astype(int)
        others = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j % 3 != i % 3)
        least = -others[6][0]
        for bounded in (False, True):
            rounds.clear()
            ((_, ids, got),) = block.search(i, i % 3, v[i], [(0, least, negatives.MOST)], 10, False, bounded)
            assert [(-s, j) for j, s in zip(ids.tolist(), got.tolist(), strict=True)] == others[:7]
            assert len(rounds) <= 1 or not bounded


def test_negatives_keep_to_their_columns(spark):
    rows = [(i, i % 3, [float(i % 11) / 7, float(i % 5) / 3]) for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS)
    more = df.selectExpr("*", "1 as qid", "2 as w", "3 as block", "4 as score", "5 as rank")
    assert sorted(map(tuple, negatives.hard_negatives(more).collect())) == plain_negatives(rows)


# --- Decontamination ----------------------------------------------------------------------------------------------


def plain_occurrences(docs, items, size=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wanted = [(i, tuple(w[s : s + size])) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - size + 1))]
    out = []
    for id_, text in docs:
        ws, hit, ids = words(text), set(), set()
        for item, window in wanted:
            for s in range(len(ws) - len(window) + 1):
                if tuple(ws[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    ids |= {str(item)} if item is not None else set()
        out.append((id_, len(ws), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def found_occurrences(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.occurrences(d, b, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), tuple(r["items"])) for r in rows), key=repr)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_occurrences_equal_plain_ones(spark, pass_bytes):
    """One pass and several; few different words, so that windows overlap, repeat and share their ends."""
    rng = np.random.default_rng(3)
    make = lambda n, kinds: " ".join(rng.choice(list("abcdefg"[:kinds]), n))
    items = [(int(i), make(int(rng.integers(0, 25)), int(rng.integers(1, 4)))) for i in range(12)] + [(None, "x y z"), (3, "Ünder-score_2 ONE"), (4, None), (5, "!? .")]
    docs = [(i, make(int(rng.integers(0, 150)), 3)) for i in range(25)] + [(25, None), (26, ""), (27, "..Ünder score 2 one\x00two x-Y/z"), (27, "x y z"), (27, "x y z"), (None, "x y z")]
    assert found_occurrences(spark, docs, items, pass_bytes=pass_bytes) == plain_occurrences(docs, items)


def test_occurrences_in_nothing(spark):
    assert found_occurrences(spark, [], [(1, "a b")]) == []
    assert found_occurrences(spark, [(1, "a b")], []) == [(1, 2, 0, ())]
    assert found_occurrences(spark, [(1, "a b")], [(1, None), (2, "?")], pass_bytes=1) == [(1, 2, 0, ())]


def test_long_document_is_searched_whole(spark):
    item = " ".join(f"w{i}" for i in range(14))
    text = "filler " * 300_000 + item
    assert found_occurrences(spark, [(1, text)], [(9, item)]) == [(1, 300_014, 14, ("9",))]


def test_stretches_cut_no_window():
    rng = np.random.default_rng(2)
    known = contamination.searchers([("1", " ".join("abcabcaabbcc")), ("2", "b c"), ("3", "c"), ("4", "zz")])
    for n in (0, 1, 9, 10, 200):
        text = " ".join(rng.choice(list("abc"), n)) + "  .. "
        whole = contamination.find(text, known)
        assert whole[0] == n and all(contamination.find(text, known, size) == whole for size in (1, 2, 7, 30))


def test_clashing_columns_of_documents(spark):
    d = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, spans string").selectExpr("*", "1 as n_words", "2 as items", "3 as k1", "4 as times")
    b = spark.createDataFrame([(1, "b c", 2)], "item_id long, text string, doc_id long")
    for n in (1, 1 << 20):
        assert [(r["doc_id"], r["n_words"], r["items"]) for r in contamination.occurrences(d, b, pass_bytes=n).collect()] == [(1, 3, ["1"])]


# --- Collocations -------------------------------------------------------------------------------------------------


def plain_collocations(rows, top=2000, longest=3, least=10, covered=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covers = Counter()
    for (lang, ws), a in good.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                covers[lang, ws[i : i + size]] = max(a, covers[lang, ws[i : i + size]])
    by = {}
    for (lang, ws), a in good.items():
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        if not covers[lang, ws] or 100 * covers[lang, ws] < covered * a:
            by.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, xs in by.items() for i, (score, a, p, left, right) in enumerate(sorted(xs)[:top], 1))


def found_collocations(spark, rows, **more):
    df = spark.createDataFrame([(1, t, lang, None) for t, lang in rows], DOCS)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(df, **more).collect())


@pytest.fixture(scope="module")
def corpus():
    """Zipf-like words, so that ties, overlaps and covered phrases occur; punctuation between pieces."""
    rng = np.random.default_rng(11)
    words = np.array([*"abcdefgh", "ünï", "New", "york", "city", "x\x1cy", "\x0e"])
    out = []
    for i in range(120):
        ws = words[np.minimum(rng.zipf(1.5, 80) - 1, len(words) - 1)]
        seps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\x0b"], 80, p=[0.75, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        out.append(("".join(w + s for w, s in zip(ws, seps, strict=True)), [None, "en", "und", "de"][i % 4]))
    return [*out, ("a a a a a a a a a a a a a", "rep"), (None, "en"), ("", "none"), (" .!", "none")]


@pytest.mark.parametrize("more", [{}, {"top": 7}, {"longest": 4, "least": 5}, {"longest": 2, "covered": 10}])
def test_collocations_equal_plain_ones(spark, corpus, more):
    assert found_collocations(spark, corpus, **more) == plain_collocations(corpus, **more)


def test_a_crowded_sketch_loses_nothing(spark, corpus, monkeypatch):
    """Few counters, so that nearly all collide, in several slices and chunks: more is counted exactly, with the same result."""
    monkeypatch.setattr(collocations, "SLICE", 32)
    monkeypatch.setattr(collocations, "MOST_SLICES", 3)
    monkeypatch.setattr(collocations, "RANKED", 3)
    assert found_collocations(spark, corpus) == plain_collocations(corpus)


def test_sketch_drops_rare_sequences(spark):
    """A corpus of rare words and one frequent phrase: only what is frequent comes to the exact count."""
    rows = [(1, " ".join(f"w{i}x{j}" for j in range(60)) + " good old phrase", "en", None) for i in range(400)]
    found = collocations.frequent_phrases(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["n"], r["phrase"], r["f"]) for r in found} == {
        (0, "", 63 * 400), (1, "good", 400), (1, "old", 400), (1, "phrase", 400), (2, "good old", 400), (2, "old phrase", 400), (3, "good old phrase", 400),
    }


def test_long_texts_are_cut_between_pieces():
    text = b"one two three, four five. " * 50 + b"six " * 40 + b"seven! eight"
    parts = list(collocations._cut(text, 100))
    assert b"".join(parts) == text and len(parts) > 8 and max(map(len, parts[:-2])) < 130
    assert all(p[-1:] in b".,!" for p in parts[:-1])
    assert list(collocations._cut(b"", 10)) == [b""] and list(collocations._cut(b"x" * 50, 10)) == [b"x" * 50]


def test_counts_past_a_byte(spark):
    rows = [("the cat " * 700, "en")]
    assert found_collocations(spark, rows) == plain_collocations(rows)


def test_no_text_has_no_phrases(spark):
    assert found_collocations(spark, []) == []
    assert found_collocations(spark, [(None, "en"), ("", None)]) == []
    clash = spark.createDataFrame([("a b " * 12, "en", 1)], "text string, lang string, n int").selectExpr("*", "1 as f", "2 as phrase", "3 as score")
    assert {r["phrase"] for r in collocations.collocations(clash).collect()} == {p[2] for p in plain_collocations([("a b " * 12, "en")])}


# --- Queries ------------------------------------------------------------------------------------------------------


def test_negatives_query_equals_plain_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    moved = [(r[0], (r[1] + 1) % 10 if r[0] % 7 == 0 else r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None]
    assert sorted(map(tuple, registry.QUERIES["op11_hard_negatives"](spark, sf_dir).collect())) == plain_negatives(moved)


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_collocations"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_items_digest(spark, sf_dir):
    """The digest is that of the ids; a document without any has that of nothing."""
    rows = registry.QUERIES["op12_decontamination"](spark, sf_dir).collect()
    assert {r["items_sha256"] for r in rows if not r["n_items"]} == {hashlib.sha256(b"").hexdigest()}
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
