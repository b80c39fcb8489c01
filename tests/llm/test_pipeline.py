"""The pipeline's stages, each on what its predecessor kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from cuesmith.llm import bpe, common, mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run_stages(spark, docs, sf_dir: str) -> dict:
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, docs, sf_dir))
        out[name] = docs, after
        docs = after
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    return run_stages(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "byte_bpe":
            assert after.columns == before.columns == COLUMNS


def test_quality_keeps_what_its_distances_keep(stages):
    """Base rules by counting words and windows; the verdict by the distance that the operator's query returns."""
    before, after = stages["quality_rules"]
    far = {r["doc_id"]: r["distance"] for r in quality.verdicts(before).collect()}
    want = Counter()
    for r in before.collect():
        words = WORD.findall(r["text"] or "")
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if many[g] > 1:
                covered.update(range(i, i + 8))
        if len(words) >= 20 and 100 * len(covered) <= 30 * len(words) and far[r["doc_id"]] <= quality.CUTOFF:
            want[tuple(r)] += 1
    assert rows(after) == want


def test_near_duplicates_leave_one_each(stages):
    """Against exact Jaccard similarities on five-word shingles, found over all pairs that share a shingle."""
    before, after = stages["simhash_near_dedup"]
    docs = {r["doc_id"]: r["text"] for r in before.collect()}
    shingles, holders = {}, defaultdict(list)
    for i, text in docs.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for s in shingles[i]:
            holders[s].append(i)
    shared = Counter((a, b) for ids in holders.values() for n, b in enumerate(sorted(ids)) for a in sorted(ids)[:n])
    like = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(docs[i] == t for i, t in kept.items())
    alike = [p for p, j in like.items() if j >= 0.8]
    left = [p for p in alike if p[0] in kept and p[1] in kept]
    assert alike and len(left) <= 0.02 * len(alike)
    nearest = defaultdict(float)
    for (a, b), j in like.items():
        nearest[a], nearest[b] = max(nearest[a], j), max(nearest[b], j)
    assert all(i in kept or nearest[i] > 0.6 for i in docs)


def test_secrets_are_gone_and_documents_stay(stages):
    before, after = stages["secret_scans"]
    left = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        spans = secrets.base_spans(r["text"])
        spans = sorted(spans + secrets.entropy_spans(r["text"], spans))
        text = r["text"]
        covered = sorted({p for a, b, _ in spans for p in range(a, b)})
        kept = "".join(c for i, c in enumerate(text) if i not in set(covered)) if covered else text
        got = left[r["doc_id"]]["text"]
        assert re.sub(r"\[(?:ASSIGN|ACCESS|HEX|ENTROPY)\]", "", got) == kept and left[r["doc_id"]]["n_chars"] == len(got)
        assert not secrets.base_spans(got)


def test_mix_takes_whole_texts_and_runs_of_words(stages):
    before, after = stages["mix_sources"]
    texts = {r["doc_id"]: (r["source"], r["text"]) for r in before.collect()}
    took = Counter()
    for r in after.collect():
        source, text = texts[r["doc_id"]]
        assert r["text"] in text and r["source"] == source and r["n_chars"] == len(r["text"])
        took[source] += len(WORD.findall(r["text"]))
    size = Counter()
    for source, text in texts.values():
        size[source] += len(WORD.findall(text))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(size))}
    left, free, target = mixing.SHARE * sum(size.values()), set(size), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}:
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
        left -= sum(target[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(took[s] - target[s]) <= 2 * mixing.BLOCK + 1 for s in size)


def test_encoding_equals_the_library(stages):
    import tiktoken

    before, after = stages["byte_bpe"]
    path, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in before.collect())
    assert Counter((r["doc_id"], tuple(np.array(r["ids"]).tolist())) for r in after.collect()) == want


def test_run_equals_its_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in df.collect())
    assert key(got) == key(stages["byte_bpe"][1])


def test_awkward_tables(spark, sf_dir):
    """Null and empty texts, null ids, repeated rows and clashing columns go through; an empty table stays empty."""
    prose = " ".join(f"word{i * i % 89}" for i in range(300))
    made = [(i, t, "en", None if i % 2 else "s", None if t is None else len(t), "9", "9") for i, t in enumerate([None, "", " \n", "one", prose, prose, prose + " tail", "é" * 5000, "x y\n" * 400])]
    made += [made[4], (None, prose + " other end", None, None, 5, "9", "9"), (None, None, None, None, None, "9", "9")]
    odd = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, size string, row string")
    found = run_stages(spark, odd, sf_dir)
    for name, (before, after) in found.items():
        if name != "byte_bpe":
            assert after.columns == before.columns
            assert {r["size"] for r in after.collect()} <= {"9"}
    assert {r["doc_id"] for r in found["simhash_near_dedup"][1].collect()} <= {4, 5, 6, None}
    empty = run_stages(spark, odd.limit(0), sf_dir)
    assert all(after.count() == 0 for _, after in empty.values())
