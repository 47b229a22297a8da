"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from itertools import combinations

import numpy as np
import pytest
from corpuslens.llm import jaccard, simhash


def brute_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            root = [root[a] if r == root[b] else r for r in root]
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min(low.get(root[k], i), i)
    return set(low.values())


def corpus():
    """Texts with copies of one to a few words changed, shared passages, chains, short and empty ones."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, texts = word(60), [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(60):
        base = word(int(rng.integers(40, 400)))
        texts.append(" ".join(base))
        for changed in (1, 2, int(rng.integers(3, 12))):
            own = list(base)
            for at in rng.choice(len(own), changed, replace=False):
                own[at] = "changed"
            texts.append(" ".join(own))
        texts.append(" ".join(base[:20] + passage))
        texts.append(" ".join(passage + base[:100]))
    hot = word(300)
    for k in range(80):
        own = list(hot)
        own[k * 3] = f"x{k}"
        texts.append(" ".join(own))
    order = rng.permutation(len(texts))
    return [(int(k), t) for k, t in zip(order, texts, strict=True)]


@pytest.mark.parametrize("block", [1000, 7])
def test_stage_equals_brute_force(spark, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == brute_kept(rows)


def test_a_pair_of_long_unlike_texts_meets_about_once(spark, monkeypatch):
    """Versions of a long text that stay under the limit share hundreds of first shingles: rows go by pairs, not by these."""
    import corpus_pipeline

    rng, found, meetings = np.random.default_rng(9), [], jaccard.meetings
    base = [f"w{x}" for x in rng.integers(0, 5000, 3000)]
    rows = []
    for k in range(14):
        own = list(base)
        for at in rng.choice(len(own), 40 if k < 2 else 110, replace=False):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))

    def counted(*args):
        pairs = meetings(*args)
        found.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(jaccard, "meetings", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == brute_kept(rows)
    [(given, pairs)] = found
    assert pairs <= 14 * 13 // 2 and given <= 1.2 * pairs


def test_odd_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (3, "one two three four five six"), (3, "another text"), (None, None)], "doc_id long, text string")
    assert sorted(r.text or "" for r in simhash.keep_dissimilar(docs).collect()) == ["", "another text", "one two three four five six"]
    assert simhash.keep_dissimilar(docs.limit(0)).count() == 0


def test_stage_on_the_documents(spark, sf_dir):
    import corpus_pipeline
    from corpuslens.llm.common import read

    docs = read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()} == brute_kept(rows)


def test_sketches_rule_out_no_similar_pair():
    """Any two sketches differ in no more bits than their sets in shingles, folded or of different sizes."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 100, 700, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for keep, more in ((1.0, 0), (0.9, n // 12), (0.4, n)):
            x = np.unique(base)
            y = np.unique(np.concatenate((base[: int(n * keep)], rng.integers(0, 2**63, more).astype(np.uint64))))
            apart = len(np.setxor1d(x, y))
            assert jaccard.differ(jaccard.wide(x), jaccard.wide(y)) <= apart
            a, b = jaccard.sketch(x), jaccard.sketch(y)
            assert jaccard.differ(a, b) <= apart and jaccard.differ(jaccard.folded(a), jaccard.folded(b)) <= jaccard.differ(a, b)
            assert jaccard.differ(jaccard.wide(x), jaccard.sketch(x)) == 0


def test_later_stages_give_back_the_hashes_of_words():
    from corpuslens.llm.common import lean

    jaccard.shingle_sets(["one two three four five six"])
    assert jaccard._hashes
    lean()
    assert not jaccard._hashes
