"""Near-duplicates of the pipeline against brute-force Jaccard of five-word shingles."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_operators import SF, empty, odd, rows  # noqa: F401
from tracewright.llm import jaccard, simhash


def brute_kept(docs):
    """Smallest doc_id of each component of pairs with a similarity of 0.8 or more."""
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, parent = sorted(docs), {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_pairs = 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                n_pairs += sets[a] != sets[b]
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return {d for d in ids if find(d) == d}, n_pairs


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Texts with near copies of many similarities, a large group, and texts of a few words."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    texts = []
    for _ in range(30):
        base = word(int(rng.integers(60, 400)))
        texts += [base, *(edited(rng, base, max(1, round(len(base) * f))) for f in (0.004, 0.01, 0.02, 0.025, 0.05))]
    hub = word(150)
    texts += [edited(rng, hub, int(rng.integers(1, 8))) for _ in range(120)]
    texts += [word(int(n)) for n in rng.integers(1, 12, 40)] + [["a", "b"], ["A", "b"], ["b", "a"], [], []]
    passage = word(40)
    texts += [word(30) + passage + word(30) for _ in range(40)]
    order = rng.permutation(len(texts))
    return {int(d): " ".join(texts[k]) for d, k in enumerate(order)}


def test_near_duplicates_are_those_of_the_definition(spark, copies):
    want, n_pairs = brute_kept(copies)
    assert n_pairs > 400
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near_duplicates(spark, df, None))) == sorted(want)


def test_near_duplicates_over_a_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want, n_pairs = brute_kept(dict(zip(t["doc_id"], t["text"])))
    assert n_pairs > 0
    got = rows(simhash.keep_first(spark.read.parquet(f"{SF}/documents.parquet")))
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_edges(spark, odd, empty):  # noqa: F811
    kept = rows(simhash.keep_first(odd))
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "6", "7", "None"]
    assert simhash.keep_first(odd).columns == odd.columns
    null_ids = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words that stand here alone"), (5, None), (3, "")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in rows(simhash.keep_first(null_ids))))) == ["3", "None", "None"]
    assert rows(simhash.keep_first(empty)) == []


def test_prefix_size():
    for n in range(200):
        assert jaccard.prefix_size(n) == (n - -(-8 * n // 10) + 1 if n else 0)


def test_rows_beyond_the_broadcast_bound(spark, copies, monkeypatch):
    want, _ = brute_kept(copies)
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "KEYS", 0)
    assert sorted(r["doc_id"] for r in rows(simhash.keep_first(df))) == sorted(want)
