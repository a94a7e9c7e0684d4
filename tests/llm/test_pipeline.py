"""The corpus pipeline, stage by stage, against brute force on a small whole table."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_operators import SF, brute_em, brute_quality, brute_tiles, check_packing, library_ids
from tracewright.llm import quality
from tracewright.llm.common import cut, plain_words

KEY = " \t\n\x0b\x0c\r"


def votes(text):
    m = brute_quality(text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, chars = m["n_words"], m["word_chars"]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    import unicodedata

    cat = Counter(unicodedata.category(c) for c in text)
    letters = sum(v for k, v in cat.items() if k[0] == "L")
    known = sum(w in quality.FORMS for w in words)
    stops, shouts = len(re.findall(r"[.?]", text)), text.count("!")
    vote = lambda bad, good=False: -1 if bad else 1 if good else 0
    return (
        vote(10 * m["n_symbols"] > n, 50 * m["n_symbols"] <= n),
        vote(100 * letters < 90 * chars, 100 * letters >= 94 * chars),
        vote(100 * known < 4 * n, 100 * known >= 10 * n),
        vote(chars > 12 * n or chars < 2 * n),
        vote(10 * cat["Lu"] > 3 * chars),
        vote(10 * shouts > n),
        vote(10 * m["n_dup_lines"] > 5 * len(lines)),
        vote(10 * m["n_repeat_words"] > 2 * n),
        vote(stops == 0 and n >= 40),
    ), m["base_failed"]


def brute_stages():
    import math

    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = dict(zip(t["doc_id"], t["text"]))
    voted = {d: votes(x) for d, x in docs.items()}
    good, on_good, on_bad = brute_em(sorted(Counter(v for v, _ in voted.values()).items()), quality.ITERATIONS)
    odds = lambda v: math.log(good / (1 - good)) + sum(math.log(a[x + 1] / b[x + 1]) for x, a, b in zip(v, on_good, on_bad))
    docs = {d: x for d, x in docs.items() if not voted[d][1] and odds(voted[d][0]) >= 0}
    yield docs
    key = lambda line: line.strip(KEY).encode().lower()
    held = Counter(k for x in docs.values() for k in {key(line) for line in x.split("\n")} if k)
    docs = {d: "\n".join(line for line in x.split("\n") if held[key(line)] < 10) for d, x in docs.items()}
    yield docs
    kept, _ = brute_kept(docs)
    docs = {d: x for d, x in docs.items() if d in kept}
    yield docs
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = [plain_words(x) for x in b["text"]]
    for d in list(docs):
        own = plain_words(docs[d])
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for w in items:
            if any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)) and brute_tiles(own, w, 5) >= 0.8 * len(w):
                del docs[d]
                break
    yield docs


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns
        out.append({r["doc_id"]: r["text"] for r in docs.collect()})
    return out


def test_stages(spark, stages):
    for (name, _), got, want in zip(corpus_pipeline.STAGES, stages, brute_stages()):
        assert got == want, name
    assert len(stages[0]) < 200 and len(stages[2]) < len(stages[1]) and len(stages[3]) < len(stages[2])


def test_run(spark, stages):
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    check_packing(got, 1024)
    sizes = Counter()
    for r in got:
        sizes[r["doc_id"]] += r["length"]
    last = stages[-1]
    assert sizes == dict(zip(last, map(len, library_ids(last.values(), 2))))


def test_run_over_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (None, "words " * 30 + "of the and in to.", None, "s", 5), (2, "", "en", "s", 0), (3, "The cat and the dog of the house in to be it. " * 3, "en", "s", 9), (3, "The cat and the dog of the house in to be it. " * 3, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # nulls, empties and texts under 20 words fail the base rule; the repeated windows of id null and 3 too
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    words = "the cat of a house and its dog in to be was for it on with as by an or".split()
    fine = [(7, " ".join(f"{w}{k} {w}" for k, w in enumerate(words)) + ".", "en", "s", 1)] * 2 + [(None, " ".join(f"{w} {w}x{k}" for k, w in enumerate(words)) + ".", None, None, None)]
    spark.createDataFrame(rows + fine, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [7, None]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
