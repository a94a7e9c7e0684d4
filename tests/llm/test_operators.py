"""The operators against brute force on small whole tables, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import line_dedup, packing, quality, queries, simhash, tokens

SF = "/root/testdata/sf0.001"
WS = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, repeats, ties, a very long text, clashing extra columns."""
    rows = [
        (1, "", "x", 1),
        (2, None, None, None),
        (None, "a lone text without an id that has some words in it", "y", 2),
        (3, " \n\t ", "x", 3),
        (4, "same text here for two rows", "x", 4),
        (4, "same text here for two rows", "x", 4),
        (5, "same text here for two rows", "x", 5),
        (6, "word " * 60_000, "x", 6),
        (7, "é ü 漢字 \U0001f600 <|endoftext|> x y", "x", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, fp int")
    # names that the operators would like to use themselves
    for name in ("_q_text", "_Q_n_words", "_l_n_lines", "_l_row", "_s_tie", "_s_same_id", "tie", "sig", "key", "block", "length"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- quality ---------------------------------------------------------------------------------


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": rep,
        "base_failed": n < 20 or 100 * rep > 30 * n,
    }


def test_quality_measures(spark, texts):
    for r in rows(queries.op3_quality(spark, SF)):
        want = brute_quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def brute_em(patterns, rounds):
    """The same model as plain sums over documents: share of good ones, and chances of the votes -1, 0, 1 per rule."""
    n_rules = len(patterns[0][0])
    share = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in patterns]
    for turn in range(rounds + 1):
        if turn:
            odds = [np.log(good / (1 - good)) + sum(np.log(a[v + 1] / b[v + 1]) for v, a, b in zip(votes, on_good, on_bad)) for votes, _ in patterns]
            share = [1 / (1 + np.exp(-x)) for x in odds]
        total = sum(n for _, n in patterns)
        good = (sum(n * s for (_, n), s in zip(patterns, share)) + 1) / (total + 2)
        on_good, on_bad = [], []
        for j in range(n_rules):
            a = np.array([x + sum(n * s for (v, n), s in zip(patterns, share) if v[j] == vote) for vote, x in ((-1, 0.5), (0, 2.0), (1, 2.0))])
            b = np.array([x + sum(n * (1 - s) for (v, n), s in zip(patterns, share) if v[j] == vote) for vote, x in ((-1, 2.0), (0, 2.0), (1, 0.5))])
            a, b = a / a.sum(), b / b.sum()
            for vote, worse in ((0, a[0] > b[0]), (2, b[2] > a[2])):
                if worse:
                    a[vote] = b[vote] = (a[vote] + b[vote]) / 2
            on_good.append(a / a.sum())
            on_bad.append(b / b.sum())
    return good, on_good, on_bad


def test_quality_posteriors_against_sums_over_documents(spark):
    got = rows(queries.op3_quality(spark, SF))
    patterns = sorted(Counter(tuple(r[k] for k in quality.RULES) for r in got).items())
    good, on_good, on_bad = brute_em(patterns, quality.ITERATIONS)
    for r in got:
        odds = np.log(good / (1 - good)) + sum(np.log(a[r[k] + 1] / b[r[k] + 1]) for k, a, b in zip(quality.RULES, on_good, on_bad))
        assert abs(r["posterior"] - 1 / (1 + np.exp(-odds))) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


@pytest.mark.parametrize("share", [0.2, 0.35])
def test_quality_em_finds_that_most_are_bad(share):
    rng = np.random.default_rng(6)
    acc = np.linspace(0.75, 0.95, len(quality.RULES))
    pats = Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < share else -1
        pats[tuple(int(v) for v in np.where(rng.random(len(acc)) < 0.3, 0, np.where(rng.random(len(acc)) < acc, y, -y)))] += 1
    assert abs(quality.maximise(list(pats.items())).good - share) < 0.03


def test_quality_agrees_with_labels(spark):
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    good = dict(zip(labels["doc_id"], labels["quality"]))
    got = [r for r in rows(queries.op3_quality(spark, "/root/testdata/sf0.01")) if r["doc_id"] in good and not r["base_failed"]]
    clean = [r["kept"] for r in got if good[r["doc_id"]] == 1]
    junk = [r["kept"] for r in got if good[r["doc_id"]] == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.1 * len(junk)


def test_quality_em_finds_accuracies():
    rng = np.random.default_rng(5)
    acc = np.linspace(0.65, 0.95, len(quality.RULES))
    pats = Counter()
    truth = []
    for _ in range(20_000):
        y = 1 if rng.random() < 0.8 else -1
        votes = tuple(int(v) for v in np.where(rng.random(len(acc)) < 0.3, 0, np.where(rng.random(len(acc)) < acc, y, -y)))
        pats[votes] += 1
        truth.append(y)
    model = quality.maximise(list(pats.items()))
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(np.array([model.accuracy(j) for j in range(len(acc))]) - acc[:, None]).max() < 0.04


def test_quality_edges(spark, odd, empty):
    got = rows(quality.score(odd))
    assert len(got) == 9
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_words"] == 0 and not r["kept"]
        if r["doc_id"] == 6:
            assert r["n_repeat_words"] == 60_000 and not r["kept"]
    assert rows(quality.score(empty)) == []
    assert quality.keep(odd).columns == odd.columns
    assert quality.keep(empty).count() == 0


# --- line dedup ------------------------------------------------------------------------------


def brute_lines(docs, least):
    """docs: (doc_id, text) rows; a null id is a document of its own."""
    key = lambda line: line.encode().strip(WS).lower()
    held = defaultdict(set)
    for row, (d, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            held[key(line)].add(("row", row) if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(held[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def digest_rows(df):
    n, gone = df.columns[-2:]
    return sorted(((r["doc_id"], r[n], r[gone], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()), key=str)


def test_line_dedup(spark, texts):
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(queries.op5_line_dedup(spark, SF))]
    assert sorted(got) == sorted(brute_lines(list(texts.items()), 10))


def test_line_dedup_counts_documents_not_rows(spark):
    docs = [(1, f"again\nown {k}") for k in range(10)] + [(k, "shared\nx") for k in range(2, 12)] + [(None, "lone\ny") for _ in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest_rows(line_dedup.dedup(df, 10)) == sorted(brute_lines(docs, 10), key=str)


def test_line_dedup_beyond_the_broadcast_bound(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = line_dedup.insert(line_dedup.LineState.empty(spark, 3), docs).cut()
    near, far = line_dedup.clean(docs, state), line_dedup.clean(docs, state, broadcast_bytes=0)
    assert near.columns == far.columns
    assert digest_rows(near) == digest_rows(far) == sorted(brute_lines(list(texts.items()), 3), key=str)


def filter_content(state):
    """Fingerprints with their pair of buckets, by shard."""
    out = Counter()
    for r in state.filters.collect():
        f = line_dedup.CuckooFilter.load(bytes(r["filter"]))
        for bucket, slot in zip(*np.nonzero(f.table)):
            print_ = f.table[bucket, slot]
            out[r["shard"], f.buckets, int(print_), min(int(bucket), int(f._other(bucket, print_)))] += 1
    return out


def test_line_state_is_reversible(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some, more = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    as_set = lambda x: {(bytes(r["key"]), r["n_docs"]) for r in x.counts.collect()}
    first = line_dedup.insert(line_dedup.LineState.empty(spark, 2), some)
    first.save(str(tmp_path / "state"))
    both = line_dedup.insert(line_dedup.LineState.load(spark, str(tmp_path / "state"), 2), more)
    whole = line_dedup.insert(line_dedup.LineState.empty(spark, 2), docs)
    back = line_dedup.delete(both, more)
    assert as_set(both) == as_set(whole) and as_set(back) == as_set(first) and as_set(first) != as_set(whole)
    for state in (first, both, whole, back):
        keys = [bytes(r["key"]) for r in state.frequent().collect()]
        shipped = line_dedup.ShardedFilter([(r["shard"], bytes(r["filter"])) for r in state.filters.collect()])
        assert keys and shipped.contains(keys).all()
        assert sum(f.count for f in shipped.shards.values()) == len(keys)
    # fingerprints are those of a rebuild, wherever kicks have put them
    prints = lambda state: Counter((s, p) for (s, _, p, _), n in filter_content(state).items() for _ in range(n))
    assert prints(back) == prints(first) and prints(both) == prints(whole)
    sizes = lambda state: {(k[0], k[1]) for k in filter_content(state)}
    same = sizes(back) & sizes(first)
    pick = lambda state: Counter({k: n for k, n in filter_content(state).items() if (k[0], k[1]) in same})
    assert same and pick(back) == pick(first)


def test_full_shards_are_built_anew(spark):
    make = lambda a, b: spark.createDataFrame([(d, f"line {k}") for d in (0, 1) for k in range(a, b)], "x long, text string").selectExpr("monotonically_increasing_id() doc_id", "text")
    state = line_dedup.insert(line_dedup.LineState.empty(spark, 2), make(0, 700))
    more = line_dedup.insert(state, make(700, 9000))
    shipped = line_dedup.ShardedFilter([(r["shard"], bytes(r["filter"])) for r in more.filters.collect()])
    keys = [bytes(r["key"]) for r in more.frequent().collect()]
    assert len(keys) == 9000 and shipped.contains(keys).all() and sum(f.count for f in shipped.shards.values()) == 9000
    gone = line_dedup.delete(more, make(0, 9000))
    assert gone.counts.isEmpty() and not filter_content(gone)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.of(keys.tolist())
    assert f.count == 5000 and f.contains(keys).all()
    others = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.01
    assert f.updated(keys[:2500].tolist(), []) is f
    assert f.count == 2500 and f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.02
    with pytest.raises(KeyError):
        line_dedup.CuckooFilter(16).updated([1], [])
    assert f.updated([], keys[:2500].tolist()) is f
    g = line_dedup.CuckooFilter.load(f.dump())
    assert g.contains(keys).all() and (g.contains(others) == f.contains(others)).all()
    assert f.updated(keys.tolist(), []).count == 0
    assert line_dedup.CuckooFilter(16).updated([], keys.tolist()) is None


def test_a_full_cuckoo_filter_stays_as_it_was():
    f = line_dedup.CuckooFilter(4)
    rng = np.random.default_rng(2)
    held = []
    for key in rng.integers(0, 2**63, 200, dtype=np.uint64).tolist():
        if f.insert(key):
            held.append(key)
        else:
            assert f.contains(np.array(held, dtype=np.uint64)).all() and f.count == len(held)
    assert len(held) < 200


def test_line_edges(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in rows(odd)]
    for least in (2, 3):
        out = line_dedup.dedup(odd, min_docs=least)
        assert out.columns[:-2] == odd.columns
        assert digest_rows(out) == sorted(brute_lines(docs, least), key=str)
    assert rows(line_dedup.dedup(empty)) == []


# --- token ids -------------------------------------------------------------------------------


def library_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_vocabulary())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_encoder_gives_the_library_ids(texts):
    odd_texts = ["", " ", " a", "a ", "a  b", "a\n\nb c", "it's we'll  ok", "x <|endoftext|> y", "a b c", "a  b", "tab\tb c", "1 2 33 !? a", "漢字 か な", "a\x1c b"]
    all_texts = odd_texts + list(texts.values())
    got = tokens.Encoder(tokens.public_vocabulary()).encode(all_texts)
    want = library_ids(all_texts, 0)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [w[:-1] for w in want]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 255, 256, 257, 5000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    if n > 3:
        ids[rng.integers(0, n, max(1, n // 50))] = rng.integers(0, 2**32 - 1, max(1, n // 50))
    for percentile in (50, 90, 100):
        assert (tokens.decode_shard(tokens.encode_shard(ids, percentile)) == ids).all()
    wide = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    assert (tokens.decode_shard(tokens.encode_shard(wide)) == wide).all()


def test_token_ids(spark, texts):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(queries.op9_token_ids(spark, SF))}
    at, want = 0, {}
    for doc_id, ids in zip(sorted(texts), library_ids([texts[d] for d in sorted(texts)], 0)):
        want[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_token_shards_of_many_rows(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens.write_shards(docs, str(tmp_path / "s"), tokens.public_vocabulary(), 0, shard_ids=3000)
    few = tokens.read_shards(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, queries.op9_token_ids(spark, SF).collect()))


def test_token_edges(spark, odd, empty):
    got = rows(tokens.token_table(odd))
    assert len(got) == 9 and sorted(r["start"] for r in got)[0] == 0
    total = sum(r["n_tokens"] for r in got)
    assert {r["start"] for r in got if r["doc_id"] is None} == {0}
    assert max(r["start"] + r["n_tokens"] for r in got) == total
    assert rows(tokens.token_table(empty)) == []


# --- packing ---------------------------------------------------------------------------------


def check_packing(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, texts):
    got = rows(queries.op6_packing(spark, SF))
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for doc_id, ids in zip(texts, library_ids(texts.values(), 2)):
        raw = np.array(ids, "<u4").tobytes()
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in own[1:])
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])
    bins = check_packing(got, 1024)
    want = best_fit_one_by_one([r["length"] for r in got], packing.Capacity())
    assert sorted(sorted((n for _, n in own), reverse=True) for own in bins.values()) == sorted(sorted(own, reverse=True) for own in want)


def best_fit_one_by_one(lengths, cap):
    """Vector best-fit by its definition: pieces one after another, every open sequence looked at."""
    size, weight = np.array([cap.tokens, cap.documents, cap.cost], float), np.array(cap.weights)
    left, bins = np.zeros((len(lengths), 3)), []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        best = None
        own = left[: len(bins)]
        for k in np.flatnonzero((own >= need).all(axis=1)).tolist():
            after = (own[k] - need) / size
            score = float((after**2 * weight).sum()) if cap.rule == "norm" else -float((own[k] / size * (need / size) * weight).sum())
            mark = (round(score, 12), own[k][1], own[k][2], own[k][0], k)
            best = mark if best is None else min(best, mark)
        if best is None:
            left[len(bins)] = size
            bins.append([])
            k = len(bins) - 1
        else:
            k = best[-1]
        left[k] -= need
        bins[k].append(n)
    return bins


def bins_of(steps):
    found = defaultdict(list)
    for n, a, b, first, offset, each in steps.tolist():
        for r in range(b - a):
            found[first + r // each].append((offset + r % each * n, n))
    out = []
    for _, own in sorted(found.items()):
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        out.append([n for _, n in sorted(own)])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents", [100, 6])
@pytest.mark.parametrize("weights", [(1, 0.05, 0.05), (1, 1, 1), (1, 0, 0)])
def test_plan_is_vector_best_fit_bin_by_bin(rule, documents, weights):
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(1, 101, 250), rng.integers(1, 12, 250)].tolist()
    cap = packing.Capacity(tokens=100, documents=documents, cost=10_000, weights=weights, rule=rule)
    got = bins_of(packing.plan(dict(Counter(lengths)), cap))
    assert got == best_fit_one_by_one(lengths, cap)
    assert all(sum(own) <= 100 and len(own) <= documents for own in got)


def test_a_binding_cost_is_kept():
    cap = packing.Capacity(tokens=100, documents=100, cost=10_000, weights=(1, 1, 1), rule="dot")
    # by tokens alone 50 + 50 would fit twice as tightly as the cost of a longer piece allows
    got = bins_of(packing.plan({80: 5, 20: 40, 1: 7}, cap))
    assert all(sum(n * n for n in own) <= cap.cost for own in got)


def test_weights_decide_between_equal_tokens():
    # 6 + 2 + 2 and 10: both leave 4 of 14; the one with fewer documents left is fuller
    by = lambda w: bins_of(packing.plan({10: 1, 6: 1, 2: 2, 4: 1}, packing.Capacity(tokens=14, documents=3, cost=196, weights=w)))
    assert by((1, 0, 0)) == best_fit_one_by_one([10, 6, 2, 2, 4], packing.Capacity(tokens=14, documents=3, cost=196, weights=(1, 0, 0)))
    with pytest.raises(ValueError):
        packing.Capacity(tokens=1024, cost=10)


def test_packing_edges(spark, odd, empty):
    got = rows(packing.pack_documents(odd))
    assert sum(r["length"] for r in got) == sum(map(len, library_ids([r["text"] for r in rows(odd)], 2)))
    check_packing(got, 1024)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert rows(packing.pack_documents(empty)) == []


# --- simhash ---------------------------------------------------------------------------------


def brute_fp(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, budget):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        low[find(i)].append(d)
    return [min((d for d in low[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash(spark, texts):
    ids = list(texts)
    fps = [brute_fp(texts[d]) for d in ids]
    want = {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, brute_components(ids, fps, 4))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(queries.op8_simhash(spark, SF))}
    assert got == want


@pytest.mark.parametrize("segments", [5, 6, 7])
@pytest.mark.parametrize("budget", [3, 4])
def test_trie_join_finds_every_component(spark, segments, budget):
    rng = np.random.default_rng(segments * 10 + budget)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    keys = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(60):
            x = b
            for _ in range(int(rng.integers(1, 7))):
                x ^= 1 << int(rng.integers(0, 64))
            keys.add(x)
    keys = sorted(keys)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    from tracewright.llm.graph import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(df, budget, segments)).collect()}
    want = brute_components(signed, keys, budget)
    assert [roots.get(s, s) for s in signed] == want


def test_simhash_edges(spark, odd, empty):
    got = rows(simhash.near_classes(odd))
    assert len(got) == 9
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert {c for _, c in by[4] | by[5]} == {4}
    assert rows(simhash.near_classes(empty)) == []
    kept = rows(simhash.keep_first(odd))
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "6", "7", "None"]
    assert simhash.keep_first(odd).columns == odd.columns


# --- repeated byte strings --------------------------------------------------------------------

from tracewright.llm import suffix_dedup  # noqa: E402


def brute_repeats(docs, length=50):
    """docs: (doc_id or None, text)"""
    order = lambda d: float("inf") if d is None else d
    least = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(least.get(s, float("inf")), order(d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < order(d):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, texts):
    got = [tuple(r) for r in queries.op7_suffix_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(brute_repeats(texts.items()))
    assert sum(r[2] for r in got) > 1000


def test_repeats_of_edited_texts(spark):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcd \n"), 3000))
    docs = [(0, base)]
    for d in range(1, 40):
        x = list(base)
        for _ in range(int(rng.integers(0, 40))):
            k = int(rng.integers(0, len(x)))
            x[k : k + int(rng.integers(0, 3))] = rng.choice(list("xyzé"), int(rng.integers(0, 3))).tolist()
        docs.append((d, "".join(x)[int(rng.integers(0, 500)) :]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got) == sorted(brute_repeats(docs))


def test_repeats_edges(spark, odd, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in rows(odd)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(odd).collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(docs), key=key)
    assert rows(suffix_dedup.remove_repeats(empty)) == []


def test_very_long_text_is_cut_into_pieces_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    whole = suffix_dedup.Anchors([text])
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    cut = suffix_dedup.Anchors([text])
    by_window = lambda a: {(i, int(h)) for x, y, h in zip(a.low, a.high, a.anchor) for i in range(x, y + 1)}
    assert by_window(cut) == by_window(whole)


@pytest.mark.parametrize("groups", [1, 7, 1000])
def test_suffix_sort_follows_byte_order(groups):
    rng = np.random.default_rng(8)
    m = rng.integers(97, 99, (3000, 50), dtype=np.uint8)
    m[:, :40] = 97
    m[::3] = m[0]
    m[1::9, :20] = rng.integers(97, 100, (len(m[1::9]), 20))
    m[2::9, :48] = 97  # large groups that differ in their last bytes, or not at all
    m[5::9, :49] = 98
    group = rng.integers(0, groups, 3000)
    order, new = suffix_dedup.suffix_sort(m.ravel(), np.arange(3000) * 50, group)
    name = [(int(g), r.tobytes()) for g, r in zip(group, m)]
    assert sorted(order.tolist()) == list(range(3000))
    assert [name[k] for k in order] == sorted(name)
    assert new.tolist() == [True, *(name[a] != name[b] for a, b in zip(order, order[1:]))]


def test_anchors_of_many_classes_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(10)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(70)
    docs = [(d, word(60) + passage[: int(rng.integers(40, 70))] + word(60)) for d in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted(brute_repeats(docs))
    assert sum(r[2] for r in want) > 1000
    for most in (2000, 3):
        # the bound is read on the workers, which are forked from this process's session
        monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", most)
        codes = suffix_dedup._settle(np.array([1, 1, 1, 1, 2], np.uint64), np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64))[0][0]
        assert codes.tolist() == [suffix_dedup.SEND if most > 4 else suffix_dedup.SEND_DEALT] * 4 + [suffix_dedup.NONE]
    monkeypatch.setattr(suffix_dedup, "MEETING", suffix_dedup.Meeting(np.minimum, dealt_settle, suffix_dedup._give, 1))
    assert sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect()) == want


def test_repeats_across_a_tree_of_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "Tree", lambda blocks: exchange.Tree(20, 2))
    got = [tuple(r)[:5] for r in queries.op7_suffix_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(brute_repeats(texts.items()))


def dealt_settle(anchor, segment, doc):
    codes, facts = suffix_dedup._settle(anchor, segment, doc)
    return [np.where(codes[0] == suffix_dedup.SEND, np.uint64(suffix_dedup.SEND_DEALT), codes[0])], facts


# --- language model ----------------------------------------------------------------------------

from tracewright.llm import language_model  # noqa: E402


def test_language_model(spark, texts):
    got = {r["doc_id"]: r for r in rows(queries.op2_language_model(spark, SF))}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    toks = {d: texts[d].encode().lower().split() for d in texts}
    count = Counter(w for d in texts if not out[d] for w in [*toks[d], None])
    n, v = sum(count.values()), len(count)
    for d, r in got.items():
        own = [*toks[d], None]
        want = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))


def test_scores_one_decision_at_a_time(spark, texts):
    """Some scores again: bytes one by one, and stretches by dictionaries over all training documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(language_model.score(docs))}
    model = language_model.train(docs)
    lower = {d: t.encode().lower() for d, t in texts.items()}
    learns = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in texts}

    def stretches(raw):
        """(first byte, end, the three words before, bytes) by the definition of anchors."""
        words = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw)]
        h = [int(arrays.word_values([raw[a:b]])[0][0]) for a, b in words]
        at = []
        for k in range(3, len(words)):
            key = 0
            for x in h[k - 3 : k]:
                key = (key * 0x9E3779B97F4A7C15 + x) % 2**64
            if int(mixed(np.array([(key + 3) % 2**64], np.uint64))[0]) % 16 == 0:
                at.append((words[k][0], tuple(raw[a:b] for a, b in words[k - 3 : k])))
        ends = [a for a, _ in at[1:]] + [len(raw) + 1]
        return [(a, e, c, (raw + b"\0")[a:e]) for (a, c), e in zip(at, ends)]

    context, pair = Counter(), Counter()
    own = {d: stretches(raw) for d, raw in lower.items()}
    for d, found in own.items():
        if learns[d]:
            context.update(c for _, _, c, _ in found)
            pair.update((c, t) for _, _, c, t in found)
    gates = lambda n: sum(n > x for x in (1, 2, 3, 5, 9, 17, 65))
    seen, met = np.zeros(8), np.zeros(8)
    for (c, _), n in pair.items():
        if context[c] > 1:
            seen[gates(context[c] - 1)] += n
            met[gates(context[c] - 1)] += n if n > 1 else 0
    weight = np.clip((met + 0.5) / (seen + 1), 1e-3, 1 - 1e-3)
    stretched = model.stretched()
    matched = 0
    short = [x for x in texts if len(lower[x]) < 1500]
    for d in [*[x for x in short if got[x]["matched_bytes"]][:4], *short[:2]]:
        codes = np.array([int.from_bytes((bytes(5) + lower[d] + bytes(1))[k : k + 6], "big") for k in range(len(lower[d]) + 1)], np.uint64)
        bits = [float(model.mixer.log10(stretched, codes[k : k + 1])[0]) for k in range(len(codes))]
        mine_c, mine_p = Counter(c for _, _, c, _ in own[d]), Counter((c, t) for _, _, c, t in own[d])
        total, at = 0.0, 0
        for a, e, c, t in own[d]:
            total += sum(bits[at:a])
            n, k = context[c] - learns[d] * mine_c[c], pair[c, t] - learns[d] * mine_p[c, t]
            plain = sum(bits[a:e])
            w = weight[gates(n)] if n else 0.0
            total += np.log10(w * k / n + (1 - w) * 10.0**plain) if k and plain > -300 else np.log10(w * k / n) if k else np.log10(1 - w) + plain
            matched += k > 0
            at = e
        total += sum(bits[at:])
        assert abs(got[d]["score"] - total) < 1e-6 * abs(total)
    assert matched > 3


def test_the_model_is_ahead_of_the_word_base(spark):
    got = [r for r in rows(queries.op2_language_model(spark, "/root/testdata/sf0.01")) if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.97 * sum(r["base_score"] for r in got)


def test_documents_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 9))))
    vocabulary = [word() for _ in range(3000)]
    texts_ = [" ".join(rng.choice(vocabulary, 300)) for _ in range(150)]
    docs = [(d, t) for d, t in enumerate(texts_ + texts_[:30])]
    got = {r["doc_id"]: r["bits_per_byte"] for r in rows(language_model.score(spark.createDataFrame(docs, "doc_id long, text string")))}
    learns = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    twice = [got[d] for d in range(30) if learns(d + 150)] + [got[d + 150] for d in range(30) if learns(d)]
    once = [got[d] for d in range(30, 150)]
    assert max(twice) < 0.6 * min(once)


def test_model_probabilities_sum_to_one():
    mixer, tables = language_model.Mixer(), np.random.default_rng(0).normal(size=(language_model.ORDERS, 1 << language_model.SLOT_BITS)).astype(np.float32)
    code = (np.uint64(0x6162636465) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** mixer.log10(tables, code)).sum() - 1) < 1e-6


def test_stretches_share_their_probability():
    """All stretches after a context, and the bits, together weigh one."""
    own = np.array([3.0, 1.0, 1.0])
    got = 10 ** language_model.mixed_log10(np.full(3, -400.0), np.full(3, 5.0), own, np.full(8, 0.25))
    assert abs(got.sum() - 0.25) < 1e-12
    assert language_model.mixed_log10(np.array([-2.0]), np.zeros(1), np.zeros(1), np.full(8, 0.25))[0] == -2


def test_counts_beyond_the_exact_range_keep_their_ratio():
    mixer = language_model.Mixer(4)
    tables = np.zeros((language_model.ORDERS, 16, 2), np.uint16)
    tables[:, :, 0], tables[:, :, 1] = language_model.EXACT, 600
    x, _ = mixer.inputs(tables, np.arange(8, dtype=np.uint64), 0, np.zeros(8, int), np.ones(8, bool))
    assert np.allclose(x[:, 0], np.log(600.3 / (language_model.EXACT + 0.3)))


def test_words_and_strings_of_the_model():
    texts = [b"", b" a bb  a\n", b"x" * 9000 + b" " + b"x" * 8999 + b"y", b"ab ba", b"\x0b\x0c"]
    h, n = arrays.word_values(texts)
    words = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(h.tolist(), words))) == len(set(h.tolist())) == len(set(words))
    code, sizes = language_model.strings(texts)
    want = [int.from_bytes((bytes(5) + t + bytes(1))[k : k + 6], "big") for t in texts for k in range(len(t) + 1)]
    assert code.tolist() == want and sizes.tolist() == [len(t) + 1 for t in texts]
    keys = np.unique(code)
    assert (keys[language_model.Lookup(keys)(code)] == code).all()


def test_language_model_counts_in_turns(texts, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
    count = lambda: {r["shard"]: arrays.opened(r["payload"], np.uint32).tolist() for b in language_model._first(12)(iter([batch])) for r in b.to_pylist() if r["kind"] == "bits"}
    whole = count()
    # the counts by their definition, for one order
    want = np.zeros((1 << 12, 2), int)
    raw = [t.encode().lower() for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10]
    code = language_model.strings(raw)[0]
    for bit in range(8):
        np.add.at(want, (language_model.slots(code, 3, bit, 12), ((code >> np.uint64(bit)) & np.uint64(1)).astype(int)), 1)
    assert np.concatenate([whole[2 * language_model.RANGES + r] for r in range(language_model.RANGES)]).reshape(-1, 2).tolist() == want.tolist()
    monkeypatch.setattr(language_model.Distinct, "LIMIT", 10)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 50_000)
    assert count() == whole


def test_language_model_edges(spark, odd, empty):
    got = rows(language_model.score(odd))
    assert len(got) == 9 and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 4}) == 1
    assert rows(language_model.score(empty)) == []


# --- meeting in a tree -----------------------------------------------------------------------------

from tracewright.llm import arrays, exchange  # noqa: E402
from tracewright.llm.common import mixed  # noqa: E402


@pytest.mark.parametrize("blocks,fan_bits", [(1, 7), (16, 7), (16, 1), (13, 2), (40, 2)])
def test_entries_meet_in_a_tree(spark, blocks, fan_bits):
    tree = exchange.Tree(blocks, fan_bits)
    assert tree.levels == -(-max(1, (blocks - 1).bit_length()) // fan_bits)
    df = spark.range(blocks).selectExpr("cast(id as int) block", "id")

    def entries(block):
        rng = np.random.default_rng(block)
        key = np.unique(mixed(rng.integers(0, 400, 120).astype(np.uint64)))
        return key, key % np.uint64(3), rng.integers(1, 5, len(key)).astype(np.uint64)

    def emit(key, table):
        return exchange.rows_of(tree, 1, key[0].as_py(), *entries(key[0].as_py()))

    meeting = exchange.Meeting(np.add, lambda k, s, v: ([v, k], [len(k), v.sum()]), lambda own, met, found: found, 2)
    answers, up = exchange.meet(df.groupBy("block").applyInArrow(emit, exchange.ROW), tree, meeting)
    total = Counter()
    for b in range(blocks):
        for k, s, v in zip(*(x.tolist() for x in entries(b))):
            total[k, s] += v
    table = answers.toArrow()
    for b in range(blocks):
        import pyarrow.compute as pc

        got = exchange.answer_columns(table.filter(pc.equal(table["source"], b)), 2)
        key, sub, _ = entries(b)
        assert got[1].tolist() == key.tolist()
        assert got[0].tolist() == [total[k, s] for k, s in zip(key.tolist(), sub.tolist())]
    facts = np.array([f for f in table["facts"].to_pylist() if f]).sum(axis=0)
    assert facts.tolist() == [len(total), sum(total.values())]
    for level in up:
        assert level.count() <= 2 * blocks * 2**fan_bits


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        y = rng.integers(0, 300, n).astype(np.uint64)
        a, b = arrays.of_planes(arrays.planes(arrays.steps(x), y), 2)
        assert arrays.of_steps(a).tolist() == x.tolist() and b.tolist() == y.tolist()


def test_majority_bits():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 3, 0, 1, 70_000, 0, 2, 140_000, 5, 0])
    h = rng.integers(0, 2**64 - 1, sizes.sum(), dtype=np.uint64)
    bounds = np.r_[0, np.cumsum(sizes)]
    for a, b, got in zip(bounds, bounds[1:], arrays.majority(h, bounds).tolist()):
        assert got == sum(1 << k for k in range(64) if 2 * int(((h[a:b] >> np.uint64(k)) & np.uint64(1)).sum()) > b - a)


# --- toxicity, decontamination, licenses ---------------------------------------------------------

from tracewright.llm import decontamination, licenses, toxicity  # noqa: E402


def test_toxicity_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    truth = pq.read_table(f"{big}/labels.parquet").to_pydict()
    toxic = dict(zip(truth["doc_id"], truth["toxic"]))
    got = [r for r in rows(queries.op4_toxicity(spark, big)) if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    hit = [r["predicted"] for r in got if toxic[r["doc_id"]] == 1]
    alarm = [r["predicted"] for r in got if toxic[r["doc_id"]] == 0]
    # some 300 toxic rows to learn from
    assert sum(hit) >= 0.6 * len(hit) and sum(alarm) <= 0.005 * len(alarm)


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(odd, labels))
    assert len(got) == 9 and {r["score"] for r in got} == {0.5}
    assert rows(toxicity.toxicity(empty, labels)) == []


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(3)
    model = toxicity.Ftrl(size=5000, l1=2.0)
    data = []
    for _ in range(600):
        y = int(rng.random() < 0.5)
        at = rng.integers(10, 5000, 50)
        data.append((np.append(at, rng.integers(0, 3)) if y else at, y))
    for _ in range(3):
        for at, y in data:
            model.learn(at, y)
    at, w = model.sparse()
    assert {0, 1, 2} <= set(at[w > 1].tolist())
    assert len(at) < 1500


def test_ftrl_follows_the_rule_coordinate_by_coordinate():
    rng = np.random.default_rng(5)
    model, z, n = toxicity.Ftrl(size=40, l1=0.3), defaultdict(float), defaultdict(float)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, 0.3, toxicity.L2

    def weight(i):
        bound = 0.0 if i == 40 else l1
        return 0.0 if abs(z[i]) <= bound else -(z[i] - np.sign(z[i]) * bound) / ((b + np.sqrt(n[i])) / a + l2)

    for _ in range(300):
        at, y = rng.integers(0, 40, 6), int(rng.random() < 0.4)
        model.learn(at, y)
        own = [*sorted(set(at.tolist())), 40]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in own:
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / a
            z[i] += g - step * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(41)), [weight(i) for i in range(41)])
    assert 0 < len(model.sparse()[0]) < 41


def test_toxicity_trains_in_shards(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 400_000)
    at, w = toxicity.fit(docs, labels)
    assert len(at) and np.isfinite(w).all()


def test_toxicity_of_repeated_rows_and_ids(spark):
    bad, fine = "you utter fool I hate you", "the weather is fine today in town"
    docs = [(d, bad if d % 2 else fine) for d in range(60)] + [(1, bad), (1, bad)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)] + [(2, 0), (2, None), (3, 0)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(df, labels))
    assert len(got) == 62 and {(r["doc_id"] % 2, r["predicted"]) for r in got} == {(0, 0), (1, 1)}
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        for k in range(best[0]):
            ma[best[1] + k] = mb[best[2] + k] = True
        total += best[0]


def test_tiling_covers_as_much_as_the_definition():
    rng = np.random.default_rng(6)
    for _ in range(40):
        item = [f"w{k}" for k in rng.integers(0, 30, 25)]
        cuts = sorted(rng.integers(0, 25, 2).tolist())
        doc = item[cuts[1] :] + ["x"] + item[cuts[0] : cuts[1]] + [f"w{k}" for k in rng.integers(0, 30, 10)] + item[: cuts[0]]
        index = decontamination.Index.of([(1, " ".join(item))])
        got = index.matches(" ".join(doc))
        assert (got[0][2] if got else 0) == brute_tiles(doc, item, 5)


def test_tiling_of_repeated_words():
    """Repeats on both sides: runs, not pairs, are kept, and the cover is that of the definition."""
    import time

    for doc, item in (("a " * 30, "a " * 12), ("a b " * 20, "a b " * 9), ("a a b " * 9 + "b", "b a a " * 6), ("x " + "a " * 7 + "y " + "a " * 8, "a " * 14)):
        index = decontamination.Index.of([(1, item)])
        got = index.matches(doc)
        assert (got[0][2] if got else 0) == brute_tiles(doc.split(), item.split(), 5)
    index = decontamination.Index.of([(1, "a " * 300)])
    begun = time.process_time()
    assert index.matches("a " * 3000)[0][2] == 300
    assert time.process_time() - begun < 2


def test_items_of_one_or_two_words_match_nothing():
    assert decontamination.Index.of([(1, "the"), (2, "of the"), (3, "one two three")]).items == [3]


def test_decontamination(spark, texts):
    from tracewright.llm.common import plain_words

    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = {i: plain_words(t) for i, t in zip(bench["item_id"], bench["text"])}
    want = set()
    for d, t in texts.items():
        own = plain_words(t)
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for i, w in items.items():
            if any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)) and brute_tiles(own, w, 5) >= 0.8 * len(w):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in rows(queries.op10_decontamination(spark, SF))}
    assert got == want and want


def test_decontamination_in_blocks_and_edges(spark, odd, empty):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontamination.leaks(docs, bench)) == key(decontamination.leaks(docs, bench, block_chars=1500))
    own = spark.createDataFrame([(1, None), (2, ""), (3, "SAME, text here"), (3, "same text here for two rows!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in rows(decontamination.leaks(odd, own))}
    assert got == {(4, 3, 1.0), (5, 3, 1.0)}
    assert decontamination.keep_clean(odd, own).count() == 6 and decontamination.keep_clean(odd, own).columns == odd.columns
    assert rows(decontamination.leaks(empty, own)) == [] and rows(decontamination.leaks(odd, own.where("item_id = 2"))) == []


def test_licenses(spark, texts):
    got = {(r["doc_id"], r["license"]) for r in rows(queries.op1_licenses(spark, SF)) if r["coverage"] == 1}
    short = {k: v for k, v in licenses.TEMPLATES.items() if k.endswith("notice")}
    want = {(d, k) for d, t in texts.items() for k, v in short.items() if v.lower().rstrip(".") in t.lower()}
    assert {g for g in got if g[1] in short} == want


def test_license_with_edits():
    scan = licenses.Scanner().scan
    text = "Some code.\n" + licenses.TEMPLATES["mit-grant"].replace("free of charge", "at no cost").replace("sublicense, ", "") + "\nmore text follows"
    found = {x[0]: x for x in scan(text)}
    assert found["mit-grant"][3] > 0.9
    assert text[found["mit-grant"][6] : found["mit-grant"][7]].startswith("Permission is hereby") and text[: found["mit-grant"][7]].endswith("conditions")
    assert scan("a text about license and version numbers in the software world") == []
    twice = scan("Released under the MIT License. And again: released under the mit license.")
    assert [x[0] for x in twice] == ["mit-notice", "mit-notice"]


def test_whole_licenses_and_their_parts():
    scan = licenses.Scanner().scan
    for name, text in licenses.TEMPLATES.items():
        assert [(x[0], x[3]) for x in scan(f"Some words before.\n{text}\nand after it")] == [(name, 1.0)], name
    bsd = licenses.TEMPLATES["bsd-3-clause"].replace("copyright holder", "University of Somewhere")
    found = scan(bsd)
    assert [x[0] for x in found] == ["bsd-3-clause"] and 0.95 < found[0][3] < 1


@pytest.mark.parametrize("name", ["apache-2.0-header", "mit-grant", "mit"])
@pytest.mark.parametrize("side", ["start", "end"])
def test_licenses_cut_at_the_document(name, side):
    own = licenses.TEMPLATES[name].split()
    for gone in range(0, len(own) // 6):
        text = " ".join(own[gone:] + ["and", "more", "words"]) if side == "start" else " ".join(["words", "before", "it", *own[: len(own) - gone]])
        found = {x[0]: x for x in licenses.Scanner({name: licenses.TEMPLATES[name]}).scan(text)}
        words = len(licenses.plain_words(licenses.TEMPLATES[name]))
        there = len(licenses.plain_words(" ".join(own[gone:] if side == "start" else own[: len(own) - gone])))
        assert found[name][2] == there and found[name][1] == words


def brute_matches(template, text):
    """Most template words that one alignment matches: longest common subsequence with any window."""
    best = np.zeros(len(text) + 1, int)
    for w in template:
        now = best.copy()
        for j, x in enumerate(text):
            now[j + 1] = max(best[j] + (w == x), best[j + 1], now[j])
        best = now
    return int(best[-1])


def test_coverage_of_edited_licenses():
    rng = np.random.default_rng(7)
    template = licenses.plain_words(licenses.TEMPLATES["isc-grant"])
    scanner = licenses.Scanner({"t": " ".join(template)})
    for _ in range(30):
        own = list(template)
        for k in sorted(rng.choice(len(own), 4, replace=False).tolist(), reverse=True):
            own[k : k + 1] = [[], ["new"], [own[k], "more"]][int(rng.integers(0, 3))]
        text = ["lead"] * int(rng.integers(0, 20)) + own + ["tail"] * 5
        (found,) = scanner.scan(" ".join(text))
        assert found[2] == brute_matches(template, own)
        assert text[found[4]] in template and text[found[5] - 1] in template and found[5] - found[4] <= len(own)


def test_spans_are_those_of_the_text():
    for lead in ("", "\u0130" * 5 + " ", "\u1e9e STRASSE "):
        text = lead + "x released under the MIT License. tail"
        (found,) = licenses.Scanner().scan(text)
        assert text[found[6] : found[7]] == "released under the MIT License"


def test_templates_of_one_and_two_words():
    found = licenses.Scanner({"one": "Copyleft", "two": "public domain"}).scan("copyleft or the Public Domain, public or domain")
    assert [(x[0], x[4], x[5]) for x in found] == [("one", 0, 1), ("two", 3, 5)]


def test_license_edges(spark, odd, empty):
    assert rows(licenses.scan(odd)) == [] and rows(licenses.scan(empty)) == []
    notice = "Released under the MIT License."
    docs = [(None, notice), (1, notice), (1, notice), (2, "word " * 50_000 + notice), (3, None)]
    got = rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    assert Counter((r["doc_id"], r["license"], r["first_word"]) for r in got) == {(None, "mit-notice", 0): 1, (1, "mit-notice", 0): 2, (2, "mit-notice", 50_000): 1}
