"""Operators 11 to 13 against brute force, and their edge cases."""

import gc
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.llm import alignment, cutting_stock, queries, sql, vector_codes
from tracewright.llm.words import WordEncoder

SF = "/root/testdata/sf0.001"
ODD = [
    "", "a", " a", "a ", "a  b", "x\ty", "▁a b", "a\n\nb", "a\nb", "\nfoo", "日本語 テキスト\n日本", "<|endoftext|> <s> x\n<s>", "é x É é", "a\x00b c", "x \x00 y",
    "don't\nDON'T 's", "🙂🙂 x🙂", "a" * 3000, "x y z", "ΣΑΣ ΟΔΟΣ.", "İstanbul ǅ ŉ", "foo\x1cbar\x85baz", "a , b ... c!!", "foo\rbar\r\nz", "word " * 20_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a null, repeated rows and extra columns whose names the operators use."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(900, None), (None, "no id here"), (901, "twice"), (901, "twice"), (902, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("serial", "length", "rank", "salt", "piece", "id", "tape", "n_a", "places", "sequence_id", "offset"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 11 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def two():
    return alignment.Aligner(*alignment._paths(None, None))


def brute_groups(two, text):
    """(A ids, B ids, groups as pairs of lists), or None."""
    if not text:
        return None
    a, b = two._a([f" {text}"])[0], two.second.encode(text)
    want = f" {text}".encode()
    if b"".join(two.of_a.tokens[x] for x in a) != want or b"".join(two.of_b.tokens[x] for x in b) != want:
        return None
    ends = [np.cumsum([len(of.tokens[x]) for x in ids]).tolist() for of, ids in ((two.of_a, a), (two.of_b, b))]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, out


def brute_scores(two, docs):
    known = [(i, brute_groups(two, t)) for i, t in docs]
    count = Counter((g[0][-1], g[1][-1]) for _, k in known if k for g in k[2])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, k in known:
        if k is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = k
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(count[x] == best[x[1]] for x in links)
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_alignment_equals_brute_force_over_the_table(spark, two):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    same(queries.op11_token_alignment(spark, SF).collect(), brute_scores(two, list(zip(t["doc_id"], t["text"]))))


def test_alignment_of_odd_texts(spark, two, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same(alignment.score(odd.repartition(3)).collect(), brute_scores(two, docs))
    shown = {r["doc_id"]: r["groups"] for r in alignment.groups(odd).collect()}
    assert shown[6] == "" == shown[0] and shown[1].count("|") == 1
    assert alignment.score(empty).collect() == [] == alignment.pair_counts(empty).collect()


def test_pairs_are_counted_within_their_bound(spark, two, odd):
    counts = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(odd).collect()}
    want = Counter((g[0][-1], g[1][-1]) for r in odd.collect() if (k := brute_groups(two, r["text"])) for g in k[2])
    assert counts == want
    for a, b in counts:
        x, y = two.of_a.tokens[a], two.of_b.tokens[b]
        assert x.endswith(y) or y.endswith(x)
    small_a, small_b = [b"ab", b"b", b"", b"cab"], [b"b", b"ab", b"x", b"b"]
    assert alignment.most_pairs(small_a, small_b) == sum(1 for x in small_a for y in small_b if x and y and (x.endswith(y) or y.endswith(x)))


def test_shards_are_cut_between_files(spark, odd, monkeypatch):
    whole = sorted(alignment.score(odd).collect(), key=str)
    monkeypatch.setattr(alignment, "FILE_BYTES", 64)
    assert sorted(alignment.score(odd).collect(), key=str) == whole


def test_words_are_forgotten(two, monkeypatch):
    texts = [f"word{k} other{k % 7}\nline{k}" for k in range(200)]
    want = [b"".join(w) for w in two.texts(texts)[-1]]
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 50)
    fresh = alignment.Aligner(*alignment._paths(None, None))
    assert [b"".join(w) for k in range(0, 200, 20) for w in fresh.texts(texts[k : k + 20])[-1]] == want


# --- 12 ------------------------------------------------------------------------------------------


def test_tree_finds_what_comparing_all_finds():
    rng = np.random.default_rng(5)
    fewer = 0
    for k in range(120):
        n, width, size = int(rng.integers(1, 40)), int(rng.integers(1, 9)), int(rng.choice([2, 60, 10**6, 10**8]))
        entries = rng.integers(-size, size + 1, (n, width))
        if k % 3 == 0:
            entries[rng.integers(0, n, n // 2 + 1)] = entries[0]
        asked = np.concatenate([rng.integers(-size, size + 1, (100, width)), entries, entries + 1])
        search = vector_codes.Search(entries)
        entry, away = search.nearest(asked)
        table = ((asked[:, None] - entries[None]) ** 2).sum(-1)
        assert (entry == table.argmin(1)).all() and (away == table.min(1)).all()
        fewer += search.compared < table.size
    assert fewer > 20


def test_roots_are_rounded_outwards():
    x = np.array([0, 1, 2, 3, 4, 15, 16, 17, 2**52 + 1, 94906267**2 - 1, 94906267**2, 2**60 - 1, (2**30) ** 2])
    low, high = vector_codes.roots(x)
    for v, a, b in zip(x.tolist(), low.tolist(), high.tolist()):
        assert a * a <= v <= b * b and b - a <= 1 and (a + 1) ** 2 > v


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, label, vector); plain Python integers."""
    import math

    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = len(kept[0][2]) // parts
    cut = [[[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assign():
        return [[min((away(x[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[k][p] for k, a in enumerate(now) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    now = assign()
    error = [sum(d for d, _ in a) for a in now]
    label = defaultdict(int)
    for (_, l, _), e in zip(kept, error):
        label[l] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in a), e, label[r[1]]) for r, a, e in zip(kept, now, error)], digest


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(k) % 3 if k % 4 else None, rng.normal(size=16).astype("f4").tolist()) for k in rng.permutation(90)]
    rows += [(200 + k, 1, rows[0][2]) for k in range(40)]  # a very common vector
    rows += [(300, 1, None), (301, 1, [None] * 16), (302, 1, [float("nan")] * 16), (303, 2, [float("inf")] * 16), (304, None, [-1e-9] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("x", F.lit(1)).repartition(5)
    out, books = vector_codes.codes(df)
    want, digest = brute_codes(rows)
    assert sorted(map(tuple, out.select("id", "code", "error", "label_error").collect())) == sorted(want)
    assert vector_codes.digest(books) == digest


def test_codes_of_odd_tables(spark):
    ddl = "vec_id long, label int, embedding array<double>"
    out, books = vector_codes.codes(spark.createDataFrame([], ddl))
    assert out.collect() == [] and all(len(b) == 0 for b in books)
    # another length goes, three components are filled up to eight, a huge one is clamped, null ids come last
    rows = [(None, 1, [1.0, 2.0, 3.0]), (5, 1, [1e300, 0.0, 0.0]), (5, 1, [0.0, 0.0, 0.0]), (6, 1, [1.0]), (7, None, [0.0, 0.0, 0.0])]
    out, books = vector_codes.codes(spark.createDataFrame(rows, ddl), entries=2, rounds=0)
    got = out.collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in got) == [(False, 5), (False, 5), (False, 7), (True, 0)]
    assert books[0][:, 0].tolist() == [0, vector_codes.Shape(3).bound] and all(len(r["code"]) == 16 for r in got)
    one = vector_codes.codes(spark.createDataFrame([(1, 1, [])], ddl))[0].collect()
    assert [(r["code"], r["error"]) for r in one] == [("00" * 8, 0)]


def test_codes_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({sql.vector_codes()})").fetchall()
    assert sorted(map(tuple, queries.op12_vector_codes(spark, SF).collect())) == sorted(want)


# --- 13 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_ids():
    import public_tokenizers

    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_words_encode_as_the_library(word_ids, monkeypatch):
    texts = ODD + [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    want = [e.ids for e in word_ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for together in (len(texts), 7):
        got = []
        for at in range(0, len(texts), together):
            flat, sizes = word_ids.encode(texts[at : at + together])
            ends = np.cumsum(sizes)
            got += [flat[e - n : e].tolist() for n, e in zip(sizes, ends)]
            assert int(ends[-1]) == len(flat)
        assert got == want
        monkeypatch.setattr("tracewright.llm.words.KNOWN_WORDS", 100)


def test_words_that_are_met_again_stay(word_ids, monkeypatch):
    monkeypatch.setattr("tracewright.llm.words.KNOWN_WORDS", 60)
    word_ids.forget()
    letters = "bcdfghjklm"
    for k in range(12):
        # ten new words a round, and one that is in each
        texts = ["often, " + " ".join(f"{letters[k % 10]}{a}o{b}" for a, b in zip("aeiou" * 2, letters)) + f" {k}x{k}"]
        flat, sizes = word_ids.encode(texts)
        assert flat.tolist() == word_ids.tokenizer.encode(texts[0], add_special_tokens=False).ids and sizes.tolist() == [len(flat)]
        assert "often," in word_ids.known
        if k == 6:
            place = word_ids.known["often,"]
    # it was carried on twice, while what was met once went
    assert len(word_ids.known) < 100 and place < 20 and gc.isenabled()
    assert "0x0" not in word_ids.known


def packed_right(rows, docs, word_ids, capacity):
    """Every id in one piece, every sequence gapless; returns the padding."""
    texts = [t or "" for _, t in docs]
    ids = [np.array([*e.ids, 1], "<u4") for e in word_ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for (doc_id, _), own in zip(docs, ids):
        want[doc_id].append(own)
    assert set(pieces) == set(want)
    for doc_id, copies in want.items():
        assert sum(p[1] for p in pieces[doc_id]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc_id]):
                assert start == at and total == len(copies[0]) and length > 0
                at += length
                assert zlib.crc32(copies[0][start:at].tobytes()) == crc
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_cutting_stock_packs_the_table_without_padding(spark, word_ids):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = list(zip(t["doc_id"], t["text"]))
    rows = queries.op13_cutting_stock(spark, SF).collect()
    assert packed_right(rows, docs, word_ids, 2048) == 0
    pieces = Counter(r["doc_id"] for r in rows)
    # few documents are cut without need
    assert sum(pieces[i] > -(-n // 2048) for i, n in {(r["doc_id"], r["doc_tokens"]) for r in rows}) <= 0.05 * len(docs)


def test_cutting_stock_of_odd_texts(spark, word_ids, odd, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for capacity, broadcast in ((64, 100_000), (2048, 100_000), (64, 0)):
        monkeypatch.setattr(cutting_stock, "MOST_BROADCAST", broadcast)
        rows = cutting_stock.pack_documents(odd.repartition(3), cutting_stock.Stock(capacity=capacity)).collect()
        assert packed_right(rows, docs, word_ids, capacity) == 0
    assert cutting_stock.pack_documents(empty).collect() == []


def test_program_meets_its_bound():
    rng = np.random.default_rng(1)
    for _ in range(15):
        lengths = rng.choice(np.arange(5, 60), int(rng.integers(1, 7)), replace=False)
        histogram = {int(x): int(rng.integers(1, 400)) for x in lengths}
        stock = cutting_stock.Stock(capacity=64, gap=1e-9, patience=50)
        s = cutting_stock.solve(histogram, stock)
        for x, n in histogram.items():
            assert abs(sum(dict(p).get(x, 0) * u for p, u in s.patterns) - n) < 1e-6 * n
        assert s.cost >= s.bound * (1 - 1e-9) and s.cost <= s.bound * (1 + 1e-6)
        assert all(cutting_stock._fill(p) <= 64 for p, _ in s.patterns)


def test_knapsack_is_exact():
    lengths, price = np.array([3, 5, 11]), np.array([1.0, 2.2, 4.1])
    sack = cutting_stock.Knapsack(lengths, price, 40)
    for fill in range(1, 41):
        ways = [a + 2.2 * b + 4.1 * c for a in range(14) for b in range(9) for c in range(4) if 3 * a + 5 * b + 11 * c == fill]
        assert (max(ways) if ways else -np.inf) == pytest.approx(sack.best[fill])
        if ways:
            assert sum(int(lengths[k]) * n for k, n in sack.counts(fill).items()) == fill


def test_columns_are_generated_where_first_fit_wastes():
    # first fit puts 50 and 10 together twice; 34 + 30 is the only full pattern
    s = cutting_stock.solve({34: 100, 30: 100, 50: 10, 14: 10, 22: 40}, cutting_stock.Stock(capacity=64, gap=1e-9))
    assert s.rounds > 0 and s.cost <= s.history[0]


@pytest.mark.parametrize("histogram", [{1100: 500}, {1: 5000}, {1024: 7, 3: 2}, {2047: 3, 1: 1}, {1100: 500, 900: 99, 30: 7}, {k: 1 for k in range(1, 2048, 3)}])
def test_plan_places_every_item_and_pads_nothing(histogram):
    p = cutting_stock.plan(histogram)
    fills, taped = Counter(), 0
    for length in histogram:
        own = [s for s in p.steps.tolist() if s[0] == length]
        assert own[0][1] == 0 and own[-1][2] == histogram[length] and all(a[2] == b[1] for a, b in zip(own, own[1:]))
    for length, first, end, sequence, _, each, tape in p.steps.tolist():
        for rank in range(first, end):
            if tape < 0:
                fills[sequence + (rank - first) // each] += length
            else:
                taped += length
                for _, n, s, at in cutting_stock.tape_pieces(p.cuts, tape + (rank - first) * length, length):
                    fills[s] += n
                    assert 0 <= at and at + n <= 2048
    assert sum(fills.values()) == sum(k * n for k, n in histogram.items()) and len(fills) == p.sequences
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())
    assert taped <= sum(fills.values())
