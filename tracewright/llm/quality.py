"""Quality rules by weak supervision, DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0).  The contingency table of the vote patterns
(at most 3^9 rows whatever the corpus size) is all that leaves the executors; expectation-
maximisation over it estimates, for each rule, how often it votes each way on good and on bad
documents, and the share of good ones.  The posterior of a document is a closed expression over its
votes.

Defined cases: null or empty text has no words, so it fails the base rule and is not kept; a table
without rows yields no rows and the starting accuracies; repeated rows, ties among them, are scored separately and
alike; texts of any length are used whole (windows are compared by 64-bit hash within one text); extra
columns pass through :func:`keep` whatever their names, as measures get a prefix that is free.

:func:`score` and :func:`keep` measure the texts and fit the model when they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, free_prefix, scratch

RULES = (
    "rule_symbols",
    "rule_letters",
    "rule_function_words",
    "rule_word_size",
    "rule_capitals",
    "rule_exclaim",
    "rule_dup_lines",
    "rule_repeats",
    "rule_sentences",
)
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in that is for it with as be this a on are was by from or an "
    "der die das und zu den mit auf ist von ein im eine nicht sich des "
    "le la de et les un en que qui pour dans une sur est du au par pas "
    "el y los se las por con del al para su lo como"
).split()
ITERATIONS = 60
#: Pseudo-counts of a vote that is right, withheld or wrong.
PRIOR = (2.0, 2.0, 0.5)


#: Measures are columns whose names begin so, or longer where the input has such names.
PREFIX = "_q_"
#: White space other than the space.
WHITE = ("\t", "\n", "\x0b", "\x0c", "\r")
FORMS = sorted({f for w in FUNCTION_WORDS for f in (w, w.capitalize(), w.upper())})


def features(docs: DataFrame, p: str = PREFIX) -> DataFrame:
    """All columns of ``docs`` and the measures below, each prefixed ``p`` (which no column of ``docs`` may begin with)."""
    q = lambda name: f"{p}{name}"
    c = lambda name: F.col(q(name))
    out = docs.withColumn(q("text"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    # white space as single marks, which split without a search
    plain = F.col(q("text"))
    for mark in WHITE:
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    out = out.withColumns(
        {
            q("words"): F.array_remove(F.split(plain, " "), ""),
            q("lines"): F.filter(F.split(q("text"), "\n"), lambda x: F.btrim(x, F.lit(" " + "".join(WHITE))) != ""),
        }
    )
    # windows of eight words by doubling: each hash takes in the one that follows it
    longer = lambda name, n: F.when(
        F.size(name) > n,
        F.zip_with(F.slice(name, 1, F.size(name) - n), F.slice(name, n + 1, F.size(name) - n), lambda a, b: F.xxhash64(a, b)),
    )
    out = out.withColumn(q("joined"), F.array_join(q("words"), ""))
    out = out.withColumn(q("one"), F.transform(q("words"), lambda w: F.xxhash64(w)))
    out = out.withColumn(q("two"), longer(q("one"), 1))
    out = out.withColumn(q("four"), longer(q("two"), 2))
    out = out.withColumn(q("windows"), longer(q("four"), 4))
    # Most texts repeat no window: only the others are sorted.
    out = out.withColumn(
        q("sorted"),
        F.when(
            F.size(F.array_distinct(q("windows"))) < F.size(q("windows")),
            F.sort_array(F.transform(q("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    out = out.withColumn(
        q("starts"),
        F.sort_array(
            F.transform(
                F.filter(
                    q("sorted"),
                    lambda x, k: (F.get(q("sorted"), k - 1)["h"] == x["h"]) | (F.get(q("sorted"), k + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    size = F.char_length
    only = lambda of, rest: size(F.regexp_replace(of, rest, ""))
    count = lambda mark: F.octet_length(q("joined")) - F.octet_length(F.replace(c("joined"), F.lit(mark), F.lit("")))
    return out.withColumns(
        {
            # not deterministic on purpose: a filter on the measures must not be pushed below them,
            # where it would repeat their expressions
            q("row"): F.monotonically_increasing_id(),
            q("n_words"): F.size(q("words")).cast("long"),
            q("word_chars"): size(q("joined")).cast("long"),
            q("n_symbols"): only(q("joined"), r"[^#*$%&|<>]+").cast("long"),
            q("n_dup_lines"): (F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("long"),
            q("n_lines"): F.size(q("lines")).cast("long"),
            q("n_function"): F.size(F.filter(q("words"), lambda w: w.isin(*FORMS))).cast("long"),
            q("n_letters"): only(q("joined"), r"\P{L}+").cast("long"),
            q("n_upper"): only(q("joined"), r"\P{Lu}+").cast("long"),
            q("n_exclaim"): count("!").cast("long"),
            q("n_stops"): (count(".") + count("?")).cast("long"),
            q("n_repeat_words"): F.coalesce(
                F.aggregate(
                    q("starts"),
                    F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("p")),
                    lambda a, x: F.struct((a["n"] + F.least(F.lit(8), x - a["p"])).alias("n"), x.alias("p")),
                    lambda a: a["n"],
                ),
                F.lit(0).cast("long"),
            ),
        }
    ).drop(*map(q, ("text", "words", "lines", "joined", "one", "two", "four", "windows", "sorted", "starts")))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def votes(p: str = PREFIX) -> dict[str, Column]:
    c = lambda name: F.col(f"{p}{name}")
    n, chars = c("n_words"), c("word_chars")
    return {
        "rule_symbols": _vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "rule_letters": _vote(100 * c("n_letters") < 90 * chars, 100 * c("n_letters") >= 94 * chars),
        "rule_function_words": _vote(100 * c("n_function") < 4 * n, 100 * c("n_function") >= 10 * n),
        "rule_word_size": _vote((chars > 12 * n) | (chars < 2 * n)),
        "rule_capitals": _vote(10 * c("n_upper") > 3 * chars),
        "rule_exclaim": _vote(10 * c("n_exclaim") > n),
        "rule_dup_lines": _vote(10 * c("n_dup_lines") > 5 * c("n_lines")),
        "rule_repeats": _vote(10 * c("n_repeat_words") > 2 * n),
        "rule_sentences": _vote((c("n_stops") == 0) & (n >= 40)),
    }


def base_failed(p: str = PREFIX) -> Column:
    return (F.col(f"{p}n_words") < 20) | (100 * F.col(f"{p}n_repeat_words") > 30 * F.col(f"{p}n_words"))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents; per rule the chances of the votes (-1, 0, 1) on good and bad ones."""

    good: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def accuracy(self, rule: int) -> tuple[float, float]:
        """How often a vote of the rule is right, on good and on bad documents."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])

    def weight(self, rule: int, vote: int) -> float:
        return math.log(self.on_good[rule][vote + 1] / self.on_bad[rule][vote + 1])

    def log_odds(self, votes_by_rule: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for j, name in enumerate(RULES):
            v = votes_by_rule[name]
            total = total + F.when(v == 1, F.lit(self.weight(j, 1))).when(v == -1, F.lit(self.weight(j, -1))).otherwise(F.lit(self.weight(j, 0)))
        return total


def maximise(patterns: list[tuple[tuple[int, ...], int]]) -> VoteModel:
    """Expectation-maximisation over counted vote patterns, in sorted order (so repeatable).

    It starts from the majority of each pattern's votes.  A rule that turns out to vote against its
    own meaning (bad more often on good documents, or good on bad ones) loses that vote's weight.
    """
    patterns = sorted(patterns)
    share = {p: 0.9 if sum(p) > 0 else 0.1 if sum(p) < 0 else 0.5 for p, _ in patterns}
    model = _maximised(patterns, share)
    for _ in range(ITERATIONS):
        for p, _n in patterns:
            odds = math.log(model.good / (1 - model.good)) + sum(model.weight(j, v) for j, v in enumerate(p))
            share[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        model = _maximised(patterns, share)
    return model


def _maximised(patterns, share) -> VoteModel:
    wrong_last = (PRIOR[2], PRIOR[1], PRIOR[0])
    good = [list(wrong_last) for _ in RULES]
    bad = [list(PRIOR) for _ in RULES]
    total = sum_good = 0.0
    for p, n in patterns:
        g = n * share[p]
        total, sum_good = total + n, sum_good + g
        for j, v in enumerate(p):
            good[j][v + 1] += g
            bad[j][v + 1] += n - g
    for g, b in zip(good, bad):
        g[:], b[:] = [x / sum(g) for x in g], [x / sum(b) for x in b]
        if g[0] > b[0]:
            g[0] = b[0] = (g[0] + b[0]) / 2
        if b[2] > g[2]:
            g[2] = b[2] = (g[2] + b[2]) / 2
        g[:], b[:] = [x / sum(g) for x in g], [x / sum(b) for x in b]
    return VoteModel((sum_good + 1) / (total + 2), tuple(map(tuple, good)), tuple(map(tuple, bad)))


def fit(measured: DataFrame, p: str = PREFIX) -> VoteModel:
    """``measured``: rows of :func:`features`.  Collects at most 3^9 counted patterns."""
    by = [v.alias(k) for k, v in votes(p).items()]
    rows = measured.select(*by).groupBy(*RULES).count().collect()
    return maximise([(tuple(r[k] for k in RULES), r["count"]) for r in rows])


def verdicts(measured: DataFrame, model: VoteModel, p: str = PREFIX) -> DataFrame:
    """Adds posterior, base_failed and kept, prefixed ``p``."""
    return (
        measured.withColumn(f"{p}base_failed", base_failed(p))
        .withColumn(f"{p}posterior", 1 / (1 + F.exp(-model.log_odds(votes(p)))))
        .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}posterior") >= 0.5))
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id, measures, every rule's vote, posterior and verdict for each document."""
    measured = cut(features(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])).drop("text"))
    out = verdicts(measured, fit(measured))
    return out.select(
        "doc_id",
        *[F.col(f"{PREFIX}{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col(f"{PREFIX}posterior").alias("posterior"),
        *[v.alias(k) for k, v in votes().items()],
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns unchanged.

    Rows are measured once: they are written with their measures to a table in the shared folder (columnar and compressed,
    about the size of the input), which the fit reads by its vote columns and the filter as a whole.
    """
    p = free_prefix(docs, PREFIX)
    path = scratch(docs.sparkSession, "quality")
    features(docs, p).write.option("compression", "zstd").parquet(path)
    measured = docs.sparkSession.read.parquet(path)
    return verdicts(measured, fit(measured, p), p).where(F.col(f"{p}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
