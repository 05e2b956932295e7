"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a row) and selectivity are estimated on a bounded sample; rules then run in order of
rejection per cost inside one CASE, so a later rule is not computed for a text that an earlier one rejects. A rule's
rate is what it rejects of the texts that the rules before it leave. What several rules look at (SHARED) is counted
once and before the CASE, and its cost is no rule's; the same columns are given when costs are taken. A cost is the time
over the sample, repeated until that takes long enough to tell, less the time of a job that computes nothing. The order
never changes which texts are kept, only which rule is named for a text that several reject.

Cases: a null text has no words; texts of any length are read whole; repeated rows are judged each; an empty table
gives an empty table (and the rules keep their given order); all other columns pass through untouched, and an
existing column of a result's name is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, WORD, count_words, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Low bits of a window's key that hold its place in the text.
PLACE_BITS = 26
#: Texts on which costs and selectivities are estimated (8 MB at most), and how long they may be; one text in so many, by digest, may be of the sample.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_EVERY = 400, 20_000, 8
#: Net seconds from which a rule's time tells its cost; how often the sample is repeated at most to get there; the least
#: cost of a row, in seconds (what can't be told from nothing).
LONG_ENOUGH, MOST_REPEATS, LEAST_COST = 0.25, 64, 1e-7

Features = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """rejects: from the features of a text to a boolean column."""

    name: str
    rejects: Callable[[Features], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(text: str, place_bits: int = PLACE_BITS) -> Column:
    """Words that lie in a 3-word window found twice or more in the text (long).

    Hashes of the windows, each with its place, are sorted; windows whose hash has a neighbour are then compared as
    strings, so the count is exact. The place stands in the hash's low bits, or, in texts of more words than these bits
    can tell apart, beside the hash.
    """
    place, high = F.lit((1 << place_bits) - 1).cast("long"), F.lit(-(1 << place_bits)).cast("long")
    hashed = lambda w, i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - 2)

    def packed(w: Column) -> Column:
        keys = F.transform(starts(w), lambda i: hashed(w, i).bitwiseAND(high).bitwiseOR(i.cast("long")))
        return covered(w, keys, lambda x: x.bitwiseAND(high), lambda x: x.bitwiseAND(place).cast("int"))

    def paired(w: Column) -> Column:
        keys = F.transform(starts(w), lambda i: F.struct(hashed(w, i).alias("hash"), i.alias("i")))
        return covered(w, keys, lambda x: x["hash"], lambda x: x["i"])

    def covered(w: Column, keys: Column, hash_of: Callable[[Column], Column], at: Callable[[Column], Column]) -> Column:
        same = lambda k, x, j: F.coalesce(hash_of(F.get(k, j)) == hash_of(x), F.lit(False))
        alike = lambda k: F.filter(k, lambda x, j: same(k, x, j - 1) | same(k, x, j + 1))
        return let(F.sort_array(keys), lambda k: let(alike(k), lambda a: F.when(F.size(a) == 0, F.lit(0).cast("long")).otherwise(checked(w, F.transform(a, at)))))

    def checked(w: Column, places: Column) -> Column:
        window = lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
        named = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("window"), i.alias("i"))))
        equal = lambda s, x, j: F.coalesce(F.get(s, j)["window"] == x["window"], F.lit(False))
        twice = let(named, lambda s: F.filter(s, lambda x, j: equal(s, x, j - 1) | equal(s, x, j + 1)))
        found = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(found, lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get(s, j - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(words(text), lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) >= 1 << place_bits, paired(w)).otherwise(packed(w)))


def features(text: str = "text") -> Features:
    """What the rules look at, each computed from the whole text alone."""
    whole = F.coalesce(F.col(text), F.lit(""))
    without = lambda letters: F.length(F.translate(whole, letters, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": count_words(text),
        "word_chars": without(SPACES).cast("long"),
        "n_symbols": (F.length(whole) - without(SYMBOLS)).cast("long"),
        "n_capitals": (F.length(whole) - without(UPPER)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(text),
    }


#: The base rules are the first two.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", lambda f: 20 * f["n_symbols"] > f["word_chars"]),
    Rule("capitals", lambda f: 2 * f["n_capitals"] > f["word_chars"]),
    Rule("dup_lines", lambda f: 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
)


#: Features of several rules.
SHARED = ("n_words", "word_chars")


@dataclass(frozen=True)
class Estimate:
    """cost: seconds a row; rejected: of the texts that the rules before this one leave, the share it rejects."""

    rule: Rule
    cost: float
    rejected: float


def seconds(job: DataFrame) -> float:
    began = time.perf_counter()
    job.collect()
    return time.perf_counter() - began


def costs(sample: DataFrame, n: int, verdicts: dict[str, Column]) -> dict[str, float]:
    """Seconds a row of each verdict over the sample of n rows, net of what a job itself takes."""
    again = lambda column, repeats: sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).agg(F.count_if(column).alias("n"))
    nothing, found = {}, {}
    for name, verdict in verdicts.items():
        repeats = 1
        while True:
            if repeats not in nothing:
                nothing[repeats] = min(seconds(again(F.col("_again") < 0, repeats)) for _ in range(3))
            job = again(verdict, repeats)
            net = min(seconds(job) for _ in range(2)) - nothing[repeats]
            if net >= LONG_ENOUGH or repeats >= MOST_REPEATS:
                break
            repeats *= 8
        found[name] = max(net, LEAST_COST * n * repeats) / (n * repeats)
    return found


def ranked(rules: tuple[Rule, ...], cost: dict[str, float], rejects: list[dict[str, bool]]) -> list[Estimate]:
    """Rules by rejection per cost, each rate among the sampled texts that all rules before leave; ties by name."""
    left, found = list(rules), []
    while left:
        share = {r.name: sum(x[r.name] for x in rejects) / max(1, len(rejects)) for r in left}
        best = min(left, key=lambda r: (-share[r.name] / cost[r.name], r.name))
        found.append(Estimate(best, cost[best.name], share[best.name]))
        rejects = [x for x in rejects if not x[best.name]]
        left.remove(best)
    return found


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = SHARED) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of texts, in the order in which they should run. given: features that are columns by then."""
    some = df.select(F.col(text).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    taken = some.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_EVERY)) == 0).take(sample_rows) or some.take(sample_rows)
    if not taken:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    of, spark = features("text"), df.sparkSession
    counted = spark.createDataFrame(taken, "text string").select("text", *(of[c].alias(c) for c in given))
    sample = spark.createDataFrame(counted.collect(), counted.schema).coalesce(1)
    verdicts = {r.name: r.rejects(of | {c: F.col(c) for c in given}) for r in rules}
    rejects = [r.asDict() for r in sample.select(*(F.coalesce(v, F.lit(False)).alias(n) for n, v in verdicts.items())).collect()]
    return ranked(rules, costs(sample, len(taken), verdicts), rejects)


def judge(df: DataFrame, rules: list[Rule], of: Features) -> DataFrame:
    """Adds failed_rule (null if none) and kept; a rule's features are computed only if all rules before it let the text pass."""
    failed = F.lit(None).cast("string")
    for rule in reversed(rules):
        failed = F.when(rule.rejects(of), F.lit(rule.name)).otherwise(failed)
    return df.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The table with failed_rule and kept, rules ordered by their estimates."""
    order = [e.rule for e in estimate(df, rules, text, sample_rows)]
    of = features("_row." + text)
    shared = df.select(F.struct(*df.columns).alias("_row"), *(of[c].alias(f"_{c}") for c in SHARED))
    judged = judge(shared, order, of | {c: F.col(f"_{c}") for c in SHARED})
    return judged.select(*(F.col("_row")[c].alias(c) for c in df.columns if c not in ("failed_rule", "kept")), "failed_rule", "kept")
