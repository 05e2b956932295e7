"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in turn each feature (later each chosen pair of features) gets a shallow tree fitted to the loss's
gradients, which is added to the lookup table of that feature (pair). A score is the sum of one entry of each table,
through the logistic function; scoring is vectorised bin additions.

The model is fitted on the driver, on a bounded sample of labelled documents (SAMPLE_ROWS, chosen by a digest of their
ids); features are computed by Spark, from whole texts.

Cases: null and empty texts have all features 0 and a score as any other text; rows whose label is null, or whose id is
null or not in documents, teach nothing; several labels of a document all count, and so do several documents of an id,
up to the sample's bound; repeated rows are scored each; without any label all scores are 0.5; an empty table gives an
empty table; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import rules
from tidemark.llm.common import words

#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_WEIGHT = 150, 80, 0.15, 2.0


def features(text: str = "text") -> dict[str, Column]:
    of = rules.features(text)
    whole = F.coalesce(F.col(text), F.lit(""))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern))
    distinct = rules.let(words(text), lambda w: share(F.size(F.array_distinct(w)), F.size(w)))
    longest = rules.let(words(text), lambda w: F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).cast("double"))
    return {
        "log_words": F.log1p(of["n_words"].cast("double")),
        "word_length": share(of["word_chars"], of["n_words"]),
        "symbols": share(of["n_symbols"], of["word_chars"]),
        "capitals": share(of["n_capitals"], of["word_chars"]),
        "dup_lines": share(of["n_dup_lines"], of["n_lines"]),
        "line_words": share(of["n_words"], of["n_lines"]),
        "distinct_words": distinct,
        "longest_word": longest,
        "digits": share(count("[0-9]"), of["word_chars"]),
        "stops": share(count("[.,;:]"), of["n_words"]),
        "shouts": share(count("[!?]"), of["n_words"]),
        "other_signs": share(count(r"[@/\\_=+{}\[\]()~^-]"), of["word_chars"]),
    }


NAMES = ("log_words", "word_length", "symbols", "capitals", "dup_lines", "line_words", "distinct_words", "longest_word", "digits", "stops", "shouts", "other_signs")


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + LEAST_WEIGHT)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + LEAST_WEIGHT)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Of bins in order: what the best cut gains, and the first bin right of it."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = gain(gl, hl) + gain(g.sum() - gl, h.sum() - hl) - gain(g.sum(), h.sum())
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over bins in order, as a value a bin."""
    _, first = best_cut(g, h)
    sides = [(0, first), (first, len(g))] if first else [(0, len(g))]
    inner = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in sides]
    most, cut, a, _ = max(inner)
    edges = sorted({0, first, len(g), *([a + cut] if most > 0 and cut else [])})
    out = np.empty(len(g))
    for x, y in zip(edges, edges[1:], strict=False):
        out[x:y] = leaf(g[x:y].sum(), h[x:y].sum())
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a grid of bins: what the best pair of cuts gains, and its four leaves as a value a cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gains = sum(gain(x, y) for x, y in zip(*parts, strict=True)) - gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for rows, a in ((slice(0, i + 1), 0), (slice(i + 1, None), 2)):
        for cols, b in ((slice(0, j + 1), 0), (slice(j + 1, None), 1)):
            k = a + b
            out[rows, cols] = leaf(parts[0][k][i, j], parts[1][k][i, j])
    return float(gains[i, j]), out


@dataclass
class Additive:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def edges_of(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """x: a row a document; y: 0 or 1."""
    model = Additive([edges_of(c, BINS) for c in x.T], [edges_of(c, PAIR_BINS) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    mean = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), model.bias)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[k])
            step = RATE * shallow_tree(np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size))
            model.tables[k] += step
            total += step[own]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))]
        return *sums, cell

    wide = [p for p in combinations(range(x.shape[1]), 2) if sizes[p[0]] > 1 and sizes[p[1]] > 1]
    ranked = sorted(wide, key=lambda p: (-quadrants(*grid(*p)[:2])[0], p))[:PAIRS]
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p, table in model.pairs.items():
            g, h, cell = grid(*p)
            step = RATE * quadrants(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return model


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """docs: doc_id, text. labels: doc_id, quality (0 or 1); rows held out (remainder 0) are not learned from."""
    usable = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id") != 0)).select(F.col("doc_id").alias("labelled"), "quality")
    sample = usable.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample_rows)  # bounded, so it can be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    known = joined.select("labelled", "quality", *(c.alias(n) for n, c in features().items()))
    # the same rows in the same order in every run; bounded too where many documents have one id
    rows = known.orderBy(F.xxhash64("labelled"), "labelled", "quality", *NAMES).limit(sample_rows).toPandas()
    return fit(rows[list(NAMES)].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """Adds score (double)."""

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return docs.withColumn("score", scored(*(features(text)[n] for n in NAMES)))
