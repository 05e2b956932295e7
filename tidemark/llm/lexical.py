"""Ranked lexical search: the best documents of each item, by branch and bound over document tries.

A document's vector is restricted to the terms of the items, its terms in the order of how many documents hold them.
Documents of a task are dealt to tries of up to TREE_DOCS; documents that begin with the same terms share a path, and a
path is followed while more than LEAF documents share it. Each node knows the largest tf of every term below it and the
least m, so it bounds the score of every document below: a score grows with tf and falls with m. An item goes down the
children with the largest bound first and leaves out those whose bound is below its twentieth score so far; whole
documents are scored at the leaves, in integers. What an item has found in one trie holds for all later ones of the
task; before that, a first trie of few documents with the longest restricted vectors tells every task scores that are
reached for certain, so a task begins with a bound.

Items go in blocks of BLOCK_TERMS distinct terms (or one item), and a block takes one pass over the documents, so what
tasks get by closure is bounded. Counts (N, L, df) are made over all documents.

Cases: null and empty texts have no terms; documents without terms, or with none of an item's, are not ranked for it,
nor are documents whose score is 0; items without terms have no rows; rows that repeat a document are documents like
others, and rows that repeat an item are answered each; a null doc_id comes last among equal scores; texts of any length
are used whole; empty tables give an empty table; other columns are not kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import spread
from tidemark.llm.arrow import small_batches
from tidemark.llm.common import LOWER, UPPER, drop, save

#: A term: letters and digits of ASCII, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of a document's m, in hundredths; the factor of m and of tf in a score.
FLAT, SLOPE, BY_M, BY_TF, UNIT = 75, 25, 12, 1000, 1_000_000_000
WEIGHT = 1000
#: Distinct terms of a block of items.
BLOCK_TERMS = 200_000
#: Documents and (document, term) pairs of a trie; documents of a leaf.
TREE_DOCS, TREE_PAIRS, LEAF = 16_384, 2_000_000, 32
#: Leaves that are scored together; bits of a tf (a text has fewer than 2^31 bytes).
TOGETHER, TF_BITS = 16, 30
#: Documents of the first trie, and terms of a document that it takes.
FIRST_DOCS = 2000
#: An id that stands for null: it comes after all others.
_NO_ID = 2**63 - 1


def terms(text: Column) -> Column:
    """The terms of a text, repeats included."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_TERM), lambda t: t != "")


def restricted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id (null: the largest number), n (terms of the text), codes (places in the vocabulary, ascending), tfs."""
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text", rows=4096, size=4_000_000):
                split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), NOT_TERM)
                owner, each = pc.list_parent_indices(split), pc.list_flatten(split)
                real = pc.greater(pc.binary_length(each), 0)
                owner, each = owner.filter(real).to_numpy(), each.filter(real)
                n = np.bincount(owner, minlength=batch.num_rows)
                code = pc.index_in(each, value_set=known)
                held = code.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(owner[held].astype(np.int64) * len(known) + pc.drop_null(code).to_numpy(), return_counts=True)
                begin = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * len(known)), pa.int32())
                lists = [pa.ListArray.from_arrays(begin, pa.array(v, pa.int32())) for v in (key % len(known), tf)]
                yield pa.RecordBatch.from_arrays([pc.fill_null(batch.column("doc_id"), _NO_ID), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


class Statistics:
    """What scores need: N, L and the weights of the terms."""

    def __init__(self, documents: int, length: int, often: np.ndarray):
        self.documents, self.length = documents, length
        self.weights = np.array([floor(WEIGHT * log((2 * documents + 2) / (2 * int(df) + 1))) for df in often], dtype=np.int64)
        self.place = np.empty(len(often), dtype=np.int64)  # of a term in the order of frequency
        self.place[np.lexsort((np.arange(len(often)), -often))] = np.arange(len(often))

    def m(self, n: np.ndarray) -> np.ndarray:
        return FLAT + (SLOPE * n * self.documents) // self.length


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (BY_TF * tf + BY_M * m)


def paths(size: np.ndarray, begin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents in the order of their paths, and where the nodes of each level begin in it. A node of LEAF documents or fewer, or of such that have ended, is not split."""
    order, node = np.arange(len(size)), np.zeros(len(size), dtype=np.int64)
    split, starts = np.full(len(size), len(size) > LEAF), [np.zeros(1, dtype=np.int64)]
    for level in range(int(size.max(initial=0))):
        if not split.any():
            break
        term = np.full(len(size), -1, dtype=np.int64)
        goes_on = split & (size[order] > level)
        term[goes_on] = place[begin[order[goes_on]] + level]
        by = np.lexsort((term, node))
        order, node, term = order[by], node[by], term[by]
        new = np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]
        node = np.cumsum(new) - 1
        starts.append(np.flatnonzero(new))
        split = ((np.bincount(node) > LEAF) & (term[new] >= 0))[node]
    return order, starts


class Trie:
    """Documents in the order of their paths; a node is a range of them, and its children stand next to each other. Of each term: the nodes below which it occurs, and what it adds there at most."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, begin: np.ndarray, place: np.ndarray, tf: np.ndarray, terms: int):
        """begin: where each document's terms begin; place: places (below `terms`) in the order of frequency, ascending within a document."""
        size = np.diff(begin)
        order, levels = paths(size, begin, place)
        self.ids, self.m, self.begin = ids[order], m[order], np.r_[0, np.cumsum(size[order])]
        own = np.repeat(begin[order] - self.begin[:-1], size[order]) + np.arange(len(tf))
        self.place, tf = place[own], tf[own]
        self.impact, owner = impact(tf, np.repeat(self.m, size[order])), np.repeat(np.arange(len(ids)), size[order])
        self.low, self.high, self.first, self.last = [], [], [], []  # documents and children of the nodes
        entries, above = [], None
        for starts in levels:
            stops = np.r_[starts[1:], len(ids)]
            if above is None:
                new, number = np.ones(len(starts), dtype=bool), np.zeros(len(starts), dtype=np.int64)
            else:
                up = np.searchsorted(above[0], starts, side="right") - 1
                new = (above[0][up] != starts) | (above[1][up] != stops)  # others are their parents
                number = np.where(new, len(self.low) + np.cumsum(new) - 1, above[2][up])
                parent = above[2][up[new]]
                at = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]][: len(parent)])
                for a, b in zip(at.tolist(), np.r_[at[1:], len(parent)].tolist(), strict=False):
                    self.first[parent[a]], self.last[parent[a]] = len(self.low) + a, len(self.low) + b
            low, high = starts[new], stops[new]
            self.low += low.tolist()
            self.high += high.tolist()
            self.first += [0] * len(low)
            self.last += [0] * len(low)
            if len(low):
                node = np.searchsorted(low, owner, side="right") - 1
                inside = (node >= 0) & (owner < high[node])
                packed = np.sort((node[inside] * terms + self.place[inside]) << TF_BITS | tf[inside])
                key, most = packed >> TF_BITS, packed & ((1 << TF_BITS) - 1)
                at = np.flatnonzero(np.r_[key[1:] != key[:-1], True][: len(key)])  # the last of a key has its largest tf
                node, term = np.divmod(key[at], terms)
                least = np.minimum.reduceat(np.r_[self.m, self.m.max()], np.stack([low, high], axis=1).ravel())[::2]
                entries.append((term, len(self.low) - len(low) + node, impact(most[at], least[node])))
            above = starts, stops, number
        term, node, bound = (np.concatenate(x) for x in zip(*entries, strict=True))
        by = np.argsort(term, kind="stable")
        self.nodes, self.bounds, self.node_begin = node[by], bound[by], np.searchsorted(term[by], np.arange(terms + 1))
        self.low, self.high, self.first, self.last = (np.array(x) for x in (self.low, self.high, self.first, self.last))

    def node_bounds(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the documents of each node score at most."""
        out = np.zeros(len(self.low), dtype=np.int64)
        for p, w in zip(places.tolist(), weights.tolist(), strict=True):
            own = slice(self.node_begin[p], self.node_begin[p + 1])
            out[self.nodes[own]] += w * self.bounds[own]  # a node once a term
        return out


def search(trie: Trie, weights: np.ndarray, places: np.ndarray, best: tuple[np.ndarray, np.ndarray], floor_score: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """weights: of all places, 0 where the item lacks the term; places: those it has. best: scores and ids found so far, best first. Those after this trie; no document of less than floor_score is wanted."""
    scores, ids = best
    least = max(floor_score, int(scores[k - 1]) if len(scores) >= k else 1)
    bounds = trie.node_bounds(places, weights[places])
    stack = [np.zeros(1, dtype=np.int64)]
    while stack:
        nodes = stack.pop()
        nodes = nodes[bounds[nodes] >= least]
        inner = trie.last[nodes] > 0
        deeper = nodes[inner]
        stack += [np.arange(trie.first[n], trie.last[n]) for n in deeper[np.argsort(bounds[deeper], kind="stable")]]  # the largest is taken first
        leaves = nodes[~inner]
        leaves = leaves[np.argsort(-bounds[leaves], kind="stable")]
        for a in range(0, len(leaves), TOGETHER):
            some = leaves[a : a + TOGETHER]
            some = some[bounds[some] >= least]
            if not len(some):
                break
            docs = ranges(trie.low[some], trie.high[some])
            begin, end = trie.begin[docs], trie.begin[docs + 1]
            own = ranges(begin, end)
            found = np.add.reduceat(weights[trie.place[own]] * trie.impact[own], np.cumsum(end - begin) - (end - begin))
            good = np.flatnonzero(found >= least)
            if len(good):
                scores, ids = np.r_[scores, found[good]], np.r_[ids, trie.ids[docs[good]]]
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                if len(scores) >= k:
                    least = max(least, int(scores[k - 1]))
    return scores, ids


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0], ..., end[0] - 1, begin[1], ..."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def tries(batches: Iterator[pa.RecordBatch], statistics: Statistics) -> Iterator[Trie]:
    parts, docs, pairs = [], 0, 0

    def built() -> Trie:
        batch = pa.Table.from_batches(parts).combine_chunks()
        of = lambda c: batch.column(c).combine_chunks()
        size = pc.list_value_length(of("codes")).to_numpy()
        place, tf = statistics.place[of("codes").flatten().to_numpy()], of("tfs").flatten().to_numpy().astype(np.int64)
        order = np.lexsort((place, np.repeat(np.arange(len(size)), size)))
        return Trie(of("doc_id").to_numpy(), statistics.m(of("n").to_numpy()), np.r_[0, np.cumsum(size)], place[order], tf[order], len(statistics.place))

    for big in batches:
        for batch in small_batches(big, "codes", rows=TREE_DOCS, size=TREE_PAIRS):
            many = len(batch.column("codes").flatten())
            if docs and (docs + batch.num_rows > TREE_DOCS or pairs + many > TREE_PAIRS):
                yield built()
                parts, docs, pairs = [], 0, 0
            parts.append(batch)
            docs, pairs = docs + batch.num_rows, pairs + many
    if docs:
        yield built()


def searched(vectors: DataFrame, items: list[Counter], statistics: Statistics, floors: list[int], k: int) -> DataFrame:
    """vectors: as restricted. items: how often each holds a term, by code. The best of each task: item (place in the list), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        weights = np.zeros(len(statistics.place), dtype=np.int64)
        for trie in tries(batches, statistics):
            for n, item in enumerate(items):
                codes, many = np.fromiter(item, np.int64), np.fromiter(item.values(), np.int64)
                at = statistics.place[codes]
                weights[at] = many * statistics.weights[codes]
                best[n] = search(trie, weights, at, best[n], floors[n], k)
                weights[at] = 0
        number = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        of = [number.astype(np.int32), *(np.concatenate([b[x] for b in best] or [np.empty(0, np.int64)]) for x in (1, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in of], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    named = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")).select("item_id", "copies", terms(F.col("text")).alias("terms"))
    named = save(named.where(F.size("terms") > 0), "lexical-items")
    many = named.agg(F.sum(F.size(F.array_distinct("terms")))).first()[0] or 0
    blocks, out = max(1, ceil(2 * many / block_terms)), None
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()  # bounded: a block
        if rows:
            found = of_block(docs, rows, k)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def of_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    code = {t: n for n, t in enumerate(vocabulary)}
    items = [Counter(code[t] for t in r["terms"]) for r in rows]
    vectors = save(restricted(spread(docs.select("doc_id", "text")), vocabulary), "lexical-vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    often = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row a term of the block
        often[r["code"]] = r["count"]
    statistics = Statistics(total["n"], max(1, total["l"]), often)
    held = vectors.where(F.size("codes") > 0)
    first = held.orderBy(F.desc(F.size("codes")), "doc_id", "n", "codes", "tfs").limit(FIRST_DOCS)
    known = [[] for _ in items]
    for r in searched(first, items, statistics, [1] * len(items), k).collect():  # k rows an item
        known[r["item"]].append(r["score"])
    floors = [min(s) if len(s) >= k else 1 for s in known]
    best = save(best_of(searched(held, items, statistics, floors, k), k), "lexical-best")
    drop(vectors)
    side = spark.createDataFrame([(n, r["item_id"], r["copies"]) for n, r in enumerate(rows)], "item int, item_id long, copies long")
    named = best.join(F.broadcast(side), "item")  # a row an item of the block
    again = named.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")
