"""MinHash near-duplicate removal.

A document's set is its distinct shingles of words. Documents of equal sets form one class. Each class gets a
one-permutation MinHash signature: its hashes are dealt to bins by their top bits, the least of a bin is its value, and
an empty bin takes the value of a full one, found along a random order of its own (optimal densification). Bands of
bins are the buckets. In a bucket, edges go from centers to the other members only (a star), never between all pairs;
edges whose signatures differ too much are left out, the others are confirmed on the full sets.

A star alone may miss a link between two members that both aren't linked to the center. So members of buckets in which
several components remain are compared once more, exactly: their shingles are ordered by how rare they are among
these members, and two sets that are similar enough must share one among the rarest of both (prefix filter), at places
that leave enough for the rest (positional filter). Only pairs of different components are looked at.

Cases: null, empty and blank texts have empty sets and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows with null ids link and are linked as all others, but never name a component (one without any id has
the name null); repeated rows are in one class; rows that repeat an id are judged each by its own text; texts of any
length are used whole; an empty table gives an empty table; other columns are not kept by `near_duplicates`, and all
are, whatever their names, by `without_near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat_text, small_batches
from tidemark.llm.common import drop, hot_keys, salted_join, save, small_side

#: Words of a shingle; bins of a signature; how likely a pair at the threshold may share no band.
SHINGLE, BINS, MISSED = 5, 192, 1e-6
#: Bins in which two signatures must agree: at a similarity of 0.85 fewer agree with probability under 1e-8; lower thresholds lower it alike.
SLACK = 0.15
#: Rows up to which a table of ids and text digests (two numbers a row, 32 MB in all) is broadcast to the scan of the texts.
MANY_IDS = 2_000_000
#: An id that stands for null: it comes after all others.
_NO_ID = 2**63 - 1

U = np.uint64
_random = np.random.default_rng(20240601)
_BYTE = _random.integers(0, 2**64, 256, dtype=U)
_ODD = _random.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
_BASE = int(_ODD[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_ORDERS = np.argsort(_random.random((BINS, BINS)), axis=1)
_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], dtype=object)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return tuple(np.cumprod(np.r_[U(1), np.full(n, x, dtype=U)]) for x in (U(_BASE), U(_BASE_INVERSE)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in bytes (A-Z lower-cased), and where each begins."""
    space = _SPACE[flat]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(16, int(len(flat)).bit_length())
    up, down = _powers(size)
    sums = np.r_[U(0), np.cumsum(_BYTE[_LOWER[flat]] * up[: len(flat)])]
    return mixed((sums[end] - sums[begin]) * down[begin]), begin


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are cut out of the flat bytes by the offsets, with a space between them."""
    hashes, begin = word_hashes(flat)
    first = np.searchsorted(begin, offsets)
    sums = np.zeros(max(0, len(hashes) - shingle + 1), dtype=U)
    for k in range(shingle):
        sums += hashes[k : len(sums) + k] * _ODD[k + 1]
    sums = mixed(sums)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= shingle:
            out.append(np.unique(sums[a : b - shingle + 1]))
        elif n:
            out.append(mixed(np.array([int(sum(int(h) * int(o) for h, o in zip(hashes[a:b], _ODD[10 + n :], strict=False)) % 2**64)], dtype=U)))
        else:
            out.append(np.empty(0, U))
    return out


def spaced(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """flat_text with a space after each text, so that no word runs over."""
    flat, offsets = flat_text(values)
    return np.insert(flat, offsets[1:], 0x20) if len(flat) else np.full(len(offsets) - 1, 0x20, np.uint8), offsets + np.arange(len(offsets))


_EDGE_U = np.array([int(x) for x in _EDGES], dtype=U)


def signature(own: np.ndarray) -> np.ndarray:
    """own: sorted distinct hashes, not empty."""
    at = np.r_[np.searchsorted(own, _EDGE_U), len(own)]
    full = at[1:] > at[:-1]
    values = own[np.minimum(at[:-1], len(own) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _ORDERS[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return values


def rows_of_band(percent: int) -> int:
    """The most bins of a band at which a pair at the threshold is missed with a probability of MISSED at most: 6 at 85 %, 5 at 80 %."""
    fits = [r for r in range(1, 20) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED]
    return max(fits, default=1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band."""
    bands = BINS // rows
    own = values[: bands * rows].reshape(bands, rows) * _ODD[20 : 20 + rows]
    return mixed(own.sum(axis=1, dtype=U) + np.arange(bands, dtype=U) * _ODD[50])


def digest(own: np.ndarray) -> bytes:
    """What stands for a set: documents of equal sets have equal digests."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, t long, n_shingles long, class binary, signature binary, bands array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t (digest of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def signed(docs: DataFrame, rows: int, shingle: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. A row a document: digest of its text, size of its set, digest of the set (its class), signature, band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text"):
                sets = shingle_sets(*spaced(batch.column("text")), shingle)
                classes, signatures, bands = [], [], []
                for own in sets:
                    values = signature(own) if len(own) else None
                    classes.append(digest(own) if len(own) else None)
                    signatures.append((values & U(0xFFFF)).astype(np.uint16).tobytes() if len(own) else None)
                    bands.append(band_keys(values, rows).view(np.int64) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "t", "n_shingles", "class", "signature", "bands"],
                )

    return keyed(docs).mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs: text. The set of each text as an array, with its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(*spaced(batch.column("text")), shingle)]
                offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), shingles], names=["class", "shingles"])

    return docs.select("text").mapInArrow(run, "class binary, shingles array<long>")


def agreeing(edges: DataFrame, least: int) -> DataFrame:
    """edges: a, b, sa, sb (signatures). Those that agree in so many bins at least, as a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BINS) for c in ("sa", "sb"))
                keep = (left == right).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return edges.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """links: a, b. (node, root) for every node of a link: root is the least node that can be reached.

    Every node takes the least label around it, then its label's label, until nothing changes; both are joins.
    """
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-both")
    labels = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        around = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(around.hint("merge"), labels.node == around.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        jumped = lower.join(up.hint("merge"), lower.root == F.col("up_node"))
        new = save(jumped.select("node", F.least("root", "up_root").alias("root"), (F.least("root", "up_root") < F.col("old")).alias("changed")), "near-labels")
        drop(labels)
        labels = new
        if not labels.where("changed").limit(1).count():
            drop(both)
            return labels.select("node", "root")


def grouped(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. A row a document: doc_id, t (digest of the text), n_shingles, root (what its component is known by; null for empty sets), component_id.

    Two documents are linked if 100 * |intersection of their sets| >= percent * |union|.
    """
    base = save(signed(docs, rows_of_band(percent), shingle), "near-signed")
    some = base.where("class is not null")
    # a row a class: the copies of a text never meet again
    classes = some.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = save(classes, "near-classes")
    keys = classes.select("class", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = save(keys.join(shared.hint("merge"), "bucket"), "near-members")
    # how many others a member meets in all its buckets: the origin of many near copies meets most
    met = members.groupBy("class").agg(F.sum("members").alias("met"))
    members = save(members.join(met.hint("merge"), "class").select("bucket", "class", (-F.col("met")).alias("met")), "near-met")
    facts = classes.select("class", "signature", "n")
    sets = sets_of(docs, base, members.select("class").distinct(), shingle)
    links = save(confirmed(alike(star_edges(members), facts, percent), sets, percent), "near-links")
    roots = components(links)
    rest = save(still_open(members, roots), "near-rest")
    if rest.limit(1).count():
        more = confirmed(alike(prefix_pairs(rest, sets, percent), facts, percent), sets, percent)
        links = save(links.union(more), "near-links")
        roots = components(links)
    # back to documents: the least id of each component
    rooted = classes.select("class", "first_id").join(roots.hint("merge"), classes["class"] == roots.node, "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = save(rooted.join(named.hint("merge"), "root").select("class", "root", "component_id"), "near-named")
    out = base.select("doc_id", "t", "n_shingles", "class").join(of_class.hint("merge"), "class", "left")
    return out.select("doc_id", "t", "n_shingles", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. A row a document: doc_id, n_shingles, component_id (least doc_id that can be reached by links, its own included)."""
    return grouped(docs, percent, shingle).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the least id (null comes last), then of the least digest of its text. Documents without words all stay."""
    spot = F.struct("id", "t")
    found = grouped(docs, percent, shingle).where("root is not null").select("root", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "t")
    found = save(found.groupBy("root", "id", "t").agg(F.count(F.lit(1)).alias("n")), "near-found")
    first = found.groupBy("root").agg(F.min(spot).alias("first"))
    # rows that leave, and rows that stay but are met again
    marked = found.join(first.hint("merge"), "root").select(F.col("id").alias("_id"), F.col("t").alias("_t"), (spot != F.col("first")).alias("_later"), "n")
    marked = save(marked.where("_later or n > 1").drop("n"), "near-marked")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("t"))
    kept = rows.join(small_side(marked, MANY_IDS), (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t")), "left").where("_later is null or not _later")
    out = kept.where("_later is null").select("_row.*")
    if marked.where("not _later").limit(1).count():
        out = out.unionByName(kept.where("not _later").dropDuplicates(["id", "t"]).select("_row.*"))
    return out


def alike(edges: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Edges whose sizes and signatures allow a link."""
    a, b = (facts.select(F.col("class").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    near = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return save(agreeing(near.select("a", "b", "sa", "sb"), int(BINS * (percent / 100 - SLACK))), "near-edges")


def centers(members: DataFrame) -> DataFrame:
    """The member of each bucket that meets most others: bucket, hub."""
    return members.groupBy("bucket").agg(F.min(F.struct("met", "class")).alias("m")).select("bucket", F.col("m.class").alias("hub"))


def star_edges(members: DataFrame) -> DataFrame:
    """members: bucket, class, met. Distinct pairs (a, b) of a bucket's center and another member."""
    pairs = members.select("bucket", "class").join(centers(members).hint("merge"), "bucket").where("class <> hub")
    return pairs.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """class, root of the members, centers apart, of buckets in which these lie in several components."""
    rest = members.join(centers(members).withColumnRenamed("hub", "class").hint("merge"), ["bucket", "class"], "left_anti")
    rest = rest.join(roots.hint("merge"), rest["class"] == roots.node, "left").select("bucket", "class", F.coalesce("root", "class").alias("root"))
    open_buckets = rest.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("bucket")
    return rest.join(open_buckets.hint("merge"), "bucket", "left_semi").select("class", "root").distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that may be linked; none that is linked is missing."""
    ceil = lambda x, y: F.ceil(x / F.lit(y)).cast("int")
    own = sets.join(rest.hint("merge"), "class").select("class", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ordered = own.join(often.hint("merge"), "shingle").groupBy("class", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    longer = F.col("n") - ceil(percent * F.col("n"), 100) + 1
    rarest = ordered.select("class", "root", "n", F.posexplode(F.slice("all", F.lit(1), longer)).alias("place", "x")).where("x.often > 1")
    rarest = rarest.select("class", "root", "n", (F.col("place") + 1).alias("place"), F.col("x.shingle").alias("shingle"))
    rarest = save(rarest, "near-rarest")
    apart = rarest.groupBy("shingle").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("shingle")
    # sets that may be linked lie in one class of sizes or in two that follow each other
    ratio = float(np.log(100 / percent) * (1 + 1e-9)) if percent < 100 else 1.0
    rank = F.floor(F.log("n") / ratio)
    key = lambda r: F.xxhash64("shingle", r)
    rarest = save(rarest.join(apart.hint("merge"), "shingle", "left_semi").withColumn("bin", rank), "near-apart")
    large = rarest.select(key("bin").alias("key"), *(F.col(c) for c in ("shingle", "class", "root", "n", "place")))
    hot = hot_keys(large.groupBy("key").agg(F.count(F.lit(1)).alias("many")), "key", "many")
    shorter = F.col("n") - ceil(2 * percent * F.col("n"), 100 + percent) + 1
    small = rarest.where(F.col("place") <= shorter).withColumn("other", F.explode(F.array(F.col("bin"), F.col("bin") + 1)))
    small = small.select(key("other").alias("key"), *(F.col(c).alias(f"{c}_s") for c in ("shingle", "class", "root", "n", "place")))
    common = ceil(percent * (F.col("n_s") + F.col("n")), 100 + percent)
    fits = (F.col("shingle_s") == F.col("shingle")) & (F.col("root_s") != F.col("root")) & (F.col("n_s") <= F.col("n")) & (100 * F.col("n_s") >= percent * F.col("n")) & (F.least(F.col("n_s") - F.col("place_s"), F.col("n") - F.col("place")) + 1 >= common)
    both = salted_join(large, small, "key", hot, F.col("class")).where(fits)
    return both.select(F.least("class_s", "class").alias("a"), F.greatest("class_s", "class").alias("b")).distinct()


def sets_of(docs: DataFrame, base: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full sets of the wanted classes, from the text of one document each."""
    known = F.coalesce("doc_id", F.lit(_NO_ID))
    one = base.join(wanted.hint("merge"), "class", "left_semi").groupBy("class").agg(F.min(F.struct(known.alias("id"), "t")).alias("one"))
    one = save(one.select(F.col("one.id").alias("one_id"), F.col("one.t").alias("one_t")), "near-wanted")
    texts = keyed(docs).join(small_side(one, MANY_IDS), (known == F.col("one_id")) & (F.col("t") == F.col("one_t")))
    return save(full_sets(texts, shingle).dropDuplicates(["class"]), "near-sets")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges whose sets are similar enough."""
    a, b = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    joint = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common >= percent * joint).select("a", "b")
