"""Centroid clustering of integer vectors over subvector dictionaries.

Vectors are cut into blocks of neighbouring dimensions, and each block is dictionary-encoded without loss: the distinct
subvectors once, and a code a vector. A round computes the exact squared distance of every distinct subvector from that
part of each centroid once, and adds up the partial distances by code, so a subvector that many vectors share costs its
distances once. Sums for the next centroids go the same way: codes are counted by cluster, and counts times subvectors
added. All numbers are 64-bit integers, so results don't depend on how rows are dealt.

Dictionaries belong to chunks of CHUNK_ROWS vectors, so a task's memory is bounded whatever the table holds; a chunk is
written once and read in every round. Blocks begin as single dimensions and neighbours are joined while their dictionary
stays under 1/SHARED of the chunk's rows: many copies make wide blocks, scattered vectors narrow ones. The driver gets
k x dims sums a round, whatever the table's size.

Cases: vectors that are null, of another length than dims, or hold null or non-finite components take no part, nor do
such that hold an integer beyond BIGGEST, whose distances no long can hold; rows that repeat an id or a vector are rows
like others; a null id takes part, is hashed as the empty text and comes last among equal hashes; equal hashes are taken
in the order of their vectors; fewer vectors than k give fewer centroids; a centroid that loses all its vectors stays;
equal distances go to the smaller number; an empty table gives an empty table; other columns are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import spread
from tidemark.llm.common import drop, save

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Vectors of a chunk (codes are 16 bits); a joined block's dictionary holds at most one subvector for so many vectors.
CHUNK_ROWS, SHARED = 8192, 4
#: 64 x (2 x BIGGEST)^2 is below 2^63.
BIGGEST = 1 << 27
#: Distances of so many vectors at a time.
STEP = 4096

CHUNK = "ids array<long>, widths array<int>, sizes array<int>, values array<long>, codes array<short>"


def whole_numbers(df: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """vec_id, x (array<long>) of the vectors that take part."""
    scaled = F.transform(F.col(embedding), lambda v: v.cast("double") * scale)
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -BIGGEST) & (v < BIGGEST + 1))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("x")).where((F.size("x") == dims) & fits)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v)).alias("x"))


def dictionaries(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct subvectors of each block, and the codes of all vectors (rows x blocks)."""
    blocks = []
    for d in range(x.shape[1]):
        values, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((values[:, None], codes))
    joined = True
    while joined and len(blocks) > 1:
        joined, wider = False, []
        for a, b in zip(blocks[::2], blocks[1::2], strict=False):
            pairs, codes = np.unique(a[1] * len(b[0]) + b[1], return_inverse=True)
            if len(pairs) * SHARED <= len(x):
                wider.append((np.c_[a[0][pairs // len(b[0])], b[0][pairs % len(b[0])]], codes))
                joined = True
            else:
                wider += [a, b]
        blocks = wider + blocks[len(blocks) // 2 * 2 :]
    return [v for v, _ in blocks], np.stack([c for _, c in blocks], axis=1)


def encoded(rows: DataFrame, dims: int) -> DataFrame:
    """A row a chunk (CHUNK); values and codes are laid out block by block."""

    def chunk(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        subvectors, codes = dictionaries(np.vstack(parts))
        of = [pa.concat_arrays(ids), [v.shape[1] for v in subvectors], [len(v) for v in subvectors], np.concatenate([v.ravel() for v in subvectors]), codes.T.astype(np.int16).ravel()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int16()]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(of, kinds, strict=True)], names=["ids", "widths", "sizes", "values", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for big in batches:
            for k in range(0, big.num_rows, CHUNK_ROWS):
                batch = big.slice(k, CHUNK_ROWS)
                if n + batch.num_rows > CHUNK_ROWS:
                    yield chunk(ids, parts)
                    ids, parts, n = [], [], 0
                ids.append(batch.column("vec_id"))
                parts.append(batch.column("x").flatten().to_numpy().reshape(-1, dims))
                n += batch.num_rows
        if n:
            yield chunk(ids, parts)

    return rows.mapInArrow(run, CHUNK)


class Chunk:
    def __init__(self, row: dict):
        self.ids = row["ids"].values
        get = lambda c: row[c].values.to_numpy(zero_copy_only=False)
        widths, sizes, values = get("widths"), get("sizes"), get("values")
        cuts = np.cumsum(widths * sizes)[:-1]
        self.subvectors = [v.reshape(-1, w) for v, w in zip(np.split(values, cuts), widths, strict=True)]
        self.codes = get("codes").reshape(len(widths), -1)
        self.begin = np.r_[0, np.cumsum(widths)]

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and its squared distance."""
        tables = []
        for v, a, b in zip(self.subvectors, self.begin, self.begin[1:], strict=False):
            far = np.zeros((len(v), len(centroids)), dtype=np.int64)
            for d in range(a, b):
                far += (v[:, d - a, None] - centroids[None, :, d]) ** 2
            tables.append(far)
        cluster, distance = [], []
        for k in range(0, self.codes.shape[1], STEP):
            total = np.zeros((len(self.codes[0, k : k + STEP]), len(centroids)), dtype=np.int64)
            for far, codes in zip(tables, self.codes[:, k : k + STEP], strict=True):
                total += far[codes]
            cluster.append(total.argmin(axis=1))
            distance.append(total.min(axis=1))
        return np.concatenate(cluster), np.concatenate(distance)

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of each cluster, and sums of their components."""
        out = np.zeros((k, self.begin[-1]), dtype=np.int64)
        for v, codes, a, b in zip(self.subvectors, self.codes, self.begin, self.begin[1:], strict=False):
            many = np.bincount(cluster * len(v) + codes, minlength=k * len(v)).reshape(k, len(v))
            out[:, a:b] = many @ v
        return np.bincount(cluster, minlength=k), out


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk({c: batch.column(c)[k] for c in batch.schema.names})


def starting_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the least hashes of their ids, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, F.col("vec_id").isNull(), "x").limit(k).select("x").collect()  # k rows
    return np.array([r["x"] for r in first], dtype=np.int64)


def next_centroids(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for chunk in chunks_of(batches):
            n, s = chunk.sums(chunk.assign(centroids)[0], k)
            count, total = count + n, total + s
        held = np.flatnonzero(count)
        of = [np.repeat(held, dims), np.tile(np.arange(dims), len(held)), np.repeat(count[held], dims), total[held].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(of, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["cluster", "dim", "n", "total"])

    parts = chunks.mapInArrow(run, "cluster int, dim int, n long, total long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = r["total"] // r["n"]  # rounds down, below zero too
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector after so many rounds, and the centroids (fewer than k if there are fewer vectors)."""
    spark = vectors.sparkSession
    rows = whole_numbers(spread(vectors.select(vec_id, embedding)), vec_id, embedding, dims, scale)
    chunks = save(encoded(rows, dims), "centroid-chunks")
    centroids = starting_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), dtype=np.int64)
    for _ in range(rounds):
        centroids = next_centroids(chunks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            number, distance = chunk.assign(centroids)
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = save(chunks.mapInArrow(run, "vec_id long, cluster int, distance long"), "centroid-clusters")
    drop(chunks)
    return out, centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256 (of its components as decimal integers, joined by commas)."""
    spark = clustered.sparkSession
    sums = {r["cluster"]: r["s"] for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    named = [(n, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids.tolist()) if n in sums]
    side = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(side), "cluster")  # k rows
