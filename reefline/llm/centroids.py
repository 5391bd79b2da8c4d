"""Centroid clustering (Lloyd's rounds) over integer vectors with scalar lookup tables.

Vectors are scaled to integers once and written as blocks: per dimension the
occurring integers and, for each vector, the place of its integer among them.
In a round a task tabulates, for each dimension, the squared difference of every
occurring integer and every centroid; the distances of a block are gathers from
these tables and sums.  Integer sums make the result exact and independent of
how the vectors are partitioned.

A block holds at most ``BLOCK`` vectors whatever the data, so its tables are
bounded; a round sends one row per centroid and dimension to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import keep

BLOCK = 4096
LARGEST = 1 << 27       # |integer| at most: 64 squared differences of such integers stay below 2^63


def integers(vectors: DataFrame, dims: int = 64, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(vec_id, values)``: rows whose vector has exactly ``dims`` components, none null, NaN or infinite, as floor(scale * x).

    Integers beyond ``LARGEST`` become ``LARGEST`` with their sign."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * F.lit(scale)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == dims) & finite).select(F.col(vec_id).alias("vec_id"), scaled.alias("values"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:vec_id``, in that order (a null id counts as the empty text; ties by values)."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(rank.alias("rank"), "values").orderBy("rank", "values").limit(k).collect()
    return np.array([r["values"] for r in rows], np.int64)


def encoded(kept: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors: ids, occurring integers of all dimensions, how many each dimension has, and the places by dimension."""
    id_type = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column(1).flatten()).reshape(len(part), dims)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
                places = np.stack([place for _, place in found]).astype(np.uint16)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array([a.tobytes()], pa.binary()) for a in (np.concatenate([v for v, _ in found]).astype(np.int64),
                                                                           np.array([len(v) for v, _ in found], np.int64), places)]],
                    names=["ids", "occurring", "sizes", "places"])

    return kept.select("vec_id", "values").mapInArrow(run, f"ids array<{id_type}>, occurring binary, sizes binary, places binary")


def _read(occurring: bytes, sizes: bytes, places: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    values = np.split(np.frombuffer(occurring, np.int64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
    return values, np.frombuffer(places, np.uint16).reshape(len(values), -1)


def distances(values: list[np.ndarray], places: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector of a block to each centroid, from one table per dimension."""
    total = np.zeros((places.shape[1], len(centroids)), np.int64)
    for d, occurring in enumerate(values):
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += np.take(table, places[d], axis=0)
    return total


def round_sums(blocks: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(cluster, dimension, count, sum)`` over the vectors nearest to each centroid (ties: the smaller number)."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                values, places = _read(row["occurring"], row["sizes"], row["places"])
                nearest = distances(values, places, centroids).argmin(axis=1)
                counts += np.bincount(nearest, minlength=k)
                order = np.argsort(nearest, kind="stable")
                some, first = np.unique(nearest[order], return_index=True)
                vectors = np.stack([v[p] for v, p in zip(values, places, strict=True)], axis=1)
                sums[some] += np.add.reduceat(vectors[order], first, axis=0)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(on, dims)), pa.array(np.tile(np.arange(dims), len(on))),
                                          pa.array(np.repeat(counts[on], dims)), pa.array(sums[on].ravel())],
                                         names=["cluster", "dim", "n", "total"])

    partial = blocks.select("occurring", "sizes", "places").mapInArrow(run, "cluster bigint, dim bigint, n bigint, total bigint")
    exact = partial.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [(r["cluster"], r["dim"], r["n"], int(r["total"])) for r in exact.collect()]      # k * dims rows


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                _, occurring, sizes, places = (c[i] for c in batch.columns)
                far = distances(*_read(occurring.as_py(), sizes.as_py(), places.as_py()), centroids)
                nearest = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest])],
                                                 names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = 64, vec_id: str = "vec_id",
            vector: str = "embedding", scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every kept vector after ``rounds`` rounds, and the final centroids.

    Centroids start as the kept vectors of the ``k`` smallest hashes; fewer kept
    vectors give fewer centroids, none an empty table.  A round moves every centroid
    that has vectors to the floor of their mean in each component; one without
    vectors stays.  Vectors with a null, NaN or infinite component or another number
    of components, and null vectors, are left out; repeated rows and null ids are
    vectors like any other; columns other than those named are not read."""
    kept = integers(vectors, dims, vec_id, vector, scale)
    blocks = keep(encoded(kept, dims))
    centroids = first_centroids(kept, k, seed).reshape(-1, dims)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for c, d, n, total in round_sums(blocks, centroids):
            moved[c, d] = total // n                # floors towards minus infinity
        centroids = moved
    return _assigned(blocks, centroids), centroids


def digest_of(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector, as ``cluster`` finds them."""
    found, centroids = cluster(vectors, **options)
    found = keep(found)
    per = found.groupBy("cluster").agg(F.sum("distance").alias("_sum"))
    whole = found.agg(F.sum("distance").alias("_sum"))
    digests = F.element_at(F.array(*[F.lit(digest_of(c)) for c in centroids] or [F.lit("")]), F.col("cluster") + 1)
    inertia: Column = F.broadcast(per.select(F.col("cluster").alias("_of"), F.col("_sum").alias("cluster_inertia")))    # one row per centroid
    return found.join(inertia, F.col("cluster") == F.col("_of")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", whole.scalar().alias("inertia"), digests.alias("centroid_sha256"))
