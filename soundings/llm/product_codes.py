"""Compression of vectors to codes: one entry of a small codebook for each part of a vector.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook, trained by rounds of assignment and averaging; every round sums parts by entry over
the whole table on Spark, and the new entries, which do not grow with the data, are the only
thing that passes through the driver.  All numbers are integers, so results do not depend
on the order of rows or tasks.

The nearest entry is found by slices.  For each coordinate a codebook's entries are sorted,
and every prefix of that order has a mask with the bits of its entries.  The entries within a
radius of a part's coordinate are a range of the order, so two masks give their bits, and the
masks of all coordinates, ANDed, those of all entries in the cube of that radius around the
part.  Distances are computed for these candidates alone.  The first radius comes from the
entries' own spacing; where the nearest candidate lies beyond the radius, the radius becomes
its distance, and where there is no candidate, it doubles.  An entry as near as the radius is
in the cube, so what is settled is exact, ties included.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soundings.session import cut_lineage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Scaled components lie within this, so that squared distances of up to 256 components fit 64 bits.
BOUND = 1 << 26
ROWS = 8192


class Slices:
    """Sorted coordinates and prefix masks of one codebook (entries by components, at most 64 entries)."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask holds 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        bits = np.uint64(1) << order.T.astype(np.uint64)
        self.masks = np.concatenate([np.zeros((entries.shape[1], 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        apart = gaps[gaps > 0]
        #: half the way between entries, by the median of their squared distances
        self.radius = max(1, math.isqrt(int(np.median(apart))) // 2) if len(apart) else 1

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each part in every coordinate."""
        found = np.full(len(parts), np.uint64(0xFFFFFFFFFFFFFFFF))
        for order, masks, values in zip(self.sorted, self.masks, parts.T):
            low, high = np.searchsorted(order, values - radius, "left"), np.searchsorted(order, values + radius, "right")
            found &= masks[high] & ~masks[low]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lowest of equally near ones, and the squared distance."""
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        open_rows, radius = np.arange(len(parts)), np.full(len(parts), self.radius, np.int64)
        while len(open_rows):
            mine = parts[open_rows]
            masks = self.candidates(mine, radius)
            best, at = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.int64)
            for e, entry in enumerate(self.entries):
                has = np.flatnonzero((masks >> np.uint64(e)) & np.uint64(1))
                if not len(has):
                    continue
                squares = ((mine[has] - entry) ** 2).sum(axis=1)
                nearer = squares < best[has]
                best[has[nearer]], at[has[nearer]] = squares[nearer], e
            settled = (masks != 0) & (best <= radius * radius)
            index[open_rows[settled]], distance[open_rows[settled]] = at[settled], best[settled]
            # the root may be rounded down, so one more
            further = np.where(masks != 0, np.sqrt(np.where(masks != 0, best, 0)).astype(np.int64) + 1, 2 * radius)
            open_rows, radius = open_rows[~settled], further[~settled]
        return index, distance


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            yield batch.slice(a, ROWS)


def _sums(codebooks: list[np.ndarray]):
    """Per task: count and component sums of the parts nearest to each entry."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, counts = [Slices(c) for c in codebooks], [np.zeros(len(c), np.int64) for c in codebooks]
        totals = [np.zeros(c.shape, np.int64) for c in codebooks]
        for batch in _batches(batches):
            for p, parts in enumerate(np.split(_matrix(batch.column("vector")), len(codebooks), axis=1)):
                index, _ = slices[p].nearest(parts)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(totals[p], index, parts)
        rows = [(p, e, int(n), totals[p][e].tolist()) for p, c in enumerate(counts) for e, n in enumerate(c) if n]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
    return sums


def _codes(codebooks: list[np.ndarray]):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(c) for c in codebooks]
        digits = np.array([f"{i:02x}" for i in range(64)])
        for batch in _batches(batches):
            text, error = np.full(len(batch), "", object), np.zeros(len(batch), np.int64)
            for one, parts in zip(slices, np.split(_matrix(batch.column("vector")), len(codebooks), axis=1)):
                index, distance = one.nearest(parts)
                text, error = text + digits[index].astype(object), error + distance
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array(error)], ["row", "code", "error"])
    return codes


def train(vectors: DataFrame, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds over ``vectors`` (column vector), which begin as the parts of ``first``."""
    codebooks = [np.ascontiguousarray(c) for c in np.split(np.array(first, np.int64), parts, axis=1)]
    for _ in range(rounds):
        added = (vectors.select("vector").mapInArrow(_sums(codebooks), "part int, entry int, n long, total array<long>")
                 .select("part", "entry", "n", F.posexplode("total").alias("place", "value"))
                 .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
        # as many rows as the codebooks have components
        for part, entry, place, n, value in added.collect():
            codebooks[part][entry, place] = int(value) // n
    return codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def scaled(vector: str = "embedding"):
    """floor(4096 x) of each component; NULL for a vector that is NULL or has a NULL, NaN, infinite or too large component."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * SCALE)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < BOUND))
    return F.when(fine, F.transform(x, lambda v: F.floor(v).cast("int")))


def compress(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``embeddings`` with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``, without the vector.

    Rows whose vector is NULL or has a NULL, NaN or infinite component are dropped.  The codebooks
    begin as the parts of the ``entries`` vectors with the smallest ids; NULL ids come last and
    equal ids are told apart by their vectors; with fewer vectors there are fewer entries.
    Repeated rows count as often as they occur.  ``label_error`` adds up ``error`` over equal labels,
    NULLs together (NULL where the sum leaves 64 bits).

    ``parts`` has to divide a vector's length.  Rows whose vector is of another length than that of the smallest id, or
    has a component of 16384 or more, which 64-bit distances do not allow for, take no part
    and get NULL as code and error.  An empty table gives no rows.  Other columns pass through;
    those named like a result column are replaced.
    """
    results = ["code", "error", "label_error", "codebooks_sha256"]
    named = [c for c in embeddings.columns if c not in (*results, vector_column)]
    spark = embeddings.sparkSession
    whole = F.forall(F.col(vector_column), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = cut_lineage(embeddings.filter(whole).select(F.struct(*named).alias("row"), scaled(vector_column).alias("vector")))
    own_id = F.col("row").getField(id_column)
    usable = rows.filter("vector is not null")
    first = [list(r[0]) for r in usable.orderBy(own_id.asc_nulls_last(), "vector").limit(entries).select("vector").collect()]
    width = len(first[0]) if first else 0
    if width % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {width} components")
    fits = F.coalesce(F.size("vector") == width, F.lit(False)) if width else F.lit(False)
    codebooks = train(rows.filter(fits), [v for v in first if len(v) == width], parts, rounds) if width else []
    coded = rows.filter(fits).mapInArrow(_codes(codebooks), rows.select("row").schema.add("code", "string").add("error", "long"))
    rest = rows.filter(~fits).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut_lineage(coded.unionByName(rest))
    out = [F.col("row").getField(c).alias(c) for c in named]
    digest = F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    if label_column is None:
        return coded.select(*out, "code", "error", F.lit(None).cast("long").alias("label_error"), digest)
    label = F.col("row").getField(label_column)
    sums = cut_lineage(coded.groupBy(label.alias("same")).agg(F.try_sum("error").alias("label_error")))
    joined = coded.join(sums, label.eqNullSafe(F.col("same")))
    return joined.select(*out, "code", "error", "label_error", digest)
