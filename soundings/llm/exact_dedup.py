"""Exact dedup: counting quotient filters, merged by sorted remainders, then byte verification.

Every partition puts the 64-bit fingerprints of its normalised texts into a counting
quotient filter: the high bits of a fingerprint (quotient) name a slot, the low bits
(remainder) are kept sorted in the slot's run, each with its count.  A filter loses
nothing, so filters merge by merging their sorted remainders.  They are cut into slices by
the top bits of the quotient; a slice of all partitions meets in one task, and a repeated
fingerprint arrives there at most once per partition, however many copies there are.

Fingerprints with a count above one route their documents to verification, where texts
are grouped by their bytes; the other documents are known to be alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soundings.session import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"


class QuotientFilter:
    """Counting quotient filter over 64-bit fingerprints.

    ``runs[s]`` is the number of remainders in slot s; ``remainders`` and ``counts`` hold
    the runs one after another, each sorted.  ``quotient_bits`` follows the number of
    fingerprints, so about one remainder falls to a slot.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray | None = None):
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        ordered, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        distinct = ordered[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        self.quotient_bits = max(1, int(len(distinct)).bit_length())
        self.shift = np.uint64(64 - self.quotient_bits)
        self.runs = np.bincount((distinct >> self.shift).astype(np.int64), minlength=1 << self.quotient_bits)
        self.remainders = distinct & ((np.uint64(1) << self.shift) - np.uint64(1))

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, sorted: slot number and remainder put together again."""
        slots = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (slots << self.shift) | self.remainders

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the counts of all added; nothing is lost."""
        return QuotientFilter(np.concatenate([f.fingerprints() for f in filters]),
                              np.concatenate([f.counts for f in filters]))

    def slices(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Cut by the top ``bits`` bits: number, fingerprints, counts."""
        whole = self.fingerprints()
        top = (whole >> np.uint64(64 - bits)).astype(np.int64)
        bounds = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True]) if len(top) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(top[a]), whole[a:b], self.counts[a:b]


def _build(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[QuotientFilter] = []
        for batch in batches:
            held.append(QuotientFilter(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(held) == 32:
                held = [QuotientFilter.merge(held)]
        if held:
            parts = list(QuotientFilter.merge(held).slices(bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1].tobytes() for p in parts], pa.binary()),
                 pa.array([p[2].tobytes() for p in parts], pa.binary())], ["slice", "fingerprints", "counts"])
    return build


def _merge_slice(parts):
    import pandas as pd

    whole = QuotientFilter.merge([
        QuotientFilter(np.frombuffer(f, np.uint64), np.frombuffer(c, np.int64))
        for f, c in zip(parts["fingerprints"], parts["counts"])])
    again = whole.counts > 1
    return pd.DataFrame({"fingerprint": whole.fingerprints()[again].view(np.int64), "copies": whole.counts[again]})


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """Fingerprints (the only column) that occur more than once, with their counts."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (4 * tasks - 1).bit_length())
    slices = prints.mapInArrow(_build(bits), "slice int, fingerprints binary, counts binary")
    return slices.groupBy("slice").applyInPandas(_merge_slice, "fingerprint long, copies long")


def normalised(text: str = "text"):
    """Runs of white space become one space; NULL is the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when equal after normalising white space; NULL counts as empty.  In a
    group of equal texts the smallest id stays.  A NULL id never wins against another;
    where all are NULL, all of them stay.  Rows that repeat the keeping id all stay.  An
    empty table gives no rows.  Other columns pass through; those named like a result
    column are replaced.
    """
    named = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    # the caller's columns travel in a struct, so that no name can clash with one used here
    texts = docs.select(F.struct(*named).alias("row"), normalised(text_column).alias("norm")).withColumn("print", F.xxhash64("norm"))
    again = cut_lineage(repeated_fingerprints(texts.select(F.col("print").alias("fingerprint"))))
    routed = cut_lineage(
        texts.join(again, F.col("print") == F.col("fingerprint"), "left")
        .select("row", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("copies") > 1, F.col("norm")).alias("norm")))
    own_id = F.col("row").getField(id_column)
    result = ["row", "text_sha256", "keep_id", "group_size", "kept"]
    alone = routed.filter("norm is null").select(
        "row", "text_sha256", own_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    checked = routed.filter("norm is not null")
    # written, so that the join below is between two plain shuffles, of which a large group of copies can be split
    groups = cut_lineage(checked.groupBy(F.col("norm").alias("same")).agg(F.min(own_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    verified = checked.join(groups, F.col("norm") == F.col("same")).withColumn("kept", own_id.eqNullSafe(F.col("keep_id"))).select(*result)
    return alone.unionByName(verified).select(*(F.col("row").getField(c).alias(c) for c in named), *result[1:])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)
