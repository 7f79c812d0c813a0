"""Find out, for marks on places of documents, which are also elsewhere.

A task gathers the marks of its documents in units of bounded size.  Within a unit a mark is
sent once, with all its places, to the block its value belongs to; so a mark that every
document has reaches its block at most once per unit.  A block answers with places, and
the answers of a unit are put back to its documents.
"""
from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from soundings.session import cut_lineage

#: A unit is closed at so many marks or so many bytes of text.
UNIT_MARKS = 1 << 18
UNIT_BYTES = 8 << 20

#: A mark with more places than this in all documents is called crowded.
CROWDED = 4096
#: Set in an answered place whose mark is crowded; places themselves stay below it.
CROWDED_BIT = 1 << 31

#: What goes to a block: places of entry i are the next ``counts[i]`` ones.
SENT = "block int, unit long, values binary, counts binary, places binary, owners binary, extra binary"
ANSWER = "unit long, places binary, values binary, ids binary, prints binary, nulls binary, bases binary"


def release(spark: SparkSession) -> None:
    """Let shuffle files of forgotten plans go.

    Spark removes them when the driver's plan is collected as garbage, which else may come
    long after the results are written.  Forgotten objects are handed back to the driver's
    virtual machine by a background thread, hence the pause.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text without NULL, and the text's hash: with the id it names a row's content."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))


class Unit:
    """Marks of some documents: place numbers run on from document to document."""

    def __init__(self, number: int):
        self.number, self.bytes, self.marks, self.end = number, 0, 0, 0
        self.ids, self.prints, self.bases = [], [], []
        self.values, self.places, self.owners, self.extra = [], [], [], []

    def add(self, doc_id, text_print: int, size: int, places: np.ndarray, values: np.ndarray, extra: list[bytes] | None = None) -> None:
        """``values`` has a row of one or more 64-bit numbers for each place, below ``size``."""
        self.ids.append(doc_id)
        self.prints.append(text_print)
        self.bases.append(self.end)
        self.places.append(places.astype(np.int64) + self.end)
        self.values.append(values)
        self.owners.append(np.full(len(places), len(self.ids) - 1, np.int64))
        if extra is not None:
            self.extra += extra
        self.end += size
        self.marks += len(places)
        self.bytes += size

    def full(self) -> bool:
        return self.marks >= UNIT_MARKS or self.bytes >= UNIT_BYTES

    def about(self) -> tuple:
        """The unit's documents, sent along as a block of its own."""
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        nulls = np.array([i is None for i in self.ids], bool)
        return ids.tobytes(), np.array(self.prints, np.int64).tobytes(), nulls.tobytes(), np.array(self.bases, np.int64).tobytes()


def first_of_runs(rows: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted rows."""
    if not len(rows):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])


def sorted_rows(rows: np.ndarray) -> np.ndarray:
    """An order of rows of 64-bit numbers that puts equal ones together."""
    return np.argsort(rows[:, 0], kind="stable") if rows.shape[1] == 1 else np.lexsort(rows.T[::-1])


def block_of(values: np.ndarray, blocks: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def blocks_for(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def own_block(unit: int) -> int:
    """A block below zero for what a unit keeps for itself; units (task << 24 | number) have different ones."""
    return -1 - ((unit >> 24) * 8191 + (unit & 0xFFFFFF)) % (1 << 30)


def _documents_row(unit: Unit) -> dict:
    ids, prints, nulls, bases = unit.about()
    return {"block": own_block(unit.number), "unit": unit.number, "values": ids, "counts": prints, "places": nulls, "owners": bases, "extra": b""}


def send(unit: Unit, blocks: int) -> Iterator[dict]:
    """Rows of ``SENT``: one for each block with its marks, one for the unit's documents."""
    if not unit.ids:
        return
    yield _documents_row(unit)
    if not unit.marks:
        return
    values, places = np.concatenate(unit.values), np.concatenate(unit.places)
    order = sorted_rows(values)
    values, places = values[order], places[order]
    first = first_of_runs(values)
    counts = np.diff(np.r_[first, len(values)])
    own = block_of(values[first, 0], blocks)
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ends = np.r_[first, len(values)]
    for a, b in zip(cuts, np.r_[cuts[1:], len(first)]):
        yield {"block": int(own[a]), "unit": unit.number, "values": values[first[a:b]].tobytes(), "counts": counts[a:b].astype(np.uint32).tobytes(),
               "places": places[ends[a]:ends[b]].astype(np.uint32).tobytes(), "owners": b"", "extra": b""}


def sender(mark: Callable, blocks: int, send_unit: Callable = send):
    """A mapInArrow function; ``mark(row, unit)`` adds one document, given as a dict of columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        unit = Unit(task << 24)
        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.large_binary()))
            for a in range(0, batch.num_rows, 64):
                for row in batch.slice(a, 64).to_pylist():
                    mark(row, unit)
                    if unit.full():
                        yield _arrow(send_unit(unit, blocks))
                        made += 1
                        unit = Unit(task << 24 | made)
        yield _arrow(send_unit(unit, blocks))
    return work


def _arrow(rows) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.int32()), ("unit", pa.int64()), *((c, pa.binary()) for c in ("values", "counts", "places", "owners", "extra"))])
    return pa.RecordBatch.from_pylist(list(rows), schema)


def _pass_documents(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"unit": rows["unit"], "places": b"", "values": b"", "ids": rows["values"], "prints": rows["counts"],
                         "nulls": rows["places"], "bases": rows["owners"]})


def answer(unit: list[int], places: list[bytes], values: list[bytes] | None = None) -> pd.DataFrame:
    n = len(unit)
    return pd.DataFrame({"unit": unit, "places": places, "values": values or [b""] * n, "ids": [None] * n, "prints": [None] * n,
                         "nulls": [None] * n, "bases": [None] * n})


def _repeated(width: int, crowded: int):
    def find(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Places of the marks that occur more than once, in any units together."""
        if key[0] < 0:
            return _pass_documents(rows)
        values = np.concatenate([np.frombuffer(v, np.uint64).reshape(-1, width) for v in rows["values"]])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
        order = sorted_rows(values)
        first = first_of_runs(values[order])
        total = np.add.reduceat(counts[order], first)
        again, many = np.empty(len(values), bool), np.empty(len(values), np.uint32)
        sizes = np.diff(np.r_[first, len(values)])
        again[order] = np.repeat(total > 1, sizes)
        many[order] = np.repeat(np.where(total > crowded, CROWDED_BIT, 0).astype(np.uint32), sizes)
        units, places, at = [], [], 0
        entries = [len(c) // 4 for c in rows["counts"]]
        for unit, own in zip(rows["unit"], rows["places"]):
            own = np.frombuffer(own, np.uint32)
            stop = at + entries.pop(0)
            kept = np.repeat(again[at:stop], counts[at:stop])
            if kept.any():
                units.append(unit)
                places.append((own | np.repeat(many[at:stop], counts[at:stop]))[kept].tobytes())
            at = stop
        return answer(units, places)
    return find


def repeated_marks(docs: DataFrame, mark: Callable, width: int = 1, crowded: int = CROWDED) -> DataFrame:
    """doc_id, print and ``places`` (unsigned 32-bit) of the marks of ``docs`` that occur again.

    ``mark(row, unit)`` adds the marks of one row of ``docs``.  Places of a mark with more
    than ``crowded`` of them have ``CROWDED_BIT`` set.
    """
    sent = docs.mapInArrow(sender(mark, blocks_for(docs)), SENT)
    answers = cut_lineage(sent.groupBy("block").applyInPandas(_repeated(width, crowded), ANSWER))
    return by_document(answers)


def _to_documents(key, rows: pd.DataFrame) -> pd.DataFrame:
    about = rows[rows["bases"].notna()].iloc[0]
    ids, prints, bases = (np.frombuffer(about[c], np.int64) for c in ("ids", "prints", "bases"))
    nulls = np.frombuffer(about["nulls"], bool)
    told = rows[rows["bases"].isna()]
    if not len(told):
        return pd.DataFrame({"doc_id": pd.array([], "Int64"), "print": np.empty(0, np.int64), "places": [], "values": []})
    places = np.concatenate([np.frombuffer(p, np.uint32) for p in told["places"]]).astype(np.int64)
    values = np.concatenate([np.frombuffer(v, np.uint64) for v in told["values"]])
    flags, places = places & CROWDED_BIT, places & (CROWDED_BIT - 1)
    order = np.argsort(places, kind="stable")
    flags, places, values = flags[order], places[order], values[order] if len(values) else values
    owner = np.searchsorted(bases, places, "right") - 1
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = {"doc_id": [], "print": [], "places": [], "values": []}
    for a, b in zip(first, np.r_[first[1:], len(places)]):
        k = owner[a]
        out["doc_id"].append(None if nulls[k] else int(ids[k]))
        out["print"].append(int(prints[k]))
        out["places"].append(((places[a:b] - bases[k]) | flags[a:b]).astype(np.uint32).tobytes())
        out["values"].append(values[a:b].tobytes() if len(values) else b"")
    return pd.DataFrame(out).astype({"doc_id": "Int64"})


def by_document(answers: DataFrame) -> DataFrame:
    """Answers put back to documents: doc_id, print, places and values, one row per content."""
    found = answers.groupBy("unit").applyInPandas(_to_documents, "doc_id long, print long, places binary, values binary")
    # rows that repeat id and text have equal answers
    return found.groupBy("doc_id", "print").agg(F.first("places").alias("places"), F.first("values").alias("values"))


def with_answers(docs: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """``docs`` (of ``identified``) with the answers of ``by_document``."""
    told = answers.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "places", "values")
    return docs.join(told, docs["doc_id"].eqNullSafe(told["_id"]) & (docs["print"] == told["_print"]), how).select(
        "doc_id", "text", "print", "places", "values")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    top = np.iinfo(x.dtype).max
    padded = np.concatenate([x, np.full(-len(x) % width, top, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every ``width`` consecutive gram hashes, and the places where one is that.

    Equal stretches choose equal anchors, wherever they stand.
    """
    least = sliding_min(grams, width)
    if not len(least):
        return least, np.empty(0, np.int64)
    # a place is an anchor if the largest of the minima over it is its own value
    spread = np.concatenate([np.full(width - 1, 0, np.uint64), least, np.full(width - 1, 0, np.uint64)])
    largest = ~sliding_min(~spread, width)
    return least, np.flatnonzero(largest == grams)
