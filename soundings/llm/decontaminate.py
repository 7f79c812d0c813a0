"""Benchmark decontamination by hashed n-gram windows.

Item texts are normalised, cut into windows and hashed; a document's words are numbered by
the items' vocabulary (other words get no number), hashed in windows by one running sum and
looked up.  A hit is verified by comparing the word numbers themselves, so a hash never
decides alone.

The hash set goes to all tasks only if the items are within ``BROADCAST_WINDOWS`` windows, which
is counted first.  A larger benchmark is dealt into parts of about that size (long items in overlapping
pieces), and the documents pass the parts one after another; hits of all parts are united per
row, by a row number of its own.  Both ways give the same results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soundings.llm.text import mix, text_runs, window_hashes
from soundings.session import cut_lineage

WINDOW = 10
#: Most item words broadcast at once, about 30 MB in a worker.
BROADCAST_WORDS = 400_000

#: A-Z to lower case; every other byte outside 0-9, a-z and the bytes above 7F to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bench_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Windows:
    """Windows of the items by length: sorted hashes, with the places they come from."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        places: dict[str | None, int] = {}  # rows that repeat an item_id, NULL included, are one item
        found: dict[int, dict[bytes, set[int]]] = {}
        for item_id, text in items:
            words = bench_words((text or "").encode())
            if not words:
                continue
            k = places.setdefault(item_id, len(places))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                found.setdefault(n, {}).setdefault(numbers[i:i + n].tobytes(), set()).add(k)
        self.items = list(places)
        self.tables = {}
        for n, windows in found.items():
            rows = np.frombuffer(b"".join(windows), np.uint32).reshape(-1, n)
            hashes = np.array([window_hashes(mix(r.astype(np.uint64)), n)[0] for r in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(windows.values())
            self.tables[n] = (hashes[order], rows[order], [owners[i] for i in order])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the items that have one."""
        hit, items = np.zeros(len(words), bool), set()
        numbers = np.fromiter(map(self.vocabulary.get, words, _ZEROS), np.uint32, len(words))
        for n, (hashes, rows, owners) in self.tables.items():
            known = np.flatnonzero(np.convolve(numbers > 0, np.ones(n, np.int32), "valid") == n) if len(words) >= n else []
            if not len(known):
                continue
            own = window_hashes(mix(numbers.astype(np.uint64)), n)[known]
            left, right = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for at, a, b in zip(known[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist()):
                for i in range(a, b):
                    if np.array_equal(rows[i], numbers[at:at + n]):
                        hit[at:at + n] = True
                        items |= owners[i]
        return hit, items


class _Zeros:
    """Endless zeros: the number of a word that no item has."""

    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def items_digest(found) -> str:
    """Of item ids as strings, sorted and joined by commas; a NULL id is written "None", yet is an item apart from one of that name."""
    return hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def _scan(windows, whole: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = windows.value
        for batch, texts in text_runs(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, texts):
                words = bench_words(text)
                hit, items = table.scan(words)
                found = [table.items[k] for k in items]
                if whole:
                    rows.append((doc_id, len(words), int(hit.sum()), len(items), items_digest(found), bool(hit.any())))
                else:
                    rows.append((doc_id, len(words), np.packbits(hit).tobytes() if hit.any() else None, found))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] if whole else ["doc_id", "n_words", "hits", "items"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if whole else [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return scan


def _unite(parts):
    import pandas as pd

    bits = [np.frombuffer(h, np.uint8) for h in parts["hits"] if h is not None]
    items = {i for found in parts["items"] for i in found}
    return pd.DataFrame({
        "_row": parts["_row"][:1], "n_hit": [int(np.unpackbits(np.bitwise_or.reduce(bits)).sum()) if bits else 0],
        "n_items": [len(items)], "items_sha256": [items_digest(items)]})


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window.  A document word inside any occurrence of a window is hit.  NULL
    texts have no words; a NULL item id is written "None".  No items, or none with words:
    nothing is hit.  Rows that repeat a doc_id give a row each.
    """
    sc = docs.sparkSession.sparkContext
    docs, (items, size) = docs.select("doc_id", "text"), _measured(items)
    if size <= broadcast_words:
        table = sc.broadcast(Windows([(r[0], r[1]) for r in items.collect()], window))
        return docs.mapInArrow(_scan(table, True), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    # written, so that a row has the same number in every pass
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    counts, hits = _in_parts(rows, items, window, size, broadcast_words)
    none = F.lit(items_digest([]))
    return rows.select("_row", "doc_id").join(counts, "_row").join(hits, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _measured(items: DataFrame) -> tuple[DataFrame, int]:
    """Items that have a text, and a bound of their words and ids: a word and its separator take two bytes at least."""
    items = items.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = F.octet_length("text") + 1 + F.coalesce(F.octet_length("item_id"), F.lit(0))
    return items, items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] // 2


def _cut(window: int, most: int):
    """Items of more than ``most`` words in pieces that share ``window`` - 1 words, so that every window is in one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            out = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), texts):
                words = bench_words(text)
                step = max(1, most - window + 1)
                starts = range(0, max(1, len(words) - window + 1), step) if len(words) > most else [0]
                out += [(item_id, b" ".join(words[a:a + step + window - 1] if len(words) > most else words).decode()) for a in starts if words]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["item_id", "text"])
    return cut


def _in_parts(rows: DataFrame, items: DataFrame, window: int, size: int, broadcast_words: int) -> tuple[DataFrame, DataFrame]:
    """For a benchmark of any size: (_row, n_words) of all rows, and (_row, n_hit, n_items, items_sha256) of those hit.

    ``rows`` (_row, text) pass over bounded parts of the benchmark in turn, so the corpus is read once for each.
    """
    sc, parts = rows.sparkSession.sparkContext, -(-2 * size // broadcast_words)
    pieces = items.mapInArrow(_cut(window, max(window, broadcast_words // 8)), "item_id string, text string").distinct()
    pieces = cut_lineage(pieces.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
    found = None
    for k in range(parts):
        table = sc.broadcast(Windows([(r[0], r[1]) for r in pieces.filter(F.col("_part") == k).select("item_id", "text").collect()], window))
        part = rows.select(F.col("_row").alias("doc_id"), "text").mapInArrow(
            _scan(table, False), "doc_id long, n_words long, hits binary, items array<string>")
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found.withColumnRenamed("doc_id", "_row"))
    hits = found.filter("hits is not null").groupBy("_row").applyInPandas(
        _unite, "_row long, n_hit long, n_items long, items_sha256 string")
    return found.groupBy("_row").agg(F.max("n_words").alias("n_words")), hits


def _clean(windows):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = windows.value
        for batch, texts in text_runs(batches):
            keep = [not table.scan(bench_words(t))[0].any() for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return clean


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents in which no window of an item occurs, with the columns of ``docs``.

    Every row is judged by its own text, also where ids are NULL or repeat, and whatever the size of the benchmark.
    """
    items, size = _measured(items)
    if size <= broadcast_words:
        table = docs.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1]) for r in items.collect()], window))
        return docs.mapInArrow(_clean(table), docs.schema)
    # the caller's columns travel in a struct, so that no name can clash with one used here
    rows = cut_lineage(docs.select(F.struct(*docs.columns).alias("kept"), F.monotonically_increasing_id().alias("_row")))
    _, hits = _in_parts(rows.select("_row", F.col("kept.text").alias("text")), items, window, size, broadcast_words)
    clean = rows.join(hits.select("_row"), "_row", "left_anti")
    return clean.select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))
