"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  Fingerprints that differ in at most four
bits differ in at most one bit of some segment, so with each of that segment's bits in
turn made a wildcard they share at least one key (segment, wildcard, other bits): 64 keys
a fingerprint.  Equal keys meet, and meetings are verified by counting differing bits.

Equal fingerprints are one row from the start.  Within a key only links that join
something new are emitted, never all pairs, and a key with many fingerprints is dealt out in
pairs of blocks over many tasks.  Links become components by rounds of joins.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from soundings.llm.components import components, joined_links
from soundings.llm.text import text_runs
from soundings.session import cut_lineage

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: The three segments as (first bit, number of bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more fingerprints is dealt out in blocks of this size.
BLOCK = 4096
SALTS = 64
#: Links a task holds before it passes them on.
HELD = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is set if set in over half the shingles' hashes; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                         np.uint64, len(words) - k + 1)
    set_bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        set_bits += np.unpackbits(hashes[a:a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            values = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "print"])
    return make


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint ``print`` of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(width), "doc_id long, print long")


def keys_of(prints: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint: a row for each, a column for each segment and wildcard."""
    columns = []
    for segment, (first, bits) in enumerate(SEGMENTS):
        own = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for wildcard in range(bits):
            columns.append((own & ~np.uint64(1 << wildcard)) | np.uint64((segment << 60) | (wildcard << 50)))
    return np.stack(columns, axis=1)


def _variants(block: int):
    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A key that is crowded here already goes to several tasks (``salt``), which only count it."""
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(prints), 8192):
                own = prints[a:a + 8192]
                keys = keys_of(own).ravel()
                repeated = np.repeat(own, len(keys) // len(own))
                _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
                salt = np.where(n[at] > block // 4, 1 + repeated % np.uint64(SALTS), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(repeated.view(np.int64)), pa.array(salt)], ["key", "print", "salt"])
    return variants


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def links_within(prints: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links that join what is close among ``prints``: at most one for each but the first of a group."""
    links, left = [], prints
    while len(left) > 1:  # breadth first from the first one left
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), bool)
            parent = np.zeros(len(left), np.uint64)
            for a in range(0, len(reached), 64):
                close = _close(reached[a:a + 64, None], left[None, :], distance)
                hit = close.any(axis=0) & ~near
                parent[hit] = reached[a + close.argmax(axis=0)[hit]]
                near |= hit
            links.append(np.stack([parent[near], left[near]], axis=1))
            reached, left = left[near], left[~near]
    return links


def _emit(links: list[np.ndarray], crowded: list[int]) -> pa.RecordBatch:
    whole = np.concatenate([np.empty((0, 2), np.uint64), *links]).view(np.int64)
    none, keys = [None] * len(crowded), [None] * len(whole)
    return pa.RecordBatch.from_arrays(
        [pa.array([*whole[:, 0].tolist(), *none], pa.int64()), pa.array([*whole[:, 1].tolist(), *none], pa.int64()),
         pa.array([*keys, *crowded], pa.int64())], ["a", "b", "crowded"])


def links_of_sorted(keys: np.ndarray, prints: np.ndarray, distance: int, block: int) -> tuple[list[np.ndarray], list[int]]:
    """Links of rows sorted by key, and the keys with more than ``block`` rows, which give none."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    firsts, sizes = edges[:-1], np.diff(edges)
    pairs = firsts[sizes == 2]
    close = _close(prints[pairs], prints[pairs + 1], distance)
    links = [np.stack([prints[pairs[close]], prints[pairs[close] + 1]], axis=1)]
    middle = (sizes > 2) & (sizes <= block)
    for at, n in zip(firsts[middle].tolist(), sizes[middle].tolist()):
        links += links_within(prints[at:at + n], distance)
    return links, keys[firsts[sizes > block]].view(np.int64).tolist()


def _meet(distance: int, block: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by salt and key; a key that may go on in the next batch waits for it."""
        held_keys, held = np.empty(0, np.uint64), np.empty(0, np.uint64)
        links, crowded = [], set()
        for batch in batches:
            keys, prints = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "print"))
            salted = batch.column("salt").to_numpy(zero_copy_only=False) > 0
            crowded.update(np.unique(keys[salted]).view(np.int64).tolist())
            keys, prints = np.concatenate([held_keys, keys[~salted]]), np.concatenate([held, prints[~salted]])
            if not len(keys):
                continue
            last = np.flatnonzero(keys != keys[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            found, full = links_of_sorted(keys[:cut], prints[:cut], distance, block)
            crowded.update(full)
            links = joined_links([*links, *found])
            if sum(map(len, links)) > HELD:
                yield _emit(links, [])
                links = []
            # of a crowded key one row more than a block is enough to know it
            held_keys, held = keys[cut:][:block + 1], prints[cut:][:block + 1]
        found, full = links_of_sorted(held_keys, held, distance, block) if len(held) else ([], [])
        yield _emit(joined_links([*links, *found]), sorted(crowded.union(full)))
    return meet


def _block_pair(distance: int):
    def links(parts: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(parts["print"].to_numpy().view(np.uint64))
        whole = np.concatenate([np.empty((0, 2), np.int64), *(x.view(np.int64) for x in joined_links(links_within(prints, distance)))])
        return pd.DataFrame({"a": whole[:, 0], "b": whole[:, 1]})
    return links


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all distinct fingerprints within ``distance`` bits.

    ``prints`` has them in column ``print``.  ``distance`` may be four at most.
    """
    if not 0 <= distance <= 4:
        raise ValueError("three segments with one wildcard each find distances up to four")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.mapInArrow(_variants(block), "key long, print long, salt int")
    met = cut_lineage(keyed.repartition(tasks, "key", "salt").sortWithinPartitions("salt", "key")
                      .mapInArrow(_meet(distance, block), "a long, b long, crowded long"))
    found = met.filter("a is not null").select("a", "b")
    crowded = met.filter("crowded is not null").select(F.col("crowded").alias("_key")).distinct()
    if crowded.isEmpty():
        return found
    rows = cut_lineage(keyed.join(crowded, F.col("key") == F.col("_key"), "left_semi").select("key", "print"))
    blocks = rows.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (rows.join(blocks, F.col("key") == F.col("_key"))
             .withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print"))
    return found.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(_block_pair(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    Shingles are ``width`` consecutive words after lower-casing A-Z, or all words of a text
    that has fewer; a NULL text or one without words has fingerprint zero and is linked like
    any other.  Fingerprints within ``distance`` bits are linked, and component_id is the
    smallest doc_id that links lead to; NULL only where all ids of a component are NULL.
    Rows that repeat a doc_id give a row each.
    """
    prints = cut_lineage(fingerprints(docs, width))
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("print"), distance, block))
    placed = cut_lineage(distinct.join(found, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")))
    smallest = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, F.col("root") == F.col("_root")).select(F.col("print").alias("_print"), "component_id")
    return prints.join(named, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def first_documents(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with the columns of ``docs``.

    Rows that repeat the staying doc_id all stay, and so do NULL ids.
    """
    gone = near_duplicates(docs, width, distance).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
