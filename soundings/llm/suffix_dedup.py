"""Suffix dedup by grouping sorted 50-byte windows, in place of longest-previous-factor arrays.

A byte goes if it lies in a factor of at least 50 bytes that an earlier document (smaller
doc_id) has too; the first document keeps its copy.  Whether position i begins such a
factor is what the longest-previous-factor array says: in suffix order, the nearest suffixes
before and after i that stand earlier in the corpus share the most with it.

One suffix array of everything would not fit anywhere, so the suffixes that can matter are
dealt to blocks in which all their rivals are:

1. Of the 20-byte grams in each 50-byte window the one with the smallest hash is the window's
   anchor; equal windows have equal anchors.  Neighbouring windows with one anchor are a
   stretch.  Its anchor, a hash of its text and its doc_id go to the block of the anchor.  A
   stretch that an earlier document has too is a copy as a whole, and is settled without its
   text.  Anchors of one document alone, or with one text alone, need no more.
2. Where an anchor has several texts, the first document's stretch of each goes, as text, to
   the block of the anchor's hash.  An anchor with very many places (``CROWDED``) would crowd
   its block, so its windows go one by one to the blocks of their own hashes.
3. A block sorts its suffixes, to a depth of 50 bytes, and then by document.  Suffixes
   that share 50 bytes are neighbours; within such a run the previous smaller position of
   every suffix but those of the first document is an earlier document's, and there is
   no next smaller one.  So a group's smallest document decides; no previous or next smaller
   positions and no common lengths beyond 50 bytes are computed.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from soundings.llm.marks import (ANSWER, CROWDED, CROWDED_BIT, SENT, Unit, _documents_row, _pass_documents, answer, block_of, blocks_for,
                                 by_document, first_of_runs, identified, own_block, release, sender, sliding_min, with_answers)
from soundings.llm.text import cover, from_planes, mix, planes, steps, stretch_hashes, text_runs, window_hashes
from soundings.session import cut_lineage

WIDTH = 50
GRAM = 20
#: Windows of a stretch, as bits of one number.
STRETCH = 64
#: Suffixes sorted at a time, unless one anchor has more.
SORTED = 150_000

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93  # another than that of the grams
_LOW = np.uint64(0xFFFFFFFF)


def _grams(text: bytes, gram: int) -> np.ndarray:
    return window_hashes(_BYTES[np.frombuffer(text, np.uint8)], gram)


def stretches(text: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where neighbouring windows with one anchor begin, their number (``STRETCH`` at most) and the anchor."""
    least = sliding_min(_grams(text, gram), width - gram + 1)
    first = first_of_runs(least.reshape(-1, 1))
    n = np.diff(np.r_[first, len(least)])
    pieces = -(-n // STRETCH)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(first, pieces) + STRETCH * step
    return starts, np.minimum(np.repeat(first + n, pieces) - starts, STRETCH), least[starts]


def _all_windows(sizes: np.ndarray) -> np.ndarray:
    return np.uint64(2 ** 64 - 1) >> (np.uint64(64) - sizes.astype(np.uint64))


def _stretch_marks(width: int, gram: int):
    def mark(row: dict, unit: Unit) -> None:
        text = row["text"]
        if row["doc_id"] is None:  # neither earlier nor later than another
            return
        starts, sizes, keys = stretches(text, width, gram)
        prints = stretch_hashes(_BYTES[np.frombuffer(text, np.uint8)], starts, sizes + width - 1, _BASE)
        unit.add(row["doc_id"], row["print"], len(text) + 1, starts, np.stack([keys, prints, sizes.astype(np.uint64)], axis=1))
    return mark


def _send_stretches(unit: Unit, blocks: int) -> Iterator[dict]:
    if not unit.ids:
        return
    yield _documents_row(unit)
    if not unit.marks:
        return
    (keys, prints, sizes), places = np.ascontiguousarray(np.concatenate(unit.values).T), np.concatenate(unit.places)
    ids = np.array(unit.ids, np.int64)[np.concatenate(unit.owners)]
    copied = _copies(keys, prints, ids)[0]
    later = np.flatnonzero(copied)  # copies of an earlier document of the same unit
    if len(later):
        yield {"block": own_block(unit.number), "unit": unit.number, "values": _all_windows(sizes[later]).tobytes(), "counts": None,
               "places": places[later].astype(np.uint32).tobytes(), "owners": b"", "extra": b""}
    own = np.flatnonzero(~copied)
    block = block_of(keys[own], blocks).astype(np.int64)
    order = np.argsort(block, kind="stable")  # by place within a block
    own, block = own[order], block[order]
    cuts = first_of_runs(block.reshape(-1, 1))
    for a, b in zip(cuts, np.r_[cuts[1:], len(own)]):
        at = own[a:b]
        yield {"block": int(block[a]), "unit": unit.number, "values": prints[at].tobytes(), "counts": b"",
               "places": planes(steps(places[at].astype(np.uint32))), "owners": planes(steps(ids[at])),
               "extra": (keys[at] & _LOW).astype(np.uint32).tobytes() + sizes[at].astype(np.uint8).tobytes()}


def _copies(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which stretches an earlier document has as a whole; an order by anchor and text, and where in it a text begins."""
    order = np.lexsort((ids, prints, keys))
    first = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]) | (prints[order][1:] != prints[order][:-1])])
    copied = np.empty(len(keys), bool)
    copied[order] = ids[order] > np.repeat(ids[order][first], np.diff(np.r_[first, len(order)]))
    return copied, order, first


def _settle(crowded: int):
    def settle(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Stretches that are copies as a whole, with their windows, and those whose text is asked for, without."""
        if key[0] < 0:
            return _own_rows(rows)
        numbers = [len(v) // 8 for v in rows["values"]]
        prints = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["values"]])
        keys = np.concatenate([np.frombuffer(e, np.uint32, n) for e, n in zip(rows["extra"], numbers)])
        sizes = np.concatenate([np.frombuffer(e, np.uint8, offset=4 * n) for e, n in zip(rows["extra"], numbers)])
        places = np.concatenate([np.cumsum(from_planes(p, np.uint32), dtype=np.uint32) for p in rows["places"]])
        ids = np.concatenate([np.cumsum(from_planes(o, np.int64)) for o in rows["owners"]])
        copied, order, texts = _copies(keys, prints, ids)
        first = first_of_runs(keys[order].reshape(-1, 1))
        n = np.diff(np.r_[first, len(order)])
        several = np.diff(np.searchsorted(texts, np.r_[first, len(order)])) > 1
        several &= np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
        asked = np.empty(len(keys), bool)
        asked[order] = np.repeat(several, n)
        asked &= ~copied
        many = np.empty(len(keys), bool)
        many[order] = np.repeat(np.add.reduceat(asked[order].astype(np.int64), first) > crowded, n)
        places = np.where(asked & many, places | np.uint32(CROWDED_BIT), places)
        units, told, values, at = [], [], [], 0
        for unit, n in zip(rows["unit"], numbers):
            for which, masks in ((copied[at:at + n], True), (asked[at:at + n], False)):
                if which.any():
                    units.append(unit)
                    told.append(places[at:at + n][which].tobytes())
                    values.append(_all_windows(sizes[at:at + n][which]).tobytes() if masks else b"")
            at += n
        return answer(units, told, values)
    return settle


def _own_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """What a unit kept for itself: its documents and the copies within it."""
    about, later = rows[rows["counts"].notna()], rows[rows["counts"].isna()]
    return pd.concat([_pass_documents(about), answer(list(later["unit"]), list(later["places"]), list(later["values"]))])


def _texts(width: int, gram: int):
    def mark(row: dict, unit: Unit) -> None:
        text, told = row["text"], np.frombuffer(row["places"], np.uint32)
        starts, sizes, keys = stretches(text, width, gram)
        at = np.searchsorted(starts, told & np.uint32(CROWDED_BIT - 1))
        crowded = told >= CROWDED_BIT
        whole, single = at[~crowded], at[crowded]
        ends = starts[whole] + sizes[whole] + width - 1
        starts_of, texts, keys_of = starts[whole], [text[a:b] for a, b in zip(starts[whole].tolist(), ends.tolist())], keys[whole]
        if len(single):
            n = sizes[single]
            windows = np.repeat(starts[single], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            alone = [text[a:a + width] for a in windows.tolist()]
            starts_of, texts = np.r_[starts_of, windows], texts + alone
            keys_of = np.r_[keys_of, np.array([xxhash.xxh3_64_intdigest(x) for x in alone], np.uint64)]
        unit.add(row["doc_id"], row["print"], len(text) + 1, starts_of, keys_of.reshape(-1, 1), texts)
    return mark


def _send(width: int):
    def send(unit: Unit, blocks: int) -> Iterator[dict]:
        if not unit.ids:
            return
        yield _documents_row(unit)
        if not unit.marks:
            return
        keys, places = np.concatenate(unit.values)[:, 0], np.concatenate(unit.places)
        ids = np.array(unit.ids, np.int64)[np.concatenate(unit.owners)]
        entries: dict[tuple[int, bytes], int] = {}
        entry = np.fromiter((entries.setdefault(x, len(entries)) for x in zip(keys.tolist(), unit.extra)), np.int64, len(keys))
        texts = [t for _, t in entries]
        first = np.full(len(entries), np.iinfo(np.int64).max)
        np.minimum.at(first, entry, ids)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) - width + 1
        later = np.flatnonzero(ids > first[entry])  # copies of an earlier document of the same unit
        if len(later):
            yield {"block": own_block(unit.number), "unit": unit.number, "values": _all_windows(sizes[entry[later]]).tobytes(), "counts": None,
                   "places": places[later].astype(np.uint32).tobytes(), "owners": b"", "extra": b""}
        own = np.flatnonzero(ids == first[entry])
        entry_keys = np.fromiter((k for k, _ in entries), np.uint64, len(entries))
        entry_blocks = block_of(entry_keys, blocks).astype(np.int64)
        own = own[np.lexsort((entry[own], entry_blocks[entry[own]]))]
        entry, places = entry[own], places[own]
        new = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        order, counts, ends = entry[new], np.diff(np.r_[new, len(entry)]), np.r_[new, len(entry)]
        block = entry_blocks[order]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
            yield {"block": int(block[a]), "unit": unit.number, "values": entry_keys[order[a:b]].tobytes(),
                   "counts": counts[a:b].astype(np.uint32).tobytes(), "places": places[ends[a]:ends[b]].astype(np.uint32).tobytes(),
                   "owners": first[order[a:b]].tobytes(),
                   "extra": sizes[order[a:b]].astype(np.uint16).tobytes() + b"".join([texts[i] for i in order[a:b].tolist()])}
    return send


def previous_factors(text: np.ndarray, starts: np.ndarray, documents: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes share ``width`` bytes with one of an earlier document.

    ``starts`` are places in ``text`` with at least ``width`` bytes after them.
    """
    words = -(-width // 8)
    padded = np.concatenate([text, np.zeros(8 * words, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)[starts]
    rows[:, width:] = 0
    columns = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((documents, *columns.T[::-1]))  # suffix order, then by document
    columns = columns[order]
    first = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]).any(axis=1)])
    earliest = np.repeat(documents[order][first], np.diff(np.r_[first, len(order)]))
    out = np.empty(len(starts), bool)
    out[order] = documents[order] > earliest
    return out


def _masks(keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, begins: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each stretch the windows, as bits, that an earlier document has."""
    masks = np.zeros(len(keys), np.uint64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    rivals = np.minimum.reduceat(owners[order], first) != np.maximum.reduceat(owners[order], first)
    groups = [order[a:b] for a, b, r in zip(first, np.r_[first[1:], len(order)], rivals) if r]
    held, n = [], 0
    for k, group in enumerate(groups):
        held.append(group)
        n += int(sizes[group].sum())
        if n < SORTED and k + 1 < len(groups):
            continue
        own = np.concatenate(held)
        held, n = [], 0
        edges = np.cumsum(sizes[own]) - sizes[own]
        step = np.arange(int(sizes[own].sum())) - np.repeat(edges, sizes[own])
        copied = previous_factors(text, np.repeat(begins[own], sizes[own]) + step, np.repeat(owners[own], sizes[own]), width)
        masks[own] = np.bitwise_or.reduceat(copied.astype(np.uint64) << step.astype(np.uint64), edges)
    return masks


def _find(width: int):
    def find(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return _own_rows(rows)
        keys = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["values"]])
        owners = np.concatenate([np.frombuffer(v, np.int64) for v in rows["owners"]])
        numbers = [len(v) // 8 for v in rows["values"]]
        sizes = np.concatenate([np.frombuffer(e, np.uint16, n) for e, n in zip(rows["extra"], numbers)]).astype(np.int64)
        text = np.concatenate([np.frombuffer(e, np.uint8, offset=2 * n) for e, n in zip(rows["extra"], numbers)])
        lengths = sizes + width - 1
        masks = _masks(keys, owners, sizes, np.cumsum(lengths) - lengths, text, width)
        units, places, values, at = [], [], [], 0
        for unit, n, counts, own in zip(rows["unit"], numbers, rows["counts"], rows["places"]):
            each = np.repeat(masks[at:at + n], np.frombuffer(counts, np.uint32))
            at += n
            if each.any():
                units.append(unit)
                places.append(np.frombuffer(own, np.uint32)[each > 0].tobytes())
                values.append(each[each > 0].tobytes())
        return answer(units, places, values)
    return find


def _remove(width: int, bytes_too: bool):
    bits = np.arange(STRETCH, dtype=np.uint64)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            rows = []
            for doc_id, text, places, masks in zip(*(batch.column(c).to_pylist() if c != "text" else texts for c in ("doc_id", "text", "places", "values"))):
                kept, removed, spans = text, 0, 0
                if places:
                    set_bits = (np.frombuffer(masks, np.uint64)[:, None] >> bits) & np.uint64(1) > 0
                    starts = (np.frombuffer(places, np.uint32).astype(np.int64)[:, None] + bits.astype(np.int64))[set_bits]
                    gone = cover(starts, width, len(text))
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if bytes_too else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return remove


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowded: int = CROWDED, with_bytes: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    A byte of a text (UTF-8; NULL is empty) goes if a string of ``width`` bytes that covers it
    also starts in a document with a smaller doc_id.  Texts shorter than that lose nothing.
    A NULL id is neither smaller nor larger than another, so its row loses nothing and costs
    others nothing; rows that repeat an id do not count against each other.  ``with_bytes=False`` leaves
    ``kept`` NULL.
    """
    if not 0 < gram <= width:
        raise ValueError("a gram must fit into the width")
    texts = identified(docs)
    sent = texts.mapInArrow(sender(_stretch_marks(width, gram), blocks_for(texts), _send_stretches), SENT)
    settled = cut_lineage(sent.groupBy("block").applyInPandas(_settle(crowded), ANSWER))
    del sent
    release(docs.sparkSession)
    copied = _copied(texts, settled.filter("ids is not null or length(values) = 0"), width, gram)
    release(docs.sparkSession)
    whole, part = by_document(settled.filter("ids is not null or length(values) > 0")), by_document(copied)
    found = whole.withColumn("of", F.lit(0)).unionByName(part.withColumn("of", F.lit(1))).groupBy("doc_id", "print").agg(
        *(F.concat(*(F.coalesce(F.first(F.when(F.col("of") == k, F.col(c)), True), F.lit(b"")) for k in (0, 1))).alias(c) for c in ("places", "values")))
    return with_answers(texts, found, "left").mapInArrow(
        _remove(width, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _copied(texts: DataFrame, asked: DataFrame, width: int, gram: int) -> DataFrame:
    """Answers of the blocks: places of stretches and the windows in them that are copies."""
    sent = with_answers(texts, by_document(asked), "inner").mapInArrow(sender(_texts(width, gram), blocks_for(texts), _send(width)), SENT)
    return cut_lineage(sent.groupBy("block").applyInPandas(_find(width), ANSWER))
