"""Substring dedup by anchored window hashing against a blocked reference, in place of relative Lempel-Ziv parsing.

The reference of a document is the whole corpus.  It is indexed in blocks by what a phrase
says and not by where it stands: block b holds all phrases whose anchor hash falls into
its range, so that a phrase that occurs again has its other places in one known block, and
parsing a document against every block means asking, for each of its phrases, the one
block that can hold it.

1. Phrases are found by anchors: of the 16-word grams in each 35-word window the one with
   the smallest hash.  Equal windows have equal anchors.  Blocks tell which anchors occur again;
   text without such an anchor cannot belong to a factor.
2. Only there the windows themselves, under 128-bit hashes, are looked up in the
   blocks.  This is the check at the factors' boundaries: it settles each start by itself.
3. Documents are parsed greedily: at the first unparsed word that begins a window found
   elsewhere a factor starts, and it goes on while each next word ends such a window.
   Factors are at least one window long; their words are the duplicate spans.  A factor is tied to no
   source place, and its windows may come from several documents: nothing is extended against a block.

A very long text is cut to runs for hashing and otherwise treated like any other.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from soundings.llm.marks import CROWDED_BIT, Unit, anchors, identified, release, repeated_marks, with_answers
from soundings.llm.text import WordHashes, text_runs, window_hashes

WINDOW = 35
GRAM = 16
#: Fixed value: a second odd base, for the other half of a window's hash.
SECOND = 0xD6E8FEB86659FD93


def _anchor_marks(window: int, gram: int):
    known = WordHashes()

    def mark(row: dict, unit: Unit) -> None:
        words = row["text"].split()
        grams = window_hashes(known.of(words), gram)
        _, places = anchors(grams, window - gram + 1)
        unit.add(row["doc_id"], row["print"], len(words) + 1, places, grams[places].reshape(-1, 1))
    return mark


def _window_marks(window: int, gram: int):
    known = WordHashes()

    def mark(row: dict, unit: Unit) -> None:
        words = row["text"].split()
        hashes = known.of(words)
        grams = window_hashes(hashes, gram)
        least, _ = anchors(grams, window - gram + 1)
        again = np.unique(grams[np.frombuffer(row["places"], np.uint32) & np.uint32(CROWDED_BIT - 1)])
        places = np.flatnonzero(again[np.minimum(np.searchsorted(again, least), len(again) - 1)] == least)
        values = np.stack([window_hashes(hashes, window)[places], window_hashes(hashes, window, SECOND)[places]], axis=1)
        unit.add(row["doc_id"], row["print"], len(words) + 1, places, values)
    return mark


def factors(starts: np.ndarray, window: int) -> np.ndarray:
    """Greedy parse: first word and length of each factor, given the sorted starts of found windows."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    starts = starts.astype(np.int64)
    new = np.flatnonzero(np.r_[True, np.diff(starts) > 1])  # a factor ends where no next word extends it
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return np.stack([starts[new], starts[last] - starts[new] + window], axis=1)


def _remove(window: int, texts_too: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            ids, found, rows = batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), []
            for doc_id, text, places in zip(ids, texts, found):
                words = text.split()
                spans = factors(np.frombuffer(places or b"", np.uint32) & np.uint32(CROWDED_BIT - 1), window)
                kept, at, removed = [], 0, 0
                for start, length in spans.tolist():  # spans may overlap, as two sources may
                    kept += words[at:max(at, start)]
                    removed += max(0, start + length - max(at, start))
                    at = max(at, start + length)
                kept += words[at:]
                joined = b" ".join(kept)
                rows.append((doc_id, len(words), removed, hashlib.sha256(joined).hexdigest(), len(spans), joined.decode() if texts_too else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()])],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "kept_text"])
    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, n_factors, kept_text.

    Words are runs of anything but ASCII white space.  A word goes if it lies in a window of
    ``window`` words whose sequence also starts at another place, in this document or another;
    all copies go.  A NULL text has no words, a text shorter than a window loses none, and
    rows that repeat an id or a text are documents of their own, so equal texts lose all
    windows.  Kept words are joined by one space; ``with_text=False`` leaves
    them NULL.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram must fit into a window")
    texts = identified(docs)
    candidates = repeated_marks(texts, _anchor_marks(window, gram))
    release(docs.sparkSession)
    found = repeated_marks(with_answers(texts, candidates, "inner"), _window_marks(window, gram), 2)
    del candidates
    release(docs.sparkSession)
    return with_answers(texts, found, "left").mapInArrow(
        _remove(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, kept_text string")
