"""Packing of tokenised documents into training sequences, online and in bounded space.

Each partition keeps a fixed number of open windows.  A document's whole windows are
emitted at once; its tail goes into the open window that it fits best.  When it fits none
and no further window may open, the fullest is emitted, topped up with the tail's
beginning, since documents may be cut.  At a partition's end its open windows are merged,
which leaves one window at most that is not full; those of all partitions are merged in
rounds of up to ``MERGED`` a task, until a single one is left in the whole corpus.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from soundings.session import cut_lineage

LENGTH = 1024
OPEN = 32
MERGED = 256
END = 0
#: Pieces of text whose ids a worker remembers; the table is emptied when full.
REMEMBERED = 200_000
WRITTEN = 4096

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Texts to token ids, as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` file at ``path``.  Its pieces always begin anew
    at a space before a non-space, so the parts of a text between such spaces have ids of
    their own: known parts are looked up, new ones are encoded together and cut by the
    tokens' lengths.  For that the file's vocabulary is read as byte-pair ranks, which
    encode faster; each worker first proves that they give the file's ids on its first
    texts, and else keeps to the file's own encoder.  A text with any other use of the
    space, or with an added token's name, always goes through that encoder as a whole.
    """

    _other_space = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.ranks = Tokenizer.from_file(path), {}, None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.proven = False

    def _read_ranks(self) -> None:
        """The vocabulary as bytes, and each token's length; printable stand-ins of bytes are undone."""
        import tiktoken
        from public_tokenizers import PATTERN

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()
                 if t not in self.added}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it."""
        ids = self.ranks.encode_to_numpy(" " + " ".join(parts), disallowed_special=())
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) + 1 for p in parts]), "left") + 1
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _fast(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        new = {p for parts in split for p in parts[1:]}
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
        new = list(new - self.known.keys())
        if new:
            self.known.update(zip(new, self._parts(new)))
        look = self.known.__getitem__
        return [b"".join([array("I", self.ranks.encode_ordinary(p[0])).tobytes(), *map(look, p[1:])]) for p in split]

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, then the end id."""
        end, out = array("I", [END]).tobytes(), [b""] * len(texts)
        if not self.proven and texts:
            self.proven = True
            try:
                self._read_ranks()
                plain = [t[:20_000] for t in texts[:20] if not self._odd(t[:20_000])]
                if self._fast(plain) != self._whole(plain):
                    self.ranks = None
            except (ImportError, KeyError, ValueError):  # not a byte-level vocabulary
                self.ranks = None
        slow = [i for i, t in enumerate(texts) if self.ranks is None or self._odd(t)]
        skip = set(slow)
        fast = [i for i in range(len(texts)) if i not in skip]
        for places, ids in ((slow, self._whole([texts[i] for i in slow])), (fast, self._fast([texts[i] for i in fast]) if fast else [])):
            for i, one in zip(places, ids):
                out[i] = one + end
        return out

    def _odd(self, text: str) -> bool:
        return bool(self._other_space.search(text)) or any(a in text for a in self.added)


class Packer:
    """Open windows of one task; ``emit`` gets each closed window as a list of pieces.

    A piece is (doc_id, start, ids, doc_tokens), ids four bytes each.
    """

    def __init__(self, emit, length: int = LENGTH, windows: int = OPEN):
        self.emit, self.length, self.windows = emit, length, windows
        self.open: list[list] = []  # [used, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        at, n = 0, len(ids) // 4
        while n - at >= self.length:
            self.emit([(doc_id, start + at, ids[4 * at:4 * (at + self.length)], doc_tokens)])
            at += self.length
        while at < n:
            left = n - at
            fits = [w for w in self.open if self.length - w[0] >= left]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                left = self.length - best[0]
            best[1].append((doc_id, start + at, ids[4 * at:4 * (at + left)], doc_tokens))
            best[0] += left
            at += left
            if best[0] == self.length:
                self.emit(best[1])
                self.open.remove(best)

    def merge(self) -> list[tuple] | None:
        """Close what can be filled from the open windows; the pieces of the last one."""
        rest, self.open = sorted(self.open, key=lambda w: -w[0]), []
        self.windows = 1
        for _, pieces in rest:
            for piece in pieces:
                self.add(*piece)
        return self.open[0][1] if self.open else None


def _number(turn: int, task: int, n: int) -> int:
    """Sequence numbers do not meet: 5 bits for the round, 27 for the task, 31 within it."""
    return (turn << 58) | (task << 31) | n


class _Rows:
    """Pieces as rows; ``loose`` pieces keep their ids for a later round."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"]
    types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]

    def __init__(self, turn: int, task: int):
        self.turn, self.task, self.n, self.rows = turn, task, 0, []

    def window(self, pieces: list[tuple], loose: bool = False) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens,
                              _number(self.turn, self.task, self.n), at, ids if loose else None, self.task))
            at += len(ids) // 4
        self.n += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.types)], self.names)


def _pack(path: str | None, length: int, windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path or tokenizer_path())
        rows = _Rows(0, TaskContext.get().partitionId())
        packer = Packer(rows.window, length, windows)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a in range(0, len(names), 256):
                made = ids.of([t or "" for t in texts.slice(a, 256).to_pylist()])
                for doc_id, one in zip(names[a:a + 256], made):
                    packer.add(doc_id, 0, one, len(one) // 4)
                if len(rows.rows) >= WRITTEN:
                    yield rows.batch()
        last = packer.merge()
        if last:
            rows.window(last, loose=True)
        if rows.rows:
            yield rows.batch()
    return pack


def _merge(turn: int, length: int, final: bool):
    def merge(key, parts):
        import pandas as pd

        rows = _Rows(turn, int(key[0]))
        packer = Packer(rows.window, length, 1)
        parts = parts.sort_values(["task", "offset"])
        for doc_id, start, ids, n in zip(parts["doc_id"], parts["start"], parts["ids"], parts["doc_tokens"]):
            packer.add(None if pd.isna(doc_id) else int(doc_id), int(start), ids, int(n))
        last = packer.merge()
        if last:
            rows.window(last, loose=not final)
        return pd.DataFrame(rows.rows, columns=rows.names).astype({"doc_id": "Int64"})
    return merge


def pack(docs: DataFrame, length: int = LENGTH, windows: int = OPEN, path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, one row each.

    ``path`` names the tokenizer's file where it is not the public one.  A document is its
    ids and one end id; a NULL or empty text is the end id alone.  Every id lies in exactly
    one piece, all sequences but the very last are full, and no tokens give no rows.  A
    NULL doc_id is kept; rows that repeat a doc_id are packed each.
    """
    every = FIELDS + ", ids binary, task long"
    table = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(path, length, windows), every))
    columns = [f.split()[0] for f in FIELDS.split(", ")]
    done, loose = table.filter("ids is null").select(*columns), table.filter("ids is not null")
    for turn in range(1, 32):
        groups = loose.agg((F.max("task") / MERGED).cast("long").alias("n")).first()["n"]
        if groups is None:
            return done
        table = cut_lineage(
            loose.withColumn("unit", (F.col("task") / MERGED).cast("long"))
            .groupBy("unit").applyInPandas(_merge(turn, length, groups == 0), every))
        done = done.unionByName(table.filter("ids is null").select(*columns))
        loose = table.filter("ids is not null")
        if groups == 0:
            return done
    raise ValueError("more rounds than sequence numbers allow")
