"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding joins, over and over, the adjacent pair whose bytes have the lowest rank.  What it
leaves is the one sequence of tokens in which every token is left alone by its own bytes and
every adjacent pair by the bytes of the two: while no join crosses a boundary, the joins
within a pair of neighbours are those that the pair would make alone, so the first join to
cross a boundary would cross it there too.

So the merges compile to a transducer that reads bytes: a configuration is the last token,
the bytes read since, and the tokens not yet emitted; it may end a token wherever its bytes
are one that fits the last.  One way alone leads to the end of a text.  The transducer is
determinised as it is used: a state is the set of configurations that the bytes so far
allow, a step is made the first time a text takes it, and a token is emitted as soon as all
configurations agree on it, which is a few bytes after its end.  States and the results of
known pieces of text are kept while there is room.

Decoding looks tokens up and passes them through a state machine of UTF-8, token by token,
which gives out whole characters and holds back the bytes of one that has begun.
"""
from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from soundings.llm.text import text_runs

#: States a worker keeps (about half a KB each), and pieces of text whose ids it remembers; both start anew when full.
STATES = 300_000
REMEMBERED = 400_000
#: Pieces, and ids, that are handled at a time.
CHUNK = 1 << 17

#: Pieces with more characters are not remembered.
LONGEST = 64

NEVER = float("inf")
EMITS = 256
END_OF = [bytes((i,)) for i in range(256)]
EVERY = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one token per line: its bytes in base64, then the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """What the ranks do to the bytes of one token, and to those of two neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.ends: dict[int, tuple | None] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def _ends(self, token: int) -> tuple | None:
        """Elements that stand first while a token is joined, and those that stand last; None if it is never joined.

        Each comes with the highest rank joined before another element takes its place.
        """
        data, ranks = self.tokens[token], self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        left, right, highest_left, highest_right = [], [], -1, -1
        while len(parts) > 1:
            found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(found)
            if rank == NEVER:
                return None
            at = found.index(rank)
            highest_left, highest_right = max(highest_left, rank), max(highest_right, rank)
            if at == 0:
                left.append((parts[0], highest_left))
                highest_left = -1
            if at == len(parts) - 2:
                right.append((parts[-1], highest_right))
                highest_right = -1
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [*left, (data, NEVER)], [*right, (data, NEVER)]

    def ends_of(self, token: int) -> tuple | None:
        if token not in self.ends:
            self.ends[token] = self._ends(token)
        return self.ends[token]

    def fit(self, before: int | None, token: int) -> bool:
        """Whether ``token`` is left as it is after ``before`` (None: at the beginning)."""
        if before is None:
            return self.ends_of(token) is not None
        found = self.known.get((before, token))
        if found is None:
            if len(self.known) >= 5 * REMEMBERED:
                self.known.clear()
            found = self.known[before, token] = self.ends_of(token) is not None and self._apart(before, token)
        return found

    def _apart(self, before: int, token: int) -> bool:
        """No join crosses the boundary: each possible one comes later than one that changes an element beside it.

        Both sides go on by lowest rank, the left one first where ranks are equal, so the side whose
        highest rank until its next change is the lower one changes first.
        """
        lefts, rights = self.ends_of(before)[1], self.ends_of(token)[0]
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = lefts[i], rights[j]
            rank = self.ranks.get(a + b, NEVER)
            if rank < until_a and rank <= until_b and rank != NEVER:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes of one piece of text to token ids.

    A configuration is (last token or None, bytes since, tokens held back).  States are numbered in
    steps of 512, so that a state plus a byte names a step; ``EMITS`` is added to the state that a
    step leads to where the step emits tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.merges = ranks, Merges(ranks)
        self.beginnings = {token[:i]: token[:i] for token in ranks for i in range(1, len(token))}
        self._anew()

    def _anew(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.configurations: list[tuple] = []
        #: by state, what is still to be emitted if the text ends there; a text that is one token is that token
        self.last: list[tuple[int, ...]] = []
        self.steps: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self._number(((None, b"", ()),))

    def _number(self, configurations: tuple) -> int:
        found = self.numbers.get(configurations)
        if found is None:
            found = self.numbers[configurations] = 2 * EMITS * len(self.configurations)
            self.configurations.append(configurations)
            whole = [(self.ranks[since],) for before, since, held in configurations if before is None and since in self.ranks]
            ended = [held for before, since, held in configurations if not since]
            self.last.append((whole or ended)[0])
        return found

    def _step(self, state: int, byte: int) -> int:
        """Make the step from a state: the state after ``byte``, and the tokens that all its configurations agree on."""
        ranks, beginnings, fit, reached, agreed = self.ranks, self.beginnings, self.merges.fit, [], 0
        end = END_OF[byte]
        for before, since, held in self.configurations[state // (2 * EMITS)]:
            longer = since + end
            token = ranks.get(longer)
            if longer in beginnings or (before is None and token is not None):
                reached.append((before, beginnings.get(longer, longer), held))
            if token is not None and fit(before, token):
                reached.append((token, b"", (*held, token)))
        held = reached[0][2]
        while agreed < len(held) and all(len(c[2]) > agreed and c[2][agreed] == held[agreed] for c in reached):
            agreed += 1
        step = state + byte
        if agreed:
            reached = [(before, since, held[agreed:]) for before, since, held in reached]
            self.emitted[step] = held[:agreed]
        found = self.steps[step] = self._number(tuple(reached)) + (EMITS if agreed else 0)
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.configurations) >= STATES:
            self._anew()
        state, ids, steps = 0, [], self.steps
        for byte in piece:
            found = steps.get(state + byte)
            if found is None:
                found = self._step(state, byte)
            if found & EMITS:
                ids += self.emitted[state + byte]
                found -= EMITS
            state = found
        return [*ids, *self.last[state // (2 * EMITS)]]


class Pieces(dict):
    """Ids of pieces of text, four bytes each, remembered while there is room."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.transducer = Transducer(ranks)

    def __missing__(self, piece: str) -> bytes:
        found = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Texts to ids: the pattern cuts a text into pieces, the transducer reads each.

    Letters and numbers are those of the library that the ranks are for.  Where the pattern engine
    used here knows other ones, texts with such a character take a pattern with both classes written out.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pieces, self.plain = Pieces(ranks), regex.compile(pattern)
        differing, written_out = set(), pattern
        for name in (r"\p{L}", r"\p{N}"):
            members = self._members(name)
            differing |= members.symmetric_difference(regex.findall(name, EVERY))
            written_out = written_out.replace(name, self._ranges(members))
        self.differing = frozenset(differing)
        self.suspect = re.compile(f"[{min(differing)}-\U0010ffff]") if differing else re.compile("(?!)")
        self.written_out = regex.compile(written_out, regex.V1)

    @staticmethod
    def _members(name: str) -> set[str]:
        """Characters that the library counts into a class."""
        import tiktoken

        one = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes((i,)): i for i in range(256)}, special_tokens={})
        return set(bytes(one.encode_ordinary(EVERY)).decode())

    @staticmethod
    def _ranges(members: set[str]) -> str:
        points = np.array(sorted(map(ord, members)))
        cuts = np.flatnonzero(np.diff(points) != 1)
        firsts, lasts = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist())) + "]"

    def _cut(self, text: str) -> Iterator[list[str]]:
        odd = not text.isascii() and self.suspect.search(text) and not self.differing.isdisjoint(text)
        pattern = self.written_out if odd else self.plain
        if len(text) <= CHUNK:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, CHUNK)):
            yield part

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(b"".join(map(self.pieces.__getitem__, part)) for part in self._cut(text)), "<u4")


# ------------------------------------------------------------------------------ decoding

def _utf8_table() -> np.ndarray:
    """State after a byte, by state: 0 whole characters, 1 to 7 within one, -1 not UTF-8.

    States 1 to 3 wait for as many bytes; 4 and 5 for two and 6 and 7 for three, the next of them in a narrower range.
    """
    table = np.full((8, 256), -1, np.int8)
    # fixed values: lead bytes and ranges of UTF-8
    for first, last, state in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
                               (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        table[0, first:last + 1] = state
    for state, first, last, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1),
                                     (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state, first:last + 1] = then
    return table


class Utf8:
    """Steps of the UTF-8 state machine over whole tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.table = tokens, _utf8_table().tolist()
        self.steps: dict[tuple[int, int], tuple[int, int, int]] = {}
        #: tokens of whole characters only
        self.whole = np.array([self._run(0, t) == (0, 0, 0) for t in tokens])

    def _run(self, state: int, data: bytes) -> tuple[int, int, int]:
        """State after ``data``, its bytes that belong to a character not yet whole, and errors met."""
        due, errors = 0, 0
        for byte in data:
            following = self.table[state][byte]
            if following < 0:
                errors, due = errors + 1, 0
                following = max(self.table[0][byte], 0) if state else 0
            state = following
            due = due + 1 if state else 0
        return state, due, errors

    def step(self, state: int, token: int) -> tuple[int, int, int]:
        found = self.steps.get((state, token))
        if found is None:
            found = self.steps[state, token] = self._run(state, self.tokens[token])
        return found


class StreamDecoder:
    """Ids in, whole characters out; bytes of a character that has only begun wait for the next ids.

    Bytes that are no UTF-8 come out unchanged, so the output is always the bytes of the tokens;
    ``errors`` counts them.
    """

    def __init__(self, machine: Utf8):
        self.machine, self.state, self.pending, self.errors = machine, 0, b"", 0

    def feed(self, ids: np.ndarray) -> bytes:
        machine, last = self.machine, -1
        due = len(self.pending)
        for i in np.flatnonzero(~machine.whole[ids]).tolist():
            if self.state and i != last + 1:
                self.errors, self.state, due = self.errors + 1, 0, 0
            state, more, errors = machine.step(self.state, int(ids[i]))
            # a token that begins and ends within one character adds to what is due
            due = due + more if self.state and state and not errors and more == len(machine.tokens[ids[i]]) else more
            self.state, last = state, i
            self.errors += errors
        if self.state and last != len(ids) - 1 and len(ids):
            self.errors, self.state, due = self.errors + 1, 0, 0
        out = self.pending + b"".join(map(machine.tokens.__getitem__, ids.tolist()))
        cut = len(out) - (due if self.state else 0)
        self.pending = out[cut:]
        return out[:cut]

    def finish(self) -> bytes:
        """What is left of a character that never became whole."""
        rest, self.errors = self.pending, self.errors + (self.state != 0)
        self.state, self.pending = 0, b""
        return rest


# ----------------------------------------------------------------------------- operators

@lru_cache(maxsize=2)
def _tools(path: str, pattern: str | None) -> tuple[Encoder, Utf8, list[str]]:
    """Encoder, decoder's tables and ids in decimal, once for each worker."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Encoder(ranks, pattern), Utf8(tokens), [str(i) for i in range(len(tokens))]


def _encoded(path: str, pattern: str | None, with_ids: bool):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, machine, decimal = _tools(path, pattern)
        for part, texts in text_runs(batches):
            counts, digests, decoded, kept = [], [], [], []
            for data in texts:
                ids = encoder.encode(data.decode("utf-8", "replace"))
                sha, back, decoder = hashlib.sha256(), hashlib.sha256(), StreamDecoder(machine)
                for a in range(0, len(ids), CHUNK):
                    some = ids[a:a + CHUNK]
                    sha.update((("," if a else "") + ",".join(map(decimal.__getitem__, some.tolist()))).encode())
                    back.update(decoder.feed(some))
                back.update(decoder.finish())
                counts.append(len(ids))
                digests.append(sha.hexdigest())
                decoded.append(back.hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            columns = [part.column("row"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return encoded


def encode(docs: DataFrame, text_column: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Each row of ``docs``, its text replaced by ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``token_ids``.

    ``path`` names the file of ranks (``public_tokenizers``' multilingual one by default, which must
    be installed on every executor), ``pattern`` cuts texts.  No special tokens are read or added.

    NULL and empty texts have no tokens.  A text of any length is encoded whole, piece after
    piece; a piece takes time in proportion to its bytes.  Bytes that are no UTF-8 are read as the
    replacement character.  Rows are independent, so repeated rows and NULL ids need no rule.  An
    empty table gives no rows.  Other columns pass through; those named like a result column are replaced.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if with_ids else [])]
    named = [c for c in docs.columns if c not in (*results, text_column)]
    carried = F.struct(*named) if named else F.struct(F.lit(None).cast("int").alias("_"))
    rows = docs.select(carried.alias("row"), F.col(text_column).cast("binary").alias("text"))
    schema = rows.select("row").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("token_ids", ArrayType(IntegerType()))
    done = rows.mapInArrow(_encoded(path or ranks_path(), pattern, with_ids), schema)
    return done.select(*(F.col("row").getField(c).alias(c) for c in named), *results)


def _decoded(path: str, pattern: str | None):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, machine, _ = _tools(path, pattern)
        for batch in batches:
            texts, errors = [], []
            for i in range(len(batch)):
                ids = batch.column("ids")[i]
                if ids.as_py() is None:
                    texts.append(None)
                    errors.append(None)
                    continue
                ids = ids.values.to_numpy(zero_copy_only=False)
                decoder, out = StreamDecoder(machine), []
                for a in range(0, len(ids), CHUNK):
                    out.append(decoder.feed(ids[a:a + CHUNK]))
                out.append(decoder.finish())
                texts.append(b"".join(out).decode("utf-8", "replace"))
                errors.append(decoder.errors)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["row", "text", "errors"])
    return decoded


def decode(encoded: DataFrame, ids_column: str = "token_ids", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Each row of ``encoded`` with the text of its ids in ``text_column``, and ``decode_errors``.

    ``decode_errors`` counts places where the ids' bytes are no UTF-8; each is a replacement character
    in the text.  NULL ids give NULL, no ids the empty text.  Other columns pass through; those
    named like a result column are replaced.
    """
    named = [c for c in encoded.columns if c not in (text_column, "decode_errors")]
    rows = encoded.select(F.struct(*named).alias("row"), F.col(ids_column).alias("ids"))
    schema = rows.select("row").schema.add("text", "string").add("errors", "long")
    done = rows.mapInArrow(_decoded(path or ranks_path(), None), schema)
    return done.select(*(F.col("row").getField(c).alias(c) for c in named), F.col("text").alias(text_column), F.col("errors").alias("decode_errors"))
