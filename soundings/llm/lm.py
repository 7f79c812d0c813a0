"""Scores of a log-bilinear language model trained by noise-contrastive estimation.

Tokens are numbered per unit of documents and counted in blocks over all documents, as the
base score needs every count.  The model predicts symbols: the most frequent tokens have one each,
the others share one for each class of word endings, and within a class a token has its
add-one share of the class's count.  So each next token, known or not, has a normalised probability.

The representation predicted from the two symbols before is ``q = u[c1] A + u[c2] B``, and a symbol's
score is ``q . r + b``.  Training goes over all training tokens of all documents: in each round
every task runs minibatches over its own tokens against a shared draw of noise symbols, and
the parameters are averaged, weighted by tokens.  Normalised scores come from matrix
products of batches of distinct contexts with all symbols.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from soundings.llm.marks import block_of, blocks_for, own_block, release
from soundings.llm.text import WordHashes
from soundings.session import cut_lineage

FREQUENT = 512
CLASSES = 128
DIMENSIONS = 32
ROUNDS = 3
BATCH = 2048
NOISE = 512
RATE = 0.15
FIRST_SQUARE = 1e-4
UNIT_TOKENS = 1 << 19
#: Units of a task are trained on together up to this many tokens: the more, the more often contexts are equal.
TRAINED = 1 << 20
SLOT = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b""  # no word is empty

_BLOBS = ("a", "b", "c", "d", "e")
SENT = "block int, unit long, first long, " + ", ".join(f"{c} binary" for c in _BLOBS)
COUNTED = "kind string, unit long, first long, " + ", ".join(f"{c} binary" for c in _BLOBS)


def tokens(text: bytes) -> list[bytes]:
    words = text.translate(_LOWER).split()
    words.append(END)
    return words


class Numbers(dict):
    """Tokens numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Unit:
    def __init__(self, number: int):
        self.number, self.numbers, self.size = number, Numbers(), 0
        self.tokens, self.sizes, self.ids, self.held = [], [], [], []

    def add(self, doc_id, text: bytes, held: bool) -> None:
        words = tokens(text)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.sizes.append(len(words))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words)

    def rows(self, blocks: int, known: WordHashes, classes: int) -> Iterator[dict]:
        if not self.ids:
            return
        whole = np.concatenate(self.tokens)
        words = list(self.numbers)
        hashes = known.of(words)
        kinds = np.fromiter((hash_of_ending(w) % classes for w in words), np.uint8, len(words))
        learned = np.repeat(~np.array(self.held), self.sizes)
        counts = np.bincount(whole[learned], minlength=len(words)).astype(np.uint32)
        block = block_of(hashes, blocks).astype(np.int64)
        order = np.argsort(block, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        flags = np.array([(i is None) + 2 * h for i, h in zip(self.ids, self.held)], np.uint8)
        yield {"block": own_block(self.number), "unit": self.number, "first": len(words), "a": place[whole].tobytes(), "b": kinds[order].tobytes(),
               "c": ids.tobytes(), "d": np.array(self.sizes, np.uint32).tobytes(), "e": flags.tobytes()}
        block = block[order]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            own = order[a:b]
            yield {"block": int(block[a]), "unit": self.number, "first": a, "a": hashes[own].tobytes(), "b": counts[own].tobytes(),
                   "c": kinds[own].tobytes(), "d": None, "e": None}


def hash_of_ending(word: bytes) -> int:
    """A number of the word's last two bytes; the end token and one-byte words have their own."""
    return int.from_bytes(word[-2:], "big") * 40503 >> 8


def _send(blocks: int, classes: int, unit_tokens: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("unit", pa.int64()), ("first", pa.int64()), *((c, pa.binary()) for c in _BLOBS)])
        task, made, known = TaskContext.get().partitionId(), 0, WordHashes()
        unit = _Unit(task << 24)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for doc_id, text, held in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("held_out").to_pylist()):
                    unit.add(doc_id, text or b"", held)
                    if unit.size >= unit_tokens:
                        yield pa.RecordBatch.from_pylist(list(unit.rows(blocks, known, classes)), schema)
                        made += 1
                        unit = _Unit(task << 24 | made)
        yield pa.RecordBatch.from_pylist(list(unit.rows(blocks, known, classes)), schema)
    return send


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "unit", "first", *_BLOBS]).astype({"unit": "Int64", "first": "Int64"})


def _count(frequent: int):
    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Counts of a block's tokens, told to every unit, with what the whole corpus needs of them."""
        if key[0] < 0:
            return _frame([{"kind": "unit", **{c: r[c] for c in ("unit", "first", *_BLOBS)}} for r in rows.to_dict("records")])
        values = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["a"]])
        counts = np.concatenate([np.frombuffer(v, np.uint32) for v in rows["b"]]).astype(np.int64)
        kinds = np.concatenate([np.frombuffer(v, np.uint8) for v in rows["c"]])
        distinct, first, at = np.unique(values, return_index=True, return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        kinds = kinds[first]
        out, seen = [], total > 0
        sums = np.stack([np.bincount(kinds[seen], total[seen], 256), np.bincount(kinds[seen], minlength=256)])
        top = np.lexsort((distinct, -total))[:frequent]
        top = top[total[top] > 0]
        out.append({"kind": "block", "unit": int(key[0]), "a": distinct[top].tobytes(), "b": total[top].tobytes(), "c": kinds[top].tobytes(), "d": sums.tobytes()})
        marked = np.zeros(len(distinct), bool)
        marked[top] = True
        start = 0
        for unit, begin, own in zip(rows["unit"], rows["first"], rows["a"]):
            mine = at[start:start + len(own) // 8]
            start += len(mine)
            spots = np.flatnonzero(marked[mine])
            out.append({"kind": "counts", "unit": unit, "first": begin, "a": total[mine].astype(np.uint64).tobytes(),
                        "b": spots.astype(np.uint32).tobytes(), "c": distinct[mine[spots]].tobytes()})
        return _frame(out)
    return count


def _most(frequent: int):
    def most(key, rows: pd.DataFrame) -> pd.DataFrame:
        """The most frequent tokens of several blocks, and their classes' counts, as one row."""
        hashes, counts, kinds = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.uint8)))
        top = np.lexsort((hashes, -counts))[:frequent]
        sums = np.sum([np.frombuffer(x, np.float64) for x in rows["d"]], axis=0)
        return pd.DataFrame({"a": [hashes[top].tobytes()], "b": [counts[top].tobytes()], "c": [kinds[top].tobytes()], "d": [sums.tobytes()]})
    return most


class Corpus:
    """Counts of the training tokens: N, V, the frequent tokens' symbols and the classes' shares."""

    def __init__(self, tokens: list[tuple[int, float, int]], classes: list[tuple[int, float, int]], n_classes: int):
        """``tokens``: hash, count and class of the frequent; ``classes``: class, count, distinct tokens."""
        self.symbols = {h % (1 << 64): i for i, (h, _, _) in enumerate(tokens)}
        self.n = int(sum(c for _, c, _ in classes))
        self.v = int(sum(v for _, _, v in classes))
        share = np.ones(n_classes)  # a token never seen has one place in its class
        mass = np.zeros(n_classes)
        for kind, count, words in classes:
            share[kind] += count + words
            mass[kind] += count
        for _, count, kind in tokens:
            share[kind] -= count + 1
            mass[kind] -= count
        self.class_size = share
        counts = np.r_[[c for _, c, _ in tokens], mass] + 0.5
        self.noise = counts / counts.sum()
        self.frequent = len(tokens)


def _number(corpus):
    def number(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Tokens of a unit as symbols, and per document what needs no model."""
        own = corpus.value
        about = rows[rows["kind"] == "unit"].iloc[0]
        counts, symbols = np.zeros(int(about["first"]), np.int64), np.frombuffer(about["b"], np.uint8).astype(np.int64) + own.frequent
        for begin, told, spots, hashes in rows.loc[rows["kind"] == "counts", ["first", "a", "b", "c"]].itertuples(index=False):
            told = np.frombuffer(told, np.uint64)
            counts[begin:begin + len(told)] = told
            for spot, h in zip(np.frombuffer(spots, np.uint32).tolist(), np.frombuffer(hashes, np.uint64).tolist()):
                symbol = own.symbols.get(h)
                if symbol is not None:
                    symbols[begin + spot] = symbol
        rare = symbols >= own.frequent
        fixed = np.where(rare, np.log10((counts + 1) / own.class_size[np.where(rare, symbols - own.frequent, 0)]), 0.0)
        base = np.log10((counts + 1) / (own.n + own.v + 1))
        at = np.frombuffer(about["a"], np.uint32)
        sizes = np.frombuffer(about["d"], np.uint32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        sums = [np.add.reduceat(x[at], starts).astype(np.float64).tobytes() for x in (fixed, base, (counts > 0).astype(np.int64))]
        return pd.DataFrame({"unit": [about["unit"]], "symbols": [symbols[at].astype(np.uint16).tobytes()], "sizes": [about["d"]], "ids": [about["c"]],
                             "flags": [about["e"]], "fixed": [sums[0]], "base": [sums[1]], "known": [sums[2]]})
    return number


class LogBilinear:
    """Parameters and their use; symbols are whole numbers below ``n``."""

    def __init__(self, n: int, noise: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.n, self.noise = n, noise
        self.parts = {
            "context": random.normal(0, 0.1, (n, dimensions)), "target": random.normal(0, 0.1, (n, dimensions)),
            "last": np.eye(dimensions), "before": 0.5 * np.eye(dimensions), "bias": np.log(noise)}
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}
        # squared gradients so far; the first steps are small, and stay so from unit to unit
        self.squares = {k: np.full_like(v, FIRST_SQUARE) for k, v in self.parts.items()}
        self._norms = None

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, vector: np.ndarray) -> LogBilinear:
        at = 0
        for name, part in self.parts.items():
            self.parts[name] = vector[at:at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
        self._norms = None
        return self

    def predicted(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.parts["context"][last] @ self.parts["last"] + self.parts["context"][before] @ self.parts["before"]

    def train(self, last: np.ndarray, before: np.ndarray, target: np.ndarray, random: np.random.Generator,
              batch: int = BATCH, noise: int = NOISE, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation with adaptive step sizes.

        Tokens after equal contexts stand together, each target with its count, and the noise of a context is
        weighed by its tokens: the loss is that of single tokens.  A batch has whole contexts, drawn at random, of
        about ``batch`` tokens; their scores, and slopes of the loss in them, are matrices of contexts by symbols.
        """
        p, squares = self.parts, self.squares
        offset = np.log(noise * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        context, tokens, sizes, w, count = _weighted(last, before, target, self.n, random)
        number = (np.cumsum(tokens, dtype=np.int64) - 1) // batch
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        rows = np.r_[0, np.cumsum(sizes)]
        for a, b in zip(cuts, np.r_[cuts[1:], len(context)].astype(np.int64)):
            c1, c2 = np.divmod(context[a:b], self.n)
            own, each = slice(rows[a], rows[b]), np.repeat(np.arange(b - a), sizes[a:b])
            drawn = np.minimum(np.searchsorted(cumulative, random.random(noise) * cumulative[-1]), self.n - 1)
            times = np.bincount(drawn, minlength=self.n).astype(np.float32)
            drawn = np.flatnonzero(times)
            u1, u2 = p["context"][c1], p["context"][c2]
            q = u1 @ p["last"] + u2 @ p["before"]
            scores = q @ p["target"].T + (p["bias"] - offset)
            slopes = np.zeros_like(scores)
            slopes[:, drawn] = _logistic(scores[:, drawn]) * (tokens[a:b, None] * times[drawn])
            slopes[each, w[own]] += (_logistic(scores[each, w[own]]) - 1) * count[own]  # targets of a context are distinct
            gq = slopes @ p["target"]
            grads = {"context": np.zeros_like(p["context"]), "target": slopes.T @ q, "last": u1.T @ gq, "before": u2.T @ gq, "bias": slopes.sum(axis=0)}
            _scatter(grads["context"], np.r_[c1, c2], np.concatenate([gq @ p["last"].T, gq @ p["before"].T]))
            size = tokens[a:b].sum()
            for name, grad in grads.items():
                grad /= size
                squares[name] += grad * grad
                p[name] -= rate * grad / np.sqrt(squares[name])
        self._norms = None

    def norms(self) -> np.ndarray:
        """Log normalisers of all contexts, a row for each last symbol: products of batches of contexts with all symbols."""
        if self._norms is None:
            self._norms = np.empty((self.n, self.n), np.float32)
            every = np.arange(self.n)
            for last in range(self.n):
                scores = self.predicted(np.full(self.n, last), every) @ self.parts["target"].T + self.parts["bias"]
                most = scores.max(axis=1)
                self._norms[last] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
        return self._norms

    def log_probabilities(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all symbols."""
        norms = self.norms()
        out = np.empty(len(target))
        for a in range(0, len(target), 1 << 16):
            c1, c2, w = last[a:a + (1 << 16)], before[a:a + (1 << 16)], target[a:a + (1 << 16)]
            out[a:a + (1 << 16)] = (self.predicted(c1, c2) * self.parts["target"][w]).sum(axis=1) + self.parts["bias"][w] - norms[c1, c2]
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _weighted(last: np.ndarray, before: np.ndarray, target: np.ndarray, n: int, random: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Distinct contexts in random order, their tokens and numbers of targets; targets and counts, context by context."""
    distinct, count = np.unique((last * n + before) * n + target, return_counts=True)
    if not len(distinct):
        return distinct, count, count, distinct, count
    context = distinct // n
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    order = random.permutation(len(first))
    sizes = np.diff(np.r_[first, len(context)])[order]
    rows = np.arange(len(context)) + np.repeat(first[order] - np.cumsum(sizes) + sizes, sizes)
    return context[first[order]], np.add.reduceat(count, first)[order].astype(np.float32), sizes, distinct[rows] % n, count[rows].astype(np.float32)


def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` to rows of ``out`` that may repeat."""
    order = np.argsort(rows.astype(np.uint16) if len(out) <= 1 << 16 else rows, kind="stable")  # short numbers sort faster
    ordered = rows[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out[ordered[first]] += np.add.reduceat(values[order], first, axis=0)


def contexts(symbols: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each; before a document's beginning stands ``end``."""
    last, before = np.r_[end, symbols[:-1]], np.r_[end, end, symbols[:-2]][:len(symbols)]
    starts = np.cumsum(sizes) - sizes
    last[starts] = before[starts] = end
    second = starts[sizes > 1] + 1
    before[second] = end
    return last, before


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
    return get("symbols", np.uint16).astype(np.int64), get("sizes", np.uint32).astype(np.int64), get("flags", np.uint8)


def _train(state, end: int, turn: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, noise, vector, shape = state.value
        model, seen, held, size = LogBilinear(n, noise, shape).load(vector), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, sizes, flags = _unpack(batch, i)
                use = np.repeat(flags < 2, sizes)
                held.append([x[use] for x in (*contexts(symbols, sizes, end), symbols)])
                size += int(use.sum())
                if size >= TRAINED:
                    model.train(*map(np.concatenate, zip(*held)), np.random.default_rng([turn, batch.column("unit")[i].as_py()]))
                    seen, held, size = seen + size, [], 0
        if size:
            model.train(*map(np.concatenate, zip(*held)), np.random.default_rng([turn, TaskContext.get().partitionId()]))
            seen += size
        if seen:
            whole = model.vector().astype(np.float64) * seen
            parts = [whole[a:a + SLOT].tobytes() for a in range(0, len(whole), SLOT)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * n, pa.int32()),
                 pa.array([float(seen)] * n, pa.float64()), pa.array(parts, pa.binary())], ["slot", "part", "weight", "sums"])
    return train


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s, np.float64) for s in rows["sums"]], axis=0)
    return pd.DataFrame({"slot": rows["slot"][:1], "part": rows["part"][:1], "weight": [rows["weight"].sum()], "sums": [total.tobytes()]})


def _score(state, end: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, sizes, flags = _unpack(batch, i)
                last, before = contexts(symbols, sizes, end)
                each = model.log_probabilities(last, before, symbols) / np.log(10)
                fixed, base, known = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in ("fixed", "base", "known"))
                sums = np.add.reduceat(each, np.cumsum(sizes) - sizes) + fixed
                ids = pa.array(np.frombuffer(batch.column("ids")[i].as_py(), np.int64), mask=flags % 2 == 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(flags >= 2), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(sums)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return score


def _nothing(docs: DataFrame) -> DataFrame:
    long, double = F.lit(0).cast("long"), F.lit(0.0)
    return docs.limit(0).select("doc_id", "held_out", long.alias("n_tokens"), long.alias("n_known"), long.alias("train_tokens"), double.alias("base_score"), double.alias("score"))


def lm_scores(docs: DataFrame, held_out, frequent: int = FREQUENT, classes: int = CLASSES, dimensions: int = DIMENSIONS,
              rounds: int = ROUNDS, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``held_out`` is a boolean column expression of doc_id; its rows are scored but not learned from.
    A NULL text is empty and has the end token alone.  NULL and repeated ids are
    documents like any other.  Without training documents all counts are zero.
    """
    if not 0 < classes <= 256:
        raise ValueError("classes are numbered in one byte")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sc = docs.sparkSession.sparkContext
    counted = cut_lineage(
        docs.mapInArrow(_send(blocks_for(docs), classes, unit_tokens), SENT).groupBy("block").applyInPandas(_count(frequent), COUNTED))
    release(docs.sparkSession)
    blobs = "a binary, b binary, c binary, d binary"
    merged = (counted.filter("kind = 'block'").withColumn("part", F.col("unit") % 16).groupBy("part").applyInPandas(_most(frequent), blobs)
              .groupBy().applyInPandas(_most(frequent), blobs)).first()  # of each block and part at most ``frequent`` tokens
    if merged is None:
        return _nothing(docs)
    hashes, counts, kinds = (np.frombuffer(merged[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.uint8)))
    amounts, words = np.frombuffer(merged["d"], np.float64).reshape(2, -1)
    corpus = Corpus(list(zip(hashes.tolist(), counts.tolist(), kinds.tolist())),
                    [(k, amounts[k], words[k]) for k in np.flatnonzero(words).tolist()], classes)
    end = corpus.symbols.get(int(WordHashes().of([END])[0]), 0)
    numbered = cut_lineage(counted.filter("kind in ('unit', 'counts')").groupBy("unit").applyInPandas(
        _number(sc.broadcast(corpus)),
        "unit long, symbols binary, sizes binary, ids binary, flags binary, fixed binary, base binary, known binary"))
    del counted
    release(docs.sparkSession)
    n = corpus.frequent + classes
    vector = LogBilinear(n, corpus.noise, dimensions).vector()
    for turn in range(rounds):
        state = sc.broadcast((n, corpus.noise, vector, dimensions))
        sums = (numbered.select("unit", "symbols", "sizes", "flags").mapInArrow(_train(state, end, turn), "slot int, part int, weight double, sums binary")
                .groupBy("slot", "part").applyInPandas(_add, "slot int, part int, weight double, sums binary")
                .groupBy("slot").applyInPandas(_add, "slot int, part int, weight double, sums binary"))
        got = {r["slot"]: np.frombuffer(r["sums"], np.float64) / r["weight"] for r in sums.collect()}  # the parameters, once
        if got:
            vector = np.concatenate([got[i] for i in sorted(got)])
    model = LogBilinear(n, corpus.noise, dimensions).load(vector)
    model.norms()  # once, as its size is the model's
    state = sc.broadcast(model)
    return numbered.mapInArrow(
        _score(state, end), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "score")
