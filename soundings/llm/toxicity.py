"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, each weighted by a
decay for every letter it spans, so letters inserted into an insult or a changed ending lower
its likeness to the known form but do not end it.  Landmarks are words that mark toxic
training documents, unlike each other.  A sentence is described by its best likeness to each
landmark, mapped by the inverse root of the landmarks' own kernel (Nyström); a linear
machine with squared hinge loss separates sentences, and a document is as toxic as its
worst sentence.

Only documents are labelled.  A clean document's sentences are all clean; of a toxic
document those that are nearly a landmark take its label, or else the one most like one.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from soundings.llm.text import text_runs
from soundings.session import cut_lineage

LANDMARKS = 96
DECAY = 0.9
#: Likenesses are raised to this power, which a kernel may be; it parts near forms from chance likeness.
POWER = 3
SPAN = 6
#: Likenesses below this count as none.
ALIKE = 0.35
#: A toxic document's sentences this much like a landmark are toxic.
CERTAIN = 0.65
#: Landmarks are no more alike than this.
APART = 0.7
#: Most labelled documents that landmarks and machine are fitted on, the first by a hash of the id.
SAMPLE = 20_000
#: Least likelihood ratio of a landmark's document counts.
EVIDENCE = 15.0
#: Candidates for landmarks, and most sentences of one document that the machine is fitted on.
CANDIDATES, FITTED = 400, 64
SENTENCE_WORDS = 64
THRESHOLD = 0.3
REMEMBERED = 300_000

_JOINTS = re.compile(r"[^\w\n]+|_+")


def plain(words: list[str]) -> list[str]:
    """Lower-case words with letters and digits only."""
    return _JOINTS.sub("", "\n".join(words).lower()).split("\n") if words else []


def letters(joined: str) -> np.ndarray:
    """Characters as numbers below 64: a-z, digits, and the rest folded into 28 places."""
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((codes >= 97) & (codes <= 122), codes - 97, np.where((codes >= 48) & (codes <= 57), codes - 22, 36 + codes % 28))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words as numbers, each one's word, and whether it only parts two words.

    A word of fewer than three characters is filled up with a place of its own, so that it
    has a subsequence.
    """
    joined = "\n".join(w if len(w) > 2 else w + "\x1f" * (3 - len(w)) for w in words)
    breaks = np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 10
    return letters(joined), np.cumsum(breaks), breaks


def _triples(numbers: np.ndarray, owner: np.ndarray, breaks: np.ndarray, span: int, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first places, subsequences, weight) for each way to take three letters within ``span``."""
    for last in range(2, span):
        n = len(numbers) - last
        if n <= 0:
            break
        at = np.flatnonzero((owner[:n] == owner[last:]) & ~breaks[:n])
        ends = (numbers[at] << 12) | numbers[at + last]
        for middle in range(1, last):
            yield at, ends | (numbers[at + middle] << 6), decay ** (last + 1)


def subsequences(words: list[str], span: int = SPAN, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all three-letter subsequences within ``span`` letters, summed."""
    numbers, owner, breaks = _characters(words)
    keys, weights = [], []
    for at, code, weight in _triples(numbers, owner, breaks, span, decay):
        keys.append((owner[at] << 18) | code)
        weights.append(np.full(len(at), weight))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct >> 18, distinct & ((1 << 18) - 1), np.bincount(inverse, np.concatenate(weights))


class Kernel:
    """Likeness of words to landmarks: the normalised subsequence kernel."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        owner, code, weight = subsequences(landmarks)
        norms = np.sqrt(np.bincount(owner, weight ** 2, len(landmarks)))
        self.codes, column = np.unique(code, return_inverse=True)
        self.column = np.full(1 << 18, -1, np.int32)
        self.column[self.codes] = np.arange(len(self.codes))
        values = (weight / norms[owner]).astype(np.float32)
        self.most = np.zeros(len(self.codes), np.float32)
        np.maximum.at(self.most, column, values)
        # the landmarks of each subsequence stand side by side: a few of all
        order = np.argsort(column, kind="stable")
        self.holder, self.share = owner[order], values[order]
        self.width = np.bincount(column, minlength=len(self.codes))
        self.start = np.cumsum(self.width) - self.width

    def able(self, words: list[str], least: float) -> np.ndarray:
        """Numbers of the words that may be at least that like a landmark, from subsequences that are not summed yet.

        Sums of positive weights have no smaller squares than the weights, so a word's norm
        is at least that of its single subsequences, which its length tells.
        """
        numbers, owner, breaks = _characters(words)
        lengths = np.bincount(owner[~breaks], minlength=len(words))
        bound, floor = np.zeros(len(words)), np.zeros(len(words))
        for last in range(2, SPAN):
            floor += np.maximum(lengths - last, 0) * (last - 1) * DECAY ** (2 * last + 2)
        for at, code, weight in _triples(numbers, owner, breaks, SPAN, DECAY):
            column = self.column[code]
            hit = np.flatnonzero(column >= 0)
            bound += np.bincount(owner[at[hit]], weight * self.most[column[hit]], len(words))
        return np.flatnonzero((bound > 0) & (bound >= least * np.sqrt(floor) * (1 - 1e-6)))

    def of(self, words: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Words, by number, that may be at least that like a landmark, and their likenesses."""
        able = self.able(words, least)
        numbers, rows = self._of([words[i] for i in able.tolist()], least)
        return able[numbers], rows

    def _of(self, words: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
        owner, code, weight = subsequences(words)
        norms = np.sqrt(np.bincount(owner, weight ** 2, len(words)))
        column = self.column[code]
        hit = column >= 0
        owner, column, weight = owner[hit], column[hit], weight[hit]
        # no landmark can be more alike than the sum of each subsequence's largest share
        bound = np.bincount(owner, weight * self.most[column], len(words))
        able = (bound > 0) & (bound >= least * norms)
        numbers = np.flatnonzero(able)
        use = able[owner]
        owner, column, weight = owner[use], column[use], weight[use]
        if not len(owner):
            return numbers, np.zeros((0, len(self.landmarks)), np.float32)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        word, m = np.cumsum(np.r_[0, owner[1:] != owner[:-1]]), len(self.landmarks)
        out = np.empty((len(first), m), np.float32)
        for a in range(0, len(first), 4096):  # a bounded part of the products at a time
            part = slice(first[a], first[a + 4096] if a + 4096 < len(first) else len(owner))
            n = self.width[column[part]]
            entry = np.repeat(self.start[column[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat((word[part] - a) * m, n) + self.holder[entry]
            rows = min(4096, len(first) - a)
            out[a:a + rows] = np.bincount(place, np.repeat(weight[part], n) * self.share[entry], rows * m).reshape(rows, m)
        out /= norms[numbers][:, None]
        out[out < least] = 0
        alike = out.max(axis=1) > 0
        return numbers[alike], out[alike]


class Sentences:
    """Likenesses of the sentences of texts to the landmarks; words are remembered while there is room."""

    def __init__(self, kernel: Kernel, least: float = ALIKE):
        self.kernel, self.least = kernel, least
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, len(kernel.landmarks)), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:1]
        new = list(words - self.known.keys())
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            clean = plain(part)
            numbers, rows = self.kernel.of(clean, self.least)
            places = np.zeros(len(part), np.int64)
            places[numbers] = len(self.rows) + np.arange(len(numbers))
            self.rows = np.concatenate([self.rows, rows])
            ends = np.fromiter((w[-1] in ".!?" for w in part), np.int64, len(part))
            single = np.fromiter((len(c) == 1 for c in clean), np.int64, len(part))
            self.known.update(zip(part, (places << 2 | single << 1 | ends).tolist()))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its sentences that are like a landmark, a row each."""
        split = [t.split() for t in texts]
        self._learn({w for words in split for w in words})
        return [self._one(words) for words in split]

    def _one(self, words: list[str]) -> np.ndarray:
        if not words:
            return self.rows[:0]
        told = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.flatnonzero(told & 1)

        def sentence(places: np.ndarray) -> np.ndarray:
            number = np.searchsorted(ends, places)
            within = places - np.where(number > 0, ends[number - 1] + 1 if len(ends) else 0, 0)
            return number * (1 + len(words)) + within // SENTENCE_WORDS  # long ones are cut

        at = np.flatnonzero(told >> 2)
        owner, rows = sentence(at), self.rows[told[at] >> 2]
        spelled = (told >> 1) & 1
        if spelled.sum() > 2:  # runs of single letters are read as one word
            edge = np.diff(np.r_[0, spelled, 0])
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            runs = [(b, e) for b, e in zip(begin.tolist(), end.tolist()) if e - b > 2]
            if runs:
                numbers, more = self.kernel.of(["".join(plain(words[b:e])) for b, e in runs], self.least)
                owner = np.r_[owner, sentence(np.array([runs[i][0] for i in numbers], np.int64))]
                rows = np.concatenate([rows, more])
        if not len(owner):
            return self.rows[:0]
        order = np.argsort(owner, kind="stable")
        first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
        return np.maximum.reduceat(rows[order], first, axis=0)


class Machine:
    """Linear machine over Nyström features, with a logistic of the margin fitted to documents."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        m = len(kernel.landmarks)
        self.weights, self.bias, self.slope, self.shift = np.zeros(m), -1.0, 0.0, 0.0
        if m:
            numbers, own = kernel.of(kernel.landmarks)
            values, vectors = np.linalg.eigh(((own + own.T) / 2) ** POWER + 1e-6 * np.eye(m))
            self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows ** POWER @ self.weights + self.bias

    def margin(self, sentences: np.ndarray) -> float:
        """A document's: that of its worst sentence; one without likenesses is an empty sentence."""
        return float(max(self.bias, self.margins(sentences).max())) if len(sentences) else self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))

    def _separate(self, rows: np.ndarray, labels: np.ndarray, penalty: float = 0.5) -> None:
        """Squared hinge loss by Newton steps on the rows inside the margin, classes weighted alike."""
        x = np.c_[rows ** POWER @ self.root, np.ones(len(rows))]
        y = np.where(labels, 1.0, -1.0)
        weight = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum())) * len(labels)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            inside = y * (x @ w) < 1
            a = x[inside] * weight[inside, None]
            new = np.linalg.solve(a.T @ x[inside] + penalty * np.eye(len(w)), a.T @ y[inside])
            if np.allclose(new, w, atol=1e-8):
                break
            w = new
        self.weights, self.bias = self.root @ w[:-1], float(w[-1])

    def _calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Logistic of the margin, by Newton steps with slightly softened labels."""
        n1, n0 = labels.sum(), (~labels).sum()
        t = np.where(labels, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x, w = np.c_[margins, np.ones(len(margins))], np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(w[0]), float(w[1])

    def fit(self, documents: list[tuple[bool, np.ndarray]]) -> Machine:
        """``documents``: label and sentences.  With labels of one kind the score is that kind's."""
        labels = np.array([label for label, _ in documents], bool)
        if not len(labels) or labels.all() or not labels.any() or not self.kernel.landmarks:  # nothing to part
            share = (labels.sum() + 0.5) / (len(labels) + 1)
            self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))
            return self
        none = np.zeros((1, len(self.kernel.landmarks)), np.float32)
        bags = [s if len(s) else none for _, s in documents]
        rows, own = [], []
        for label, bag in zip(labels, bags):
            if label:
                most = bag.max(axis=1)
                bag = bag[most >= min(CERTAIN, most.max())]
            rows.append(bag)
            own.append(np.full(len(bag), label))
        self._separate(np.concatenate(rows), np.concatenate(own))
        self._calibrate(np.array([self.margin(s) for _, s in documents]), labels)
        return self


def choose_landmarks(counts: list[tuple[str, float]], most: int = LANDMARKS, apart: float = APART) -> list[str]:
    """Words in the order given, without those too like one already taken."""
    chosen: list[str] = []
    for word, _ in counts:
        if len(chosen) == most:
            break
        if chosen:
            _, likeness = Kernel(chosen).of([word])
            if len(likeness) and likeness.max() > apart:
                continue
        chosen.append(word)
    return chosen


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each word is."""
    for batch, texts in text_runs(batches):
        counts: dict[str, list[int]] = {}
        for label, text in zip(batch.column("label").to_pylist(), texts):
            for word in set(plain(text.decode().split())):
                if len(word) > 2:
                    counts.setdefault(word, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
             pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "toxic", "clean"])


def _evidence(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Likelihood ratio of a word's document counts against the labels' shares."""
    def term(seen, rate):
        return F.when(seen > 0, seen * F.log(seen / ((toxic + clean) * rate))).otherwise(0.0)
    n = all_toxic + all_clean
    return 2 * (term(toxic, all_toxic / n) + term(clean, all_clean / n))


def _sentences(kernel):
    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Sentences(kernel)
        for batch, texts in text_runs(batches):
            rows = []
            for found in reader.of([t.decode() for t in texts]):
                if len(found) > FITTED:
                    found = found[np.argsort(-found.max(axis=1), kind="stable")[:FITTED]]
                rows.append(found.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "sentences"])
    return sentences


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Machine:
    """Landmarks and machine from at most ``sample`` rows of ``labels`` (doc_id, label 0 or 1)."""
    first = (labels.filter("label in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
             .orderBy(F.xxhash64("_id"), "_id", "label").limit(sample))
    # at most ``sample`` rows of two numbers
    known = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(first), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Machine(Kernel([])).fit([(label == 1, np.zeros((0, 0), np.float32)) for label, n in totals.items() for _ in range(n)])
    counts = (known.mapInArrow(_word_counts, "word string, toxic long, clean long")
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    candidates = (counts.filter("toxic > 1 and toxic > clean")
                  .withColumn("evidence", _evidence(F.col("toxic"), F.col("clean"), totals[1], totals[0]))
                  .filter(F.col("evidence") >= EVIDENCE).orderBy(F.round("evidence", 6).desc(), "word").limit(CANDIDATES).select("word", "evidence"))
    kernel = Kernel(choose_landmarks([tuple(r) for r in candidates.collect()], landmarks))
    m = len(kernel.landmarks)
    rows = known.mapInArrow(_sentences(kernel), "doc_id long, label int, sentences binary").orderBy("doc_id", "label").collect() if m else []
    return Machine(kernel).fit([(r["label"] == 1, np.frombuffer(r["sentences"], np.float32).reshape(-1, m)) for r in rows])


def _score(machine, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.value
        reader = Sentences(own.kernel)
        for batch, texts in text_runs(batches):
            margins = np.array([own.margin(s) for s in reader.of([t.decode() for t in texts])])
            scores = own.score(margins)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])
    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and label (1: toxic); rows for which ``held_out``, a boolean column expression
    of doc_id, holds are never learned from.  NULL and empty texts score like a text without likenesses.  A
    NULL id has no label; rows that repeat an id are scored each.  With labels of one kind, or no
    word that marks toxic documents, every score is the share of toxic labels.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    machine = fit(docs, labels.select("doc_id", "label").filter(~held_out))
    scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine), threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
