"""Decontamination, packing, classifiers, the language model and the pipeline."""
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from odd import PASSAGE, ROWS, empty_table, odd_table, prose, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from soundings.llm import decontaminate, lm, packing, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEMS = [("7", PASSAGE), ("10", "na na"), ("3", None), ("4", "!!"), ("5", prose(2, 50)), ("5", "odd BYTES"), (None, prose(6, 30)), ("11", "日本語")]


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores)) + 1.0
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_contamination(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = rows_of(decontaminate.contamination(odd_table(spark), items, broadcast_words=limit), *HITS)
    assert got == sorted(brute.contamination(ROWS, ITEMS))
    clean = decontaminate.clean_documents(odd_table(spark), items, broadcast_words=limit)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in got if not r[5]} and clean.columns == odd_table(spark).columns
    assert decontaminate.contamination(empty_table(spark), items, broadcast_words=limit).count() == 0
    none = decontaminate.contamination(odd_table(spark), items.limit(0), broadcast_words=limit).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)


@pytest.mark.parametrize("limit", [10**6, 40])
def test_rows_are_judged_by_their_own_text_whatever_the_benchmark(spark, limit):
    """Clean rows that share an id, 7 or NULL, with a contaminated one stay; a NULL item id is not the id "None"."""
    rows = [(7, "clean words only"), (7, PASSAGE), (None, "another clean text"), (None, PASSAGE), (7, None), (8, prose(6, 30)), (9, "")]
    items = [(None, PASSAGE), ("None", PASSAGE), ("a", PASSAGE), ("a", PASSAGE), ("b", None), ("c", prose(6, 30))]
    table = spark.createDataFrame(items * 3, "item_id string, text string")
    got = decontaminate.contamination(odd_table(spark, rows), table, broadcast_words=limit).collect()
    assert sorted((str(r.doc_id), r.n_items, r.contaminated) for r in got) == [
        ("7", 0, False), ("7", 0, False), ("7", 3, True), ("8", 1, True), ("9", 0, False), ("None", 0, False), ("None", 3, True)]
    both = brute.sha(b"None,None,a")
    assert {r.items_sha256 for r in got if r.n_items == 3} == {both}
    clean = decontaminate.clean_documents(odd_table(spark, rows).withColumn("_row", F.lit(1)).withColumn("kept", F.lit("k")), table, broadcast_words=limit).collect()
    want = [(i, t, 1, "k") for i, t in rows if t not in (PASSAGE, prose(6, 30))]
    assert sorted(((r.doc_id, r.text, r["_row"], r.kept) for r in clean), key=str) == sorted(want, key=str)


def test_long_items_are_cut_without_losing_a_window(spark):
    item = prose(11, 900)
    words = item.split(" ")
    rows = [(k, "x y z " + " ".join(words[k:k + 10]) + " q") for k in range(0, 891, 9)] + [(1000, " ".join(words[5:14])), (1001, item)]
    items = spark.createDataFrame([("long", item), ("short", "na ti or")], "item_id string, text string")
    want = brute.contamination(rows, [("long", item), ("short", "na ti or")])
    assert rows_of(decontaminate.contamination(odd_table(spark, rows), items, broadcast_words=200), *HITS) == sorted(want)


def test_counts_beyond_32_bits(spark):
    """A token that occurs five billion times in the corpus keeps its count."""
    import pandas as pd

    value, unit = np.array([77], np.uint64), 3
    rows = pd.DataFrame([{"kind": "counts", "unit": u, "first": 0, "a": value.tobytes(), "b": np.array([2_500_000_000], np.uint32).tobytes(), "c": np.array([1], np.uint8).tobytes()}
                         for u in (unit, 4)], columns=["kind", "unit", "first", *lm._BLOBS])
    told = lm._count(8)((0,), rows)
    counts = told[told["kind"] == "counts"]
    assert [np.frombuffer(a, np.uint64).tolist() for a in counts["a"]] == [[5_000_000_000]] * 2


def test_contamination_of_given_tables(spark):
    docs, items = table(spark, "documents").select("doc_id", "text"), table(spark, "benchmark").select("item_id", "text")
    got = rows_of(decontaminate.contamination(docs, items), *HITS)
    assert got == sorted(brute.contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]))
    assert any(r[5] for r in got)


def pieces_are_whole(rows, docs, length=1024):
    """Every id in one piece, as the tokenizer gives it, and no gap in a sequence."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = defaultdict(list)
    for i, text in docs:
        ids[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in ids.items():
        want = own[0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding < length  # only the very last sequence may be short


def test_packing(spark):
    odd = [*ROWS, (21, "a <|endoftext|> b"), (22, "two  spaces and\n a break "), (23, " leads"), (24, "tab\t \tand   other  spaces")]
    pieces_are_whole(packing.pack(odd_table(spark, odd)).collect(), odd)
    docs = table(spark, "documents").select("doc_id", "text")
    pieces_are_whole(packing.pack(docs.repartition(9)).collect(), [tuple(r) for r in docs.collect()])
    assert packing.pack(empty_table(spark)).count() == 0
    loose = packing.pack(odd_table(spark, [(None, "a"), (1, "b"), (1, "b")])).collect()
    assert len(loose) == 3 and len({r["sequence_id"] for r in loose}) == 1


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    rows = [(i, prose(i, 5 + i)) for i in range(40)]
    pieces_are_whole(packing.pack(odd_table(spark, rows).repartition(12)).collect(), rows)


def test_packer_places_best_fit():
    closed = []
    packer = packing.Packer(closed.append, 10, 2)
    for i, n in enumerate([6, 8, 2, 4, 7]):
        packer.add(i, 0, b"\0\0\0\1" * n, n)
    assert [[p[0] for p in w] for w in closed] == [[1, 2], [0, 3]] and packer.open[0][0] == 7


def test_quality(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    labels = table(spark, "labels").select("doc_id", F.col("quality").alias("label"))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]]["score"], r["label"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert auc(np.array([h[0] for h in held]), np.array([h[1] for h in held])) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    # labels of the held-out fold change nothing
    turned = labels.withColumn("label", F.when(quality.remainder("doc_id", 5) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, turned).collect()}
    assert all(math.isclose(again[i], got[i]["score"], abs_tol=1e-9) for i in again)


def test_quality_edge_cases(spark):
    labels = table(spark, "labels").select("doc_id", F.col("quality").alias("label"))
    odd = odd_table(spark, [*ROWS, (None, "text without an id"), (4, PASSAGE)])
    docs = odd.unionByName(table(spark, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"), allowMissingColumns=True)
    shifted = labels.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(spark.createDataFrame([(4, None), (5, 7)], "doc_id long, label int"))
    got = quality.quality_scores(docs, shifted).filter("doc_id < 1000 or doc_id is null").collect()
    assert len(got) == len(ROWS) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(empty_table(spark), labels).count() == 0
    none = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.good_documents(docs, shifted).columns == docs.columns


def test_discriminant_is_the_gaussian_difference():
    random = np.random.default_rng(2)
    d = len(quality.FEATURES)
    a, b = random.normal(0, 1, (400, d)), random.normal(1, 2, (300, d))
    moments = {0: (400.0, a.sum(axis=0), a.T @ a), 1: (300.0, b.sum(axis=0), b.T @ b)}
    model = quality.Discriminant(moments, 0.2)
    z = np.clip((np.r_[a, b] - model.mean) / model.scale, -quality.CLIP, quality.CLIP)
    want = []
    for label, own in ((0, a), (1, b)):
        s = (own - model.mean) / model.scale
        c = np.cov(s.T, bias=True)
        c = 0.8 * c + 0.2 * np.trace(c) / d * np.eye(d)
        gap = z - s.mean(axis=0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) + np.linalg.slogdet(c)[1]) + math.log(len(own) / 700))
    assert np.allclose(model.score(np.r_[a, b]), 1 / (1 + np.exp(want[0] - want[1])), atol=1e-8)


INSULTS = ["grumblox", "snarfel", "wretchin"]


def insulted(seed):
    words = prose(seed, 30).split()
    if seed % 3 == 0:
        words.insert(seed % 20, INSULTS[seed // 3 % 3] + ".")
    return " ".join(words)


def test_toxicity_tolerates_gaps(spark):
    docs = odd_table(spark, [(i, insulted(i)) for i in range(300)] + [
        (1000, prose(900, 20) + " g r u m b l o x " + prose(901, 5)), (1001, "snar-fel " + prose(902, 20)), (1002, "wrettchin " + prose(903, 20)),
        (1003, prose(904, 20)), (1004, None), (1005, ""), (None, "snarfel")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, label int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels, quality.remainder("doc_id", 4) == 2).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["predicted"] == (i % 3 == 0) and got[i]["held_out"] for i in held)
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 1]


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(4, 0), (9, 0), (4, 0), (None, 1)], "doc_id long, label int")
    one_kind = toxicity.toxicity_scores(odd_table(spark), labels, F.lit(False)).collect()
    assert len(one_kind) == len(ROWS) and len({r["score"] for r in one_kind}) == 1
    assert toxicity.toxicity_scores(empty_table(spark), labels, F.lit(False)).count() == 0


def test_subsequence_kernel_against_its_definition():
    def count(word):
        c = Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    c[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return c

    def alike(a, b):
        a, b = count(a), count(b)
        return sum(a[x] * b[x] for x in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    landmarks, words = ["banana", "rustle"], ["banana", "bananna", "rxustle", "tropic", "ban"]
    numbers, rows = toxicity.Kernel(landmarks).of(words)
    for n, row in zip(numbers, rows):
        assert np.allclose(row, [alike(words[n], x) for x in landmarks], atol=1e-6)
    assert set(numbers) == {i for i, w in enumerate(words) if any(alike(w, x) > 0 for x in landmarks)}


def test_language_model(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, quality.remainder("doc_id", 7) == 2, unit_tokens=60_000).collect()}
    counts = Counter()
    for i, t in rows:
        if brute.crc(i) % 7 != 2:
            counts.update(lm.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words, r = lm.tokens((t or "").encode()), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(counts[w] > 0 for w in words), n, brute.crc(i) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_language_model_edge_cases(spark):
    rows = [*ROWS, (None, "a b"), (4, PASSAGE)]
    got = lm.lm_scores(odd_table(spark, rows), quality.remainder("doc_id", 7) == 2, unit_tokens=500).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 6)} == {1}
    unlearned = lm.lm_scores(odd_table(spark), F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in unlearned} == {(0, 0, 0.0)}
    assert lm.lm_scores(empty_table(spark), F.lit(False)).count() == 0


def test_model_probabilities_sum_to_one():
    model = lm.LogBilinear(20, np.full(20, 0.05), 8)
    symbols = np.random.default_rng(0).integers(0, 20, 3000)
    last, before = lm.contexts(symbols, np.array([1000, 2000]), 0)
    model.train(last, before, symbols, np.random.default_rng(1), batch=256)
    for c1, c2 in ((0, 0), (3, 17)):
        total = np.exp(model.log_probabilities(np.full(20, c1), np.full(20, c2), np.arange(20))).sum()
        assert math.isclose(total, 1, rel_tol=1e-5)
    assert last[0] == before[0] == before[1] == last[1000] == before[1001] == 0 and last[1] == symbols[0] and before[1002] == symbols[1000]


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], FOLDER).collect(), docs.schema))
        assert steps[-1].columns == docs.columns
    rows = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in steps]
    assert len(rows[0]) > len(rows[1]) > len(rows[2]) >= len(rows[3]) > len(rows[4]) > 0
    assert {r[0] for r in rows[2]} == {r[0] for r in brute.exact_dedup(rows[1]) if r[3]}
    assert {r[0] for r in rows[3]} == {i for i, _, c in brute.simhash(rows[2]) if i == c}
    items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    assert {r[0] for r in rows[4]} == {r[0] for r in brute.contamination(rows[3], items) if not r[5]}
    pieces_are_whole(corpus_pipeline.STAGES[-1][1](spark, steps[-1], FOLDER).collect(), rows[4])
    final = corpus_pipeline.run(spark, FOLDER).collect()
    pieces_are_whole(final, rows[4])


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        if docs.columns[0] == "doc_id" and "text" in docs.columns:
            docs = spark.createDataFrame([], docs.schema)
