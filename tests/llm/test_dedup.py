"""Exact, substring, suffix, line and near dedup against plain versions."""
import brute
import numpy as np
import pytest
from odd import PASSAGE, ROWS, empty_table, odd_table, prose, rows_of

from soundings.llm import components, exact_dedup, line_dedup, marks, simhash, substring_dedup, suffix_dedup

EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
SUBSTRING = ["doc_id", "n_words", "n_removed", "kept_sha256"]
SUFFIX = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
LINES = ["doc_id", "class_id", "n_lines", "n_removed", "n_links", "kept_sha256"]
NEAR = ["doc_id", "fingerprint", "component_id"]


@pytest.fixture(scope="module")
def odd(spark):
    return odd_table(spark)


def documents(spark, sf="0.001"):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    return df, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("operator, columns, plain", [
    (exact_dedup.exact_dedup, EXACT, brute.exact_dedup), (substring_dedup.substring_dedup, SUBSTRING, brute.substring_dedup),
    (suffix_dedup.suffix_dedup, SUFFIX, brute.suffix_dedup), (line_dedup.line_dedup, LINES, brute.line_dedup),
    (simhash.near_duplicates, NEAR, brute.simhash)])
def test_against_plain_version(spark, odd, operator, columns, plain):
    assert rows_of(operator(odd), *columns) == sorted(plain(ROWS))
    df, rows = documents(spark)
    assert rows_of(operator(df), *columns) == sorted(plain(rows))
    none = operator(empty_table(spark))
    assert none.count() == 0 and set(columns) <= set(none.columns)


@pytest.mark.parametrize("operator, columns", [
    (exact_dedup.exact_dedup, EXACT), (substring_dedup.substring_dedup, SUBSTRING), (suffix_dedup.suffix_dedup, SUFFIX),
    (line_dedup.line_dedup, LINES), (simhash.near_duplicates, NEAR)])
def test_null_and_repeated_ids(spark, operator, columns):
    rows = [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (None, None), (1, "other text")]
    got = operator(odd_table(spark, rows)).select(*columns).collect()
    assert len(got) == len(rows)
    assert sum(r["doc_id"] is None for r in got) == 2


def test_exact_ties_and_nulls(spark):
    got = rows_of(exact_dedup.exact_dedup(odd_table(spark, [(5, "a  b"), (2, "a b"), (None, "a\tb"), (2, "a b")])), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(2, 2, 4, True), (2, 2, 4, True), (5, 2, 4, False), (None, 2, 4, False)]


def test_kept_documents_have_the_same_columns(spark, odd):
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in brute.exact_dedup(ROWS) if r[3]}


def test_quotient_filter_loses_nothing():
    random = np.random.default_rng(3)
    whole = random.integers(0, 1 << 63, 5000, dtype=np.uint64)
    parts = [random.choice(whole, 2000) for _ in range(5)] + [np.empty(0, np.uint64), np.array([0, 2 ** 64 - 1, 0], np.uint64)]
    merged = exact_dedup.QuotientFilter.merge([exact_dedup.QuotientFilter(p) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
    sliced = list(merged.slices(6))
    assert np.concatenate([s[1] for s in sliced]).tolist() == values.tolist() and [s[0] for s in sliced] == sorted({int(v) >> 58 for v in values})


def test_substring_texts_and_factors(spark):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(odd_table(spark, [(1, "x " + PASSAGE), (2, PASSAGE + " y"), (3, "z")])).collect()}
    assert got[1]["kept_text"] == "x" and got[2]["kept_text"] == "y" and got[3]["kept_text"] == "z"
    assert got[1]["n_factors"] == got[2]["n_factors"] == 1
    assert substring_dedup.factors(np.array([3, 4, 5, 9]), 35).tolist() == [[3, 37], [9, 35]]


def test_suffix_keeps_the_first_and_its_bytes(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(odd_table(spark, [(7, "a" + PASSAGE), (3, PASSAGE + "b"), (None, PASSAGE)])).collect()}
    assert bytes(got[3]["kept"]) == (PASSAGE + "b").encode() and bytes(got[7]["kept"]) == b"a" and got[None]["n_removed"] == 0


@pytest.mark.parametrize("crowded", [1, 3, 10_000])
def test_crowded_anchors_give_the_same(spark, crowded):
    rows = [(i, prose(100 + i, 3) + " " + PASSAGE + " " + prose(200 + i, 3)) for i in range(12)]
    got = rows_of(suffix_dedup.suffix_dedup(odd_table(spark, rows), crowded=crowded), *SUFFIX)
    assert got == sorted(brute.suffix_dedup(rows))


def test_other_window_sizes(spark):
    rows = [(i, t) for i, t in ROWS]
    assert rows_of(substring_dedup.substring_dedup(odd_table(spark, rows), 8, 3), *SUBSTRING) == sorted(brute.substring_dedup(rows, 8))
    assert rows_of(suffix_dedup.suffix_dedup(odd_table(spark, rows), 21, 9), *SUFFIX) == sorted(brute.suffix_dedup(rows, 21))


def test_sliding_minimum_and_anchors():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 7, 200):
        least, places = marks.anchors(x, width)
        wanted = [min(x[i:i + width]) for i in range(len(x) - width + 1)]
        assert least.tolist() == wanted
        assert places.tolist() == [p for p in range(len(x)) if any(x[p] == wanted[i] for i in range(max(0, p - width + 1), min(p, len(wanted) - 1) + 1))]
    assert len(marks.sliding_min(x, 201)) == 0


def test_fingerprint_segments_find_every_close_pair():
    random = np.random.default_rng(5)
    for _ in range(300):
        a = random.integers(0, 1 << 63, dtype=np.uint64)
        flips = random.choice(64, 4, replace=False)
        b = a ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        keys = simhash.keys_of(np.array([a, b]))
        assert set(keys[0]) & set(keys[1])


@pytest.mark.parametrize("block", [2, 8, 4096])
def test_crowded_fingerprint_keys(spark, block):
    random = np.random.default_rng(6)
    base = random.integers(0, 1 << 63, 2, dtype=np.uint64)
    prints = {int(base[0])}
    for _ in range(60):  # a dense group, and a chain
        prints.add(int(base[0] ^ np.bitwise_or.reduce(np.uint64(1) << random.choice(12, 2).astype(np.uint64))))
    chain = int(base[1])
    for bit in range(0, 40, 4):
        prints.add(chain)
        chain ^= 0b1111 << bit
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long").repartition(2)
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df, block=block)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = {p: p for p in signed}
    for _ in signed:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[signed[i]] = root[signed[j]] = min(root[signed[i]], root[signed[j]])
    assert {p: found.get(p, p) for p in signed} == root


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_first_documents(spark, odd):
    kept = simhash.first_documents(odd, 4)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in brute.simhash(ROWS) if i == c}


@pytest.mark.parametrize("block", [2, 2048])
def test_crowded_line_words(spark, block):
    rows = [(i, f"the same rare words stand in every line but one {i % 7} {'x' if i % 3 else 'y'} {i % 5}") for i in range(40)]
    assert rows_of(line_dedup.line_dedup(odd_table(spark, rows), block=block), *LINES) == sorted(brute.line_dedup(rows))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_line_similarities(spark, similarity):
    rows = [(i, "\n".join(prose(i * 7 + k, 4) for k in range(4)) + "\nba ne ti or lu bane tior " + prose(i, 2)) for i in range(30)]
    assert rows_of(line_dedup.line_dedup(odd_table(spark, rows), similarity), *LINES) == sorted(brute.line_dedup(rows, similarity))
