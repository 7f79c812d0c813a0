"""Merkle manifest, byte-level BPE and vector codes against plain versions."""
import random
import zlib

import brute
import numpy as np
import pytest
from odd import PASSAGE, ROWS, empty_table, odd_table
from pyspark.sql import functions as F

from soundings.llm import bpe, merkle, product_codes

MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# ------------------------------------------------------------------------------ manifest

def rows_with_trees(n, langs):
    r = random.Random(n)
    rows = [(i, r.choice(["web", None]), r.choice(langs), r.choice([None, 5]), r.choice([None, "", "Text A", "Größe B", PASSAGE])) for i in range(n)]
    return rows + [(None, None, None, None, None), (3, "web", "en", 1, "Same"), (3, "web", "en", 1, "Same"), (None, "x", "en", 2, "Y")]


@pytest.mark.parametrize("n, langs, height", [
    (300, ["en"] * 9 + ["de", None], 1), (75, ["en"], 1), (520, ["en"], 2), (90, [f"l{k}" for k in range(20)] + ["é", "z", None], 1), (9, ["en", "de"], 4)])
def test_manifest_against_plain_version(spark, n, langs, height):
    rows = rows_with_trees(n, langs)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("grp", F.lit("x")).withColumn("root", F.lit("x"))
    got = merkle.manifest(df.repartition(5), altered={"text": merkle.tampered_text()}, height=height)
    assert got.columns == MANIFEST
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.manifest(rows), key=str)


def test_manifest_without_changes_is_verified(spark):
    df = odd_table(spark).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1))
    assert {r["verified"] for r in merkle.manifest(df).collect()} == {True}
    none = merkle.manifest(df.limit(0), altered={"text": merkle.tampered_text()})
    assert none.columns == MANIFEST and none.count() == 0


def test_many_equal_rows_have_a_place_each(spark):
    df = spark.range(700).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.manifest(df, height=1).collect()
    rows = [(None, "s", "en", 1, "t")] * 700
    assert sorted(map(tuple, got), key=str) == sorted(brute.manifest(rows), key=str)


def test_peers_get_one_digest_from_each_group(spark):
    """Also where the last group of a tree is short: 8 digits at most, each once, in every unit."""
    for size in (1, 7, 8, 9, 63, 64, 65, 100, 513):
        units = spark.range(size).select(F.col("id").alias("unit"), F.lit(size).cast("long").alias("size"))
        for width in (1, 8, 64):
            if width >= size:
                continue
            sent = units.select((F.floor(F.col("unit") / width)).alias("grp"), F.explode(merkle._peers(width)).alias("to"))
            met = {r["to"]: r["groups"] for r in sent.groupBy("to").agg(F.sort_array(F.collect_list("grp")).alias("groups")).collect()}
            last = (size - 1) // width
            assert met == {u: [g for g in range(u // width // 8 * 8, u // width // 8 * 8 + 8) if g <= last] for u in range(size)}


# ----------------------------------------------------------------------- byte-level BPE

@pytest.fixture(scope="module")
def tools():
    return bpe._tools(bpe.ranks_path(), None)


@pytest.fixture(scope="module")
def library():
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(bpe.ranks_path()), special_tokens={})


def test_bpe_against_the_library(spark, library):
    rows = [*ROWS, (21, "ab" * 100_000), (22, "a" * 3000 + "=" * 999 + " " * 700 + "\n\n x"), (23, "Ա՘₏\U00011de1٣"), (None, PASSAGE), (None, PASSAGE)]
    got = bpe.encode(odd_table(spark, rows))
    assert got.columns[-4:] == ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and "print" in got.columns and "text" not in got.columns
    plain = brute.encoded(rows, library)
    assert sorted((tuple(r) for r in got.select(*DIGESTS).collect()), key=str) == sorted((r[:4] for r in plain), key=str)
    back = bpe.decode(got).select("doc_id", "text", "decode_errors").collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "", 0) for i, t in rows), key=str)
    assert bpe.encode(empty_table(spark)).count() == 0


def test_transducer_against_the_library(tools, library):
    """Random strings, strings of random tokens and long repeats; whole texts and each alone."""
    encoder, r, tokens = tools[0], random.Random(5), sorted(bpe.read_ranks(bpe.ranks_path()))
    for k in range(6000):
        text = ["".join(r.choice("abeinrst  's12\n\té日語한국א😀ا") for _ in range(r.randint(1, 40))),
                b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "replace"),
                r.choice(["a", "ab", "e", "=", "-", "日", " "]) * r.randint(1, 300)][k % 3]
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), text


def test_transducer_follows_ranks_that_do_not_grow_with_length():
    """Joins whose rank is lower than those of their parts, and a token that no join makes."""
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"abc": 4, b"bc": 9, b"ab": 12, b"cd": 6, b"bcd": 5, b"abcd": 30, b"dad": 7, b"aa": 8, b"aaa": 11}
    transducer, r = bpe.Transducer(ranks), random.Random(1)
    assert not transducer.merges.fit(None, 7)
    for _ in range(4000):
        piece = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 14)))
        assert transducer.encode(piece) == brute.joined(piece, ranks), piece


def test_states_start_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    from public_tokenizers import PATTERN

    encoder = bpe.Encoder(bpe.read_ranks(bpe.ranks_path()), PATTERN)
    assert encoder.encode(PASSAGE * 3).tolist() == library.encode_ordinary(PASSAGE * 3)


def test_streaming_decoder(tools):
    encoder, machine, _ = tools
    text = "Größe 日本語 テキスト 😀😀 א" + PASSAGE
    ids = encoder.encode(text)
    for width in (1, 2, 3, 7):
        decoder, out = bpe.StreamDecoder(machine), []
        for a in range(0, len(ids), width):
            out.append(decoder.feed(ids[a:a + width]).decode())  # whole characters only
        assert "".join(out) == text and decoder.finish() == b"" and decoder.errors == 0


def test_decoder_passes_odd_bytes_through(tools):
    machine = tools[1]
    ranks, r = bpe.read_ranks(bpe.ranks_path()), random.Random(2)
    for _ in range(300):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0xFF]) for _ in range(r.randint(1, 12)))
        decoder, out = bpe.StreamDecoder(machine), b""
        for byte in data:
            out += decoder.feed(np.array([ranks[bytes([byte])]], np.uint32))
        assert out + decoder.finish() == data
        try:
            data.decode()
            assert decoder.errors == 0
        except UnicodeDecodeError:
            assert decoder.errors > 0


# -------------------------------------------------------------------------- vector codes

def vectors(n, width, seed=3):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in r.normal(0, 0.3, width).astype(np.float32)], None if i % 7 == 0 else int(i % 3)) for i in r.permutation(n)]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, error string").repartition(3)


@pytest.mark.parametrize("n, width", [(300, 32), (40, 8), (16, 64), (5, 16), (1, 8)])
def test_codes_against_plain_version(spark, n, width):
    rows = vectors(n, width)
    if n == 300:  # repeated rows, ties and vectors that are no vectors
        rows += rows[:5] * 30 + [(900, None, 1), (901, [None] + [0.0] * 31, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, None), (904, [0.0] * 32, None)]
    got = product_codes.compress(table_of(spark, rows))
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(brute.codes(rows))


def test_codes_of_odd_vectors(spark):
    rows = [*vectors(50, 16), (60, [0.5] * 8, 1), (61, [], 1), (62, [3e38] * 16, 2), (None, [0.25] * 16, None)]
    got = {r["vec_id"]: r for r in product_codes.compress(table_of(spark, rows)).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if r["code"] is None} == {60, 61, 62}
    assert got[60]["error"] is None and got[None]["code"] is not None
    assert product_codes.compress(table_of(spark, [])).count() == 0
    assert product_codes.compress(table_of(spark, vectors(20, 16)), label_column=None).filter("label_error is null").count() == 20


def test_nearest_by_slices_is_exact():
    r = np.random.default_rng(4)
    for entries, spread in ((16, 300), (64, 300), (16, 2), (1, 50), (16, 1 << 25)):
        codebook = r.integers(-spread, spread + 1, (entries, 8))
        parts = np.concatenate([r.integers(-2 * spread, 2 * spread + 1, (500, 8)), codebook])
        index, distance = product_codes.Slices(codebook).nearest(parts)
        squares = ((parts[:, None] - codebook[None]) ** 2).sum(axis=2)
        assert (index == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()


def test_masks_hold_the_cube():
    r = np.random.default_rng(5)
    codebook, parts = r.integers(-20, 20, (16, 4)), r.integers(-20, 20, (200, 4))
    masks = product_codes.Slices(codebook).candidates(parts, np.full(200, 9))
    inside = (np.abs(parts[:, None] - codebook[None]) <= 9).all(axis=2)
    assert (((masks[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(1)).astype(bool) == inside).all()


def test_tampering_is_by_crc():
    assert [zlib.crc32(str(i).encode()) % 3 == 0 for i in range(6)] == [brute.tampered(i) for i in range(6)]
