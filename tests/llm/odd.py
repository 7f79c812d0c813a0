"""A small table of everything that tends to break text operators."""
import random


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ne", "ti", "or", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(n))


PASSAGE = prose(1, 60)
ROWS = [
    (1, None), (2, ""), (3, "one"), (4, PASSAGE), (5, PASSAGE), (6, " \t\r\n "), (7, PASSAGE.replace(" ", "  ")),
    (8, "Über naïve Größe — 日本語 テキスト " + prose(2, 50)), (9, prose(3, 40) + " " + PASSAGE + " " + prose(4, 40)),
    (10, "na " * 500), (11, prose(5, 6000)), (12, prose(3, 40) + "\n" + prose(6, 30)), (13, PASSAGE.upper()),
    (14, prose(7, 30) + "\n" + prose(8, 12) + "\n" + prose(7, 30)), (15, prose(8, 12) + " extra"), (16, prose(5, 5900)),
    (17, "\x00 odd \x1f bytes \x85 here"), (18, "ab" * 4000), (19, prose(9, 200) + " " + prose(1, 60)), (20, None),
]
CLASH = ["print", "places", "values", "kept", "keep_id", "unit", "block", "line", "label", "score", "_norm", "_id"]


def odd_table(spark, rows=ROWS, clash=True):
    """doc_id and text, and columns named like those the operators use inside."""
    names = ["doc_id", "text", *(CLASH if clash else [])]
    schema = "doc_id long, text string" + "".join(f", `{c}` string" for c in names[2:])
    return spark.createDataFrame([(*r, *["x"] * (len(names) - 2)) for r in rows], schema).repartition(3)


def empty_table(spark):
    return odd_table(spark, [])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is None, r))
