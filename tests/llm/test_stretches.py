"""Suffix dedup settles stretches that are copies as a whole without sending their text."""
import numpy as np
import pandas as pd

from soundings.llm import suffix_dedup
from soundings.llm.marks import CROWDED, Unit


def _asked(texts: list[str]) -> tuple[int, int, int]:
    """Stretches in all, settled as copies and asked for as text, each text in a unit of its own."""
    mark, rows, n = suffix_dedup._stretch_marks(50, 20), [], 0
    for k, text in enumerate(texts):
        unit = Unit(k)
        mark({"doc_id": k, "print": k, "text": text.encode()}, unit)
        n += unit.marks
        rows += suffix_dedup._send_stretches(unit, 1)
    rows = pd.DataFrame([r for r in rows if r["block"] >= 0])
    got = suffix_dedup._settle(CROWDED)((0,), rows)
    sizes, copied = got["places"].map(len) // 4, got["values"].map(len) > 0
    return n, int(sizes[copied].sum()), int(sizes[~copied].sum())


def test_only_the_edges_of_copies_go_as_text():
    rng = np.random.default_rng(3)
    text, other = ("".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(2))
    n, copied, asked = _asked([text, text])
    assert (copied, asked) == (n // 2, 0)
    n, copied, asked = _asked([text, other[:2000] + text[1000:3000] + other[2000:]])
    assert copied > 100 and 0 < asked < 20


def test_one_document_asks_for_nothing():
    assert _asked([60 * "abcdefghijklmnopqrstuvwxyz 0123456789 and more of it, "])[1:] == (0, 0)
