"""The fill-in-the-middle transformation against regular expressions, in whole texts and in chunks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fill_middle
from tests.llm.test_operators import DOCS, empty, odd  # noqa: F401


def by_pattern(doc_id, text, rate=100, spm=50):
    text = text or ""
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made_texts(n, longest):
    rng = random.Random(5)
    parts = ["\n", "\n\n", "a", "<", "<P", "<<P", "P>", ">", "ü", "𝄞", "word ", "<S", "<M", "M>", "\r\n", "\x0b"]
    out = ["".join(rng.choices(parts, [8, 2, 5, 1, 1, 1, 1, 1, 3, 2, 6, 1, 1, 1, 1, 1], k=rng.randint(0, longest))) for _ in range(n)]
    return out + ["x<P>", "<M>", "<S", "\n", "no end", "a\n", "", "<" * 300 + "P>", "a" * 255 + "<P>", "b" * 254 + "<S>\n"]


@pytest.mark.parametrize("giant, chunk", [(1 << 16, 1 << 14), (64, 16), (0, 1)])
def test_lines_marks_and_cuts(spark, monkeypatch, giant, chunk):
    monkeypatch.setattr(fill_middle, "GIANT_BYTES", giant)
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", chunk)
    texts = made_texts(60 if chunk == 1 else 300, 40 if chunk == 1 else 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fill_middle.fill_middle(docs, rate=90, spm=40).withColumn("back", fill_middle.restored()).collect()
    assert len(out) == len(texts)
    for r in out:
        want = by_pattern(r.doc_id, texts[r.doc_id], 90, 40)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == texts[r.doc_id]
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_functions_compose():
    """However a text is cut, composed functions and counts are those of the whole."""
    rng = random.Random(1)
    marks = [b"<P>", b"<S>", b"<M>"]
    for text in made_texts(40, 60):
        raw = text.encode()
        whole = fill_middle._Scan([raw], marks)
        cuts = sorted(rng.choices(range(len(raw) + 1), k=3))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        pieces = fill_middle._Scan(parts, marks)
        for one, many in ((whole.line_functions, pieces.line_functions), (whole.mark_functions, pieces.mark_functions)):
            every = np.arange(one[0].shape[1])[None, :]
            results = [fill_middle.fold(*f, np.array([len(f[0])]), every)[2:] for f in (one, many)]
            assert all((x == y).all() for x, y in zip(*results, strict=True))


def test_fill_middle_edges(spark, odd, empty):  # noqa: F811
    out = fill_middle.fill_middle(odd)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    want = [(r.doc_id, *by_pattern(r.doc_id, r.text)) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert fill_middle.digest(empty).count() == 0
    giants = odd.filter(F.octet_length("text") > fill_middle.GIANT_BYTES).count()
    assert giants == 3
