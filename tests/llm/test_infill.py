"""Fill-in-middle against a plain version, and its defined cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from opsward.llm import infill

TEXTS = [None, "", "a", " ", "one two", "Grüße,  日本語 it's\x1c 𝒳y done.\n\nAb", "a<P>b c d", "x <S> y", "<M>", "<P", "a <S b> <M c<P",
         "<<P<S<<M<", "word " * 60_000, "é" * 3000, "\x00a\x7fb￿", "<S", "end <", "S> M>"]


def plain(doc_id, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(u)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not t or any(m in t for m in infill.MARKS) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, t, t)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", t)
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", t)


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = [(i * 40 + j, t) for i in range(30) for j, t in enumerate(TEXTS)]
    rows += [(9000 + i, "".join(rng.choice("ab <>PSM\néß.") for _ in range(rng.randrange(40)))) for i in range(800)]
    return rows + [(None, "no id here"), (None, "no id here"), (7, "twice"), (7, "twice"), (7, "thrice")]


@pytest.mark.parametrize("size", [64, infill.SLICE_BYTES])
def test_equals_plain_version_and_restores(spark, data, size):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in data], "doc_id int, text string, n long, form string, h1 int").repartition(3)
    got = infill.fill_in_middle(docs, slice_bytes=size)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = [tuple(r) for r in got.withColumn("t", infill.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(rows, key=key) == sorted((plain(*r) for r in data), key=key)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_parameters_and_empty_table(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    marks = ("<|a|>", "<|b|>", "<|c|>")
    got = infill.fill_in_middle(docs, seed=5, marks=marks, infill=100, suffix_first=50)
    other = infill.fill_in_middle(docs, seed=6, marks=marks, infill=100, suffix_first=50)
    rows = got.withColumn("t", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all((r.form == "plain") == (r.t == "") for r in rows)
    assert sorted(r.t for r in rows) == sorted(t or "" for _, t in data)
    assert sorted(r.output for r in rows) != sorted(r.output for r in other.collect())
