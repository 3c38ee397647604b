"""Line dedup against a plain version, and its defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from opsward.llm import linededup

BLANK = " \t\n\v\f\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def plain(data, min_docs, least, keep):
    docs, first = Counter(), {}
    for d, t in data:
        lines = (t or "").split("\n")
        docs.update({key_of(x) for x in lines})
        for i, x in enumerate(lines):
            at = (d is None, d or 0, i)
            first[key_of(x)] = min(first.get(key_of(x), at), at)
    out = []
    for d, t in data:
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if len(key_of(x)) < least or docs[key_of(x)] < min_docs
                or keep == "first" and first[key_of(x)] == (d is None, d or 0, i)]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(60)] + ["", " ", "\t", "x", "É", "é", "\x1c a", "日本語  ", "nul\x00"]
    rows = [(i, "\n".join(rng.choice((x, x.upper(), f"  {x}\r", x + "\v")) for x in rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(150)]
    rows += [(1000 + i, f"shared by all\nonly here {i}\n\n") for i in range(400)]
    rows += [(2000, "one line\n" * 30_000), (2001, "one line"), (2002, "z" * 300_000), (2003, "z" * 300_000)]
    return rows + [(None, None), (3000, ""), (3001, None), (None, "shared by all\nx"), (5, "twice\nx"), (5, "twice\nx"), (5, "thrice\ntwice")]


@pytest.mark.parametrize("held", [0, linededup.HELD_BYTES])
@pytest.mark.parametrize("min_docs,least,keep", [(10, 1, "none"), (2, 1, "first"), (3, 4, "none"), (2, 0, "none"), (4, 1, "first")])
def test_equals_plain_version(spark, data, min_docs, least, keep, held):
    docs = spark.createDataFrame([(*r, "k", 1, "x") for r in data], "doc_id int, text string, key string, n_lines int, of string").repartition(5)
    got = linededup.line_dedup(docs, min_docs, least, keep, held)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(data, min_docs, least, keep), key=key)


def test_empty_table_and_nulls_only(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert linededup.line_dedup(docs.limit(0)).count() == 0
    assert [tuple(r) for r in linededup.line_dedup(docs.where("doc_id = 3001")).collect()] == [(3001, 1, 0, "")]
    with pytest.raises(ValueError):
        linededup.line_dedup(docs, keep="last")
    with pytest.raises(ValueError):
        linededup.line_dedup(docs, min_docs=1)


def test_filters_miss_no_repeat_and_few_pass_by_chance(spark):
    """Keys of two documents are always held, over any split into tasks; of the rest few are."""
    rows = [(i, f"own {i}\nshared {i // 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bits, probes = linededup.shape(8000)
    f = linededup.twice_seen(docs, bits, probes)

    def share(keys):
        hashes = np.array([linededup.xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64)
        return linededup.held(f, linededup.places(hashes, bits, probes)).mean()

    assert share([f"shared {i}" for i in range(2000)]) == 1
    assert share([f"own {i}" for i in range(4000)]) < 0.02


def test_filter_size_is_bounded():
    assert linededup.shape(0)[0] == linededup.LEAST_BITS
    assert linededup.shape(10**13) == (linededup.MOST_BITS, 1)
    bits, probes = linededup.shape(10**6)
    assert bits >= 8 * 10**6 and probes == linededup.MOST_PROBES
