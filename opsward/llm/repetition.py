"""Repetition inside a text by suffix arrays over its words.

For a batch of whole texts, words become integer codes and one suffix array is built over all of them at once
by prefix doubling (a level doubles the compared length; only suffixes that still share their rank with
another one of the same text are sorted again). The rank tables of the levels then give the longest common
prefix of neighbouring suffixes. Runs of that array are the LCP intervals: an interval whose occurrences are
preceded by different words is a maximal repeated substring. The union of their spans is the covered part.

A text is kept if it passes the base rule, the words covered by repeats of at least ``min_words`` words are at
most ``max_covered`` of its words, and no repeat has more than ``max_longest`` words.

Defined cases: a null or empty text has 0 words and fails the base rule; a row gives a row, repeated ids
included, null ids too; texts longer than a slice form a slice of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read, text_slices

MIN_WORDS = 10
MAX_COVERED = 0.30
MAX_LONGEST = 200
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_words long, n_maximal long, longest_repeat long")


def _levels(code: np.ndarray, doc: np.ndarray):
    """Prefix doubling. Returns the sparse rank tables [(positions, ranks)] of lengths 1, 2, 4, ... (only positions
    whose rank is shared), and the final rank of the positions shared at length 1."""
    n = len(code)
    _, rank = np.unique(doc * (code.max() + 1) + code, return_inverse=True)
    first = np.bincount(rank)
    rank = (np.cumsum(first) - first)[rank]  # a group's rank: its first place in the order
    group = np.bincount(rank, minlength=n)
    pos = np.flatnonzero(group[rank] > 1)
    final, levels, step = rank, [], 1
    while len(pos):
        levels.append((pos, final[pos].copy()))
        nxt = pos + step
        inside = nxt < n
        inside[inside] = doc[nxt[inside]] == doc[pos[inside]]
        second = np.zeros(len(pos), np.int64)
        second[inside] = final[nxt[inside]] + 1
        key = final[pos] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        old = final[pos]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_old = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(len(pos))
        place = at - np.maximum.accumulate(np.where(new_old, at, 0))
        rank = old + place[np.maximum.accumulate(np.where(new_key, at, 0))]
        final = final.copy()
        final[pos] = rank
        starts = np.flatnonzero(new_key)
        shared = np.repeat(np.diff(np.r_[starts, len(pos)]) > 1, np.diff(np.r_[starts, len(pos)]))
        pos = np.sort(pos[shared])
        step *= 2
    return levels, final


def suffix_lcp(code: np.ndarray, doc: np.ndarray):
    """(suffixes, lcp): the suffixes that share their first word with another of their text, in suffix order, and
    the longest common prefix in words of each with the one before it (0 at a change of first word)."""
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels, final = _levels(code, doc)
    if not levels:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos = levels[0][0]
    suffixes = pos[np.argsort(final[pos], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        where, rank = levels[k]
        x, y = a + common, b + common
        i, j = np.searchsorted(where, x), np.searchsorted(where, y)
        i[i == len(where)] = 0
        j[j == len(where)] = 0
        same = (where[i] == x) & (where[j] == y) & (rank[i] == rank[j])
        common[same] += 1 << k
    return suffixes, np.r_[0, common]


def covered(starts: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """Mask over n words of the union of spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lens, -1)
    return np.cumsum(edge[:n]) > 0


def maximal_repeats(suffixes: np.ndarray, lcp: np.ndarray, code: np.ndarray, doc: np.ndarray, min_words: int):
    """The maximal repeated substrings of at least ``min_words`` words: (length, lb, rb), rows of the suffix order.
    LCP intervals come from a stack; one is left-maximal if the words before its occurrences differ."""
    n = len(suffixes)
    before = np.where((suffixes > 0) & (doc[suffixes - 1] == doc[suffixes]), code[suffixes - 1], -1 - suffixes)
    changes = np.r_[0, np.cumsum(before[1:] != before[:-1])] if n else before
    found, stack = [], []
    last = -2
    for i in np.flatnonzero(lcp >= min_words).tolist():
        if i != last + 1:
            found += [(h, lb, last) for h, lb in stack]
            stack = []
        h, lb = int(lcp[i]), i - 1
        while stack and stack[-1][0] > h:
            top, lb = stack.pop()
            found.append((top, lb, i - 1))
        if not stack or stack[-1][0] < h:
            stack.append((h, lb))
        last = i
    found += [(h, lb, last) for h, lb in stack]
    return [(h, lb, rb) for h, lb, rb in found if changes[rb] != changes[lb]]


def longest_at(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """For each row of the suffix order the length of the longest interval it lies in (0: none). Intervals nest, so one
    sweep with a stack writes every row once."""
    best, stack, at = np.zeros(n, np.int64), [], 0

    def close(before: int) -> None:
        nonlocal at
        while stack and stack[-1][1] < before:
            h, rb = stack.pop()
            best[at: rb + 1] = h
            at = max(at, rb + 1)

    for h, lb, rb in sorted(found, key=lambda x: (x[1], -x[2])):
        close(lb)
        if stack:
            best[at:lb] = stack[-1][0]
        at = max(at, lb)
        stack.append((h, rb))
    close(n)
    return best


def spans(suffixes: np.ndarray, found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Mask over n words of the union of the spans of all intervals. A span that lies inside a longer one at the same
    place adds nothing, so each place gives its longest."""
    best = longest_at(found, len(suffixes))
    long_ = best > 0
    return covered(suffixes[long_], best[long_], n)


def measure(texts: list, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Counts per text of a slice, see RESULT."""
    index: dict[bytes, int] = {}
    codes, lens = [], []
    word_chars, symbols, dup_lines = [], [], []
    for t in texts:
        t = t or ""
        words = t.encode("utf-8", "surrogatepass").split()  # bytes: splits on exactly the six ASCII spaces
        codes += [index.setdefault(w, len(index)) for w in words]
        lens.append(len(words))
        word_chars.append(len(t) - sum(map(t.count, SPACES)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    lens = np.array(lens, np.int64)
    code = np.array(codes, np.int64)
    doc = np.repeat(np.arange(len(texts)), lens)
    suffixes, lcp = suffix_lcp(code, doc)
    best = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    per_doc = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    three = suffixes[best >= 3]
    repeat = covered(three, np.full(len(three), 3), len(code))
    found = maximal_repeats(suffixes, lcp, code, doc, min_words)
    cover = spans(suffixes, found, len(code))
    owners = [doc[suffixes[lb]] for _, lb, _ in found]
    longest = np.zeros(len(texts), np.int64)
    short = best < min_words  # texts without an interval show their longest shorter repeat
    np.maximum.at(longest, doc[suffixes[short]], best[short])
    if found:
        np.maximum.at(longest, owners, [h for h, _, _ in found])
    return {"n_words": lens, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": per_doc(repeat), "covered_words": per_doc(cover),
            "n_maximal": np.bincount(owners, minlength=len(texts)) if owners else np.zeros(len(texts), np.int64),
            "longest_repeat": longest}


def repeated_passages(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Merged word spans [start, end) of one text that repeats of at least ``min_words`` words cover."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    index: dict[bytes, int] = {}
    code = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    suffixes, lcp = suffix_lcp(code, np.zeros(len(code), np.int64))
    one = np.zeros(len(code), np.int64)
    mask = spans(suffixes, maximal_repeats(suffixes, lcp, code, one, min_words), len(code))
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repetition(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED,
               max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its counts, base_failed and kept."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                got = measure(texts, min_words)
                yield pa.RecordBatch.from_arrays([rows.column(0)] + [pa.array(got[c], pa.int64()) for c in names[1:]], names=names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keep = ~failed & (100 * F.col("covered_words") <= round(100 * max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumns({"base_failed": failed, "kept": keep})


def op1_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(read(spark, sf_dir, "documents")).drop("n_maximal", "longest_repeat")


# Words repeated in windows of MIN_WORDS, and whether any window of MAX_LONGEST + 1 words repeats, say the same in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, len(w)::BIGINT AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i+2], ' ') AS g3, array_to_string(w[i:i+9], ' ') AS g10,
        md5(array_to_string(w[i:i+200], ' ')) AS g201 FROM p),
c AS (SELECT doc_id, i, i + 2 <= n AND count(*) FILTER (i + 2 <= n) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
        i + 9 <= n AND count(*) FILTER (i + 9 <= n) OVER (PARTITION BY doc_id, g10) > 1 AS r10,
        i + 200 <= n AND count(*) FILTER (i + 200 <= n) OVER (PARTITION BY doc_id, g201) > 1 AS r201 FROM g),
m AS (SELECT doc_id, max(r3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        max(r10::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r201 FROM c),
s AS (SELECT doc_id, sum(c3)::BIGINT AS n3, sum(c10)::BIGINT AS n10, max(r201::INT) AS over FROM m GROUP BY doc_id),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, (count(*) - count(DISTINCT x))::BIGINT AS dup FROM l GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(array_to_string(w, '')))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
        coalesce(n3, 0) AS n_repeat_words, coalesce(n10, 0) AS covered_words, coalesce(over, 0) AS over
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN u USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= 30 * n_words AND over = 0 AS kept FROM f"""
