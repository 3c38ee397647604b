"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A mix is laid out in three steps, none of which moves a text:

1. Sizes (words) are summed per source, targets follow from the weights: the mix holds ``share`` times all
   words, a source gets its weight's part, stops at ``max_epochs`` times its own size, and the excess goes
   to the others by weight until none is above.
2. A document's place in its source is a hash key. The leading digit of the key is its block, so the blocks
   of a source are random and disjoint. A source gives whole passes, then blocks in key order up to the cut,
   the key where its target is met. The cut is found by radix descent: sums per key digit (map-side
   combined), then per next digit inside the one digit that holds the cut, so a source of any size costs a
   bounded table per level and no sort.
3. The exact block quotas of all sources are split among the output shards by a binary tree: each node
   draws how many blocks of each source go left from the multivariate hypergeometric distribution. Shards
   then take disjoint runs of each source's permuted blocks, and rows are shuffled inside their shard by a
   second hash.

Everything is a function of the rows and ``seed``: reruns and retried tasks agree. The driver sees one table
row per (source, leading digit); sources are the entries of a mix's configuration.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents whose keys
are equal (repeated ids) are cut together, to whichever side of the cut lies nearer; an empty table gives an
empty mix; with only empty texts every target is 0 and each document is taken once or not at all, for 0 words.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import neutral, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
KEY_DIGITS = 15
DIGIT_BITS = 10
SHARDS = 64
LEAF_ROWS = 4096
LEAST_PARTS, PART_WORDS = 16, 8_000_000
BROADCAST_ROWS = 200_000
SEED = 20


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS) -> list[Fraction]:
    """Words the mix takes of each source: water-filling by weight below the ceilings, in exact fractions."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > max_epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = Fraction(max_epochs * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) block counts that sum to ``quotas``, drawn down the splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        total = int(q.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else q
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _permuted(n: int, seed: list[int]) -> np.ndarray:
    """A keyed affine permutation of range(n)."""
    rng = np.random.default_rng(seed)
    a = int(rng.integers(1, max(2, n)))
    while gcd(a, n) != 1:
        a += 1
    return (np.arange(n, dtype=np.int64) * a + int(rng.integers(0, max(1, n)))) % max(1, n)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size and key, a uniform 60-bit number."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return docs.withColumns({"__size": word_count(F.col("text")),
                             "__key": F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")})


def _cuts(base: DataFrame, sums: list, wanted: dict[int, Fraction]) -> dict[int, int]:
    """Per source index the largest key that the last pass still takes (-1: none). A document goes in while the
    middle of its words lies at or before ``wanted``."""
    spark = base.sparkSession
    cut: dict[int, int] = {}
    state = {i: (Fraction(0), 0, 0) for i in wanted}  # words before, key prefix, bits fixed
    level, rows = 0, [(r.s, r.digit, r.words, r.n) for r in sums if r.s in wanted]
    while True:
        nxt = []
        for s, (before, prefix, bits) in state.items():
            here = sorted((d, w, n) for i, d, w, n in rows if i == s)
            inside = None
            for d, w, n in here:
                if before + w >= wanted[s]:
                    inside = (d, n)
                    break
                before += w
            if inside is None:
                cut[s] = (1 << 60) - 1 if bits == 0 else ((prefix + 1) << (60 - bits)) - 1
            else:
                nxt.append((s, before, (prefix << DIGIT_BITS) + inside[0], bits + DIGIT_BITS, inside[1]))
        if not nxt:
            return cut
        level += 1
        state = {s: (b, p, bits) for s, b, p, bits, _ in nxt}
        leaf = [x for x in nxt if x[4] <= LEAF_ROWS or x[3] >= 60]
        at = spark.createDataFrame([(s, p) for s, _, p, _, _ in nxt], "s int, prefix long")
        inside = base.withColumn("prefix", F.shiftright("key", 60 - level * DIGIT_BITS)).join(at, ["s", "prefix"])
        if len(leaf) == len(nxt):
            got = inside.groupBy("s", "key").agg(F.sum("size").alias("words")).collect()
            for s, before, prefix, bits, _ in nxt:
                cut[s] = (prefix << (60 - bits)) - 1
                for key, words in sorted((r.key, r.words) for r in got if r.s == s):
                    if before + Fraction(words, 2) > wanted[s]:
                        break
                    before += words
                    cut[s] = key
            return cut
        digit = F.shiftright("key", 60 - (level + 1) * DIGIT_BITS).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
        rows = [(r.s, r.digit, r.words, r.n) for r in inside.groupBy("s", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")).collect()]


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    """A table made on the driver, broadcast if its counted rows allow it; beyond that Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Mix:
    """The laid-out mix: ``sources`` has a row per source, ``placements`` one per drawn block."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS,
                 shards: int = SHARDS, seed: int = SEED):
        spark = docs.sparkSession
        self.seed, self.shards = seed, shards
        narrow = _keyed(docs.select("doc_id", "text", "source"), seed)
        self.base = stored(narrow.select("doc_id", "source", F.col("__size").alias("size"), F.col("__key").alias("key"),
                                         F.monotonically_increasing_id().alias("row")), "mix-base")
        digit = F.shiftright("key", 60 - DIGIT_BITS).cast("int")
        sums = self.base.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
        names = sorted({r.source for r in sums if r.source is not None}) + ([None] if any(r.source is None for r in sums) else [])
        index = {x: i for i, x in enumerate(names)}
        total = [0] * len(names)
        by_source = []
        for r in sums:
            total[index[r.source]] += r.words
            by_source.append(type("Row", (), {"s": index[r.source], "digit": r.digit, "words": r.words, "n": r.n}))
        goal = targets(total, [weights[i % len(weights)] for i in range(len(names))], share, max_epochs)
        # a shard is sorted in as many tasks as its share of the counted words asks for
        self.parts = max(LEAST_PARTS, -(-int(sum(goal)) // (PART_WORDS * shards)))
        passes = [int(g // t) if t else 0 for g, t in zip(goal, total)]
        wanted = {i: g - p * t for i, (g, p, t) in enumerate(zip(goal, passes, total)) if p * t < g}
        lookup = _hinted(spark.createDataFrame([(i, x) for i, x in enumerate(names)], "s int, src string"), len(names))
        indexed = self.base.join(lookup, F.col("source").eqNullSafe(F.col("src"))).select("s", "key", "size")
        cut = _cuts(indexed, by_source, wanted) if wanted else {}
        self.sources = _hinted(spark.createDataFrame(
            [(i, x, total[i], float(goal[i]), passes[i], cut.get(i, -1)) for i, x in enumerate(names)],
            "s int, src string, source_size long, target double, passes int, cut long"), len(names))
        digits: dict[int, set[int]] = {}
        for r in by_source:
            digits.setdefault(r.s, set()).add(r.digit)
        units = []
        for i in range(len(names)):
            last = cut.get(i, -1) >> (60 - DIGIT_BITS)
            units.append([(p, d) for p in range(passes[i]) for d in sorted(digits[i])]
                         + [(passes[i], d) for d in sorted(digits[i]) if d <= last])
        quota = split_quotas([len(u) for u in units], shards, seed)
        placed = []
        for i, u in enumerate(units):
            order = _permuted(len(u), [seed, i])
            owner = np.repeat(np.arange(shards), quota[:, i])
            placed += [(i, u[k][0], u[k][1], int(owner[j])) for j, k in enumerate(order)]
        self.placements = _hinted(spark.createDataFrame(placed, "s int, pass int, block int, shard int"), len(placed))

    def _dealt(self, got: DataFrame, columns: list[str], tasks_per_shard: int | None) -> DataFrame:
        """The draw: a row for each copy of ``got`` (with source and __key), its shard and place there, dealt and shuffled."""
        src = self.sources.select(F.col("s").alias("__s"), F.col("src").alias("__src"), F.col("passes").alias("__passes"), F.col("cut").alias("__cut"))
        at = self.placements.select(F.col("s").alias("__s"), F.col("pass").alias("__pass"), F.col("block").alias("__block"), F.col("shard").alias("__shard"))
        got = got.join(src, F.col("source").eqNullSafe(F.col("__src")))
        copies = F.col("__passes") + F.when(F.col("__key") <= F.col("__cut"), 1).otherwise(0)
        got = got.where(copies > 0).withColumn("__pass", F.explode(F.sequence(F.lit(0), copies - 1)))
        got = got.withColumn("__block", F.shiftright("__key", 60 - DIGIT_BITS).cast("int")).join(at, ["__s", "__pass", "__block"])
        got = got.withColumn("__order", F.xxhash64("__key", "__pass", F.lit(self.seed)))
        got = got.select(*columns, "__shard", "__order", F.pmod("__order", F.lit(tasks_per_shard or self.parts)).alias("__part"))
        return got.repartition("__shard", "__part").sortWithinPartitions("__shard", "__part", "__order")

    def per_document(self, tasks_per_shard: int | None = None) -> DataFrame:
        """One row per document: size, its source's size and target, copies and words taken, counted on the draw
        (without the texts)."""
        drawn = stored(self._dealt(self.base.withColumnRenamed("key", "__key"), ["row", "size"], tasks_per_shard), "mix-drawn")
        placed = drawn.groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
        return (self.base.join(self.sources, F.col("source").eqNullSafe(F.col("src"))).join(placed, "row", "left")
                .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                        F.coalesce("copies", F.lit(0)).cast("int").alias("copies")))

    def rows(self, docs: DataFrame, tasks_per_shard: int | None = None, names: tuple[str, str] = ("shard", "order_key")) -> DataFrame:
        """``docs`` as the mix has them, a row per copy, shuffled inside the shards. Shard and order are appended under
        ``names`` (and replace columns of those names). Text rows move once, to their shard's tasks."""
        plain, back = neutral(docs.drop(*names), ("doc_id", "text", "source"))
        got = self._dealt(_keyed(plain, self.seed), plain.columns, tasks_per_shard)
        columns = back(got).columns
        return got.select(*(F.col(a).alias(b) for a, b in zip(plain.columns, columns)), F.col("__shard").alias(names[0]), F.col("__order").alias(names[1]))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read
    return Mix(read(spark, sf_dir, "documents")).per_document().drop("copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(doc_id::VARCHAR || ':20'), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
r AS (SELECT *, sum(2 * n) OVER o AS full_to, sum(w) OVER o AS w_to, sum(w) OVER () AS w_all, 1.5 * sum(n) OVER () AS goal
      FROM w WINDOW o AS (ORDER BY n / w, i)),
c AS (SELECT *, goal - (full_to - 2 * n) AS left_, w_all - (w_to - w) AS open_ FROM r),
f AS (SELECT arg_min(left_, n / w) AS left_, arg_min(open_, n / w) AS open_ FROM c WHERE left_ * w <= 2 * n * open_),
t AS (SELECT source, n, CASE WHEN w * f.left_ > 2 * n * f.open_ THEN (2 * n)::DOUBLE ELSE (w * f.left_)::DOUBLE / f.open_ END AS target FROM w, f),
m AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) - d.size / 2 AS mid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (CASE WHEN target >= 2 * source_size THEN 2
     WHEN target >= source_size THEN 1 + (mid <= target - source_size AND target > source_size)::INT
     ELSE (mid <= target)::INT END))::BIGINT AS taken
FROM m"""
