"""Shared helpers of the training-data operators: shared scratch tables, bounded text batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsward.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts lineage durably."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run: Callable, reset: Callable | None = None) -> Callable:
    """``run`` for mapInArrow, with ``reset`` called and free memory given back to the machine at the end of a partition:
    workers live on over many tasks and stages, what they held need not."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if reset:
                reset()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
    return wrapped


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows here hold whole texts: fewer of them go to Python at once, unless the session sets a number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None or int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)


def neutral(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but those to ``keep`` named c0, c1, ..., so no name clashes with those of a job; and the
    function that gives the columns their names and order back."""
    names = {c: c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df: df.select(*(F.col(to).alias(c) for c, to in names.items()))


def word_count(text) -> F.Column:
    """Words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_fold(doc_id) -> F.Column:
    """True for rows that may be learnt from (crc32 of the id as text, mod 4, is not 2)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def at_most(n: int, total: int) -> int:
    """Largest 64-bit hash value that about 1.3 n + 20 of ``total`` rows stay below: a sample whose size does not grow with
    rows or partitions, to be cut to n by hash order."""
    return min(2**63 - 1, int((1.3 * n + 20) / max(1, total) * 2**64) - 2**63)


def text_slices(batch: pa.RecordBatch, max_chars: int = 2_000_000, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive row ranges of a batch with at most ``max_chars`` of text each (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > max_chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def byte_slices(batch: pa.RecordBatch, max_bytes: int = 2_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with at most ``max_bytes`` of text each (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of texts (null: none): the distinct ones, the number of each word in reading order, words per text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    coded = pc.dictionary_encode(split.flatten())
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(owner) else np.zeros(0, np.int32)
    if "" in distinct:  # beside leading or trailing white space
        keep = codes != distinct.index("")
        owner, codes = owner[keep], codes[keep]
    return distinct, codes, np.bincount(owner, minlength=len(texts))


def ragged_positions(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(starts[i], starts[i] + lens[i])``."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lens)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of each run of edges: at most one edge a vertex leaves, with the same components."""
    held, n = [], 0

    def stars(tables):
        a = np.concatenate([t.column(0).to_numpy() for t in tables])
        b = np.concatenate([t.column(1).to_numpy() for t in tables])
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat[: len(a)], flat[len(a):]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            while not np.array_equal(new, new[new]):
                new = new[new]
            new = new[label]
            if np.array_equal(new, label):
                break
            label = new
        keep = label != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[label[keep]])], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > 500_000:
            held = [stars(held)]
            n = held[0].num_rows
            if n > 250_000:
                yield held[0]
                held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (u, v: long): one row (v, component) per vertex, the smallest id
    as component. Each round joins the edges with a min-neighbour label, contracts them and stores the
    shrunken edge list; labels are followed through the rounds at the end. Distributed throughout: a
    partition only ever thins its own edges."""
    spark = edges.sparkSession
    schema = "u long, v long"
    e = stored(edges.select("u", "v").where("u <> v").mapInArrow(_forest, schema), f"{name}-edges")
    links: DataFrame | None = None
    for rnd in range(60):
        if e.isEmpty():
            break
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        low = stored(low, f"{name}-hook")
        # pointer jumping: follow the hooks to their roots
        while True:
            up = low.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = low.join(up, "p", "left").select("u", "p", F.coalesce("pp", "p").alias("q"))
            jumped = stored(jumped, f"{name}-jump")
            moved = not jumped.where("p <> q").isEmpty()
            low = jumped.select("u", F.col("q").alias("p"))
            if not moved:
                break
        links = low if links is None else links.select("u", F.col("p").alias("m")).join(
            low.select(F.col("u").alias("m"), F.col("p").alias("n")), "m", "left").select("u", F.coalesce("n", "m").alias("p"))
        if rnd:
            links = stored(links, f"{name}-links")
        a = low.select(F.col("u"), F.col("p").alias("pu"))
        b = low.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        e = stored(e.mapInArrow(_forest, schema), f"{name}-edges")
    if links is None:
        return spark.createDataFrame([], "v long, component long")
    return links.select(F.col("u").alias("v"), F.col("p").alias("component"))

