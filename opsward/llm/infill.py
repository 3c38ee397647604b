"""Fill-in-middle documents, cut and put together by pyarrow.compute a batch at a time.

A text's units (a run of letters, or one other code point) become a list array. The lists are flattened beside the
index of their text, each unit gets its ordinal in the text, and its role follows from the text's two cuts: prefix,
middle or suffix. Units of one role are filtered out, their lists rebuilt from the counts, and every list joined to
one string. No unit ever becomes a Python object.

Cuts and form come from the first four 8-digit groups of the sha256 of ``seed:doc_id``, so reruns agree and no row
depends on another. ``restored`` gives the text back from output and form by column functions.

Defined cases: a null text is the empty text; an empty text and one that holds a mark stay as they are (form
``plain``); a null id counts as the empty string; rows with equal ids are cut by the same numbers; texts are cut
whole, a very long one as a slice of its own; an empty table gives no rows. Only the id and the text are read, so
extra columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean, read

MARKS = ("<P>", "<S>", "<M>")
SEED = 1
INFILL_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
SLICE_BYTES = 2_000_000
#: One unit in UTF-8 bytes, and a byte that UTF-8 never holds to part units by.
UNIT = rb"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
BREAK = b"\xff"
NOTHING = pa.scalar(b"", pa.large_binary())
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_lists(raw: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of all texts in a row, the text that each belongs to, and the number of units of each text."""
    marked = pc.replace_substring_regex(raw, pattern=UNIT, replacement=b"\\1" + BREAK)
    lists = pc.split_pattern(marked, pattern=BREAK)
    # what follows the last break is empty
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(), size - 1


def joined(units: pa.Array, keep: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The kept units of each text as one string."""
    ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, pc.filter(units, pa.array(keep))), NOTHING)


def transform(raw: pa.Array, hashes: np.ndarray, marks: tuple[str, str, str] = MARKS, infill: int = INFILL_PERCENT,
              suffix_first: int = SUFFIX_FIRST_PERCENT) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts (UTF-8, no nulls), whose four numbers are the rows of ``hashes``."""
    units, parent, n = unit_lists(raw)
    a, b = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    first = np.cumsum(n + 1) - (n + 1)
    ordinal = np.arange(len(parent)) - first[parent]
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent]) + (ordinal >= n[parent])
    prefix, middle, suffix = (joined(units, role == r, c) for r, c in enumerate((low, high - low, n - high)))
    plain = (n == 0) | (hashes[:, 2] % 100 >= infill)
    for m in marks:
        plain |= pc.match_substring(raw, pattern=m.encode()).to_numpy(zero_copy_only=False)
    swapped = hashes[:, 3] % 100 < suffix_first
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in marks)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, NOTHING)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, NOTHING)
    is_plain, is_swapped = pa.array(plain), pa.array(swapped)
    form = pc.if_else(is_plain, "plain", pc.if_else(is_swapped, "spm", "psm"))
    output = pc.if_else(is_plain, raw, pc.if_else(is_swapped, spm, psm))
    chars = [pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x.cast(pa.large_string())), pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output.cast(pa.large_string()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = SEED, marks: tuple[str, str, str] = MARKS, infill: int = INFILL_PERCENT,
                   suffix_first: int = SUFFIX_FIRST_PERCENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: units, form, code points of prefix and middle, and the output text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch, slice_bytes):
                raw = pc.fill_null(rows.column(1), "").cast(pa.large_string()).cast(pa.large_binary())
                hashes = np.stack([rows.column(2 + i).to_numpy() for i in range(4)], axis=1)
                yield pa.RecordBatch.from_arrays([rows.column(0), *transform(raw, hashes, marks, infill, suffix_first)],
                                                 names=[x.split()[0] for x in RESULT.split(", ")])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *numbers).mapInArrow(lean(run), RESULT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A text holds no mark, and no mark can begin inside one and end in the next, so
    the first place of each mark is the one that was put there."""
    p, s, m = marks

    def cut(after: str, before: str | None) -> Column:
        start = F.locate(after, output) + F.lit(len(after))
        return output.substr(start, F.locate(before, output) - start if before else F.length(output) + F.lit(1))

    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(cut(p, s), cut(m, None), cut(s, m)))
            .otherwise(F.concat(cut(p, m), cut(m, None), cut(s, p))))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    got = fill_in_middle(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
g AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT *, array_to_string(u[1:low], '') AS pre, array_to_string(u[low + 1:high], '') AS mid, array_to_string(u[high + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
