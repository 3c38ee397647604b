"""Corpus extraction: object blocks from schema scripts, table references from SQL text.

Block extraction is a segmented scan over ``(file, line_no, line)``.  A line
belongs to the block opened by the latest begin line at or before it, unless an
end marker came in between.  Both "latest" values are running maxima, computed
in bounded chunks of ``chunk_lines`` lines plus a carry-in from earlier chunks
that is itself a hierarchical scan, so no window partition is ever larger than
a chunk or ``fanout`` rows, even for a single huge script.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.listing import write_texts

# Fixed block-begin patterns per object kind (first match wins).
BLOCK_KINDS = [
    ("TABLE", r"(?i)^\s*CREATE\s+TABLE\s"),
    ("VIEW", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?VIEW\s"),
    ("INDEX", r"(?i)^\s*CREATE\s+(UNIQUE\s+)?INDEX\s"),
    ("TRIGGER", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?TRIGGER\s"),
    ("PROCEDURE", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\s"),
    ("FUNCTION", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?FUNCTION\s"),
    ("SEQUENCE", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?SEQUENCE\s"),
    ("ALIAS", r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?(PUBLIC\s+)?ALIAS\s"),
    ("ROLE", r"(?i)^\s*CREATE\s+ROLE\s"),
    ("AUDIT POLICY", r"(?i)^\s*CREATE\s+AUDIT\s+POLICY\s"),
]
END_MARKER = r"[;@]\s*$"
NAME_RE = (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+)?(?:PUBLIC\s+)?"
           r"(?:TABLE|VIEW|INDEX|TRIGGER|PROCEDURE|FUNCTION|SEQUENCE|ALIAS|ROLE|AUDIT\s+POLICY)\s+"
           r"(\"?[A-Za-z0-9_#$@]+\"?(?:\.\"?[A-Za-z0-9_#$@]+\"?)?)")
UNQUALIFIED = "UNQUAL"


def block_kind(line: Column) -> Column:
    e = None
    for kind, rx in BLOCK_KINDS:
        e = F.when(line.rlike(rx), F.lit(kind)) if e is None else e.when(line.rlike(rx), F.lit(kind))
    return e


def object_name(begin_text: Column) -> tuple[Column, Column]:
    tok = F.regexp_replace(F.regexp_extract(begin_text, NAME_RE, 1), '"', "")
    schema = F.when(tok.contains("."), F.split_part(tok, F.lit("."), F.lit(1))).otherwise(F.lit(UNQUALIFIED))
    name = F.when(tok.contains("."), F.split_part(tok, F.lit("."), F.lit(2))).otherwise(tok)
    return schema, name


def exclusive_prefix_max(df: DataFrame, part_cols: list[str], pos_col: str, value_cols: list[str],
                         fanout: int = 4096, levels: int = 2) -> DataFrame:
    """Per row: the max of ``value_cols`` over rows of the same partition with a smaller ``pos_col``.

    Hierarchical scan: positions are grouped in blocks of ``fanout``; inside a
    block a window covers at most ``fanout`` rows, and the carry from earlier
    blocks is the same computation one level up on per-block maxima.  With
    ``levels`` levels the top window spans ``rows / fanout**levels`` rows.
    Output: ``part_cols, pos_col, in_<value>``.
    """
    if levels <= 0:
        w = Window.partitionBy(*part_cols).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*part_cols, pos_col, *[F.max(c).over(w).alias(f"in_{c}") for c in value_cols])
    blk = f"_blk{levels}"
    d = df.select(*part_cols, pos_col, *value_cols, F.floor(F.col(pos_col) / fanout).alias(blk))
    w = Window.partitionBy(*part_cols, blk).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
    local = d.select(*part_cols, pos_col, blk, *[F.max(c).over(w).alias(f"_l_{c}") for c in value_cols])
    totals = d.groupBy(*part_cols, blk).agg(*[F.max(c).alias(c) for c in value_cols])
    carry = exclusive_prefix_max(totals, part_cols, blk, value_cols, fanout, levels - 1)
    j = local.join(carry, [*part_cols, blk], "left")
    return j.select(*part_cols, pos_col, *[F.greatest(F.col(f"_l_{c}"), F.col(f"in_{c}")).alias(f"in_{c}")
                                           for c in value_cols])


def block_lines(lines: DataFrame, chunk_lines: int = 4096, fanout: int = 4096) -> DataFrame:
    """Lines that belong to a block, with the block's begin ``(line_no, kind, text)``."""
    ln = F.col("line_no")
    kind = block_kind(F.col("line"))
    d = lines.select(
        "file", "line_no", "line",
        F.floor(ln / chunk_lines).alias("chunk"),
        F.when(kind.isNotNull(), F.struct(ln.alias("b_line"), kind.alias("b_kind"), F.col("line").alias("b_text"))).alias("beg"),
        F.when(F.col("line").rlike(END_MARKER), ln).alias("end_at"),
        (F.trim(F.col("line")) == "").alias("blank"),
        F.trim(F.col("line")).startswith("--").alias("comment"))
    w = Window.partitionBy("file", "chunk").orderBy("line_no")
    run_beg = F.max("beg").over(w.rowsBetween(Window.unboundedPreceding, 0))
    run_end = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    local = d.select("file", "line_no", "line", "chunk", "blank", "comment", "beg", "end_at",
                     run_beg.alias("r_beg"), run_end.alias("r_end"))
    # carry-in from earlier chunks of the same file: one row per chunk, scanned hierarchically.
    # Derived from the windowed lines (already clustered by file, chunk), so the lines are
    # classified and shuffled once and both branches reuse that exchange.
    stats = local.groupBy("file", "chunk").agg(F.max("beg").alias("c_beg"), F.max("end_at").alias("c_end"))
    carry = exclusive_prefix_max(stats, ["file"], "chunk", ["c_beg", "c_end"], fanout).select(
        "file", "chunk", F.col("in_c_beg").alias("in_beg"), F.col("in_c_end").alias("in_end"))
    j = local.join(carry, ["file", "chunk"], "left")
    beg = F.greatest(F.col("r_beg"), F.col("in_beg"))
    end = F.greatest(F.col("r_end"), F.col("in_end"))
    member = beg.isNotNull() & (end.isNull() | (end < beg["b_line"])) & ~F.col("blank") & ~F.col("comment")
    return j.where(member).select("file", "line_no", "line", beg.alias("begin"))


def extract_blocks(lines: DataFrame, chunk_lines: int = 4096, fanout: int = 4096) -> DataFrame:
    """One record per object: file, begin line, kind, schema, name, number of lines."""
    b = block_lines(lines, chunk_lines, fanout)
    blocks = b.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n_lines"))
    schema, name = object_name(F.col("begin.b_text"))
    return blocks.select("file", F.col("begin.b_line").alias("begin_line"), F.col("begin.b_kind").alias("kind"),
                         schema.alias("schema"), name.alias("name"), "n_lines")


def block_text(lines: DataFrame, chunk_lines: int = 4096) -> DataFrame:
    """Whole DDL text per object (sorted lines); an object's statement is the group."""
    b = block_lines(lines, chunk_lines)
    return b.groupBy("file", "begin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("ddl"))


SKIP_STATEMENTS = r"^\s*(OPEN|CLOSE|WHENEVER|FETCH|STOP)\b"
CUT_KEYWORDS = r"\b(SELECT|WHERE|ORDER|GROUP|ON|HAVING|UNION|LEFT|RIGHT|INNER|OUTER|FULL|CROSS)\b"
_ALL_CUTS = r"\b(SELECT|FROM|JOIN|WHERE|ORDER|GROUP|ON|HAVING|UNION|LEFT|RIGHT|INNER|OUTER|FULL|CROSS)\b"


def table_refs(stmts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Table names after FROM / JOIN (comma lists, first token of each item), distinct per statement row.

    One regex pass cuts the text before every keyword; a statement's names are made distinct inside its row, so
    nothing is shuffled.
    """
    s = F.upper(F.regexp_replace(F.col(text_col), r"\s+", " "))
    cut = F.split(F.regexp_replace(s, _ALL_CUTS, "|$1"), r"\|")
    segs = F.filter(cut, lambda x: x.startswith("FROM") | x.startswith("JOIN"))
    names = F.flatten(F.transform(segs, lambda x: F.transform(
        F.split(F.substr(x, F.lit(5)), ","), lambda it: F.split_part(F.trim(it), F.lit(" "), F.lit(1)))))
    refs = F.array_distinct(F.filter(names, lambda x: x != ""))
    return stmts.where(~s.rlike(SKIP_STATEMENTS)).select(F.col(id_col), F.explode(refs).alias("table_ref"))


def missing_objects(refs: DataFrame, catalog: DataFrame, schemas: list[str],
                    ref_col: str = "table_ref") -> DataFrame:
    """Qualified references are checked in their own schema, unqualified ones in every listed schema."""
    r = F.col(ref_col)
    cand = F.when(r.contains("."), F.array(F.split_part(r, F.lit("."), F.lit(1)))) \
        .otherwise(F.array(*[F.lit(s) for s in schemas]))
    name = F.when(r.contains("."), F.split_part(r, F.lit("."), F.lit(2))).otherwise(r)
    need = refs.select(F.explode(cand).alias("schema"), name.alias("name")).distinct()
    return need.join(catalog.select("schema", "name"), ["schema", "name"], "left_anti")


def reconcile(manifest: DataFrame, catalog: DataFrame, key: str, alt_prefix: str = "/alt/") -> DataFrame:
    """Manifest ⟕ catalog (latest row per key): one row per finding."""
    c = catalog.select(F.col(key), F.col("path").alias("c_path"), F.col("token").alias("c_token"))
    j = manifest.join(c, key, "left")
    findings = F.array(
        F.when(F.col("c_path").isNull(), F.lit("missing_artifact")),
        F.when(F.col("c_path").isNotNull() & ~F.col("path").startswith(F.col("c_path")),
               F.when(F.col("c_path").startswith(alt_prefix), F.lit("alternate_folder")).otherwise(F.lit("path_mismatch"))),
        F.when(F.col("c_token").isNotNull() & (F.col("c_token") != F.col("token")), F.lit("token_mismatch")))
    return j.select(key, F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("finding"))


def write_object_files(lines: DataFrame, base: str, chunk_lines: int = 4096) -> int:
    """One text file per object, ``<base>/<kind>/<schema>/<object>.ddl``; of objects of one name their blocks follow each other by
    file and line. Returns the files written."""
    b = block_lines(lines, chunk_lines)
    schema, name = object_name(F.col("begin.b_text"))
    rows = b.select(F.concat_ws("/", F.col("begin.b_kind"), schema, name).alias("_object"), "file", "line_no", F.col("line").alias("value"))
    return write_texts(rows, base, "_object", "value", ["file", "line_no"], "ddl")


def write_sorted(df: DataFrame, path: str, keys: list[str], line: Column) -> str:
    """A manifest in global order: part files hold consecutive key ranges, their names in the order of the ranges."""
    df.select(*keys, line.alias("value")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)
    return path


def read_sorted(lines: DataFrame) -> DataFrame:
    """(line_no, line) over all files of a sorted manifest, numbered in the order of file names: lines (file, line_no, line) plus the
    lines of the files before."""
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()  # a row per part file
    ends = [0, *accumulate(r.n for r in counts)]
    shift = lines.sparkSession.createDataFrame([(r.file, e) for r, e in zip(counts, ends)], "of string, shift long")
    return lines.join(shift, F.col("file") == F.col("of")).select((F.col("line_no") + F.col("shift")).alias("line_no"), "line")


def write_objects(lines: DataFrame, path: str, chunk_lines: int = 4096) -> str:
    """One DDL text per object, laid out ``<kind>/<schema>/`` (partitioned output, one row per object)."""
    text = block_text(lines, chunk_lines)
    schema, name = object_name(F.col("begin.b_text"))
    (text.select(F.col("begin.b_kind").alias("object_type"), schema.alias("object_schema"), name.alias("object_name"), "ddl")
         .hint("rebalance", "object_type", "object_schema")
         .write.mode("overwrite").partitionBy("object_type", "object_schema").parquet(path))
    return path
