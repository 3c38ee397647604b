"""Log analytics: window, counts over a fixed domain, unknown levels, sections, and the report in one scan of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed severity domain of the diagnostic log (reported levels first).
REPORTED_LEVELS = ["Critical", "Severe", "Error", "Warning"]
KNOWN_LEVELS = ["Info", "Event", "Warning", "Error", "Severe", "Critical"]
SECTION_LEVELS = [("Severe", "Severe Errors"), ("Error", "Common Errors")]


def last_days(df: DataFrame, ts_col: str, as_of: Column, days: int) -> DataFrame:
    return df.where((F.col(ts_col) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts_col) <= as_of))


def severity_counts(spark: SparkSession, logs: DataFrame, domain: list[str] = REPORTED_LEVELS) -> DataFrame:
    dom = spark.createDataFrame([(i, lv) for i, lv in enumerate(domain)], "ord int, level string")
    counts = logs.where(F.col("level").isin(*domain)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dom).join(counts, "level", "left")
            .select("ord", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def unknown_levels(logs: DataFrame, known: list[str] = KNOWN_LEVELS) -> DataFrame:
    return logs.where((F.col("level") != "") & ~F.col("level").isin(*known)).select("level").distinct()


def time_range(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                    F.count(F.lit(1)).alias("n_records"))


def sections(logs: DataFrame) -> DataFrame:
    """Distinct (instance, db) groups per detail section with their record counts; empty db = own group."""
    titles = F.create_map(*[F.lit(x) for pair in SECTION_LEVELS for x in pair])
    return (logs.where(F.col("level").isin(*[lv for lv, _ in SECTION_LEVELS]) & (F.col("instance") != ""))
            .groupBy("level", "instance", "db").agg(F.count(F.lit(1)).alias("n"))
            .select(titles[F.col("level")].alias("section"), "instance", "db", "n"))


def _group_header(inst: Column, db: Column) -> Column:
    return F.when(db != "", F.concat(F.lit("  ##  Instance: "), inst, F.lit(" Database: "), db, F.lit(" ")))\
        .otherwise(F.concat(F.lit("  ##  Instance: "), inst, F.lit(" ")))


def report(spark: SparkSession, logs: DataFrame, archived_to: str) -> DataFrame:
    """The sectioned report as ordered lines ``(section_no, grp, seq, line)``; a reader orders by the three keys.

    One scan, one aggregate: every record names the lines of the report that it contributes to (first and last time,
    its level's count, the titles, its group's head, its own detail line), and equal lines are combined, mostly on
    the map side. Titles of detail sections so appear as soon as any reported level occurs. Lines that must be
    there without any record are added with weight 0. No action runs while the plan is built."""
    shape = "section_no int, grp string, seq string, line string, w long, ts timestamp_ntz"
    fixed = [(0, "0", ""), (0, "1", "  Diagnostics Log Report"), (0, "2", "  ======================"), (0, "3", ""),
             (0, "4", f"    Current log archived to {archived_to}"), (0, "5", ""), (1, "0", ""), (1, "1", ""),
             *[(3, str(i), lv.rjust(15) + ": ") for i, lv in enumerate(REPORTED_LEVELS)], (9, "0", ""), (9, "1", "End of Report")]
    always = spark.createDataFrame([(no, "", seq, line, 0, None) for no, seq, line in fixed], shape)

    def line(no, grp, seq, text, when=None):
        no = no if isinstance(no, Column) else F.lit(no)
        x = F.struct(no.cast("int").alias("section_no"), grp.alias("grp"), seq.alias("seq"), text.alias("line"))
        return x if when is None else F.when(when, x)

    none, first = F.lit(""), F.lit("0")
    level, inst, db = F.col("level"), F.col("instance"), F.col("db")
    known = level.isin(*KNOWN_LEVELS) | (level == "")
    order = F.create_map(*[F.lit(x) for i, lv in enumerate(REPORTED_LEVELS) for x in (lv, i)])[level]
    section = F.create_map(*[F.lit(x) for i, (lv, _) in enumerate(SECTION_LEVELS) for x in (lv, 4 + i)])[level]
    detailed = section.isNotNull() & (inst != "")
    grp = F.concat_ws("$", inst, db)
    items = [line(1, none, first, none), line(1, none, F.lit("1"), none),
             line(2, level, first, F.concat(F.lit("Unknown error level of "), level, F.lit(" found")), ~known),
             line(3, none, order.cast("string"), F.concat(F.lpad(level, 15, " "), F.lit(": ")), order.isNotNull()),
             line(section, grp, first, _group_header(inst, db), detailed),
             line(section, grp, F.concat(F.lit("1"), F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lit("-"), F.col("rid")),
                  F.concat(F.lit("    "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.col("rid"), F.lit(" "), F.col("message")), detailed)]
    for i, (_, title) in enumerate(SECTION_LEVELS):
        items += [line(4 + i, none, first, F.lit(f"  {title} "), order.isNotNull()),
                  line(4 + i, none, F.lit("1"), F.lit("  " + "-" * (len(title) + 1)), order.isNotNull())]
    rows = logs.select("ts", F.explode(F.array_compact(F.array(*items))).alias("x")).select("x.*", F.lit(1).cast("long").alias("w"), "ts")
    out = rows.unionByName(always).groupBy("section_no", "grp", "seq").agg(
        F.max("line").alias("line"), F.sum("w").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    text = (F.when((F.col("section_no") == 1) & (F.col("seq") == "0"), F.coalesce(F.concat(F.lit("    First message :- "), stamp("a")), F.lit("")))
            .when(F.col("section_no") == 1, F.coalesce(F.concat(F.lit("    Last message  :- "), stamp("b")), F.lit("")))
            .when(F.col("section_no") == 3, F.concat("line", F.col("n").cast("string"))).otherwise(F.col("line")))
    return out.select("section_no", "grp", "seq", text.alias("line"))
