"""Line removal by how common a line is on its own site.

For each host, the pages that hold a line are divided by the pages of the host; lines above `ratio`, and on
at least `min_pages`, are boilerplate and are dropped from every page of that host. Pages of equal text count
once, on both sides of the division: a site full of copies of one page does not make its lines boilerplate.
With `groups`, which names the near-duplicate group of each text, pages of one group count once in the same way:
a group of near copies does not make the lines that it shares boilerplate. Without it only equal texts are one.

Lines are what stands between line feeds, compared exactly (by 64-bit hash inside a host). Empty lines are
kept. Null text stays null; a null host is a host of its own. A text that loses all lines becomes empty.
Repeated rows are treated alike. No rows are dropped.

Counts are made per (host, line) after a partial count on each task, so a host with a third of all pages is
split by line. The boilerplate of a host is at most (lines of a page / ratio) hashes, as each is on that share
of its pages. It is written, and its size is known: up to SENT_LINES hashes it is sent to all tasks, so that no text
is shuffled. Beyond that it meets the pages by a join on the host, in which the few hosts that hold more than one part
in (shuffle partitions) of all rows are dealt out over as many parts, row by row. Both ways give the same.

Columns of docs may have any names but those of the two counts, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartline.llm import flat
from chartline.sizing import task_count

MIN_PAGES = 10
RATIO = 0.05
SENT_LINES = 500_000


def boilerplate(
    docs: DataFrame, *, host: str = "source", text: str = "text", min_pages: int = MIN_PAGES, ratio: float = RATIO, groups: DataFrame | None = None,
) -> DataFrame:
    """host, lines: hashes of the boilerplate lines of each host that has any. groups: (mark, group), one row for each text hash."""
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(
        F.transform(F.filter(F.split(F.col(text), "\n"), lambda line: line != ""), lambda line: F.xxhash64(line))
    ).alias("lines"))
    if groups is not None:
        # equal pages go before the join, so that a text that is everywhere is one row for each host
        once = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"))
        pages = once.join(groups, F.col("page") == F.col("mark")).select("host", F.col("group").alias("page"), "lines")
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    counts = (
        pages.select("host", "page", F.explode("lines").alias("line")).distinct()
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    joined = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return joined.where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, *, host: str = "source", text: str = "text", min_pages: int = MIN_PAGES, ratio: float = RATIO,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped", groups: DataFrame | None = None, sent_lines: int = SENT_LINES,
) -> DataFrame:
    """All rows and columns of docs with the text without boilerplate lines, and two counts (of that name, replaced)."""
    docs = docs.drop(n_lines, n_dropped)
    found = flat.written(boilerplate(docs, host=host, text=text, min_pages=min_pages, ratio=ratio, groups=groups))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    size = found.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0)).alias("n")).first().n
    joined = _sent(rows, found) if size <= sent_lines else _dealt(rows, found, task_count(docs))
    lines = joined.withColumn("lines", F.split("text", "\n"))
    kept = lines.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: (line == "") | ~F.array_contains("gone", F.xxhash64(line)))
    ))
    cut = F.when(F.size("kept") == F.size("lines"), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return kept.select(*(cut.alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias(n_lines),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias(n_dropped),
    )


def _sent(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `gone`, the boilerplate of their host; its size was checked."""
    found = F.broadcast(found.select(F.col("host").alias("of"), F.col("lines").alias("gone")))
    return rows.join(found, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")


def _dealt(rows: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The same by a shuffle. Hosts with more than one part of all rows are dealt out; there are fewer than `parts`."""
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("n") * parts > total).select(F.col("host").alias("of"), F.lit(parts).alias("parts")))
    same = F.col("host").eqNullSafe(F.col("of"))
    salted = rows.join(hot, same, "left").drop("of").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("parts")
    spread = (
        found.join(hot, same, "left").drop("of")
        .select(F.col("host").alias("of"), F.col("lines").alias("gone"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    )
    return salted.join(spread, same & (F.col("salt") == F.col("part")), "left").drop("of", "part", "salt")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


SQL = f"""
WITH pages AS (
  SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL
), totals AS (
  SELECT source, count(*) AS pages FROM pages GROUP BY source
), lines AS (
  SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages
), gone AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.n >= {MIN_PAGES} AND l.n > {RATIO} * t.pages
), per_source AS (
  SELECT source, list(line) AS lines FROM gone GROUP BY source
), cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS was,
         list_filter(string_split(d.text, chr(10)), lambda x: p.lines IS NULL OR NOT list_contains(p.lines, x)) AS kept
  FROM documents d LEFT JOIN per_source p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       coalesce(len(was), 0) AS n_lines, coalesce(len(was) - len(kept), 0) AS n_dropped
FROM cut
"""
