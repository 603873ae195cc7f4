"""Line dedup by site-relative frequency (operator 5), DataFrame functions only.

Pages containing a line are divided by the page total of their host; lines whose
ratio exceeds the boilerplate ratio are dropped from the host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A line is boilerplate if more than this share of its host's pages contain it. Known
#: license lines are on 8 to 13 % of a host's pages, and hardly any line is between 5 and 8 %...
RATIO = 0.05
#: ...and at least so many pages do, so that small hosts keep their lines.
MIN_PAGES = 5
#: Most boilerplate lines, over all hosts, that are broadcast; beyond it a join by (host, line).
BROADCAST_LINES = 200_000
#: Most of one host that each of its lines is compared with in turn; beyond it they are hashed.
HOST_LINES = 200


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, total) of the lines to drop.

    A line counts once for a page. Lines travel as 64-bit hashes; a page total has
    every row of the host, those without text too.
    """
    src = docs.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    total = src.groupBy("host").agg(F.count("*").alias("total"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), lambda x: F.xxhash64(x)))
    pages = src.select("host", F.explode(own).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages"))
    pages = pages.filter(F.col("pages") >= min_pages)
    t = total.select(F.col("host").alias("__h"), "total")
    return pages.join(t, F.col("host").eqNullSafe(F.col("__h"))).filter(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "line_hash", "pages", "total")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", length_col: str | None = None, count_col: str | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, host_lines: int = HOST_LINES) -> DataFrame:
    """All rows of ``docs`` with boilerplate lines cut from the text.

    Remaining lines keep their order and are joined by one line feed; lines without
    a word are never boilerplate. Null texts stay null, a text of boilerplate alone
    becomes empty. Rows without a host form a host of their own; repeated rows count
    as pages of their own. Texts of any length count whole, and lines on equally many pages
    are judged alike. ``length_col`` is set to the new number of code points,
    ``count_col`` names a column to add with the number of dropped lines; a column of that
    name is replaced. Other columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    found = scratch.table(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    few = scratch.rows(found) <= broadcast_lines
    if few and (found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) <= host_lines:
        per_host = F.broadcast(found.groupBy("host").agg(F.collect_list("line_hash").alias("__drop")).withColumnRenamed("host", "__host"))
        joined = docs.join(per_host, host.eqNullSafe(F.col("__host")), "left")
        gone = F.coalesce("__drop", F.array().cast("array<bigint>"))
        kept = F.filter(_lines(text), lambda x: ~F.array_contains(gone, F.xxhash64(x)))
        cut = joined.withColumn("__kept", F.when(F.size(gone) == 0, _lines(text)).otherwise(kept))
    else:
        rows = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        lines = rows.select("__row", host.alias("__host"), F.posexplode(_lines(text)).alias("__pos", "__line"))
        gone = found.select(F.col("host").alias("__h"), F.col("line_hash").alias("__lh"))
        gone = F.broadcast(gone) if few else gone
        left = lines.join(gone, F.col("__host").eqNullSafe(F.col("__h")) & (F.xxhash64("__line") == F.col("__lh")), "left_anti")
        texts = left.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__line"))), lambda x: x["__line"]).alias("__some"))
        cut = rows.join(texts, "__row", "left").withColumn("__kept", F.when(text.isNotNull(), F.coalesce("__some", F.array().cast("array<string>"))))
    new = F.array_join("__kept", "\n")
    made = {text_col: new.alias(text_col)}
    if length_col:
        made[length_col] = F.length(new).cast("long").alias(length_col)
    out = [made.get(c, F.col(f"`{c}`")) for c in docs.columns if not count_col or c.lower() != count_col.lower()]
    if count_col:
        out.append(F.when(text.isNotNull(), F.size(_lines(text)) - F.size("__kept")).otherwise(0).cast("long").alias(count_col))
    return cut.select(*out)


def drop_boilerplate_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return rf"""WITH lines AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
pages AS (
  SELECT source, line, count(*) AS pages
  FROM (SELECT source, unnest(list_distinct(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM lines)
  GROUP BY source, line),
gone AS (
  SELECT p.source, list(p.line) AS gone FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
  WHERE p.pages >= {min_pages} AND p.pages > {ratio} * t.total GROUP BY p.source),
cut AS (
  SELECT l.*, list_filter(l.parts, lambda x: NOT list_contains(coalesce(g.gone, []), x)) AS kept
  FROM lines l LEFT JOIN gone g ON l.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(parts) - len(kept) END AS BIGINT) AS n_dropped FROM cut"""
