"""Removal of boilerplate lines that many sites share.

Each line's hash gathers a HyperLogLog sketch of the sites it stands on; sketches are made
per task and merged by the aggregation, so a line that fills a third of the corpus reaches its
reducer as one row per task.  Sketches decide clear cases; lines whose estimate lies within the
sketch's error of the threshold get an exact distinct count.  A line on at least ``min_sites``
sites is boilerplate: its first occurrence (least ``doc_id``, then line number) stays, all
others go.

Defined cases: a null or empty text has no lines and stays as it is; a line without a word is never
removed; lines are compared without the blanks at their ends; a null site counts for no site;
rows with an equal ``doc_id``, or without one, count as one document whose first occurrences all stay; each text is
edited by itself, so that its lines alone meet in one task; a very long text is as many lines as it has;
an empty table gives no rows; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import materialize

MIN_SITES = 10
LG_K = 10
#: Four standard errors of a sketch of 2**LG_K registers.
BAND = 4 * 1.04 / 2 ** (LG_K / 2)
_ENDS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _occurrences(docs: DataFrame, site: str) -> DataFrame:
    """(h1, h2, doc, text_key, line_no, site) of each line that has a word."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), F.col(site).cast("string").alias("site"), F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    bare = F.trim(F.col("line"), F.lit(_ENDS))
    rows = rows.select("doc", "text_key", "site", "line_no", bare.alias("line")).filter(F.length("line") > 0)
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc", "text_key", "line_no", "site")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(h1, h2, first): lines on at least ``min_sites`` sites and where each stands first."""
    found = _occurrences(docs, site)
    place = F.struct(F.col("doc"), F.col("line_no"))
    summed = found.groupBy("h1", "h2").agg(
        F.count("site").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first")
    )
    # A line on `min_sites` sites occurs at least as often; rarer ones need no estimate.
    seen = materialize(
        summed.filter(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites"
    ) if min_sites > 1 else materialize(summed.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    sure = seen.filter(F.col("sites") > high)
    near = seen.filter((F.col("sites") >= low) & (F.col("sites") <= high))
    # The pairs are made distinct per task before they are moved.
    pairs = found.filter(F.col("site").isNotNull()).join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("one").alias("exact")).filter(F.col("exact") >= min_sites)
    return sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(row, text, n_lines, n_removed): the input's columns as one struct, and the text rid of boilerplate lines."""
    spread = materialize(boilerplate(docs, min_sites, site), "boilerplate")
    gone = (
        _occurrences(docs, site)
        .join(spread, ["h1", "h2"])
        .filter(~F.struct(F.col("doc"), F.col("line_no")).eqNullSafe(F.col("first")))
        .groupBy("doc", "text_key")
        .agg(F.collect_set(F.struct("line_no", "h1")).alias("gone"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["doc"]) & (rows["key"] == gone["text_key"]), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), F.xxhash64(F.trim(line, F.lit(_ENDS))).alias("h1"), line.alias("line"))),
        lambda x: ~F.array_contains(F.col("gone"), F.struct(x["line_no"], x["h1"])),
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    whole = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    rest = F.when(F.col("gone").isNull(), whole).otherwise(F.size(kept).cast("long"))
    return joined.select("row", text.alias("text"), whole.alias("n_lines"), (whole - rest).alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal, and how many lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("row.doc_id", "n_lines", "n_removed", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of boilerplate lines; ``n_chars`` follows the text."""
    found = drop_boilerplate(docs)
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


LINES_SQL = f"""
line_rows AS (
  SELECT doc_id, source, i - 1 AS line_no, trim(l[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, l[i] AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {{docs}})),
spread AS (
  SELECT line, min({{{{'d': doc_id, 'n': line_no}}}}) AS first FROM line_rows
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
line_texts AS (
  SELECT r.doc_id, count(*) AS n_lines,
         count(*) FILTER (WHERE s.line IS NOT NULL AND s.first <> {{{{'d': r.doc_id, 'n': r.line_no}}}}) AS n_removed,
         string_agg(CASE WHEN s.line IS NOT NULL AND s.first <> {{{{'d': r.doc_id, 'n': r.line_no}}}} THEN NULL ELSE raw END, chr(10) ORDER BY line_no) AS text
  FROM line_rows r LEFT JOIN spread s ON r.line = s.line GROUP BY r.doc_id)
"""
ORACLE_SQL = "WITH " + LINES_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM line_texts"
