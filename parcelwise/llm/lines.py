"""Boilerplate lines by their frequency on a host's pages. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def boilerplate(documents: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): for each host the hashes of the lines that stand on more than ``max_ratio`` of its pages, and on ``min_pages`` at least.

    A host has at most (its lines a page / ``max_ratio``) of them, however many pages.
    """
    pages = documents.select(F.col(host).alias("host"), F.array_distinct(F.transform(content_lines(F.col(text)), lambda x: F.xxhash64(x))).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > max_ratio * F.col("pages"))
    return common.groupBy("c.host").agg(F.collect_list("line").alias("lines"))


def all_lines(text):
    return F.split(text, "\n", -1)


def content_lines(text):
    """Lines without spaces at their ends, blank ones left out."""
    return F.filter(F.transform(all_lines(text), F.trim), lambda x: x != "")


def cleaned(documents: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(row, n_lines, n_dropped): each row of ``documents`` as a struct with its text less its boilerplate lines, its lines that aren't blank, and those dropped.

    A line is dropped if it stands on more than ``max_ratio`` of its host's pages and on ``min_pages`` at least: a share
    of fewer pages tells nothing. A page is a row, so repeated rows count as pages each; a line counts once a page,
    compared without spaces at its ends; a page of such lines alone is left empty but for its blank lines, which stay. A
    null text stays null and counts as a page without lines; pages of a null host form a host of their own. An empty
    table gives an empty one. All other columns stay as they are, whatever their names.
    """
    found = written(boilerplate(documents, host, text, max_ratio, min_pages).select("host", F.col("lines").alias("common")), "boilerplate")
    held = found.agg(F.sum(8 * F.size("common") + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    own = F.col(f"row.`{text}`")
    marked = rows.join((F.broadcast(found) if held < broadcast_bytes else found), F.col(f"row.`{host}`").eqNullSafe(F.col("host")), "left")
    kept = F.filter(all_lines(own), lambda x: (F.trim(x) == "") | ~F.array_contains("common", F.xxhash64(F.trim(x))))
    marked = marked.select("row", F.when(F.col("common").isNotNull(), F.array_join(kept, "\n")).otherwise(own).alias("kept"))
    lines = lambda c: F.coalesce(F.size(content_lines(c)), F.lit(0)).cast("long")
    row = F.struct(*[(F.col("kept") if c == text else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
    return marked.select(row.alias("row"), lines(own).alias("n_lines"), (lines(own) - lines(F.col("kept"))).alias("n_dropped"))


def drop_boilerplate(documents: DataFrame, **options) -> DataFrame:
    """``documents``, all columns, with ``text`` less its boilerplate lines as ``cleaned`` finds them."""
    return cleaned(documents, **options).select("row.*")


DROP_BOILERPLATE_SQL = """
WITH lines AS (
  SELECT doc_id, source, u.pos, u.line, trim(u.line, ' ') AS content
  FROM (SELECT doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents) d,
       LATERAL (SELECT z[1] AS line, z[2] AS pos) u),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
common AS (
  SELECT l.source, l.content FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.content <> ''
  GROUP BY l.source, l.content, t.pages HAVING count(DISTINCT l.doc_id) >= 5 AND count(DISTINCT l.doc_id) > 0.1 * t.pages),
marked AS (
  SELECT l.*, c.content IS NOT NULL AS common FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.content = c.content),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE content <> '') AS n_lines, count(*) FILTER (WHERE common) AS n_common,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT common) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(s.n_lines AS BIGINT) AS n_lines,
       CAST(s.n_common AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(s.kept, '') END AS text
FROM documents d JOIN sums s USING (doc_id)
"""
