"""Line deduplication by how many pages of a site have a line; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.sources import scratch
from veridoc.sources.tables import table

#: A line is boilerplate if more than this share of its host's pages have it, and at least so many of them.
RATIO, PAGES = 0.2, 2
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BREAKS = r"(?i)<(br|hr|/?(p|div|li|ul|ol|nav|article|section|header|footer|main|aside|form|pre|blockquote|h[1-6]|title|tr|td|th|table|body|head|html))([ \t\r\n/][^>]*)?>"
TAGS, SPACE, HOST = r"<[^>]*>", r"[ \t\r\n\x0B\f]+", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)"


def lines_of(html):
    """The text lines of a page: block tags end lines, other tags vanish, white space is trimmed; no empty lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "[\r\n]+", " "), HIDDEN, ""), BREAKS, "\n")
    cut = F.transform(F.split(F.regexp_replace(text, TAGS, ""), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.coalesce(F.filter(cut, lambda x: x != ""), F.array().cast("array<string>"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """``page_id``, ``host``, ``n_lines``, ``n_dropped`` and ``text`` (the other lines, in order) of each row.

    Each row counts as a page, also a repeated one. Hosts are in lower case; a url that is null or has none belongs to
    host ''. A null html has no lines and an empty text. What is counted is a digest of each line, once a page; the
    counts are summed before the shuffle, so a line that very many pages share is few rows. At most mean lines a page /
    ratio lines of a host are boilerplate, so a host's set of them stays small however many pages it has. On a host of
    under five pages one page is over the ratio by itself, so a line must be on ``least`` pages too, on any host; a page that is
    alone on its host stays whole. A very long page is one row; an empty table stays empty; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.nullif(F.regexp_extract(F.col("url"), HOST, 2), F.lit(""))), F.lit(""))
    base = scratch.keep(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    digest = lambda x: F.unhex(F.md5(x))
    total = base.groupBy("host").agg(F.count("*").alias("pages"))
    counted = base.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", digest(F.col("line")).alias("digest")).agg(F.count("*").alias("n"))
    frequent = scratch.keep(counted.join(total, "host").filter((F.col("n") > ratio * F.col("pages")) & (F.col("n") >= least)).groupBy("host").agg(F.collect_set("digest").alias("drop")), "boilerplate")
    joined = base.join(frequent, "host", "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), digest(x))))
    size = lambda c: F.size(c).cast("long")
    return joined.select("page_id", "host", size("lines").alias("n_lines"), kept.alias("kept")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without their hosts' boilerplate lines."""
    return without_boilerplate(table(spark, sf_dir, "pages"))


OP2_SQL = rf"""
WITH cut AS (
  SELECT page_id, coalesce(lower(nullif(regexp_extract(url, '{HOST}', 2), '')), '') AS host,
    coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\r\n]+', ' ', 'g'), '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '{SPACE}', ' ', 'g'))), lambda x: x <> ''), []) AS lines
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
freq AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line),
bad AS (SELECT f.host, list(line) AS drop_lines FROM freq f JOIN total t ON f.host = t.host WHERE n >= {PAGES} AND n > {RATIO}::DOUBLE * pages GROUP BY f.host),
kept AS (SELECT page_id, cut.host, lines, CASE WHEN drop_lines IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drop_lines, x)) END AS k FROM cut LEFT JOIN bad ON cut.host = bad.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(k) AS BIGINT) AS n_dropped, array_to_string(k, chr(10)) AS text FROM kept
"""
