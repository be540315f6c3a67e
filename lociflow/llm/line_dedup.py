"""Boilerplate lines by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import hash_pair
from lociflow.sources.shared import written


def _key(line: Column) -> Column:
    return F.trim(line)


def _line_hash(line: Column) -> Column:
    """128 bits of a line without its surrounding spaces; null for a blank one."""
    first, second = hash_pair(_key(line))
    return F.when(_key(line) != "", F.struct(first.alias("h1"), second.alias("h2")))


def drop_boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = 0.05, min_pages: int = 20, counts: bool = True) -> DataFrame:
    """docs with the lines removed that more than `ratio` of their host's pages contain.

    A host's rows with equal texts are one page of it, so that copies don't make boilerplate of what they say; a page counts once for each of its distinct lines,
    compared without surrounding spaces. Hosts with fewer than `min_pages` pages lose nothing. All columns are kept in order, with
    `text_col` rewritten; with `counts`, `n_lines` and `n_dropped` come last (replacing input columns so named).

    Defined cases: a null text stays null with 0 lines; a null host is no host, so its pages stay as they are;
    blank lines are never boilerplate; repeated rows count once and all lose the same lines; rows that share
    an id are told apart by host and text; an empty table gives an empty table.

    `docs` is evaluated once, into a table of its rows and their lines' 128-bit hashes, so it may hold dear expressions; counting and matching read the hashes only.
    Pages are told apart by line and page, then counted in each task first, so a line that a third of all
    pages hold reaches its counter once per task. Only occurrences of boilerplate go on to be collected, by page.
    """
    k0, k1 = hash_pair(F.col(text_col))
    table = written(docs.select(F.struct(*docs.columns).alias("_row"), F.col(host_col).alias("_host"), F.col(id_col).alias("_id"), k0.alias("_k0"), k1.alias("_k1"), F.transform(F.split(F.col(text_col), "\n"), _line_hash).alias("_lines")), "lines")
    page = ["_host", "_id", "_k0", "_k1"]
    rows = table.where(F.col("_host").isNotNull() & F.col("_lines").isNotNull())
    held = rows.select(*page, F.explode(F.array_distinct("_lines")).alias("_h")).where(F.col("_h").isNotNull()).select(*page, "_h.h1", "_h.h2")
    pages = rows.groupBy("_host").agg(F.count_distinct("_k0", "_k1").alias("_pages")).where(F.col("_pages") >= min_pages)
    common = held.groupBy("_host", "h1", "h2").agg(F.count_distinct("_k0", "_k1").alias("_n")).where(F.col("_n") > 1).join(pages, "_host").where(F.col("_n") > F.col("_pages") * F.lit(ratio)).select("_host", "h1", "h2")
    dropped = held.join(common, ["_host", "h1", "h2"]).groupBy(*page).agg(F.collect_set(F.struct("h1", "h2")).alias("_drop")).select("_drop", *[F.col(c).alias(f"{c}_") for c in page])

    joined = table.join(dropped, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in page], "left")
    split = F.split(F.col("_row")[text_col], "\n")
    stays = lambda x, i: F.get("_lines", i).isNull() | ~F.array_contains(F.col("_drop"), F.get("_lines", i))
    made = joined.select("_row", F.size("_lines").alias("_n"), F.when(F.col("_drop").isNull(), split).otherwise(F.filter(split, stays)).alias("_kept"))
    whole = F.col("_kept").isNotNull()
    own = [F.when(whole, F.array_join("_kept", "\n")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    n = F.when(whole, F.col("_n")).otherwise(0)
    return made.select(*own, *([n.alias("n_lines"), F.when(whole, F.col("_n") - F.size("_kept")).otherwise(0).alias("n_dropped")] if counts else []))


#: Tags that do not end a line, and what of a page is no text.
INLINE, UNSEEN = r"(?i)</?(a|b|i|em|strong|span)(\s[^>]*)?>", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"


def page_lines(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, host (lower case; null without one), text: a line for each block of the page."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", UNSEEN, "\n"), INLINE, ""), "<[^>]*>", "\n")
    text = F.trim(F.regexp_replace(text, r"[ \t\r]*\n[ \t\r\n]*", "\n"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    return pages.select("page_id", F.when(host != "", host).alias("host"), text.alias("text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """pages without their sites' boilerplate: page_id, host, text, n_lines, n_dropped."""
    return drop_boilerplate_lines(page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id", "text", "host", ratio=0.2, min_pages=5)


ORACLE_SQL = r"""
WITH t AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', chr(10), 'g'), '(?i)</?(a|b|i|em|strong|span)(\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS raw
  FROM pages),
p AS (SELECT page_id, host, trim(regexp_replace(raw, '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), ' ') AS text FROM t),
h AS (SELECT DISTINCT host, text, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM p WHERE host IS NOT NULL),
n AS (SELECT host, count(DISTINCT text) AS pages FROM p WHERE host IS NOT NULL GROUP BY host HAVING count(DISTINCT text) >= 5),
c AS (SELECT h.host, line FROM h JOIN n ON h.host = n.host GROUP BY h.host, line HAVING count(*) > 1 AND count(*) > 0.2 * any_value(pages)),
b AS (SELECT host, list(line) AS bad FROM c GROUP BY host),
k AS (SELECT p.page_id, p.host, string_split(text, chr(10)) AS ls, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, ' '))) AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, CAST(len(ls) AS INT) AS n_lines, CAST(len(ls) - len(kept) AS INT) AS n_dropped FROM k
"""
