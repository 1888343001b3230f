"""Line dedup by site-relative frequency: a line that is on more than a given share of a site's pages is
boilerplate of that site and is dropped from its pages.

The share is taken over the site's *distinct* pages: copies of one text are one page, so a page that was crawled
many times doesn't turn its own lines into boilerplate. Lines are compared after trimming blanks; blank lines are
never dropped. The share decides at every site size; a line must only be on two distinct pages at least
(:data:`MIN_PAGES`), as a line of one page repeats nowhere on its site.

Counting moves hashes only (host, 128-bit line hash, page hash) with partial aggregation, so a line or host that
holds a third of all rows adds one row a task to a group. A site has at most (mean lines a page) / RATIO
boilerplate lines; these short lists are joined to the pages by host, broadcast only if the planner finds the
written table small, else as a sort-merge join whose hot host AQE splits.

Null text stays null. A null host is no site: such pages stay as they are. Empty texts, repeated rows and an
empty table are kept as they are. All columns of the input are returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import written

#: Share of a site's distinct pages above which a line is boilerplate; distinct pages it must be on at least.
RATIO, MIN_PAGES = 0.08, 2
_HOST, _BAD, _OLD = "__site_host", "__site_lines", "__site_text"


def url_host(url: Column) -> Column:
    """The lower-cased host of a URL, for tables of web pages; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hash(line: Column) -> Column:
    """128 bits of a line, as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs(text) → host, lines array<struct<a, b>>: the hashes of each site's boilerplate lines."""
    pages = docs.select(host.alias("host"), F.xxhash64("text").alias("page"), F.xxhash64(F.lit("page"), "text").alias("page2"),
                        F.transform(F.array_distinct(F.transform(_lines(F.col("text")), _trimmed)), _hash).alias("lines"),
                        ).filter("host IS NOT NULL AND lines IS NOT NULL")
    totals = (pages.select("host", "page", "page2").distinct().groupBy("host").agg(F.count("*").alias("total"))
              .filter(F.col("total") >= min_pages))
    on = (pages.select("host", "page", "page2", F.explode("lines").alias("l"))
          .select("host", "page", "page2", "l.a", "l.b").distinct()
          .groupBy("host", "a", "b").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages))
    blank = _hash(F.lit(""))
    return (on.join(totals, "host").filter(F.col("pages") / F.col("total") > ratio)
            .select("host", F.struct("a", "b").alias("line")).filter(F.col("line") != blank)
            .groupBy("host").agg(F.collect_set("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of docs, the text without its site's boilerplate lines (and n_chars, where there is such a
    column, as the length of a text that has changed)."""
    return counted(docs, host, ratio, min_pages).select(*[F.col(f"`{c}`") for c in docs.columns])


def counted(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Like :func:`drop_boilerplate`, and __n_lines, __n_dropped (long)."""
    bad = written(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    bad = bad.select(F.col("host").alias(_HOST + "2"), F.col("lines").alias(_BAD))
    own = docs.withColumn(_HOST, host)
    joined = own.join(bad, own[_HOST] == bad[_HOST + "2"], "left").withColumn(_OLD, F.col("text"))

    def stays(line: Column) -> Column:
        h = _hash(_trimmed(line))
        return ~F.array_contains(F.col(_BAD), h)

    kept = F.filter(_lines(F.col(_OLD)), stays)
    out = joined.withColumn("text", F.when(F.col(_BAD).isNull(), F.col(_OLD)).otherwise(F.array_join(kept, "\n")))
    n = F.coalesce(F.size(_lines(F.col(_OLD))), F.lit(0))
    left = F.when(F.col(_BAD).isNull() | F.col(_OLD).isNull(), n).otherwise(F.size(kept))
    out = out.withColumn("__n_lines", F.greatest(n, F.lit(0)).cast("long"))
    out = out.withColumn("__n_dropped", F.greatest(n - left, F.lit(0)).cast("long"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out


def oracle_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the query over documents, whose source is the site."""
    chars = "' ' || chr(9) || chr(13)"
    return f"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT DISTINCT source, text, lines FROM split WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
used AS (SELECT source, line, count(*) AS pages FROM (
    SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, {chars})))) AS line FROM pages)
    GROUP BY source, line),
bad AS (SELECT source, list(line) AS bad FROM used JOIN totals USING (source)
    WHERE line <> '' AND pages >= {min_pages} AND pages::DOUBLE / total::DOUBLE > {ratio} GROUP BY source),
done AS (SELECT doc_id, s.source, text, lines, bad,
    list_filter(lines, lambda x: NOT list_contains(bad, trim(x, {chars}))) AS kept
    FROM split s LEFT JOIN bad b ON s.source = b.source)
SELECT doc_id, source AS host, coalesce(len(lines), 0)::BIGINT AS n_lines,
    (CASE WHEN bad IS NULL OR text IS NULL THEN 0 ELSE len(lines) - len(kept) END)::BIGINT AS n_dropped,
    sha256(CASE WHEN text IS NULL THEN '' WHEN bad IS NULL THEN text
           ELSE array_to_string(kept, chr(10)) END) AS kept_sha256
FROM done
"""
