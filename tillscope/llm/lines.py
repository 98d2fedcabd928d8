"""Line dedup by site-relative frequency.

A line is boilerplate of a site if a large share of the site's pages hold it. Pages are
counted by host and line, divided by the host's pages, and lines above the ratio are dropped.
As a page has a bounded number of lines, a host has at most (lines per page) / ratio such
lines: they are kept as one list per host and filtered out of each page in place, so texts are
neither exploded again nor put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, written

RATIO = 0.1      # share of a host's pages above which a line is boilerplate
LEAST_PAGES = 3  # pages of the host that must hold it
UNLIKE = 0.3     # share of unlike pages among those that hold it, where these are asked for


def lines_of_text(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines_of_html(html: Column) -> Column:
    """The texts between tags; scripts, styles and comments have none."""
    bare = F.regexp_replace(
        F.coalesce(html, F.lit("")),
        "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "<>")
    return F.filter(F.transform(F.split(bare, "<[^>]*>"), lambda x: F.trim(x)),
                    lambda x: x != "")


def boilerplate(pages: DataFrame, lines: Column, host: str, ratio: float = RATIO,
                least: int = LEAST_PAGES, unlike: bool = False) -> DataFrame:
    """``host`` and ``bad``, its boilerplate lines; one row per host that has any.

    A line counts once per page, trimmed; blank lines never count. A null host is a site like
    any other. Only sums by host and line are shuffled. ``unlike``: pages whose least line hash
    is the same, as copies of a page and most near copies have, count as one page for a line,
    and they must be ``UNLIKE`` of the pages that hold it; so a page that was copied often does
    not lose its lines. Sums by host, line and that hash are shuffled then.
    """
    slim = pages.select(F.col(host).alias("host"), F.array_distinct(F.transform(
        lines, lambda x: F.trim(x))).alias("lines"))
    totals = slim.groupBy("host").agg(F.count("*").alias("pages"))
    if unlike:
        slim = slim.withColumn("sign", F.array_min(F.transform("lines", lambda x: F.xxhash64(x))))
        counts = (slim.select("host", "sign", F.explode("lines").alias("line"))
                  .filter("line != ''").groupBy("host", "line", "sign").count()
                  .groupBy("host", "line")
                  .agg(F.count("*").alias("holding"), F.sum("count").alias("all"))
                  .filter(F.col("holding") >= F.lit(UNLIKE) * F.col("all")).drop("all"))
    else:
        counts = (slim.select("host", F.explode("lines").alias("line")).filter("line != ''")
                  .groupBy("host", "line").agg(F.count("*").alias("holding")))
    counts = counts.filter(F.col("holding") >= least)
    return (counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
            .filter(F.col("holding") > F.lit(ratio) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("line").alias("bad")))


def dropped(pages: DataFrame, lines: Column, host: str, kept: str = "kept",
            count: str = "dropped", ratio: float = RATIO, least: int = LEAST_PAGES,
            unlike: bool = False) -> DataFrame:
    """``pages`` with ``kept``, their lines without boilerplate, and ``count`` of lines dropped;
    columns of those names are replaced.

    Null texts have no line; a page whose lines all go keeps an empty list and stays a row.
    Repeated rows count as pages of their own; an empty table gives no rows.
    """
    bad = written(boilerplate(pages, lines, host, ratio, least, unlike))
    name, own = fresh("bad", pages), fresh("own", pages)
    bad = bad.withColumnRenamed("bad", name).withColumnRenamed("host", own)
    out = (pages.join(bad, F.col(host).eqNullSafe(F.col(own)), "left").drop(own)
           .withColumn(own, lines))
    clean = F.when(F.col(name).isNull(), F.col(own)).otherwise(
        F.filter(own, lambda x: ~F.array_contains(F.col(name), F.trim(x))))
    return (out.withColumn(kept, clean)
            .withColumn(count, F.size(own) - F.size(kept)).drop(name, own))


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", chars: str = "n_chars",
            **options) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text`` and ``chars`` counted anew.

    Same columns and rows; a text without such lines stays as it is, null included.
    """
    kept, count = fresh("kept", docs), fresh("dropped", docs)
    out = dropped(docs, lines_of_text(F.col(text)), host, kept, count, **options)
    changed = F.col(count) > 0
    out = out.withColumn(text, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text)))
    if chars in docs.columns:
        out = out.withColumn(chars, F.when(changed, F.char_length(text).cast("long"))
                             .otherwise(F.col(chars)))
    return out.select(*docs.columns)
