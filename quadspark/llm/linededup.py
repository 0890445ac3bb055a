"""Line dedup: a line on too large a share of its site's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, unused


def _key(line: Column) -> Column:
    """128 bits for a line without its outer spaces; lines, not keys, would double what is shuffled."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def drop_boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """Drops lines found on more than `max_ratio` of their host's pages, and on `min_pages` pages at least.

    A page is a distinct text of its host, so copies of one page do not make its lines boilerplate, and it counts once for
    a line however often it has it.  Lines are equal if they are without outer spaces; blank lines always stay.  Null
    hosts are one host; a null text is no page, stays null and has no lines; an empty text is one blank line.  Returns a
    row for each row, with the input's columns, the text cleaned, and n_lines and n_dropped (in place of such columns).

    The default of 5 % lies well under what menus and notices reach (a tenth of a site's pages and more) and well over what
    quoted passages do (under 1 % in the test tables); two pages are the least on which a line is repeated at all.

    Each host has at most (mean lines a page) / max_ratio such lines, which bounds the arrays that meet the pages; texts are
    moved only if the table of all hosts' lines is too large to broadcast.
    """
    ws = Workspace(docs.sparkSession, "linededup")
    lines = F.split(F.col(text_col), "\n", -1)
    own, drop_, kept_ = (unused(docs, c) for c in ("host", "drop", "kept"))
    page = F.xxhash64(F.col(text_col))
    pages = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("h"), page.alias("page"), F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _key)).alias("keys"))
    totals = pages.select(F.col("h").alias("host"), "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = pages.select("h", "page", F.explode("keys").alias("k")).select("h", "k.a", "k.b", "page").distinct()
    counts = each.groupBy("h", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= min_pages).join(totals, F.col("h").eqNullSafe(F.col("host"))).where(F.col("n") > F.lit(float(max_ratio)) * F.col("pages"))
    drop = ws.table(often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("drop")), "boilerplate")
    drop = drop.select(F.col("host").alias(own), F.col("drop").alias(drop_))
    out = docs.drop("n_lines", "n_dropped").join(drop, F.col(host_col).eqNullSafe(F.col(own)), "left")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.coalesce(F.col(drop_), F.array().cast("array<struct<a:bigint,b:bigint>>")), _key(x)))
    out = out.withColumn(kept_, F.when(F.col(drop_).isNull(), lines).otherwise(kept))
    n = F.coalesce(F.size(F.when(F.col(text_col).isNotNull(), lines)), F.lit(0))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long")
    n_kept = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(kept_)).cast("long")
    out = out.withColumns({"n_lines": n_lines, "n_dropped": n_lines - n_kept, text_col: F.array_join(kept_, "\n")})
    return out.drop(drop_, own, kept_)
