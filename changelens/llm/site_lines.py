"""Line removal by how common a line is on its own site.

A line's frequency is the share of its site's pages that contain it; lines
above a ratio are boilerplate and are dropped.  Counts go by (site, line) with
partial sums, so a large site is not one task's.  Everything is DataFrame
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.tables import cut, fresh, put_back, set_apart

SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class SiteParams:
    """Lines on more than ``max_ratio`` of a site's pages go if they are on
    ``min_line_pages`` of them at least, whatever the site's size: on fewer a
    line's share says nothing.  Boilerplate of all sites together up to
    ``broadcast_bytes`` is sent to all executors; more is joined by shuffling,
    with each site dealt to ``salts`` parts."""

    max_ratio: float = 0.1
    min_line_pages: int = 3
    broadcast_bytes: int = 32 << 20
    salts: int = 64


def line_key(line: Column) -> Column:
    """Digest of the line without white space around it."""
    return F.unhex(F.md5(F.btrim(line, F.lit(SPACES)).cast("binary")))


def _keys(text: Column) -> Column:
    """Distinct digests of a text's lines, blank ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    filled = F.array_distinct(F.filter(lines, lambda x: x != ""))
    return F.transform(filled, lambda x: F.unhex(F.md5(x.cast("binary"))))


def boilerplate(pages: DataFrame, site: Column, text: Column, params: SiteParams = SiteParams()) -> DataFrame:
    """``site, line_key, n_pages, site_pages`` of the lines to drop."""
    rows = pages.select(site.alias("site"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("site").isNotNull())
    totals = rows.groupBy(F.col("site").alias("total_site")).agg(F.count("*").alias("site_pages"))
    counts = (
        rows.select("site", F.explode(_keys(F.col("text"))).alias("line_key"))
        .groupBy("site", "line_key")
        .agg(F.count("*").alias("n_pages"))
        # what is left is thin
        .where(F.col("n_pages") >= params.min_line_pages)
    )
    return (
        counts.join(totals, F.col("site") == F.col("total_site"))
        .where(F.col("n_pages") > params.max_ratio * F.col("site_pages"))
        .select("site", "line_key", "n_pages", "site_pages")
    )


def drop_site_lines(
    pages: DataFrame,
    site_col: str,
    text_col: str = "text",
    params: SiteParams = SiteParams(),
) -> DataFrame:
    """The rows, their text without the site's boilerplate lines, and
    ``n_lines, n_dropped`` (long, of lines with more than white space).

    No row is dropped.  A null text stays null, an empty one empty; rows
    without a site stay as they are; blank lines stay; a line
    repeated within a page counts once for the page, and all its copies go;
    repeated rows count as pages each.  Table columns of the added names are
    replaced.
    """
    pages = pages.drop(*[c for c in ("n_lines", "n_dropped") if c not in (site_col, text_col)])
    found = cut(boilerplate(pages, F.col(site_col), F.col(text_col), params), "site-lines")
    site, keys, salt, lines = fresh(pages, "boiler_site", "boiler_keys", "boiler_salt", "boiler_lines")
    # a site's list has at most (lines a page) / max_ratio entries, fewer with a floor on a line's pages
    by_site = found.groupBy(F.col("site").alias(site)).agg(F.collect_list("line_key").alias(keys))
    if found.agg(F.coalesce(F.sum(F.octet_length("site") + 48), F.lit(0))).first()[0] <= params.broadcast_bytes:
        joined = pages.join(F.broadcast(by_site), F.col(site_col) == F.col(site), "left")
    else:
        parts = F.array(*[F.lit(i) for i in range(params.salts)])
        dealt = by_site.withColumn(salt + "_", F.explode(parts))
        part = F.pmod(F.xxhash64(text_col), F.lit(params.salts)).cast("int")
        joined = (
            pages.withColumn(salt, part)
            .join(dealt, (F.col(site_col) == F.col(site)) & (F.col(salt) == F.col(salt + "_")), "left")
            .drop(salt, salt + "_")
        )
    split = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
        lambda x: F.struct(
            x.alias("line"),
            (F.btrim(x, F.lit(SPACES)) != "").alias("filled"),
            F.coalesce(F.array_contains(F.col(keys), line_key(x)), F.lit(False)).alias("common"),
        ),
    )
    kept = F.transform(F.filter(lines, lambda x: ~x["common"]), lambda x: x["line"])
    n_dropped = F.size(F.filter(lines, lambda x: x["common"]))
    return (
        joined.withColumn(lines, split)
        .withColumn("n_lines", F.size(F.filter(lines, lambda x: x["filled"])).cast("long"))
        .withColumn("n_dropped", n_dropped.cast("long"))
        .withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
        .select(*pages.columns, "n_lines", "n_dropped")
    )


def clean_texts(pages: DataFrame, site_col: str, text_col: str = "text", params: SiteParams = SiteParams()) -> DataFrame:
    """The rows with their own columns, texts as of ``drop_site_lines``."""
    apart, own = set_apart(pages)
    site, text = own[pages.columns.index(site_col)], own[pages.columns.index(text_col)]
    return put_back(drop_site_lines(apart, site, text, params), own, pages.columns)


def html_lines(html: Column) -> Column:
    """Text of a page, a line for each block; scripts and styles left out."""
    quiet = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    blocks = F.regexp_replace(
        quiet,
        r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|hr|nav|header|footer|main|article|section|table|tr|td|title|head|body|html)\b[^>]*>",
        "\n",
    )
    return F.regexp_replace(blocks, r"<[^>]*>", "")
