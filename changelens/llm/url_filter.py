"""Judging URLs: rules per host and path, then a list of canonical URLs.

The list is summed up in a blocked Bloom filter: a URL's hash picks one block
of eight 64-bit words and one bit in each word, so a probe is one lookup by
block.  Possible hits go on to an exact join with the list, which removes the
false positives.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.tables import fresh

WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track a visit.
TRACKING = r"(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class BloomParams:
    """``keys_per_block`` of 512 bits; 40 give a false positive in about 300.

    A filter or list of up to ``broadcast_bytes`` is sent to all executors;
    larger ones are joined by shuffling.
    """

    keys_per_block: int = 40
    broadcast_bytes: int = 64 << 20


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without a ``www.`` or ``m.`` prefix, path without a closing slash
    or ``.html``, and the query without tracking parameters, sorted.

    Scheme and fragment do not count.  Null where the URL has no host.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    kept = F.array_join(parts, "&")
    short = F.regexp_replace(F.regexp_replace(path, r"(?s)/+\z", ""), r"(?s)\.html?\z", "")
    return F.when(
        host != "",
        F.concat(
            F.regexp_replace(host, r"(?s)^(www|m)\.", ""),
            short,
            F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
        ),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word, from a second hash, six bits of it for each."""
    mixed = F.xxhash64(key, F.lit("bits"))
    return [
        F.call_function(
            "shiftleft",
            F.lit(1).cast("long"),
            F.shiftrightunsigned(mixed, 6 * j).bitwiseAND(F.lit(63)).cast("int"),
        )
        for j in range(WORDS)
    ]


def build_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``block`` and words ``w0`` to ``w7``; blocks without a key have no row."""
    rows = keys.select(
        _block(F.col(key), n_blocks).alias("block"),
        *[b.alias(f"b{j}") for j, b in enumerate(_bits(F.col(key)))],
    )
    return rows.groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(WORDS)])


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    url_col: str = "url",
    listed_col: str = "url",
    params: BloomParams = BloomParams(),
) -> DataFrame:
    """The page rows and ``host, path, canonical_url, rule, maybe_listed,
    listed, verdict``.

    ``verdict`` is the longest fitting rule's, else ``block`` for a listed
    canonical URL and ``allow`` for others.  ``maybe_listed`` is the filter's
    answer, ``listed`` the exact one.

    A null URL, or one without ``://``, has empty host and path, no canonical
    URL and is allowed.  Repeated rows are judged alike, repeated list entries
    count once, an empty list blocks nothing.  Page columns of the names above
    are replaced.  A URL that a third of all rows share is one key of a join
    whose other side has one row, so the engine can split or broadcast it.
    """
    added = ("host", "path", "canonical_url", "rule", "maybe_listed", "listed", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]
    entries = (
        listed.select(
            canonical(F.col(listed_col), url_host(F.col(listed_col)), url_path(F.col(listed_col))).alias("listed_url")
        )
        .where(F.col("listed_url").isNotNull())
        .distinct()
    )
    n_listed, n_bytes = entries.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("listed_url")), F.lit(0))
    ).first()
    n_blocks = max(1, -(-n_listed // params.keys_per_block))
    ask_, block_, listed_, *words = fresh(pages, "asked_block", "bloom_block", "listed_url", *[f"w{j}" for j in range(WORDS)])
    bloom = build_filter(entries, "listed_url", n_blocks).toDF(block_, *words)
    entries = entries.withColumnRenamed("listed_url", listed_)
    if min(n_blocks, n_listed) * (WORDS + 1) * 8 <= params.broadcast_bytes:
        bloom = F.broadcast(bloom)
    small = n_bytes + 16 * n_listed <= params.broadcast_bytes

    url = F.col(url_col)
    rows = pages.select(
        *[F.col(c) for c in kept],
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        canonical(url, url_host(url), url_path(url)).alias("canonical_url"),
    )
    rule, rule_verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    found = F.lit(True)
    for j, bit in enumerate(_bits(F.col("canonical_url"))):
        found = found & (F.col(words[j]).bitwiseAND(bit) != 0)
    # a row without a canonical URL asks a block by its place, so they are not one key
    has_url = F.col("canonical_url").isNotNull()
    asked = F.when(has_url, _block(F.col("canonical_url"), n_blocks)).otherwise(F.monotonically_increasing_id() % n_blocks)
    probed = (
        rows.withColumn(ask_, asked)
        .join(bloom, F.col(ask_) == F.col(block_), "left")
        .withColumn("maybe_listed", has_url & F.coalesce(found, F.lit(False)))
        .drop(ask_, block_, *words)
    )
    if small:
        own = F.when(F.col("maybe_listed"), F.col("canonical_url"))
        exact = probed.join(F.broadcast(entries), own == F.col(listed_), "left")
    else:  # rows without a hit meet nothing: they stay where they are
        hits = probed.where("maybe_listed").join(entries, F.col("canonical_url") == F.col(listed_), "left")
        exact = hits.unionByName(probed.where("NOT maybe_listed").withColumn(listed_, F.lit(None).cast("string")))
    return exact.select(
        *kept,
        "host",
        "path",
        "canonical_url",
        rule.alias("rule"),
        "maybe_listed",
        F.col(listed_).isNotNull().alias("listed"),
        F.coalesce(
            rule_verdict,
            F.when(F.col(listed_).isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
        ).alias("verdict"),
    )
