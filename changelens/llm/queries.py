"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import best_fit, conversation_repair, cost_pack, decontam, exact_dedup, fixity, hilbert, ngram_join, pii, quality, site_lines, url_filter, whitening
from changelens.llm.tables import cut, read

#: The rules of the URL query.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Hosts with one of these words are the source of the listed URLs.
LISTED_HOSTS = "casino|pills|spam|bets"

DOCUMENT_DIMS = (
    hilbert.Dimension("source", "category"),
    hilbert.Dimension("lang", "category"),
    hilbert.Dimension("size", "log"),
)


def damaged_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages' archives, 512 ids to an archive.  By the
    digest of its id a record in 37 is changed in the second, one is lost there
    and one is lost in the first."""
    number = F.coalesce("page_id", -1 - F.abs(F.xxhash64("url", "html") / 2).cast("long"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % 37
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    other = F.concat(F.translate(F.substring(html, 1, 1), "<", "("), F.substring(html, 2, 1 << 30))
    rows = pages.select(
        F.floor(number / 512).cast("long").alias("archive"),
        number.alias("number"),
        draw.alias("draw"),
        fixity.warc_record(url, html).alias("record"),
        fixity.digest(fixity.warc_record(url, html)).alias("digest_a"),
        fixity.digest(fixity.warc_record(url, F.when(draw == 1, other).otherwise(html))).alias("digest_b"),
    )
    index = cut(fixity.lay_out(rows, "archive", [F.col("number"), F.col("digest_a")], "record"), "warc-index")
    a = index.where("draw != 3").select("archive", "offset", F.col("digest_a").alias("digest"))
    b = index.where("draw != 2").select("archive", "offset", F.col("digest_b").alias("digest"))
    return a, b


def op1_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged records of two replicas of ``pages`` as archives."""
    return fixity.audit(*damaged_replicas(read(spark, folder, "pages")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` judged by rules whose cutoffs ``labels`` certify by language."""
    judged = quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "stratum", "rejected_by")


def op3_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of ``pages`` without the lines that are common on their host."""
    pages = read(spark, folder, "pages").select(
        "page_id",
        url_filter.url_host(F.col("url")).alias("host"),
        site_lines.html_lines(F.col("html")).alias("text"),
    )
    return site_lines.drop_site_lines(pages, "host")


def op4_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` in sequences of 1,024 tokens and of even cost."""
    return cost_pack.pack(read(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of ``documents`` inside windows of ten words of ``benchmark`` items."""
    hits = decontam.scan(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and listed URLs over ``pages``; the list are the URLs of the pages
    on hosts with one of the listed words, in whichever form they were met."""
    pages = read(spark, folder, "pages")
    listed = pages.where(url_filter.url_host(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op7_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as packed id matrices of 1,024 columns."""
    return best_fit.pack(read(spark, folder, "documents"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in ``documents``, with their scores."""
    found = pii.find(read(spark, folder, "documents"))

    def joined(spans: Column) -> Column:
        texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(texts, ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[counted(kind) for kind in pii.BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of ``documents`` whose three-word shingles are 90 % alike."""
    params = ngram_join.JoinParams(words=3, percent=90)
    found = ngram_join.near_duplicates(read(spark, folder, "documents"), params)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` in 16 runs of the curve over source, language and size."""
    documents = read(spark, folder, "documents")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "source",
        "lang",
    )
    sharded = hilbert.shard_rows(rows, DOCUMENT_DIMS, ties=["doc_id", "text_crc32", "size"])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 16 whitened coordinates of ``embeddings``."""
    return whitening.whiten(read(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by the checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of ``conversations``, damaged by plan."""
    whole = read(spark, folder, "conversations")
    found = conversation_repair.repair(damaged_conversations(whole))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = [F.lit(None).cast("long").alias(c) for c in counts]
    parts = found.conversations.select("conv", *counts, "audit", F.lit(None).cast("string").alias("sha256"))
    hashes = conversation_repair.digests(found.rows).select("conv", *empty, F.lit(None).cast("string").alias("audit"), "sha256")
    ids = whole.select(F.col("conv_id").alias("conv"), *empty, F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("sha256"))
    every = parts.unionByName(hashes).unionByName(ids).groupBy("conv")
    return every.agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    ).withColumnRenamed("conv", "conv_id")


def op13_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with the row that stays of each group of equal texts."""
    found = exact_dedup.exact_duplicates(read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_quality_rules": op2_quality_rules,
    "op3_site_lines": op3_site_lines,
    "op4_cost_packing": op4_cost_packing,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit": op7_best_fit,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tree_dedup": op13_tree_dedup,
}
