"""Quality rules whose cutoffs are fixed by labelled holdouts.

Each rule compares one text statistic with a cutoff.  One fixed sequence of
steps takes the rules' cutoffs in turn, mildest first; a step's rules reject
together.  For each stratum the steps are tested in order: a step is certified
if, were it to reject more than the allowed share of good documents, so few
rejections among the distinct labelled good ones would be unlikely by the exact
binomial distribution.  The sequence ends at the first step that fails, so it
costs one test's error; the error is divided by the number of strata
(Bonferroni).  Of the certified steps the one that rejects most bad documents
less good ones is taken.  Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.llm.tables import cut, fresh, put_back, set_apart

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``statistic`` is above the cutoff; cutoffs mildest first."""

    name: str
    statistic: str
    cutoffs: tuple[float, ...]


#: Statistics are SQL over the columns of ``with_stats``; a document without
#: words has none and no rule rejects it.
RULES = (
    Rule("symbols", "n_symbols / n_words", (2.5, 1.5, 1.0, 0.7, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeats", "n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("capitals", "n_capitals / word_chars", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3)),
    Rule("exclamations", "n_exclamations / n_words", (1.5, 1.0, 0.75, 0.5, 0.3)),
    Rule("long_words", "word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 15.0)),
)


@dataclass(frozen=True)
class RiskParams:
    """At most ``max_false_rejection`` of a stratum's good documents that pass
    the base rules are lost to all others together, with probability ``1 -
    error`` over all strata."""

    max_false_rejection: float = 0.03
    error: float = 0.05
    min_words: int = 50
    max_repeat_percent: int = 50
    rules: tuple[Rule, ...] = RULES
    #: Labels up to this many rows are sent to all executors, else shuffled.
    broadcast_rows: int = 2_000_000

    @property
    def steps(self) -> list[tuple[int, float]]:
        """The fixed sequence, ``(rule, cutoff)``: each rule's mildest cutoff in
        turn, then each one's next; a step keeps those before it."""
        longest = max(len(r.cutoffs) for r in self.rules)
        return [(i, r.cutoffs[k]) for k in range(longest) for i, r in enumerate(self.rules) if k < len(r.cutoffs)]


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in order."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def sorted_windows(hashes: Column) -> Column:
    """(hash, place) by hash, so that equal windows stand together; empty where
    no window occurs twice."""
    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    none = F.array().cast("array<struct<h: bigint, p: int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs)).otherwise(none)


def covered_words(ordered: Column) -> Column:
    """Words inside windows that occur twice or more: the places of such
    windows, in order, each with the words that the one before has not."""
    n = F.size(ordered)
    again = F.filter(
        ordered,
        lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
        | ((i < n - 1) & (F.get(ordered, i + 1)["h"] == x["h"])),
    )
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["p"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals, n_exclamations`` (long) of whole texts.

    Words are runs of characters other than space and ``\\t`` to ``\\r``; a null
    or empty text has none.  Table columns of these names are replaced.
    """
    added = (*STATS, "n_lines", "n_capitals", "n_exclamations")
    words, lines, hashes, ordered, row = fresh(docs, "words", "lines", "hashes", "ordered", "row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.translate(text, SPACES, " " * len(SPACES))
    # a column for each step: the steps that the engine compiles then stay compiled
    steps = (
        docs.drop(*[c for c in added if c != text_col])
        .withColumns(
            {
                words: F.array_remove(F.split(flat, " "), ""),
                lines: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            }
        )
        .withColumn(hashes, window_hashes(F.col(words)))
        .withColumn(ordered, sorted_windows(F.col(hashes)))
    )
    stats = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered_words(F.col(ordered)),
        "n_lines": F.size(lines),
        "n_capitals": _count_of(text, CAPITALS),
        "n_exclamations": _count_of(text, "!"),
    }
    # the row number keeps the optimizer from moving a filter on statistics below
    # them, where it would repeat their work
    return (
        steps.withColumns({**{k: v.cast("long") for k, v in stats.items()}, row: F.monotonically_increasing_id()})
        .where(F.col(row) >= 0)
        .drop(words, lines, hashes, ordered, row)
    )


def base_failed(params: RiskParams) -> Column:
    return (F.col("n_words") < params.min_words) | (
        100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words")
    )


def log_gamma(x: Column) -> Column:
    """For x >= 1: Stirling's series eight places up, and back by the product."""
    up = x + 8.0
    series = (
        1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3))) + 1 / (1260 * F.pow(up, F.lit(5)))
        - 1 / (1680 * F.pow(up, F.lit(7)))
    )
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), by its terms from k downwards.

    After 10,000 terms the rest is replaced by a geometric series above it, so
    the value is never too small.  1 where k is at or above the mean.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(
        log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
        + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    )

    def shrink(i: Column) -> Column:
        return i * (1 - p) / ((nd - i + 1) * p)

    terms = 10_000
    steps = F.when(
        k >= 1, F.sequence(k.cast("long"), F.greatest(F.lit(1).cast("long"), k.cast("long") - terms + 1), F.lit(-1).cast("long"))
    ).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * shrink(i)).alias("term"), (a["sum"] + a["term"] * shrink(i)).alias("sum")
        ),
        lambda a: a["sum"]
        + F.when(k > terms, a["term"] * shrink(kd - terms) / (1 - shrink(kd - terms))).otherwise(0.0),
    )
    return F.when((n <= 0) | (kd >= nd * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def _value(rule: Rule) -> Column:
    return F.expr(rule.statistic.replace("/", "/ nullif(") + ", 0)")


def first_step(params: RiskParams) -> Column:
    """The first step of the sequence that rejects a document, null if none."""
    found = [F.when(_value(params.rules[i]) > cutoff, step) for step, (i, cutoff) in enumerate(params.steps, 1)]
    # a rule's cutoffs fall, so of the steps that reject the least is the first
    return F.array_min(F.array(*found))


def trials(labelled: DataFrame, params: RiskParams) -> DataFrame:
    """``stratum, good, step``: one for each distinct text of a stratum that
    passes the base rules; of several labels the best counts.

    Copies of a text, and repeated rows, are judged alike, so they are no
    independent trials.
    """
    rows = with_stats(labelled).where(~base_failed(params))
    thin = rows.select("stratum", "good", first_step(params).alias("step"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return thin.groupBy("stratum", "digest").agg(F.max("good").alias("good"), F.min("step").alias("step")).drop("digest")


def calibrate(holdout: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """``stratum, step, rule, cutoff, n_good, k_good, k_bad, p_value, certified,
    chosen``: how many good and bad trials each step's cutoffs reject together,
    and the verdict.

    ``holdout`` has rows as of ``trials``.  A stratum's steps are tested in order
    until one fails, each at the whole error of its stratum; the error is shared
    among the strata alone.  Of the certified steps that of the largest gain is
    chosen, bad ones rejected less good ones.  A stratum with too few good trials
    certifies nothing.
    """
    counts = cut(
        holdout.groupBy("stratum", "step").agg(
            F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")
        ),
        "quality-counts",
    )
    # a stratum has one row for each step, whatever the input
    sums = counts.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("at"))
    steps = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(c).alias("cutoff")) for i, c in params.steps])
    grid = sums.select("stratum", "n_good", "at", F.posexplode(steps).alias("pos", "own")).select(
        "stratum", "n_good", "at", (F.col("pos") + 1).alias("step"), "own.*"
    )

    def rejected(name: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("at", zero, lambda a, x: a + F.when(x["step"] <= F.col("step"), x[name]).otherwise(zero))

    counted = grid.select("stratum", "step", "rule", "cutoff", "n_good", rejected("good").alias("k_good"), rejected("bad").alias("k_bad"))
    n_strata = sums.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    sequence = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = (
        counted.withColumn("p_value", at_most(F.col("k_good"), F.col("n_good"), params.max_false_rejection))
        .crossJoin(F.broadcast(n_strata))
        .withColumn("passes", F.col("p_value") <= params.error / F.col("n_strata"))
        .withColumn("certified", F.min("passes").over(sequence))
    )
    best = Window.partitionBy("stratum").orderBy(F.col("gain").desc_nulls_last(), "step")
    gain = F.when(F.col("certified") & (F.col("k_bad") > F.col("k_good")), F.col("k_bad") - F.col("k_good"))
    return (
        tested.withColumn("gain", gain)
        .withColumn("chosen", (F.row_number().over(best) == 1) & F.col("gain").isNotNull())
        .drop("passes", "gain", "n_strata")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    params: RiskParams = RiskParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """The rows with the columns of ``with_stats`` and ``stratum, base_failed,
    rejected_by, kept``.

    ``labels`` has ``id_col`` and ``quality`` (1 good, else bad); of several
    labels of a document the best counts, null ones don't.  ``rejected_by`` is
    the first rule that rejects, in the order of the rules.

    The null stratum is one of its own; null ids have no label; repeated rows
    are judged alike and are one trial, as are equal texts of a stratum; without
    labels, or with too few, the base rules alone decide.  No row is dropped, an
    empty table gives an empty one.
    """
    added = ("stratum", "base_failed", "rejected_by", "kept")
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col, stratum_col)])
    stratum = F.col(stratum_col).cast("string")
    holdout = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col(id_col).alias("label_id")
    ).agg((F.max("quality") == 1).alias("good"))
    if labels.count() <= params.broadcast_rows:
        holdout = F.broadcast(holdout)
    labelled = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), stratum.alias("stratum")).join(
        holdout, F.col("own_id") == F.col("label_id")
    )
    # what the base rules reject is lost anyway, and tells nothing about a cutoff
    table = cut(calibrate(trials(labelled, params), params), "quality-cutoffs")
    names = [f"cut_{i}" for i in range(len(params.rules))]
    last = table.where("chosen").select(F.col("stratum").alias("cut_stratum"), F.col("step").alias("last_step"))
    cutoffs = (
        table.join(last, F.col("stratum").eqNullSafe(F.col("cut_stratum")) & (F.col("step") <= F.col("last_step")))
        .groupBy("cut_stratum")
        .agg(*[F.min(F.when(F.col("rule") == i, F.col("cutoff"))).alias(name) for i, name in enumerate(names)])
    )
    if table.count() <= params.broadcast_rows:
        cutoffs = F.broadcast(cutoffs)
    judged = with_stats(docs, text_col).withColumn("stratum", stratum).join(
        cutoffs, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left"
    )
    rejected = F.lit(None).cast("string")
    for name, rule in reversed(list(zip(names, params.rules))):
        rejected = F.when(_value(rule) > F.col(name), F.lit(rule.name)).otherwise(rejected)
    return (
        judged.withColumn("base_failed", base_failed(params))
        .withColumn("rejected_by", rejected)
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
        .drop("cut_stratum", *names)
    )


def keep_good(docs: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with their own columns."""
    apart, own = set_apart(docs)
    doc_id, text, lang = (own[docs.columns.index(c)] for c in ("doc_id", "text", "lang"))
    ids = labels.select(F.col("doc_id").alias(doc_id), "quality")
    return put_back(judge(apart, ids, params, doc_id, text, lang).where("kept"), own, docs.columns)
