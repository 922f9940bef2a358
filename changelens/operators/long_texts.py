"""Secret scan of texts too long for one task.

A text is cut into blocks of lines, which are rows of their own.  A line's
findings need the line alone, so blocks are scanned wherever they are; line
numbers come from the lines in the blocks before, and context that reaches over
a block's edge from the lines next to it.  The findings are those of
``scan.scan_content`` on the whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.rows import each
from changelens.functions.running import running
from changelens.functions.sql import let
from changelens.operators import scan
from changelens.params import ScanOptions
from changelens.sources.tables import cut, drop_tables

BLOCK_LINES = 4096


def scan_blocks(
    texts: DataFrame,
    keys: Sequence[str],
    options: ScanOptions = ScanOptions(),
    path: str = "path",
    text: str = "text",
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Findings in the texts of a table, like ``scan.scan_content``; the blocks
    of one text are dealt to many tasks.

    A block brings the lines around it that its context reaches, so nothing is
    joined afterwards.  Texts are moved once; a table of short texts is better
    scanned in place.
    """
    around = options.context_size if options.include_context else 0
    blocks = let(
        "lines",
        f"split({text}, '\\n', -1)",
        f"transform(sequence(0, (size(lines) - 1) div {block_lines}), b -> "
        + let(
            "first",
            f"greatest(b * {block_lines} - {around}, 0)",
            "named_struct('block', b, 'first', first,"
            f" 'lines', slice(lines, first + 1, (b + 1) * {block_lines} + {around} - first))",
        )
        + ")",
    )
    rows = each(texts, [*keys, f"{path} AS _path"], blocks, "_b").selectExpr(
        *keys, "_path", "_b.block AS _block", "_b.first AS _first", "_b.lines AS _lines"
    )
    dealt = rows.repartition(*[F.col(k) for k in keys], "_block")
    lines = "transform(_lines, (s, i) -> named_struct('i', i, 'line', _first + i + 1L, 'content', s))"
    found = dealt.selectExpr(*keys, "_path", "_block", "_first", f"{scan.findings_sql('_path', lines, options)} AS findings")
    flat = scan.explode_findings(found, [*keys, "_block", "_first"], scan.unlimited(options), path="_path")
    own = flat.withColumn("line_ord", F.col("line_ord") + F.col("_first")).where(f"line_ord div {block_lines} = _block")
    return scan.limit(own.drop("_block", "_first"), keys, options.max_findings)


def scan_text_files(
    spark: SparkSession, path: str, options: ScanOptions = ScanOptions(), block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Findings in a folder of text files, keyed by ``path``; a file of any size
    is read and scanned by as many tasks as it has splits.

    One pass reads the lines, gathers them into blocks and leaves a thin table:
    findings, line counts and the lines at the edges.  Line numbers are running
    totals over it.  A line end at the end of a file begins no line.
    """
    around = options.context_size if options.include_context else 0
    used: list[str] = []
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        # of a split's lines, numbers of the task that reads it follow one another
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        "value",
    )
    blocks = lines.groupBy("path", "split", F.floor(F.col("at") / block_lines).alias("block")).agg(
        F.expr("transform(array_sort(collect_list(struct(at, value))), x -> x.value) AS lines")
    )
    numbered = "transform(lines, (s, i) -> named_struct('i', i, 'line', i + 1L, 'content', s))"
    key = ["path", "split", "block"]
    table = cut(
        blocks.selectExpr(
            *key,
            "cast(size(lines) as bigint) AS n_lines",
            f"{scan.findings_sql('path', numbered, options)} AS findings",
            f"slice(lines, 1, {around}) AS head",
            f"slice(lines, greatest(size(lines) - {around}, 0) + 1, {around}) AS tail",
        ),
        "line-blocks",
    )
    firsts = running(table.select(*key, "n_lines"), ["path"], ["split", "block"], {"first": "n_lines"}, paths=used)
    firsts = cut(firsts.selectExpr("path AS _path", "split AS _split", "block AS _block", "first", "n_lines AS _lines"), "line-numbers")
    drop_tables(spark, used)
    same = (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split")) & (F.col("block") == F.col("_block"))
    placed = table.join(firsts, same)
    found = placed.where("size(findings) > 0").selectExpr("path", "first", "_lines", "findings")
    flat = scan.explode_findings(found, ["path", "first", "_lines"], scan.unlimited(options))
    flat = flat.withColumn("line", F.col("line") + F.col("first")).withColumn("line_ord", F.col("line_ord") + F.col("first"))
    if around:
        flat = _with_context(flat, placed, around)
    return scan.limit(flat.drop("first", "_lines"), ["path"], options.max_findings)


def _with_context(found: DataFrame, placed: DataFrame, around: int) -> DataFrame:
    """Adds the lines beyond a block's edges, from the edges of other blocks.

    A line that near to a block is among the first or last of its own."""
    edges = (
        placed.selectExpr(
            "path",
            "explode(concat(transform(head, (s, i) -> struct(first + i AS at, s AS value)),"
            " transform(tail, (s, i) -> struct(first + n_lines - size(tail) + i AS at, s AS value)))) AS edge",
        )
        .selectExpr("path AS edge_path", "edge.at AS edge_at", "edge.value AS value")
        .distinct()
    )
    key = ["path", "line_ord", "pattern_idx", "match_idx"]
    missing = (
        f"filter(sequence(line_ord - {around}, line_ord + {around}), x -> x >= 0 AND (x < first OR x >= first + _lines))"
    )
    wanted = found.selectExpr(*key, f"explode({missing}) AS at")
    lines = wanted.join(edges, (F.col("path") == F.col("edge_path")) & (F.col("at") == F.col("edge_at")))
    near = lines.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
        F.expr("transform(array_sort(collect_list(if(at < line_ord, struct(at, value), null))), x -> x.value) AS _above"),
        F.expr("transform(array_sort(collect_list(if(at > line_ord, struct(at, value), null))), x -> x.value) AS _below"),
    )
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return (
        found.join(near, same, "left")
        .withColumn("context_before", F.expr("concat(coalesce(_above, array()), context_before)"))
        .withColumn("context_after", F.expr("concat(context_after, coalesce(_below, array()))"))
        .drop("_above", "_below", *[f"_{k}" for k in key])
    )
