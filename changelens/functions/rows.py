"""Row-shaping helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Files of one diff part are numbered below this, so that
# file_idx = part_idx * FILES_PER_PART + position orders a change set's files.
FILES_PER_PART = 1 << 26


def each(df: DataFrame, keep: Sequence[str], values: str, name: str) -> DataFrame:
    """One row per array element, next to the columns to keep.

    An inner explode makes the optimizer infer a size filter and push it below
    the projection, which would compute a costly array twice; an outer explode
    followed by a null filter does not.  Elements must not be null.
    """
    return df.selectExpr(*keep, f"explode_outer({values}) AS {name}").where(f"{name} IS NOT NULL")


def each_with_position(df: DataFrame, keep: Sequence[str], values: str, position: str, name: str) -> DataFrame:
    """Like ``each``, with the element's position from zero on."""
    rows = df.selectExpr(*keep, f"posexplode_outer({values}) AS (_p, {name})").where(f"{name} IS NOT NULL")
    return rows.selectExpr(*[_name(k) for k in keep], f"cast(_p as bigint) AS {position}", name)


def _name(column: str) -> str:
    return column.rsplit(" AS ", 1)[-1]


_SALTS = 256


def first_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, ranked from one.

    One key with most of the rows does not load one task: small ranks are limited
    per task before the shuffle, and for large ones every key is first cut down
    in salted groups.
    """
    by = ", ".join(order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:  # up to there the optimizer limits groups per task itself
        names = ", ".join(c for c in df.columns if c in {o.split()[0] for o in order})
        salted = df.selectExpr("*", f"pmod(xxhash64({names or by}), {_SALTS}) AS _salt")
        window = f"PARTITION BY {', '.join(keys)}, _salt ORDER BY {by}"
        df = salted.selectExpr("*", f"row_number() OVER ({window}) AS _r").where(f"_r <= {n}").drop("_salt", "_r")
    window = f"PARTITION BY {', '.join(keys)} ORDER BY {by}"
    return df.selectExpr("*", f"cast(row_number() OVER ({window}) as bigint) AS {rank}").where(f"{rank} <= {n}")
