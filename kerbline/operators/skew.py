"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # largest table sent whole to every executor, in rows
BROADCAST_BYTES = 64 << 20  # and in bytes of its texts
HOT_KEYS = 10_000         # at most this many keys are ever treated as hot
HOT_ROWS = 100_000        # a key with fewer rows is never hot


def hot_threshold(total: int, hot_rows: int = HOT_ROWS) -> int:
    """Keys with more rows than this are hot; at most HOT_KEYS of them can exist."""
    return max(hot_rows, total // HOT_KEYS)


def _text_bytes(table: DataFrame) -> int:
    """Bytes of all texts of a table that is known to have few rows; numbers need no count."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    if not texts:
        return 0
    return table.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], *, spread: Sequence[str], table_rows: int,
                total: int, weight: str | None = None, active: Column | None = None,
                broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``rows`` to ``table`` (one row per key), whatever the key frequencies.

    ``table_rows`` and ``total`` are counts the caller has taken. A small table
    is broadcast. Otherwise the table entries of hot keys, at most HOT_KEYS, are
    broadcast, and the remaining rows meet the rest of the table in a shuffle.
    Rows that are settled (hot, null-keyed or not ``active``) are dealt over all
    partitions by a hash of ``spread``. ``weight`` names the column of ``table``
    that counts the rows per key; without it they are counted here.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys and c != weight]
    usable = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    rows = rows.withColumn("_usable", usable)
    plain = table.select(*keys, *values)

    if table_rows <= broadcast_rows and _text_bytes(plain) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(plain), keys, "left")
        return joined.select(*[c for c in rows.columns if c != "_usable"],
                             *[F.when(F.col("_usable"), F.col(v)).alias(v) for v in values])

    limit = hot_threshold(total, hot_rows)
    if weight is not None:
        hot = table.where(F.col(weight) > limit)
    else:
        frequent = rows.where("_usable").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        hot = plain.join(F.broadcast(frequent.drop("_n")), keys)
    hot = hot.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    first = rows.join(F.broadcast(hot), keys, "left")

    settled = F.col("_hot").isNotNull() | ~F.col("_usable")
    for key in keys:
        settled = settled | F.col(key).isNull()
    # Both sides hash their keys, so the extra join key is no constant the optimizer could fold away.
    dealt = first.withColumn("_deal", F.when(settled, F.xxhash64(*spread)).otherwise(F.xxhash64(*keys)))
    rest = plain.select(*keys, *[F.col(v).alias(f"_cold_{v}") for v in values], F.xxhash64(*keys).alias("_deal"))
    joined = dealt.join(rest, [*keys, "_deal"], "left")
    return joined.select(
        *[c for c in rows.columns if c != "_usable"],
        *[F.when(F.col("_usable"), F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}"))).alias(v)
          for v in values],
    )
