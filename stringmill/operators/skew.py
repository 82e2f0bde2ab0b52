"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

# A key with this many rows is spread: its salts grow with its rows, so that one has at most about
# half as many. At most MAX_HOT keys are spread, the hottest ones: what is broadcast is at most a
# megabyte of hashes and numbers, and a key left whole holds less than a 65 536th of all rows.
HOT_ROWS = 1_000_000
MAX_HOT = 65_536
# Pairs that one cell of a grid join makes, about.
CELL_PAIRS = 1_000_000


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_hashes(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the most frequent keys with their number of salts, at most ``MAX_HOT`` rows."""
    counts = rows.select(_key_hash(keys).alias("__hash")).groupBy("__hash").count()
    return _hottest(counts, hot_rows)


def _hottest(counts: DataFrame, hot_rows: int) -> DataFrame:
    return (
        counts.where(F.col("count") >= hot_rows)
        .orderBy(F.col("count").desc(), "__hash")
        .limit(MAX_HOT)
        .select("__hash", F.ceil(2 * F.col("count") / hot_rows).cast("int").alias("__salts"))
    )


# A table joins without a shuffle when it has at most this many rows and bytes of text.
SMALL_ROWS = 200_000
SMALL_BYTES = 32 * 2**20


def is_small(table: DataFrame) -> bool:
    """Whether a table is within the broadcast bounds, by one aggregate over it."""
    texts = [F.octet_length(f.name) for f in table.schema.fields if f.dataType.typeName() == "string"]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(8 * len(table.columns)))
    rows, size = (
        table.select(size.cast("long").alias("b"))
        .agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)))
        .first()
    )
    return rows <= SMALL_ROWS and size <= SMALL_BYTES


def small_or_lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: str | Sequence[str] = "ord",
) -> DataFrame:
    """Broadcasts the table after a check of its size, else joins by :func:`lookup_join`."""
    if is_small(table):
        return rows.join(F.broadcast(table), on, how)
    return lookup_join(rows, table, on, how, spread_by)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: str | Sequence[str] = "ord",
    hot_rows: int = HOT_ROWS,
    row_count: str | None = None,
) -> DataFrame:
    """Join any number of rows per key to a table, usually with one row per key.

    Only hot keys are salted: their rows are spread by ``spread_by`` (columns that differ
    between rows of one key, so that a rerun of a task gives the same salt) and their single
    table row is repeated once per salt. Nulls match nulls. All other keys join as usual.
    ``row_count`` names a column of the table that already holds the number of rows per key;
    without it the rows are counted by key hash first.
    """
    keys = [on] if isinstance(on, str) else list(on)
    spread = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    if row_count is None:
        found = hot_hashes(rows, keys, hot_rows)
    else:
        counts = table.select(_key_hash(keys).alias("__hash"), F.col(row_count).alias("count"))
        found = _hottest(counts, hot_rows)
    hot = F.broadcast(found.groupBy("__hash").agg(F.max("__salts").alias("__salts")) if row_count else found)
    salts = F.coalesce("__salts", F.lit(1))

    left = (
        rows.withColumn("__hash", _key_hash(keys))
        .join(hot, "__hash", "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
        .drop("__salts")
    )
    right = (
        table.withColumn("__hash", _key_hash(keys))
        .join(hot, "__hash", "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts")
    )
    l, r = left.alias("l"), right.alias("r")
    match = (F.col("l.__hash") == F.col("r.__hash")) & (F.col("l.__salt") == F.col("r.__salt"))
    for k in keys:
        match &= F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    joined = l.join(r, match, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__hash", "__salt")
    extra = [F.col(f"r.`{c}`") for c in table.columns if c not in keys]
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], *extra)


def grid_shape(left: DataFrame, right: DataFrame, key: str, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``(key, __rows, __cols)`` of the keys whose pairs are more than one cell should make.

    The sides of a cell are equal where both sides of the key are long enough, so a key with few
    rows on one side is cut along the other only.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    l, r, side = F.col("l").cast("double"), F.col("r").cast("double"), float(cell_pairs) ** 0.5

    def cuts(own: Column, other: Column) -> Column:
        # rows of this side in a cell: the side of a square, or more where the other side is short
        return F.ceil(own / F.greatest(F.lit(side), F.lit(float(cell_pairs)) / other)).cast("int")

    return counts.where(l * r > cell_pairs).select(key, cuts(l, r).alias("__rows"), cuts(r, l).alias("__cols"))


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_left: str | Sequence[str],
    spread_right: str | Sequence[str],
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """All pairs of two tables within a key, where a key may be hot on either side or on both.

    The pairs of a key form a rectangle. Where it is large it is cut into cells of about
    ``cell_pairs`` pairs, sized from the counts of both sides; a left row goes to the cells of its
    row, a right row to those of its column, so each pair is made in exactly one cell. The columns in
    ``spread_left`` and ``spread_right`` differ between the rows of a key, so that a rerun of a task
    sends a row to the same cells. Null keys pair with nothing. Both tables may have no other
    column name in common.
    """
    shape = grid_shape(left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull()), key, cell_pairs)
    shape = cut_lineage(shape)
    rows, cols = F.coalesce("__rows", F.lit(1)), F.coalesce("__cols", F.lit(1))

    def placed(df: DataFrame, spread: str | Sequence[str], own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        spread = [spread] if isinstance(spread, str) else list(spread)
        return (
            small_or_lookup_join(df, shape, key, "left", spread)
            .withColumn(names[0], F.pmod(F.xxhash64(*spread), own).cast("int"))
            .withColumn(names[1], F.explode(F.sequence(F.lit(0), other - 1)))
            .drop("__rows", "__cols")
        )

    a = placed(left, spread_left, rows, cols, ("__row", "__col"))
    b = placed(right, spread_right, cols, rows, ("__col", "__row"))
    return a.join(b, [key, "__row", "__col"]).drop("__row", "__col")
