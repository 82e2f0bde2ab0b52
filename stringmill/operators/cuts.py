"""First rows, exact splits and other cuts at a rank, without sorting the data.

A cut is found in rounds: some values drawn by hash split the range in question, counts per range
say in which one the wanted rank lies, and the next round looks at that one only. It works for every
type that can be ordered, structs included. The data itself is filtered or labelled map-side by
comparing with the cut value, so nothing but counts and a few values is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's top-k sends this many rows per task to one task; beyond it a cut is looked for.
TOP_ROWS = 1_000
# a range this small is ranked by one task
RANKED_ROWS = 100_000
SPLITTERS = 64


def first_n(df: DataFrame, n: int, order_by: str = "ord", **sizes: int) -> DataFrame:
    """First ``n`` rows in order; an error when there are fewer."""
    if n <= 0:
        raise ValueError("n must be positive")
    rows = df.count()
    if n > rows:
        raise ValueError(f"asked for {n} rows, there are {rows}")
    return cap_rows(df, n, order_by, **sizes)


def cap_rows(df: DataFrame, n: int, order_by: str = "ord", top_rows: int = TOP_ROWS, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """First ``min(n, rows)`` rows in order, nulls first. ``order_by`` must be unique."""
    if n <= top_rows:
        return df.orderBy(order_by).limit(n)
    values = df.select(F.col(order_by).alias("v"))
    nulls, rows = values.agg(F.count_if(F.col("v").isNull()), F.count("*")).first()
    if rows <= n:
        return df
    if n <= nulls:
        return df.where(F.col(order_by).isNull()).limit(n)
    cut = rank_value(values.where("v is not null"), n - nulls, ranked_rows)
    return df.where(F.col(order_by).isNull() | (F.col(order_by) <= _literal(cut, df.schema[order_by].dataType)))


def _literal(value: object, kind: T.DataType) -> Column:
    """A collected value as a column of its type."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    if isinstance(kind, T.ArrayType) and value is not None:
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def rank_value(values: DataFrame, rank: int, ranked_rows: int = RANKED_ROWS) -> object:
    """The value of this rank (1 = smallest) in a column ``v`` without nulls; repeated values count each.

    Every round counts the rows between and at SPLITTERS values of the range, which narrows it to
    about its SPLITTERS-th part, or to one value that fills the rank.
    """
    kind = values.schema["v"].dataType
    inside, rows = values, values.count()
    if not 1 <= rank <= rows:
        raise ValueError(f"there is no row {rank} among {rows}")
    while rows > ranked_rows:
        drawn = inside.orderBy(F.xxhash64("v"), "v").limit(SPLITTERS).distinct().orderBy("v").collect()
        # ranges in order: below the first splitter, at it, between it and the next, ...
        place = sum(
            ((F.col("v") > _literal(r["v"], kind)).cast("int") + (F.col("v") >= _literal(r["v"], kind)).cast("int") for r in drawn),
            F.lit(0),
        )
        found = inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("place").collect()
        for r in found:
            if rank <= r["n"]:
                break
            rank -= r["n"]
        if r["low"] == r["high"]:
            return r["low"]
        rows = r["n"]
        inside = values.where(F.col("v").between(_literal(r["low"], kind), _literal(r["high"], kind)))
    return inside.orderBy("v").limit(rank).agg(F.max("v")).first()[0]


def heaviest(df: DataFrame, weight: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the greatest positive weight, ties by columns ascending.

    Counts per power of two say which rows can be among them, so that not every task sends
    its own top ``n`` to the last one. ``df`` is read twice: pass a stored table.
    """
    level = F.floor(F.log2(weight))
    sizes = sorted(df.groupBy(level.alias("l")).count().collect(), reverse=True)  # some 60 rows
    total = 0
    for cut, count in sizes:
        total += count
        if total >= n:
            df = df.where(level >= cut)
            break
    return df.orderBy(weight.desc(), *ties).limit(n)


def shuffle_order(key: Column, tie: Column, seed: int) -> Column:
    """Reproducible pseudo-random order value of a row."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), tie.cast("string")))


def random_split(
    df: DataFrame,
    val_percent: float,
    test_percent: float,
    seed: int = 42,
    key: str = "item",
    tie: str = "ord",
) -> DataFrame:
    """Adds ``split`` (train, validation, test) with exact sizes ``int(rows * percent / 100)``.

    Rows are ordered by an MD5 of seed, key and tie; validation comes first, then test.
    """
    order = shuffle_order(F.col(key), F.col(tie), seed)
    marks = df.select(order.alias("v"))
    rows = marks.count()
    n_val = int(rows * val_percent / 100)
    n_test = int(rows * test_percent / 100)

    def cut(rank: int) -> str:
        """The order value of the row with this rank (1 = first)."""
        return rank_value(marks, rank)

    split = F.lit("train")
    if n_test:
        split = F.when(order <= cut(n_val + n_test), "test").otherwise(split)
    if n_val:
        split = F.when(order <= cut(n_val), "validation").otherwise(split)
    return df.withColumn("split", split)
