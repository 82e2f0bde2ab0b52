"""Generated samples that arrive in batches: labels, first appearances, running counters."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import clean_generated, digest, identity_key, trimmed
from ..operators.tally import fractions
from ..sources.shared import shared_path


HOT_SALTS = 64
MAX_HOT = 1024  # the hot keys stand in the plan of each batch
_SALTED = "known_digests"


class KnownKeys(NamedTuple):
    """Digests of known keys as a bucketed table, and those that are split because a stream brings them often."""

    table: str
    buckets: int
    hot: tuple[bytes, ...] = ()


def known_keys(known: DataFrame, buckets: int | None = None, hot: DataFrame | None = None) -> KnownKeys:
    """Writes the distinct digests of known keys ``(key)`` once, dealt by digest into buckets of a table.

    A batch then joins without moving them: only its own rows are shuffled. ``hot`` may name keys
    ``(key)`` that a stream brings very often; they are spread over HOT_SALTS places each. buckets
    should be the number of shuffle partitions (the default).
    """
    spark = known.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = known.select(digest(F.col("key")).alias("__digest")).distinct()
    often: tuple[bytes, ...] = ()
    if hot is not None:
        rows = hot.select(digest(F.col("key")).alias("d")).distinct().limit(MAX_HOT + 1).collect()
        if len(rows) > MAX_HOT:
            raise ValueError(f"at most {MAX_HOT} hot keys can be spread")
        often = tuple(bytes(r["d"]) for r in rows)
    salts = F.when(_among("__digest", often), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    path = shared_path(spark, _SALTED)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = digests.withColumn("__salt", F.explode(salts)).repartition(buckets, "__digest", "__salt")
    dealt.write.bucketBy(buckets, "__digest", "__salt").sortBy("__digest", "__salt").option("path", path).saveAsTable(name)
    return KnownKeys(name, buckets, often)


def _among(name: str, values: tuple[bytes, ...]) -> Column:
    return F.col(name).isin([F.lit(bytearray(v)) for v in values]) if values else F.lit(False)


def stream_label(
    stream: DataFrame,
    known: DataFrame | KnownKeys,
    canonical: Callable[[Column], Column] = trimmed,
    col: str = "item",
    marks: tuple[str, str, str] = ("^", " ", "_"),
    drop_empty: bool = True,
) -> DataFrame:
    """Cleaned items with ``canonical, key, valid, novel``; known keys are a static table ``(key)`` or :func:`known_keys`.

    The static side is distinct, so the left join never multiplies rows, and bucketed by digest, so
    a batch moves its own rows only.
    """
    rows = stream.withColumn(col, clean_generated(F.col(col), *marks))
    if drop_empty:
        rows = rows.where(F.length(col) > 0)
    rows = rows.withColumn("canonical", canonical(F.col(col)))
    rows = rows.withColumn("key", identity_key(F.col(col), F.col("canonical")))
    keys = known if isinstance(known, KnownKeys) else known_keys(known)
    seen = stream.sparkSession.table(keys.table).withColumn("__seen", F.lit(True))
    # a seed, so that a task that runs again deals its rows alike
    salt = F.when(_among("__digest", keys.hot), F.floor(F.rand(7) * HOT_SALTS).cast("int")).otherwise(0)
    asking = rows.withColumn("__digest", digest(F.col("key"))).withColumn("__salt", salt)
    return asking.join(seen.hint("merge"), ["__digest", "__salt"], "left").select(
        *rows.columns,
        F.col("canonical").isNotNull().alias("valid"),
        F.col("__seen").isNull().alias("novel"),
    )


def stream_first_seen(
    stream: DataFrame, key: str = "key", watermark: tuple[str, str] | None = None
) -> DataFrame:
    """Each key once over all batches; the state holds digests. With a watermark (column, delay) the state is bounded:
    a key counts as new again after the delay."""
    rows = stream.withColumn("__digest", digest(F.col(key)))
    if watermark is None:
        return rows.dropDuplicates(["__digest"]).drop("__digest")
    bounded = rows.withWatermark(*watermark)
    return bounded.dropDuplicatesWithinWatermark(["__digest"]).drop("__digest")


def run_available(
    stream: DataFrame,
    name: str,
    options: Callable[[DataStreamWriter], DataStreamWriter] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Runs a stream over what is there now into a Parquet table of the shared folder.

    With the path of an earlier run the stream goes on where that one ended: rows and state stay.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
    writer = writer.outputMode("append").trigger(availableNow=True)
    query = (options(writer) if options else writer).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


COUNTERS = ("generated", "valid", "unique", "novel")
_RECORD = "batch_id long, generated long, valid long, unique long, novel long, found long, fruitless long, stopped string"
_ENDED = "the tally has ended"


class StreamTally(NamedTuple):
    """Where a running tally keeps its state and records, and why it ended."""

    path: str
    stopped: str | None

    def records(self, spark: SparkSession) -> DataFrame:
        """One row per batch: its counters, and ``found, fruitless, stopped`` after it."""
        return spark.read.schema(_RECORD).parquet(f"{self.path}/records/batch-*")

    def batches(self, spark: SparkSession) -> DataFrame:
        """``(batch_id, idx, counter, count)``"""
        pairs = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(c).alias("counter"), F.col(c).alias("count")) for i, c in enumerate(COUNTERS)))
        return self.records(spark).select("batch_id", F.inline(pairs)).select("idx", "counter", "count", "batch_id")

    def totals(self, spark: SparkSession) -> DataFrame:
        """Sums over all batches with both fractions."""
        sums = self.records(spark).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(COUNTERS)])
        return fractions(sums, list(COUNTERS))


def _record(spark: SparkSession, path: str, batch_id: int | None = None) -> dict:
    """Record of a batch, or of the last one; an empty one where there is none."""
    name = f"{path}/records/batch-" + ("*" if batch_id is None else str(batch_id))
    try:
        rows = spark.read.schema(_RECORD).parquet(name)
    except AnalysisException:  # no such folder yet
        rows = None
    last = rows.orderBy(F.desc("batch_id")).first() if rows is not None else None
    return last.asDict() if last else {"batch_id": -1, "found": 0, "fruitless": 0, "stopped": None}


def stream_tally(
    labelled: DataFrame,
    target: int | None = None,
    max_tries: int | None = None,
    count_novel: bool = True,
    path: str | None = None,
) -> StreamTally:
    """Counters per batch of a stream with ``key, valid, novel``.

    A batch counts its distinct keys, the valid ones, those valid for the first time and the novel
    ones of these. Which valid keys came before is held in the state store of the query, as digests,
    so a batch reads no earlier ones. Each batch leaves one record with its counters and the running
    ``found`` and ``fruitless``; a batch that runs again replaces its record by the same one.

    The stream ends once ``target`` novel keys (first-time valid keys when ``count_novel`` is False)
    were found, or after ``max_tries`` batches in total without any novel (valid) key. The number of
    fruitless batches is never reset. A batch after the end is not committed: with the path of an
    earlier run, and other limits if it had ended, the tally goes on with that batch.
    """
    spark = labelled.sparkSession
    path = path or shared_path(spark, "tally")

    def ended(found: int, fruitless: int) -> str | None:
        if target is not None and found >= target:
            return "target"
        return "aborted" if max_tries is not None and fruitless >= max_tries else None

    def process(batch: DataFrame, batch_id: int) -> None:
        before = _record(spark, path, batch_id - 1)
        if ended(before["found"], before["fruitless"]):
            raise RuntimeError(_ENDED)
        flags = batch.groupBy("digest").agg(*(F.bool_or(c).alias(c) for c in ("valid", "novel", "fresh")))
        # one action: the state of the batch is made once
        c0, c1, c2, c3 = flags.agg(F.count("*"), F.count_if("valid"), F.count_if("fresh"), F.count_if(F.col("fresh") & F.col("novel"))).first()
        found = before["found"] + (c3 if count_novel else c2)
        fruitless = before["fruitless"] + ((c3 if count_novel else c1) == 0)
        row = (batch_id, c0, c1, c2, c3, found, fruitless, ended(found, fruitless))
        spark.createDataFrame([row], _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/records/batch-{batch_id}")

    last = _record(spark, path)
    if ended(last["found"], last["fruitless"]):
        return StreamTally(path, ended(last["found"], last["fruitless"]))
    rows = labelled.select(digest(F.col("key")).alias("digest"), "valid", "novel")
    first = rows.where("valid").dropDuplicates(["digest"])
    marked = rows.withColumn("fresh", F.lit(False)).unionByName(first.withColumn("fresh", F.lit(True)))
    query = (
        marked.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if _ENDED not in str(error):
            raise
    last = _record(spark, path)
    return StreamTally(path, ended(last["found"], last["fruitless"]))
