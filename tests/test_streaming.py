import pytest
from pyspark.sql import functions as F

from stringmill.plans.labelling import item_tally, label_generated_items
from stringmill.streaming import samples as ops

ITEMS = [["C", "N!", "C ", "O_"], ["C", "N", "", "^N"], ["O", "S", "N!"], ["C", "C"], ["P", "F"]]
KNOWN = ["O", "P"]


def form(c):
    return F.when(~c.contains("!"), c)


@pytest.fixture
def stream(spark, rows, tmp_path):
    """One file per batch, labelled against a static table."""
    for i, batch in enumerate(ITEMS):
        part = rows("ord long, item string", *[(i * 10 + j, t) for j, t in enumerate(batch)])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = (
        spark.readStream.schema("ord long, item string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    # repeated known keys do not multiply rows
    known = rows("key string", *[(k,) for k in KNOWN + KNOWN])
    return ops.stream_label(source, known, form)


def batch_labels(rows):
    gen = [(b, b * 10 + j, t) for b, batch in enumerate(ITEMS) for j, t in enumerate(batch)]
    known = rows("item string", *[(k,) for k in KNOWN])
    return label_generated_items(rows("batch int, ord long, item string", *gen), known, form)


def test_labels_equal_the_batch_result(stream):
    got = ops.run_available(stream.select("ord", "key", "valid", "novel"), "labels").collect()
    assert len(got) == sum(len(b) for b in ITEMS) - 1
    for r in got:
        assert r.valid == ("!" not in r.key)
        assert r.novel == (r.key not in KNOWN)


def test_first_seen_over_batches(stream):
    got = ops.run_available(ops.stream_first_seen(stream.where("valid").select("key")), "first")
    assert sorted(r.key for r in got.collect()) == ["C", "F", "N", "O", "P", "S"]


def test_bounded_state(spark, rows, tmp_path):
    rows("key string, ts timestamp_ntz", ).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    bounded = ops.stream_first_seen(source, watermark=("ts", "1 hour"))
    assert bounded.isStreaming


def test_running_counters_equal_the_batch_tally(spark, rows, stream):
    result = ops.stream_tally(stream)
    assert result.stopped is None
    want = [r["count"] for r in item_tally(batch_labels(rows)).orderBy("idx").collect()]
    assert [r["count"] for r in result.totals(spark).orderBy("idx").collect()] == want
    assert result.batches(spark).select("batch_id").distinct().count() == len(ITEMS)


def test_stop_at_target(spark, stream):
    result = ops.stream_tally(stream, target=1)
    assert result.stopped == "target"
    assert result.batches(spark).select("batch_id").distinct().count() < len(ITEMS)


def test_abort_counts_fruitless_batches_in_total(spark, rows, tmp_path):
    for batch in (["C"], ["C"], ["N"], ["C"], ["S"]):
        part = rows("item string", *[(t,) for t in batch])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = (
        spark.readStream.schema("item string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    labelled = ops.stream_label(source, rows("key string", ("zz",)))
    result = ops.stream_tally(labelled, max_tries=2)
    assert result.stopped == "aborted"


def files_of(rows, path, batches):
    for i, batch in enumerate(batches):
        rows("ord long, item string", *[(i * 10 + j, t) for j, t in enumerate(batch)]).coalesce(1).write.mode("append").parquet(str(path))


def one_by_one(spark, path):
    return spark.readStream.schema("ord long, item string").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_tally_goes_on_after_a_restart(spark, rows, tmp_path):
    known = ops.known_keys(rows("key string", *[(k,) for k in KNOWN]))

    def labelled():
        return ops.stream_label(one_by_one(spark, tmp_path / "in"), known, form)

    files_of(rows, tmp_path / "in", ITEMS[:2])
    path = str(tmp_path / "tally")
    first = ops.stream_tally(labelled(), path=path)
    assert first.records(spark).count() == 2
    files_of(rows, tmp_path / "in", ITEMS[2:])
    second = ops.stream_tally(labelled(), path=path)
    want = [r["count"] for r in item_tally(batch_labels(rows)).orderBy("idx").collect()]
    assert [r["count"] for r in second.totals(spark).orderBy("idx").collect()] == want
    assert second.records(spark).count() == len(ITEMS)
    # nothing new: nothing counted
    assert ops.stream_tally(labelled(), path=path).records(spark).count() == len(ITEMS)


def test_ended_tally_goes_on_with_other_limits(spark, rows, stream, tmp_path):
    path = str(tmp_path / "tally")
    ended = ops.stream_tally(stream, target=1, path=path)
    assert ended.stopped == "target"
    n = ended.records(spark).count()
    again = ops.stream_tally(stream, target=1, path=path)
    assert again.stopped == "target" and again.records(spark).count() == n < len(ITEMS)
    whole = ops.stream_tally(stream, path=path)
    want = [r["count"] for r in item_tally(batch_labels(rows)).orderBy("idx").collect()]
    assert [r["count"] for r in whole.totals(spark).orderBy("idx").collect()] == want


def test_first_seen_goes_on_after_a_restart(spark, rows, tmp_path):
    def first():
        keys = one_by_one(spark, tmp_path / "in").select(F.col("item").alias("key"))
        return ops.run_available(ops.stream_first_seen(keys), "first", path=str(tmp_path / "out")).collect()

    files_of(rows, tmp_path / "in", [["a", "b"], ["b", "c"]])
    assert sorted(r.key for r in first()) == ["a", "b", "c"]
    files_of(rows, tmp_path / "in", [["a", "d"]])
    assert sorted(r.key for r in first()) == ["a", "b", "c", "d"]


def test_known_side_is_not_moved_and_hot_keys_are_spread(spark, rows, tmp_path):
    hot = rows("key string", ("O",), ("not known",))
    known = ops.known_keys(rows("key string", *[(k,) for k in KNOWN + KNOWN]), hot=hot)
    assert spark.table(known.table).count() == len(KNOWN) - 1 + ops.HOT_SALTS
    labelled = ops.stream_label(rows("item string", *[("O",)] * 50, ("C",), ("P",)), known, form)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan
    files_of(rows, tmp_path / "in", [["O"] * 40, ["C", "P", "O"]])
    streamed = ops.stream_label(one_by_one(spark, tmp_path / "in"), known, form)
    got = ops.run_available(streamed.select("item", "novel"), "hot").collect()
    assert len(got) == 43 and all(r.novel == (r.item == "C") for r in got)
