import gzip
import hashlib
import json
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stringmill.operators.cuts import cap_rows
from stringmill.operators.runs import (
    attach_run_registry,
    catalogue_table,
    last_eval_value,
    metric_type_check,
)
from stringmill.plans.corpus import prepare_reaction_corpus
from stringmill.plans.experiments import collect_run_metrics, short_directories
from stringmill.sources import artifacts, items, opened, sinks


def texts(df, order="ord"):
    return [r.item for r in df.orderBy(order).collect()]


def test_items_header_is_dropped_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"smiles"\n"C/C=C\\C"\nMOL in the middle\n"a ""quoted"", one",2\n')
    (tmp_path / "b.csv").write_text("CCO,1\nreaction later\n")
    got = texts(items.read_items(spark, str(tmp_path)))
    assert got == ["C/C=C\\C", "MOL in the middle", 'a "quoted", one', "CCO", "reaction later"]
    assert len(texts(items.read_known(spark, str(tmp_path)))) == 6


def _jobs(spark, run):
    """The Spark jobs that a call starts."""
    context = spark.sparkContext
    group = f"counted-{uuid.uuid4().hex}"
    context.setJobGroup(group, "")
    result = run()
    started = context.statusTracker().getJobIdsForGroup(group)
    context._jsc.clearJobGroup()
    return result, len(started)


def test_many_files_are_looked_at_in_one_job(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02}.csv").write_text(f"C{i},1\nSMILES\n" if i % 2 else f"\n\"Smiles, {i}\"\nC{i}\n")
    (tmp_path / "empty.csv").write_text("")
    rows, jobs = _jobs(spark, lambda: items.read_items(spark, str(tmp_path)))
    assert jobs <= 2
    want = [t for i in range(30) for t in ([f"C{i}", "SMILES"] if i % 2 else [f"C{i}"])]
    assert sorted(texts(rows)) == sorted(want)


def test_headerless_generated_files_are_one_group(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02}.csv").write_text(f"C{i}\nN\n")
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("valid,smiles\nTrue,X\n")
    rows, jobs = _jobs(spark, lambda: items.read_generated(spark, str(tmp_path)))
    assert jobs <= 2
    assert len(texts(rows)) == 61 and "X" in texts(rows)
    assert texts(items.read_generated(spark, str(tmp_path), n=3)) == ["C0", "N", "C1"]


def test_order_survives_blocks(spark, tmp_path):
    lines = [f"item {i}" for i in range(5000)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = items.read_known(spark, str(tmp_path / "a.csv"))
        assert df.rdd.getNumPartitions() > 4
        assert texts(df) == lines
        for n in (1, 1200, 4999, 5000, 6000):
            assert texts(cap_rows(df, n)) == lines[:n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compressed_input(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("SMILES\nC\n")
    assert texts(items.read_items(spark, str(tmp_path / "a.csv.gz"))) == ["C"]
    with pytest.raises(ValueError, match="xz"):
        items.read_items(spark, str(tmp_path / "a.csv.xz"))


def test_generated_file_forms(spark, tmp_path):
    full = tmp_path / "full.csv"
    full.write_text("smiles,canonical_smiles,valid\nC,C,True\nX,,False\n,,True\nN,N,True\n")
    assert texts(items.read_generated(spark, str(full))) == ["C", "X", "N"]
    assert texts(items.read_generated(spark, str(full), valid_only=True)) == ["C", "N"]
    assert texts(items.read_generated(spark, str(full), n=1, valid_only=True)) == ["C"]
    with pytest.raises(ValueError):
        items.read_generated(spark, str(full), n=3, valid_only=True)
    short = tmp_path / "short.csv"
    short.write_text("smiles\nC\n")
    assert texts(items.read_generated(spark, str(short))) == ["C"]
    with pytest.raises(ValueError):
        items.read_generated(spark, str(short), valid_only=True)
    bare = tmp_path / "bare.csv"
    bare.write_text("C,1\nN,2\n")
    assert texts(items.read_generated(spark, str(bare))) == ["C", "N"]
    one = tmp_path / "one.csv"
    one.write_text("C\n")
    assert texts(items.read_generated(spark, str(one))) == ["C"]


def test_split_dir(spark, tmp_path):
    for name, text in (("my_train.csv", "a\nb\n"), ("my_val.csv", "c\n"), ("my_test.txt", "d\n"), ("notes.md", "e\n")):
        (tmp_path / name).write_text(text)
    got = sorted((r.split, r.item) for r in items.read_split_dir(spark, str(tmp_path)).collect())
    assert got == [("test", "d"), ("train", "a"), ("train", "b"), ("validation", "c")]


def test_split_dir_words(spark, tmp_path):
    plain, mixed = tmp_path / "plain", tmp_path / "mixed"
    plain.mkdir(), mixed.mkdir()
    for name in ("part0.csv", "retrain.csv", "latest.csv"):
        (plain / name).write_text(f"{name}\n")
    got = {(r.split, r.item) for r in items.read_split_dir(spark, str(plain)).collect()}
    assert got == {("train", "part0.csv"), ("train", "retrain.csv"), ("train", "latest.csv")}
    for name in ("dev.csv", "evaluation.csv", "My Training-1+2.csv"):
        (mixed / name).write_text(f"{name}\n")
    got = {(r.split, r.item) for r in items.read_split_dir(spark, str(mixed)).collect()}
    assert got == {("validation", "dev.csv"), ("test", "evaluation.csv"), ("train", "My Training-1+2.csv")}
    (mixed / "other.csv").write_text("x\n")
    with pytest.raises(ValueError, match="other.csv"):
        items.read_split_dir(spark, str(mixed))


def test_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n4,3\n")
    rows = items.read_table(spark, str(tmp_path)).orderBy("ord")
    assert [(r.x, r.y) for r in rows.collect()] == [("1", "2"), ("3", "4")]
    (tmp_path / "c.csv").write_text("y,z\n4,3\n")
    with pytest.raises(ValueError, match="no column"):
        items.read_table(spark, str(tmp_path))


def test_generated_with_two_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,valid\nC,True\nD,False\n")
    (tmp_path / "b.csv").write_text("valid,smiles\nTrue,N\n")
    assert [r.item for r in items.read_generated(spark, str(tmp_path)).orderBy("ord").collect()] == ["C", "D", "N"]
    kept = items.read_generated(spark, str(tmp_path), valid_only=True).orderBy("ord")
    assert [r.item for r in kept.collect()] == ["C", "N"]


def test_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\ny,2\nx,3\n")
    (tmp_path / "b.csv").write_text("k,v\ny,2\nz,4\n")
    path = str(tmp_path)
    first = items.merge_tables(spark, path, column="k").orderBy("ord")
    assert [(r.k, r.v) for r in first.collect()] == [("x", "1"), ("y", "2"), ("z", "4")]
    assert items.merge_tables(spark, path, column=0).count() == 3
    assert items.merge_tables(spark, path, column="none").count() == 4
    assert items.merge_tables(spark, path, column="unknown").count() == 4
    assert items.merge_tables(spark, path, drop_duplicates=False).count() == 5
    with pytest.raises(ValueError):
        items.merge_tables(spark, path, check_header=False, column="k")
    (tmp_path / "c.csv").write_text("k,w\nq,1\n")
    with pytest.raises(ValueError, match="header"):
        items.merge_tables(spark, path)


def test_reaction_corpus(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(
        "id,split,class,prod_smiles,reaction_smarts\n"
        "1,train,x,P,A>>B\n2,train,x,P,A>>B\n3,train,x,P,C>>D\n4,valid,x,P,C>>D\n5,test,x,P,C>>D\n6,test,x,P,E>>F\n"
    )
    parts = prepare_reaction_corpus(spark, str(raw), str(tmp_path / "out"))
    assert [r[0] for r in parts["train"].collect()] == ["A>>B"]
    assert parts["known"].count() == 3 and parts["test"].count() == 2 and parts["valid"].count() == 1
    known = items.read_known_reactions(spark, str(tmp_path / "out/known"))
    assert sorted(r.id for r in known.collect()) == ["4", "5", "6"]


def test_written_items_come_back(spark, rows, tmp_path):
    data = [(3, ' lead, "q" '), (1, "C\\C"), (2, "x")]
    df = rows("ord int, item string", *data)
    sinks.write_items(df, str(tmp_path / "o"))
    assert texts(items.read_known(spark, str(tmp_path / "o"))) == ["C\\C", "x", ' lead, "q" ']


def test_metrics_formats(spark, rows, tmp_path):
    df = rows("run string, loss double, n int", ("b", 0.123456, None), ("a", 2.0, 3))
    sinks.write_metrics(df, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m/md")).collect()]
    assert sorted(lines) == sorted(
        ["| run | loss | n |", "|:--|:--|:--|", "| a | 2.0 | 3 |", "| b | 0.123456 |  |"]
    )
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m/json")).collect()]
    assert {"run": "b", "loss": 0.123, "n": None} in got
    assert spark.read.csv(str(tmp_path / "m/csv"), header=True).count() == 2
    shown = sinks.format_wide(df, {"loss": ".4f"}).orderBy("run").collect()
    assert [r.loss for r in shown] == ["2.0000", "0.1235"]
    with pytest.raises(ValueError):
        sinks.write_metrics(df, str(tmp_path / "x"), "PDF")


@pytest.fixture
def run_tree(tmp_path):
    root = tmp_path / "runs"

    def put(path, content):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content if isinstance(content, str) else json.dumps(content))

    put("model_a/pytorch_model.bin", "weights")
    put(
        "model_a/tokenizer.json",
        {
            "added_tokens": [{"content": "^"}, {"content": "_"}],
            "pre_tokenizer": None,
            "model": {"type": "BPE", "vocab": {"^": 0, "_": 1, "C": 2, "N": 3}},
        },
    )
    put("model_a/config.json", {"n_layer": 12, "n_head": 6, "n_embd": 144})
    put("model_a/misc_training_information.json", {"model_size": "6.43M", "dataset_dir": "data", "wandb_run_id": "old"})
    put("model_a/all_results.json", {"epoch": 49.99, "train_runtime": 90061.5, "train_loss": 0.5, "test_loss": 0.6})
    put(
        "model_a/trainer_state.json",
        {"best_metric": 0.55, "log_history": [{"eval_accuracy": 0.7}, {"eval_accuracy": 0.8}, {"loss": 1.0}]},
    )
    put("model_a/README.md", "# card\n- learning_rate: 0.0005\n- train_batch_size: 128\n")
    put("model_a/checkpoint-100/pytorch_model.bin", "weights")
    put("model_a/checkpoint-100/scheduler.pt", "state")
    put("gen_1/generated_smiles.csv", "smiles\nC\n")
    put("gen_1/generate_args.json", {"num_beams": 1, "temperature": 1.0})
    put("gen_1/assess_stats.json", {"Validity": 0.97, "FCD": 0.2, "FCD GuacaMol": 0.96})
    put("gen_2/generated_smarts.csv", "smarts\nC\n")
    put("gen_2/generate_stats.json", {"counts": {"known": 7}, "relative_fractions": {"valid": 0.8}})
    put("empty/notes.txt", "nothing")
    return root


def test_collect_run_metrics(spark, rows, run_tree):
    root = f"file:{run_tree}"
    links = rows("run string, model_run string", (f"{root}/gen_1", f"{root}/model_a"))
    registry = rows(
        "run_id string, run_name string, output_dir string", ("w1", "first", "out/model_a.x"), ("w2", "b", "q")
    )
    table = collect_run_metrics(spark, str(run_tree), links, registry)
    got = {r["run"].rsplit("/", 1)[-1]: r.asDict() for r in table.collect()}
    assert set(got) == {"model_a", "gen_1", "gen_2"}
    a, g1, g2 = got["model_a"], got["gen_1"], got["gen_2"]
    assert (a["pre_tokenizer"], a["algorithm"], a["vocab_size"]) == ("Char", "BPE", 2)
    assert (a["layers"], a["heads"], a["hidden_dim"], a["model_size"]) == (12, 6, 144, "6.43M")
    assert (a["num_epochs"], a["batch_size"], a["lr"]) == (50, 128, 0.0005)
    assert (a["train_runtime"], a["val_loss"], a["val_acc"]) == ("1 day, 1:01:01", 0.55, 0.8)
    assert (a["wandb_run_id"], a["wandb_run_name"]) == ("w1", "first")
    assert a["validity_mols"] is None and a["test_acc"] is None
    # a generated run inherits what its model offers
    assert (g1["layers"], g1["wandb_run_id"], g1["validity_mols"], g1["fcd_g_mols"]) == (12, "w1", 0.97, 0.96)
    assert (g2["layers"], g2["known_either_rts"], g2["validity_rts"]) == (None, 7, 0.8)
    places = [table.columns.index(c) for c in ("pre_tokenizer", "layers", "lr", "fcd_mols", "known_val_rts")]
    assert places == sorted(places)
    short = short_directories(table).where("run like '%gen_1'").first()
    assert (short["Generated directory"], short["Model directory"]) == ("gen_1", "model_a")


def test_discovery_and_latest(spark, run_tree):
    runs = artifacts.discover_runs(artifacts.list_files(spark, str(run_tree)))
    assert sorted(r.run.rsplit("/", 1)[-1] for r in runs.collect()) == ["gen_1", "gen_2", "model_a"]
    assert artifacts.latest_run(runs).first().run is not None


def test_last_eval_without_entry(rows):
    df = rows("s string", ('{"log_history": [{"loss": 1}]}',), ("{}",), ('{"log_history": [{"eval_accuracy": 0.5}, {"x": 1}]}',))
    assert [r[0] for r in df.select(last_eval_value(F.col("s"))).collect()] == [None, None, "0.5"]


def test_strict_registry_and_types(spark, rows):
    runs = rows("output_dir string", ("a/run",))
    registry = rows("run_id string, run_name string, output_dir string", ("1", "x", "run"), ("2", "y", "b/run.t"))
    assert attach_run_registry(runs, registry).first().run_id == "Multiple"
    with pytest.raises(Exception, match="several runs"):
        attach_run_registry(runs, registry, strict=True).collect()
    metrics = rows("run string, metric string, value string", ("r", "layers", "1.5"), ("r", "lr", "x"), ("r", "lr", "0.1"))
    wrong = metric_type_check(metrics, catalogue_table(spark)).collect()
    assert sorted((r.metric, r.value) for r in wrong) == [("layers", "1.5"), ("lr", "x")]


def test_checksums(spark, rows, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.bin").write_bytes(name.encode())
    digests = artifacts.file_digests(spark, str(tmp_path))
    good = hashlib.sha256(b"a").hexdigest()
    registry = rows(
        "name string, expected string", ("a.bin", "sha256:" + good), ("b.bin", "00"), ("c.bin", None), ("d.bin", "11")
    )
    got = {r.name: r.status for r in artifacts.verify_checksums(digests, registry).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "unchecked", "d.bin": "missing"}
    whole = artifacts.fileset_digest(digests).first().digest
    assert whole == artifacts.fileset_digest(digests.orderBy(F.desc("name"))).first().digest
    md5 = artifacts.file_digests(spark, str(tmp_path), "md5")
    assert hashlib.md5(b"a").hexdigest() in {r.digest for r in md5.collect()}


def _put(root, *names):
    for name in names:
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"" if "empty" in name else name.encode())


def test_listed_files_do_not_stand_on_the_driver(spark, tmp_path):
    """What the driver knows of a listing is the files of its tables, not the files that are listed."""
    _put(tmp_path, *[f"{i % 40}/{i}.bin" for i in range(200)])
    files = artifacts.list_files(spark, str(tmp_path))
    assert not any(name.endswith(".bin") for name in files.inputFiles())
    assert sorted((r.name, r.length, r.folder) for r in files.collect()) == sorted(
        (f"{i}.bin", len(f"{i % 40}/{i}.bin"), f"file:{tmp_path}/{i % 40}") for i in range(200)
    )
    assert artifacts.file_digests(spark, str(tmp_path)).select("path").distinct().count() == 200


ODD_NAMES = [
    "a.bin", "c d.bin", "50%.txt", "50%25.txt", "a+b.txt", "ü ñ/é.txt", "h#sh?q/x[1]{y}*.txt", "k=1/z", "_k=v/y", "empty", "deep/1/2/3/4/f",
    "deep/1/g", "deep/empty2", ".hidden/x", "_hidden/x", "_SUCCESS", ".x.crc", "part._COPYING_", "_metadata", "_metadata_of/x", "q'u\"o,te",
]


@pytest.mark.parametrize("below", ["", "/", "/*", "/{deep,deep/1}", "/deep/1/g", "/empty", "/_hidden", "/_SUCCESS", "/none", "/ü ñ", "/50%25.txt"])
def test_listing_finds_what_a_scan_finds(spark, tmp_path, below):
    root = tmp_path / "tree"
    _put(root, *ODD_NAMES)
    (root / "none").mkdir()
    (root / "link").symlink_to(root / "deep")
    (root / "broken").symlink_to(root / "gone")
    found, scanned = (f(spark, f"{root}{below}") for f in (artifacts.list_files, artifacts._scanned_files))
    assert found.schema == scanned.schema
    assert sorted(found.collect(), key=lambda r: r.path) == sorted(scanned.collect(), key=lambda r: r.path)


def test_listing_of_a_missing_path_is_an_error(spark, tmp_path):
    for name in ("gone", "gone*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            artifacts.list_files(spark, str(tmp_path / name))


def test_listing_leaves_its_own_tables_out(spark, tmp_path, monkeypatch):
    _put(tmp_path, "a.bin", "shared/b.bin", "x/y/z/c.bin")
    monkeypatch.setattr(opened, "shared_path", lambda s, name: f"{tmp_path}/shared/{name}-0")
    assert sorted(r.name for r in artifacts.list_files(spark, str(tmp_path)).collect()) == ["a.bin", "b.bin", "c.bin"]


def test_listing_where_only_spark_reaches(spark, tmp_path, monkeypatch):
    _put(tmp_path, "a.bin", "x/b.bin", "empty")
    want = sorted(artifacts.list_files(spark, str(tmp_path)).collect())
    assert opened.in_reach(f"file:{tmp_path}") and not opened.in_reach(f"file:{tmp_path}/gone") and not opened.in_reach("strange://host/x")
    monkeypatch.setattr(opened, "in_reach", lambda path: False)
    assert sorted(artifacts.list_files(spark, str(tmp_path)).collect()) == want


def test_large_folder_is_handed_over_in_pieces(tmp_path, monkeypatch):
    _put(tmp_path, *[f"{i}.bin" for i in range(10)], ".hidden", "own/x")
    monkeypatch.setattr(opened, "LISTED_ROWS", 4)
    pieces = list(opened._entries(f"file:{tmp_path}", "own"))
    assert all(len(p) <= 4 for p in pieces)
    assert sorted(name for p in pieces for name in p["name"]) == [f"{i}.bin" for i in range(10)]


def test_digests_block_by_block(spark, tmp_path, monkeypatch):
    texts = {"a.bin": b"", "b.bin": b"x" * 100, "c d.bin": bytes(range(256)) * 10}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.digest for r in artifacts.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in texts.items()}
    leaves = {r.name: (r.n_leaves, r.digest) for r in artifacts.merkle_digests(spark, str(tmp_path), 100).collect()}
    for name, data in texts.items():
        parts = [data[i : i + 100] for i in range(0, len(data), 100)] or [b""]
        whole = b"".join(hashlib.sha256(p).digest() for p in parts)
        assert leaves[name] == (len(parts), hashlib.sha256(whole).hexdigest())
    rows = artifacts.file_digests(spark, str(tmp_path))
    sets = [artifacts.fileset_digest(r).first() for r in (rows, rows.orderBy("digest"))]
    assert sets[0] == sets[1] and sets[0].n_files == 3
    assert artifacts.fileset_digest(rows.where("name <> 'a.bin'")).first().digest != sets[0].digest
