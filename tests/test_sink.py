"""Run folders: whole or not at all, whatever happens to the tasks that write them."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import folders, run_sink, saved_files
from tessera.sources.artifacts import read_artifacts


def artifacts(spark, runs, kinds=run_sink.KINDS):
    return spark.createDataFrame([(r, k, "" if (r, k) == ("r3", "result") else f"{k} of {r} é\n" * (1 + i % 5)) for i, r in enumerate(runs) for k in kinds], "run_id string, kind string, content string")


def test_runs_are_read_back_as_their_manifests_tell(spark, tmp_path):
    df = artifacts(spark, [f"r{i}" for i in range(23)])
    run_sink.write_runs(df, str(tmp_path))
    got = run_sink.read_runs(spark, str(tmp_path))
    assert sorted(got.select("run_id", "kind", "content").collect()) == sorted(df.collect()) and got.where("NOT sound").count() == 0
    m = {(r.run_id, r.kind): r for r in run_sink.read_manifests(spark, str(tmp_path)).collect()}
    assert len(m) == 230 and all(m[r.run_id, r.kind].sha256 == hashlib.sha256(r.content.encode()).hexdigest() and m[r.run_id, r.kind].bytes == len(r.content.encode()) for r in df.collect())
    assert m["r1", "state"].authority == "authoritative" and run_sink.unnamed(spark, str(tmp_path)).count() == 0
    run_sink.write_runs(artifacts(spark, ["r4"]).withColumn("content", F.lit("second")), str(tmp_path))
    assert {r.content for r in run_sink.read_runs(spark, str(tmp_path)).where("run_id = 'r4'").collect()} == {"second"}
    assert run_sink.unnamed(spark, str(tmp_path)).count() == 10  # of the first attempt
    m = run_sink.read_manifests(spark, str(tmp_path)).where("run_id = 'r7' AND kind = 'state'").first()
    with open(f"{tmp_path}/r7/{m.file}", "a") as f:
        f.write("damage")
    assert [tuple(r) for r in run_sink.read_runs(spark, str(tmp_path)).where("NOT sound").select("run_id", "kind").collect()] == [("r7", "state")]


def test_incomplete_runs_have_no_manifest(spark, tmp_path):
    df = artifacts(spark, ["whole"]).union(artifacts(spark, ["half"], run_sink.KINDS[:9]))
    run_sink.write_runs(df, str(tmp_path))
    assert {r.run_id for r in run_sink.read_runs(spark, str(tmp_path)).collect()} == {"whole"}
    assert run_sink.unnamed(spark, str(tmp_path)).count() == 9
    assert [(r.runs, r.incomplete) for r in spark.read.json(f"{tmp_path}/commit-*.json").collect()] == [(1, 1)]


def test_a_task_that_dies_in_mid_write_leaves_no_half_run(spark, tmp_path):
    """The last run's seventh artifact fails; earlier runs of the task stand, and this one isn't seen until it is written again."""
    df = artifacts(spark, ["a", "b", "c"]).coalesce(1)
    dies = df.withColumn("content", F.when((F.col("run_id") == "c") & (F.col("kind") == "spans"), F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    spark.dataSource.register(run_sink.RunArtifacts)
    ordered = dies.coalesce(1).sortWithinPartitions("run_id")
    with pytest.raises(Exception, match="killed|abort"):
        run_sink.write_runs(ordered, str(tmp_path))
    assert "c" not in {r.run_id for r in run_sink.read_manifests(spark, str(tmp_path)).collect()} if os.path.isdir(f"{tmp_path}/a") else True
    writer = run_sink.RunWriter(str(tmp_path), run_sink.KINDS)

    def rows():
        for i, row in enumerate(df.where("run_id = 'c'").sort("kind").collect()):
            if i == 6:
                raise RuntimeError("killed")
            yield row

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert len(os.listdir(f"{tmp_path}/c")) == 6
    run_sink.write_runs(artifacts(spark, ["z"]), str(tmp_path))
    assert "c" not in {r.run_id for r in run_sink.read_runs(spark, str(tmp_path)).collect()}
    run_sink.write_runs(df, str(tmp_path))
    assert {r.run_id for r in run_sink.read_runs(spark, str(tmp_path)).where("sound").collect()} == {"a", "b", "c", "z"}
    assert run_sink.unnamed(spark, str(tmp_path)).count() >= 6


def test_names_stay_inside_the_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no name"):
        run_sink.write_runs(artifacts(spark, ["../out"]), str(tmp_path))
    assert not os.path.exists(f"{tmp_path.parent}/out")


def test_object_stores_are_named_as_hadoop_names_them():
    store, root = folders.store("s3a://bucket/runs?region=eu-west-1")
    assert store.type_name == "s3" and root == "bucket/runs"
    assert folders.store("/tmp/x")[1] == "/tmp/x" and folders.store("file:///tmp/x")[1] == "/tmp/x"


def test_no_list_of_files_passes_through_the_driver(spark, tmp_path):
    """Tasks find runs and open their files by name; folders without a manifest, and manifests that are none, are passed over."""
    run_sink.write_runs(artifacts(spark, ["r1", "r2", "r3"]), str(tmp_path))
    os.mkdir(f"{tmp_path}/empty")
    with open(f"{tmp_path}/r2/{run_sink.MANIFEST}", "w") as f:
        f.write("{broken")
    os.remove(f"{tmp_path}/r1/{run_sink.read_manifests(spark, str(tmp_path)).where("run_id = 'r1' AND kind = 'spans'").first().file}")
    got = run_sink.read_runs(spark, str(tmp_path))
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.run_id, r.kind) for r in got.collect()) == sorted((r, k) for r in ("r1", "r3") for k in run_sink.KINDS)
    assert [tuple(r) for r in got.where("NOT sound").select("run_id", "kind", "content").collect()] == [("r1", "spans", None)]


def test_files_are_dealt_to_all_tasks(spark):
    """Rows too small for Spark to keep their partitions still go to as many tasks as shuffles have."""
    one = folders.dealt(spark.range(1000).selectExpr("CAST(id AS STRING) AS session_id"), "session_id")
    assert one.select(F.spark_partition_id()).distinct().count() == 4


def test_groups_are_dealt_to_all_tasks(spark):
    """Groups by the key lie as they would be dealt; they are dealt all the same, as Spark would merge them into one task."""
    some = spark.range(1000).selectExpr("CAST(id % 500 AS STRING) AS session_id").groupBy("session_id").count()
    assert folders.dealt(some, "session_id").select(F.spark_partition_id()).distinct().count() == 4


def test_saved_files_are_written_and_read_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(f"s {i}", "output.txt", None if i == 3 else f"é {i}\n") for i in range(40)] + [(None, "output.txt", "x")], "run_id string, kind string, content string")
    saved_files.write_files(df, f"{tmp_path}/saved")
    assert {os.listdir(f"{tmp_path}/saved/s {i}")[0] for i in range(40)} == {"output.txt"} and len(os.listdir(f"{tmp_path}/saved")) == 40
    got = read_artifacts(spark, f"{tmp_path}/saved/*")
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    # A file without a byte gives no row.
    assert sorted(got.collect()) == [(r, "output", c) for r, _, c in sorted(df.where("run_id IS NOT NULL AND content IS NOT NULL").collect())]
    with pytest.raises(Exception, match="no name"):
        saved_files.write_files(spark.createDataFrame([("../out", "k", "")], df.schema), f"{tmp_path}/saved")


def test_patterns_of_saved_files(spark, tmp_path):
    """As Spark reads them: folders at any depth, hidden names only where a pattern matches them, patterns on any level."""
    for name in ("a1/x.json", "a2/x.json", "b1/y.txt", "b1/in/z.txt", "_old/x.json", ".tmp/x.json", "a1/.x.json.1", "a1/.x.json.crc", "a1/_SUCCESS", "k=_1/x.json", "a,c/{x", "top.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(name)
    patterns = ["*", "*/*", "*/x.json", "a[1-9]", "[^a]*/*", "{a1,b1}/*", "?1/*.{json,txt}", "a1/x.json", "b1", "", "a,c", "*,c/*", r"a,c/\{*", "b*/in/*", "top.*", "*/*/*"]
    for p in patterns:
        told = spark.read.text(f"{tmp_path}/{p}", wholetext=True, recursiveFileLookup=True)
        for root in (str(tmp_path), f"file://{tmp_path}"):
            got = saved_files.read_files(spark, f"{root}/{p}".rstrip("/")).select(F.col("content").cast("string"))
            assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in told.collect()) != [], p
    with open(f"{tmp_path}/a2/.x.json.{'0' * 32}", "w") as f:
        f.write("half of it")
    assert [bytes(r.content) for r in saved_files.read_files(spark, f"{tmp_path}/a2/*").collect()] == [b"a2/x.json"]
    with pytest.raises(Exception, match="nothing"):
        saved_files.read_files(spark, f"{tmp_path}/none*").collect()
