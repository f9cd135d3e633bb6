"""Rejected lines and their numbers, stored snapshots, batches as CSV."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.operators import review as R
from graphloom.sources import records as S
from graphloom.sources.snapshots import SnapshotConflict, SnapshotTable


def reason(number):
    return {0: '{"k": ', 1: "[1]", 2: '{"pmid": 7, "n": "x"}', 3: '{"n": 1}', 4: " \t", 5: "", 6: '{"pmid": "a"}'}.get(number % 11, f'{{"pmid": "{number}", "n": {number}}}')


KINDS = {0: "json", 1: "schema", 2: "schema", 3: "schema", 6: "schema"}


def test_rejects_have_the_numbers_of_their_lines(spark, tmp_path):
    files = {"a.jsonl": 4000, "b.jsonl": 777, "c.jsonl": 0, "d.jsonl": 1}
    for name, n in files.items():
        (tmp_path / name).write_text("".join(reason(i) + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # many blocks a file
    try:
        good, bad = S.read_json_permissive(spark, str(tmp_path), "pmid string, n int", required=("pmid",), checks={"pmid: digits only": "not pmid rlike '^[0-9]+$'"})
        assert good.rdd.getNumPartitions() > 10
        found = {(os.path.basename(r["file"]), r["line"]): (r["kind"], r["message"], r["text"]) for r in bad.collect()}
        kept = good.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(name, i): KINDS[i % 11] for name, n in files.items() for i in range(1, n + 1) if i % 11 in KINDS}
    assert {k: v[0] for k, v in found.items()} == want
    assert all(text == reason(i) for (_, i), (_, _, text) in found.items())
    said = {i % 11: message for (_, i), (_, message, _) in found.items()}
    assert said == {0: "invalid JSON", 1: "expected an object; pmid: field required", 2: "n: expected int", 3: "pmid: field required", 6: "pmid: digits only"}
    assert kept == sum(n for n in files.values()) - len(want) - sum(1 for n in files.values() for i in range(1, n + 1) if i % 11 in (4, 5))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, status string, n int")


def state(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None and table.snapshot() is None
    first = table.write(rows(spark, (1, "new", 1), (2, "new", 1), (None, "new", 1)))
    assert (first.version, first.rows, first.parent) == (1, 3, 0)
    with pytest.raises(FileExistsError):
        table.write(rows(spark, (9, "x", 9)))
    with pytest.raises(FileExistsError):
        table.upsert(rows(spark, (9, "x", 9)), "id")
    second = table.upsert(rows(spark, (2, "done", 2), (3, "new", 2), (None, "done", 2)), "id", overwrite=True)
    assert (second.version, second.rows, second.parent) == (2, 4, 1)
    assert state(table) == sorted([(1, "new", 1), (2, "done", 2), (3, "new", 2), (None, "done", 2)], key=repr)
    # an upsert that fails while it writes leaves the version as it is
    broken = rows(spark, (1, "x", 1)).withColumn("status", F.raise_error(F.lit("no"))).select("id", F.col("status").cast("string").alias("status"), "n")
    with pytest.raises(PySparkException):
        table.upsert(broken, "id", overwrite=True)
    with pytest.raises(PySparkException, match="more than one row for key 4"):
        table.upsert(rows(spark, (4, "a", 1), (4, "b", 2)), "id", overwrite=True)
    assert table.snapshot() == second and len(state(table)) == 4
    third = table.upsert(rows(spark, (4, "a", 1), (4, "b", 2)), "id", latest=[F.desc("n")], overwrite=True)
    assert (4, "b", 2) in state(table) and third.rows == 5
    # older versions stay readable until they expire
    assert sorted(r["id"] is None or r["id"] for r in table.read(1).collect()) == [True, 1, 2]
    assert table.expire(keep=2) == [1] and table.versions() == [2, 3]
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_a_second_writer_is_refused(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.write(rows(spark, (1, "a", 1)))
    before = table.snapshot()
    table.write(rows(spark, (1, "b", 1)), overwrite=True)
    with pytest.raises(SnapshotConflict):
        table._commit(rows(spark, (1, "c", 1)), before)
    assert state(table) == [(1, "b", 1)]
    assert not [n for n in os.listdir(tmp_path / "t" / "_versions") if n.endswith(".draft")]


def test_upserts_from_edited_csv_files(spark, tmp_path):
    plan = spark.createDataFrame([("B1", i, f"p:{i}", None, ["low; odd", 'say "x"\nnow'] if i == 1 else []) for i in range(4)], "batch_id string, batch_position int, item_id string, reviewer string, reasons array<string>")
    path = str(tmp_path / "out")
    R.export_batch(plan, "B1", path, ["batch_id", "batch_position", "item_id", "reasons"], reviewer="ann")
    columns = ["batch_id", "batch_position", "item_id", "reasons", "assigned_reviewer", "batch_status"]
    back = {r["item_id"]: r for r in R.import_batch(spark, path, columns, "2024-05-01").collect()}
    assert len(back) == 4 and back["p:1"]["reasons"] == 'low; odd; say "x"\nnow'
    assert {(r["reviewer"], r["reviewer_id"], r["review_status"], r["decision_timestamp_utc"], r["batch_status"]) for r in back.values()} == {("ann", "ann", "pending", None, "in_review")}
    table = SnapshotTable(spark, f"file://{tmp_path}/q")
    for name, lines in (("one.csv", ["p:0,accepted,", "p:1,rejected,bea"]), ("two.csv", ["p:1,accepted,", "p:2,,"])):
        (tmp_path / name).write_text("item_id,review_status,reviewer\n" + "\n".join(lines) + "\n")
        new = R.import_batch(spark, f"file://{tmp_path}/{name}", ["item_id", "review_status", "reviewer"], name)
        table.upsert(new.select("item_id", "review_status", "reviewer", "decision_timestamp_utc"), "item_id", overwrite=True)
    assert state(table) == [("p:0", "accepted", None, "one.csv"), ("p:1", "accepted", None, "two.csv"), ("p:2", "pending", None, None)]
    (tmp_path / "bad.csv").write_text("item_id,review_status,reviewer\np:3,maybe,\n")
    with pytest.raises(PySparkException, match="unknown review status maybe"):
        table.upsert(R.import_batch(spark, f"file://{tmp_path}/bad.csv", ["item_id", "review_status", "reviewer"], "x").select("item_id", "review_status", "reviewer"), "item_id", overwrite=True)
    assert table.snapshot().version == 2
