"""Readers, sinks and the resume log on temporary files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from colweave.sources import files, sinks
from colweave.streaming import resultlog


def test_ground_truth_readers(spark):
    d = tempfile.mkdtemp(prefix="cw-io-")
    p = os.path.join(d, "gt.csv")
    with open(p, "w") as f:
        f.write("source_column,target_column\na,x\nb,y\na,z\nb,y\n,q\n")
    rk = {r["source"]: r["target"] for r in files.ranking_ground_truth(spark, p).collect()}
    assert rk["a"] == "z" and rk["b"] == "y"
    pairs = files.pair_ground_truth(spark, p, positional=True).collect()
    assert len(pairs) == 3


def test_benchmark_folder_skips_empty_mappings(spark):
    root = tempfile.mkdtemp(prefix="cw-bench-")
    for pair, matches in [("p1", [{"source_column": "a", "target_column": "b"}]), ("p2", [])]:
        os.makedirs(os.path.join(root, pair))
        for side in ("source", "target"):
            with open(os.path.join(root, pair, f"{pair}_{side}.csv"), "w") as f:
                f.write("a,b\n1,2\n")
        with open(os.path.join(root, pair, f"{pair}_mapping.json"), "w") as f:
            json.dump({"matches": matches}, f)
    wl = files.benchmark_folder(spark, root).collect()
    assert [r["pair_id"] for r in wl] == ["p1"]
    m = files.mapping_json(spark, os.path.join(root, "p1", "p1_mapping.json")).collect()
    assert (m[0]["source"], m[0]["target"]) == ("a", "b")


def test_result_log_resume(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cw-log-"), "results")
    tables = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "table_id string")
    wl = resultlog.worklist(tables, ["baseline", "no_bp"])
    done = spark.createDataFrame([("baseline", "t1", 0.5)], "method string, table_id string, mrr double")
    resultlog.append_results(done, path)
    log = resultlog.read_results(spark, path)
    todo = resultlog.pending(wl, log, ["method", "table_id"])
    assert todo.count() == 5


SCHEMA = "method string, value long"


def _log(spark, path):
    return sorted(tuple(r) for r in resultlog.committed_results(spark, path, SCHEMA).select("run", "batch", "method", "value").collect())


def test_rerun_after_failed_commit_leaves_each_result_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert _log(spark, path) == [] and resultlog.commits(spark, path).count() == 0
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], SCHEMA)
    with monkeypatch.context() as m:
        def stopped(*_):
            raise RuntimeError("lost before the commit")

        m.setattr(resultlog, "mark_committed", stopped)
        with pytest.raises(RuntimeError):
            resultlog.commit_results(first.unionByName(first), path, "07", 0)
    assert _log(spark, path) == []  # staged rows are not part of the log
    assert resultlog.commit_results(first, path, "07", 0)
    assert not resultlog.commit_results(first, path, "07", 0)
    want = [("07", 0, "a", 1), ("07", 0, "b", 2), ("07", 0, "b", 2)]
    assert _log(spark, path) == want
    assert resultlog.commit_results(first.limit(0), path, "07", 1)  # an empty batch is a batch
    assert resultlog.commit_results(first.filter("method = 'a'"), path, "other", 0)
    assert _log(spark, path) == [*want, ("other", 0, "a", 1)]
    assert sorted(tuple(r) for r in resultlog.commits(spark, path).collect()) == [("07", 0, 3), ("07", 1, 0), ("other", 0, 1)]
    with pytest.raises(ValueError):
        resultlog.commit_results(first, path, "a/b", 0)


def test_replayed_stream_is_logged_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1).write.parquet(source)
    for checkpoint in ("one", "two"):  # the second one has lost the first one's progress
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = stream.writeStream.foreachBatch(resultlog.committing_sink(path, "stream")).option(
            "checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert _log(spark, path) == [("stream", 0, "a", 1), ("stream", 0, "b", 2)]


def test_miss_log(spark):
    preds = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.5, 2)], "source string, target string, score double, rank int")
    gt = spark.createDataFrame([("a", "z"), ("a", "x")], "source string, target string")
    rows = sinks.miss_log(preds, gt, "run1").collect()
    assert len(rows) == 1 and rows[0]["target"] == "z" and rows[0]["predicted"] == "x, y"


def test_csv_folder_by_each_files_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text('anchor, positive ,negative\nx,"two\nlines",NA\n\ny,p\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("negative,anchor,extra,anchor\nn,z,1,again,too many\n", encoding="utf-8-sig")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "heads.csv").write_text("anchor,positive\n")
    (tmp_path / "note.txt").write_text("no,table\n")
    cells = {(r["file"].rsplit("/", 1)[1], r["row"], r["col_pos"]): (r["col_name"], r["value"]) for r in files.csv_cells(spark, str(tmp_path)).collect()}
    second = cells.pop(("two.csv", 0, 3))
    assert second[1] == "again" and second[0] != "anchor"
    assert cells == {
        ("one.csv", 0, 0): ("anchor", "x"), ("one.csv", 0, 1): ("positive", "two\nlines"), ("one.csv", 0, 2): ("negative", None),
        ("one.csv", 1, 0): ("anchor", "y"), ("one.csv", 1, 1): ("positive", "p"), ("one.csv", 1, 2): ("negative", None),
        ("two.csv", 0, 0): ("negative", "n"), ("two.csv", 0, 1): ("anchor", "z"), ("two.csv", 0, 2): ("extra", "1")}
    union = files.csv_union(spark, str(tmp_path), ["anchor", "positive", "negative"])
    assert sorted((r["anchor"], r["positive"] or "", r["negative"] or "") for r in union.collect()) == [("x", "two\nlines", ""), ("y", "p", ""), ("z", "", "n")]
