"""Reader, records and feeds: round trips, damaged input, bounded streams."""

import datetime as dt
import os

import grids as G  # noqa: F401  (shared path of the helpers)
from test_workbook import write_book

from unitwise import schema
from unitwise.operators import records as R
from unitwise.sources.workbook import read_cells, unreadable_files
from unitwise.streaming import progress as X


def test_reader_keeps_upper_case_names_and_reports_damage(spark, tmp_path):
    write_book(tmp_path / "A.XLSX")
    write_book(tmp_path / "b.xlsm")
    (tmp_path / "c.xlsx").write_bytes(b"no zip file")
    cells = read_cells(spark, str(tmp_path))
    assert cells.select("path").distinct().count() == 2
    bad = unreadable_files(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and bad[0].path.endswith("c.xlsx") and bad[0].message


def test_several_changes_of_a_job(spark):
    now = spark.createDataFrame([("a", "new", 1), ("b", "new", 2)], "job_id string, status string, n long")
    changes = spark.createDataFrame(
        [("a", "run", None, 1), ("a", "done", None, 2), ("a", None, 7, 1), ("x", "run", 1, 1)],
        "job_id string, status string, n long, seq int")
    found = {tuple(r) for r in R.upsert_records(now, changes, order="seq").collect()}
    assert found == {("a", "done", 7), ("b", "new", 2)}
    named = changes.selectExpr("job_id", "status", "n", "seq", "array('n') AS fields")
    found = {tuple(r) for r in R.upsert_records(now, named, set_fields="fields", order="seq").collect()}
    assert found == {("a", "new", None), ("b", "new", 2)}


def test_records_round_trip(spark, tmp_path):
    row = ("j1", "f.xlsx", None, "complete", 5, None, dt.datetime(2024, 1, 2, 3), None, 10, None, True)
    records = spark.createDataFrame([row], schema.RECORD)
    path = R.write_records(records, str(tmp_path), "1")
    assert [tuple(r) for r in R.read_records(spark, path).collect()] == [row]


def test_extractions_are_written(spark, tmp_path):
    one = lambda text, *values: spark.createDataFrame([values], text)
    R.write_extractions(
        str(tmp_path), one("doc_id long, n long", 1, 2), one("doc_id long, t long", 1, 3),
        one("doc_id long, name string, ok boolean", 1, "sum", True), one("doc_id long, unit string", 1, "1A"),
        one("doc_id long, issue string", 1, "gap"))
    head = spark.read.json(f"{tmp_path}/documents").first()
    assert (head.doc_id, head.summary.n, head.stated.t, head.checks[0].name) == (1, 2, 3, "sum")
    assert spark.read.json(f"{tmp_path}/units").first().unit == "1A"
    assert spark.read.json(f"{tmp_path}/issues").first().issue == "gap"


def test_stale_sessions_leave_finished_jobs_out(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, at(0), "extracting"), (1, 2, at(5), "complete"), (2, 3, at(0), "extracting"), (2, 4, at(9), "extracting")]
    events = spark.createDataFrame(rows, "job_id long, event_id long, event_at timestamp, stage string")
    found = X.stale_sessions(events).collect()
    assert [(r.job_id, r.stale_at, r.n_updates) for r in found] == [(2, at(19), 2)]


def test_incremental_ingest(spark, tmp_path):
    for k, text in enumerate(("x", "y", "x")):
        (tmp_path / f"{k}.txt").write_text(text)
    files = spark.readStream.format("binaryFile").schema(
        spark.read.format("binaryFile").load(str(tmp_path)).schema).load(str(tmp_path))
    query = X.incremental_ingest(files).select("sha256").writeStream.format("memory").queryName("ingested").trigger(
        availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("ingested").count() == 2


def test_old_dated_files_of_a_later_batch_pass_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    got = []

    def run(checkpoint):
        files = spark.readStream.format("binaryFile").option("maxFileAge", "9000d").schema(
            spark.read.format("binaryFile").load(str(source)).schema).load(str(source))
        X.incremental_ingest(files).writeStream.foreachBatch(X.ingest_into(str(out), lambda rows, k: got.append(
            sorted(bytes(r.content).decode() for r in rows.collect())))).option(
            "checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    def put(name, text, days=0):
        (source / name).write_text(text)
        os.utime(source / name, (1.7e9 - 86400 * days,) * 2)

    put("a.txt", "x")
    run("first")
    put("b.txt", "y", 400)
    put("c.txt", "x", 400)
    run("first")
    put("d.txt", "z", 900)
    run("first")
    assert [x for x in got if x] == [["x"], ["y"], ["z"]]
    # A stream that has forgotten every digest still finds them in the manifest.
    put("e.txt", "w", 900)
    got.clear()
    spark.read.parquet(str(out)).select("sha256").write.parquet(str(tmp_path / "kept/batch_id=-1"))
    out = tmp_path / "kept"
    run("second")
    assert [x for x in got if x] == [["w"]]
