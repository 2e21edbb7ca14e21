"""Sources, sinks, and the progress stream against the same rows as a batch."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docassay.sources import packs, sinks, uploads
from docassay.streaming import progress


def docx(texts):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(docx([("Heading1", "Scope"), ("Normal", "Text")]))
    (tmp_path / "c.docx").write_bytes(docx([("Heading2", "Scope"), ("Normal", "Text"), ("Normal", " ")]))
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "e.txt").write_bytes(b"plain")
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x", "y")
    (tmp_path / "f.docx").write_bytes(bad.getvalue())
    got = uploads.files(spark, str(tmp_path))
    codes = {r.name: (r.kind, r.reject_code) for r in got.collect()}
    assert codes == {"a.pdf": ("pdf", None), "b.pdf": ("docx", "TYPE_CONFLICT"), "c.docx": ("docx", None), "d.docx": ("docx", "ARCHIVE_BROKEN"), "e.txt": ("unknown", "TYPE"), "f.docx": ("docx", "ARCHIVE_PATH")}
    assert [(r.text, r.level) for r in uploads.docx_items(got).orderBy("seq").collect()] == [("Scope", 2), ("Text", None)]


def test_packs(spark, tmp_path):
    for name, rules in (("a", [{"rule_id": "r1", "standard": "S", "kind": "terminology", "terminology_params": {"term": "t", "preferred_term": "t", "deprecated_terms": ["u"], "context_keywords": []}}]), ("b", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"pack_id": name, "standard_code": f"QN {name}", "active": True}))
        (tmp_path / name / "rules.json").write_text(json.dumps(rules))
    got = packs.registry(spark, str(tmp_path))
    assert {(r.pack_id, r.rules, r.configured) for r in got.collect()} == {("a", 1, True), ("b", 0, False)}
    assert packs.rules(spark, str(tmp_path)).first().terminology_params.deprecated_terms == ["u"]
    cited = spark.createDataFrame([("qn B",)], "code string")
    assert {r.pack_id for r in packs.resolved(got, cited, ["a"]).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="zzz"):
        packs.resolved(got, cited, ["zzz"])


def test_replaced_documents(spark, tmp_path):
    out = str(tmp_path / "issues")
    first = spark.createDataFrame([(d, f"old{d}") for d in range(50)], "doc_id long, m string")
    sinks.replace_documents(first, out, 4)
    sinks.replace_documents(spark.createDataFrame([(3, "new"), (3, "more"), (99, "x")], "doc_id long, m string"), out, 4)
    got = spark.read.parquet(out)
    assert got.count() == 52 and {r.m for r in got.where("doc_id = 3").collect()} == {"new", "more"} and got.where("doc_id = 7").first().m == "old7"


def test_documents_replaced_by_nothing(spark, tmp_path):
    out = str(tmp_path / "issues")
    sinks.replace_documents(spark.createDataFrame([(d, f"old{d}") for d in range(20)], "doc_id long, m string"), out, 64)
    run = spark.createDataFrame([(2,), (5,)], "doc_id long")
    sinks.replace_documents(spark.createDataFrame([(5, "new")], "doc_id long, m string"), out, 64, run)
    got = {r.doc_id: r.m for r in spark.read.parquet(out).collect()}
    assert got == {**{d: f"old{d}" for d in range(20) if d != 2}, 5: "new"}


def test_issues_of_later_stages_in_one_write(spark, tmp_path):
    out = str(tmp_path / "issues")
    first, later = spark.createDataFrame([(1, "a")], "doc_id long, m string"), spark.createDataFrame([(1, 3), (2, 4)], "doc_id long, page int")
    sinks.append_issues(first, later, folder=out, buckets=4)
    assert {(r.doc_id, r.m, r.page) for r in spark.read.parquet(out).collect()} == {(1, "a", None), (1, None, 3), (2, None, 4)}


def test_guards(spark):
    from docassay.sources import guards

    cell = "cell_id long, doc_id long, table_index int, row_index int, col_index int, row_span int, col_span int, bbox struct<page_index:int>"
    rows = [(i, 1, i, 0, 0, 1, 1, (0,)) for i in range(22)] + [(100, 2, 0, 99, 29, 1, 1, None), (100, 2, 0, 99, 29, 1, 1, None), (101, 3, 0, 99, 0, 2, None, None), (102, 4, 0, 0, 30, None, 1, None)] + [(1000 + i, 5, 0, i % 50, i // 50, 1, 1, (1,)) for i in range(501)]
    got = {(r.doc_id, r.table_index): (r.page_index, r.cells, r.warnings) for r in guards.guarded(spark.createDataFrame(rows, cell)).collect()}
    assert got[1, 19][2] == "" and got[1, 20][2] == "TOO_MANY_TABLES" and got[2, 0] == (0, 1, "") and got[3, 0][2] == "TOO_MANY_ROWS" and got[4, 0][2] == "TOO_MANY_COLUMNS" and got[5, 0] == (1, 501, "TOO_MANY_CELLS")
    assert guards.guarded(spark.createDataFrame([], cell)).count() == 0


def test_unreadable_folders_are_errors(spark, tmp_path):
    broken = tmp_path / "issues"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="."):
        sinks.replace_documents(spark.createDataFrame([(5, "new")], "doc_id long, m string"), str(broken), 4)
    assert (broken / "part-0.parquet").read_text() == "no parquet"
    (tmp_path / "stage").mkdir()
    (tmp_path / "stage" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="."):
        sinks.read_stage(spark, str(tmp_path), "stage", "a int").count()
    assert sinks.read_stage(spark, str(tmp_path), "other", "a int").count() == 0


def test_cut_tables_are_deleted(spark):
    from docassay import session

    kept = session.cut(spark.range(5).toDF("id"))
    path = session._CUT[-1][1]
    assert kept.count() == 5 and session.exists(spark, path)
    session.clear()
    assert not session.exists(spark, path)


def test_stages_and_attempts(spark, tmp_path):
    sinks.write_stage(spark.range(3), str(tmp_path), "s", "v1")
    assert sinks.read_stage(spark, str(tmp_path), "s", "id long, rule_version string").where("rule_version = 'v1'").count() == 3
    assert sinks.read_stage(spark, str(tmp_path), "none", "id long").count() == 0
    earlier = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "document_id long, stage string, attempt int")
    assert {(r.stage, r.attempt) for r in sinks.append_runs(spark.createDataFrame([(1, "a"), (1, "b")], "document_id long, stage string"), earlier).collect()} == {("a", 3), ("b", 1)}


def runs():
    t = datetime(2025, 1, 1)
    rows = [(d, s, status, p, t + timedelta(minutes=m), d * 100 + i) for d in (1, 2, 3) for i, (s, status, p, m) in enumerate([("EXTRACTING", "RUNNING", 10, 0), ("EXTRACTING", "COMPLETED", 100, 2), ("TABLE_MATH", "RUNNING", 50, 3), ("OTHER", "FAILED", 0, 1)])]
    return rows + [(1, "AGGREGATION", "COMPLETED", 100, t + timedelta(minutes=9), 190), (None, "X", "RUNNING", 0, t, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows, folder = runs(), str(tmp_path / "in")
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], progress.RUNS).coalesce(1).write.mode("append").parquet(folder)
    stream = progress.read_runs(spark, folder)
    q = progress.latest_runs(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("SELECT * FROM latest").collect()))
    want = sorted(map(tuple, progress.latest_runs(spark.createDataFrame(rows, progress.RUNS)).collect()))
    assert got == want and len(got) == 10


def test_snapshots_and_end(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (runs()[:8], runs()[8:]):
        spark.createDataFrame(part, progress.RUNS).coalesce(1).write.mode("append").parquet(folder)
    # a processing-time timeout asks for batches without data for ever; this run is to end with its data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = progress.write_snapshots(progress.snapshots(progress.read_runs(spark, folder)), out, str(tmp_path / "ck"), availableNow=True)
    ended = q.awaitTermination(45)
    q.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert ended
    rows = spark.read.parquet(out)
    last = {r.document_id: r for r in rows.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("batch").desc()))).where("n = 1").collect()}
    assert last[1].closed and last[1].percent == 100 and not last[2].closed and last[2].current_stage == "TABLE_MATH" and last[2].failed_stage == "OTHER"
    assert [s["stage"] for s in json.loads(last[2].stages)] == ["EXTRACTING", "TABLE_MATH", "OTHER"]
    frame = progress.frames(rows.where("document_id = 1 AND closed")).first().frame
    assert frame.startswith("event: end\ndata: {") and frame.endswith("\n\n")
