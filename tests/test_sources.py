"""Sources, releases, extraction and streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from talentweave.operators import extraction, quality, releases, vocabulary
from talentweave.sources import files, workbooks
from talentweave.streaming import ingest


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True), (2, 'a "q"\nb', False)], "id int, t string, f boolean")
    files.write_csv(df, str(tmp_path / "c"), ["id", "t", "f"], one_file=True)
    back = files.read_csv(spark, str(tmp_path / "c"), ["id", "t", "f"]).orderBy("id").collect()
    assert [(r.id, r.t or "", r.f) for r in back] == [("1", "", "true"), ("2", 'a "q"\nb', "false")]


def test_jsonl_keeps_the_last_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\nnot json\n{"k": 1, "v": "c"}\n')
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k int, v string", "k")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "c"), (2, "b")]


def test_json_directory_leaves_out_summaries(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "_summary.json").write_text('{"k": 2}')
    assert [r.k for r in files.read_json(spark, str(tmp_path), "k int").collect()] == [1]


def test_workbook_round_trip_and_header_discovery(spark):
    data = workbooks.write_workbook({"Notes": [["x"]], "Codes": [["a title"], [], ["Code", "Parent Code"], ["10", "=SUM(1)"], ["", None], ["11", "10"]]})
    got = workbooks.read_sheet(spark, data, "Codes", ["code", "parent_code"]).collect()
    assert [tuple(r) for r in got] == [("10", "'=SUM(1)"), ("11", "10")]
    with pytest.raises(ValueError):
        workbooks.read_sheet(spark, data, "Codes", ["nothing"])
    with pytest.raises(ValueError):
        workbooks.sheet_rows(data, "Missing")


def docx(*paragraphs, table=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    for row in table or ():
        body += ""
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table or ())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_word_extraction(spark, tmp_path):
    good = docx("Lead Analyst", "Primary purpose of the role", "Leads analysis.", "Key accountabilities", "Plan the work", "of the team.", "Report.", "Key challenges", "Many.", "Essential requirements", "A degree.", "Key relationships", table=[["Internal"], ["Team", "Guide"], ["Board", ""], ["Focus capabilities"], ["Manage Self (MS1)", "Adept"]])
    (tmp_path / "a.docx").write_bytes(good)
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    got = {r.path.rsplit("/", 1)[1]: r for r in extraction.extract_files(files.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.docx", "b.docx"}
    a = got["a.docx"]
    assert a.title == "Lead Analyst" and a.sections["primary_purpose"] == "Leads analysis."
    assert [(i.section, i.text) for i in a["items"]][:2] == [("key_accountabilities", "Plan the work of the team."), ("key_accountabilities", "Report.")]
    assert [(r.grouping, r.who, r.why) for r in a.relationships] == [("Internal", "Team", "Guide"), ("Internal", "Board", "")]
    assert [(c.kind, c.name, c.code, c.level) for c in a.capabilities] == [("Focus", "Manage Self", "MS1", "Adept")]
    assert [i.issue_type for i in a.issues] == ["Incomplete relationship row"] and got["b.docx"].status == "Extraction failed"


def test_publish_refuses_and_keeps_the_current_release(spark, tmp_path):
    store = releases.Releases(spark, f"file://{tmp_path}/r")
    one = store.publish({"t": spark.range(3).toDF("x")})
    assert store.current() == one == store.publish({"t": spark.range(3).toDF("x")})

    def refuse(tables):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.publish({"t": spark.range(4).toDF("x")}, [refuse])
    assert store.current() == one
    two = store.publish({"t": spark.range(4).toDF("x"), "u": spark.range(1).toDF("x")})
    assert {(r.name, r.change) for r in store.compare(one, two).collect()} == {("t", "changed"), ("u", "added")}


def test_upserts_are_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = releases.upsert(now, new, ["k"])
    assert sorted(map(tuple, releases.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    dim = spark.createDataFrame([(1, "x", ""), (2, "y", "Y")], "id long, name string, code string")
    got = releases.get_or_create(dim, spark.createDataFrame([("x", "X"), ("z", "Z")], "name string, code string"), "name", "code")
    assert sorted(map(tuple, got.collect())) == [(1, "x", "X"), (2, "y", "Y"), (3, "z", "Z")]


def test_matrix_rules(spark):
    cells = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 2), (2, 2, 1), (1, 3, 5)], "source int, target int, tier int")
    got = {(r.source, r.target, r.issue) for r in quality.matrix_issues(cells).collect()}
    assert got == {(2, 2, "diagonal"), (1, 3, "unknown_tier"), (1, 3, "hole"), (1, 2, "asymmetric"), (2, 1, "asymmetric")}


def test_assignment_falls_back(spark):
    short = spark.createDataFrame([(1, f"a{k}", k, 0.0) for k in range(1, 12)] + [(2, "a1", 1, 0.0)], "role_id int, activity_id string, place int, similarity double")
    picked = vocabulary.assigned(short, lambda options: ["a3", "a3", "zzz"] if len(options) > 1 else []).collect()
    assert [(r.role_id, r.activity_rank, r.activity_id, r.fallback_used) for r in sorted(picked)] == [(1, 1, "a3", False), (2, 1, "a1", True)]
    assert vocabulary.assigned(short).where("role_id = 1").count() == 8


def test_stream_ingest_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = ingest.event_stream(spark, str(tmp_path / "in"), events.schema)
        ingest.ingest_latest(stream, str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / "cp")).awaitTermination()
        if not k:
            events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out" / "version=1"))
    want = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert got.select("user_id", "event_id").exceptAll(want).count() == 0 and got.count() == want.count()
