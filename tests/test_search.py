"""The index of trigrams against a scan; previews; parts that no query reaches."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.functions import identifiers
from talentweave.operators import graph, reference, releases, search
from talentweave.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    words = ["Lead", "plan", "ÄRZTE", "water", "x", "budgét", "漢字", "a_b%c"]
    data = [(k, " ".join(r.choice(words) for _ in range(r.randrange(5))) if r.random() < 0.9 else None, r.choice(["Chef", "planner", None, "ab"])) for k in range(300)]
    return spark.createDataFrame(data, "id int, title string, text string").cache()


def test_the_index_finds_what_a_scan_finds(rows, tmp_path):
    path = f"file://{tmp_path}/index"
    search.build(rows, "id", ["title", "text"], path, buckets=16)
    for word in ("lead", " LEAD plan ", "ärz", "planner", "漢字 a", "a_b%c", "zzz", "ab", "x", " ", "t"):
        w = word.strip().lower()
        want = {r.id for r in rows.collect() if any(w in (c or "").lower() for c in (r.title, r.text)) or not w}
        assert {r.id for r in search.keyword_search(rows, "id", ["title", "text"], word, path, buckets=16).collect()} == want, word
    # grams that lie in two fields don't make a hit, and an empty table has an index too
    assert search.candidates(rows.sparkSession, path, "lead chef", buckets=16).count() == 0


def test_a_search_reads_the_buckets_of_its_grams(rows, tmp_path):
    path = f"file://{tmp_path}/index"
    search.build(rows, "id", ["title", "text"], path, buckets=64)
    all_files = len(rows.sparkSession.read.parquet(path).inputFiles())
    plan = search.candidates(rows.sparkSession, path, "lead", buckets=64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    used = {f for f in rows.sparkSession.read.parquet(path).where(F.col("gram").isin("lea", "ead")).select("bucket").distinct().collect()}
    assert len(used) == 2 < all_files


def test_a_row_for_each_sheet(spark):
    f = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "code string, name string")
    g = spark.createDataFrame([("a", "A"), ("b", "X"), ("c", None), ("d", None)], "code string, name string")
    assert tuple(reference.sheet_changes("s", f, g, ["code"]).first()) == ("s", 3, 4, 1, 0, 1)
    assert tuple(reference.sheet_changes("s", f.limit(0), f.limit(0), ["code"]).first()) == ("s", 0, 0, 0, 0, 0)


def test_flags_lines_parameters_and_gates(spark, tmp_path):
    assert [r[0] for r in spark.createDataFrame([(1,), (0,), (None,)], "f int").select(reference.yes_no(F.col("f"))).collect()] == ["Yes", "No", "No"]
    path = f"file://{tmp_path}/lines"
    for k in range(2):
        files.append_jsonl(spark.createDataFrame([("a", k), (f"b{k}", k)], "id string, v int"), path)
    got = files.read_jsonl(spark, path, "id string, v int", "id").collect()
    assert sorted(r.id for r in got) == ["a", "b0", "b1"]
    assert releases.flat_parameters({"b": {"d": 1.5, "c": [1]}, "a": "x"}) == [("a", '"x"', "str"), ("b.c", "[1]", "list"), ("b.d", "1.5", "float")]
    assert identifiers.fingerprint_of({"a": 1, "b": 2}) == identifiers.fingerprint_of({"b": 2, "a": 1}) != identifiers.fingerprint_of({"a": 1})
    graph.require_ready(spark.createDataFrame([(True, "")], "ready boolean, blockers string"))
    with pytest.raises(ValueError, match="no_activities"):
        graph.require_ready(spark.createDataFrame([(False, "no_activities")], "ready boolean, blockers string"))


def test_a_byte_order_mark_is_no_part_of_the_first_name(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,x\n")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/a.csv", ["id", "name"]).collect()] == [("1", "x")]
