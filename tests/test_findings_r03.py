"""What a round of review found: queries against their SQL on tables that the test data don't have."""

import json
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from talentweave import registry
from talentweave.operators import graph, hierarchy, pools, reference, similarity

from .test_parity import SF, TABLES, norm
from .test_pools import some_roles


@pytest.fixture
def check(spark, tmp_path):
    """Compares a query with its SQL over the smallest tables, some of them changed."""

    def run(name, **changed):
        for t in TABLES:
            if t in changed:
                changed[t](spark.read.parquet(f"{SF}/{t}.parquet")).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            else:
                shutil.copy(f"{SF}/{t}.parquet", tmp_path)
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t in changed else ''}'")
        found = con.execute(registry.oracle_sql()[name])
        names = [c[0] for c in found.description]
        df = registry.queries()[name](spark, str(tmp_path))
        value = lambda v: None if v is None else norm(v)
        want = sorted((tuple(value(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=str)
        got = sorted((tuple(map(value, r)) for r in df.collect()), key=str)
        assert got == want
        return want

    return run


def test_release_checks_of_no_missing_object_are_null(check):
    """Every nation has a rich supplier."""
    rich = lambda df: df.limit(1).crossJoin(df.sparkSession.range(25)).withColumns({"s_nationkey": F.col("id").cast("int"), "s_suppkey": F.lit(1000) + F.col("id"), "s_acctbal": F.lit(9500.0)}).drop("id")
    rows = check("release_checks", supplier=lambda df: df.unionByName(rich(df).select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns))))
    assert len(rows) == 2


def test_identifiers_of_six_digits_are_cut_to_five(check):
    """Customers 300,000 and beyond share the base of ten others."""
    longer = lambda df: df.unionByName(df.withColumn("c_custkey", (F.col("c_custkey") + 300_000).cast(df.schema["c_custkey"].dataType)))
    assert any(r[0].startswith("1000") for r in check("identifier_versions", customer=longer))


def test_walks_broadcast_no_table_that_grows_with_the_tree(spark):
    chain = spark.range(300).selectExpr("cast(id as string) as code", "if(id = 0, '', cast(id - 1 as string)) as parent_code")
    found = hierarchy.depths(chain)
    assert found.selectExpr("max(depth)").first()[0] == 300
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("Join") < 40


@pytest.mark.parametrize("pairs", [150, 2_000_000])
def test_whole_pools_and_pages_are_those_of_all_pairs(spark, monkeypatch, pairs):
    """Also where the roles of a block, and the roles they may move to, are dealt to several tasks."""
    monkeypatch.setattr(pools, "PAIRS", pairs)
    monkeypatch.setattr(pools, "STORED", max(20, pairs // 10))
    data = some_roles(spark, 80, 5)
    want = graph.ranked_pools(graph.move_scores(*data)).where("rank_default is not null or rank_down is not null").cache()
    columns = ["source_role_id", "candidate_role_id", "rank_default", "rank_down"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pools.all_moves(*data, block_rows=8).select(columns)) == rows(want.select(columns)) and want.count() > 50
    assert rows(pools.fan_page(*data, 3, block_rows=8)) == rows(graph.fan_page(want, "rank_down", 3))


def test_readiness_is_computed_between_profiles_only(spark):
    """300 roles of 3 profiles: all pairs come out, 9 values are computed."""
    profile = spark.range(300).selectExpr("id as role_id", "explode(array('x', concat('y', id % 3))) as capability").withColumn("level", F.lit(1.0) + F.col("role_id") % 3)
    found = graph.readiness(profile, 6)
    values = {(r.a, r.b): (r.n, r.v) for r in found.groupBy((F.col("a_role_id") % 3).alias("a"), (F.col("b_role_id") % 3).alias("b")).agg(F.count("*").alias("n"), F.max("readiness").alias("v")).collect()}
    assert values[0, 0] == (9900, 1.0) and values[0, 2] == (10000, 0.166667) and len(values) == 9
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no sums over pairs of roles


def shuffled(spark):
    """Bytes that this session's shuffles have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_payloads_share_the_rosters_of_their_codes(spark):
    """600 positions show one of three rosters of up to 1,000 roles; one shows none."""
    positions = spark.range(601).selectExpr("id as position_id", "'t' as title", "cast(null as string) as grade", "'' as cohort")
    tree = positions.where("position_id < 600").selectExpr("position_id as query_id", "concat('F', position_id % 3) as family", "1 as family_place", "if(position_id % 3 = 2, 'F1', 'x') as node", "1 as place", "0.5d as score")
    tree = tree.unionByName(tree.withColumns({"node": F.lit("y"), "place": F.lit(2)}))
    roles = spark.range(1000).selectExpr("id as role_id", "concat('role ', sha2(cast(id as string), 256)) as title", "concat('F', id % 3) as code")
    said = spark.range(1000).selectExpr("id * 7 % 1000 as role_id", "id as sequence", "'said' as statement")
    assigned = spark.createDataFrame([], "position_id long, code string")
    paths = hierarchy.paths(spark.createDataFrame([("F0", "zero", "Job Family", "")], "code string, name string, level string, parent_code string"))
    before, rows = shuffled(spark), {}
    for copies in (7, 50):
        found = reference.assistant_payloads(positions, assigned, paths, tree, similarity.roster(roles, said), per_copy=copies).collect()
        rows[copies] = {r.position_id: json.loads(r.payload) for r in found}
    assert rows[7] == rows[50] and len(rows[50]) == 601
    assert "roster" not in rows[50][600] and rows[50][600]["current"] == "Unmapped"
    for k, codes in enumerate((["F0"], ["F1"], ["F1", "F2"])):
        assert [(x["code"], x["total"]) for x in rows[50][597 + k]["roster"]] == [(c, 334 if c == "F0" else 333) for c in codes]
        assert {m["role_id"] for x in rows[50][597 + k]["roster"] for m in x["roles"]} == {r for r in range(1000) if f"F{r % 3}" in codes}
    assert shuffled(spark) - before < sum(len(json.dumps(r)) for r in rows[50].values()) / 4


def test_moves_of_all_pairs_shuffle_no_pairs(spark):
    """Also where roles lack family, rung or activities, in blocks of any size, some of them empty on one side."""
    data = some_roles(spark, 600, 7)
    before = shuffled(spark)
    rows = sorted(map(str, graph.move_scores(*data).collect()))
    n = data[0].where("status = 'active'").count()
    assert len(rows) == n * (n - 1) and len(set(rows)) == len(rows)
    assert shuffled(spark) - before < len(rows)  # less than a byte for each pair
    assert sorted(map(str, graph.move_scores(*data, block_rows=90).collect())) == rows
    few = [df.where("role_id < 12") if "role_id" in df.columns else df for df in data]
    small = sorted(map(str, graph.move_scores(*few, block_rows=1).collect()))
    assert small == sorted(map(str, graph.move_scores(*few).collect())) and small
    assert not graph.move_scores(data[0].where("false"), *data[1:]).collect()
