"""Pools by bounds against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import graph, pools

ROLES = "role_id long, family string, sub_family string, specialisation string, rung int, status string"


def some_roles(spark, n, seed):
    """Roles in uneven families, some without family, rung or activities; one activity that nearly all have."""
    r = random.Random(seed)
    roles, links = [], []
    for k in range(n):
        f = r.choice("aaaabc")
        roles.append((k, None if r.random() < 0.05 else f, None if r.random() < 0.1 else f + r.choice("12"), r.choice([None, "x", "y", "z"]), None if r.random() < 0.05 else r.randrange(6), "archived" if r.random() < 0.1 else "active"))
        if r.random() < 0.9:
            links += [(k, "all")] * (r.random() < 0.8) + [(k, f"t{r.randrange(25)}") for _ in range(r.randrange(6))]
    adjacency = [(x, y, abs(ord(x) - ord(y))) for x in "abc" for y in "abc" if (x, y) != ("a", "c")]
    return spark.createDataFrame(roles, ROLES), spark.createDataFrame(links, "role_id long, activity string"), spark.createDataFrame(adjacency, "source string, target string, tier int")


@pytest.mark.parametrize(("seed", "keep", "block"), [(1, 3, 4), (2, 8, 16)])
def test_pools_and_reasons_are_those_of_all_pairs(spark, seed, keep, block):
    data = some_roles(spark, 90, seed)
    if seed == 2:  # more users than active roles: a weight below zero
        data = (data[0].withColumn("status", F.when(F.col("role_id") % 3 == 0, "active").otherwise("archived")), *data[1:])
    scores = graph.move_scores(*data).cache()
    want = graph.ranked_pools(scores).select("source_role_id", "candidate_role_id", *(F.when(F.col(c) <= keep, F.col(c)).alias(c) for c in ("rank_default", "rank_down")), F.round("score", 9).alias("score"))
    want = want.where("rank_default is not null or rank_down is not null")
    found = pools.best_moves(*data, keep, block_rows=block).select(*want.columns[:4], F.round("score", 9).alias("score"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() > 50
    for down in (False, True):
        by = "reason_down" if down else "reason_default"
        counts = {r[0]: r[1] for r in scores.groupBy(F.coalesce(by, F.lit("eligible"))).count().collect()}
        assert {r.reason: r.n for r in pools.reason_counts(*data, down, block_rows=block).collect()} == counts


def test_bounds_leave_most_pairs_out(spark):
    """Families of their own activities: a role visits blocks of its family and rungs only."""
    n = 400
    roles = spark.range(n).selectExpr("id as role_id", "concat('f', id % 8) as family", "concat('f', id % 8, '-', id % 16) as sub_family", "'s' as specialisation", "cast(id / 8 % 5 as int) as rung", "'active' as status")
    links = spark.range(n).selectExpr("id as role_id", "explode(array(concat('a', id % 8, '-', id % 24), concat('b', id % 8, '-', id % 40))) as activity")
    adjacency = spark.range(64).selectExpr("concat('f', id % 8) as source", "concat('f', cast(id / 8 as int)) as target", "2 as tier")
    assert pools.share_scored(roles, links, adjacency, 3, block_rows=8) < 0.15


def test_empty_tables_give_no_moves(spark):
    roles, links, adjacency = some_roles(spark, 30, 3)
    assert pools.best_moves(roles.limit(0), links, adjacency, 3).count() == 0
    assert pools.best_moves(roles, links.limit(0), adjacency, 3).count() == 0
    reasons = {r.reason: r.n for r in pools.reason_counts(roles, links.limit(0), adjacency).collect()}
    n = roles.where("status = 'active'").count()
    assert reasons == {"missing_activities": n * (n - 1)}
