"""Golden numbers and traps of scores, graphs, mappings and texts."""

import random
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from talentweave.functions import identifiers, scoring, text
from talentweave.operators import graph, hierarchy, mappings, similarity, summaries


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


ROLE = {"family": 1, "sub_family": 11, "specialisation": 111, "rung": 10, "status": "active", "title": "t"}


def moves(spark, roles, links, adjacency=((1, 2, 1), (2, 1, 1), (1, 3, 2)), w=scoring.MoveWeights()):
    rows = [Row(role_id=k, **{**ROLE, **r}) for k, r in roles.items()]
    schema = "role_id string, family int, sub_family int, specialisation int, rung int, status string, title string"
    r = spark.createDataFrame(rows).select("role_id", "family", "sub_family", "specialisation", "rung", "status", "title") if all(x.get("rung", 1) is not None and x.get("family", 1) is not None for x in roles.values()) else spark.createDataFrame([tuple(x[c] for c in ("role_id", "family", "sub_family", "specialisation", "rung", "status", "title")) for x in rows], schema)
    found = graph.move_scores(r, spark.createDataFrame(links, "role_id string, activity string"), spark.createDataFrame(list(adjacency), "source int, target int, tier int"), w)
    return {(x.source_role_id, x.candidate_role_id): x for x in graph.ranked_pools(found).collect()}


def test_overlap_and_jaccard(spark):
    assert value(spark, scoring.overlap_coefficient(F.lit(1), F.lit(2), F.lit(3))) == 0.5
    assert value(spark, scoring.weighted_jaccard(F.lit(0.8), F.lit(1.0), F.lit(2.2))) == pytest.approx(0.8 / 2.4)
    assert value(spark, scoring.overlap_coefficient(F.lit(None).cast("int"), F.lit(0), F.lit(3))) == 0
    assert value(spark, scoring.weighted_jaccard(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))) == 0


def test_occupation_ladder_and_grades(spark):
    ladder = [value(spark, scoring.occupation_value(F.lit(True), F.lit(a), F.lit(b))) for a, b in ((False, False), (True, False), (True, True))]
    assert ladder == pytest.approx([0.34, 0.67, 1.0])
    grades = [value(spark, scoring.grade_value(F.lit(x).cast("int"))) for x in (0, 1, 2, 3, 4, -1, -2, None)]
    assert grades == pytest.approx([1, 0.8, 0.5, 0.3, 0, 0.48, 0.3, 0])
    assert [value(spark, scoring.adjacency_value(F.lit(t).cast("int"))) for t in (0, 1, 2, None)] == [1, 0.5, 0, 0]
    with pytest.raises(Exception, match="unknown adjacency tier"):
        value(spark, scoring.adjacency_value(F.lit(7)))


def test_reasons_in_order(spark):
    links = [(r, a) for r in "abcdefg" for a in ("x", "y")]
    roles = {"a": {}, "b": {"rung": 9}, "c": {"rung": 11}, "d": {"rung": 6}, "e": {"family": 2}, "f": {"family": 9}, "g": {"rung": None}, "h": {}}
    got = moves(spark, roles, links)
    assert (got["a", "b"].grade_delta, got["a", "b"].grade, got["a", "b"].reason_default) == (1, 0.8, None)
    assert (got["a", "c"].reason_default, got["a", "c"].reason_down) == ("downward_move_disabled", None)
    assert got["a", "c"].grade == pytest.approx(0.48)
    assert got["a", "d"].reason_default == "more_than_three_rungs_up"
    assert (got["a", "e"].tier, got["a", "e"].adjacency, got["a", "e"].occupation) == (1, 0.5, 0)
    assert got["a", "f"].reason_default == "missing_adjacency_tier"
    assert got["a", "g"].reason_default == "missing_grade_rung"
    assert got["a", "h"].reason_default == "missing_activities"


def test_floor_is_inclusive_and_smaller_ids_win_ties(spark):
    links = [(r, a) for r in "abc" for a in ("x",)]
    w = scoring.MoveWeights(plain=0, rare=0, occupation=0, adjacency=0, grade=0.12, floor=0.12)
    got = moves(spark, {"a": {}, "b": {}, "c": {}}, links, w=w)
    assert got["a", "b"].above_floor and got["a", "b"].reason_default is None
    assert (got["a", "b"].rank_default, got["a", "c"].rank_default) == (1, 2)


def test_pages(spark):
    pool = spark.createDataFrame([("s", c, k) for k, c in enumerate("abcde", 1)], "source_role_id string, candidate_role_id string, rank_default int")
    assert graph.page_of_pool(pool, "rank_default", 0) == (["a", "b", "c"], "1–3 of 5", 3)
    assert graph.page_of_pool(pool, "rank_default", 3) == (["d", "e"], "4–5 of 5", 0)
    assert graph.page_of_pool(pool, "rank_default", 5)[0] == ["a", "b", "c"]
    assert graph.page_of_pool(pool, "rank_default", 0, 2, ("b", "d"))[:2] == (["a", "c"], "1–2 of 3")
    with pytest.raises(ValueError):
        graph.page_of_pool(pool, "rank_default", 0, 4)
    fan = lambda cursor: [r.candidate_role_id for r in graph.fan_page(pool, "rank_default", cursor).orderBy("slot").collect()]
    assert (fan(-4), fan(3), fan(9)) == (["a", "b", "c"], ["d", "e"], ["a", "b", "c"])


def brute_neighbours(roles, links, caps, k):
    active = sum(r["status"] == "active" for r in roles)
    users = {}
    for r, a in links:
        users.setdefault(a, set()).add(r)
    weight = {a: 1 - round(len(u) / active, 12) for a, u in users.items()}
    acts = {r["role_id"]: {a for x, a in links if x == r["role_id"]} for r in roles}
    focus = {}
    for r, c, level, f in caps:
        if f:
            focus.setdefault(r, {})[c] = max(level, focus.get(r, {}).get(c, 0))
    rungs = sorted({r["rung"] for r in roles if r["rung"] is not None})
    out = {}
    for s in roles:
        found = []
        for t in roles:
            if s is t:
                continue
            a, b = acts[s["role_id"]], acts[t["role_id"]]
            union = sum(weight[x] for x in a | b)
            work = sum(weight[x] for x in a & b) / union if union > 0 else 0
            want, have = focus.get(t["role_id"], {}), focus.get(s["role_id"], {})
            ready = sum(min(have.get(c, 0) / v, 1) for c, v in want.items() if v) / len(want) if want else 0
            gp = 0 if None in (s["rung"], t["rung"]) else max(0, 1 - abs(rungs.index(t["rung"]) - rungs.index(s["rung"])) / 4)
            same = s["sub_family"] is not None and s["sub_family"] == t["sub_family"]
            found.append((round(0.55 * ready + 0.30 * work + 0.10 * same + 0.05 * gp, 12), t["role_id"]))
        out[s["role_id"]] = [x for _, x in sorted(found, reverse=True)[:k]]
    return out


def test_neighbours_match_brute_force(spark):
    r = random.Random(4)
    roles = [{"role_id": i, "sub_family": r.choice([None, 1, 2, 3]), "rung": r.choice([None, 1, 2, 5, 9]), "status": r.choice(["active", "active", "old"])} for i in range(40)]
    links = sorted({(i, f"a{r.randrange(12)}") for i in range(38) for _ in range(r.randrange(0, 6))})
    caps = [(i, f"c{c}", float(r.randrange(0, 5)), r.random() < 0.7) for i in range(39) for c in r.sample(range(8), 4)]
    df = graph.neighbours(
        spark.createDataFrame([tuple(x.values()) for x in roles], "role_id long, sub_family int, rung int, status string"),
        spark.createDataFrame(links, "role_id long, activity string"),
        spark.createDataFrame(caps, "role_id long, capability string, level double, focus boolean"),
        scoring.NeighbourWeights(neighbours=10),
        rounded=True,
    )
    got = {}
    for row in df.orderBy("role_id", "neighbour_rank").collect():
        got.setdefault(row.role_id, []).append(row.neighbour_role_id)
        assert row.score == pytest.approx(row.readiness_part + row.activity_part + row.sub_family_part + row.grade_part, abs=1e-9)
    assert got == brute_neighbours(roles, links, caps, 10)


def test_one_manual_mapping_hides_all_imported_ranks(spark):
    cols = "id long, position_id long, mapping_rank int, code string, validated string, code_valid int"
    imported = spark.createDataFrame([(1, 7, 1, "100", "Yes", 1), (2, 7, 2, "101", "", 0), (3, 8, 1, "100", "", 1)], cols)
    assigned = spark.createDataFrame([(4, 7, 1, "110", "", 0), (5, 7, 2, "111", "", 0)], cols)
    rows = mappings.active_mappings(imported, assigned).collect()
    assert sorted((r.id, r.code, r.code_valid) for r in rows) == [(-5, "111", 1), (-4, "110", 1), (3, "100", 1)]
    codes = spark.createDataFrame([("110",), ("111",)], "code string")
    new = mappings.replace_assignments(assigned, 7, ["111", "111", " 110 "], codes).orderBy("mapping_rank").collect()
    assert [(r.mapping_rank, r.code) for r in new] == [(1, "111"), (2, "110")]
    for bad in ([], ["1", "2", "3", "4"], ["999"]):
        with pytest.raises(ValueError):
            mappings.replace_assignments(assigned, 7, bad, codes)


def test_suggestions_and_confidence(spark):
    rows = [(0, 1, 0.90, "1021", True), (0, 2, 0.85, "1021", True), (0, 3, 0.80, "1010", True), (0, 4, 0.95, None, False), (0, 5, 0.78, "1021", False)]
    near = spark.createDataFrame(rows, "query_id int, vec_id int, similarity double, code string, validated boolean")
    first, second = similarity.suggestions(near).orderBy("place").collect()
    assert (first.code, first.n, first.validated, first.confidence) == ("1021", 3, 2, "High")
    assert second.code == "1010"


def test_cosine_guards(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert value(spark, scoring.cosine(arr(1.0, 0.0), arr(1.0, 0.0))) == 1
    for a, b in ((arr(), arr()), (arr(1.0), arr(1.0, 2.0)), (arr(0.0, 0.0), arr(1.0, 1.0))):
        assert value(spark, scoring.cosine(a, b)) == 0


def test_levels_texts_and_ids(spark):
    levels = [value(spark, text.level_number(F.lit(x))) for x in ("Foundational", "Highly Advanced", "Level 4 – SINT", "Level (PBMG)", "Level 10", "")]
    assert levels == [1, 5, 4, None, None, None]
    df = spark.createDataFrame([("cafÃ© â€“ x",), (" A‑B ",), (None,)], "t string").select(text.match_text("t").alias("m"))
    assert [r.m for r in df.collect()] == ["café - x", "a-b", None]
    assert value(spark, identifiers.uuid5(uuid.NAMESPACE_DNS, F.lit("é/role"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "é/role"))
    assert value(spark, text.lenient_json(F.lit('```json\nso {"a": 3} end\n```'), "a int")).a == 3
    assert value(spark, text.title_from_filename(F.lit("00123-01_Lead Analyst TWL7.docx"), F.lit("00123-01"), F.lit("TWL7"))) == "Lead Analyst"
    assert value(spark, text.whole_level(F.lit(2.5))) == 2


def test_dataset_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    h = lambda d: identifiers.dataset_hash(d).first()[0]
    assert h(df) == h(df.repartition(5, "y")) != h(df.distinct())


def test_paths_stop_at_cycles_and_unknown_parents(spark):
    nodes = spark.createDataFrame([("a", "A", "Job Family", ""), ("b", "B", "Sub-family", "a"), ("c", "C", "Specialisation", "b"), ("x", "X", "Sub-family", "y"), ("y", "Y", "Sub-family", "x"), ("z", "Z", "Sub-family", "q")], "code string, name string, level string, parent_code string")
    texts = {r.code: r.path for r in hierarchy.path_text(hierarchy.paths(nodes)).collect()}
    assert texts == {"a": "A", "b": "A > B", "c": "A > B > C", "x": "Y > X", "y": "X > Y", "z": "Z"}
    assert {r.code for r in hierarchy.cycles(nodes).collect()} == {"x", "y"}
    assert [r.code for r in hierarchy.orphans(nodes).collect()] == ["z"]


def test_search_and_resolve(spark):
    rows = spark.createDataFrame([(1, "00010-01", "Lead_X", "f1"), (2, "00010-02", "lead", "f2"), (3, "00011-01", "Chef", "00099-x")], "id long, number string, title string, filename string")
    assert [r.id for r in summaries.keyword_search(rows, " LEAD ", ["title"], ["id"]).collect()] == [1, 2]
    assert summaries.keyword_search(rows, " ", ["title"], ["id"]).count() == 3
    assert [summaries.resolve(rows, x).first().id for x in ("00010", "00010-01", "3")] == [2, 1, 3]
    assert summaries.resolve(rows, "nothing").count() == 0
    assert summaries.find_id(rows, "00099").first().id == 3
