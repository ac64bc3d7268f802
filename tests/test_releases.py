"""Answers asked once, tables compared by trees of hashes, publications that build on the same base."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import answers, reconcile, releases, vocabulary


def test_a_failed_run_keeps_its_rounds_and_the_next_asks_the_rest(spark, tmp_path):
    path, log = f"file://{tmp_path}/answers", tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame([(k, f"p{k % 40}" if k % 41 else None, "key clash") for k in range(120)], "id int, prompt string, answer_was string")

    def ask(batch, refuse=()):
        import uuid

        if any(p in refuse for (p,) in batch):
            raise RuntimeError("the model is gone")
        (log / uuid.uuid4().hex).write_text("\n".join(p for (p,) in batch))
        return [None if p == "p7" else " " if p == "p8" else p.upper() for (p,) in batch]

    with pytest.raises(Exception, match="the model is gone"):
        answers.answered(prompts, ["prompt"], lambda b: ask(b, ("p11",)), path, round_rows=4, batch=2)
    before = {r.key for r in answers.kept(spark, path).collect()}
    for f in log.iterdir():
        f.unlink()
    found = answers.answered(prompts, ["prompt"], ask, path, round_rows=4, batch=2).collect()
    asked = [p for f in log.iterdir() for p in f.read_text().split("\n")]
    assert len(found) == 120 and all(r.answer == (None if r.prompt in ("p7", "p8") else (r.prompt or "").upper() or None) for r in found)
    assert len(asked) == len(set(asked)) and not before & {r.key for r in found if r.prompt in asked}
    for f in log.iterdir():
        f.unlink()
    answers.answered(prompts, ["prompt"], ask, path).count()
    assert sorted(p for f in log.iterdir() for p in f.read_text().split("\n")) == ["", "p7", "p8"]  # without an answer, asked again
    assert answers.answered(prompts.limit(0), ["prompt"], ask, path).count() == 0


def test_differences_are_those_of_except_both_ways(spark):
    r = random.Random(5)
    a = [(r.randrange(300) if r.random() < 0.95 else None, r.choice(["x", "y", None])) for _ in range(500)]
    b = r.sample(a, 480) + [(k, "z") for k in range(5)] + a[:3]
    tables = [spark.createDataFrame(x, "k int, v string") for x in (a, b)]
    want = sorted(map(str, tables[0].exceptAll(tables[1]).collect())), sorted(map(str, tables[1].exceptAll(tables[0]).collect()))
    found = reconcile.differences(*tables, ["k"]).collect()
    more = lambda rows: sorted(str(x) for x, n in rows for _ in range(n))
    row = lambda x: f"Row(k={x.k!r}, v={x.v!r})"
    assert (more((row(x), x.old_rows - x.new_rows) for x in found if x.old_rows > x.new_rows), more((row(x), x.new_rows - x.old_rows) for x in found if x.new_rows > x.old_rows)) == want
    assert reconcile.differences(tables[0], tables[0].repartition(3, "v"), ["k"]).count() == 0
    assert reconcile.differences(tables[0].limit(0), tables[1].limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        reconcile.differences(tables[0], tables[1].withColumn("w", F.lit(1)), ["k"])


def test_only_differing_leaves_are_looked_at(spark):
    a = spark.range(20_000).selectExpr("id as k", "id * 2 as v")
    b = a.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    trees = reconcile.tree(a, ["k"]), reconcile.tree(b, ["k"])
    assert trees[0].where("level = 0").first().n == 20_000
    assert reconcile.differing_leaves(*trees).count() == 1
    assert [(r.k, r.change) for r in reconcile.changes(a, b, ["k"], trees).collect()] == [(77, "changed")]


def test_of_two_publications_on_one_base_the_second_is_refused(spark, tmp_path):
    store = releases.Releases(spark, f"file://{tmp_path}/r")
    first = store.publish({"t": spark.range(3).toDF("x")})
    inner = []

    def meanwhile(tables):  # another publisher finishes while this one checks
        inner.append(releases.Releases(spark, f"file://{tmp_path}/r").publish({"t": spark.range(5).toDF("x")}, base=first))

    with pytest.raises(releases.Moved):
        store.publish({"t": spark.range(4).toDF("x")}, [meanwhile])
    assert store.current() == inner[0] != first
    with pytest.raises(releases.Moved):
        store.publish({"t": spark.range(6).toDF("x")}, base=first)
    refused = store.clean(0)
    assert any(x.startswith("release=") for x in refused) and store.clean(0) == []
    assert store.tables(store.current(), ["t"])["t"].count() == 5 and store.tables(first, ["t"])["t"].count() == 3


def test_a_crash_before_the_pointer_leaves_the_old_release(spark, tmp_path, monkeypatch):
    store = releases.Releases(spark, f"file://{tmp_path}/r")
    first = store.publish({"t": spark.range(3).toDF("x")})
    monkeypatch.setattr(store, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.publish({"t": spark.range(9).toDF("x")})
    fresh = releases.Releases(spark, f"file://{tmp_path}/r")
    assert fresh.current() == first and fresh.clean() == [] and sorted(x.partition("=")[0] for x in fresh.clean(0) if x != "staged") == ["manifest", "release"]
    assert fresh.publish({"t": spark.range(9).toDF("x")}) == fresh.current() != first


def test_three_tries_and_answers_of_the_whole_vocabulary(spark):
    short = spark.createDataFrame([(r, f"a{k}", k, 0.0) for r in (1, 2, 3) for k in range(1, 12)], "role_id int, activity_id string, place int, similarity double")

    def choose(options):
        raise ConnectionError("gone")

    calls = []
    found = vocabulary.assigned(short, choose, valid={"a3", "z9"}, again=lambda o, seen=calls: seen.append(1) or (["a2", "zz"] if len(seen) % 2 else ["z9", "a3", "z9"])).collect()
    assert {(r.activity_id, r.fallback_used, r.retry_count) for r in found} == {("z9", False, 2), ("a3", False, 2)}
    found = vocabulary.assigned(short, choose, tries=3).where("role_id = 1").collect()
    assert [(r.activity_id, r.fallback_used, r.retry_count) for r in sorted(found)] == [(f"a{k}", True, 3) for k in range(1, 9)]
