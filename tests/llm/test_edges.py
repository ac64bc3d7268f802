"""Samples of any table size, and empty tables, repeated rows and clashing names through every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import chat, fingerprints, language, mixing, neardup, queries, substrings, toxicity
from talentweave.llm.ordering import in_share
from talentweave.llm.scratch import Scratch, shared_dir
from talentweave.shipping import ship

CLASHES = ["key", "row", "rows", "own", "place", "wordless", "id", "h", "text_size", "toxic", "score", "lang_pred", "size", "n", "rep", "component", "runs", "signature", "next_key", "range", "edited", "u", "cell"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    r = random.Random(1)
    words = ["plan", "works", "river", "stone", "vile", "quiet", "garden", "letter", "mountain", "paper"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 40))) + (" vile awful scum" if k % 4 == 0 else ""), "en" if k % 2 else "de", "ab"[k % 2]) for k in range(80)]
    rows += [rows[3]] * 3 + [(None, "no id here", "en", None), (200, None, None, "a"), (201, "", "en", "b"), (3, "another text", "en", "a")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def test_samples_have_members_at_any_table_size(spark):
    keys = spark.range(200_000).select(F.col("id"))
    for rows, total in ((8_000, 8_000), (8_000, 10**11), (20_000, 10**13), (1, 2**62)):
        threshold = int(rows / total * (1 << 63)) - 1
        assert threshold >= 0
        assert keys.where(in_share(F.col("id"), rows / total)).count() == pytest.approx(200_000 * min(1, rows / total), rel=0.2, abs=5)
    half = keys.where(in_share(F.col("id"), 0.5)).count()
    assert half == pytest.approx(100_000, rel=0.05)


def test_toxicity_samples_are_bounded_and_never_empty(docs):
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).distinct()
    known = labels.join(docs.select("doc_id", F.length("text").alias("size")), "doc_id").select(F.col("doc_id").alias("id"), "toxic", F.xxhash64("doc_id").alias("h"), F.coalesce("size", F.lit(0)).alias("size"))
    assert len(toxicity._chosen(known, 10, 10**9)) == 10
    assert 0 < sum(r["size"] for r in toxicity._chosen(known, 50, 500)) <= 500
    assert len(toxicity._chosen(known.where("size > 100"), 50, 10)) == 1
    assert toxicity._chosen(known.limit(0), 50, 10) == []


def test_toxicity_of_empty_repeated_and_clashing_rows(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)] + [(4, 0), (4, 1), (8, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    once = toxicity.fit(docs, labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    assert np.array_equal(model.grams, once.grams) and np.allclose(model.weights, once.weights)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.id in (200, 201)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    for some in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.limit(0))):
        assert len(some.grams) == 0 and {r.score for r in toxicity.score(docs, some).collect()} == {0.5}


def test_language_of_empty_repeated_and_clashing_rows(docs):
    model = language.fit(docs, F.lit(True))
    found = language.identify(docs, model).collect()
    assert len(found) == docs.count() and {r.lang_pred for r in found if r.id in (200, 201)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in found if r.id == 3}) <= 2
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert nothing.languages == [] and {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.with_language(docs, model, 0.0).columns == docs.columns


def test_a_document_in_many_languages_has_them_all():
    r = random.Random(2)
    alphabets = {f"l{k}": [chr(0x4E00 + 100 * k + c) for c in range(20)] for k in range(7)}
    text = lambda k, n: " ".join("".join(r.choice(alphabets[f"l{k}"]) for _ in range(5)) for _ in range(n))
    counts = np.zeros((7, language.CELLS))
    for k in range(7):
        _, cell = language.trigram_cells([text(k, 3000)])
        counts[k] = np.bincount(cell, minlength=language.CELLS)
    model = language.LanguageModel(list(alphabets), (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * language.CELLS))
    _, cell = language.trigram_cells([" ".join(text(k, 150) for k in range(6))])
    share = language.infer(model, np.bincount(cell, minlength=language.CELLS)[None].astype(np.float32))[0]
    assert (share > 0.1).sum() == 6 and share[6] < 0.02


def test_classes_of_clashing_and_repeated_rows(spark, docs):
    kept = neardup.one_of_each(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and None in ids and {200, 201} <= set(ids)
    assert neardup.one_of_each(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_mix_and_removal_of_clashing_rows(spark, docs):
    assert mixing.copies_of(docs, Scratch(spark, "t")).columns == docs.columns
    assert mixing.mix(docs, Scratch(spark, "t")).count() == docs.count()
    assert substrings.remove_repeats(docs, Scratch(spark, "t")).count() == docs.count()


def test_fingerprints_of_empty_repeated_and_clashing_rows(spark, docs):
    rows = fingerprints.with_edits(docs, Scratch(spark, "t")).collect()
    assert len(rows) == docs.count()
    assert len({tuple(r.signature) for r in rows if r.id in (200, 201)}) == 1
    assert fingerprints.with_edits(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_pairs_of_an_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", "b", 5), (2, 0, "user", "c", 5), (2, 1, "assistant", "d", 5)], "conv_id long, turn int, role string, text string, pair_id int")
    none = turns.limit(0)
    assert chat.format_preferences(none.drop("pair_id").withColumnRenamed("conv_id", "pair_id"), chat.with_other_answers(none, Scratch(spark, "t"))).count() == 0


def test_preferences_of_clashing_columns_null_ids_and_ties(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (None, 0, "user", "e"), (None, 1, "assistant", "f"), (2, 1, "assistant", "e"), (2, 1, "user", None)]
    clashes = ["pair_id", "key", "last", "last_turn", "answer", "other", "a", "b", "n", "differs", "prompt", "chosen", "rejected", "next_key", "range"]
    for k, extra in enumerate((clashes, [])):
        table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").select("*", *(F.lit(1).alias(c) for c in extra))
        table.write.parquet(str(tmp_path / str(k) / "conversations.parquet"))
    with_clashes, plain = (sorted(map(str, queries.op8_preferences(spark, str(tmp_path / str(k))).collect())) for k in range(2))
    assert with_clashes == plain and len(plain) == 3
    found = {r.pair_id: (r.prompt_turns, r.chosen, r.rejected) for r in queries.op8_preferences(spark, str(tmp_path / "0")).collect()}
    # without an id is first, so 1 follows it; both rows of the last assistant turn of 2 are answered anew
    assert found[None] == (1, "<|assistant|>\nf<|end|>\n", "<|assistant|>\nb<|end|>\n")
    assert found[1] == (1, "<|assistant|>\nb<|end|>\n", "<|assistant|>\ne<|end|>\n")
    assert found[2][0] == 1 and found[2][2].count("<|assistant|>\nf<|end|>") == 2
    table.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op8_preferences(spark, str(tmp_path / "none")).count() == 0


def test_a_hot_id_brings_no_more_rows_than_the_sample(spark, monkeypatch):
    """One id with most rows, of one class: texts on the driver stay within the bound, and no class is lost."""
    ship(spark)
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("calm river "), F.col("id") % 20_000).alias("text"))
    rest = spark.createDataFrame([(k, "vile awful scum" if k % 2 else "quiet garden") for k in range(10, 20)], "doc_id long, text string")
    docs, labels = hot.unionByName(rest), spark.createDataFrame([(7, 0)] + [(k, k % 2) for k in range(10, 20)], "doc_id long, toxic int")
    came = []
    monkeypatch.setattr(toxicity, "_frequencies", lambda seen, label, least, counted=toxicity._frequencies: came.append(label) or counted(seen, label, 1))
    model = toxicity.fit(docs, labels, rows=400, chars=10**6)
    assert len(came[0]) <= 400 and came[0].sum() == 5 and len(model.grams)
    scores = {r.id: r.score for r in toxicity.score(rest, model).collect()}
    assert min(v for k, v in scores.items() if k % 2) > max(v for k, v in scores.items() if k % 2 == 0)
    toxicity.fit(docs, labels, rows=400, chars=3000)
    long = docs.unionByName(spark.createDataFrame([(99, "vile " * 5000)], "doc_id long, text string"))
    with pytest.raises(ValueError, match="lost a class"):
        toxicity.fit(long, spark.createDataFrame([(7, 0), (99, 1)], "doc_id long, toxic int"), rows=400, chars=8000)


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://somewhere"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Nothing:
        def isDefined(self):
            return False

    class Session:
        sparkContext = Context()

    Session.sparkContext._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()
    with pytest.raises(ValueError):
        shared_dir(Session())
