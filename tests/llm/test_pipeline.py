"""The pipeline against its stages done by brute force on a small table."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from talentweave.llm import tokenids

from .test_pairs import R, brute_components, edited, prose


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("world")
    items = [(k, prose(40)) for k in range(5)]
    texts = [prose(R.randrange(5, 120)) for _ in range(60)]
    texts += [edited(texts[0], 2), texts[1], None, "", "123 456", f"{prose(30)} {items[2][1]} {prose(20)}"]
    rows = [(2 * i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return path, rows


def test_stages_take_effect_and_keep_the_columns(spark, world):
    path, rows = world
    docs = spark.read.parquet(str(path / "documents.parquet"))
    known = {r[0]: r[1] for r in rows}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.persist()
        left[name] = [r.doc_id for r in docs.collect()]
    with_letters = {k for k, t in known.items() if re.search("[a-zé]", t or "")}
    assert set(left["language"]) == with_letters
    ids = sorted(with_letters)
    groups = brute_components(ids, [known[k] for k in ids])
    assert set(left["near_duplicates"]) == {k for k in ids if groups[k][1] == k}
    assert set(left["near_duplicates"]) - set(left["decontamination"]) == {rows[-1][0]}
    assert set(left["mixing"]) <= set(left["decontamination"]) and len(left["mixing"]) > 0


def test_run_gives_the_ids_of_the_mix(spark, world):
    path, _ = world
    got = corpus_pipeline.run(spark, str(path)).orderBy("start").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(path / "documents.parquet")).collect()}
    vocabulary = public_tokenizers.path(tokenids.VOCABULARY)
    assert all(r.n_tokens == len(tokenids.ids_of(vocabulary, texts[r.doc_id])) + 1 for r in got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
