"""Token counts against the library, sort-means against plain rounds, periodic runs against trying every stretch."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import periodicruns, queries, sortmeans, tokencounts
from talentweave.llm.scratch import Scratch
from talentweave.shipping import ship

SF = "/root/testdata/sf0.001"
CLASHES = ["key", "digest", "chunk", "part", "n", "n_bytes", "n_tokens", "head", "tail", "words", "a", "p", "h", "runs", "collapsed", "v", "cluster", "distance", "id", "centroid", "best"]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(tokencounts.VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["plan", "works", "Ünïcode", "naïve", "漢字", "🙂", "▁", "<s>", "tok" * 30, "a" * 400, "　　", "  ", "\n", "\x00"]
    mixed = ["".join(r.choice(words) + " " * r.randrange(3) for _ in range(r.randrange(1, 900))) for _ in range(30)]
    runs = ["a" * 5000, "=" * 3000 + " end", " " * 4000, "漢" * 3000, "\x80" * 2500, "ab" * 2500 + "c", "eyJ" * 2000]
    return [None, "", " ", "x", "</s> <0x41> ▁"] + mixed + runs


def test_counts_are_the_librarys(spark, vocabulary, texts):
    ship(spark)
    rows = [(k, x) for k, x in enumerate(texts)] + [(3, "another"), (None, "no id"), (40, texts[10]), (40, texts[10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES) if c != "id"))
    library = tokencounts.encoder(vocabulary).processor
    want = sorted((k if k is not None else -1, len((x or "").encode()), len(library.encode(x or ""))) for k, x in rows)
    for huge, chunk, overlap in ((tokencounts.HUGE, tokencounts.CHUNK, tokencounts.OVERLAP), (50, 37, 37), (0, 200, 5)):
        found = tokencounts.count_tokens(docs, Scratch(spark, "t"), vocabulary, huge=huge, chunk=chunk, overlap=overlap).collect()
        assert sorted((r.id if r.id is not None else -1, r.n_bytes, r.n_tokens) for r in found) == want
    assert tokencounts.count_tokens(docs.limit(0), Scratch(spark, "t"), vocabulary).count() == 0
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs, Scratch(spark, "t"), vocabulary, chunk=10, overlap=20)


def test_chunks_without_a_common_piece_are_cut_wider(spark, vocabulary):
    """A run of one letter is cut at other phases in each chunk; the rounds go on until a chunk holds it."""
    ship(spark)
    # pieces of 2 and 4 equal letters, whose phase depends on where a chunk begins
    texts = spark.createDataFrame([("x", "=" * 1111 + "a" * 777)], "digest string, text string")
    summaries = tokencounts.chunks(texts, 101, 3).select("digest", "chunk", "part").mapInArrow(tokencounts._summaries(vocabulary, 101, 3), tokencounts.SUMMARY)
    assert tokencounts.spliced(summaries).first().n_tokens is None
    docs = texts.select(F.lit(1).alias("doc_id"), "text")
    found = tokencounts.count_tokens(docs, Scratch(spark, "t"), vocabulary, huge=100, chunk=101, overlap=3).first()
    assert found.n_tokens == len(tokencounts.encoder(vocabulary).processor.encode("=" * 1111 + "a" * 777))


def test_chunks_cover_the_text_once(spark):
    texts = ["漢字🙂" * 50, "abc", "x" * 64, "y" * 65, "\n" * 130]
    found = tokencounts.chunks(spark.createDataFrame([(str(k), x) for k, x in enumerate(texts * 2)], "digest string, text string"), 64, 10).collect()
    assert len(found) == sum(2 * math.ceil(len(x) / 64) for x in texts)
    assert all(r.part == texts[int(r.digest) % 5][64 * r.chunk : 64 * r.chunk + 74] for r in found)


def test_other_vocabularies_are_refused(tmp_path, vocabulary):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(vocabulary, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.ModelType.UNIGRAM
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokencounts.PieceEncoder(str(tmp_path / "other.model"))


def test_op11_of_all_documents(spark, vocabulary):
    ship(spark)
    library = tokencounts.encoder(vocabulary).processor
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in docs)
    assert sorted(map(tuple, queries.op11_token_counts(spark, SF).collect())) == want


# --- sort-means -------------------------------------------------------------------------------------------------------


def plain_rounds(rows, size, clusters, rounds, scale, seed=1):
    """Every vector against every centroid."""
    kept = [(k, np.array([math.floor(scale * float(np.float32(x))) for x in v], object)) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), list(r[1])))
    centroids = [v for _, v in order[:clusters]]
    for k in range(rounds + 1):
        assigned = [min((((v - c) ** 2).sum(), j) for j, c in enumerate(centroids)) for _, v in kept]
        if k < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, assigned, strict=True) if at == j]
                centroids[j] = sum(own) // len(own) if own else centroids[j]
    return sorted((-1 if i is None else i, j, int(d)) for (i, _), (d, j) in zip(kept, assigned, strict=True)), centroids


def test_sort_means_are_plain_rounds(spark):
    ship(spark)
    r = random.Random(4)
    rows = [(k, [r.choice([0.0, 0.25, 0.5, -0.25, 1.0]) for _ in range(3)]) for k in range(300)]
    rows += [(5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5]), (7, rows[9][1]), (None, [2.0, 2.0, 2.0])]
    rows += [(900, None), (901, []), (902, [1.0, None, 1.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 1.0]), (906, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    for clusters, rounds in ((16, 3), (1, 2), (40, 0), (400, 2)):
        want, centroids = plain_rounds(rows, 3, clusters, rounds, 64)
        found, got = sortmeans.cluster(table, Scratch(spark, "t"), clusters=clusters, rounds=rounds, size=3)
        assert sorted((-1 if x.id is None else x.id, x.cluster, x.distance) for x in found.collect()) == want
        assert got.tolist() == [list(c) for c in centroids]
    assert sortmeans.with_inertia(*sortmeans.cluster(table.limit(0), Scratch(spark, "t"), size=3)).count() == 0
    few = sortmeans.with_inertia(*sortmeans.cluster(table.where("vec_id < 3"), Scratch(spark, "t"), size=3)).collect()
    assert len(few) == 3 and {x.inertia for x in few} == {0}


def test_components_that_do_not_fit_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e30] * 3)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        sortmeans.cluster(table, Scratch(spark, "t"), size=3)


def test_ties_and_bounds_of_a_scan():
    r = np.random.default_rng(5)
    for _ in range(200):
        x, c = r.integers(-3, 4, (60, 2)), r.integers(-3, 4, (int(r.integers(1, 9)), 2))
        last = r.integers(0, len(c), 60)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        cluster, distance, computed = sortmeans.nearest(x, last, c, *sortmeans.neighbours(c))
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and computed <= every.size
    x = np.concatenate([r.integers(0, 10, (500, 2)), r.integers(0, 10, (500, 2)) + 10_000])
    c = np.concatenate([x[:8], x[-8:]])
    last = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sortmeans.nearest(x, last, c, *sortmeans.neighbours(c))[2] <= 1000 * 8  # the far group is never looked at


def test_op12_of_all_vectors(spark):
    ship(spark)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = plain_rounds(rows, 64, 16, 3, 64)
    found = queries.op12_sort_means(spark, SF).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == want
    sums = {j: sum(d for _, c, d in want if c == j) for j in range(16)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (sums[r.cluster], sum(sums.values()), names[r.cluster]) for r in found)


# --- periodic runs ----------------------------------------------------------------------------------------------------


def every_run(words):
    """(start, length, period) by trying each period and extending each stretch."""
    found, n = {}, len(words)
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, m, p) for (s, m), p in found.items())


def collapsed(words, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(r):
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(0, 60))]
    if kind == 1:
        unit = [r.choice("abc") for _ in range(r.randrange(1, 9))]
        return [r.choice("abc") for _ in range(r.randrange(5))] + unit * r.randrange(1, 9) + unit[: r.randrange(len(unit))] + [r.choice("abc") for _ in range(r.randrange(5))]
    if kind == 2:
        unit = ["a"] * r.randrange(1, 12) + ["b"]
        return unit * r.randrange(1, 8) + ["a"] * r.randrange(30)
    return ["x"] * r.randrange(40)


@pytest.mark.parametrize("prime", [(1 << 31) - 1, 5])
def test_runs_are_all_runs(prime):
    """With a tiny prime nearly all hashes collide, so the comparison of words has to mend them."""
    r = random.Random(6)
    docs = [some_words(r) for _ in range(300)]
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for d in docs for w in d], np.int64)
    ends = np.cumsum([len(d) for d in docs])
    found = periodicruns.runs_of(ids, ends - [len(d) for d in docs], ends, prime)
    assert [tuple(x) for x in found.tolist()] == [(k, *run) for k, d in enumerate(docs) for run in every_run(d)]


def test_pairs_in_small_blocks_give_the_same(monkeypatch):
    r = random.Random(7)
    d = [w for _ in range(20) for w in some_words(r)]
    ids = np.array([ord(w) for w in d], np.int64)
    want = periodicruns.runs_of(ids, np.array([0]), np.array([len(d)]))
    monkeypatch.setattr(periodicruns, "_PAIRS", 7)
    assert (periodicruns.runs_of(ids, np.array([0]), np.array([len(d)])) == want).all() and len(want)


def test_one_word_over_and_over_takes_little_time():
    import time

    began = time.time()
    n = 300_000
    assert periodicruns.runs_of(np.zeros(n, np.int64), np.array([0]), np.array([n])).tolist() == [[0, 0, n, 1]]
    assert time.time() - began < 60


def test_runs_of_odd_rows(spark):
    ship(spark)
    texts = [None, "", " \t\r", "a", "\x0ba a\x0ca a\ra  a ", "a a a a a", "A a A a A a A a", "x y z " * 30, "\x1cq\x1cq q", "漢字 " * 50]
    rows = [(k, x) for k, x in enumerate(texts)] + [(4, "a b " * 5), (None, "n " * 8), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    words = lambda x: (x or "").encode().split()
    want = sorted((-1 if k is None else k, len(words(x)), every_run(words(x)), collapsed([w.decode() for w in words(x)], every_run(words(x)))) for k, x in rows)
    found = periodicruns.find_runs(docs).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found) == want
    assert periodicruns.find_runs(docs.limit(0)).count() == 0
    assert periodicruns.with_repetitions(docs.limit(0)).count() == 0
    assert periodicruns.with_repetitions(docs).where("id is null").first().text == "n " * 8


def test_op13_of_all_documents(spark):
    ship(spark)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = every_run(words[:1500]) if n <= 1500 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(collapsed(words, runs)))
    found = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(want) > 150
    assert {k: found[k] for k in want} == want
    assert sum(x[1] > 0 for x in want.values()) > 5
