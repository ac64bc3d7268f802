"""Operators on repeats, against brute force over small hostile tables."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import decontamination, neardup, substrings, triejoin
from talentweave.llm.components import components
from talentweave.llm.queries import op3_repeated_substrings, op4_decontamination, op5_jaccard_join
from talentweave.llm.scratch import Scratch
from talentweave.shipping import ship

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdeé") for _ in range(R.randrange(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[R.randrange(len(words))] = R.choice(VOCABULARY)
    return R.choice([" ", "\n", "\t "]).join(words)


def shout(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def hostile_texts():
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b C d E", "x" * 450, "ab" * 300, "é" * 150]
    for _ in range(25):
        base = prose(R.randrange(5, 260))
        texts += [base] + [edited(base, R.randrange(0, 6)) for _ in range(R.randrange(0, 6))]
    line = prose(60)
    texts += [f"{prose(80)}\n{line}\n{prose(R.randrange(30, 120))}" for _ in range(30)]
    big = prose(150)
    texts += [edited(big, R.randrange(1, 4)) for _ in range(60)] + [big] * 20
    return texts


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                    parent[root(i)] = root(j)
    smallest = {}
    for i in range(len(texts)):
        smallest[root(i)] = min(smallest.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), smallest[root(i)]) for i in range(len(texts))}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = hostile_texts()
    R.shuffle(texts)
    rows = [(3 * i + 1, t, "k", 5) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, k string, n int").repartition(4).write.parquet(str(path / "documents.parquet"))
    ship(spark)
    return path, [r[0] for r in rows], texts


def test_jaccard_join_matches_brute_force(spark, corpus):
    path, ids, texts = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard_join(spark, str(path)).collect()}
    assert got == brute_components(ids, texts)


def test_jaccard_join_in_blocks(spark, corpus):
    path, ids, texts = corpus
    docs = spark.read.parquet(str(path / "documents.parquet"))
    got = {r.key: (r.n_shingles, r.component) for r in neardup.near_duplicates(docs, Scratch(spark, "t"), group_classes=4).collect()}
    assert got == brute_components(ids, texts)


def test_trie_finds_all_links():
    r = random.Random(2)
    sets = [np.array(sorted(r.sample(range(40), r.randrange(1, 30)))) for _ in range(200)]
    sets += [np.array(sorted(set(s.tolist()) ^ {r.randrange(40)} or {1})) for s in sets[:100]]
    trie = triejoin.Trie(sets, 40)
    for s in sets:
        want = {k for k, t in enumerate(sets) if triejoin.linked(len(set(s.tolist()) & set(t.tolist())), len(s), len(t))}
        assert set(trie.query(s)) == want


def brute_roots(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if triejoin.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(12))
def test_roots_of_links(seed):
    r = random.Random(seed)
    pool = r.sample(range(1 << 40), 60)
    sets = []
    for _ in range(12):
        base = r.sample(pool, r.randrange(1, 40))
        for _ in range(r.randrange(1, 12)):
            own = {x for x in base if r.random() > 0.06} | {r.randrange(1 << 40) for _ in range(r.randrange(0, 4))}
            sets.append(np.array(sorted(own or {1}), np.uint64))
    r.shuffle(sets)
    assert triejoin.link_roots(sets) == brute_roots(sets)


def test_unlinked_sets_and_copies_take_little_time():
    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 60, 300, np.uint64)
    unlinked = [np.unique(np.append(r.choice(common, 100, replace=False), r.integers(0, 1 << 60, 30, np.uint64))) for _ in range(2000)]
    copies = [np.unique(np.append(r.choice(common, 285, replace=False), r.integers(0, 1 << 60, 10, np.uint64))) for _ in range(2000)]
    began = time.time()
    assert len(set(triejoin.link_roots(unlinked))) == 2000 and set(triejoin.link_roots(copies)) == {0}
    assert time.time() - began < 5


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.root for r in components(edges, Scratch(spark, "t"), "c").collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, Scratch(spark, "t"), "c", rounds=1)


def test_repeated_substrings_match_brute_force(spark, corpus):
    path, ids, texts = corpus
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_repeated_substrings(spark, str(path)).collect()}
    assert [got[i] for i in ids] == substrings.brute_force(texts, substrings.LENGTH)


@pytest.mark.parametrize("length,anchor,classes", [(40, 8, 20_000), (40, 8, 3)])
def test_short_strings_and_dealt_anchors(spark, corpus, length, anchor, classes):
    path, ids, texts = corpus
    docs = spark.read.parquet(str(path / "documents.parquet"))
    rows = substrings.remove_repeats(docs, Scratch(spark, "t"), length=length, anchor=anchor, anchor_classes=classes)
    rows = rows.select("key", "n_bytes", F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.begin)").alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h"))
    got = {r.key: (r.n_bytes, r.n, r.s, r.h) for r in rows.collect()}
    assert [got[i] for i in ids] == substrings.brute_force(texts, length)


def test_repeated_and_missing_ids(spark):
    ship(spark)
    text, other = prose(120), prose(120)
    docs = spark.createDataFrame([(1, text), (1, text), (1, other), (None, None), (None, other[:50]), (2, "a b")], "doc_id long, text string")
    rows = substrings.remove_repeats(docs, Scratch(spark, "t")).collect()
    assert sorted(len(r.kept) for r in rows) == sorted([0, 0, len(other.encode()), 0, len(other[:50].encode()), 3])
    assert near_counts(neardup.near_duplicates(docs, Scratch(spark, "t"))) == {(1, 1): 3, (neardup.NO_ID, neardup.NO_ID): 2, (2, 2): 1}


def near_counts(df):
    out = {}
    for r in df.collect():
        out[r.key, r.component] = out.get((r.key, r.component), 0) + 1
    return out


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for query in (op3_repeated_substrings, op4_decontamination, op5_jaccard_join):
        assert query(spark, str(tmp_path)).count() == 0


def test_leaks_are_found_and_clean_documents_left_alone(spark, tmp_path):
    items = [(k, prose(R.randrange(20, 60))) for k in range(30)] + [(90, None), (91, ""), (92, "zu kurz")]
    docs, want = [], set()
    for d in range(120):
        text = prose(R.randrange(0, 200))
        if d % 3 == 0:
            k, passage = items[R.randrange(30)]
            text = f"{text} {shout(passage) if d % 2 else edited(passage, 1)} {prose(R.randrange(0, 50))}"
            want.add((d, k))
        docs.append((d, text if d % 7 else None if d % 3 else text))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id): r.similarity for r in op4_decontamination(spark, str(tmp_path)).collect()}
    exact = {(d, k) for d, k in want if d % 2}
    assert exact <= got.keys() <= want
    assert all(got[x] > 0.99 for x in exact)
    clean = decontamination.without_leaks(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert {r.doc_id for r in clean.collect()} == set(range(120)) - {d for d, _ in got}


def windows_of(hashes, size):
    value, _, _ = decontamination.shingles(np.array(hashes, np.uint64), np.zeros(len(hashes), np.int64), 1)
    m = size - decontamination.SHINGLE + 1
    return [value[s : s + m].tolist() for s in range(len(value) - m + 1)]


def scanned(docs, items):
    """Best similarity of every document and item by comparing all windows exactly, where it reaches the threshold."""
    lists, sizes = decontamination._item_shingles(items)
    n = sum(1 for s in sizes if s)
    having = Counter(x for own in lists for x in set(own.tolist()))
    weight = lambda x: int(decontamination.weight_of(np.int64(having.get(x, 1)), n))
    out = {}
    for d, text in enumerate(docs):
        data = text.encode()
        hashes, _ = decontamination.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for k, own in enumerate(lists):
            if sizes[k] < 5 or len(hashes) < 5:
                continue
            wanted, best = Counter(own.tolist()), 0.0
            for window in windows_of(hashes.tolist(), min(int(sizes[k]), len(hashes))):
                have = Counter(window)
                if have.keys() & wanted.keys():
                    low = sum(weight(x) * min(have[x], wanted[x]) for x in have.keys() | wanted.keys())
                    high = sum(weight(x) * max(have[x], wanted[x]) for x in have.keys() | wanted.keys())
                    best = max(best, low / high)
            if best >= decontamination.SIMILARITY:
                out[d, k] = best
    return out


def test_near_copies_of_items_are_found_as_an_exact_scan_finds_them():
    r = random.Random(9)
    items = [prose(r.randrange(12, 70)) for _ in range(25)]
    items += [f"{items[0]} {prose(4)}", items[1]]
    docs = []
    for k in range(90):
        words = items[r.randrange(len(items))].split(" ")
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(len(words)) if r.random() < 0.5 else -1] = "neu"
        docs.append(f"{prose(r.randrange(0, 60))} {' '.join(words)} {prose(r.randrange(0, 60))}" if k % 9 else " ".join(words[: max(5, len(words) - 1)]))
    want = scanned(docs, items)
    found = decontamination.prepare(list(range(len(items))), items)
    data = [d.encode() for d in docs]
    got = {}
    for d, leaks in decontamination.leaks_of(found, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])):
        got |= {(d, k): s for k, s, _, _ in leaks}
    assert got.keys() <= want.keys() and len(want) > 50
    assert len(got) >= 0.9 * len(want)
    assert all(got[x] == pytest.approx(want[x]) for x in got)


def test_leaks_of_short_long_and_repeated_items_in_one_pass_and_in_several(spark):
    ship(spark)
    long = prose(6000)
    items = [(1, "Yes, indeed"), (2, "x"), (3, long), (4, prose(30)), (4, prose(30)), (5, None), (6, ""), (None, prose(20))]
    texts = ["well YES, indeed so", "yes, x", f"{prose(3000)} {long}", items[3][1], items[3][1], None, "", f"a {items[7][1]} b", prose(7000), "indeed yes,"]
    docs = spark.createDataFrame([(k, t, 7, "s") for k, t in enumerate(texts)], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    one = sorted(map(str, decontamination.find_leaks(docs, bench, Scratch(spark, "t")).collect()))
    several = sorted(map(str, decontamination.find_leaks(docs, bench, Scratch(spark, "t"), chars=15_000).collect()))
    assert one == several
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 4), (7, None)}
    for chars in (15_000, 1 << 20):
        kept = decontamination.without_leaks(docs, bench, Scratch(spark, "t"), chars=chars)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 8, 9]
