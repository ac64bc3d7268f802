"""Operators on single texts and on mixes, against brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from talentweave.llm import chat, fingerprints, language, mixing, queries, tokenids, toxicity
from talentweave.llm.scratch import Scratch
from talentweave.shipping import ship

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path(tokenids.VOCABULARY)
ODD = [None, "", " ", "a", "Don't STOP, it's 3.14%!", "naïve café é  x y \x1c\x85z", "<|endoftext|> x<|startoftext|>", "İstanbul ΣΑΣ ﬁ Å", "日本語 テキスト。", "😀😀 👩‍👩‍👧", "...,,, ,. a,b. c,", "x" * 5000, "﻿zero​width", "tab\tnew\nline\r\nend."]


# --- token ids


def test_elias_fano_select_and_all():
    r = random.Random(1)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        for top in (0, 1, 50, 10**6, 10**12):
            values = np.array(sorted(r.randrange(top + 1) for _ in range(n)), np.int64)
            ef = tokenids.EliasFano(n, *tokenids.EliasFano.encode(values))
            assert [ef.select(k) for k in range(len(values))] == values.tolist()
            assert [ef.select(k) for k in range(n)] == values.tolist()


def test_pieces_give_the_tokenizers_own_ids():
    r = random.Random(5)
    docs = [d for d in ODD if d] + ["".join(r.choice("aB,.' \n'sé́Ñ3%ßẞ") for _ in range(r.randrange(80))) for _ in range(1500)]
    encoder = tokenids.WordEncoder(VOCABULARY)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([d.encode() for d in docs])]
    for d, ids in zip(docs, got, strict=True):
        assert ids == tokenids.ids_of(VOCABULARY, d), repr(d)


def test_stops_behind_letters_that_end_in_a_mark():
    letters = [c for c in map(chr, range(0x20000)) if c.isalpha()]
    docs = ["BELGESİ.", "HİZMETLERİ,", "\u0958,", "\u0915\u093c.", *(f"{a}{c}{stop}" for c in letters for a in ("", "b") for stop in ".,")]
    encoder = tokenids.WordEncoder(VOCABULARY)
    got = encoder.encode([d.encode() for d in docs])
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(docs, add_special_tokens=False)]
    assert [d for d, a, b in zip(docs, got, want, strict=True) if a != b] == []


def test_simple_pieces_of_all_characters_and_a_full_cache(monkeypatch):
    r = random.Random(6)
    some = [chr(c) for c in range(33, 0x250) if chr(c).strip()] + ["'s", "'LL", "<|", "|>", "<|endoftext|>", "‌", "\u0301"]
    docs = ["".join(r.choice(some) for _ in range(r.randrange(1, 9))) for _ in range(30_000)]
    monkeypatch.setattr(tokenids, "_WORDS", 500)
    encoder = tokenids.WordEncoder(VOCABULARY)
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(docs, add_special_tokens=False)]
    assert [d for d, a, b in zip(docs, encoder.encode([d.encode() for d in docs]), want, strict=True) if a != b] == []
    assert max(len(encoder.known), len(encoder.known.older), len(encoder.of_word)) <= 501


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokenids.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("block_ids,same_id", [(1, 10_000), (40, 1), (1 << 20, 10_000)])
def test_blocks_round_trip(spark, block_ids, same_id, monkeypatch):
    monkeypatch.setattr(tokenids, "SAME_ID", same_id)
    ship(spark)
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(1, "again"), (1, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_tokens").repartition(3)
    got = tokenids.read_blocks(Scratch(spark, "t").save(tokenids.encode_blocks(docs, VOCABULARY, block_ids=block_ids), "b")).collect()
    want, start = [], 0
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()  # the order of rows of one id
    for key, _, t in sorted(((-(1 << 63) if k is None else k, h, t or "") for k, h, t in hashed)):
        ids = [*tokenids.ids_of(VOCABULARY, t), 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # rows without an id are written first, under the smallest number, and have none when they are read
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1


# --- mixing


def brute_targets(sizes):
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(total)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "hot"]
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 60))), "hot" if i % 3 == 0 else r.choice(names)) for i in range(900)] + [(5000, None, "a"), (5001, "", None), (5002, " ", "only-empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, Scratch(spark, "t")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(float(target[x.source]))
        assert 0 <= x.copies <= 3
        taken[x.source] += x.size * x.copies
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert len(got) == len(rows)
    again = {(x.id, x.copies) for x in mixing.mix(docs.repartition(2), Scratch(spark, "t")).collect()}
    assert again == {(x.id, x.copies) for x in got}


def test_inclusion_rates_are_unequal_and_met(spark):
    """Over many seeds each document gets its expected copies, which fall with its size, and each sample has its words."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * r.choice([2, 2, 2, 40, 40, 700]), "ab"[i % 2]) for i in range(240)], "doc_id long, text string, source string").cache()
    rounds, sums, chance = 12, {}, {}
    for seed in range(rounds):
        for x in mixing.mix(docs, Scratch(spark, "t"), seed=f"s{seed}").collect():
            sums.setdefault((x.source, x.size), []).append(x.copies)
            chance[x.source, x.size] = x.p
            assert x.quotient is None or x.quotient > 0
    rate = {k: sum(v) / len(v) for k, v in sums.items()}
    for source in "ab":
        assert rate[source, 2] > rate[source, 40] > rate[source, 700]
    words = {s: sum(len(t.split()) for _, t, x in docs.collect() if x == s) for s in "ab"}
    target = brute_targets(words)
    for (source, size), mean in rate.items():  # the expected copies: c * weight, at most 3
        weight = lambda n: 16 - min(12, n.bit_length())
        groups = {n: sum(len(t.split()) for _, t, x in docs.collect() if x == source and len(t.split()) == n) for n in (2, 40, 700)}
        low, high = 0.0, 10.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(w * min(3, c * weight(n)) for n, w in groups.items()) < target[source] else (low, c)
        expected = min(3, low * weight(size))
        assert chance[source, size] == pytest.approx(expected % 1, abs=1e-6) or expected == 3
        assert mean == pytest.approx(expected, abs=0.12)


def test_copies_of_clashing_columns(spark):
    names = ["words", "copies", "rows", "row", "u", "cell", "weight", "size", "id", "target"]
    docs = spark.createDataFrame([(k, f"a b {'c ' * k}", "s", *range(10)) for k in range(5)] * 2, f"doc_id long, text string, source string, {', '.join(f'{n} int' for n in names)}")
    mixed = mixing.copies_of(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns and mixed.count() == 10


def test_copies_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9), (1, "a b", "s", 9), (2, "c", None, 1), (3, None, "s", 2)], "doc_id long, text string, source string, size int")
    mixed = mixing.copies_of(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {1, 2}
    assert mixing.copies_of(docs.limit(0), Scratch(spark, "t")).count() == 0


# --- fingerprints


def test_signatures_equal_brute_force_numbering(spark):
    r = random.Random(8)
    texts = [None, "", "one", "a a a a a a a a", "b a b a b a"] + [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    kmers = fingerprints._kmers(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = df.select("i", kmers.alias("k"), fingerprints.signature(F.col("t")).alias("s")).collect()
    # the same tuples, with occurrence numbers counted in text order
    numbered = []
    for x in rows:
        seen = {}
        for p, h in enumerate(x.k):
            h &= (1 << fingerprints._HASH_BITS) - 1
            numbered.append((x.i, p, h, seen.get(h, 0)))
            seen[h] = seen.get(h, 0) + 1
    got = spark.createDataFrame(numbered, "i int, p long, h long, n int").withColumn("g", F.xxhash64("h", "n").bitwiseAND(F.lit((1 << fingerprints._HASH_BITS) - 1))).collect()
    pairs, tuples = {}, []
    for x in got:
        cell = x.g >> (fingerprints._HASH_BITS - fingerprints.CELL_BITS)
        pairs.setdefault((x.i, cell), []).append((x.g, x.p))
    for (i, cell), found in pairs.items():
        least = sorted(sorted(found)[: fingerprints.DEPTH], key=lambda y: y[1])
        tuples.append((i, cell, *(y[0] for y in least), *[None] * (2 - len(least))))
    hashed = spark.createDataFrame(tuples, "i int, c long, a long, b long").withColumn("v", F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")))
    want = {}
    for x in hashed.collect():
        want.setdefault(x.i, set()).add(x.c << 32 | (x.v & 0xFFFFFFFF))
    assert {x.i: set(x.s) for x in rows if x.s} == want


def test_edits_and_likeness(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(n))
    texts = [None, "", "é", *(prose(r.randrange(1, 300)) for _ in range(40))]
    rows = [(5 * i - 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op6_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    import hashlib

    for k, (key, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        assert got[key].n_chars == len(t)
        assert got[key].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
        assert 0 <= got[key].near_edited <= 1 and 0 <= got[key].near_next <= 1
    long = [x for x in got.values() if x.n_chars > 400]
    assert np.mean([x.near_edited for x in long]) > 0.05 > np.mean([x.near_next for x in long])


def test_swapped_order_changes_a_signature(spark):
    a, b = "p q r s t u v w", "1 2 3 4 5 6 7 8"
    x, y = spark.range(1).select(fingerprints.signature(F.lit(f"{a} {b}")), fingerprints.signature(F.lit(f"{b} {a}"))).first()
    assert x != y


def swapped(words, size=5):
    blocks = [words[i : i + size] for i in range(0, len(words), size)]
    return [w for b in reversed(blocks) for w in b]


def test_short_texts_have_the_minimal_kmers_of_the_whole_text(spark):
    r = random.Random(12)
    texts = ["one", "a b", "a b c", *(" ".join(r.choice("abcdefghijkl") for _ in range(n)) for n in (4, 10, 30, 60, 100, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    bits = fingerprints._HASH_BITS
    rows = df.select("i", fingerprints._sorted(F.col("t"), lambda t: t).alias("t"), fingerprints.full_signature(F.col("t")).alias("s")).collect()
    hashes = [(x.i, c, t >> fingerprints.PLACE_BITS, t & ((1 << fingerprints.PLACE_BITS) - 1)) for x in rows for t in x.t for c in range(64)]
    ranked = spark.createDataFrame(hashes, "i int, c long, h long, p long").withColumn("r", F.xxhash64("h", "c")).collect()
    orders = {}
    for x in ranked:  # those dealt to the cell first, then all others by the hash of the cell
        dealt = x.h >> (bits - fingerprints.CELL_BITS) == x.c
        orders.setdefault((x.i, x.c), []).append((not dealt, x.h if dealt else x.r, x.p, x.h))
    tuples = []
    for (i, c), found in orders.items():
        least = [x[3] for x in sorted(sorted(found)[: fingerprints.DEPTH], key=lambda x: x[2])]
        tuples.append((i, c, *least, *[None] * (2 - len(least))))
    want = {}
    for x in spark.createDataFrame(tuples, "i int, c long, a long, b long").withColumn("v", F.xxhash64("a", "b")).collect():
        want.setdefault(x.i, []).append(x.c << 32 | (x.v & 0xFFFFFFFF))
    assert {x.i: x.s for x in rows} == {i: sorted(x) for i, x in want.items()}


def test_likeness_of_short_texts_after_a_block_swap(spark, tmp_path):
    """As near as plain Order MinHash says: both minimal k-mers common and in the same order."""
    r = random.Random(13)
    for n in (20, 30, 60):
        pairs, plain = [], []
        for _ in range(60):
            a = [f"w{r.randrange(10**6)}" for _ in range(n)]
            b = swapped(a)
            pairs.append((" ".join(a), " ".join(b)))
            x, y = ({(p, q): i for i, (p, q) in enumerate(zip(w, w[1:]))} for w in (a, b))
            for _ in range(64):
                order = {k: r.random() for k in {*x, *y}}
                tx, ty = (sorted(sorted(k, key=order.get)[:2], key=k.get) for k in (x, y))
                plain.append(tx == ty)
        df = spark.createDataFrame(pairs, "a string, b string")
        got = df.select(fingerprints.likeness(fingerprints.full_signature(F.col("a")), fingerprints.full_signature(F.col("b")))).collect()
        assert abs(np.mean([x[0] for x in got]) - np.mean(plain)) < 0.03


def test_texts_without_white_space_are_near_their_edits(spark, tmp_path):
    r = random.Random(14)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400)) for _ in range(20)] + ["".join(r.choice("0123456789abcdef") for _ in range(900)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_fingerprints(spark, str(tmp_path)).collect()
    assert min(np.mean([x.near_edited for x in got if (x.doc_id < 20) == cjk]) for cjk in (True, False)) > 0.05
    assert np.mean([x.near_next for x in got]) < 0.02


# --- chat


def test_preferences_share_their_prompt(spark):
    cols = "pair_id long, turn int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "x"), (None, 0, "user", "n"), (4, 0, None, "r")], cols)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (3, 0, "assistant", "only"), (4, 0, None, "r"), (None, 0, "user", "n")], cols)
    got = {r.pair_id: r for r in chat.format_preferences(a, b).collect()}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.prompt_turns == 1
    assert one.rejected == "<|assistant|>\nno<|end|>\n" and one.rejected_mask == "14:0,10:1"
    assert one.chosen.endswith("<|user|>\n<|end|>\n") and one.chosen_mask == "14:0,11:1,9:0,8:0"
    assert sum(int(x.split(":")[0]) for x in one.chosen_mask.split(",")) == len(one.chosen)
    assert (got[2].prompt, got[2].rejected, got[3].chosen, got[3].rejected_mask) == ("", "", "", "14:0,12:1")
    assert got[None].chosen == got[4].rejected == "" and got[4].prompt_turns == 1
    assert chat.format_preferences(a.limit(0), b.limit(0)).count() == 0


# --- classifiers


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op9_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_texts_without_letters(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    by = {r.lang: r.text for r in docs.where("length(text) > 3000").collect()}
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, by["en"][:3000] + " " + by["de"][:3000]), (5, by["fr"])]
    got = {r.id: r for r in language.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert {x.split(":")[0] for x in got[4].languages.split(",")} == {"en", "de"} and 0.3 < got[4].score < 0.7
    assert got[5].languages.startswith("fr:1.0") or got[5].score > 0.95
    empty = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(odd, "doc_id long, text string"), empty).collect()} == {"und"}


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02


def test_toxicity_of_odd_inputs(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 700_000), (3, "y")], "doc_id long, text string")
    for labels in ([(1, 1), (2, 0), (3, None)], [(1, 0)], []):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)


def test_language_sets_have_every_language_that_wins_its_penalty():
    r = np.random.default_rng(4)
    line = r.dirichlet(np.full(language.CELLS, 0.05), 7) + 1e-7
    model = language.LanguageModel(list("abcdefg"), line / line.sum(axis=1, keepdims=True))
    mixes = np.array([[1, 1, 1, 1, 1, 1, 0], [1, 0, 0, 0, 0, 0, 0], [0.995, 0, 0, 0.005, 0, 0, 0], [1, 1, 1, 1, 1, 1, 1]], float)
    counts = np.array([r.multinomial(40_000, m / m.sum() @ model.likelihood) for m in mixes]).astype(np.float32)
    share = language.infer(model, counts)
    assert ((share > 0) == (mixes > 0)).all()
    assert np.abs(share - mixes / mixes.sum(axis=1, keepdims=True)).max() < 0.02
