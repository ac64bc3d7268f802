import random
import re
from hashlib import sha256

import numpy as np
import pytest

from talentweave.llm import secrets
from talentweave.llm.queries import op10_secret_scan
from talentweave.llm.secrets import Rule, compile_rules, find_secrets
from talentweave.shipping import ship

#: The contract's patterns and the added ones, written for the standard matcher: kind, pattern, group, least length.
PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ("jwt", re.compile(r"eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+", re.ASCII), 0, 1),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("chat_token", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
]
PIECES = ["password", "PassWd", "api_key", "apikey", "token", "toKEN", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef" * 2, "Zz9+/_.=-", "é", "\n", ",", "😀", "eyJhbGciOiJIUzI1", ".", "eyJ", "xoxb-1234567890", "xoxa-", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN ", "A", "ſ", "K"]


def brute_force(text):
    """(sha256 of the base spans, all spans) as the contract defines them."""
    found = sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if m.end(group) - m.start(group) >= least)
    shown = lambda spans: ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
    return sha256(shown([x for x in found if x[1] < 3]).encode()).hexdigest(), shown(found)


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def check(spark, tmp_path, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, id int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        digest, spans = brute_force(t)
        assert (got[i].base_sha256, got[i].spans) == (digest, spans), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [len(re.findall(rf"\b{k}:", spans)) for k in ("assign", "access", "hex")]


def test_matches_brute_force(spark, tmp_path):
    long = ["a" * 300_000 + " token=abcdefgh", "é" * 5000 + "AKIA" + "B" * 9000, "token=" * 3000]
    check(spark, tmp_path, [None, "", "token = abc", "secret: token: abcdefghij", *random_texts(2500), *long])


def test_unbroken_texts_take_time_in_proportion(spark, tmp_path):
    """Beginnings of matches that come to nothing until far behind are read a fixed number of times."""
    import time

    small = ["eyJ" * 900 + "/eyJa.eyJb.c", "eyJa." * 700 + "eyJ", "-----BEGIN " * 300 + "PRIVATE KEY-----", "xoxb-" * 500, "token=" * 400 + "x" * 9, "AKIA" * 500, "token " * 300 + "=abcdefgh"]
    check(spark, tmp_path, small)
    rules = secrets.RULES
    for text in ("eyJ" * 350_000 + "/eyJa.eyJb.c", "-----BEGIN " * 90_000 + "PRIVATE KEY-----", "xoxb-" * 200_000, "api_key" * 150_000 + "=abcdefgh"):
        data, began = np.frombuffer(text.encode(), np.uint8), time.time()
        assert secrets.spans_of(data, rules, (1 << len(rules)) - 1)
        assert time.time() - began < 20, text[:12]


def test_a_match_never_crosses_documents(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "token="), (2, "abcdefghij"), (3, "0123456789abcdef"), (4, "0123456789abcdef"), (4, "0123456789abcdef" * 2), (None, "AKIA"), (5, "ABCDEFGHIJKL")], "doc_id long, text string").coalesce(1)
    assert sorted((r.id, [tuple(x) for x in r.spans]) for r in find_secrets(docs).collect() if r.spans) == [(4, [("hex", 0, 32)])]


def test_repeated_rows_and_empty_table(spark, tmp_path):
    ship(spark)
    docs = spark.createDataFrame([(1, "0" * 40, "a")] * 3, "doc_id long, text string, spans string")
    assert [len(r.spans) for r in find_secrets(docs).collect()] == [1, 1, 1]
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op10_secret_scan(spark, str(tmp_path)).count() == 0


def test_automaton_is_minimal_and_finds_every_reported_match():
    dfa = compile_rules(secrets.RULES)
    moves = dfa.move.reshape(-1, dfa.n_classes) // dfa.n_classes
    block = np.unique(dfa.hits[:: dfa.n_classes], return_inverse=True)[1]
    for _ in range(len(moves)):
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1]
        if finer.max() == block.max():
            break
        block = finer
    assert block.max() + 1 == dfa.n_states
    for text in random_texts(300, 5):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data):
            mask = int(np.bitwise_or.reduce(secrets.scan(dfa, data)[1]))
            kinds = {x.split(":")[0] for x in brute_force(text)[1].split(",") if x}
            assert kinds == {r.kind for k, r in enumerate(secrets.RULES) if mask >> k & 1}, text


def test_rules_that_cannot_be_compiled_are_refused():
    for rule in (Rule("x", r"a(?=b)"), Rule("x", r"(a|b)", 1, 4)):
        with pytest.raises(ValueError):
            compile_rules((rule,))
