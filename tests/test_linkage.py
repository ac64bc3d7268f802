"""Average linkage against merging the nearest pair one by one; singular values against numpy."""

import numpy as np
import pytest

from talentweave.operators import linkage, svd, vocabulary


def average_linkage(vectors, clusters):
    """Cluster of each row: the pair of the least mean cosine distance is merged until `clusters` are left."""
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms > 0, norms, 1)
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > max(1, clusters):
        i, j = sorted(divmod(int(np.argmin(distance)), n))
        merged = (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = merged, merged
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return label


def parts(label):
    found = {}
    for k, x in enumerate(label):
        found.setdefault(x, set()).add(k)
    return sorted(map(sorted, found.values()))


def some_vectors(n, seed, size=8):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 10 + 1, size))
    return centres[r.integers(0, len(centres), n)] + 0.4 * r.standard_normal((n, size))


@pytest.mark.parametrize(("n", "target", "local"), [(240, 17, 3000), (90, 12, 8), (5, 3, 2), (1, 3, 2)])
def test_clusters_are_those_of_one_merge_at_a_time(spark, n, target, local):
    v = some_vectors(n, n + target)
    table = spark.createDataFrame([(f"p{k:04d}", x.tolist()) for k, x in enumerate(v)], "phrase string, vector array<double>")
    found = vocabulary.clustered(table, "phrase", target, local).collect()
    label = [r.cluster for r in sorted(found)]
    assert len(label) == n and parts(label) == parts(average_linkage(v, min(target, max(2, n // 3))))


def test_equal_and_zero_vectors(spark):
    v = [[1.0, 0.0]] * 6 + [[0.0, 2.0]] * 5 + [[0.0, 0.0]] * 2 + [[-1.0, 0.0]] * 5
    table = spark.createDataFrame(list(enumerate(v)), "phrase int, vector array<double>")
    for local in (3000, 5):
        label = [r.cluster for r in sorted(vocabulary.clustered(table, "phrase", 5, local).collect())]
        assert len(set(label)) == 5 and len(set(label[:6])) == len(set(label[6:11])) == len(set(label[13:])) == 1
    assert vocabulary.clustered(table.limit(0), "phrase", 5).count() == 0


def test_chains_give_the_same_heights():
    v = some_vectors(80, 3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    tree = linkage.chain_merges(np.arange(80), unit, np.ones(80, int), 80)
    height = {m: h for m, _, _, h in tree}
    assert len(tree) == 79 and all(h >= max(height.get(a, 0), height.get(b, 0)) - 1e-9 for _, a, b, h in tree)


def test_singular_values_are_those_of_numpy(spark):
    r = np.random.default_rng(4)
    a = r.standard_normal((150, 12)) * np.arange(12, 0, -1) @ r.standard_normal((12, 110)) + 0.05 * r.standard_normal((150, 110))
    a[r.random(a.shape) < 0.7] = 0
    a[3] = 0
    cells = [(f"r{i:03d}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    rows, values = svd.truncated(spark.createDataFrame(cells, "row string, column int, value double"), 150, 110, 10)
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(values, s[:10], rtol=0.01)
    found = {x.row: np.array(x.vector) for x in rows.collect()}
    assert "r003" not in found and len(found) == 149
    got = np.array([found.get(f"r{k:03d}", np.zeros(10)) for k in range(150)])
    want = u[:, :10] * s[:10]
    assert np.linalg.norm(got @ got.T - want @ want.T) < 0.05 * np.linalg.norm(want @ want.T)


def test_texts_of_the_same_words_are_near(spark):
    texts = ["plan the annual budget", "plan annual budgets", "annual budget plan", "repair water pumps", "repair the water pump", "water pumps repair", "", None, "the"]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r.id: np.array(r.vector) for r in vocabulary.tfidf(table, "id", "text", 4).collect()}
    assert all(np.linalg.norm(rows[k]) == pytest.approx(1) for k in range(6)) and not any(rows[k].any() for k in (6, 7, 8))
    assert rows[0] @ rows[2] > 0.5 > rows[0] @ rows[3] and rows[3] @ rows[4] > 0.5
