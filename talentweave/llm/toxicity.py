"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (3 to 6 code points, lower case, white space as one blank, blanks around the
text). The fit chooses the n-grams whose presence tells the classes apart best, scales each by the logarithm of the ratio
of its smoothed frequencies in toxic and clean documents, and learns weights by penalised logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import in_share
from .textbatch import blocks, codepoints

ORDERS = (3, 4, 5, 6)
#: N-grams of the model, the ones that tell the classes apart best.
FEATURES = 2048
#: The classifier is fitted on a sample of the labelled rows, those of the smallest hashes of id and text: so many rows and
#: code points at most (but for a single row that is longer).
FIT_ROWS = 8_000
FIT_CHARS = 24_000_000
#: One of so many rows of the sample is of the rarer class at least.
LEAST_SHARE = 8
BLOCK = 500_000
_BITS = 22


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of the features (ascending), their weights, and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def _normal(points: np.ndarray) -> np.ndarray:
    """White space (ASCII) as blanks; the rest stays."""
    return np.where((points == 32) | ((points >= 9) & (points <= 13)), 32, points).astype(np.uint64)


def _grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the hashes of the n-grams that begin at each position."""
    points = _normal(points)
    value = np.zeros(len(points), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        if len(points) < n:
            return
        value = (value[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
        if n in ORDERS:
            yield n, value


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return codepoints([f" {(x or '').lower()} " for x in texts])


def _hashes(text: str) -> np.ndarray:
    """The n-grams of a text, repeated ones too."""
    return np.concatenate([h for _, h in _grams(_points([text])[0])] or [np.zeros(0, np.uint64)])


def _chosen(known: DataFrame, rows: int, chars: int) -> list:
    """Rows (id, toxic, h, size) of the sample, of each class the first by hash that fit; the shortest one where none does.

    A class has its share of `rows`, but an eighth at least if it has as many; `chars` are dealt out alike.
    """
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = sum(counts.values())
    take = {c: min(m, max(rows * m // max(1, n), rows // LEAST_SHARE, 1)) for c, m in counts.items()}
    most = max(take, key=take.get, default=None)
    if len(take) > 1:
        take[most] = min(counts[most], max(1, rows - sum(take[c] for c in take if c != most)))
    out, shortest = [], []
    for c, m in sorted(counts.items()):
        first = known.where((F.col("toxic") == c) & in_share(F.col("h"), max(4 * take[c], 64) / m)).orderBy("h", "id", "size").limit(take[c]).collect()
        if not first:
            raise ValueError(f"an empty sample of {m} labelled rows")
        held, room = 0, chars * take[c] // sum(take.values())
        for r in first:
            if held + r["size"] <= room:
                held += r["size"]
                out.append(r)
        shortest += sorted(first, key=lambda r: r["size"])[:1]
    return out or sorted(shortest, key=lambda r: r["size"])[:1]


def _frequencies(seen: list[np.ndarray], label: np.ndarray, least: int, parts: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams in at least `least` documents, and in how many toxic and clean ones; hashes are counted range by range."""
    found = []
    edges = [np.uint64(k * ((1 << 64) // parts)) for k in range(1, parts)]
    cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in seen]
    for k in range(parts):
        sides = []
        for side in (True, False):
            own = [seen[i][cuts[i][k] : cuts[i][k + 1]] for i in np.flatnonzero(label == side)]
            sides.append(np.unique(np.concatenate(own), return_counts=True))
        grams = np.union1d(sides[0][0], sides[1][0])
        df = np.zeros((2, len(grams)), np.int64)
        for line, (own, n) in zip(df, sides, strict=True):
            line[np.searchsorted(grams, own)] = n
        often = df.sum(axis=0) >= least
        found.append((grams[often], df[0][often], df[1][often]))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> ToxicityModel:
    """Fits the model on documents with a label in `labels` (id, label); null labels and ids are left out, a null text is empty.

    An id with several labels counts as toxic if one of them is; documents that repeat an id have its label each, and rows
    that repeat id and text count once. Sizes and hashes alone are joined with the labels to choose the sample; its keys (id,
    hash of the text), `rows` at most, are then broadcast to the documents, and of each key one text comes back, so neither
    a hot id nor copies of a text bring more than `rows` texts to the driver. Where a class has less than an eighth of the
    rows it is taken more often, and the intercept is set back by what that adds to its odds. Without both classes, as for
    an empty table, the model has no feature and gives the smoothed share of the class it saw; a sample that has lost a
    class that the labels have (texts longer than `chars` allow) is an error.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("toxic"))
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(docs[id_col].alias("id"), F.shiftrightunsigned(F.xxhash64(docs[id_col].cast("string"), text), 1).alias("h"), text.alias("text"))
    sizes = keyed.select("id", "h", F.length("text").alias("size")).join(known, "id").groupBy("id", "h", "toxic").agg(F.min("size").alias("size"))
    spark = docs.sparkSession
    counts = {r["toxic"]: r["count"] for r in sizes.groupBy("toxic").count().collect()}
    chosen = spark.createDataFrame(sorted((r["id"], r["h"], r["toxic"]) for r in _chosen(sizes, rows, chars)), sizes.select("id", "h", "toxic").schema)
    sample = keyed.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "toxic").agg(F.first("text").alias("text")).toArrow().sort_by([("id", "ascending"), ("h", "ascending")])
    texts, label = sample.column("text").to_pylist(), np.array(sample.column("toxic").to_pylist(), bool)
    del sample
    if len(counts) > 1 and (label.all() or not label.any()):
        raise ValueError(f"the sample has lost a class of {counts}")
    if len(counts) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log((label.sum() + 1) / ((~label).sum() + 1))))

    least, found = max(3, min(label.sum(), (~label).sum()) // 200), []
    for half in range(2):  # of the hashes, so that no more than half of all distinct n-grams are held at a time
        found.append(_frequencies([np.unique(h[h >> np.uint64(63) == half]) for h in map(_hashes, texts)], label, least))
    all_grams, toxic_df, clean_df = (np.concatenate([x[k] for x in found]) for k in range(3))
    p, q = (toxic_df + 1) / (label.sum() + 2), (clean_df + 1) / ((~label).sum() + 2)
    gain = np.abs(p - q) * np.abs(np.log(p / q))
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    best = best[np.argsort(all_grams[best])]
    grams, ratio = all_grams[best], np.log(p[best] / q[best])

    owner, column = [], []
    for i, h in enumerate(map(_hashes, texts)):
        at = np.searchsorted(grams, h)
        at[at == len(grams)] = 0
        hit = np.unique(at[grams[at] == h]) if len(grams) else at[:0]
        owner.append(np.full(len(hit), i)), column.append(hit)
    weights, bias = _logistic(np.concatenate(owner), np.concatenate(column), ratio, label)
    if min(counts.values()) * LEAST_SHARE < sum(counts.values()):
        bias += np.log(counts[True] / counts[False]) - np.log(label.sum() / (~label).sum())
    return ToxicityModel(grams, weights * ratio, float(bias))


def _logistic(owner: np.ndarray, column: np.ndarray, scale: np.ndarray, label: np.ndarray, penalty: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse rows; accelerated gradient steps with a fixed step length."""
    n, k = len(label), len(scale)
    target = label.astype(float)
    value = scale[column]
    norm = np.bincount(owner, value * value, minlength=n).mean() + 1
    step = 4 / (n * norm + penalty)
    w, b = np.zeros(k), 0.0
    ahead_w, ahead_b = w, b
    for t in range(1, rounds + 1):
        margin = np.bincount(owner, value * ahead_w[column], minlength=n) + ahead_b
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target
        new_w = ahead_w - step * (np.bincount(column, value * error[owner], minlength=k) + penalty * ahead_w)
        new_b = ahead_b - step * error.sum()
        ahead_w, ahead_b = new_w + (t - 1) / (t + 2) * (new_w - w), new_b + (t - 1) / (t + 2) * (new_b - b)
        w, b = new_w, new_b
    return w, b


def margins(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    if not len(model.grams):
        return out
    low = np.zeros(1 << _BITS, bool)  # most n-grams aren't features: one look at a small table tells
    low[(model.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    lengths = np.concatenate([[0], np.cumsum([len(x or "") + 2 for x in texts])])
    for i, j in blocks(lengths, BLOCK):
        points, offsets = _points(texts[i:j])
        owner = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(offsets))
        pairs = []
        for n, value in _grams(points):
            at = np.flatnonzero(low[(value >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + n - 1]]
            which = np.minimum(np.searchsorted(model.grams, value[at]), len(model.grams) - 1)
            hit = model.grams[which] == value[at]
            pairs.append(owner[at[hit]] * len(model.grams) + which[hit])
        pairs = np.unique(np.concatenate(pairs))
        out[i:j] += np.bincount(pairs // len(model.grams), model.weights[pairs % len(model.grams)], minlength=j - i)
    return out


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, higher for likelier toxic texts; the score reads the whole text and nothing else.

    Null and empty texts have the score of a text without features; repeated rows give repeated rows; an empty table gives
    an empty one; other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = 1 / (1 + np.exp(-np.clip(margins(model, batch.column(1).to_pylist()), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["id", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, score double")
