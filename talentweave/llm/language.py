"""Language identification: each document is a mixture of languages.

Character trigrams (case folded, every run of non-letters one blank) are hashed to a fixed number of cells; a language is
a smoothed distribution over the cells. Expectation-maximisation estimates the language proportions of a document from
the likelihood of its trigrams; the language set is the one, among the sets of the k most probable languages, with the
best log-likelihood less a penalty for each language in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import in_share
from .textbatch import codepoints, text_blocks

CELLS = 4096
UNDETERMINED = "und"
#: A language model is fitted on about so many labelled documents at most, chosen by a hash of the id.
FIT_ROWS = 20_000
#: Expectation-maximisation ends where a round moves no proportion by more.
SETTLED = 1e-3
#: Log-likelihood that one more language has to win, for each logarithm of the number of trigrams.
PENALTY = 3.0
BLOCK = 400_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and cell of each trigram that has a letter."""
    points, offsets = codepoints([f"\n{x.lower()}\n" for x in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    letter = _letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    points, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep]
    if len(points) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = (owner[:-2] == owner[2:]) & ((points[:-2] != 32) | (points[1:-1] != 32))
    return owner[:-2][inside], (mixed >> np.uint64(64 - 12)).astype(np.int64)[inside]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # languages x CELLS


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS) -> LanguageModel:
    """Trigram distributions of the labelled rows for which `training` holds; rows without a label or text are left out.

    Of more than `rows` labelled rows a sample of about that many is counted, chosen by a hash of the id; what reaches the
    driver is CELLS counts for each label. Without a labelled row no language is learned.
    """
    labelled = docs.where(training & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    n = labelled.count()
    sample = labelled.where(in_share(docs[id_col], rows / max(rows, n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in text_blocks(batch.column(0).to_pylist(), BLOCK):
                owner, cell = trigram_cells(texts)
                names = sorted(set(langs[first : first + len(texts)]))
                code = np.array([names.index(x) for x in langs[first : first + len(texts)]])
                table = np.bincount(code[owner] * CELLS + cell, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, line in zip(names, table, strict=True):
                    sums[name] = sums.get(name, 0) + line
        for name, line in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * CELLS), pa.array(range(CELLS), pa.int32()), pa.array(line, pa.int64())], ["lang", "cell", "n"])

    pairs = sample.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).mapInArrow(count, "lang string, cell int, n bigint")
    found = pairs.groupBy("lang", "cell").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    if n > rows and not len(found):
        raise ValueError(f"no trigram in a sample of {rows} of {n} labelled rows")
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), CELLS))
    np.add.at(counts, (found["lang"].map(languages.index).to_numpy(int), found["cell"].to_numpy(int)), found["n"].to_numpy(float))
    return LanguageModel(languages, (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * CELLS))


def _em(counts: np.ndarray, likelihood: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions where the rounds from `share` settle, and the log-likelihood; a language that begins at 0 stays there."""
    share, moving = share.copy(), np.arange(len(counts))
    total = counts.sum(axis=1, keepdims=True)
    now, rows = share, counts
    while len(moving):
        after = now * ((rows / (now @ likelihood)) @ likelihood.T) / total[moving]
        share[moving] = after
        on = np.abs(after - now).max(axis=1) > SETTLED
        moving, now, rows = moving[on], after[on], rows[on] if not on.all() else rows
    return share, (counts * np.log(share @ likelihood)).sum(axis=1)


def infer(model: LanguageModel, counts: np.ndarray) -> np.ndarray:
    """Language proportions of each document (rows of cell counts, none of them empty), 0 outside its language set."""
    likelihood = model.likelihood.astype(np.float32)
    n, k = len(counts), len(model.languages)
    share, log = _em(counts, likelihood, np.full((n, k), 1 / k, np.float32))
    # the log-likelihood is concave in the shares, so no shares get more than this
    most = log + ((counts / (share @ likelihood)) @ likelihood.T).max(axis=1) - counts.sum(axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    every = np.arange(n)
    best = np.zeros((n, k), np.float32)
    best[every, order[:, 0]] = 1
    value = (counts * np.log(likelihood[order[:, 0]])).sum(axis=1)
    step = PENALTY * np.log(np.maximum(counts.sum(axis=1), 2))
    for size in range(2, k + 1):
        more = np.flatnonzero(most - (size - 1) * step > value)
        if not len(more):
            break
        begin = np.zeros((len(more), k), np.float32)
        rows = order[more, :size]
        begin[np.arange(len(more))[:, None], rows] = np.maximum(share[more[:, None], rows], 1e-3)
        begin /= begin.sum(axis=1, keepdims=True)
        found, log = _em(counts[more], likelihood, begin)
        log -= (size - 1) * step[more]
        won = log > value[more]
        best[more[won]], value[more[won]] = found[won], log[won]
    return best


def _predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[str]]:
    """Main language, its share and the language set of each text; UNDETERMINED with 0 and no set where there is none."""
    names, scores, sets = [], [], []
    for _, block in text_blocks(texts, BLOCK):
        for i in range(0, len(block), 128):
            part = block[i : i + 128]
            owner, cell = trigram_cells(part)
            counts = np.bincount(owner * CELLS + cell, minlength=len(part) * CELLS).reshape(-1, CELLS).astype(np.float32)
            known = np.flatnonzero(counts.any(axis=1)) if model.languages else np.zeros(0, int)
            share = infer(model, counts[known]) if len(known) else []
            at = dict(zip(known.tolist(), share, strict=True))
            for d in range(len(part)):
                if d not in at:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    sets.append("")
                    continue
                line = at[d] / at[d].sum()
                by = [j for j in np.argsort(-line, kind="stable") if line[j] > 0]
                names.append(model.languages[by[0]])
                scores.append(min(1.0, float(line[by[0]])))
                sets.append(",".join(f"{model.languages[j]}:{line[j]:.3f}" for j in by))
    return names, scores, sets


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) for every row: the most probable language, its proportion, and the language set
    as "lang:proportion" by falling proportion.

    Null texts, texts without a letter, and all texts if no language was learned give `und` with score 0 and no set.
    Repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets = _predict(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())], ["id", "lang_pred", "score", "languages"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, lang_pred string, score double, languages string")


def with_language(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose main language is determined and has at least the share `least`; nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scores, _ = _predict(model, batch.column(place).to_pylist())
            yield batch.filter(pa.array(np.array(scores) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
