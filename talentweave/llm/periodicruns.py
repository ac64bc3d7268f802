"""Periodic runs of words, by longest common extensions on a harmonic grid.

A run of period p and at least max(6, 4 * p) words is a stretch of at least max(6 - p, 3 * p) places i with word i = word
i + p. Such a stretch holds a multiple of that step, so for each p it is enough to look at the multiples: n / (3 * p) places
for each p up to n / 4, of the order of n * log(n) for a document. All (period, place) pairs of a block of documents are handled at
once: where the two words are equal, the common extensions to both sides are found by binary search over hashes of
prefixes. Hashes that differ prove that words do; what they say is equal is compared word by word, and extended word by
word should they have collided. The same stretch found by several places, or by multiples of its period, is one run, that
of the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import text_blocks

#: Repetitions and words of a run at least.
TIMES = 4
LEAST = 6
_PRIME = (1 << 31) - 1
_BASE = 1_103_515_245
_BLOCK = 1 << 20
_PAIRS = 1 << 20


def step(period: np.ndarray) -> np.ndarray:
    """Places of a run of this period at which a word equals the one a period later, at least."""
    return np.maximum(LEAST, TIMES * period) - period


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of every word, its document, the words): equal words `[^\\x20\\x09-\\x0D]+` have equal numbers."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy()[there].astype(np.int64), owner[there], coded.dictionary


class Prefixes:
    """Hashes of all prefixes of a sequence, to compare substrings at two places."""

    def __init__(self, ids: np.ndarray, prime: int = _PRIME) -> None:
        self.prime, n = prime, len(ids)
        powers = np.ones(1, np.int64)
        top = _BASE % prime
        while len(powers) <= n:
            powers = np.concatenate([powers, powers * top % prime])
            top = top * top % prime
        self.powers = powers[: n + 1]
        self.sums = np.concatenate([[0], np.cumsum((ids + 1) % prime * self.powers[:n] % prime) % prime])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of the n words from a on and from b on (a < b) are equal."""
        left = (self.sums[a + n] - self.sums[a]) % self.prime
        right = (self.sums[b + n] - self.sums[b]) % self.prime
        return left * self.powers[b - a] % self.prime == right

    def longest(self, test, most: np.ndarray) -> np.ndarray:
        """By binary search, for every pair the largest m up to `most` with equal hashes; `test(m)` compares them."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = test(middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _grid(begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place) of all pairs to look at, in blocks of about `_PAIRS`."""
    sizes = ends - begins
    for first in range(0, len(sizes), 4096):
        n = sizes[first : first + 4096]
        most = np.where(n >= LEAST, np.maximum(n // TIMES, 1), 0)
        at = np.concatenate([[0], np.cumsum(most)])
        for low in range(0, int(at[-1]), _PAIRS):  # (document, period) rows
            row = np.arange(low, min(low + _PAIRS, int(at[-1])))
            doc = np.searchsorted(at, row, "right") - 1
            period = row - at[doc] + 1
            counts = (n[doc] - period - 1) // step(period) + 1
            counts[n[doc] < np.maximum(LEAST, TIMES * period)] = 0
            total = np.concatenate([[0], np.cumsum(counts)])
            i = 0
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
                pair = np.repeat(np.arange(i, j), counts[i:j])
                number = np.arange(len(pair)) - np.repeat(total[i:j] - total[i], counts[i:j])
                yield first + doc[pair], period[pair], begins[first + doc[pair]] + number * step(period[pair])
                i = j


def _extended(ids: np.ndarray, begin: int, end: int, place: int, period: int) -> tuple[int, int]:
    """The stretch around a place that keeps the period, word by word."""
    last, first = place, place
    while last + period < end and ids[last] == ids[last + period]:
        last += 1
    while first > begin and ids[first - 1] == ids[first - 1 + period]:
        first -= 1
    return first, last + period


def runs_of(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, prime: int = _PRIME) -> np.ndarray:
    """(document, start, length, period) of every run in the documents that lie at [begins, ends) in `ids`, in this order;
    starts count from the document's first word."""
    hashes, found = Prefixes(ids, prime), {}
    for doc, period, place in _grid(begins, ends):
        same = np.flatnonzero(ids[place] == ids[place + period])
        doc, period, place = doc[same], period[same], place[same]
        after = hashes.longest(lambda m: hashes.equal(place, place + period, m), ends[doc] - place - period)
        before = hashes.longest(lambda m: hashes.equal(place - m, place + period - m, m), place - begins[doc])
        start, end = place - before, place + period + after
        long = np.flatnonzero(end - start >= np.maximum(LEAST, TIMES * period))
        rows = np.stack([doc, start, end, period, place], axis=1)[long]
        rows = rows[np.lexsort(rows.T[3::-1])]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]))
        # periods of a document come in ascending order, so a stretch is known by its smallest one
        for k, (doc_, start_, end_, period_, _) in zip(first.tolist(), rows[first].tolist(), strict=True):
            if (doc_, start_, end_) in found:
                continue
            if np.array_equal(ids[start_ : end_ - period_], ids[start_ + period_ : end_]):
                found[doc_, start_, end_] = period_
                continue
            while k < len(rows) and tuple(rows[k, :4]) == (doc_, start_, end_, period_):  # hashes have collided
                low, high = _extended(ids, int(begins[doc_]), int(ends[doc_]), int(rows[k, 4]), period_)
                if high - low >= max(LEAST, TIMES * period_):
                    found.setdefault((doc_, low, high), period_)
                k += 1
    rows = np.array([(doc, start - begins[doc], end - start, period) for (doc, start, end), period in found.items()], np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _analysed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words of each text, its runs, its text without their repetitions)."""
    ids, owner, names = words_of(texts)
    ends = np.searchsorted(owner, np.arange(len(texts)), "right")
    begins = np.searchsorted(owner, np.arange(len(texts)), "left")
    runs = runs_of(ids, begins, ends)
    # a word is dropped if a run covers it behind its first period: +1 where that begins, -1 where the run ends
    change = np.zeros(len(ids) + 1, np.int64)
    start = begins[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    keep = np.cumsum(change[:-1]) == 0
    at = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])
    kept = pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(ids[keep])))
    return ends - begins, runs, pc.binary_join(kept, " ").to_pylist()


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its kept words joined by one space.

    A run is a maximal stretch of words with a smallest period q that is at least max(6, 4 * q) words long. What runs hold
    behind their first period is left out of `collapsed`. Null and empty texts have no words, no runs and an empty
    `collapsed`; rows that repeat an id, and rows without one, are analysed each on its own; an empty table gives no rows;
    other columns aren't read. A task holds a block of texts, or one longer text, at a time, and looks at `_PAIRS` pairs of
    a period and a place at a time.
    """
    key = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1).to_pylist(), _BLOCK):
                n, runs, collapsed = _analysed(texts)
                at = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
                values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), lists, pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, then the smallest start, then the smallest period; null without one."""
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    ahead = lambda a, b: (more(a, b) > 0) | ((more(a, b) == 0) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(ahead(x, best), x).otherwise(best))


def with_repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), every tenth document (by a hash h of its id) repeating part of itself: with g = h / 10, its words from
    a = g % n on are the words a .. a + p - 1 over and over, p being 1 + (n - a) / (3 + g % 8). Rows without an id stay as
    they are."""
    h = F.crc32(docs[id_col].cast("string").cast("binary"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    chosen = F.coalesce((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    rows = rows.withColumn("words", F.when(chosen, words)).withColumn("a", a)
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("id", F.when(F.col("words").isNotNull() & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
