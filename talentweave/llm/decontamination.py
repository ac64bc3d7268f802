"""Benchmark decontamination: item-sized windows of documents against the benchmark's items.

Windows and items have SimHash fingerprints of their weighted five-word shingles. Items of a size have a multi-index:
fingerprints are cut into blocks, and two within the radius agree in some block up to radius / blocks bits, so sorted
lists of all near values of each block give every item within the radius of a window. Those are the candidates; they are
verified by the exact weighted similarity of their shingles, sum(w * min) / sum(w * max) over counts, with
w = 1 + ln(items / items that have the shingle), counted over the whole benchmark and kept as integers.

A window is fingerprinted where the shingles that the benchmark knows at all weigh enough in it to reach the similarity
with the lightest item of its size; that bound loses nothing. Items of fewer than five words have one shingle, their
whole sequence, and are found where it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbatch import blocks, utf8
from .wordgrams import SHINGLE, mix, shingles, words

SIMILARITY = 0.8
BITS = 64
#: Fingerprints of sets of the least similarity differ in about 10 of 64 bits, with a standard deviation below 3.
RADIUS = 20
BLOCKS = 8
#: Code points of the items that are matched in one pass; a larger benchmark takes more passes.
PASS_CHARS = 4_000_000
#: Weights are integers of this many units, so sums don't depend on their order.
UNITS = 1 << 10
_BLOCK = 1 << 20
_PLACES = 4096
_EACH = BITS // BLOCKS
_NEAR = np.array([v for v in range(1 << _EACH) if v.bit_count() <= RADIUS // BLOCKS], np.uint16)


@dataclass(frozen=True)
class SizedItems:
    """Items of one number of words and their multi-index: block and value, ascending, of all values near an item's."""

    words: int
    items: np.ndarray
    prints: np.ndarray
    least: int  # the smallest total weight
    keys: np.ndarray
    owners: np.ndarray

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all fingerprints within RADIUS bits of each other."""
        asked = _block_keys(prints).ravel()
        low, high = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        n = high - low
        window = np.repeat(np.arange(len(asked)) // BLOCKS, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pairs = np.unique(window * len(self.items) + self.owners[place])
        window, item = pairs // len(self.items), pairs % len(self.items)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], self.items[item[close]]


def _block_keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint the numbers of its blocks' values, those of different blocks being different."""
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(_EACH)
    return ((prints[:, None] >> shifts).astype(np.uint16) & np.uint16((1 << _EACH) - 1)) | (np.arange(BLOCKS, dtype=np.uint16) << np.uint16(_EACH))


@dataclass(frozen=True)
class Items:
    """Items of one pass; `shingles` are ascending and have `weights`, any other shingle weighs `rare`."""

    ids: list
    counts: list[dict[int, int]]
    totals: np.ndarray
    shingles: np.ndarray
    weights: np.ndarray
    rare: int
    sized: list[SizedItems]  # by ascending size, of SHINGLE words or more
    short: dict[int, dict[int, list[int]]]  # words: shingle: items of fewer words

    @property
    def most_words(self) -> int:
        return self.sized[-1].words if self.sized else SHINGLE


def bit_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums (n + 1 x BITS) of the weighted bits, as +1 or -1, of shingles."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    out = np.zeros((len(hashes) + 1, BITS), np.int64)
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of runs of `size` shingles: the signs of the weighted sums of their bits."""
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weight_of(items: np.ndarray | int, n: int) -> np.ndarray:
    """The weight, in units, of shingles that `items` of n items have."""
    return np.round(UNITS * (1 + np.log(n / np.maximum(1, items)))).astype(np.int64)


def _item_shingles(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, owner = words(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    value, text, _ = shingles(hashes, owner, len(texts))
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    return [value[ends[k] : ends[k + 1]] for k in range(len(texts))], np.bincount(owner, minlength=len(texts))


def prepare(ids: list, texts: list[str], others: tuple[int, dict[int, int]] | None = None) -> Items:
    """Items without a word are left out. `others`: items with a word in the whole benchmark, and how many have a shingle."""
    lists, sizes = _item_shingles(texts)
    kept = [k for k in range(len(texts)) if sizes[k]]
    counts = [dict(Counter(lists[k].tolist())) for k in kept]
    n, having = others or (len(kept), Counter(s for c in counts for s in c))
    known = np.array(sorted({s for c in counts for s in c}), np.uint64)
    weights = weight_of(np.array([having[s] for s in known.tolist()], np.int64), max(1, n))
    of = dict(zip(known.tolist(), weights.tolist(), strict=True))
    totals = np.array([sum(of[s] * c for s, c in x.items()) for x in counts], np.int64)
    prints = np.zeros(len(kept), np.uint64)
    groups: dict[int, list[int]] = {}
    short: dict[int, dict[int, list[int]]] = {}
    for k, source in enumerate(kept):
        size, own = int(sizes[source]), lists[source]
        if size < SHINGLE:
            short.setdefault(size, {}).setdefault(int(own[0]), []).append(k)
            continue
        groups.setdefault(size, []).append(k)
        prints[k] = fingerprints(bit_sums(own, np.array([of[s] for s in own.tolist()])), np.zeros(1, np.int64), len(own))[0]
    sized = []
    for size in sorted(groups):
        members = np.array(groups[size])
        near = (_block_keys(prints[members])[:, :, None] ^ _NEAR).reshape(len(members), -1)
        owners = np.repeat(np.arange(len(members), dtype=np.int32), near.shape[1])
        order = np.argsort(near.ravel(), kind="stable")
        sized.append(SizedItems(size, members, prints[members], int(totals[members].min()), near.ravel()[order], owners[order]))
    return Items([ids[k] for k in kept], counts, totals, known, weights, int(weight_of(1, max(1, n))), sized, short)


def _verified(items: Items, value: list[int], weight: list[int], size: int, starts: list[int], item: int) -> tuple[float, int]:
    """(similarity, start) of the best of the windows of `size` shingles, the first on ties; counts slide from one to the next."""
    wanted, total = items.counts[item], int(items.totals[item])
    seen: dict[int, int] = {}
    common = own = 0
    best, at, reach = (0.0, -1), 0, 0  # the window counted so far is value[at:reach]

    def add(p: int, sign: int) -> None:
        nonlocal common, own
        s, w = value[p], weight[p]
        n = seen.get(s, 0)
        seen[s] = n + sign
        own += sign * w
        if (n if sign > 0 else n - 1) < wanted.get(s, 0):
            common += sign * w

    for start in starts:
        if start >= reach:
            seen.clear()
            common = own = 0
            at = reach = start
        while at < start:
            add(at, -1)
            at += 1
        while reach < start + size:
            add(reach, 1)
            reach += 1
        found = common / (own + total - common)
        if found > best[0]:
            best = (found, start)
    return best


def _found(items: Items, value: np.ndarray, weight: np.ndarray, known: np.ndarray, n_words: int) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window for each sized item that a text of five words or more has.

    `value` are the text's shingles, `weight` their weights where `known` to the benchmark.
    """
    own = np.concatenate([[0], np.cumsum(np.where(known, weight, 0))])
    hits = np.flatnonzero(known)
    best: dict[int, tuple[float, int, int]] = {}
    for first in range(0, len(value), _PLACES):
        last = min(len(value), first + _PLACES)  # windows that begin here
        reach = min(len(value), last + items.most_words)
        if hits.searchsorted(reach) == hits.searchsorted(first):
            continue
        sums, most = None, own[reach] - own[first]
        for group in items.sized:
            if most < SIMILARITY * group.least:
                continue
            size = min(group.words, n_words) - SHINGLE + 1
            starts = np.arange(first, min(last, len(value) - size + 1))
            starts = starts[own[starts + size] - own[starts] >= SIMILARITY * group.least]
            if not len(starts):
                continue
            if sums is None:
                sums = bit_sums(value[first:reach], weight[first:reach])
            near: dict[int, list[int]] = {}
            for window, item in zip(*(x.tolist() for x in group.within_radius(fingerprints(sums, starts - first, size))), strict=True):
                near.setdefault(item, []).append(int(starts[window]) - first)
            if near:
                part, weights = value[first:reach].tolist(), weight[first:reach].tolist()
            for item, places in near.items():
                found, at = _verified(items, part, weights, size, places, item)
                if found >= SIMILARITY and (item not in best or found > best[item][0]):
                    best[item] = (found, at + first, size + SHINGLE - 1)
    for item in sorted(best):
        yield item, *best[item]


def _short_found(items: Items, hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> dict[int, list[tuple[int, float, int, int]]]:
    """Per text the items of fewer than five words that it has, with their first places."""
    out: dict[int, list[tuple[int, float, int, int]]] = {}
    begins = np.searchsorted(owner, np.arange(n_texts))
    for size, of in sorted(items.short.items()):
        if len(hashes) < size:
            continue
        starts = np.flatnonzero(owner[: len(hashes) - size + 1] == owner[size - 1 :])
        one = np.repeat(np.arange(len(starts)), size)
        value, text, _ = shingles(hashes[(starts[:, None] + np.arange(size)).ravel()], one, len(starts))  # a window is a text here
        for w in np.flatnonzero(np.isin(value, np.array(list(of), np.uint64))).tolist():
            d = int(owner[starts[w]])
            known = {x[0] for x in out.get(d, ())}
            out.setdefault(d, []).extend((k, 1.0, int(starts[w] - begins[d]), size) for k in of[int(value[w])] if k not in known)
    return out


def leaks_of(items: Items, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, float, int, int]]]]:
    """(text, its leaks by item) for the texts of a batch that have any."""
    if not len(items.ids):
        return
    low = np.zeros(1 << 20, bool)
    low[(items.shingles >> np.uint64(44)).astype(np.int64)] = True
    least = SIMILARITY * min((g.least for g in items.sized), default=np.inf)
    for i, j in blocks(offsets, _BLOCK):
        hashes, owner = words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
        leaks = _short_found(items, hashes, owner, j - i)
        value, text, _ = shingles(hashes, owner, j - i)
        maybe = np.flatnonzero(low[(value >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(items.shingles, value[maybe]), len(items.shingles) - 1)
        hit = items.shingles[at] == value[maybe]
        maybe, at = maybe[hit], at[hit]
        heavy = np.bincount(text[maybe], items.weights[at], minlength=j - i)
        ends = np.searchsorted(text, np.arange(j - i + 1))
        sizes = np.bincount(owner, minlength=j - i)
        weight = np.full(len(value), items.rare, np.int64)
        weight[maybe] = items.weights[at]
        known = np.zeros(len(value), bool)
        known[maybe] = True
        for d in np.flatnonzero((heavy >= least) & (sizes >= SHINGLE)).tolist():
            a, b = ends[d], ends[d + 1]
            leaks.setdefault(d, []).extend(_found(items, value[a:b], weight[a:b], known[a:b], int(sizes[d])))
        for d in sorted(leaks):
            if leaks[d]:
                yield i + d, sorted(leaks[d])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, shingle) for the distinct shingles of every item, and (-1, 0) for the item itself."""
    for batch in batches:
        lists, sizes = _item_shingles([x or "" for x in batch.column(1).to_pylist()])
        for part, own, size in zip(batch.column(0).to_pylist(), lists, sizes, strict=True):
            if size:
                own = np.unique(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*[part] * len(own), -1], pa.int32()), pa.array(np.append(own, 0))], ["part", "shingle"])


class Benchmark:
    """The items in parts of about `chars` code points, so that what the driver holds and a task gets is bounded by a part
    or a single item; weights count over all of them. Null texts are left out."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch | None, item_col: str, text_col: str, chars: int) -> None:
        rows = benchmark.where(benchmark[text_col].isNotNull()).select(benchmark[item_col].alias("id"), benchmark[text_col].alias("text"))
        total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        self.parts = max(1, -(-total // chars))
        self.rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(self.parts)).cast("int"))
        if self.parts == 1:
            return
        if scratch is None:
            raise ValueError("a benchmark of several parts needs a scratch folder")
        found = scratch.save(self.rows.select("part", "text").mapInArrow(_shingle_rows, "part int, shingle bigint"), "item_shingles")
        self.items = found.where("part = -1").count()
        found = found.where("part >= 0")
        counts = found.groupBy("shingle").agg(F.count("*").alias("items")).where("items > 1")
        self.having = scratch.save(found.distinct().join(counts, "shingle"), "item_counts")

    def passes(self) -> Iterator[Items]:
        for part in range(self.parts):
            own = self.rows.where(F.col("part") == part).orderBy("id", "text").collect()
            others = None
            if self.parts > 1:
                table = self.having.where(F.col("part") == part).select("shingle", "items").toArrow()
                others = (self.items, _Ones(zip(table.column(0).to_numpy().view(np.uint64).tolist(), table.column(1).to_pylist(), strict=True)))
            yield prepare([r.id for r in own], [r.text for r in own], others)


class _Ones(dict):
    """Counts of the shingles that several items have; all others have one."""

    def __missing__(self, key: int) -> int:
        return 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each item in each row that has one.

    Rows without a leak are not returned. Null and empty texts and items and an empty benchmark give none; repeated rows and
    items give repeated rows; of equal windows the first counts; a document shorter than an item is one window, and has it
    only if both have five words or more. Other columns are not read. A benchmark above `chars` code points is matched in
    passes, each written to `scratch`.
    """
    key, item_key = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    parts, found = Benchmark(benchmark, scratch, item_col, text_col, chars), None
    for number, items in enumerate(parts.passes()):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(d, items.ids[k], *best) for d, leaks in leaks_of(items, *utf8(batch.column(1))) for k, *best in leaks]
                columns = [batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.float64()), *(pa.array([x[k] for x in out], pa.int64()) for k in (3, 4))]
                if out:
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, f"doc_id {key}, item_id {item_key.simpleString()}, similarity double, first_word bigint, n_words bigint")
        part = scratch.save(part, f"leaks_{number}") if parts.parts > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, text_col: str = "text", item_col: str = "item_id", chars: int = PASS_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that have no leak as `find_leaks` defines it; nothing is shuffled."""
    place = docs.columns.index(text_col)
    parts, kept = Benchmark(benchmark, scratch, item_col, text_col, chars), docs
    for number, items in enumerate(parts.passes()):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _ in leaks_of(items, *utf8(batch.column(place)))]] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
        kept = scratch.save(kept, f"clean_{number}") if parts.parts > 1 else kept
    return kept
