"""Removal of repeated substrings: every byte covered by a string of LENGTH bytes that also starts anywhere else.

Minimizer anchors and hash names stand in for prefix doubling: no ranks are sorted at growing offsets. Names of strings are
hashes, which agree wherever the strings do; the name of a string of twice the length is the pair of the names at its two
halves and needs no exchange. Two rounds drop what is unique.

Round 1 groups one anchor for many positions. Each string of LENGTH bytes is represented by its minimal ANCHOR bytes (by
hash, the last on ties), a choice that depends on the string alone: equal strings have equal anchors at equal offsets. An
anchor that occurs once retires all strings it stands for. Where all occurrences of an anchor have the same surroundings
in full, all its strings repeat and need no second round.

Round 2 compares the strings themselves: pairs of the names of both halves, sorted within the occurrences of an anchor, of
which equal surroundings are there once. Anchors with very many different surroundings are dealt by pair instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import NO_ID, order_key
from .scratch import Scratch
from .textbatch import utf8
from .wordgrams import mix

LENGTH = 200
ANCHOR = 48
#: Different surroundings of an anchor that one task ranks at most.
ANCHOR_CLASSES = 5000
_PIECE = 1 << 17
#: Anchors whose strings are ranked together, about, and texts that are cut together.
_ANCHORS = 4000
_TEXTS = 500
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_OTHER = 0xD6E8FEB86659FD93
_OTHER_INVERSE = pow(_OTHER, -1, 1 << 64)
_VALUES = np.random.default_rng(41).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; the longest table so far is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(10, (n - 1).bit_length())
        known = _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return known[:n]


class Names:
    """Names of substrings of `data`: equal substrings of the same length have the same name, wherever they start."""

    def __init__(self, data: np.ndarray, other: bool = False) -> None:
        self.inverse = _powers(_OTHER_INVERSE if other else _INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[int(other)][data] * _powers(_OTHER if other else _ODD, len(data) + 1)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first byte, end) of about _PIECE bytes; long texts are cut so that each string lies in one piece."""
    now, size = [], 0
    for d in range(len(offsets) - 1):
        total = int(offsets[d + 1] - offsets[d])
        for a in range(0, total - length + 1, _PIECE):
            b = min(total, a + _PIECE + length - 1)
            if size + b - a > 2 * _PIECE and now:
                yield now
                now, size = [], 0
            now.append((d, a, b))
            size += b - a
    if now:
        yield now


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor's name, name of the surroundings, anchor, first and last string) for each anchor, in bytes of the text.

    The strings start from `first` to `last`; the surroundings are all their bytes.
    """
    span = length - anchor + 1
    for pieces in _pieces(offsets, length):
        part = np.concatenate([data[offsets[d] + a : offsets[d] + b] for d, a, b in pieces])
        sizes = np.array([b - a for _, a, b in pieces])
        ends = np.cumsum(sizes)
        names = Names(part)
        grams = mix(names.of(slice(0, len(part) - anchor + 1), slice(anchor, len(part) + 1)))
        least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (_LOW - (least & _LOW)).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        inside = np.flatnonzero(piece[: len(at)] == piece[length - 1 :])
        at = at[inside]
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (np.diff(piece[inside]) != 0)))
        first, last = inside[new], inside[np.append(new[1:], len(inside)) - 1]
        at = at[new]
        size = last - first + length
        around = mix(names.of(first, last + length) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (at - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        which = piece[first]
        shift = np.array([a for _, a, _ in pieces])[which] - (ends - sizes)[which]
        text = np.array([d for d, _, _ in pieces])[which]
        yield text, grams[at].view(np.int64), around.view(np.int64), at + shift, first + shift, last + shift


def _anchor_rows(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for text, k, c, at, first, last in anchors(data, offsets, length, anchor):
                rows = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(c), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, pa.int32()) for x in (at, first, last))], ["k", "c", "key", "h", "at", "first", "last"]
                )

    return run


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of a union of intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, int)
    return starts[new], ends[np.append(new[1:], len(starts)) - 1] if len(starts) else ends


def _surroundings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(k, key, h, n, at, first, bytes): the bytes around each listed anchor of a text."""
    for batch in batches:
        texts = batch.column(2)
        marks = batch.column(3)
        out: dict[str, list] = {x: [] for x in ("k", "key", "h", "n", "first", "bytes")}
        for row in range(batch.num_rows):
            text = (texts[row].as_py() or "").encode()
            for m in marks[row].as_py():
                for name in ("k", "n", "first"):
                    out[name].append(m[name])
                out["key"].append(batch.column(0)[row].as_py())
                out["h"].append(batch.column(1)[row].as_py())
                out["bytes"].append(text[m["first"] : m["last"] + length])
            if len(out["k"]) > _ANCHORS:
                yield _surrounding_batch(out)
                out = {x: [] for x in out}
        yield _surrounding_batch(out)


def _surrounding_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"k": pa.int64(), "key": pa.int64(), "h": pa.int32(), "n": pa.int64(), "first": pa.int32(), "bytes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[x], kinds[x]) for x in kinds], list(kinds))


def _pairs(around: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, name of the first half, name of the second half) of all strings in the rows' bytes."""
    sizes = np.fromiter(map(len, around), np.int64, len(around))
    data = np.frombuffer(b"".join(around), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(around)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, half = begins[row] + place, length // 2
    return row, place, mix(Names(data).of(at, at + half)), mix(Names(data, True).of(at + half, at + length))


def _rank(length: int):
    """Round 2 within anchors: rows come sorted by anchor; gives the runs of repeated strings of rows that stand for one text."""

    def ranked(k: np.ndarray, n: np.ndarray, key, h, first: np.ndarray, around: list[bytes]) -> pa.RecordBatch:
        row, place, a, b = _pairs(around, length)
        a = a ^ mix(k.view(np.uint64))[row]  # strings are compared within an anchor
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= n[row] == 1
        row, place = row[again], place[again]
        keep = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (np.diff(place) > length))) if len(row) else np.zeros(0, int)
        last = np.append(keep[1:], len(row)) - 1 if len(row) else keep
        r = pa.array(row[keep], pa.int64())
        begin = first[row[keep]] + place[keep]
        end = first[row[keep]] + place[last] + length
        return pa.RecordBatch.from_arrays([key.take(r), h.take(r), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["key", "h", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            col = lambda x: t.column(x).combine_chunks()
            return ranked(col("k").to_numpy(), col("n").to_numpy(), col("key"), col("h"), col("first").to_numpy().astype(np.int64), col("bytes").to_pylist())

        limit = _ANCHORS
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                k = part.column(0).to_numpy()
                if held and rows >= limit:
                    more = np.flatnonzero(k != held[-1].column(0)[held[-1].num_rows - 1].as_py())
                    cut = int(more[0]) if len(more) else part.num_rows
                    if cut:
                        held.append(part.slice(0, cut))
                    if len(more):
                        yield flush(held)
                        held, rows = [], 0
                    part = part.slice(cut)
                if part.num_rows:
                    held.append(part)
                    rows += part.num_rows
        if held:
            yield flush(held)

    return run


def _pair_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, place, a, b = _pairs(part.column(5).to_pylist(), length)
                r = pa.array(row)
                begin = part.column(4).to_numpy().astype(np.int64)[row] + place
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(1).take(r), part.column(2).take(r), part.column(3).take(r), pa.array(begin, pa.int32())], ["a", "b", "key", "h", "n", "begin"])

    return run


def repeated_runs(docs: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, anchor_classes: int = ANCHOR_CLASSES) -> DataFrame:
    """(key, h, begin, end): byte intervals of texts whose union is what repeats; `docs` has (key, h, text)."""
    schema = "k bigint, c bigint, key bigint, h int, at int, first int, last int"
    found = docs.select("key", "h", "text").mapInArrow(_anchor_rows(length, anchor), schema)
    often = found.groupBy("k").agg(F.count("*").alias("total"), (F.min("c") != F.max("c")).alias("differ")).where("total > 1").select("k", "differ")
    repeated = scratch.save(found.join(often, "k"), "anchors")
    scratch.release()
    whole = repeated.where("not differ").select("key", "h", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    differ = repeated.where("differ")
    classes = differ.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "h", "at", "first", "last")).alias("one")).select("k", "c", "n", "one.*")
    classes = scratch.save(classes, "classes")
    equal = differ.join(classes.where("n > 1").select("k", "c"), ["k", "c"]).select("key", "h", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    done = scratch.save(whole.unionByName(equal), "whole")

    marks = classes.groupBy("key", "h").agg(F.collect_list(F.struct("k", "n", "first", "last")).alias("marks"))
    around = "k bigint, key bigint, h int, n bigint, first int, bytes binary"
    around = docs.select("key", "h", "text").join(marks, ["key", "h"]).mapInArrow(lambda batches: _surroundings(batches, length), around)
    around = scratch.save(around, "around")
    scratch.release()
    hot = classes.groupBy("k").count().where(F.col("count") > anchor_classes).select("k")
    columns = ["k", "key", "h", "n", "first", "bytes"]
    some = around.join(hot, "k", "left_anti").select(columns).repartition("k").sortWithinPartitions("k").mapInArrow(_rank(length), "key bigint, h int, begin int, end int")
    runs = done.unionByName(scratch.save(some, "ranked"))
    if hot.head(1):
        pairs = around.join(hot, "k").select(columns).mapInArrow(_pair_rows(length), "a bigint, b bigint, key bigint, h int, n bigint, begin int")
        twice = pairs.groupBy("a", "b").count().where("count > 1").select("a", "b")
        dealt = pairs.where("n = 1").join(twice, ["a", "b"]).select("key", "h", "begin", (F.col("begin") + length).alias("end"))
        runs = runs.unionByName(scratch.save(dealt, "dealt"))
    scratch.drop("anchors", "classes", "around")
    return runs


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, anchor_classes: int = ANCHOR_CLASSES) -> DataFrame:
    """(key, n_bytes, removed: array of (begin, end), kept: the remaining bytes) for every row, in UTF-8 bytes.

    `key` is the id as a 64-bit integer, the smallest one for null. A null text is empty; texts shorter than `length`
    lose nothing. Strings are judged on the input, within one text only; rows that repeat a text lose all of it if it is
    long enough. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(order_key(docs[id_col]).alias("key"), F.hash(text).alias("h"), text.alias("text"))
    runs = repeated_runs(rows, scratch, length, anchor, anchor_classes)
    lists = runs.groupBy("key", "h").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
            sizes, removed, kept = [], [], []
            for row in range(batch.num_rows):
                data = (batch.column(1)[row].as_py() or "").encode()
                runs = batch.column(2)[row]
                values = runs.values if runs.is_valid else None
                a, b = _merged(*(values.field(x).to_numpy().astype(np.int64) for x in ("begin", "end"))) if values is not None else ((), ())
                places = [0, *(x for pair in zip(a, b, strict=True) for x in pair), len(data)]
                sizes.append(len(data))
                removed.append([{"begin": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(data[x:y] for x, y in zip(places[::2], places[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["key", "n_bytes", "removed", "kept"])

    return rows.join(lists, ["key", "h"], "left").select("key", "text", "runs").mapInArrow(run, "key bigint, n_bytes bigint, removed array<struct<begin:bigint,end:bigint>>, kept binary")


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), sha256(kept).hexdigest()))
    return out


def original_id(key):
    return F.when(key != NO_ID, key)
