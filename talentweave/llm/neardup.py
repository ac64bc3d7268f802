"""N-gram Jaccard join of all documents: exact links of 0.8 or more between their sets of five-word shingles.

Documents with the same set are one class. What follows is a sequence of lossless reductions to classes that can link.

1. Sharing test. In a global order (here: by hash), a set of n elements and any set that links with it share at least
   ceil(0.08 n) of the elements in their beginnings of floor(0.2 n) + ceil(0.1 n). So only these beginnings are dealt by
   element, and a class stays if enough of its own are found in another class.
2. Order by frequency. Among the classes left, elements are counted and ordered from rare to frequent. Two linked
   classes share an element in their beginnings of floor(0.2 n) + 1, which holds few frequent ones. Star edges from each
   element's smallest class to its others give groups that hold all links.
3. Prefix-tree join within each group (`triejoin`). A group that is too large for a task is compared with one of its
   classes first; only the classes that don't link with it are joined with the others, in blocks of bounded size.

Arrow blobs carry elements between the steps, dealt by the leading bits of their hashes; an element that many classes of
a batch share goes out once for the batch and is marked, so no bucket holds the rows of a hot element.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .ordering import NO_ID, order_key
from .scratch import Scratch
from .textbatch import blocks, utf8
from .triejoin import link_roots, linked
from .wordgrams import shingles, words

#: Elements of a bucket that one task sorts, about.
BUCKET = 2_000_000
#: Rows of a batch that are sorted together, and how many of them share an element before it counts as frequent everywhere.
SLICE = 2000
HOT = 8
#: Classes and elements of a group that one task joins at most.
GROUP_CLASSES = 20_000
GROUP_ELEMENTS = 4_000_000
_BLOCK = 1 << 20
_FREQUENT = np.int64(1 << 40)


def missing(n):
    """Elements of a set of n that a linked set may lack: n - ceil(0.8 n)."""
    return n // 5


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text."""
    data, offsets = utf8(batch.column(column))
    for i, j in blocks(offsets, _BLOCK):
        value, owner, _ = shingles(*words(data[offsets[i] : offsets[j]], offsets[i : j + 1]), j - i)
        ends = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(value[ends[k] : ends[k + 1]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _digest(items: np.ndarray) -> tuple[int, int]:
    if not len(items):
        return 0, 0
    a, b = np.frombuffer(blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(items), *_digest(items)) for _, items in _sets(batch, 1)]
        n, a, b = (pa.array([x[k] for x in found], pa.int64()) for k in range(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), n, a, b], ["key", "n", "k1", "k2"])


def _dealt(bits: int, elements: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, bytes of each array) by the leading bits of the elements, which are ascending."""
    bucket = (elements >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(elements), np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), [x[a:b].tobytes() for x in (elements, *values)]


def _batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ENTRIES = pa.schema([("bucket", pa.int32()), ("elements", pa.binary()), ("classes", pa.binary()), ("counted", pa.binary()), ("local_classes", pa.binary()), ("local_counts", pa.binary())])


def _beginnings(bits: int):
    """Deals the first elements of every set; those shared within the batch are counted here and go out twice in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            elements, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, items in _sets(batch, 0):
                if len(items):
                    first = items[: missing(len(items)) + -(-len(items) // 10)]
                    elements.append(first)
                    classes.append(np.full(len(first), _digest(items)[0]))
            e, c = np.concatenate(elements), np.concatenate(classes)
            order = np.lexsort((c, e))
            e, c = e[order], c[order]
            new = np.ones(len(e), bool)
            new[1:] = (e[1:] != e[:-1]) | (c[1:] != c[:-1])
            e, c = e[new], c[new]  # a class once for each element
            start = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, int)
            size = np.diff(np.append(start, len(e)))
            shared = np.repeat(size > 1, size)
            own, count = np.unique(c[shared], return_counts=True)
            send = ~shared
            send[start[size > 1]] = send[(start + size - 1)[size > 1]] = True
            rows = [(b, *x, b"", b"") for b, x in _dealt(bits, e[send], c[send], shared[send].astype(np.uint8))]
            if len(own):
                rows.append((int(abs(int(own[0])) % (1 << bits)), b"", b"", b"", own.tobytes(), count.astype(np.int64).tobytes()))
            if rows:
                yield _batched(rows, _ENTRIES)

    return run


def _shared_in_bucket(table: pa.Table) -> pa.Table:
    """(k1, here, local): how many uncounted elements of a class another class has; counts of the batches are passed on."""
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    e, c, counted = joined("elements", np.uint64), joined("classes", np.int64), joined("counted", np.uint8)
    order = np.lexsort((c, e))
    e, c, counted = e[order], c[order], counted[order]
    start = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, int)
    size = np.diff(np.append(start, len(e)))
    last = start + size - 1
    shared = np.repeat(c[start] != c[last], size) if len(e) else np.zeros(0, bool)
    own, count = np.unique(c[shared & (counted == 0)], return_counts=True)
    there, local = joined("local_classes", np.int64), joined("local_counts", np.int64)
    return pa.table({"k1": np.concatenate([own, there]), "here": np.concatenate([count, np.zeros(len(there), np.int64)]).astype(np.int64), "local": np.concatenate([np.zeros(len(own), np.int64), local])})


_FULL = pa.schema([("bucket", pa.int32()), ("elements", pa.binary()), ("classes", pa.binary()), ("marks", pa.binary())])


def _by_element(bits: int):
    """Deals all elements of the sets, with class and a mark on those that are frequent in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not sets:
                continue
            e, c = np.concatenate(sets), np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            order = np.argsort(e, kind="stable")
            e, c = e[order], c[order]
            start = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            size = np.diff(np.append(start, len(e)))
            hot = np.repeat(size >= HOT, size)
            send = ~hot
            send[start[size >= HOT]] = True
            yield _batched([(b, *x) for b, x in _dealt(bits, e[send], c[send], hot[send].astype(np.uint8))], _FULL)

    return run


def _answers(bits: int):
    """For each bucket of elements: what every class in it needs to know, dealt by class."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        e, c, marks = joined("elements", np.uint64), joined("classes", np.int64), joined("marks", np.uint8)
        order = np.argsort(e, kind="stable")
        e, c, marks = e[order], c[order], marks[order]
        start = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        size = np.diff(np.append(start, len(e)))
        often = np.maximum.reduceat(marks, start) > 0
        size[often] = _FREQUENT
        frequency = np.repeat(size, np.diff(np.append(start, len(e))))
        send = (frequency > 1) & (marks == 0)
        e, c, frequency = e[send], c[send], frequency[send]
        to = (c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) if bits else np.zeros(len(c), np.uint64)
        order = np.argsort(to, kind="stable")
        to, e, c, frequency = to[order], e[order], c[order], frequency[order]
        cuts = np.append(np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1)), len(to))
        rows = [(int(to[a]), e[a:b].tobytes(), c[a:b].tobytes(), frequency[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_batches([_batched(rows, _ANSWERS)])

    return run


_ANSWERS = pa.schema([("bucket", pa.int32()), ("elements", pa.binary()), ("classes", pa.binary()), ("frequencies", pa.binary())])


def _hot_answers(bits: int):
    """What a class knows of elements that are frequent in its own batch, dealt by class; also its size, as element 0 of frequency -n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not sets:
                continue
            keys = batch.column(0).to_numpy()
            e, c = np.concatenate(sets), np.repeat(keys, [len(s) for s in sets])
            _, place, size = np.unique(e, return_inverse=True, return_counts=True)
            hot = size[place] >= HOT
            e = np.concatenate([e[hot], np.zeros(len(keys), np.uint64)])
            frequency = np.concatenate([np.full(int(hot.sum()), _FREQUENT), [-len(s) for s in sets]]).astype(np.int64)
            c = np.concatenate([c[hot], keys])
            to = (c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) if bits else np.zeros(len(c), np.uint64)
            order = np.argsort(to, kind="stable")
            to, e, c, frequency = to[order], e[order], c[order], frequency[order]
            cuts = np.append(np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1)), len(to))
            yield _batched([(int(to[a]), e[a:b].tobytes(), c[a:b].tobytes(), frequency[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], _ANSWERS)

    return run


def _rare_beginnings(table: pa.Table) -> pa.Table:
    """(element, class): for each class that can link, the elements of its beginning that others have, rare ones first."""
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    e, c, frequency = joined("elements", np.uint64), joined("classes", np.int64), joined("frequencies", np.int64)
    order = np.lexsort((e, frequency, c))
    e, c, frequency = e[order], c[order], frequency[order]
    start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))  # the first row of a class has its size
    size = np.diff(np.append(start, len(c))) - 1
    n = -frequency[start]
    alone = n - size
    first = np.where(size >= n - missing(n), np.maximum(0, missing(n) + 1 - alone), 0)
    place = np.arange(len(c)) - np.repeat(start, size + 1)
    kept = (place > 0) & (place <= np.repeat(first, size + 1))
    return pa.table({"element": e[kept].view(np.int64), "rep": c[kept]})


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links that span the components of each group; the rows of a group follow each other."""
    label, reps, sets = None, [], []

    def done() -> pa.RecordBatch:
        roots = link_roots(sets)
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([reps[r] for r in roots], pa.int64())], ["a", "b"])

    for batch in batches:
        for g, rep, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if g != label and reps:
                yield done()
                reps, sets = [], []
            label = g
            reps.append(rep)
            sets.append(np.frombuffer(items, np.uint64))
    if reps:
        yield done()


def _pivot_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
        found = [linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["label", "rep", "linked"])


def _block_links(table: pa.Table) -> pa.Table:
    """(a, b) links that span the components of the sets that meet in a block."""
    table = table.sort_by([("rep", "ascending"), ("asks", "ascending")])
    reps, place = np.unique(table.column("rep").to_numpy(), return_index=True)  # a set may be on both sides
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").take(pa.array(place)).to_pylist()]
    return pa.table({"a": pa.array(reps, pa.int64()), "b": pa.array(reps[link_roots(sets)], pa.int64())})


def _large_links(large: DataFrame, sizes: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(a, b) links that span the components of groups that are too large for a task."""
    pivots = large.groupBy("label").agg(F.min("rep").alias("rep"))
    pivots = pivots.join(large, ["label", "rep"]).select("label", F.col("rep").alias("pivot"), F.col("items").alias("pivot_items")).dropDuplicates(["label"])
    compared = large.join(pivots, "label").select("label", "rep", "items", "pivot_items").mapInArrow(_pivot_links, "label bigint, rep bigint, linked boolean")
    compared = scratch.save(compared.distinct(), "pivot_links")
    links = compared.where("linked").join(pivots.select("label", "pivot"), "label").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    asking = compared.where("not linked").groupBy("label").agg(F.count("*").alias("n_asking"))
    counts = asking.join(sizes, "label").select("label", F.ceil(F.col("n_asking") / most).cast("int").alias("q"), F.ceil(F.greatest(F.col("n") / most, F.col("elements") / GROUP_ELEMENTS)).cast("int").alias("s"))
    rows = large.join(compared, ["label", "rep"]).join(counts, "label")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    stored = rows.select("label", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), block("s").alias("j"), "rep", "items", F.lit(False).alias("asks"))
    asked = rows.where("not linked").select("label", block("q").alias("i"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), "rep", "items", F.lit(True).alias("asks"))
    return links.unionByName(stored.unionByName(asked).groupBy("label", "i", "j").applyInArrow(_block_links, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", group_classes: int = GROUP_CLASSES) -> DataFrame:
    """(key, n_shingles, component): for every row its set's size and the smallest id reachable by links, itself included.

    `key` is the id as a 64-bit integer, the smallest one for null. A null text, an empty one and one without words has
    the empty set and links with nothing; fewer than five words are one shingle. Repeated rows link. An empty table gives
    an empty one; other columns are not read.
    """
    rows = docs.select(order_key(docs[id_col]).alias("key"), docs[text_col].alias("text"))
    digests = scratch.save(rows.mapInArrow(_digests, "key bigint, n bigint, k1 bigint, k2 bigint"), "digests")
    classes = scratch.save(digests.where("n > 0").groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.first("n").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, int(total * 0.3 / BUCKET).bit_length())

    entries = rows.select("text").mapInArrow(_beginnings(bits), "bucket int, elements binary, classes binary, counted binary, local_classes binary, local_counts binary")
    shared = entries.groupBy("bucket").applyInArrow(_shared_in_bucket, "k1 bigint, here bigint, local bigint")
    shared = shared.groupBy("k1").agg((F.sum("here") + F.max("local")).alias("shared"))
    left = scratch.save(classes.join(shared, "k1").where("shared >= greatest(1, ceil(n * 8 / 100))").select("rep", "k1", "k2", "n"), "left")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep, sets = [], []
            for k, items in _sets(batch, 1):
                if _digest(items) == (k1[k], k2[k]):  # another row of the same id may have another text
                    keep.append(k)
                    sets.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64())], ["rep", "items", "n"])

    # the list of classes grows with the corpus, so it is merged with the texts at every size and never broadcast
    sets = rows.join(left.select(F.col("rep").alias("key"), "k1", "k2").hint("merge"), "key").select("key", "text", "k1", "k2").mapInArrow(chosen, "rep bigint, items binary, n bigint")
    sets = scratch.save(sets, "sets")
    bits = max(4, int((sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / BUCKET).bit_length())

    pairs = sets.select("rep", "items")
    blob = "bucket int, elements binary, classes binary"
    answers = pairs.mapInArrow(_by_element(bits), f"{blob}, marks binary").groupBy("bucket").applyInArrow(_answers(bits), f"{blob}, frequencies binary")
    answers = answers.unionByName(pairs.mapInArrow(_hot_answers(bits), f"{blob}, frequencies binary"))
    begins = scratch.save(answers.groupBy("bucket").applyInArrow(_rare_beginnings, "element bigint, rep bigint"), "beginnings")
    hubs = begins.groupBy("element").agg(F.min("rep").alias("hub"))
    stars = begins.join(hubs, "element").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(stars, scratch, "groups").select(F.col("node").alias("rep"), F.col("root").alias("label"))

    members = scratch.save(sets.join(groups, "rep").select("label", "rep", "items", "n"), "members")
    scratch.drop("left", "sets", "beginnings")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("n").alias("elements"))
    sizes = scratch.save(sizes.withColumn("large", (F.col("n") > group_classes) | (F.col("elements") > GROUP_ELEMENTS)), "sizes")
    small = members.join(sizes.where("not large").select("label"), "label").select("label", "rep", "items")
    links = small.repartition("label").sortWithinPartitions("label").mapInArrow(_grouped, "a bigint, b bigint")
    found = scratch.save(links, "links").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    if sizes.where("large").head(1):
        large = members.join(sizes.where("large").select("label"), "label").select("label", "rep", "items")
        more = components(_large_links(large, sizes.where("large"), scratch, group_classes), scratch, "large_groups")
        found = found.unionByName(more.select(F.col("node").alias("rep"), F.col("root").alias("root")))
    scratch.drop("members")
    smallest = found.groupBy("root").agg(F.min("rep").alias("component"))
    found = found.join(smallest, "root").groupBy("rep").agg(F.min("component").alias("component"))
    named = classes.join(found, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return digests.join(named, ["k1", "k2"], "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))


def one_of_each(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without near duplicates: of each component the row with the smallest id.

    Where that id has several rows, the smallest text of those in the component stays, once. Documents without words link
    with nothing, so all of them stay.
    """
    found = near_duplicates(docs, scratch, id_col, text_col)
    kept = scratch.save(found.where("key = component").groupBy("key").agg(F.count("*").alias("rows")), "kept")
    # the columns of `docs` travel as one struct, so no name can clash
    rows = docs.select(F.struct("*").alias("row"), order_key(docs[id_col]).alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("own")).join(kept.hint("merge"), "key")  # it grows with the corpus
    if kept.where("rows > 1").head(1):
        rows = rows.withColumn("wordless", ~F.col("own").rlike(r"[^\x20\x09-\x0D]"))
        worded = Window.partitionBy("key", "wordless").orderBy("own")
        rows = rows.withColumn("place", F.row_number().over(worded)).where("wordless or place = 1")
    return rows.select("row.*")


def original_id(key):
    return F.when(key != NO_ID, key)
