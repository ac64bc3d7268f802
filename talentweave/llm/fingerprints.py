"""Document fingerprints: Order MinHash signatures, sensitive to edit distance.

k-mers are runs of K words, numbered by occurrence, so the second occurrence of a k-mer differs from the first. A word of
more than LONG characters (text without white space) counts as its runs of GRAM characters. Each of the 2 ** CELL_BITS cells
has an order of all k-mers: a hash of k-mer and number deals every k-mer to one cell, whose order begins with the k-mers
dealt to it, by that hash; all others follow by a hash of the cell. The DEPTH minimal k-mers of the whole text in a
cell's order are put back into text order and hashed as a tuple. Two texts agree in a cell if they share its minimal k-mers
and have them in the same order. Only a text with less than DEPTH k-mers has tuples of fewer.

Everything is Column expressions. Arrays of packed 64-bit integers keep it n log n in the length of a text: the first sort
brings the occurrences of a k-mer together in text order, the second the minimal ones of each cell. The hash of a cell is
computed only where less than DEPTH k-mers were dealt to it, which is rare in long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import NO_ID, order_key, successors
from .scratch import Scratch

K = 2
CELL_BITS = 6
DEPTH = 2
#: Longer words, in characters, are taken apart into runs of GRAM characters.
LONG = 20
GRAM = 5
#: Bits of a position; longer texts share positions between neighbouring k-mers.
PLACE_BITS = 26
_HASH_BITS = 63 - PLACE_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once, also where it stands inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), PLACE_BITS).bitwiseOR(place)


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _cell(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 63 - CELL_BITS)


def _short(words: Column) -> Column:
    """The words, with all runs of GRAM characters in place of a word of more than LONG."""
    runs = lambda w: F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))
    parts = lambda w: F.when(F.length(w) > LONG, runs(w)).otherwise(F.array(w))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), F.flatten(F.transform(words, parts))).otherwise(words)


def _kmers(words: Column) -> Column:
    return let(_short(words), _runs)


def _runs(words: Column) -> Column:
    count = F.greatest(F.size(words) - (K - 1), F.lit(0))
    return F.when(F.size(words) < K, F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))).otherwise(
        F.zip_with(F.slice(words, 1, count), F.slice(words, K, count), lambda a, b: F.xxhash64(a, b))
    )


def _first_of_run(ordered: Column, at: Column, hashed: Column) -> Column:
    """Index of the first element of `ordered` with the hash of the element at `at`, by halving steps."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(PLACE_BITS))))
    return F.aggregate(steps, at, lambda i, step: F.when((i >= step) & (_hash(F.get(ordered, i - step)) == hashed), i - step).otherwise(i))


def _numbered(ordered: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        occurrence = F.when((i == 0) | (_hash(F.get(ordered, i - 1)) != _hash(x)), F.lit(0)).otherwise(i - _first_of_run(ordered, i, _hash(x)))
        return _pack(F.xxhash64(_hash(x), occurrence), _place(x))

    return F.transform(ordered, one)


def _tuples(least: Column) -> Column:
    """cell << 32 | hash of the tuple, for each cell; `least` has one or two k-mers of a cell side by side."""

    def one(x: Column, i: Column) -> Column:
        other = F.get(least, i + 1)
        both = F.when(_place(x) <= _place(other), F.xxhash64(_hash(x), _hash(other))).otherwise(F.xxhash64(_hash(other), _hash(x)))
        hashed = F.when(_cell(other) == _cell(x), both).otherwise(F.xxhash64(_hash(x)))
        opens = (i == 0) | (_cell(F.get(least, i - 1)) != _cell(x))
        return F.when(opens, F.shiftleft(_cell(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1))))

    return F.filter(F.transform(least, one), lambda x: x.isNotNull())


def _pair(a: Column, b: Column) -> Column:
    """Hash of two k-mers in text order, of the first alone if the second is null."""
    alone, ahead = F.xxhash64(_hash(a)), F.xxhash64(_hash(a), _hash(b))
    return F.when(b.isNull(), alone).when(_place(a) <= _place(b), ahead).otherwise(F.xxhash64(_hash(b), _hash(a)))


def _filled(least: Column, ordered: Column) -> Column:
    """The tuples of all cells; those that were dealt less than DEPTH of the `ordered` k-mers take the rest from all of them."""
    every = F.sequence(F.lit(0).cast("long"), F.lit((1 << CELL_BITS) - 1).cast("long"))

    def chosen(own: Column, ranks: Column) -> Column:
        kmer = lambda rank: F.get(ordered, (F.array_position(ranks, rank) - 1).cast("int"))
        second = lambda first: kmer(F.array_min(F.array_remove(ranks, first)))
        two = lambda first: let(F.array(kmer(first), second(first)), lambda x: _pair(F.coalesce(own, x[0]), F.when(own.isNull() | (own == x[0]), x[1]).otherwise(x[0])))
        return let(F.array_min(ranks), two)

    def fill(cells: Column, hashes: Column, cell: Column) -> Column:
        own = F.get(least, (F.array_position(cells, cell) - 1).cast("int"))
        hashed = let(own, lambda own: let(F.transform(hashes, lambda h: F.xxhash64(h, cell)), lambda ranks: chosen(own, ranks)))
        return F.shiftleft(cell, 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))

    def tuples(cells: Column, missing: Column) -> Column:
        dealt = F.filter(_tuples(least), lambda x: ~F.array_contains(missing, F.shiftright(x, 32)))
        more = let(F.transform(ordered, _hash), lambda hashes: F.transform(missing, lambda c: fill(cells, hashes, c)))
        return F.when(F.size(missing) == 0, _tuples(least)).otherwise(F.sort_array(F.concat(dealt, more)))

    full = lambda cells: F.filter(cells, lambda c, i: (i > 0) & (F.get(cells, i - 1) == c))
    found = let(F.transform(least, _cell), lambda cells: let(F.array_except(every, full(cells)), lambda missing: tuples(cells, missing)))
    return F.when(F.size(least) > 0, found).otherwise(F.array().cast("array<bigint>"))


def _sorted(text: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the numbered k-mers of a text, ordered by hash and so by cell."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def packed(kmers: Column) -> Column:
        spread = F.greatest(F.lit(0), F.ceil(F.log2(F.size(kmers) + 1)) - PLACE_BITS).cast("int")
        return F.transform(kmers, lambda h, i: _pack(h, F.call_function("shiftright", i.cast("long"), spread)))

    return let(words, lambda w: let(_kmers(w), lambda k: let(F.sort_array(packed(k)), lambda s: let(F.sort_array(_numbered(s)), body))))


def _least(ordered: Column) -> Column:
    return F.filter(ordered, lambda x, i: (i < DEPTH) | (_cell(F.get(ordered, i - DEPTH)) != _cell(x)))


def signature(text: Column) -> Column:
    """The tuples of the k-mers dealt to each cell alone, a number for each cell that was dealt one, as array<bigint>."""
    return _sorted(text, lambda t: let(_least(t), _tuples))


def full_signature(text: Column) -> Column:
    """The signature as array<bigint>, a number for each cell; null is the empty text, without any."""
    return _sorted(text, lambda t: let(_least(t), lambda least: _filled(least, t)))


def as_string(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the cells of either signature in which both agree; 1 if both are empty."""
    cells = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    of = F.size(F.array_union(cells(a), cells(b)))
    return F.when(of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / of)


def with_edits(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signatures of every text and of its edit, whose last half (rounded down) is the beginning of the next text.

    (id, n_chars, edited, signature, edited_signature, next_signature) for every row. The next text is that of the next
    larger id, after the largest that of the smallest; where rows share an id it is the smallest text of that id, and all
    of them have the same next text. Rows without an id come first, together. A null text is empty. An empty table gives an
    empty one; other columns are not read.
    """
    rows = docs.select(order_key(docs[id_col]).alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sizes = scratch.save(rows.select("key", F.length("text").alias("n")).groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("rows")), "sizes")
    texts = rows
    if sizes.where("rows > 1").head(1):
        texts = rows.groupBy("key").agg(F.min("text").alias("text"))
    chain = successors(sizes, scratch, "chain")
    wanted = chain.join(sizes, "key").select(F.col("key").alias("for_key"), F.col("next_key").alias("key"), F.expr("n div 2").cast("int").alias("half"))
    signed = scratch.save(texts.select("key", full_signature(F.col("text")).alias("signature")), "signatures")
    heads = texts.join(wanted, "key").join(signed, "key").select(F.col("for_key").alias("key"), F.expr("substring(text, 1, half)").alias("head"), F.col("signature").alias("next_signature"))
    own = rows.join(signed, "key") if texts is rows else rows.withColumn("signature", full_signature(F.col("text")))
    joined = own.join(heads, "key").withColumn("n_chars", F.length("text")).withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(head, 1, n_chars div 2))"))
    return joined.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("id"), F.col("n_chars").cast("long").alias("n_chars"), "edited", "signature", full_signature(F.col("edited")).alias("edited_signature"), "next_signature")
