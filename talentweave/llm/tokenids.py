"""Token ids in binary blocks with Elias-Fano encoded document boundaries.

The format is a table of blocks (Parquet carries the bytes, so any store that Spark writes works and a lost task is simply
run again). A block holds consecutive documents in id order:

    shard, block      place of the block; shards and the blocks in them are in document order
    first             ids in the shard before the block
    n_docs, n_ids     size of the block
    low_bits, low, high   ends of the documents in the id array, Elias-Fano: `low` has the low bits of each end packed
                      together, `high` has, for the end number k, a one at bit (end >> low_bits) + k
    width, ids        bytes of an id (2 or 4, little endian) and the concatenated ids
    doc_ids           64-bit little-endian document ids
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import NO_ID
from .scratch import Scratch
from .textbatch import blocks, utf8

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Ids of a block at most, but for a longer document.
BLOCK_IDS = 1 << 20
#: Rows of one id that go to one shard at most.
SAME_ID = 10_000
_WORDS = 500_000
_TEXT = 1 << 20

BLOCK_SCHEMA = "shard int, block int, first bigint, n_docs bigint, n_ids bigint, low_bits int, low binary, high binary, width int, ids binary, doc_ids binary"


class EliasFano:
    """A non-decreasing sequence of n values in about n * (2 + log2(last / n)) bits."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
        """(low_bits, low, high)."""
        n = len(values)
        if not n:
            return 0, b"", b""
        values = values.astype(np.int64)
        bits = max(0, int(values[-1]) // n).bit_length() - 1 if int(values[-1]) > n else 0
        low = (values[:, None] >> np.arange(bits)) & 1
        high = np.zeros((int(values[-1]) >> bits) + n, np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        return bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, every: int = 64) -> None:
        self.n, self.bits, self.every = n, low_bits, every
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        #: The byte of `high` that has each `every`-th one, and the ones before that byte.
        self.at = np.searchsorted(ones, np.arange(1, n + 1, every))
        self.before = ones[self.at] - np.bitwise_count(self.high[self.at]) if n else ones[:0]

    def select(self, k: int) -> int:
        """The value number k."""
        byte, seen = int(self.at[k // self.every]), int(self.before[k // self.every])
        while seen + (ones := int(self.high[byte]).bit_count()) <= k:
            seen += ones
            byte += 1
        value = int(self.high[byte])
        for _ in range(k - seen):
            value &= value - 1
        place = byte * 8 + (value & -value).bit_length() - 1
        return (place - k) << self.bits | self._low(k)

    def _low(self, k: int) -> int:
        first = k * self.bits
        word = int.from_bytes(self.low[first >> 3 : (first + self.bits + 7) >> 3].tobytes(), "little")
        return word >> (first & 7) & ((1 << self.bits) - 1)


@cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the other bytes as code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: What the encoder relies on, as the vocabulary's file states it: fixed values.
_RULES = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizers": ["Split", "ByteLevel"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "model": ("BPE", "</w>"),
}


def _check_rules(tokenizer) -> None:
    """Refuses a vocabulary whose words can't be put together as `WordEncoder` does."""
    import json

    file = json.loads(tokenizer.to_str())
    steps = lambda part, name: [x["type"] for x in (part or {}).get(name, [])]
    found = {
        "normalizers": steps(file["normalizer"], "normalizers"),
        "pre_tokenizers": steps(file["pre_tokenizer"], "pretokenizers"),
        "split": ((file["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex"),
        "model": (file["model"]["type"], file["model"].get("end_of_word_suffix")),
    }
    if found != _RULES:
        raise ValueError(f"the vocabulary has other rules: {found}")


class _Pieces(dict):
    """Ids of pieces, learned when first asked for. A full table becomes the older one, which frequent pieces come back from."""

    def __init__(self, encoder: WordEncoder) -> None:
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encoder.piece(piece)
        if len(self) > _WORDS:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


def _of(category: str) -> str:
    """The characters below U+0130 of a general category, for a character class."""
    return "".join(c for c in map(chr, range(0x130)) if unicodedata.category(c).startswith(category))


class WordEncoder:
    """Ids of whole texts, put together from the ids of their pieces between ASCII white space.

    This tokenizer drops white space and none of its rules looks across it, so the ids of a text are the ids of its pieces
    one after the other; pieces repeat, so each is encoded once for as long as it stays in a cache of bounded size. Pieces
    of visible characters below U+0130, which its normalisation only lower-cases, are cut into words by its own pattern;
    all others, and those that may hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        _check_rules(self.tokenizer)
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.simple = re.compile("[!-~¡-į]+").fullmatch
        self.words = re.compile(_RULES["split"].replace(r"\p{L}", _of("L")).replace(r"\p{N}", _of("N"))).findall
        self.letters = _byte_letters()
        self.known = _Pieces(self)
        self.of_word: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word as the pattern cuts it, in lower case."""
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) > _WORDS:
                self.of_word.clear()
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.of_word[word] = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(shown)])
        return found

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece."""
        if piece.isalpha():  # of ASCII
            return self._word(piece.lower().decode())
        text = piece.decode()
        if self.simple(text) and "<|" not in text:
            return b"".join(map(self._word, self.words(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        get = self.known.__getitem__
        return [b"".join(map(get, x.split())) for x in texts]


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _block(shard: int, block: int, first: int, keys: list[np.ndarray], counts: list[np.ndarray], ids: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum(np.concatenate(counts))
    bits, low, high = EliasFano.encode(ends)
    words = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(words) or words.max() < 1 << 16 else 4
    row = [shard, block, first, len(ends), len(words), bits, low, high, width, words.astype(f"<u{width}").tobytes(), np.concatenate(keys).astype("<i8").tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def encode_blocks(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all rows in ascending id order: shards are ranges of ids, so the texts are shuffled once.

    A null text is empty, so only the end id is written; rows without an id come first, under the id of the smallest
    64-bit integer; rows of the same id follow each other by a hash of their texts, so one id may fill many shards; an
    empty table has no blocks; other columns are not read.
    """
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("id"), docs[text_col].alias("text"))
    ranges, order = ["id"], ["id", F.xxhash64("text"), "text"]
    if rows.groupBy("id").count().where(F.col("count") > SAME_ID).head(1):  # ids alone; ranges by text need another scan of it
        ranges = order[:2]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number, first, held = 0, 0, 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[bytes] = []
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, _TEXT):
                texts = [data[offsets[d] : offsets[d + 1]].tobytes() for d in range(i, j)]
                found = [x + end for x in encoder.encode(texts)]
                n = np.fromiter(map(len, found), np.int64, len(found)) // 4
                keys.append(key[i:j]), counts.append(n), ids.extend(found)
                held += int(n.sum())
                if held >= block_ids:
                    yield _block(shard, number, first, keys, counts, ids)
                    number, first, held = number + 1, first + held, 0
                    keys, counts, ids = [], [], []
        if keys:
            yield _block(shard, number, first, keys, counts, ids)

    return ordered.mapInArrow(run, BLOCK_SCHEMA)


def read_blocks(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in stored blocks, read from their bytes; rows that had no id
    have none again."""
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard, so as many as shuffle partitions
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, first, n, bits, low, high, width, ids, keys = (batch.column(k)[row].as_py() for k in range(9))
                ends = EliasFano(n, bits, low, high)
                words = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                starts, sizes, sums, start = [], [], [], 0
                for k in range(n):
                    end = ends.select(k)
                    starts.append(base + first + start)
                    sizes.append(end - start)
                    sums.append(zlib.crc32(words[4 * start : 4 * end]))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = ["before", "first", "n_docs", "low_bits", "low", "high", "width", "ids", "doc_ids"]
    found = stored.join(F.broadcast(before), "shard").select(columns).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def write_and_read(docs: DataFrame, scratch: Scratch, vocabulary: str) -> DataFrame:
    """Writes the blocks of all documents to the shared folder and returns what `read_blocks` finds there. A file that
    doesn't hold as many documents as there are is an error."""
    stored = scratch.save(encode_blocks(docs, vocabulary), "token_blocks")
    written, there = stored.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0], docs.count()
    if written != there:
        raise RuntimeError(f"{written} of {there} documents were written")
    return read_blocks(stored)


def ids_of(path: str, text: str | None) -> list[int]:
    """The tokenizer's own ids of a whole text, for comparison."""
    return _tokenizer(path).encode(text or "", add_special_tokens=False).ids
