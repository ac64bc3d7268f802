"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are joined at proven boundaries.

The vocabulary is a byte-pair one whose merges are tried by score, then from the left. Such an encoding is the one sequence
of pieces of which every two neighbours, encoded alone, stay apart: as long as no merge has crossed a border, merges left
and right of it come in the order in which the two pieces alone would make them, so the first merge that crosses it would
cross it there too. Two encodings of overlapping chunks may therefore be joined at any piece that both have at the same
place: all neighbours before it are neighbours in the first encoding and all after it in the second.

Chunks of a document are rows: they are cut in the JVM, dealt by (text, chunk) so that one document fills many tasks, encoded
where they land, and joined with SQL functions; only the pieces of the overlaps leave the task of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbatch import text_blocks

VOCABULARY = "piece_bpe_32k.model"
#: Code points above which a document is cut, of a chunk, and of the overlap of two chunks at first.
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 512
#: How much wider chunks and overlaps are for documents of which two chunks had no piece in common.
WIDER = 8
_BLOCK = 1 << 20

SUMMARY = "digest string, chunk int, n bigint, head array<string>, head_index array<int>, tail array<string>, tail_index array<int>"


class PieceEncoder:
    """A vocabulary with the length of each piece in code points: of a character that is written in bytes, the first has 1
    and the others 0. Vocabularies for which the proof above doesn't hold are refused."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = pb.ModelProto.SentencePiece.Type
        normal, trainer = model.normalizer_spec, model.trainer_spec
        plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
        if trainer.model_type != pb.TrainerSpec.ModelType.BPE or not plain or {p.type for p in model.pieces} & {kinds.USER_DEFINED, kinds.UNUSED}:
            raise ValueError("chunks can only be joined for byte-pair vocabularies without normalisation and without pieces of the user")
        self.prefix = int(normal.add_dummy_prefix)
        self.processor = SentencePieceProcessor(model_file=path)
        later = [p.type == kinds.BYTE and 0x80 <= int(p.piece[1:-1], 16) < 0xC0 for p in model.pieces]
        self.lengths = np.array([0 if x else 1 if p.type == kinds.BYTE else len(p.piece) for p, x in zip(model.pieces, later, strict=True)])
        self.lengths[[k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN]] = 1

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def places(self, ids: list[int]) -> np.ndarray:
        """Where each piece of a text begins, in code points; the space that is put before a text is at -1."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])]) - self.prefix


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _counts(path: str):
    """Token counts of texts that aren't cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(x) for _, texts in text_blocks(batch.column(2).to_pylist(), _BLOCK) for x in encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _summaries(path: str, chunk: int, overlap: int):
    """For each chunk its pieces' number, and place and id of the pieces that begin in the overlaps at its ends with their
    numbers in the chunk. Places count from the begin of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            digests, numbers, texts = (batch.column(k).to_pylist() for k in range(3))
            for digest, number, text in zip(digests, numbers, texts, strict=True):
                ids = model.encode([text])[0]
                places = model.places(ids)
                if places[-1] != len(text):
                    raise ValueError(f"pieces of chunk {number} of text {digest} don't spell it")
                whole = model.lengths[ids] > 0
                head = np.flatnonzero(whole & (places[:-1] < overlap))
                tail = np.flatnonzero(whole & (places[:-1] >= chunk))
                named = [[f"{number * chunk + places[k]}:{ids[k]}" for k in some.tolist()] for some in (head, tail)]
                row = [digest, number, len(ids), named[0], head.tolist(), named[1], tail.tolist()]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])

    return run


def chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(digest, chunk, part): pieces of `chunk` code points, each with the `overlap` first ones of the next, once for
    equal texts. Cutting is linear in the text."""
    blocks = texts.select("digest", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("blocks"))
    parts = F.transform("blocks", lambda x, k: F.concat(x, F.coalesce(F.substring(F.get("blocks", k + 1), 1, overlap), F.lit(""))))
    return blocks.select("digest", F.posexplode(parts).alias("chunk", "part")).groupBy("digest", "chunk").agg(F.first("part").alias("part"))


def spliced(summaries: DataFrame) -> DataFrame:
    """(digest, n_tokens) of the texts whose chunks are joined; null where two chunks have no piece in common.

    With the first common piece at number i of a chunk and j of the next, the next one's j pieces before it and the first
    one's pieces from i on are taken off the sum of both.
    """
    after = summaries.select("digest", (F.col("chunk") - 1).alias("chunk"), "head", "head_index", F.lit(True).alias("follows"))
    pairs = summaries.select("digest", "chunk", "n", "tail", "tail_index").join(after, ["digest", "chunk"], "left")
    common = F.get(F.array_intersect("tail", "head"), F.lit(0))
    number = lambda names, index: F.get(index, F.array_position(names, F.col("common")).cast("int") - 1)
    pairs = pairs.withColumn("common", common).withColumns({"i": number("tail", "tail_index"), "j": number("head", "head_index")})
    own = F.when(F.col("follows").isNull(), F.col("n")).otherwise(F.col("i") - F.col("j"))
    rows = pairs.select("digest", own.alias("own"))
    return rows.groupBy("digest").agg(F.when(F.count_if(F.col("own").isNull()) == 0, F.sum("own")).alias("n_tokens"))


def count_tokens(docs: DataFrame, scratch: Scratch, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes and the vocabulary's tokens of the whole text.

    Null and empty texts have 0 of both; rows that repeat an id are counted each on its own; rows without an id are counted
    too; an empty table gives no rows; other columns aren't read. Texts of more than `huge` code points are cut in chunks.
    Where two chunks have no common piece (a long run of one character, say), the text is cut anew in chunks and overlaps
    `WIDER` times as long, until one chunk holds it whole; a task holds one chunk and its ids at a time. `overlap` must
    not be longer than `chunk`.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must have from 1 code point to those of a chunk")
    rows = docs.select(docs[id_col].alias("id"), F.octet_length(docs[text_col]).cast("long").alias("n_bytes"), docs[text_col].alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0).cast("long")))
    is_huge = F.coalesce(F.char_length("text") > huge, F.lit(False))
    key = docs.schema[id_col].dataType.simpleString()
    small = rows.where(~is_huge).mapInArrow(_counts(vocabulary), f"id {key}, n_bytes bigint, n_tokens bigint")
    texts = rows.where(is_huge).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    parts, left, k = [], texts, 0
    while left is not None:
        found = chunks(left, chunk, overlap).select("digest", "chunk", "part").mapInArrow(_summaries(vocabulary, chunk, overlap), SUMMARY)
        found = scratch.save(found, f"summaries_{k}")
        done = scratch.save(spliced(found), f"counts_{k}")
        scratch.drop(f"summaries_{k}")
        parts.append(done.where("n_tokens is not null"))
        open_ = done.where("n_tokens is null").select("digest")
        left = texts.join(open_, "digest", "left_semi") if open_.head(1) else None
        chunk, overlap, k = chunk * WIDER, overlap * WIDER, k + 1
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return small.unionByName(texts.select("id", "n_bytes", "digest").join(counts, "digest").select("id", "n_bytes", "n_tokens"))
