"""Operator 3: token files of frequency-ranked ids in byte-aligned variable-length coding.

The most frequent id has rank 0. A rank takes 1 to 4 bytes; the lengths, two bits each,
stand apart from the data in control bytes, four to a byte. A file is a Parquet file
with a row per block of documents (so any store that Spark writes to can hold it):
part and first (where the block stands), doc_ids, n_tokens, control, data. The list of
ids by rank stands beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import discard, save, table
from codequarry.llm.tokens import tokenize

#: Tokens of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 17
#: Words that a worker keeps, twice; nothing else is held beside them here.
STEMS = 400_000
TOKENIZER = "word_bpe_49k.json"
#: Bytes of each of the four values of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    ranks = ranks.astype("<u4")
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros((n + 3) // 4 * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(n, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = size > k
        if not more.any():
            break
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for b in batches:
        raw = b"".join(b.column("ids").to_pylist())
        counts += np.bincount(np.frombuffer(raw, "<u2"), minlength=1 << 16)
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])


def ids_by_rank(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first. There are no more of them than the vocabulary has."""
    rows = tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _blocks(by_rank: np.ndarray):
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, part, first, size = [], [], None, 0, 0

        def block():
            control, data = pack_ranks(rank_of[np.frombuffer(b"".join(held), "<u2")])
            row = [[part], [first], [[d for d, _ in docs]], [[n for _, n in docs]], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "first", "doc_ids", "n_tokens", "control", "data"])

        for b in batches:
            for p, at, d, n, ids in zip(*[b.column(c).to_pylist() for c in ("part", "first", "doc_id", "n_tokens", "ids")], strict=True):
                # A task may read several parts, or only the end of one.
                if held and (p != part or at != first + size or size + n > BLOCK_TOKENS):
                    yield block()
                    held, docs, size = [], [], 0
                if not held:
                    part, first = p, at
                size += n
                held.append(ids)
                docs.append((d, n))
        if held:
            yield block()

    return run


def write_token_file(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, np.ndarray]:
    """Tokenize ``docs``, write them in ascending order of doc_id (null first, then by text hash), and
    return the file as written, with the ids by rank. An empty table gives an empty file.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("__q_h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__q_h"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = save(tokenize(ordered, tokenizer, STEMS).withColumn("part", F.spark_partition_id()), "tokens")
    by_rank = ids_by_rank(tokens)
    file = save(tokens.select("part", "first", "doc_id", "n_tokens", "ids").mapInArrow(_blocks(by_rank), "part int, first long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"), "token-file")
    discard(tokens)
    return file, by_rank


def read_token_file(file: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (32-bit) of each document in the file."""
    parts = file.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the file
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).cast("long").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                ids = by_rank[unpack_ranks(row["control"], row["data"], int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                raw = ids.tobytes()
                out = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + row["first"] + ends - n), pa.array(n), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return file.join(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.drop_columns(["ids"]).append_column("ids_crc32", pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64()))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, by_rank = write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return read_token_file(file, by_rank).mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op3_token_output": op3_token_output}
