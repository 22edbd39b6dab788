"""Operator 6: packing documents into sequences by minimum bin slack.

Documents longer than the capacity give whole sequences; what is left of each is a piece
of less than the capacity. Pieces are packed by their lengths alone: of the histogram of
lengths, which has fewer entries than the capacity, the driver takes the longest length
left, and a bitset subset-sum over the others finds the multiset that fills the sequence
closest to its capacity. Where that leaves more than MAX_SLACK, every piece left is longer than the gap, and the
longest is cut to close it; its rest is a piece like any other. The same multiset is used as often as the
histogram allows, so the plan is short at any number of documents. Pieces are numbered within their
length, and the plan maps a number to a sequence and an offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import root_buckets, running_start, save, table
from codequarry.llm.token_files import TOKENIZER
from codequarry.llm.tokens import tokenize

CAPACITY = 4096
#: Tokens of a sequence that may stay unfilled; a larger gap is closed by a cut.
MAX_SLACK = 4


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, at most counts[..] of each) whose sum is nearest to
    ``room`` from below, by a bitset of reachable sums; it stops once ``room`` is reached."""
    bits, full, mask, items = 1, 1 << room, (1 << (room + 1)) - 1, []
    for x in lengths:
        if x > room:
            continue
        left, k = min(counts[x], room // x), 1
        while left > 0:
            k = min(k, left)
            items.append((bits, x, k))
            bits |= (bits << (k * x)) & mask
            left, k = left - k, 2 * k
        if bits & full:
            break
    at, used = bits.bit_length() - 1, {}
    for before, x, k in reversed(items):
        if not before >> at & 1:
            used[x] = used.get(x, 0) + k
            at -= k * x
    return used


@dataclass
class Pattern:
    """How some sequences are filled alike: pieces by length, a length of which one more piece is cut to ``gap`` tokens (0: none), and how many sequences."""

    pieces: dict[int, int]
    cut: int
    gap: int
    times: int


def slack_patterns(histogram: dict[int, int], capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns while a whole sequence is left, and the pieces that are left then, by length. All lengths are below ``capacity``."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    total, patterns = sum(x * n for x, n in counts.items()), []
    while total >= capacity:
        lengths = sorted((x for x in counts if counts[x]), reverse=True)
        seed, cut = lengths[0], 0
        counts[seed] -= 1
        used = best_fill(counts, [x for x in lengths if counts[x]], capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        gap = capacity - sum(x * k for x, k in used.items())
        if gap > max_slack:
            cut = next(x for x in lengths if counts[x] > used.get(x, 0))
        else:
            gap = 0
        need = used | ({cut: used.get(cut, 0) + 1} if cut else {})
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
        if cut:
            counts[cut - gap] = counts.get(cut - gap, 0) + times
        total -= times * (sum(x * k for x, k in used.items()) + gap)
        patterns.append(Pattern(used, cut, gap, times))
    return patterns, {x: n for x, n in counts.items() if n}


@dataclass
class Plan:
    """Where the k-th piece of a length goes. by_length, a column for each pattern that takes some: pieces used before it, how many a sequence
    takes, its first sequence, the offset there, tokens taken of each, and the number of the first rest (within its own length)."""

    capacity: int
    by_length: dict[int, tuple[np.ndarray, ...]]
    used: dict[int, int]
    tail_start: dict[int, int]
    tail_sequence: int
    tail_cuts: np.ndarray

    def places(self, length: int, k: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the parts of the k-th piece of ``length``."""
        out = []
        while length and k < self.used.get(length, 0):
            before, each, first, at, take, rest = self.by_length[length]
            j = int(np.searchsorted(before, k, "right")) - 1
            turn, slot = divmod(k - int(before[j]), int(each[j]))
            part = int(take[j])
            out.append((int(first[j]) + turn, int(at[j]) + slot * length, part))
            length, k = length - part, int(rest[j]) + turn
        if not length:
            return out
        begin = self.tail_start[length] + (k - self.used.get(length, 0)) * length
        end = begin + length
        while begin < end:  # less than a sequence is left over: powers of two
            j = int(np.searchsorted(self.tail_cuts, begin, "right")) - 1
            stop = min(end, int(self.tail_cuts[j + 1]))
            out.append((self.tail_sequence + j, begin - int(self.tail_cuts[j]), stop - begin))
            begin = stop
        return out


def make_plan(histogram: dict[int, int], first_sequence: int, capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> Plan:
    """Pieces left over, less than a sequence of them, are laid end to end and cut into powers of two, which take no padding."""
    patterns, left = slack_patterns(histogram, capacity, max_slack)
    rows, used, made, sequence = {}, {}, dict(histogram), first_sequence

    def take(x: int, each: int, at: int, tokens: int, times: int) -> None:
        rest = made.get(x - tokens, 0)  # rests are numbered after the pieces that are there already
        rows.setdefault(x, []).append((used.get(x, 0), each, sequence, at, tokens, rest))
        used[x] = used.get(x, 0) + each * times
        if tokens < x:
            made[x - tokens] = rest + times

    for p in patterns:
        at = 0
        for x, k in sorted(p.pieces.items(), reverse=True):
            take(x, k, at, x, p.times)
            at += k * x
        if p.cut:
            take(p.cut, 1, at, p.gap, p.times)
        sequence += p.times
    starts, total = {}, 0
    for x, n in sorted(left.items(), reverse=True):
        starts[x], total = total, total + x * n
    cuts = [0]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return Plan(capacity, {x: tuple(np.array(c) for c in zip(*r, strict=True)) for x, r in rows.items()}, used, starts, sequence, np.array(cuts))


def pack(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (16-bit).

    ``tokens`` is a saved table with doc_id, text_hash, n_tokens (1 or more), ids. Rows alike in
    doc_id and text are packed one by one like any others. An empty table gives no piece.
    """
    tokens = save(tokens.drop("first").withColumn("row", F.monotonically_increasing_id()), "packed-tokens")
    light = tokens.select("row", "doc_id", "text_hash", F.floor(F.col("n_tokens") / capacity).alias("whole"), (F.col("n_tokens") % capacity).alias("rest"), F.lit(1).cast("long").alias("one"))
    histogram = {r["rest"]: r["n"] for r in light.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    n, whole = sum(histogram.values()), int(light.agg(F.sum("whole")).first()[0] or 0)
    histogram.pop(0, None)
    plan, buckets, order = make_plan(histogram, whole, capacity), root_buckets(n), ["doc_id", "text_hash"]
    # Both numberings run over hashed buckets, so no length and no row count meets in one task.
    placed = running_start(light, [], order, "whole", buckets, "first")
    placed = running_start(placed, ["rest"], order, "one", buckets, "k").select("row", "first", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for b in batches:
            out = []
            for doc, n, ids, first, k in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "first", "k")], strict=True):
                at = n // capacity * capacity
                places = [(first + i, 0, capacity) for i in range(n // capacity)] + (plan.places(n - at, k) if n > at else [])
                at = 0
                for sequence, offset, length in places:
                    out.append((doc, at, length, n, sequence, offset, ids[2 * at : 2 * (at + length)]))
                    at += length
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return tokens.join(placed, "row").select("doc_id", "n_tokens", "ids", "first", "k").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def crc16(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
        yield b.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenize(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer), capacity)


def packing_digests(docs: DataFrame) -> DataFrame:
    out = pack_documents(docs, public_tokenizers.path(TOKENIZER)).mapInArrow(
        crc16, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    )
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
