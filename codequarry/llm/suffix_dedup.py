"""Operator 4: removal of every byte in a 200-byte string that also starts elsewhere.

Prefix-free parsing, dealt out. A rolling hash over GRAM bytes sets triggers: a window of 200 bytes
has as its trigger the place, of its first SPAN, with the least hash (the first of equals), so
equal windows have equal triggers at equal places. From its trigger on, a window holds at least
PHRASE bytes: the phrase. The dictionary is the set of phrases, the parse the list of triggers.
Windows with one trigger start at neighbouring places, so a trigger is one row: the phrase's
name, and that of its context, which is all bytes that its windows cover.

1. Rows meet by phrase. Of a phrase that occurs once, all windows are unique. Of a context that
   occurs twice or more, all are repeats. What is open: a phrase that stands in several contexts.
2. Open rows are dealt out by chunks of CHUNK starts, under the name of the bytes that all windows
   of the chunk share. Within such a name, the bytes before it put the rows into one order
   (the dictionary's suffixes), the bytes behind it into another (the suffixes of the
   parse). Neighbours' common lengths in both orders give, for each start, the classes of equal
   bytes before and behind; rows in one class of either are equal windows.

So the corpus order of suffixes is only made where it decides something, and in groups that share
almost 200 bytes, never for the whole corpus. Steps 1 and 2 compare names of 128 bits; the
bytes that step 2 sorts are compared as they are.

A phrase can stand in very many contexts: a licence's first line, between different texts each time. Its bucket is
dealt out by context; what concerns the phrase as a whole is counted by Spark, and if its rows are too many
for one order, its windows are named one by one and counted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import discard, save, table, text_or_empty
from codequarry.llm.exact_dedup import NO_ID
from codequarry.llm.word_hashes import mix64

WINDOW, GRAM, SPAN, CHUNK = 200, 8, 128, 16
#: Bytes from the trigger on that all windows of a trigger hold.
PHRASE = WINDOW - SPAN + 1
#: Triggers looked at together; rows held before they are dealt; rows of a task, about; bytes of texts taken at once.
TOGETHER, HELD, TASK_ROWS, AT_ONCE = 1 << 13, 1 << 19, 1 << 18, 1 << 22
#: Rows of a bucket that go to one task; a bucket of more is dealt out by context, and a phrase with more contexts window by window.
MOST_ROWS = 1 << 20
_WORDS = (SPAN - 1 + WINDOW + 7) // 8
_rng = np.random.default_rng(4)
#: Random odd multipliers and values of two hashes over words of eight bytes.
_M, _X = _rng.integers(0, 2**63, (2, _WORDS), np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**64, (2, _WORDS), np.uint64)
_ROW = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("t", "<u4"), ("most", "u1"), ("least", "u1"), ("known", "u1")])
_PART = np.dtype([("key", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("t", "<u4"), ("chunk", "u1"), ("low", "u1"), ("high", "u1"), ("need", "u1"), ("left", "u1", (CHUNK,)), ("right", "u1", (CHUNK,))])
_SPANS = "doc long, h long, spans binary"


def _hash(rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each row of a byte matrix."""
    width = rows.shape[1]
    padded = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    x = padded.view("<u8") ^ _X[k, : padded.shape[1] // 8]
    x ^= x >> np.uint64(32)
    return mix64((x * _M[k, : x.shape[1]]).sum(1, dtype=np.uint64) + np.uint64(width))


def triggers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first start, last start) of each run of windows of a text with one trigger."""
    n = len(raw)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    grams = np.ndarray((n - GRAM + 1,), "<u8", raw.tobytes(), strides=(1,))
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # The place below the hash: of equal hashes, the first is the least.
    h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([h, np.full(-len(h) % SPAN, np.uint64(2**64 - 1))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - WINDOW
    t = (np.minimum(back[: last + 1], ahead[SPAN - 1 : SPAN + last]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1])
    return t[first], first, np.append(first[1:] - 1, last)


def _around(raw: np.ndarray, t: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A row of bytes for each trigger, SPAN - 1 before it and WINDOW from it on, zero outside [first, stop)."""
    at = t[:, None] + np.arange(1 - SPAN, WINDOW)
    return np.where((at >= first[:, None]) & (at < stop[:, None]), raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)


def _rows_of(doc: int, h: int, text: bytes) -> Iterator[np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    t, first, last = triggers(raw)
    for begin in range(0, len(t), TOGETHER):
        at, a, b = t[begin : begin + TOGETHER], first[begin : begin + TOGETHER], last[begin : begin + TOGETHER]
        seen = _around(raw, at, a, b + WINDOW)
        rows = np.empty(len(at), _ROW)
        rows["key"] = _hash(seen[:, SPAN - 1 : SPAN - 1 + PHRASE], 0)
        rows["most"], rows["least"], rows["known"] = at - a, at - b, 0
        rows["ctx"] = mix64(_hash(seen, 1) + (rows["most"].astype(np.uint64) * np.uint64(256) + rows["least"]) * np.uint64(0x9E3779B97F4A7C15))
        rows["doc"], rows["h"], rows["t"] = doc, h, at
        yield rows


def _texts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows of batches, a few at a time, so that texts are not all copied at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            yield from zip(*[part.column(c).to_pylist() for c in names], strict=True)


def _by_bucket(rows: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    bucket = (mix64(rows["key"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]])[: None if len(rows) else 1]
    raw, size = rows.tobytes(), rows.dtype.itemsize
    return bucket[edges[:-1]].tolist(), [raw[a * size : b * size] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _spans(doc: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list, list, list]:
    """Runs of starts by text: doc, h, and (first, last) of all its runs, packed."""
    order = np.lexsort((doc, h))
    doc, h, pairs = doc[order], h[order], np.stack([first[order], last[order]], 1).astype("<u4")
    edges = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(h) != 0)) + 1, [len(doc)]])[: None if len(doc) else 1]
    raw = pairs.tobytes()
    return doc[edges[:-1]].tolist(), h[edges[:-1]].tolist(), [raw[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _runs(rows: np.ndarray) -> tuple[list, list, list]:
    return _spans(rows["doc"], rows["h"], rows["t"].astype(np.int64) - rows["most"], rows["t"].astype(np.int64) - rows["least"])


def _groups(rows: np.ndarray, fields: tuple[str, ...]) -> np.ndarray:
    """The number of the group, of rows sorted by ``fields``, that each row is in."""
    new = np.zeros(len(rows), bool)
    for f in fields:
        new[1:] |= rows[f][1:] != rows[f][:-1]
    return np.cumsum(new)


def _parse(buckets: int):
    """Rows of triggers, dealt out (bucket, rows); contexts seen twice in one task are repeats at once
    (doc, h, spans), and only one of them goes on, marked as known."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["ctx"], rows["key"]))]
        group = _groups(rows, ("key", "ctx"))
        twice = np.bincount(group)[group] > 1
        doc, h, spans = _runs(rows[twice])
        rows["known"] = twice
        bucket, packed = _by_bucket(rows[np.concatenate([[True], np.diff(group) != 0])], buckets)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        sizes = [len(x) // _ROW.itemsize for x in packed]
        cols = [bucket + [None] * len(doc), packed + [None] * len(doc), sizes + [None] * len(doc), [None] * len(bucket) + doc, [None] * len(bucket) + h, [None] * len(bucket) + spans]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "rows", "n", "doc", "h", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0
        for doc, h, text in _texts(batches, ["doc", "h", "bytes"]):
            if len(text) < WINDOW or (h, len(text)) in seen:  # copies of whole texts are found elsewhere
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add((h, len(text)))
            for rows in _rows_of(doc, h, text):
                held.append(rows)
                n += len(rows)
                if n >= HELD:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    return run


def _by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with k > 1 in k parts, by context."""
    for b in batches:
        out = []
        for bucket, packed, k in zip(*[b.column(c).to_pylist() for c in ("bucket", "rows", "k")], strict=True):
            if k == 1:
                out.append((bucket, 0, 1, packed))
                continue
            rows = np.frombuffer(packed, _ROW)
            part = (mix64(rows["ctx"] ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(k)).astype(np.int64)
            out.extend((bucket, i, k, rows[part == i].tobytes()) for i in np.unique(part).tolist())
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "part", "k", "rows"])


_MET = "doc long, h long, spans binary, t long, most int, least int, need boolean, key long, maybe boolean"


def _meet(t: pa.Table) -> pa.Table:
    """Of the rows of a bucket: spans of repeated contexts, and open rows, one for each context. Of a part of a bucket, which has only
    some contexts of a phrase, all rows may be open (maybe)."""
    in_part = t.column("k")[0].as_py() > 1
    rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), _ROW)
    rows = rows[np.lexsort((rows["ctx"], rows["key"]))]
    context, phrase = _groups(rows, ("key", "ctx")), _groups(rows, ("key",))
    one_each = np.concatenate([[True], np.diff(context) != 0])
    again = np.bincount(context)[context] > 1
    contexts = np.bincount(phrase[one_each], minlength=phrase[-1] + 1)[phrase]
    doc, h, spans = _runs(rows[again & (rows["known"] == 0)])
    ready = pa.table({"doc": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "spans": pa.array(spans, pa.binary())})
    anyone_known = np.maximum.reduceat(rows["known"], np.flatnonzero(one_each))[context] > 0
    need = ~again & ~anyone_known
    some_need = np.bincount(phrase, need)[phrase] > 0
    pick = one_each if in_part else one_each & (contexts > 1) & some_need
    o = rows[pick]
    still = pa.table({
        "doc": o["doc"].copy(), "h": o["h"].copy(), "t": o["t"].astype(np.int64), "most": o["most"].astype(np.int32), "least": o["least"].astype(np.int32),
        "need": pa.array(need[pick]), "key": o["key"].view(np.int64) if o["key"].flags.c_contiguous else o["key"].copy().view(np.int64),
        "maybe": pa.array(np.full(len(o), in_part)),
    })
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("spans", pa.binary()), ("t", pa.int64()), ("most", pa.int32()), ("least", pa.int32()), ("need", pa.bool_()), ("key", pa.int64()), ("maybe", pa.bool_())])
    return pa.concat_tables([ready, still], promote_options="default").select(schema.names).cast(schema)


def _chunks(buckets: int):
    """Of open rows (asked, with their text): a part for each chunk of starts, under the name of what its windows share."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, packed = _by_bucket(np.concatenate(held), buckets)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for doc, h, text, asked in _texts(batches, ["doc", "h", "bytes", "asked"]):
            raw = np.frombuffer(text, np.uint8)
            every = [np.array([x[k] for x in asked]) for k in ("t", "most", "least", "need", "key")]
            for begin in range(0, len(asked), TOGETHER):
                t, most, least, need, key = (c[begin : begin + TOGETHER] for c in every)
                seen = _around(raw, t, t - most, t - least + WINDOW)
                for chunk in range(int(least.min()) // CHUNK, int(most.max()) // CHUNK + 1):
                    a0, a1 = chunk * CHUNK, chunk * CHUNK + CHUNK - 1
                    on = np.flatnonzero((most >= a0) & (least <= a1))
                    if not len(on):
                        continue
                    mine, parts = seen[on], np.empty(len(on), _PART)
                    # Bytes from a0 before the trigger up to WINDOW - a1 behind it are in each window of the chunk.
                    inner = mine[:, SPAN - 1 - a0 : SPAN - 1 + WINDOW - a1]
                    parts["key"] = mix64(_hash(inner, 0) ^ mix64(key[on].view(np.uint64) + np.uint64(chunk)) ^ (_hash(inner, 1) << np.uint64(1)))
                    parts["doc"], parts["h"], parts["t"], parts["chunk"], parts["need"] = doc, h, t[on], chunk, need[on]
                    parts["low"], parts["high"] = np.maximum(least[on] - a0, 0), np.minimum(most[on] - a0, CHUNK - 1)
                    parts["left"], parts["right"] = 0, 0
                    parts["left"][:, : CHUNK - 1] = mine[:, SPAN - 1 - a1 : SPAN - 1 - a0][:, ::-1]
                    parts["right"][:, : CHUNK - 1] = mine[:, SPAN - 1 + WINDOW - a1 : SPAN - 1 + WINDOW - a0]
                    held.append(parts)
                    n += len(parts)
                if n >= HELD:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    return run


def _order(key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their key and bytes, and how many bytes each shares with the one before; -1: not even the key."""
    words = np.ascontiguousarray(side).view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0], key))
    s = side[order]
    differ = np.concatenate([s[1:] != s[:-1], np.ones((max(len(s) - 1, 0), 1), bool)], 1)
    common = np.where(key[order][1:] == key[order][:-1], differ.argmax(1), -1)
    return order, np.concatenate([[-1], common])


def equal_windows(parts: np.ndarray) -> np.ndarray:
    """A row of CHUNK flags for each part: whether the window that starts so many bytes further before the trigger has an equal."""
    before, common_before = _order(parts["key"], parts["left"])
    behind, common_behind = _order(parts["key"], parts["right"])
    out, n = np.zeros((len(parts), CHUNK), bool), len(parts)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(CHUNK):
        left[before] = np.cumsum(common_before < d)
        right[behind] = np.cumsum(common_behind < CHUNK - 1 - d)
        on = np.flatnonzero((parts["low"] <= d) & (parts["high"] >= d))
        _, at, many = np.unique(left[on] * (n + 1) + right[on], return_inverse=True, return_counts=True)
        out[on, d] = many[at] > 1
    return out


def _settle(t: pa.Table) -> pa.Table:
    """Spans of the windows of a bucket's parts that have equals."""
    parts = np.frombuffer(b"".join(t.column("parts").to_pylist()), _PART)
    hit = equal_windows(parts) & (parts["need"] > 0)[:, None]
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    a0 = parts["t"][row].astype(np.int64) - parts["chunk"][row].astype(np.int64) * CHUNK
    doc, h, spans = _spans(parts["doc"][row], parts["h"][row], a0 - end + 1, a0 - begin)
    return pa.table({"doc": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "spans": pa.array(spans, pa.binary())})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open rows (asked, with their text): a name of 128 bits for each window."""
    for doc, h, text, asked in _texts(batches, ["doc", "h", "bytes", "asked"]):
        every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), WINDOW)
        for begin in range(0, len(asked), 64):
            part = asked[begin : begin + 64]
            starts = np.concatenate([np.arange(x["t"] - x["most"], x["t"] - x["least"] + 1) for x in part])
            need = np.concatenate([np.full(x["most"] - x["least"] + 1, x["need"]) for x in part])
            windows = every[starts]
            names = [pa.array(_hash(windows, k).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(starts), doc)), pa.array(np.full(len(starts), h)), pa.array(starts), pa.array(need)], names=["w1", "w2", "doc", "h", "start", "need"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single starts as spans."""
    for b in batches:
        doc, h, start = (b.column(c).to_numpy() for c in ("doc", "h", "start"))
        found = _spans(doc, h, start, start)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "h", "spans"])


def _rows(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), F.encode(text, "UTF-8").alias("bytes"))


def copied_texts(docs: DataFrame) -> DataFrame:
    """doc, h of the rows whose whole text, of WINDOW bytes or more, another row has too."""
    text = text_or_empty()
    light = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(4), text).alias("h2"), F.octet_length(text).alias("n")).where(F.col("n") >= WINDOW)
    rows = save(light.groupBy("doc", "h", "h2", "n").agg(F.count("*").alias("k")), "text-names")
    odd = F.pmod("h2", F.lit(7)).alias("odd")  # one more key than the aggregation has: Spark can split a hot text's rows
    twice = rows.groupBy("h", "h2", "n").agg(F.sum("k").alias("all")).where(F.col("all") > 1).select("h", "h2", "n", odd)
    return rows.select("doc", "h", "h2", "n", odd).join(twice.hint("merge"), ["h", "h2", "n", "odd"], "left_semi").select("doc", "h")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, h, spans, whole: the runs of starts (first, last: 32-bit pairs) whose windows are all repeats; whole: all of the text."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    dealt = save(_rows(docs).mapInArrow(_parse(max(1, math.ceil(2 * size / SPAN / TASK_ROWS))), "bucket long, rows binary, n long, doc long, h long, spans binary"), "triggers")
    buckets = dealt.where("bucket is not null")
    large = save(buckets.groupBy("bucket").agg(F.sum("n").alias("m")).where(F.col("m") > MOST_ROWS).select("bucket", F.ceil(F.col("m") / TASK_ROWS).cast("long").alias("k")), "large-buckets")
    any_large = not large.isEmpty()
    if any_large:
        parts = buckets.join(large, "bucket", "left").select("bucket", "rows", F.coalesce("k", F.lit(1)).alias("k")).mapInArrow(_by_context, "bucket long, part long, k long, rows binary")
    else:
        parts = buckets.select("bucket", F.lit(0).alias("part"), F.lit(1).alias("k"), "rows")
    met = save(parts.groupBy("bucket", "part").applyInArrow(_meet, _MET), "phrases")
    known = save(dealt.where("bucket is null").select("doc", "h", "spans"), "repeats")
    discard(dealt)
    still = met.where("spans is null and not maybe").withColumn("many", F.lit(False))
    if any_large:
        maybe = met.where("spans is null and maybe")
        phrases = maybe.groupBy("key").agg(F.count("*").alias("contexts"), F.bool_or("need").alias("any_need")).where("contexts > 1 and any_need")
        still = still.unionByName(maybe.join(phrases.select("key", (F.col("contexts") > MOST_ROWS).alias("many")).hint("merge"), "key"))
        still = save(still, "open-rows")
    n = still.where("not many").count()
    by_text = lambda rows: rows.groupBy("doc", "h").agg(F.collect_list(F.struct("t", "most", "least", "need", "key")).alias("asked"))  # noqa: E731  of one text's own triggers
    with_text = lambda asked: _rows(docs).join(asked.hint("merge"), ["doc", "h"]).dropDuplicates(["doc", "h"])
    asked = save(by_text(still.where("not many")), "open")
    parts = with_text(asked).mapInArrow(_chunks(max(1, math.ceil(n * (SPAN / CHUNK) / TASK_ROWS))), "bucket long, parts binary")
    settled = parts.groupBy("bucket").applyInArrow(_settle, _SPANS)
    if any_large:
        windows = save(with_text(by_text(still.where("many"))).mapInArrow(_windows, "w1 long, w2 long, doc long, h long, start long, need boolean"), "windows")
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
        settled = settled.unionByName(windows.where("need").join(twice.hint("merge"), ["w1", "w2"], "left_semi").mapInArrow(_starts, _SPANS))
    spans = met.where("spans is not null").select("doc", "h", "spans").unionByName(known).unionByName(settled)
    spans = spans.unionByName(copied_texts(docs).distinct(), allowMissingColumns=True)
    out = save(spans.groupBy("doc", "h").agg(F.collect_list("spans").alias("spans"), F.bool_or(F.isnull("spans")).alias("whole")), "spans")  # of one text
    for done in (met, known, asked):
        discard(done)
    return out


def cut(text: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of a text, and the (start, stop) of its maximal removed runs; ``spans``: first and last start of repeated windows."""
    if not len(spans):
        return text, []
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, spans[:, 0], 1)
    np.add.at(marks, spans[:, 1] + WINDOW, -1)
    gone = np.cumsum(marks)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (bytes), removed (list of start, stop) of each row.

    Strings are compared within and across documents, never over a document's end, on the
    input alone. Null texts are empty. Rows alike in doc_id and text are two places of
    their strings, like any copies. Other columns are not looked at; an empty table stays empty.
    A very long text takes, while it is parsed, some 40 bytes for each of its bytes, in one
    task; its rows are dealt out in parts. Texts of 4 GB or more are not supported (nor does Spark hold one).
    """
    found = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            doc, n, kept, runs = zip(*held, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, kind)], names=["doc_id", "n_bytes", "kept", "removed"])

        for doc, text, spans, whole in _texts(batches, ["doc", "bytes", "spans", "whole"]):
            if whole:
                kept, runs = b"", [(0, len(text))]
            else:
                kept, runs = cut(text, np.frombuffer(b"".join(spans or []), "<u4").reshape(-1, 2).astype(np.int64))
            held.append((None if doc == NO_ID else doc, len(text), kept, [{"start": s, "stop": e} for s, e in runs]))
            size += len(kept)
            if size > AT_ONCE or len(held) >= 5000:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    rows = _rows(docs).join(found.hint("merge"), ["doc", "h"], "left").select("doc", "bytes", "spans", "whole")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,stop:long>>")


def digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, runs = b.column("kept").to_pylist(), b.column("removed").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("n_bytes"),
                pa.array([sum(x["stop"] - x["start"] for x in r) for r in runs], pa.int64()),
                pa.array([len(r) for r in runs], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).mapInArrow(digest_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
