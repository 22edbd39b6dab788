"""Operator 7: removal of lines or paragraphs that occur earlier in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codequarry.llm.common import UPPER, discard, save, table, text_or_empty
from codequarry.llm.exact_dedup import NO_ID

#: What stands between two units. A paragraph ends at a blank line, however its own lines are broken.
SEPARATORS = {"line": re.compile("(\n)"), "paragraph": re.compile("(\n(?:[ \t\r\x0b\x0c]*\n)+)")}
#: The columns that line_dedup() adds.
OWN = ["n_units", "n_removed", "removed"]
SPAN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType())])
REBUILT = [StructField("__q_kept", StringType()), StructField("n_units", IntegerType()), StructField("n_removed", IntegerType()), StructField("removed", ArrayType(SPAN))]


def unit_digests(text: str, unit: str = "line", min_words: int = 1) -> Iterator[tuple[int, int, int]]:
    """(number, digest in two halves) of each unit with ``min_words`` words: MD5 of its words in lower
    case (A-Z), one blank between them. Units without words have none."""
    parts = text.split("\n") if unit == "line" else SEPARATORS[unit].split(text)[::2]
    for i, part in enumerate(parts):
        words = part.encode().lower().split()  # bytes: A-Z and ASCII white space alone
        if len(words) >= max(1, min_words):
            d = hashlib.md5(b" ".join(words)).digest()
            yield i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """A row for each unit of each text: __q_id, __q_h, unit (its number), d1 and d2 (its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                cols = [[], [], [], [], []]
                for doc, h, text in zip(*[c.to_pylist() for c in b.slice(begin, 500).columns], strict=True):
                    for row in unit_digests(text, unit, min_words):
                        for c, x in zip(cols, (doc, h, *row), strict=True):
                            c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["__q_id", "__q_h", "unit", "d1", "d2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__q_id"), F.xxhash64(text_or_empty()).alias("__q_h"), text_or_empty().alias("__q_text"))
    return rows.mapInArrow(run, "__q_id long, __q_h long, unit int, d1 long, d2 long")


def repeated_units(lines: DataFrame) -> DataFrame:
    """__q_id, __q_h, dropped: for each document with any, the units that also stand earlier.

    Units rank by doc_id (a null one first), then by number; the first of equal units
    stays. Rows alike in doc_id and text rank alike, so both keep what either keeps. Digests
    are counted before the join, whose third key makes Spark split a hot line's rows.
    """
    me, odd = F.struct("__q_id", "__q_h", "unit"), F.pmod("d1", F.lit(7)).alias("odd")
    twice = lines.groupBy("d1", "d2").agg(F.min(me).alias("first"), F.count("*").alias("k")).where("k > 1").select("d1", "d2", odd, "first")
    # The hint: one way at every size, for the list of repeated units grows with the corpus.
    later = lines.select("*", odd).join(twice.hint("merge"), ["d1", "d2", "odd"]).where(me != F.col("first"))
    return later.groupBy("__q_id", "__q_h").agg(F.array_sort(F.collect_set("unit")).alias("dropped"))  # of one text's own units


def take_out(text: str, dropped: list[int], unit: str = "line") -> tuple[str, int, list[dict]]:
    """A text without its dropped units, how many units it had, and the start and length of each that went.
    With a unit goes what parted it from the unit before; of the first that stays, too."""
    parts = SEPARATORS[unit].split(text)
    gone, at, stay, spans = set(dropped), 0, [], []
    for i in range(0, len(parts), 2):
        if i // 2 in gone:
            spans.append({"start": at, "length": len(parts[i])})
        else:
            stay.append((parts[i - 1] if stay else "") + parts[i])
        at += len(parts[i]) + (len(parts[i + 1]) if i + 1 < len(parts) else 0)
    return "".join(stay), len(parts) // 2 + 1, spans


def line_dedup(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """``docs`` with repeated lines (or paragraphs) taken out of text, and n_units, n_removed, removed added.

    Every unit with a word counts; ``min_words`` is for callers who want short ones to stay. removed
    lists (start, length) of each unit that went, in characters of the text before. n_chars,
    if there is such a column, follows the text. Extra columns pass through, but for those named
    like the three that are added, which these replace. A null text stays null and counts as one
    unit; an empty table stays empty; a very long text is rebuilt in one pass over its units.
    """
    lines = save(units(docs, unit, min_words), "units")
    gone = save(repeated_units(lines), "repeated-units")
    discard(lines)
    keys = [F.col("__q_id") == F.col("__q_g"), F.col("__q_h") == F.col("__q_gh")]
    rest = [c for c in docs.columns if c != "text" and c not in OWN]
    rows = docs.select(
        F.struct(*rest).alias("__q_row"), F.col("text").alias("__q_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__q_id"), F.xxhash64(text_or_empty()).alias("__q_h")
    )
    gone = gone.select(F.col("__q_id").alias("__q_g"), F.col("__q_h").alias("__q_gh"), F.col("dropped").alias("__q_dropped")).hint("merge")
    rows = rows.join(gone, keys, "left").select("__q_row", "__q_text", "__q_dropped")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part, kept, n_units, removed = b.slice(begin, 500), [], [], []
                for text, dropped in zip(part.column("__q_text").to_pylist(), part.column("__q_dropped").to_pylist(), strict=True):
                    stay, n, spans = take_out(text or "", dropped or [], unit)
                    kept.append(text if text is None else stay)
                    n_units.append(n)
                    removed.append(spans)
                cols = [part.column("__q_row"), pa.array(kept, pa.string()), pa.array(n_units, pa.int32()), pa.array(list(map(len, removed)), pa.int32()), pa.array(removed, span)]
                yield pa.RecordBatch.from_arrays(cols, names=["__q_row", "__q_kept", *OWN])

    out = rows.mapInArrow(rebuild, StructType([rows.schema["__q_row"], *REBUILT]))
    chars = F.length(F.coalesce("__q_kept", F.lit(""))).cast("long")
    named = {"text": F.col("__q_kept"), "n_chars": chars}
    return out.select(*[(named[c] if c in named else F.col("__q_row")[c]).alias(c) for c in docs.columns if c not in OWN], *OWN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda key: F.array_join(F.transform("removed", lambda r: r[key].cast("string")), ",")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed", listed("start").alias("removed_starts"), listed("length").alias("removed_lengths"), F.sha2(text, 256).alias("kept_sha256"), text.alias("kept_text"))


SQL = {
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, u.i - 1 AS unit, u.x AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, LATERAL (SELECT generate_subscripts(l, 1) AS i, unnest(l) AS x) u
), placed AS (
  SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         regexp_replace(regexp_replace(translate(x, '{UPPER}', '{UPPER.lower()}'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM lines
), ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) > 1 AS gone FROM placed
)
SELECT doc_id, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY unit) FILTER (gone), '') AS removed_starts,
       coalesce(string_agg(CAST(length(x) AS VARCHAR), ',' ORDER BY unit) FILTER (gone), '') AS removed_lengths,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY unit) FILTER (NOT gone), '')) AS kept_sha256,
       coalesce(string_agg(x, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept_text
FROM ranked GROUP BY doc_id"""
}
QUERIES = {"op7_line_dedup": op7_line_dedup}
