"""Operator 12: how far the sources of a language lie apart, term by term.

The terms of a language are dealt to blocks by hash, its sources to runs of 256. A tile has the counts of
a block's terms in two runs as a dense matrix; shares are exact whole numbers, and the divergence of all pairs of
a tile is computed by broadcasting. Sums of tiles give the pairs, heaps of tiles the leading terms of each source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import discard, save, table
from codequarry.llm.word_hashes import release

#: Documents that a kept term has at least in its language, parts of the whole that shares are counted in, leading terms.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a block, about; sources of a run; numbers of a broadcast at once.
BLOCK_TERMS, RUN, CELLS = 2048, 256, 1 << 21
#: Entries that a task adds up before it hands them on; bytes of a text taken at once.
HELD, AT_ONCE = 200_000, 1 << 20
#: A-Z in lower case, and a blank for whatever is neither a letter of ASCII nor beyond it.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, cut where no term is."""
    raw, begin = raw.translate(_TERMS), 0
    while begin < len(raw):
        stop = raw.find(b" ", begin + AT_ONCE) if len(raw) - begin > AT_ONCE else -1
        stop = len(raw) if stop < 0 else stop
        yield raw[begin:stop].split()
        begin = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs summed over a while; a row without term for each group met."""
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for group, own in times.items():
            lang, source = group
            terms, among = list(own), docs[group]
            columns = [pa.array([lang] * (len(own) + 1), pa.string()), pa.array([source] * (len(own) + 1), pa.string()), pa.array([None, *terms], pa.binary()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(among.__getitem__, terms)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, raw in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            own, among = times.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            before, seen = len(own), set()
            for terms in _pieces(raw.as_py()):
                own.update(terms)
                seen.update(terms)
            among.update(seen)
            held += len(own) - before
            if held > HELD:
                yield from flush()
                times, docs, held = {}, {}, 0
    yield from flush()
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (with it); a row without term for each group, also without any. Null lang, source and text are ''."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * v)), three digits at a time, so that nothing overflows below 9 * 10^15."""
    rest, whole = count + 2, total + 2 * v
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of each row of p from each row of q, summed over all terms; all pairs of some terms at once."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, p.shape[0] * q.shape[0]))
    for k in range(0, p.shape[1], step):
        out += divergence(p[:, None, k : k + step], q[None, :, k : k + step]).sum(2)
    return out


def _tile(key: tuple, terms: pa.Table, groups: pa.Table, size: int) -> pa.Table:
    """Of a tile of runs of ``size`` sources: (h set) the sum of a pair of sources g < h, or (term set) a leading term of source g."""
    lang, _, run_g, run_h = (k.as_py() for k in key)
    number = groups.column("g").to_numpy()
    order = np.argsort(number)
    number, total = number[order], groups.column("n_terms").to_numpy()[order]
    v, all_terms = groups.column("v")[0].as_py(), groups.column("lang_terms")[0].as_py()
    names, of_lang = terms.column("term").to_pylist(), terms.column("n").to_numpy()
    by_name = sorted(range(len(names)), key=lambda k: names[k].encode())  # ties go by the order of bytes
    cells = terms.column("cells").combine_chunks()
    sizes, flat = cells.value_lengths().to_numpy(), cells.flatten()
    g, n = flat.field("g").to_numpy(), flat.field("n").to_numpy()
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    column, row = np.repeat(place, sizes), np.searchsorted(number, g)
    own = (g // size == run_g) | (g // size == run_h)
    count = np.zeros((len(number), len(names)), np.int64)
    count[row[own], column[own]] = n[own]
    p = shares(count, total[:, None], v)
    first = number // size == run_g
    out: list[tuple] = []
    if run_g == run_h:
        sums = pair_sums(p, p)
        at = np.argwhere(np.triu(np.ones_like(sums, bool), 1))
        q = shares(of_lang[by_name], np.int64(all_terms), v)
        for k in range(len(number)):
            hit = np.flatnonzero((count[k] > 0) & (p[k] > q))
            value = divergence(p[k, hit], q[hit])
            best = np.argsort(-value, kind="stable")[:TOP]
            out.extend((lang, int(number[k]), None, names[by_name[hit[j]]], int(value[j])) for j in best)
        out.extend((lang, int(number[a]), int(number[b]), None, int(sums[a, b])) for a, b in at)
    else:
        sums = pair_sums(p[first], p[~first])
        out.extend((lang, int(a), int(b), None, int(sums[i, j])) for i, a in enumerate(number[first]) for j, b in enumerate(number[~first]))
    kinds = [("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("term", pa.string()), ("value", pa.int64())]
    return pa.table([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, block_terms: int = BLOCK_TERMS, run_size: int = RUN) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources of the language by divergence, and the leading terms of the source.

    ``docs`` has text, lang and source, null or not; other columns are not read and rows may repeat. Texts without
    terms still make their group known; a language without kept terms has pairs of value 0. An empty table gives no
    rows. Long texts are taken whole, piece by piece. The row of a term holds a count for each source of its language.
    """
    counts = save(term_counts(docs), "term-counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    numbered = groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    cells = counts.where("term IS NOT NULL").join(numbered, ["lang", "source"])
    kept = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("cells"))
    kept = save(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_terms"))
    by_group = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.g").agg(F.sum("c.n").alias("n_terms"))
    size = numbered.groupBy("lang").agg(F.count("*").alias("n_groups"))
    facts = numbered.join(by_group, ["lang", "g"], "left").join(langs.join(size, "lang", "right"), "lang")
    facts = save(facts.select("lang", "source", "g", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_terms", F.lit(0)).alias("lang_terms"), "n_groups"), "groups", 1)

    blocks, runs = F.ceil(F.col("v") / block_terms), F.ceil(F.col("n_groups") / run_size)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    shape = facts.where("v > 0").groupBy("lang").agg(F.max(blocks).alias("blocks"), F.max(runs).alias("runs"))
    tiles = lambda df: df.withColumn("run_g", F.explode(upto(F.col("runs")))).withColumn("run_h", F.explode(F.sequence("run_g", F.col("runs") - 1)))
    terms = tiles(kept.join(shape, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))).select("lang", "block", "run_g", "run_h", "term", "n", "cells")
    run = F.floor(F.col("g") / run_size)
    sides = tiles(facts.join(shape, "lang").withColumn("block", F.explode(upto(F.col("blocks"))))).where((run == F.col("run_g")) | (run == F.col("run_h")))
    keys = ["lang", "block", "run_g", "run_h"]
    # A block can be without terms; its sources alone give nothing.
    some = terms.select(*keys).distinct()
    sides = sides.join(some, keys, "left_semi").select(*keys, "g", "n_terms", "v", "lang_terms")
    out = terms.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(lambda key, left, right: _tile(key, left, right, run_size), "lang string, g long, h long, term string, value long")
    out = save(out, "tiles")
    for done in (counts, kept):
        discard(done)

    sums = out.where("h IS NOT NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    bare = facts.where("v = 0").select("lang", "g")
    sums = sums.unionByName(bare.join(bare.select("lang", F.col("g").alias("h")), "lang").where("g < h").withColumn("value", F.lit(0).cast("long")))
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    names = facts.select("lang", "g", "source")
    pairs = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    leading = out.where("term IS NOT NULL").join(names, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pairs.unionByName(ranked(leading).where(F.col("rank") <= TOP))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * langs.v) AS p
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
q AS (SELECT kept.lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM kept JOIN langs USING (lang)),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""
}
QUERIES = {"op12_source_divergence": op12_source_divergence}
