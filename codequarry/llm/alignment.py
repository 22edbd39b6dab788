"""Operator 13: how the tokens of two tokenizers cover the same bytes.

Each byte of a text has an owner among the tokens of A and one among those of B. Where
the pair of owners changes, a new overlap (a link) begins; where both change at once, both cut there.

Neither tokenizer joins anything across a single space between two characters that are not white
space: A splits before such a space, and no piece of B has a space inside (which is checked when B is loaded). So a
text is taken in units, from one such space to the next; a worker keeps the units that it has met.
Counts of pairs over the corpus come from sums by part (a run of documents of one task). A
part then gets the counts of its own pairs back, each once, not once a document.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import discard, save, table
from codequarry.llm.word_hashes import release

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units of a call, units that a worker keeps, characters of a unit that is kept, characters taken at once and in a part.
PER_CALL, UNITS, UNIT_CHARS, AT_ONCE, PART_CHARS = 400, 250_000, 100, 1 << 20, 1 << 23
#: No white space by any library's notion, no control character.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0▁]"
_BETWEEN = re.compile(f"(?<={_SOLID}) (?={_SOLID})")
_PLAIN = re.compile(f" {_SOLID}(?s:.*{_SOLID})?")
_ID_BITS = 16


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that cover the same bytes, by their lengths: where each link begins, its token of A and of B, and whether both begin there."""
    a, b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
    new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
    new_a[1:], new_b[1:] = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(new_a | new_b)
    return at, a[at], b[at], (new_a & new_b)[at]


class Unit:
    """What a unit adds to its document; ok is False where a tokenizer doesn't give its bytes back."""

    __slots__ = ("ok", "n_a", "n_b", "n_groups", "groups", "codes")

    def __init__(self, ok: bool, n_a: int = 0, n_b: int = 0, n_groups: int = 0, groups: bytes = b"", codes: bytes = b""):
        self.ok, self.n_a, self.n_b, self.n_groups, self.groups, self.codes = ok, n_a, n_b, n_groups, groups, codes


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            shape = json.load(f)
        if shape["normalizer"] or (shape["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not shape["pre_tokenizer"].get("use_regex"):
            raise ValueError("A must be a byte-level tokenizer that splits before spaces and changes nothing")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("B has a piece that goes on after a space")
        of = byte_level()
        vocabulary = self.a.get_vocab()
        if max(len(pieces), *(k + 1 for k in vocabulary.values())) > 1 << _ID_BITS:
            raise ValueError("ids are held in two bytes, and a vocabulary has more")
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.decimal = [str(k) for k in range(1 << _ID_BITS)]
        #: Units met of late, and those before them: what is met again moves over, the rest goes.
        self.kept: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def _take(self, units: list[str]) -> list[Unit] | None:
        """Units that stand one behind another in one text; None where the bytes differ."""
        text = "".join(units)
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        at, own_a, own_b, cut = overlaps(self.len_a[a], self.len_b[b])
        ends = np.cumsum(list(map(len, units)) if len(raw) == len(text) else [len(u.encode()) for u in units])
        stop = np.searchsorted(at, ends)  # in links
        first = np.flatnonzero(cut)
        if not cut[stop[:-1]].all() or (at[stop[:-1]] != ends[:-1]).any():
            return None  # a token goes over a unit's end, so these units can't be taken together
        group_stop, codes = np.searchsorted(first, stop).tolist(), (a[own_a] << _ID_BITS | b[own_b]).astype("<u4").tobytes()
        tokens_a = [*own_a[first].tolist(), len(a)]
        tokens_b = [*own_b[first].tolist(), len(b)]
        say_a, say_b = [self.decimal[k] for k in a.tolist()], [self.decimal[k] for k in b.tolist()]
        several = lambda say, p, q: say[p] if q - p == 1 else ",".join(say[p:q])
        groups = [f"{several(say_a, p, q)}|{several(say_b, s, t)}" for p, q, s, t in zip(tokens_a, tokens_a[1:], tokens_b, tokens_b[1:], strict=False)]
        out, link, group = [], 0, 0
        for link_stop, g in zip(stop.tolist(), group_stop, strict=True):
            n_a, n_b = tokens_a[g] - tokens_a[group], tokens_b[g] - tokens_b[group]
            out.append(Unit(True, n_a, n_b, g - group, ";".join(groups[group:g]).encode(), codes[4 * link : 4 * link_stop]))
            link, group = link_stop, g
        return out

    def _alone(self, unit: str) -> Unit:
        return (self._take([unit]) or [Unit(False)])[0]

    def units(self, names: list[str]) -> list[Unit]:
        """What each of some different units adds."""
        out = list(map(self.kept.get, names))
        open_ = [k for k, x in enumerate(out) if x is None]
        new = []
        for k in open_:
            if (x := self.older.get(names[k])) is None:
                new.append(k)
            else:
                out[k] = x
        plain = [k for k in new if len(names[k]) <= UNIT_CHARS and _PLAIN.fullmatch(names[k])]
        for begin in range(0, len(plain), PER_CALL):
            part = plain[begin : begin + PER_CALL]
            units = [names[k] for k in part]
            for k, x in zip(part, self._take(units) or map(self._alone, units), strict=True):
                out[k] = x
        for k in new:
            if out[k] is None:
                out[k] = self._alone(names[k])
        if len(self.kept) + len(open_) > UNITS:
            self.kept, self.older = {}, self.kept
        self.kept.update((names[k], out[k]) for k in open_[:UNITS] if len(names[k]) <= UNIT_CHARS)
        return out


class Document:
    """Sums up the units of a text, piece by piece."""

    def __init__(self, keep_groups: bool):
        self.ok, self.n, self.sha, self.any = True, np.zeros(4, np.int64), hashlib.sha256(), False
        self.groups: list[bytes] | None = [] if keep_groups else None
        self.codes, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, ok: bool, sums: np.ndarray, groups: bytes, codes: np.ndarray) -> None:
        if self.any:
            groups = b";" + groups
        self.ok, self.any, self.n = self.ok and ok, True, self.n + sums
        self.sha.update(groups)
        if self.groups is not None:
            self.groups.append(groups)
        codes, times = np.unique(codes, return_counts=True)
        if len(self.codes):
            codes, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            times = np.bincount(place, np.concatenate([self.times, times])).astype(np.int64)
        self.codes, self.times = codes, times

    def row(self) -> tuple:
        if not (self.ok and self.any):
            return (0, 0, 0, 0, "", b"", b"", None if self.groups is None else "")
        steps = np.diff(self.codes, prepend=np.uint32(0)).astype("<u4")
        return (*self.n.tolist(), self.sha.hexdigest(), steps.tobytes(), self.times.astype("<u4").tobytes(), None if self.groups is None else b"".join(self.groups).decode())


def pieces_of(text: str) -> Iterator[list[str]]:
    """The units of a text with its space in front, in lists of about AT_ONCE characters."""
    text, begin = " " + text, 0
    while begin < len(text):
        cut = _BETWEEN.search(text, begin + AT_ONCE) if len(text) - begin > AT_ONCE else None
        stop = cut.start() if cut else len(text)
        yield _BETWEEN.split(text[begin:stop]) if begin == 0 else _BETWEEN.split(text[begin + 1 : stop])
        begin = stop


def split_units(text: str) -> Iterator[list[str]]:
    """pieces_of() with the space back that each unit but the first begins with."""
    first = True
    for units in pieces_of(text):
        yield [units[0], *[" " + u for u in units[1:]]] if first else [" " + u for u in units]
        first = False


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner, which keeps what it has met over tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _add_all(found: Aligner, waiting: list[tuple[Document, list[str]]]) -> None:
    """Each document gets its piece; units of all pieces are looked up together."""
    met: dict[str, int] = {}
    numbers = np.array([met.setdefault(u, len(met)) for _, units in waiting for u in units], np.int64)
    units = found.units(list(met))
    sums = np.array([(u.n_a, u.n_b, u.n_groups, len(u.codes) // 4) for u in units], np.int64).reshape(-1, 4)
    bad = np.array([not u.ok for u in units])
    pool, sizes = np.frombuffer(b"".join([u.codes for u in units]), "<u4"), sums[:, 3]
    begin = np.cumsum(sizes) - sizes
    n = sizes[numbers]
    ends = np.cumsum(n)
    codes = pool[np.arange(int(n.sum())) + np.repeat(begin[numbers] - (ends - n), n)]
    groups, at, link = [u.groups for u in units], 0, 0
    for document, piece in waiting:
        own = numbers[at : at + len(piece)]
        stop = int(ends[at + len(piece) - 1])
        document.add(not bad[own].any(), sums[own].sum(0), b";".join(map(groups.__getitem__, own.tolist())), codes[link:stop])
        at, link = at + len(piece), stop


_TOKENS = "part long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, groups string"


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): part, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes (steps
    between its different pairs a << 16 | b, ascending, 32-bit), times (how often each links), and groups where they are asked for.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and ''. Rows may repeat;
    other columns are not read. An empty table gives no rows. Long texts are taken piece by piece; only the
    different pairs of one text (and its groups, if kept) are held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chars, part = aligner(path_a, path_b), 0, TaskContext.get().partitionId() << 32
        gc.disable()  # many small objects live long here, none in cycles, and looking through them took a quarter of the time
        names = ["part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "groups"]
        kinds = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string()]

        def done(ids: pa.Array, documents: list[Document], parts: list[int]) -> pa.RecordBatch:
            columns = list(zip(*[d.row() for d in documents], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), ids, *[pa.array(x, k) for x, k in zip(columns, kinds[2:], strict=True)]], names=names)

        for batch in batches:
            texts, begin = batch.column("__q_text"), 0
            documents, parts, waiting, size = [], [], [], 0
            for k in range(batch.num_rows):
                document = Document(keep_groups)
                documents.append(document)
                text = texts[k].as_py() or ""
                if chars + len(text) > PART_CHARS and chars:
                    part, chars = part + 1, 0
                chars += len(text)
                parts.append(part)
                for piece in split_units(text) if text else ():
                    waiting.append((document, piece))
                    size += sum(map(len, piece))
                    if size > AT_ONCE:
                        _add_all(found, waiting)
                        waiting, size = [], 0
                if not waiting and len(documents) and size == 0:
                    yield done(batch.column("doc_id").slice(begin, len(documents)), documents, parts)
                    begin, documents, parts = k + 1, [], []
            if waiting:
                _add_all(found, waiting)
            if documents:
                yield done(batch.column("doc_id").slice(begin, len(documents)), documents, parts)
        gc.enable()
        release()

    rows = docs.select("doc_id", F.col("text").alias("__q_text"))
    return rows.mapInArrow(run, _TOKENS.format(rows.schema["doc_id"].dataType.simpleString()))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, code, n: sums of each part's documents."""

    def flush(part: int, codes: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if codes:
            own, place = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(place, np.concatenate(times)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), pa.array(own.astype(np.int64)), pa.array(n)], names=["part", "code", "n"])

    part, codes, times, held = -1, [], [], 0
    for b in batches:
        for p, steps, t in zip(*[b.column(c).to_pylist() for c in ("part", "codes", "times")], strict=True):
            if p != part or held > 1 << 21:  # sums of one part may come in several pieces
                yield from flush(part, codes, times)
                part, codes, times, held = p, [], [], 0
            if steps:
                codes.append(np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.uint32))
                times.append(np.frombuffer(t, "<u4"))
                held += len(steps) // 4
    yield from flush(part, codes, times)


def pair_counts(by_part: DataFrame) -> DataFrame:
    """code, links, best of each pair of ids that is linked anywhere: how many links hold it, and whether none of its id of B has more."""
    counts = by_part.groupBy("code").agg(F.sum("n").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("code").bitwiseAND((1 << _ID_BITS) - 1)))  # as many rows as A has ids
    return counts.withColumn("best", F.col("links") == most)


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (a saved table of align()) with n_best (links whose pair is the best of its id of B) and count_sum (of the links' counts)."""
    by_part = save(aligned.select("part", "codes", "times").mapInArrow(_by_part, "part long, code long, n long"), "pairs-by-part")
    known = by_part.select("part", "code").join(pair_counts(by_part), "code").select("part", "code", "links", "best")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        code, links, best = (right.column(c).to_numpy() for c in ("code", "links", "best"))
        order = np.argsort(code)
        code, links, best = code[order], links[order], best[order].astype(np.int64)
        n_best, sums = [], []
        for steps, times in zip(left.column("codes").to_pylist(), left.column("times").to_pylist(), strict=True):
            at = np.searchsorted(code, np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.uint32).astype(np.int64))
            n = np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int((n * best[at]).sum()))
            sums.append(int((n * links[at]).sum()))
        return left.drop_columns(["part", "codes", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    kept = [c for c in aligned.columns if c not in ("part", "codes", "times")]
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"
    return aligned.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(look_up, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)
    aligned = save(align(table(spark, sf_dir, "documents"), *paths).drop("groups"), "aligned")
    return score_links(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_token_alignment": op13_token_alignment}
