"""Token ids of documents, by a public tokenizer, word by word.

Both normalisation and splitting of the tokenizer stop at white space, so the ids of a
text are those of its words put together. Each worker keeps the ids of words it has
met, which spares most of the work.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import text_or_empty
from codequarry.llm.word_hashes import release

END = 2
#: Entries that a worker keeps of words taken whole and of words of letters; words
#: of one call; characters of texts taken at once. Worker processes live on over tasks.
WORDS, STEMS, PER_CALL, AT_ONCE = 50_000, 250_000, 500, 1 << 21
#: Any other character sends a text through the tokenizer as a whole.
_ODD = re.compile("[^\t-\r\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: How a text is split into words, runs of letters, digits and runs of anything else.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = ".,!?;:#$%&*()|-+=/\"_[]{}@^~"


def _strings(a: pa.Array) -> list[str]:
    """As to_pylist(), many times faster."""
    return a.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts. Of plain texts it looks up lower-cased words, and takes a word with
    punctuation after it apart, as the tokenizer does; others it leaves to the tokenizer.

    The words of many texts are split and numbered by Arrow, so Python sees each different word of a
    call once, and numpy puts their ids together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        #: Stems met of late, and those before them: what is met again moves over, the rest goes.
        self.stems, self.older, self.most_stems = {}, {}, STEMS
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in two bytes, and this vocabulary has more")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        # What the work by words takes for granted; any other tokenizer gets whole texts.
        shape = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        splits = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and shape["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and shape["model"].get("end_of_word_suffix") == "</w>"
        self.by_words = self.by_words and splits.get("pattern") == {"Regex": _SPLIT} and splits.get("behavior") == "Removed" and splits.get("invert") is True
        self.up_to_rest = "^.*[^" + re.escape(_PUNCTUATION) + "]"
        # The same model without the work that lower-cased words of letters alone have behind them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode words of letters alone, many to a call: each ends with the only token that ends a word."""
        for begin in range(0, len(new), PER_CALL):
            part = new[begin : begin + PER_CALL]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            raw, at = ids.tobytes(), 0
            for w, stop in zip(part, (2 * np.flatnonzero(self.ends[ids]) + 2).tolist(), strict=True):
                self.stems[w] = raw[at:stop]
                at = stop

    def _stems(self, met: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of the different stems, which are words of letters alone, and which of them ``met`` has where."""
        numbered = met.dictionary_encode()
        names = _strings(numbered.dictionary)
        found = list(map(self.stems.get, names))
        open_ = [k for k, x in enumerate(found) if x is None]
        if open_:
            if len(self.stems) + len(open_) > self.most_stems:
                self.stems, self.older = {}, self.stems
            new = []
            for k in open_:
                if (x := self.older.get(names[k])) is None:
                    new.append(names[k])
                else:
                    self.stems[names[k]] = x
            self._learn(new)
            for k in open_:
                found[k] = self.stems[names[k]]
        return found, numbered.indices.to_numpy()

    def _kept(self, met: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer takes as a whole."""
        if len(self.words) > WORDS:
            self.words = {}
        for w in met:
            if w not in self.words:
                self.words[w] = self.whole(w)
        return list(map(self.words.__getitem__, met))

    def _plain(self, texts: list[str]) -> list[bytes]:
        lists = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        numbered = lists.flatten().dictionary_encode()
        met, codes = numbered.dictionary, numbered.indices.to_numpy()
        stem = pc.utf8_rtrim(met, characters=_PUNCTUATION)
        letters = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pc.equal(met, stem), "", pc.replace_substring_regex(met, self.up_to_rest, ""))
        other = np.flatnonzero(~letters & pc.not_equal(stem, "").to_numpy(zero_copy_only=False))
        rests = rest.dictionary_encode()
        # Each word has two pieces: its stem, or all of it, and what stands after the stem, or nothing.
        pieces, first = self._stems(stem.filter(pa.array(letters)))
        tails, wholes = self._kept(_strings(rests.dictionary)), self._kept(_strings(met.take(pa.array(other))))
        pool = [b"", *pieces, *tails, *wholes]
        head, tail = np.zeros(len(met), np.int64), 1 + len(pieces) + rests.indices.to_numpy().astype(np.int64)
        head[letters] = 1 + first
        head[other] = 1 + len(pieces) + len(tails) + np.arange(len(other))
        tail[other] = 0
        sizes = np.array(list(map(len, pool)), np.int64) // 2
        begin = np.cumsum(sizes) - sizes
        used = np.stack([head, tail], 1)[codes].ravel()
        n = sizes[used]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(begin[used] - (ends - n), n)
        raw = np.frombuffer(b"".join(pool), np.uint16)[at].tobytes()
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        stops = (2 * np.concatenate([[0], ends])[2 * words]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, two bytes each, without the end id."""
        if not self.by_words:
            return [self.whole(t) for t in texts]
        odd = [bool(_ODD.search(t)) or "<|" in t for t in texts]
        plain = iter(self._plain([t for t, o in zip(texts, odd, strict=True) if not o]))  # none: an empty array
        return [self.whole(t) if o else next(plain) for t, o in zip(texts, odd, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder, which keeps what it has learned over tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], stems: int = STEMS) -> Iterator[pa.RecordBatch]:
    """Batches with ``keep``, first (tokens before it in this task), n_tokens and ids (two bytes each, the end id last)."""
    coder, end, first = encoder(path), np.uint16(END).tobytes(), 0
    coder.most_stems = stems
    gc.disable()  # nothing here is in a cycle, and looking for cycles among so many words costs time
    for batch in batches:
        texts = batch.column("__q_text")
        begin = 0
        while begin < batch.num_rows:
            stop, size = begin, 0
            while stop < batch.num_rows and (size < AT_ONCE):
                size += len(texts[stop].as_py() or "")
                stop += 1
            ids = [x + end for x in coder.encode([t or "" for t in texts.slice(begin, stop - begin).to_pylist()])]
            part, sizes = batch.slice(begin, stop - begin), np.array([len(x) // 2 for x in ids], np.int64)
            firsts = first + np.cumsum(sizes) - sizes
            first += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(firsts), pa.array(sizes), pa.array(ids, pa.binary())], names=[*keep, "first", "n_tokens", "ids"])
            begin = stop
    gc.enable()
    release()


def tokenize(docs: DataFrame, path: str, stems: int = STEMS) -> DataFrame:
    """doc_id, text_hash (tells rows with one doc_id apart), first (tokens before it in its partition), n_tokens, ids (little-endian 16-bit) of each row.

    Null texts are empty; each document ends with the end id. Rows keep their order. The vocabulary has at most 65,536 entries.
    A worker keeps twice ``stems`` words at most, some 230 bytes each.
    """
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("__q_text"))
    keep = ["doc_id", "text_hash"]
    return rows.mapInArrow(lambda it: encode_batches(it, path, keep, stems), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, first long, n_tokens long, ids binary")
