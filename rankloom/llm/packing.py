"""Packing documents into sequences: first-fit decreasing in randomised groups of documents.

Documents are tokenized, end with an id of their own, and are cut at multiples of the sequence length.
Documents are dealt to groups by a seeded hash of their ids and contents, about `group` in each. Within a
group the pieces go, the longest first, each into the first sequence that has room. A tournament tree over
the sequences' free room finds that one in log time: each inner node has the most room below it.

At scale: the texts never move; what is shuffled is a row of numbers for each piece (and its ids where
`keep_ids` asks for them; they are never copied or sorted). Rows of one doc_id, or without one, and copies
of a row are dealt to different groups, so groups are alike in size whatever a third of the rows share, and
one group is one task's work. Texts are cut into words by Arrow, and a batch's distinct words go to the
tokenizer: a plain one (letters, then signs) as its lower-cased letters and its signs, so that all forms of
a word are tokenized once. The ids of strings met are remembered in two generations of `MOST_WORDS`, so that
frequent ones stay; a batch's strings come on top.

Ties: pieces of one length go by doc_id, start and the ids' CRC; pieces equal in these are alike. Defined
results: a null or empty text is the end id alone; a null doc_id is kept; a text of any length is packed
whole; equal rows are packed each; extra columns are left out, whatever they are called; an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_chunks

MOST_WORDS = 80_000
RUN = 2_000  # strings tokenized in one call
CHUNK = 1 << 20  # bytes of text cut into words at once
LETTERS = "".join(c for c in map(chr, range(256)) if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ" and c not in "×÷")
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")  # an apostrophe may begin a cut of its own
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokenizer:
    """Ids of texts by a `tokenizers` file whose pre-tokenizer never joins what a space or a newline parts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)} | {0x20: " "}
        self.bytes = "".join([others.get(b, chr(b)) for b in range(256)])
        self.model = Tokenizer(self.whole.model)  # of words whose bytes are written so
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # whether an id ends a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.fast, self.by_words = self._agrees(), self.parts()

    def _agrees(self) -> bool:
        """Whether the file's definitions are those that the short way stands for, and it gives the whole tokenizer's ids."""
        d = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (d["pre_tokenizer"] or {}).get("pretokenizers", [])]
        spaces = steps == ["NFC", "Replace", "Lowercase"] and d["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        if not spaces or cuts != ["Split", "ByteLevel"] or d["model"]["type"] != "BPE" or d["model"]["end_of_word_suffix"] != "</w>":
            return False
        plain, _, _ = self._halves(pa.array([a["content"] for a in d["added_tokens"]], pa.string()))
        words = ["Hello", "Straße,", "élève.", "ÀÉ", "The", "x", SIGNS, "".join(sorted(LETTERS)), *(f"Ab{s}{s}" for s in SIGNS)]
        _, stems, signs = self._halves(pa.array(words))
        return not pc.any(plain).as_py() and [a + b for a, b in zip(self._short(stems.to_pylist()), self._short(signs.to_pylist()), strict=True)] == [self._long(w) for w in words]

    def parts(self) -> bool:
        """Whether spaces and newlines part a text into words whose ids follow each other: they are removed by the file's own cut."""
        d = json.loads(self.whole.to_str())
        cuts = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        return bool(cuts) and cuts[0]["type"] == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and r"[^\s" in cuts[0]["pattern"].get("Regex", "") and self._long("A b\n\nc  d.\n") == self._long("A") + self._long("b") + self._long("c") + self._long("d.")

    def _long(self, word: str) -> bytes:
        ids = self.whole.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _halves(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Whether each word is plain, which is letters and then signs: one lower-cased token string each; its letters so, its signs."""
        signs = pc.utf8_ltrim(words, LETTERS)
        plain = pc.equal(pc.utf8_rtrim(signs, SIGNS), "")
        return plain, pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, SIGNS)), words), pc.if_else(plain, signs, "")

    def _short(self, strings: list[str]) -> list[bytes]:
        """The ids of lower-cased letters or of signs, by the model alone: all in one call, as the last id of each says so."""
        found = []
        for i in range(0, len(strings), RUN):
            some = [s for s in strings[i : i + RUN] if s]
            ids = np.array(self.model.encode_batch_fast([codecs.charmap_decode(" ".join(some).encode(), "strict", self.bytes)[0]], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(some):
                found += [self._long(s) for s in strings[i : i + RUN]]
                continue
            data, cuts = ids.tobytes(), zip([0, *ends], ends, strict=False)
            each = (data[a:b] for a, b in cuts)
            found += [next(each) if s else b"" for s in strings[i : i + RUN]]
        return found

    def _known(self, strings: pa.Array, plain: bool) -> np.ndarray:
        """The ids of each string; those of strings met are remembered."""
        strings = strings.dictionary_encode()
        if len(self.known) > MOST_WORDS:  # the strings met since then stay; of the others those that come again
            self.before, self.known = self.known, {"": b""}
        known, before, new = self.known, self.before, []
        each = strings.dictionary.to_numpy(zero_copy_only=False).tolist()
        for s in each:
            if s not in known:
                if s in before:
                    known[s] = before[s]
                else:
                    new.append(s)
        known.update(zip(new, self._short(new) if plain else map(self._long, new), strict=True))
        return _objects([known[s] for s in each])[strings.indices.to_numpy()]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, little-endian and 4 bytes each; a null is an empty text."""
        if not self.by_words:
            yield from (self._long(text.as_py() or "") for text in texts)
            return
        for i, j, _, _ in text_chunks(texts, CHUNK):
            split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.slice(i, j - i), ""), "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            if self.fast:
                plain, stems, signs = self._halves(words.dictionary)
                ids = _objects([b""] * len(plain))
                short = plain.to_numpy(zero_copy_only=False)
                ids[short] = self._known(stems.filter(plain), True) + self._known(signs.filter(plain), True)
                ids[~short] = self._known(stems.filter(pc.invert(plain)), False)
            else:
                ids = self._known(words.dictionary, False)
            at, ends = words.indices.to_numpy(), split.offsets.to_pylist()
            yield from (b"".join(ids[at[a:b]].tolist()) for a, b in itertools.pairwise(ends))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def _objects(values: list[bytes]) -> np.ndarray:
    found = np.empty(len(values), object)
    found[:] = values
    return found


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One of each in a worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, length: int, end: int, keep_ids: bool) -> DataFrame:
    """A row for each piece; `_deal` is the same for the pieces of a row, and another one for a further copy of it."""
    schema = PIECES + ", _deal long" + (", ids binary" if keep_ids else "")
    last = struct.pack("<I", end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(path).encode_all, TaskContext.get().partitionId()
        met: dict[tuple[int | None, int], int] = {}  # a row of the task's each
        for batch in batches:
            rows: list[list] = [[] for _ in schema.split(",")]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += last
                whole = zlib.crc32(ids)
                copy = met[doc_id, whole] = met.get((doc_id, whole), -1) + 1
                deal = whole | (task & 0xFFFFF) << 32 | (copy & 0x7FF) << 52
                for i in range(0, len(ids), 4 * length):
                    part = ids[i : i + 4 * length]
                    for column, value in zip(rows, (doc_id, i // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, deal, part), strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return small_batches(docs).select("doc_id", "text").mapInArrow(cut, schema)


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each item; lengths go down and none is over `room`."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    free = [room] * (2 * leaves)  # node i has the children 2i and 2i + 1; all bins are empty
    bins, offsets = [], []
    for n in lengths:
        i = 1
        while i < leaves:
            i = 2 * i if free[2 * i] >= n else 2 * i + 1
        bins.append(i - leaves)
        offsets.append(room - free[i])
        free[i] -= n
        i //= 2
        while i:
            most = max(free[2 * i], free[2 * i + 1])
            if free[i] == most:
                break
            free[i] = most
            i //= 2
    return bins, offsets


def pack(docs: DataFrame, path: str, length: int = 4096, end: int = 2, group: int = 4096, seed: int = 7, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece, with its sequence_id and its offset there."""
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, path, length, end, keep_ids).withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_deal"), F.lit(groups))).drop("_deal")
    schema = cut.drop("_group").schema.add("sequence_id", "long").add("offset", "long")

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, ids, start, crc = (table.column(c).fill_null(-1 << 63).to_numpy() for c in ("length", "doc_id", "start", "ids_crc32"))
        order = np.lexsort((crc, start, ids, -n))
        bins, offsets = first_fit(n[order].tolist(), length)
        placed = np.zeros((2, len(n)), np.int64)
        placed[:, order] = bins, offsets
        first = table.column("_group")[0].as_py() << 32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(placed[0] + first)).append_column("offset", pa.array(placed[1]))

    return cut.groupBy("_group").applyInArrow(fit, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
