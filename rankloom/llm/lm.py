"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped files.

Words are hashed to 64 bits; a word's number is its hash's rank among all, so the sorted hash arrays are
the vocabulary. The model is a folder in the shared store, in shards of equal ranges of hashes:

    uni-<s>    hashes (sorted), counts
    bi-<s>     keys history << 32 | word (sorted, by the words' numbers), counts
    stats-<s>  for each word: distinct predecessors; distinct followers seen once, twice, more

Each counting task combines what it has read before it is shuffled, as packed arrays for each shard. A
history so frequent that it would fill a shard (with the texts' start, always) is dealt to all shards by
its followers. Files get their final names by a rename, from names that follow from the shard, so a task
that runs again replaces its own. Workers map the files (those of a remote store are copied first, and
unlinked once mapped); nothing of the model is in the driver but a few numbers a shard.

P(w|u) = max(c(uw) - D(c), 0) / c(u) + gamma(u) P(w), P(w) = max(p(w) - D'(p), 0) / sum p + gamma / (V + 1)
with p(w) the distinct predecessors of w, and D from the counts of counts, one for 1, 2 and 3 or more.
An unknown history leaves P(w), an unknown word gamma / (V + 1). The order is 2: see the README.

Defined results: a null text is empty, so its only token is the end; null doc_ids count as an empty text
for the split; equal rows are all counted; a text of any length is read whole, in a run of its own; of
ties there are none, as counts and scores don't depend on order; extra columns are left out, whatever they
are called; without training rows every word is unknown and N is 0.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, shared_dir, small_batches, text_chunks, word_hashes
from .media import file_system

END = np.uint64(0x8F14E45FCEEA167A)
FLUSH = 2_000_000  # pairs that a counting task holds before it combines and sends them
HOT = 0.25  # of a shard's mean of tokens
_LOW = np.uint64(0xFFFFFFFF)


# ---- texts ------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, each text's words and then END, and the first of each text (n+1 numbers)."""
    h, first = word_hashes(data, offsets, lower=True)
    n = len(offsets) - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def pairs(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The history of each token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = start
    return before, ids


# ---- files ------------------------------------------------------------------------------


def write_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One file for each array, whole or not at all."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    for k, a in arrays.items():
        place, final = f"{root}/_{uuid.uuid4().hex}", f"{root}/{name}.{k}"
        with fs.open_output_stream(place) as out:
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"")
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            fs.delete_file(final)
        fs.move(place, final)


def map_array(folder: str, name: str, dtype: str) -> np.ndarray:
    fs, root = file_system(folder)
    path = f"{root}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem):
        handle, local = tempfile.mkstemp(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # the executor's scratch space
        os.close(handle)
        pafs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        out = np.memmap(local, dtype, "r") if os.path.getsize(local) else np.zeros(0, dtype)
        os.unlink(local)  # the mapping stays
        return out
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


class Words:
    """The vocabulary's files: shards of sorted hashes, `ends` the number of words up to each shard's end."""

    def __init__(self, folder: str, ends: list[int]) -> None:
        self.folder, self.ends = folder, np.array(ends, dtype=np.int64)
        self.shards, self.size = len(ends), ends[-1] if ends else 0
        self.open: dict[int, np.ndarray] = {}

    def hashes(self, s: int) -> np.ndarray:
        if s not in self.open:
            self.open[s] = map_array(self.folder, f"uni-{s}.hashes", "<u8")
        return self.open[s]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 for those not here. h: sorted and distinct."""
        out = np.full(len(h), -1, np.int64)
        cut = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            own, q = self.hashes(int(s)), h[cut[s] : cut[s + 1]]
            at = np.searchsorted(own, q)
            found = at < len(own)
            found[found] = own[at[found]] == q[found]
            out[cut[s] : cut[s + 1]][found] = at[found] + (self.ends[s - 1] if s else 0)
        return out

    def shard_of_number(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ends, ids, side="right"), self.shards - 1)


def pair_shard(keys: np.ndarray, words: Words, hot: np.ndarray) -> np.ndarray:
    history = (keys >> np.uint64(32)).astype(np.int64)
    return np.where(np.isin(history, hot), shard_of(mix(keys), words.shards), words.shard_of_number(history))


# ---- counting ---------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts, begin)


def _rows(shard: np.ndarray, shards: int, *arrays: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """A row of packed arrays for each shard that has something."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    arrays = tuple(a[order] for a in arrays)
    some = np.flatnonzero(np.diff(cut))
    columns = [pa.array([a[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()) for a in arrays]
    columns += [pa.nulls(len(some), pa.binary())] * (2 - len(arrays))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([kind] * len(some), pa.int64()), *columns], names=["shard", "kind", "a", "b"])


PACKED = "shard long, kind long, a binary, b binary"


def _joined(table: pa.Table, kind: int, column: str, dtype: str) -> np.ndarray:
    rows = [a for k, a in zip(table.column("kind").to_pylist(), table.column(column).to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(rows), dtype=dtype)


def _pack_pairs(keys: np.ndarray, counts: np.ndarray, words: Words, hot: np.ndarray) -> pa.RecordBatch:
    return _rows(pair_shard(keys, words, hot), words.shards, keys, counts.astype("<u4"))


def count_words(texts: DataFrame, folder: str, shards: int) -> tuple[Words, int, np.ndarray]:
    """Writes the vocabulary; the words, the number of tokens, and the histories that are dealt to all shards."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
                if sum(len(k) for k, _ in held) > FLUSH:
                    held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > FLUSH // 2:
                        yield _rows(shard_of(held[0][0], shards), shards, held[0][0], held[0][1].astype("<u4"))
                        held = []
        if held:
            k, c = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield _rows(shard_of(k, shards), shards, k, c.astype("<u4"))

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        k, c = _summed(_joined(table, 0, "a", "<u8"), _joined(table, 0, "b", "<u4").astype(np.int64))
        write_arrays(folder, f"uni-{s}", hashes=k, counts=c)
        top = np.argsort(-c, kind="stable")[:256]  # with a quarter of the mean each, more would be 64 shards' worth in one
        return pa.table({"shard": [s], "n": [len(k)], "total": [int(c.sum())], "top": pa.array([top.tolist()], pa.list_(pa.int64())), "most": pa.array([c[top].tolist()], pa.list_(pa.int64()))})

    made = small_batches(texts).mapInArrow(combine, PACKED).groupBy("shard").applyInArrow(merge, "shard long, n long, total long, top array<long>, most array<long>")
    found = {r.shard: r for r in made.collect()}  # a row a shard
    for s in set(range(shards)) - set(found):
        write_arrays(folder, f"uni-{s}", hashes=np.zeros(0, "<u8"), counts=np.zeros(0, "<i8"))
    sizes = [found[s].n if s in found else 0 for s in range(shards)]
    words = Words(folder, np.cumsum(sizes).tolist())
    if words.size >= 1 << 32:
        raise ValueError("a pair's key has 32 bits for each word's number")
    total = sum(r.total for r in found.values())
    hot = [words.size] + [int(t) + (int(words.ends[s - 1]) if s else 0) for s, r in found.items() for t, c in zip(r.top, r.most, strict=True) if c > HOT * total / shards]
    return words, total, np.array(sorted(hot), dtype=np.int64)


def count_pairs(texts: DataFrame, folder: str, words: Words, hot: np.ndarray) -> dict[str, list[int]]:
    """Writes the bigrams and the words' statistics; counts of counts of bigrams (pairs) and of predecessors (words)."""
    ends = words.ends.tolist()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, n = Words(folder, ends), [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                h, first = tokens(data, offsets)
                known, place = np.unique(h, return_inverse=True)
                u, w = pairs(vocabulary.numbers(known)[place], first, vocabulary.size)
                held.append((u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))
                n += len(u)
                if n > FLUSH:
                    yield _pack_pairs(*np.unique(np.concatenate(held), return_counts=True), vocabulary, hot)
                    held, n = [], 0
        if held:
            yield _pack_pairs(*np.unique(np.concatenate(held), return_counts=True), vocabulary, hot)

    def merge(table: pa.Table) -> pa.Table:
        s, vocabulary = table.column("shard")[0].as_py(), Words(folder, ends)
        k, c = _summed(_joined(table, 0, "a", "<u8"), _joined(table, 0, "b", "<u4").astype(np.int64))
        large = np.flatnonzero(c > 255)
        write_arrays(folder, f"bi-{s}", keys=k, counts=np.minimum(c, 255).astype(np.uint8), large=large.astype("<i8"), values=c[large])
        history, begin = np.unique(k >> np.uint64(32), return_index=True)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (c, c == 1, c == 2, c > 2)], 1)
        follower, before = np.unique(k & _LOW, return_counts=True)
        counts = np.array([(c == i).sum() for i in (1, 2, 3, 4)], dtype=np.int64)
        out = [_rows(vocabulary.shard_of_number(history.astype(np.int64)), vocabulary.shards, history, stats, kind=1)]
        out += [_rows(vocabulary.shard_of_number(follower.astype(np.int64)), vocabulary.shards, follower.astype("<u4"), before.astype("<u4"), kind=2)]
        out += [_rows(np.zeros(1, np.int64), vocabulary.shards, np.zeros(1, "<u8"), counts[None, :], kind=3)]
        return pa.Table.from_batches(out)

    def total(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        base = ends[s - 1] if s else 0
        n = ends[s] - base + (s == len(ends) - 1)  # the texts' start is the last word of all
        at = _joined(table, 1, "a", "<u8").astype(np.int64) - base
        stats = np.zeros((n, 4), np.int64)
        np.add.at(stats, at, _joined(table, 1, "b", "<i8").reshape(-1, 4))
        before = np.bincount(_joined(table, 2, "a", "<u4").astype(np.int64) - base, weights=_joined(table, 2, "b", "<u4"), minlength=n).astype(np.int64)
        write_arrays(folder, f"stats-{s}", before=before.astype("<u4"), stats=stats[:, 1:].astype("<u4"))
        ones = _joined(table, 3, "b", "<i8").reshape(-1, 4).sum(0)
        twos = [int((before == i).sum()) for i in (1, 2, 3, 4)] + [int((before > 2).sum()), int(before.sum())]
        starts = int(stats[-1, 0]) if s == len(ends) - 1 else 0
        return pa.table({"shard": [s], "ones": pa.array([ones.tolist()], pa.list_(pa.int64())), "twos": pa.array([twos], pa.list_(pa.int64())), "starts": [starts]})

    merged = texts.mapInArrow(combine, PACKED).groupBy("shard").applyInArrow(merge, PACKED)
    found = {r.shard: r for r in merged.groupBy("shard").applyInArrow(total, "shard long, ones array<long>, twos array<long>, starts long").collect()}  # a row a shard
    for s in set(range(words.shards)) - set(found):
        n = ends[s] - (ends[s - 1] if s else 0) + (s == len(ends) - 1)
        write_arrays(folder, f"stats-{s}", before=np.zeros(n, "<u4"), stats=np.zeros((n, 3), "<u4"))
    for s in range(words.shards):  # shards without a bigram have no file yet
        fs, root = file_system(folder)
        if fs.get_file_info(f"{root}/bi-{s}.keys").type == pafs.FileType.NotFound:
            write_arrays(folder, f"bi-{s}", keys=np.zeros(0, "<u8"), counts=np.zeros(0, np.uint8), large=np.zeros(0, "<i8"), values=np.zeros(0, "<i8"))
    add = lambda rows, n: np.sum(list(rows) or [[0] * n], axis=0).tolist()
    return {"pairs": add((r.ones for r in found.values()), 4), "words": add((r.twos for r in found.values()), 6), "starts": [sum(r.starts for r in found.values())]}


def discounts(n: list[int]) -> np.ndarray:
    """D of counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4.

    Each is at least 0.1, so that something is left for what wasn't seen, and at most its count.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) * 0.5 for i in range(3)]
    return np.array([0.0] + [min(max(x, 0.1), i + 1.0) for i, x in enumerate(d)])


# ---- scoring ----------------------------------------------------------------------------


class Model:
    """The trained model, small enough to send: where its files are and the few numbers it needs besides."""

    def __init__(self, folder: str, words: Words, total: int, hot: np.ndarray, counts: dict[str, list[int]]) -> None:
        self.folder, self.ends, self.total, self.hot = folder, words.ends.tolist(), total, hot
        self.d2, self.d1 = discounts(counts["pairs"][:4]), discounts(counts["words"][:4])
        n1, n2, _, _, more, self.seen = counts["words"]
        self.starts = counts["starts"][0]
        self.rest = float(self.d1[1:] @ [n1, n2, more]) / self.seen if self.seen else 1.0


class Scorer:
    """Maps a model's files, in a worker, as they are needed."""

    def __init__(self, model: Model) -> None:
        self.m, self.words, self.files = model, Words(model.folder, model.ends), {}

    def file(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = map_array(self.m.folder, name, dtype)
        return self.files[name]

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, predecessors, and followers seen once, twice, more, of sorted known words and the start."""
        counts, before, stats = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros((len(ids), 3), np.int64)
        cut = np.searchsorted(self.words.shard_of_number(ids), np.arange(self.words.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[s], cut[s + 1]
            at = ids[a:b] - (self.words.ends[s - 1] if s else 0)
            own = self.file(f"uni-{s}.counts", "<i8")
            counted = at < len(own)
            counts[a:b][counted] = own[at[counted]]
            before[a:b] = self.file(f"stats-{s}.before", "<u4")[at]
            stats[a:b] = self.file(f"stats-{s}.stats", "<u4").reshape(-1, 3)[at]
        return counts, before, stats

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        """The counts of distinct sorted pairs."""
        out = np.zeros(len(keys), np.int64)
        shard = pair_shard(keys, self.words, self.m.hot)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.words.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own, q = self.file(f"bi-{s}.keys", "<u8"), keys[order[cut[s] : cut[s + 1]]]
            at = np.searchsorted(own, q)
            found = at < len(own)
            found[found] = own[at[found]] == q[found]
            c = np.zeros(len(q), np.int64)
            c[found] = self.file(f"bi-{s}.counts", "u1")[at[found]]
            large = self.file(f"bi-{s}.large", "<i8")
            if len(large):
                most = np.flatnonzero(c == 255)
                place = np.searchsorted(large, at[most])
                over = place < len(large)
                over[over] = large[place[over]] == at[most][over]
                c[most[over]] = self.file(f"bi-{s}.values", "<i8")[place[over]]
            out[order[cut[s] : cut[s + 1]]] = c
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        m, size = self.m, self.words.size
        h, first = tokens(data, offsets)
        distinct, place = np.unique(h, return_inverse=True)
        numbers = self.words.numbers(distinct)
        known = np.flatnonzero(numbers >= 0)
        ids = np.append(numbers[known], size)
        counts, before, stats = self.of_words(ids)
        # by distinct word, with the start last
        c, p, as_history = np.zeros(len(distinct) + 1), np.zeros(len(distinct) + 1), np.zeros((len(distinct) + 1, 3))
        spot = np.append(known, len(distinct))
        c[spot], p[spot], as_history[spot] = counts, before, stats
        lower = np.maximum(p - m.d1[np.minimum(p, 3).astype(int)], 0) / max(m.seen, 1) + m.rest / (size + 1)
        times = np.append(c[:-1], m.starts)
        gamma = np.where(times > 0, (as_history @ m.d2[1:]) / np.maximum(times, 1), 1.0)
        u, w = pairs(place, first, len(distinct))
        number = np.append(numbers, size)
        both = (number[u] >= 0) & (number[w] >= 0)
        keys = (number[u[both]].astype(np.uint64) << np.uint64(32)) | number[w[both]].astype(np.uint64)
        some, back = np.unique(keys, return_inverse=True)
        cuw = np.zeros(len(u))
        cuw[both] = self.of_pairs(some)[back]
        higher = np.maximum(cuw - m.d2[np.minimum(cuw, 3).astype(int)], 0) / np.maximum(times[u], 1)
        log = np.log10(higher + gamma[u] * lower[w])
        base = np.log10((c[w] + 0.1) / (m.total + 0.1 * (size + 1)))
        begin = first[:-1]
        return np.diff(first), np.add.reduceat((c[w] > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(log, begin)


_SCORERS: dict[str, Scorer] = {}


def train(texts: DataFrame, folder: str, shards: int) -> Model:
    """texts(text)"""
    words, total, hot = count_words(texts, folder, shards)
    return Model(folder, words, total, hot, count_pairs(texts, folder, words, hot))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.folder] = Scorer(model)
        scorer = _SCORERS[model.folder]
        for batch in batches:
            parts = [scorer.score(data, offsets) for _, _, data, offsets in text_chunks(batch.column(1))]
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] or [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def shards_for(docs: DataFrame, most: int = 128 << 20) -> int:
    """Shards of about `most` bytes of what is read, and no fewer than the shuffle's partitions."""
    read = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-read // most), 1 << 16))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = shards_for(docs)
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text"), shared_dir(spark, "lm"), shards)
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
