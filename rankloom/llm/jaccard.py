"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact similarities decide.

A document is its set of shingles of `words` words (all its words are one shingle where it has fewer).
Documents of equal sets are copies: one of them stands for all. Each tree of the forest labels it with a
row of min-hashes, 16 bits each. The sorted labels of a tree are a trie, a prefix of a label is a node of
it, and two documents meet in a tree at the nodes that they share.

Prefixes are shortened for each document by itself, in all trees alike, until the target recall
(`shortened`). It begins at the longest prefix at which a pair right at the threshold meets with
`least_recall` (0.99: 6 of 8), since nothing that it has met can tell of one that it hasn't. It stops where
the partners it has met, it has met in so many trees that the share of all such partners found is the
recall: one met in c of l trees is missed by chance 1 - p = (1 - c/l)^l, so n partners met stand for the
sum of their 1/p. It ends at the latest where a pair at the threshold meets with the recall (`forest_depth`:
4), and there too if it has met nobody.

Within a node that some document stopped at all members are tied to one of them, so a node of n members has
n - 1 ties, never n^2 pairs. What is tied together is a cluster of candidates. Clusters are verified exactly: a cluster's sets
are laid out once, and one pass for each document counts what it shares with all others, so links are
also found that no tree showed. Large clusters are verified by pairs of blocks, each block bounded in
documents and shingles; a task's output is a row for each document (its links, and one to which it is
joined), never its pairs. Classes are the connected components of the links, found by rounds of minima
over shuffled tables that shrink, with each round written to the shared folder.

At scale: the texts are read in place to make the sketches (some 250 bytes a document). Only labels with
company at the shortest prefix are sorted, by ranges that split a node of any size. Only texts of
clustered documents are shuffled, once a block pair; the others are kept back by a Bloom filter of the
wanted ids, where that is small. Work grows as the square of a cluster only in the block pairs, spread
over tasks: counting every link of a group needs it.

Ties: of sets with equal ids the smaller key stands for both, and a class's id is a minimum, so results don't
depend on order. Defined results: a null text is empty; texts without words are copies of each other; equal
rows are copies; a text of any length is taken whole; doc_ids are integers; extra columns are left out by
`join_similar` and kept by `keep_one`, whatever they are called; a class's id is its smallest doc_id (null only if all its ids are); an empty table gives an
empty result. doc_ids are taken to name documents: of rows with one doc_id in one class `keep_one` keeps
those of equal text once. Rows without a doc_id count by their class too: `keep_one` drops them where a row
of the class has an id, and else keeps one, a row of the set by which the class is named, the first by text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WORD, fewer, keep, mix, small_batches, text_chunks, word_hashes
from .url_filter import Cascade, build_cascade

BLOCK_DOCS, BLOCK_SHINGLES = 512, 2_000_000
#: Ids in a filter that is sent to the executors, some 16 MB; with more, texts are shuffled.
MOST_FILTERED = 12_000_000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def forest_depth(threshold: float, trees: int, most_depth: int, recall: float) -> int:
    """The longest prefix, from most_depth down, at which a pair at the threshold meets with the recall."""
    depth = most_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = word_hashes(data, offsets)
    whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        whole = whole * _STEP + h[j : j + len(whole)]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * _STEP + x
            out.append(mix(np.array([one])) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart: two sums of the shingles' hashes."""
    return np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), mix(s * _STEP).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, words: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(doc_id, key, n, labels): the set's key and size, and its labels laid end to end: a tree's number and `depth` min-hashes, two bytes each."""
    random = np.random.default_rng(seed)
    factors = random.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, rows = [], [], []
            for i, j, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                n = np.array([len(s) for s in sets])
                keys += [set_key(s) for s in sets]
                sizes.append(n)
                labels = np.zeros((j - i, trees, 1 + depth), ">u2")
                labels[:, :, 0] = np.arange(trees)
                some = np.flatnonzero(n)
                if len(some):
                    flat, begin = np.concatenate(sets), (np.cumsum(n) - n)[some]
                    for k in range(trees * depth):
                        least = np.minimum.reduceat(flat * factors[k] + shifts[k], begin)
                        labels[some, k // depth, 1 + k % depth] = mix(least) >> np.uint64(48)
                rows += [label.tobytes() for label in labels]
            n = np.concatenate(sizes) if sizes else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "key", "n", "labels"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id long, key binary, n long, labels binary")


def _prefix(label: Column, depth: Column) -> Column:
    """The node at that depth; its bytes tell its tree and its depth."""
    return F.substring(label, F.lit(1), 2 + 2 * depth)


def tries(sets: DataFrame, trees: int, longest: int, shortest: int) -> DataFrame:
    """sets(key, labels) -> (key, node, pivot, other) of all nodes of two members or more, from the longest prefix to the shortest.

    `pivot` is the node's least key, `other` a member that isn't the document itself.
    """
    width = 2 + 2 * longest
    label = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("labels"), t * width + 1, F.lit(width))))
    labels = sets.select("key", label.alias("label")).withColumn("node", _prefix(F.col("label"), F.lit(shortest)))
    company = labels.groupBy("node").count().where("count > 1").select("node")
    # sorted by ranges: a node's members lie side by side, so that each task counts them before anything is sent
    trie = keep(labels.join(company, "node", "left_semi").select("label", "key").repartitionByRange("label", "key").sortWithinPartitions("label", "key"))
    depths = F.sequence(F.lit(shortest), F.lit(longest))
    members = trie.select("key", F.explode(F.transform(depths, lambda d: _prefix(F.col("label"), d))).alias("node"))
    nodes = members.groupBy("node").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).where("pivot != last")
    return members.join(nodes, "node").select("key", "node", "pivot", F.when(F.col("key") == F.col("pivot"), F.col("last")).otherwise(F.col("pivot")).alias("other"))


def shortened(met: DataFrame, trees: int, shortest: int, recall: float) -> DataFrame:
    """The nodes of tries(...) at which some document stops shortening its prefixes."""
    seen = met.groupBy("key", F.length("node").alias("size"), "other").agg((F.count("*") / trees).alias("share"))
    found = 1 - F.pow(1 - F.col("share"), F.lit(float(trees)))
    told = seen.groupBy("key", "size").agg((F.count("*") / F.sum(1 / found)).alias("found")).where(F.col("found") >= recall)
    stops = told.groupBy("key").agg(F.max("size").alias("stop"))
    return met.join(stops, "key", "left").where(F.length("node") == F.coalesce("stop", F.lit(2 + 2 * shortest))).select("node").distinct()


def with_set_key(docs: DataFrame, words: int) -> DataFrame:
    """Adds `key`, the key of the text's set, to docs(text, ...)."""
    schema = StructType([*docs.schema, StructField("key", BinaryType())])
    at, names = docs.columns.index("text"), schema.names

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) for _, _, data, offsets in text_chunks(batch.column(at)) for s in shingle_sets(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names)

    return small_batches(docs).mapInArrow(keyed, schema)


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, component) of all vertices in them; a component is named by its least vertex.

    In each round a vertex points to the least of itself and its neighbours, and the pointers are doubled
    until each ends at a vertex that points to itself; at least half the vertices don't. Edges are then
    drawn between those ends, and the ones within are gone. So rounds and doublings are both logarithmic,
    on a long chain too, and a star is done after the first.
    """
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    rows = 2 * left.count()  # no table of the rounds has more
    left, roots = fewer(left, rows), None
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        near = keep(fewer(ends.groupBy("e.v").agg(F.min("e.w").alias("w")).select("v", F.least("v", "w").alias("p")), rows))
        while True:
            far = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = keep(fewer(near.join(far, "p").select("v", F.col("p").alias("was"), F.col("q").alias("p")), rows))
            near = up.select("v", "p")
            if up.where("p != was").isEmpty():
                break
        if roots is None:
            roots = up.select("v", F.col("p").alias("component"))
        else:
            roots = keep(fewer(roots.join(up.select(F.col("v").alias("component"), "p"), "component", "left").select("v", F.coalesce("p", "component").alias("component")), rows))
        left = left.join(up.select(F.col("v").alias("a"), F.col("p").alias("c")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("d")), "b")
        left = keep(fewer(left.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).where("a != b").distinct(), rows))
        if left.isEmpty():
            return roots


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of left, those of right after it (by place in the list) whose similarity is high enough."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[j] for j in right])
    begin = np.cumsum(size[right]) - size[right]
    names, place = np.unique(flat, return_inverse=True)
    for i in left:
        mark = np.zeros(len(names), np.int32)
        at = np.searchsorted(names, sets[i])
        at[at == len(names)] = 0
        mark[at[names[at] == sets[i]]] = 1
        shared = np.add.reduceat(mark[place], begin)
        near = shared >= threshold * (size[i] + size[right] - shared) - 1e-9
        yield i, right[near & (right != i)]


def _verify(table: pa.Table, words: int, threshold: float) -> pa.Table:
    """Rows (cluster, i, j, block, key, copies, text) of whole units -> a row (key, joined, links) for each document of each."""
    keys, joined, links = [], [], []
    columns = {c: table.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "key", "copies")}
    sets: list[np.ndarray] = []
    for _, _, data, offsets in text_chunks(table.column("text")):
        sets += shingle_sets(data, offsets, words)
    units: dict[tuple, dict[bytes, int]] = {}
    for row, unit in enumerate(zip(columns["cluster"], columns["i"], columns["j"], strict=True)):
        if set_key(sets[row]) == columns["key"][row]:  # another text may bear the same doc_id
            units.setdefault(unit, {})[columns["key"][row]] = row  # equal rows count once
    for (_, i, j), members in units.items():
        rows = sorted(members.values(), key=lambda r: columns["key"][r])
        own = [sets[r] for r in rows]
        block = np.array([columns["block"][r] for r in rows])
        copies = np.array([columns["copies"][r] for r in rows])
        count, union = np.zeros(len(rows), np.int64), _Union(len(rows))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(left) and len(right):
            for a, near in linked(own, left, right, threshold):
                count[a] += copies[near].sum()
                if i != j:
                    count[near] += copies[a]
                for b in near.tolist():
                    union.join(int(a), b)
        for r, row in enumerate(rows):
            keys.append(columns["key"][row])
            joined.append(columns["key"][rows[union.root(r)]])
            links.append(int(count[r]))
    return pa.table({"key": pa.array(keys, pa.binary()), "joined": pa.array(joined, pa.binary()), "links": pa.array(links, pa.int64())})


def join_similar(docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 16, most_depth: int = 8, recall: float = 0.9995, least_recall: float = 0.99, seed: int = 7, heads: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id, n_copies (equal sets, itself too), n_links (other rows that are similar).

    There can be 65,536 `trees` at most.

    `heads` adds `head`: in a class without any id the key of the set that names the class, for rows of that set.
    """
    shortest = forest_depth(threshold, trees, most_depth, recall)
    longest = max(shortest, forest_depth(threshold, trees, most_depth, least_recall))
    sketched = keep(sketches(docs, words, trees, longest, seed))
    distinct = keep(sketched.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("labels").alias("labels")))
    met = keep(tries(distinct.where("n > 0").select("key", "labels"), trees, longest, shortest))
    # a document's pivots, one a node at most, are tied to their least one, and the document to that alone
    tied = met.join(shortened(met, trees, shortest, recall), "node", "left_semi").where("key != pivot").groupBy("key").agg(F.collect_set("pivot").alias("p"))
    ties = tied.select(F.explode(F.transform(F.concat(F.array("key"), "p"), lambda x: F.struct(x.alias("a"), F.array_min("p").alias("b")))).alias("e")).select("e.*")
    clusters = connected(ties).select(F.col("v").alias("key"), F.col("component").alias("cluster"))

    known = keep(clusters.join(distinct.select("key", "first", "copies", "n"), "key"))
    sizes = known.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    # written, so that the join below is of two plain exchanges, which can be split where a cluster is large
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = keep(sizes)
    tasks = max(1, math.ceil((known.agg(F.sum("n").alias("n")).first().n or 0) / BLOCK_SHINGLES * 4))
    placed = known.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    units = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "x")).withColumn("j", F.greatest("block", "x"))
    # small clusters share a task's table; a pair of blocks has one of its own
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.xxhash64("cluster", "i", "j").bitwiseOR(F.lit(1 << 62)))
    units = units.select("first", "cluster", "i", "j", "block", "key", "copies", task.alias("task"))

    wanted = known.select(F.coalesce(F.col("first").cast("string"), F.lit("")).alias("key")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    if 0 < (n := wanted.count()) <= MOST_FILTERED:
        bloom = Cascade()
        bloom.add(wanted, n, 0.01)
        texts = texts.where(bloom.level_has(F.coalesce(F.col("_id").cast("string"), F.lit("")), 0))
    rows = units.join(texts, F.col("first").eqNullSafe(F.col("_id"))).drop("first", "_id")
    verified = rows.groupBy("task").applyInArrow(lambda t: _verify(t, words, threshold), "key binary, joined binary, links long")
    verified = keep(verified)
    components = connected(verified.where("key != joined").select(F.col("key").alias("a"), F.col("joined").alias("b")).distinct())
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))

    named = distinct.select("key", "first", "copies").join(components.withColumnRenamed("v", "key"), "key", "left").join(links, "key", "left")
    named = keep(named.select("key", "first", "copies", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    # written, so that the join below is of two plain exchanges, which can be split where a class is large
    classes = keep(named.groupBy("component").agg(F.min("first").alias("class_id")))
    head = [F.when(F.col("class_id").isNull() & (F.col("key") == F.col("component")), F.col("key")).alias("head")] if heads else []
    named = keep(named.join(classes, "component").select("key", "class_id", "copies", (F.col("copies") - 1 + F.col("links")).alias("n_links"), *head))
    return sketched.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", F.col("copies").alias("n_copies"), "n_links", *["head"] * heads)


def keep_one(docs: DataFrame, words: int = 5, **options: float) -> DataFrame:
    """The rows of docs less those that aren't the first of their class; texts move only if the dropped ids are too many.

    Of rows without a doc_id one stays of each class that has no id at all.
    """
    judged = keep(join_similar(docs, words, heads=True, **options))
    stay = _first_ids(docs, judged)
    if judged.where("doc_id is null").isEmpty():
        return stay
    # one row a set in each task before anything is shuffled, however many copies there are
    nameless = with_set_key(docs.where(F.col("doc_id").isNull()).select("text", F.struct("*").alias("_row")), words)
    nameless = nameless.groupBy("key").agg(F.min_by("_row", F.coalesce("text", F.lit(""))).alias("_row"))
    heads = judged.where("head is not null").select(F.col("head").alias("key")).distinct()
    return stay.where(F.col("doc_id").isNotNull()).unionByName(nameless.join(heads, "key", "left_semi").select("_row.*"))


def _first_ids(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs that have the first id of their class, and all those without an id."""
    gone = keep(judged.where("doc_id != class_id").select(F.col("doc_id").cast("string").alias("key")).distinct())
    stay = docs
    n, total = gone.count(), judged.count()
    if 0 < n <= MOST_FILTERED:
        cascade = build_cascade(gone, judged.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("key")), n, total)
        stay = docs.where(F.col("doc_id").isNull() | ~cascade.contains(F.col("doc_id").cast("long").cast("string")))
    elif n:
        stay = docs.join(gone.withColumnRenamed("key", "_gone"), F.col("doc_id").cast("long").cast("string") == F.col("_gone"), "left_anti")
    again = judged.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return stay
    repeated = stay.join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by brute force: all pairs of different sets that share a shingle, and their closure.
ORACLE = rf"""
with recursive w as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws from documents),
d as (select rid, doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))) end sh from w),
k as (select rid, doc_id, md5(array_to_string(sh, chr(10))) k, sh from d),
c as (select k, count(*) copies, min(doc_id) first, any_value(sh) sh, len(any_value(sh)) n from k group by k),
x as (select k, n, unnest(sh) s from c),
e as (select a.k a, b.k b from x a join x b on a.s = b.s and a.k <> b.k and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by a.k, b.k, a.n, b.n
      having count(*) * 10 >= 8 * (a.n + b.n - count(*))),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select c.k, least(c.first, min(o.first)) class_id from c left join r on r.a = c.k left join c o on o.k = r.b group by c.k, c.first),
l as (select e.a k, sum(o.copies) links from e join c o on o.k = e.b group by e.a)
select doc_id, class_id, copies n_copies, (copies - 1 + coalesce(links, 0))::bigint n_links from k join c using (k) join m using (k) left join l using (k)
"""
