"""Mixing sources to target weights by Sainte-Laguë apportionment.

The token budget is cut into equal blocks of `block` tokens. Blocks go to sources by the highest
quotients target / (2k + 1), and each source's blocks go to its shards in the same way by the shards'
sizes, so every quota is an integer. Within a shard the documents stand in an order seeded by their
ids and contents, twice over (a document may be taken twice at most), and the shard's quota is a run of
that many blocks from a seeded place, round the end if need be. A document's share is how far it overlaps
that run: closed arithmetic, no list of blocks is ever made.

At scale: one pass over the texts for the sizes; what follows works on (doc_id, source, size, tie) rows.
Rows equal in all of these are one row with a number of copies before anything is ordered, and a source of
any size is split into shards of about `shard` tokens by id and content, so neither a source nor a doc_id
in a third of all rows (nor rows without one) makes a hot window. What is ranked over all sources, or over
all shards of one, is numbered by ranges of the order (`operators.ordered`), in no single task. The
quotients examined number about twice the parties (see `_apportion`), not the blocks.

Ties: rows of one doc_id and size are told apart by `tie`, which stands for their content; rows equal in
that too are interchangeable, so reruns agree. Defined results: a null text has size 0 and nothing is taken
of it; a null source is a source of its own, last; a null doc_id is ordered as an empty one; a text of any
length is one document; extra columns come back as they are, whatever they are called, but for those that
`mix` adds, which replace a column of their name; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import dense_number, running_sums
from .common import WORD, keep

ADDED = ("source_size", "target", "start", "taken")


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")


def content(docs: DataFrame) -> Column:
    """128 bits of all columns of a row."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *[F.struct(docs[c]) for c in docs.columns])), 16, "0") for i in (1, 2)])


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds rank and target to sources(source, source_size), one row each.

    The sources share `share` times all tokens by weight; none gets over `most` times its own size, and
    what is above is shared again by weight. That comes to one water level: sorted by cap / weight, the
    first sources are capped, and the level is what is left over the weights that are left.
    """
    named = sources.select("source", "source_size", F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_name"))
    ranked = dense_number(named, ["_last", "_name"], "rank").withColumn("rank", F.col("rank") + 1).drop("_last", "_name")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = keep(running_sums(ranked, ["ratio", "rank"], {"cap": "_capped", "weight": "_spent"}, "double"))
    every = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()  # three numbers
    level = (F.lit(float(share) * (every["size"] or 0)) - F.col("_capped")) / (F.lit(float(every["weight"] or 0)) - F.col("_spent"))
    first = ranked.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "rank")).alias("level")).first()["level"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def _apportion(parties: DataFrame, group: list[str], party: list[str], weight: str, seats: Column, most: Column) -> DataFrame:
    """Adds `quota` to the parties: `seats` of their group by Sainte-Laguë, at most `most` each. Names aren't null.

    With P parties and n seats the last quotient that wins lies between W / (n + P/2) and W / (n - P/2),
    so a party has at least round(w (n - P/2) / W) seats and at most round(w (n + P/2) / W): only the
    quotients between are ranked, P at most besides roundings. They are ranked by ranges of (group,
    quotient), so a group of any size is in as many tasks as it takes.
    """
    totals = parties.groupBy(*group).agg(F.sum(weight).cast("double").alias("_w"), (F.count("*") / 2).alias("_p"))
    p = parties.withColumn("_n", seats.cast("double")).join(totals, group)
    at = lambda n: F.floor(F.coalesce(F.try_divide(F.col(weight) * F.greatest(n, F.lit(0.0)), F.col("_w")), F.lit(0.0)) + 0.5)
    p = keep(p.withColumn("_low", at(F.col("_n") - F.col("_p"))).withColumn("_high", at(F.col("_n") + F.col("_p"))))
    left = p.groupBy(*group).agg((F.first("_n") - F.sum("_low")).alias("_left"))
    more = p.where(F.col("_high") > F.col("_low")).select(*group, *party, F.col(weight).alias("_of"), F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    more = dense_number(more.withColumn("_less", -F.col("_of") / (2 * F.col("_k") + 1)), [*group, "_less", *party], "_i")
    begin = more.groupBy(*group).agg(F.min("_i").alias("_begin"))
    won = more.join(begin, group).join(left, group).where(F.col("_i") - F.col("_begin") < F.col("_left"))
    won = won.groupBy(*group, *party).agg(F.count("*").alias("_won"))
    return p.join(won, [*group, *party], "left").select(*parties.columns, F.least(F.col("_low") + F.coalesce("_won", F.lit(0)), most).cast("long").alias("quota"))


def _placed(rows: DataFrame, weights: list[float], share: float, most: int, block: int, shard: int, seed: int) -> DataFrame:
    """rows(doc_id, source, size, tie) -> these with source_size, target, start and taken; a row for each of the rows."""
    groups = keep(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("_copies")))
    sources = keep(targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size")), list(weights), share, most))
    sources = sources.withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)))
    total = sources.agg(F.sum("target").alias("t")).first()["t"] or 0.0  # one number
    quotas = _apportion(sources.withColumn("_one", F.lit(0)), ["_one"], ["rank"], "target", F.round(F.lit(total) / block), F.ceil(F.col("source_size") * most / block))
    quotas = keep(quotas.drop("_one"))

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie"))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    quotas = quotas.select(F.col("source").alias("_source"), "source_size", "target", "rank", "_shards", F.col("quota").alias("_seats"))
    placed = groups.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = keep(placed.withColumn("_order", digest).withColumn("_shard", F.pmod(number, F.col("_shards"))))
    shards = placed.groupBy("rank", "_shard").agg(F.sum(F.col("size") * F.col("_copies")).alias("_size"), F.first("_seats").alias("_seats"))
    shards = _apportion(shards, ["rank"], ["_shard"], "_size", F.col("_seats"), F.ceil(F.col("_size") * most / block))
    shards = keep(shards.select(F.col("rank").alias("_rank"), F.col("_shard").alias("_at"), "_size", F.col("quota").alias("_quota")))

    inside = Window.partitionBy("rank", "_shard").orderBy("_order", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inside), F.lit(0))
    laid = placed.withColumn("_begin", begin).join(shards, (F.col("rank") == F.col("_rank")) & (F.col("_shard") == F.col("_at")))
    laid = laid.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).withColumn("_begin", F.col("_begin") + F.col("size") * F.col("_copy"))
    first = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"run {seed}"), "rank", "_shard")), 1, 15), 16, 10).cast("long")
    full = F.col("_size") * most
    laid = laid.withColumn("_full", full).withColumn("_long", F.least(F.col("_quota") * block, full)).withColumn("_first", F.floor(F.coalesce(F.try_mod(first, full), F.lit(0)) / block) * block)
    # [0, _full) is a ring; each copy of a document meets the run [_first, _first + _long) or the part of it that is carried over
    overlap = lambda a, b: F.greatest(F.least(a + F.col("size"), b + F.col("_long")) - F.greatest(a, b), F.lit(0))
    copies = [F.col("_begin") + F.col("_size") * c for c in range(most)]
    taken = sum((overlap(a, F.col("_first")) + overlap(a, F.col("_first") - F.col("_full")) for a in copies), F.lit(0))
    # where the run begins inside a copy, the taken words begin there; else at the document's first word
    start = F.coalesce(*[F.when((F.col("_first") > a) & (F.col("_first") < a + F.col("size")), F.col("_first") - a) for a in copies], F.lit(0))
    return laid.select("doc_id", "source", "size", "tie", "source_size", "target", start.cast("long").alias("start"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 16, shard: int = 1 << 20, seed: int = 7, tie: str | None = None) -> DataFrame:
    """docs(doc_id, source, size): adds source_size, target, start and taken.

    A document's taken words are those from `start` on, counted round its `most` copies: taken // size
    whole copies and a rest. `block` tokens is the unit of the quotas. `tie` names the column that tells
    rows of one doc_id, source and size apart, where these four are all there is (it then comes back too);
    without it all columns do.
    """
    options = (weights, share, most, block, shard, seed)
    if tie is not None:
        return _placed(docs.select("doc_id", "source", "size", F.col(tie).alias("tie")), *options).withColumnRenamed("tie", tie)
    rows = docs.select("doc_id", "source", "size", content(docs).alias("tie"), F.struct("*").alias("_row"))
    mixed = _with_rows(rows, _placed(rows.drop("_row"), *options))
    return mixed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def _with_rows(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds `_row` to what was placed, by the tie. Rows equal in all columns travel as one."""
    own = rows.groupBy(F.col("tie").alias("_tie")).agg(F.first("_row").alias("_row"))
    return placed.join(own, F.col("tie") == F.col("_tie")).drop("_tie")


def take(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 16, shard: int = 1 << 20, seed: int = 7) -> DataFrame:
    """The rows of docs as the mix takes them: whole ones as often as they are taken, and parts by words.

    n_chars, where there is one, is made to fit the part. The texts travel once, by the tie, never through
    a window.
    """
    rows = docs.select("doc_id", "source", sizes(docs).alias("size"), content(docs).alias("tie"), F.struct("*").alias("_row"))
    placed = _placed(rows.drop("_row"), weights, share, most, block, shard, seed).where("taken > 0")
    mixed = _with_rows(rows, placed)
    piece = lambda begin, n: F.struct(begin.cast("long").alias("at"), n.cast("long").alias("n"))
    head = F.when(F.col("start") > 0, F.least(F.col("size") - F.col("start"), F.col("taken"))).otherwise(F.lit(0))
    left = F.col("taken") - head
    whole, rest = F.try_divide(left - F.col("left_over"), F.col("size")), F.col("left_over")
    mixed = mixed.withColumn("left_over", F.coalesce(F.try_mod(left, F.col("size")), F.lit(0)))
    pieces = F.concat(F.array(piece(F.col("start"), head)), F.array_repeat(piece(F.lit(0), F.col("size")), F.coalesce(whole, F.lit(0)).cast("int")), F.array(piece(F.lit(0), rest)))
    parts = mixed.where("taken > 0").select("_row", "size", F.explode(F.filter(pieces, lambda p: p["n"] > 0)).alias("p"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(words, F.col("p.at").cast("int") + 1, F.col("p.n").cast("int")), ""), r"^[\x20\x09-\x0D]+", "")
    parts = parts.withColumn("_text", F.when(F.col("p.n") == F.col("size"), F.col("_row.text")).otherwise(cut))
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("_text").cast(docs.schema["n_chars"].dataType))
    return parts.select(row.alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", sizes(docs).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    return mix(rows, tie="content").select("doc_id", "size", "source_size", "target", "taken")


#: The same with all quotients of all seats ranked.
ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, source, md5(coalesce(text, '')) tie, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rnk from d group by source),
w as (select *, [3.0::double, 1, 2][(rnk - 1) % 3 + 1] weight, 2.0::double * source_size cap from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rnk rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by cap / weight, rnk rows between current row and unbounded following) level from w),
e as (select arg_min(level, (cap / weight, rnk)) level from l where level * weight <= cap),
t as (select source, source_size, rnk, least(cap, coalesce(e.level * weight, cap)) target, greatest(ceil(source_size / 1048576), 1)::bigint shards from l left join e on true),
n as (select round(sum(target) / 16)::bigint seats from t),
q as (select rnk, row_number() over (order by target / (2 * k + 1) desc, rnk) i from (select rnk, target, unnest(range((select seats from n))) k from t)),
g as (select rnk, least(count(*), max(ceil(source_size * 2 / 16)))::bigint seats from q join t using (rnk) where i <= (select seats from n) group by rnk),
p as (select d.*, source_size, target, rnk, coalesce(seats, 0) seats, md5('7:' || coalesce(doc_id::varchar, '') || ':' || tie) mark, ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || tie), 1, 15))::bigint % shards shard
      from d join t on d.source is not distinct from t.source left join g using (rnk)),
h as (select rnk, shard, sum(size)::bigint full_size, any_value(seats) seats from p group by rnk, shard),
hq as (select rnk, shard, seats, row_number() over (partition by rnk order by full_size / (2 * k + 1) desc, shard) i from (select *, unnest(range(seats)) k from h)),
hn as (select rnk, shard, count(*) quota from hq where i <= seats group by rnk, shard),
r as (select rnk, shard, 2 * full_size ring, least(least(coalesce(quota, 0), ceil(full_size * 2 / 16)::bigint) * 16, 2 * full_size) long,
             case when full_size > 0 then ('0x' || substr(md5('run 7:' || rnk || ':' || shard), 1, 15))::bigint % (2 * full_size) // 16 * 16 else 0 end first, full_size
      from h left join hn using (rnk, shard)),
b as (select *, coalesce(sum(size) over (partition by rnk, shard order by mark, doc_id nulls first, tie, size rows between unbounded preceding and 1 preceding), 0)::bigint place from p),
o as (select rid, doc_id, size, source_size, target, place + copy.c * full_size place, first - lap.c * ring start, long
      from b join r using (rnk, shard), (values (0), (1)) copy(c), (values (0), (1)) lap(c))
select any_value(doc_id) doc_id, any_value(size) size, any_value(source_size) source_size, any_value(target) target,
       sum(greatest(least(place + size, start + long) - greatest(place, start), 0))::bigint taken
from o group by rid
"""
