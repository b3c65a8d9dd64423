"""Document fingerprints: a Merkle tree over sections and paragraphs.

A document's sections are its lines; a section's paragraphs are its pieces up to a sentence end, of at
most `PIECE` code points. A paragraph's hash is of its text, a section's of its paragraphs' hashes and
the root's of its sections' hashes. The fingerprint is the root, ":", and the paragraphs' hashes, with
"." between them and "/" between sections. So equal roots say equal texts, and where roots differ the
branches say which sections and paragraphs were edited: `tree` has the hashes of all nodes, and `edits`
goes down from the root into those sections only whose hashes differ.

At scale: a fingerprint is made inside the scan, in one row. The next document by doc_id comes from
ranges of ids with approximate quantiles as bounds, one shuffle; a range's last document gets its
successor from the first document of the next range, which is dealt to both. With distinct ids no range
holds more than its share, and nothing is sorted in one task.

Defined results: a null text is empty; an empty text has one empty section; null doc_ids come first;
documents of one doc_id are ordered by text, equal ones after each other; the last document is
followed by the first (by itself if it is alone); a text of any length is taken whole; extra columns are
left out, whatever they are called; an empty table gives an empty result. All rows of one doc_id, and all
without one, are in one range and so in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 96
PARAGRAPH = rf"[^.!?]{{0,{PIECE - 1}}}[.!?]|[^.!?]{{1,{PIECE}}}"
#: Hex digits of a paragraph's hash in the fingerprint; sections and roots keep all 32.
DIGITS = 8


def tree(text: Column) -> Column:
    """All nodes of a text that is not null: the root's hash, and the sections with their hashes and their paragraphs' ones."""
    sections = F.transform(F.split(text, "\n"), lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p)))
    branches = F.transform(sections, lambda hashes: F.struct(F.md5(F.array_join(hashes, "")).alias("hash"), hashes.alias("paragraphs")))
    return F.struct(F.md5(F.array_join(branches["hash"], "")).alias("root"), branches.alias("sections"))


def mark(nodes: Column) -> Column:
    """The fingerprint of a tree."""
    leaves = F.transform(nodes["sections"], lambda s: F.array_join(F.transform(s["paragraphs"], lambda h: F.substring(h, 1, DIGITS)), "."))
    return F.concat(nodes["root"], F.lit(":"), F.array_join(leaves, "/"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null."""
    return F.element_at(F.transform(F.array(tree(text)), mark), 1)


def edits(a: Column, b: Column) -> Column:
    """(section, paragraph) of each place, from 0, at which two trees differ, by going down where hashes do; empty for equal roots.

    A section that only one tree has and that holds no paragraph is given with paragraph -1.
    """
    places = lambda x, y: F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    hashes, none = lambda t: F.transform(t["sections"], lambda s: s["hash"]), F.array().cast("array<string>")
    own = lambda t, i: F.coalesce(F.get(t["sections"], i)["paragraphs"], none)

    def within(i: Column) -> Column:
        x, y = own(a, i), own(b, i)
        at = F.when((F.size(x) == 0) & (F.size(y) == 0), F.array(F.lit(-1))).otherwise(places(x, y))
        return F.transform(at, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    differ = F.flatten(F.transform(places(hashes(a), hashes(b)), within))
    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(differ)


def paragraphs(mark: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring_index(mark, ":", -1), "[./]"), lambda h: h != ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs of two fingerprints over all of theirs, each distinct one once; 1 for equal roots."""
    x, y = paragraphs(a), paragraphs(b)
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).when(every == 0, F.lit(0.0)).otherwise(both / every)


def first_edit(a: Column, b: Column) -> Column:
    """The first section, from 0, at which the trees differ; null for equal roots."""
    x, y = F.split(F.substring_index(a, ":", -1), "/"), F.split(F.substring_index(b, ":", -1), "/")
    places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    other = F.filter(places, lambda i: ~F.coalesce(F.get(x, i), F.lit("-")).eqNullSafe(F.coalesce(F.get(y, i), F.lit("-"))))
    return F.when(F.substring_index(a, ":", 1) != F.substring_index(b, ":", 1), F.coalesce(F.get(other, F.lit(0)), F.lit(0)))


def with_next(docs: DataFrame, order: str, tie: str, columns: list[str], made: dict[str, Column], ranges: int) -> DataFrame:
    """Adds what is `made` of a row, and next_<c> for each of the columns: those of the next row by (order, tie), the first one's after the last."""
    facts = docs.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("q"), F.min(order).alias("least"), F.count_if(F.col(order).isNull()).alias("nulls")).first()
    bounds = sorted(set(facts.q or []) - {facts.least})
    cut = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    dealt = docs.withColumn("_range", F.size(F.filter(cut, lambda b: b <= F.col(order)))).withColumn("_copy", F.lit(0))
    # the first rows of each range, once more at the end of the range before; the very first rows after all
    heads = docs.where(F.col(order).isin(bounds)).withColumn("_range", F.size(F.filter(cut, lambda b: b < F.col(order)))).withColumn("_copy", F.lit(1))
    very_first = docs.where(F.col(order).isNull() if facts.nulls else F.col(order) == F.lit(facts.least)).withColumn("_range", F.lit(len(bounds))).withColumn("_copy", F.lit(2))
    rows = dealt.unionByName(heads).unionByName(very_first).repartition("_range")
    rows = rows.select("*", *[x.alias(c) for c, x in made.items()])  # made where the rows have come to, so that it doesn't travel
    inside = Window.partitionBy("_range").orderBy("_copy", F.col(order).asc_nulls_first(), tie)
    return rows.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_range", "_copy")


def compare(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text): fingerprints of each text and of it with its last quarter replaced by the next one's first."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(whole, "doc_id", "text", ["text", "mark"], {"mark": fingerprint(F.col("text"))}, ranges)
    n = F.char_length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    made = pairs.select("doc_id", n.alias("n_chars"), "mark", "next_mark", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "mark", "next_mark", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_mark"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", F.col("mark").alias("fingerprint"), F.col("edited_mark").alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"), first_edit(F.col("mark"), F.col("edited_mark")).alias("edited_section"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n from documents),
nx as (select doc_id, t, n, coalesce(lead(t) over (order by doc_id, t), first_value(t) over (order by doc_id, t)) nt from d),
e as (select doc_id, n, t, nt, substr(t, 1, n - n // 4) || substr(nt, 1, n // 4) ed from nx),
f as (select *, list_transform(string_split(t, chr(10)), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: md5(p))) a,
             list_transform(string_split(ed, chr(10)), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: md5(p))) b,
             list_transform(string_split(nt, chr(10)), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: md5(p))) c from e),
g as (select doc_id, n, sha256(ed) edited_sha256,
             md5(coalesce(array_to_string(list_transform(a, lambda h: md5(coalesce(array_to_string(h, ''), ''))), ''), '')) ra,
             md5(coalesce(array_to_string(list_transform(b, lambda h: md5(coalesce(array_to_string(h, ''), ''))), ''), '')) rb,
             md5(coalesce(array_to_string(list_transform(c, lambda h: md5(coalesce(array_to_string(h, ''), ''))), ''), '')) rc,
             list_transform(a, lambda h: coalesce(array_to_string(list_transform(h, lambda x: substr(x, 1, {DIGITS})), '.'), '')) pa,
             list_transform(b, lambda h: coalesce(array_to_string(list_transform(h, lambda x: substr(x, 1, {DIGITS})), '.'), '')) pb,
             list_distinct(list_transform(flatten(a), lambda x: substr(x, 1, {DIGITS}))) sa, list_distinct(list_transform(flatten(b), lambda x: substr(x, 1, {DIGITS}))) sb,
             list_distinct(list_transform(flatten(c), lambda x: substr(x, 1, {DIGITS}))) sc from f)
select doc_id, n::bigint n_chars, edited_sha256, ra || ':' || array_to_string(pa, '/') fingerprint, rb || ':' || array_to_string(pb, '/') edited_fingerprint,
       case when ra = rb then 1.0::double when len(sa) + len(sb) = 0 then 0.0::double else len(list_intersect(sa, sb))::double / (len(sa) + len(sb) - len(list_intersect(sa, sb))) end near_edited,
       case when ra = rc then 1.0::double when len(sa) + len(sc) = 0 then 0.0::double else len(list_intersect(sa, sc))::double / (len(sa) + len(sc) - len(list_intersect(sa, sc))) end near_next,
       case when ra <> rb then coalesce(list_min(list_filter(range(0, greatest(len(pa), len(pb))), lambda i: coalesce(pa[i + 1], '-') <> coalesce(pb[i + 1], '-'))), 0)::integer end edited_section
from g
"""
