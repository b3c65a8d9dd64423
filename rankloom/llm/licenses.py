"""License scan: a positional index of rare tokens over license templates.

A template is a row of words; "*" stands for any one word. Some of its words form its mandatory key phrases
(of a short phrase, all of them; in a longer text what stands between brackets). The index has, for each
word of the templates, its postings: (template, position). Words are weighed by idf over all files.

Of a file its license words and their places are kept. Looked up are the file's `rare` highest-idf license
words (ties by the alphabet), and besides them those words that are the rarest of some template, so that no
whole match is lost whatever else the file has. Each place of a word looked up, less its position in a
posting, is an alignment of the posting's template; equal ones meet (the intersection by relative
position). An alignment is verified if all words of the template's key phrases stand at their places.

Labels: `labels` are those of all templates verified in the file; `places` has every verified place.
The score is, over the alignments, the greatest share of the template's idf mass that stands at its place:
1 for a whole license, less for a damaged or shuffled one.

At scale: one pass over the texts makes (doc_id, number of words, license words' places), a few numbers a
file; the rest works on that table, written once. Nothing is grouped by file; the idf counts are one row a
license word. The index goes into the plan as one value, however many templates it has; the work for a file
follows the postings of what is looked up.

Defined results: a null text is empty; without license words there are no places, empty labels and score 0;
a text of any length is scanned whole; repeated rows are judged alike; extra columns are left out, whatever
they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: The phrases and license texts looked for, with their labels; the first three are the base ones.
#: Small words of the texts are "*", and their mandatory key phrases stand between brackets.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("cc0 1 0 universal", "cc0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("bsd 2 clause", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "bsl"),
    ("permission * hereby granted free * charge * any person obtaining", "mit"),
    ("redistribution * use * source * binary forms", "bsd"),
    ("all rights reserved", "proprietary"),
    (
        "[ permission * hereby granted free * charge * any person obtaining * copy ] * * software * associated documentation files * * deal * * software without restriction"
        " including without limitation * rights * use copy modify merge publish distribute sublicense * * sell copies * * software [ * * permit persons * whom * software ] * furnished * * * subject * * following conditions",
        "mit",
    ),
    (
        "[ redistribution * use * source * binary forms ] with * without modification * permitted provided * * following conditions * met"
        " [ redistributions * source code must retain * above copyright notice ] * list * conditions * * following disclaimer",
        "bsd",
    ),
    ("[ permission * use copy modify * * distribute * software * any purpose with * without fee * hereby granted ] provided * * above copyright notice * * permission notice appear * all copies", "isc"),
    ("[ licensed under * apache license version 2 0 ] * * license * may * use * file except * compliance with * license * may obtain * copy * * license", "apache"),
    (
        "[ * program * free software * can redistribute * * * modify * under * terms * * gnu general public license ] * published * * free software foundation either version",
        "gpl",
    ),
    ("[ * source code form * subject * * terms * * mozilla public license v 2 0 ] * * copy * * mpl * * distributed with * file * can obtain one", "mpl"),
    ("[ * * free * unencumbered software released into * public domain ] anyone * free * copy modify publish use compile sell * distribute * software", "unlicense"),
    ("[ * software * provided * * without any express * implied warranty ] * * event will * authors * held liable * any damages arising * * use * * software", "zlib"),
]
BASE = 3
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Index:
    """Templates with their words' numbers (-1: any word), which of them are key, their labels, and the postings by word."""

    def __init__(self, phrases: list[tuple[str, str]]) -> None:
        self.labels = [label for _, label in phrases]
        self.templates: list[list[str]] = []
        self.keys: list[list[bool]] = []
        for text, _ in phrases:
            inside, words, keys = "[" not in text, [], []
            for w in text.split():
                if w in "[]":
                    inside = w == "["
                else:
                    words.append(w)
                    keys.append(inside and w != "*")
            self.templates.append(words)
            self.keys.append(keys)
        self.words = sorted({w for t in self.templates for w in t if w != "*"})
        self.numbers = {w: i for i, w in enumerate(self.words)}
        self.rows = [[self.numbers.get(w, -1) for w in t] for t in self.templates]
        self.postings = [[{"t": t, "p": p} for t, row in enumerate(self.rows) for p, w in enumerate(row) if w == i] for i in range(len(self.words))]

    def value(self, weights: list[float]) -> Column:
        """All of it as one value of the plan; `order` has the words' places from the highest idf down, `rarest` the templates' rarest words."""
        order = sorted(range(len(weights)), key=lambda w: (-weights[w], w))
        rank = {w: i for i, w in enumerate(order)}
        rarest = sorted({min((w for w in row if w >= 0), key=rank.__getitem__) for row in self.rows})
        mass = [sum(weights[w] for w in row if w >= 0) for row in self.rows]
        templates = [{"label": label, "row": row, "key": keys, "mass": m} for label, row, keys, m in zip(self.labels, self.rows, self.keys, mass, strict=True)]
        found = {"templates": templates, "postings": self.postings, "weights": weights, "ranks": [rank[w] for w in range(len(weights))], "rarest": rarest}
        kind = "templates array<struct<label:string,row:array<int>,key:array<boolean>,mass:double>>, postings array<array<struct<t:int,p:int>>>, weights array<double>, ranks array<int>, rarest array<int>"
        return F.from_json(F.lit(json.dumps(found)), kind)


def license_words(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_words, hits): hits has the place and number of each license word in the file, in order."""
    # (?i) of Java without (?u) folds A-Z only; [0-9A-Za-z] and all beyond ASCII are the word's characters
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([0-9A-Za-z\x80-\x{10FFFF}]+)"), F.lit(1))
    numbers = F.create_map(*[x for n, w in enumerate(index.words) for x in (F.lit(w), F.lit(n))])
    split = docs.select("doc_id", words.alias("words"))
    # lower() is exact for words of ASCII only; others are no license words
    listed = lambda w: (F.octet_length(w) == F.char_length(w)) & F.lower(w).isin(index.words)
    known = F.filter(F.transform("words", lambda w, i: F.when(listed(w), F.struct(i.alias("at"), F.element_at(numbers, F.lower(w)).alias("word")))), lambda x: x.isNotNull())
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), known.alias("hits"))


def word_weights(hits: DataFrame, index: Index) -> list[float]:
    """The idf of each license word over all files."""
    total = hits.count()
    found = hits.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count().collect()  # a row a license word at most
    counts = {r["word"]: r["count"] for r in found}
    return [math.log((total + 1) / (counts.get(i, 0) + 1)) + 1 for i in range(len(index.words))]


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, rare: int = 8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, places (array of label, template, start), labels (array), score."""
    index = Index(phrases)
    hits = keep(license_words(docs, index))
    value = index.value(word_weights(hits, index))
    looked = hits.where(F.size("hits") > 0).select("*", value.alias("ix"))

    # the file's highest-idf words, as ranks; the words looked up are those and the templates' rarest
    ranks = F.slice(F.array_sort(F.transform(F.array_distinct(F.col("hits.word")), lambda w: F.get(F.col("ix.ranks"), w))), 1, rare)
    looked = looked.select("doc_id", "n_words", "hits", "ix", ranks.alias("top"))
    up = F.filter("hits", lambda h: F.array_contains("top", F.get(F.col("ix.ranks"), h["word"])) | F.array_contains(F.col("ix.rarest"), h["word"]))
    align = lambda h: F.transform(F.get(F.col("ix.postings"), h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["p"]).alias("s")))
    looked = looked.select("doc_id", "n_words", "hits", "ix", F.array_distinct(F.flatten(F.transform(up, align))).alias("alignments"))
    # the license word at each place of the file, -1 where there is none, up to the last one
    gap = lambda h, i: F.array_repeat(F.lit(-1), h["at"] - F.coalesce(F.get(F.col("hits.at"), i - 1), F.lit(-1)) - 1)
    looked = looked.withColumn("row", F.flatten(F.transform("hits", lambda h, i: F.concat(gap(h, i), F.array(h["word"])))))
    judged = looked.select("doc_id", "n_words", F.transform("alignments", _judge).alias("judged"))
    verified = F.filter("judged", lambda a: a["whole"])
    judged = judged.select(
        "doc_id", "n_words", F.transform(verified, lambda a: F.struct(a["label"].alias("label"), a["t"].alias("template"), a["s"].alias("start"))).alias("places"),
        F.round(F.coalesce(F.array_max(F.transform("judged", lambda a: a["share"])), F.lit(0.0)), 9).alias("score"),
    )
    none = F.array().cast("array<struct<label:string,template:int,start:int>>")
    found = judged.unionByName(hits.where(F.size("hits") == 0).select("doc_id", "n_words", none.alias("places"), F.lit(0.0).alias("score")))
    return found.select("doc_id", "n_words", "places", F.array_sort(F.array_distinct(F.col("places.label"))).alias("labels"), "score")


def _judge(a: Column) -> Column:
    """An alignment's label, template, start, whether its key phrases stand there, and its share of the template's mass."""
    template = F.get(F.col("ix.templates"), a["t"])
    there = lambda w, i: (w >= 0) & F.coalesce(F.get(F.col("row"), F.when(a["s"] + i >= 0, a["s"] + i)) == w, F.lit(False))
    stands = F.transform(template["row"], there)
    whole = F.forall(F.zip_with(stands, template["key"], lambda x, k: x | ~k), lambda x: x)
    inside = (a["s"] >= 0) & (a["s"] + F.size(template["row"]) <= F.col("n_words"))
    parts = F.zip_with(stands, template["row"], lambda x, w: F.when(x, F.get(F.col("ix.weights"), w)).otherwise(F.lit(0.0)))
    share = F.reduce(parts, F.lit(0.0), lambda x, y: x + y) / template["mass"]
    return F.struct(template["label"].alias("label"), a["t"].alias("t"), a["s"].alias("s"), (whole & inside).alias("whole"), share.alias("share"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.filter("places", lambda p: p["template"] < BASE)
    found = scan(docs).withColumn("base", base)
    starts = F.col("base.start")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _oracle(phrases: list[tuple[str, str]], rare: int = 8) -> str:
    """The query by brute force: each template is tried wherever one of its words stands; the score is over the alignments of the words looked up."""
    index = Index(phrases)
    listed = ", ".join(f"({i}, '{index.labels[i]}', {p}, '{w}', {len(t)}, {str(index.keys[i][p]).lower()})" for i, t in enumerate(index.templates) for p, w in enumerate(t) if w != "*")
    return rf"""
with listed(template, label, pos, word, len, key) as (values {listed}),
t as (select *, count_if(key) over (partition by template) own from listed),
d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TOKEN}') ws from documents),
h as (select * from (select rid, unnest(ws) word, unnest(range(len(ws))) place from d) where word in (select word from t)),
c as (select word, count(distinct rid) n from h group by word),
idf as (select word, ln(((select count(*) from d) + 1.0::double) / (coalesce(n, 0) + 1)) + 1 weight from (select distinct word from t) left join c using (word)),
p as (select rid, template, any_value(label) label, place - pos start from h join t using (word) join d using (rid)
      group by rid, template, place - pos having count_if(key) = any_value(own) and place - pos >= 0 and place - pos + any_value(len) <= any_value(len(ws))),
f as (select rid, count_if(template < {BASE}) n_base, min(start) filter (template < {BASE}) first_word, max(start) filter (template < {BASE}) last_word,
             list_sort(list(distinct label) filter (template < {BASE})) base_labels, list_sort(list(distinct label)) labels from p group by rid),
m as (select template, list_reduce(list(weight order by pos), lambda a, b: a + b) mass from t join idf using (word) group by template),
r as (select rid, word, row_number() over (partition by rid order by weight desc, word) i from (select distinct rid, word from h) join idf using (word)),
u as (select rid, word from r where i <= {rare} or word in (select arg_min(word, (-weight, word)) from t join idf using (word) group by template)),
a as (select distinct rid, template, place - pos start from h join u using (rid, word) join t using (word)),
s as (select a.rid, a.template, a.start, list_reduce(list(weight order by pos), lambda x, y: x + y) part
      from a join t using (template) join h on h.rid = a.rid and h.place = a.start + t.pos and h.word = t.word join idf on idf.word = t.word group by all),
b as (select rid, max(part / mass) score from s join m using (template) group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') base_labels,
       coalesce(array_to_string(labels, ','), '') labels, round(coalesce(score, 0), 9) score
from d left join f using (rid) left join b using (rid)
"""


ORACLE = _oracle(PHRASES)
