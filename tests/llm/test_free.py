"""Media columns, the Jaccard join, packing, the language model and the classifier."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankloom.llm import jaccard, lm, media, mixing, packing, quality, url_filter
from rankloom.llm.common import run_hashes, text_chunks, word_hashes

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [(0, "Hello there, the World."), (1, None), (2, ""), (3, "é à\nb"), (4, LONG), (4, LONG), (None, "x y"), (6, "<|endoftext|> odd's 12   ΣΑΣ"), (7, "a" * 64)]


def test_word_hashes():
    texts = ["a b  a", "", "\tA é\n", "x" * 5000, "b"]
    for most in (1, 4, 10_000):
        got = []
        for _, _, data, offsets in text_chunks(pa.array(texts)[0:], most):
            h, first = word_hashes(data, offsets)
            got += [h[a:b].tolist() for a, b in itertools.pairwise(first)]
        assert [len(x) for x in got] == [3, 0, 2, 1, 1]
        assert got[0][0] == got[0][2] != got[0][1] == got[4][0]
        assert len({x for g in got for x in g}) == 5
    assert len(run_hashes(np.frombuffer(b"a!!b", np.uint8), np.array([0, 4]), quality._CLASSES)[0]) == 3
    assert [x[:2] for x in text_chunks(pa.array([None, "ab"]).slice(1, 1))] == [(0, 1)]


# ---- media ----


def test_media_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("media", F.lit(1)).repartition(3)
    payloads = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    assert media.write_archives(payloads, str(tmp_path / "m"), archive_bytes=4000) >= 3
    for small in (300, 1 << 20):  # ranges far smaller than a member, and larger than an archive
        got = media.read_archives(spark, f"file:{tmp_path}/m", range_bytes=small, batch_bytes=1).collect()
        assert sorted([(r.doc_id, r.n_bytes, bytes(r.payload)) for r in got], key=str) == sorted([(i, len((t or "").encode()), media.padded((t or "").encode())) for i, t in TEXTS], key=str)
    assert media.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert media.write_archives(payloads.where("false"), str(tmp_path / "e")) == 0


def test_media_query_by_brute_force(spark, sf):
    texts = collections.Counter((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = collections.Counter()
    for (i, t), times in texts.items():
        data = t.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        image = media.to_image(data)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(image), sha(image), media.describe(payload)] += times
    assert collections.Counter(map(tuple, media.query(spark, sf).collect())) == want


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100_000])
def test_images_hold_the_bytes(n):
    data = random.Random(n).randbytes(n)
    payload, length = media.from_image(media.to_image(data))
    assert (payload, length) == (media.padded(data), n)
    assert len(payload) % 64 == 0 < len(payload)


def test_a_damaged_member_fails_alone(spark, tmp_path):
    payloads = spark.createDataFrame([(i, bytes([i]) * 5000) for i in range(5)], "doc_id long, payload binary").coalesce(1)
    media.write_archives(payloads, str(tmp_path))
    (path,) = tmp_path.glob("*.zip")
    raw = bytearray(path.read_bytes())
    at = raw.index(b"IDAT", raw.index(b"_2.png"))
    raw[at + 10] ^= 1
    path.write_bytes(raw)
    got = {r.doc_id: r for r in media.read_archives(spark, str(tmp_path), onerror="null").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [i for i in got if got[i].error] == [2]
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, str(tmp_path)).collect()


def test_a_member_is_read_again_by_itself(tmp_path):
    image = media.to_image(b"abc")
    (tmp_path / "f").write_bytes(b"PK\x03\x04" + bytes(26) + image)
    calls = []

    class Flaky:
        def read_at(self, n, at):
            calls.append(at)
            if len(calls) < 3:
                raise OSError("gone")
            return (tmp_path / "f").read_bytes()[at : at + n]

    class Store:
        def open_input_file(self, _):
            return Flaky()

    reader = media.MediaReader({"path": "x"})
    _, row = reader.member(Store(), "f", Flaky(), 0, "0_9.png", len(image), zlib.crc32(image))
    assert row[0] == 9
    assert row[2][:3] == b"abc"
    assert calls == [0, 0, 0, 30]


# ---- Jaccard ----


def brute_classes(docs, words=5, threshold=0.8):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    links, up = [0] * len(docs), list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both / max(1, len(sets[i] | sets[j])) >= threshold:
            links[i] += 1
            links[j] += 1
            up[root(j)] = root(i)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[root(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, least[root(i)], links[i]) for i, (d, _) in enumerate(docs)]


def near_copies(seed, n=60):
    r = random.Random(seed)
    base = [[f"t{r.randrange(300)}" for _ in range(r.randrange(1, 90))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"z{r.randrange(5)}"
        docs.append((i, " ".join(w)))
    return [*docs, (200, None), (201, ""), (202, " \n"), (5, docs[5][1]), (None, docs[7][1]), (300, LONG), (301, LONG + " end")]


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 7)])
def test_classes_and_links(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)  # small blocks: clusters are verified by pairs of them
    docs = near_copies(seed)
    got = jaccard.join_similar(spark.createDataFrame(docs, DOCS).withColumn("key", F.lit(1)).withColumn("n", F.lit(1)))
    assert rows(got, "doc_id", "class_id", "n_links") == sorted(brute_classes(docs), key=str)


@pytest.mark.parametrize("most", [12_000_000, 0])
def test_one_of_each_class_stays(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_FILTERED", most)  # the wanted ids in a filter, or joined
    docs = near_copies(3)
    df = spark.createDataFrame(docs, DOCS).withColumn("key", F.lit("k"))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, c, _ in brute_classes(docs)}
    got = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(got) == sorted(want)
    assert jaccard.keep_one(df.where("false")).count() == 0


def test_rows_without_an_id_count_by_class(spark):
    base = [[f"{c}{i}" for i in range(60)] for c in "abcde"]
    near = lambda c: " ".join([*base[c][:-1], "other"])
    text = [" ".join(b) for b in base]
    docs = [(1, text[0]), (2, near(0)), (None, text[0]), (None, near(0))]  # beside ids
    docs += [(None, text[1])] * 3  # exact copies, no id
    docs += [(None, text[2]), (None, near(2)), (None, "  " + text[2])]  # near ones, no id
    docs += [(3, text[3]), (None, text[4]), (None, None), (None, "")]
    df = spark.createDataFrame(docs, DOCS).withColumn("key", F.lit("k")).withColumn("_row", F.lit("r")).repartition(3)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, (r.text or "").strip()) for r in kept.collect()]
    assert {(r.key, r._row) for r in kept.collect()} == {("k", "r")}
    with_id = {(1, text[0]), (3, text[3])}
    assert {x for x in got if x[0] is not None} == with_id
    without = sorted(t for i, t in got if i is None)
    assert len(without) == 4
    assert {"", text[1], text[4]} < set(without)
    assert {text[2], near(2)} & set(without)
    assert len(got) == 6
    alone = spark.createDataFrame([(None, text[1]), (None, text[1])], DOCS)
    assert jaccard.keep_one(alone).count() == 1


def test_components_of_a_path_and_a_star(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    star = [("s", f"s{i}") for i in range(30)]
    found = jaccard.connected(spark.createDataFrame(random.Random(1).sample(path + star, 70) + [("q", "q")], "a string, b string"))
    assert {(r.v[0], r.component) for r in found.collect()} == {("p", "p000"), ("s", "s")}
    assert found.count() == 72


def test_depth_gives_the_recall():
    for recall in (0.9, 0.99, 0.999):
        k = jaccard.forest_depth(0.8, 16, 8, recall)
        assert 1 - (1 - 0.8**k) ** 16 >= recall
        assert k == 8 or 1 - (1 - 0.8 ** (k + 1)) ** 16 < recall


def planted(rate, n=150):
    """Pairs of texts of 150 words, of which the second has some words changed."""
    r = random.Random(rate)
    docs = []
    for i in range(n):
        w = [f"p{i}_{k}" for k in range(150)]
        docs.append((100 * i, " ".join(w)))
        for _ in range(rate):
            w[r.randrange(150)] = "x"
        docs.append((100 * i + 1, " ".join(w)))
    return docs


@pytest.mark.parametrize("rate", [1, 3])
def test_recall_of_the_forest(spark, rate):
    docs = planted(rate)  # three words changed leave a similarity of 0.81 or more
    want = {d: n for d, _, n in brute_classes(docs) if d % 100 == 0}
    got = {r.doc_id: r.n_links for r in jaccard.join_similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(want.values()) > 50
    assert all(got[d] <= n for d, n in want.items())  # verified: none too many
    assert sum(got[d] for d in want) >= 0.99 * sum(want.values())


def test_prefixes_are_shortened_for_each_document(spark):
    close, apart = ([f"{c}{i}" for i in range(400)] for c in "ab")
    docs = [(1, " ".join(close)), (2, " ".join([*close, "end"]))]  # of similarity 0.997
    docs += [(3, " ".join(apart)), (4, " ".join([*apart[:-40], *[f"z{i}" for i in range(40)]]))]  # and of 0.81
    sets = jaccard.sketches(spark.createDataFrame(docs, DOCS), 5, 16, 6, 7).cache()
    met = jaccard.tries(sets.select("key", "labels"), 16, 6, 4).cache()
    name = {r.key: r.doc_id for r in sets.collect()}
    stop = {r.node for r in jaccard.shortened(met, 16, 4, 0.9995).collect()}
    at = collections.defaultdict(set)
    for r in met.collect():
        assert {name[r.key], name[r.other]} in ({1, 2}, {3, 4})
        assert r.pivot == min(r.key, r.other)
        if r.node in stop:
            at[name[r.key]].add((len(r.node) - 2) // 2)
    assert at[1] == at[2] == {6}  # met in nearly all trees
    assert at[3] == at[4] == {4}
    assert sum(len(r.labels) == 16 * 14 for r in sets.collect()) == 4


# ---- packing ----


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_short_way_gives_the_tokenizers_ids():
    t = packing.tokenizer(vocabulary())
    texts = [x or "" for _, x in TEXTS] + ["I'm it's O'Neil's don't.", "Ünïcode, ÀÉÎ. ß ẞ İ ſ ﬁ", "a\tb c\r\nd", "x,y.z ... !!! 3.14", "é ́a", "\x1c\x1da b", "ÿ. Ÿ, ×÷ ª º"]
    assert t.fast
    for x in texts:
        ids = t.whole.encode(x, add_special_tokens=False).ids
        assert list(np.frombuffer(t.encode(x), "<u4")) == ids, x


def test_forms_of_a_word_are_tokenized_once():
    t = packing.WordTokenizer(vocabulary())
    stems, signs = [f"st{chr(97 + i)}mé" for i in range(20)], ["", ".", ",", ".!!", "###", ")&&", "...", "|<"]
    x = " ".join(f(s) + e for s in stems for e in signs for f in (str.lower, str.upper, str.capitalize))
    assert list(np.frombuffer(t.encode(x), "<u4")) == t.whole.encode(x, add_special_tokens=False).ids
    assert len(t.known) <= 1 + len(stems) + len(signs)


@pytest.mark.parametrize("run", [3, 2000])
def test_texts_are_encoded_by_batches(monkeypatch, run):
    monkeypatch.setattr(packing, "RUN", run)
    r = random.Random(5)
    bits = [*"aZéßÀÿ×÷ªµİſKΣς中é", "\u0301", *packing.SIGNS, "'s", "'", "’", "1", "\t", "\u00a0", "\x85", "\u200b", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "\n", " ", " ", "the", "Of", "😀"]
    texts = [x for _, x in TEXTS] + ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)]
    t = packing.WordTokenizer(vocabulary())
    want = [t.whole.encode(x or "", add_special_tokens=False).ids for x in texts]
    for kind in (pa.string(), pa.large_string()):
        got = [*t.encode_all(pa.array(["left out", *texts], kind).slice(1))]
        assert [list(np.frombuffer(x, "<u4")) for x in got] == want
    assert [*t.encode_all(pa.array([], pa.string()))] == []
    t.fast = False
    assert [list(np.frombuffer(x, "<u4")) for x in t.encode_all(pa.array(texts))] == want


def test_strings_that_the_model_does_not_end_are_tokenized_whole():
    t = packing.WordTokenizer(vocabulary())
    want = t.encode("some words, others.")
    t.known, t.last = {"": b""}, np.zeros_like(t.last)
    assert t.encode("some words, others.") == want


def test_words_met_are_forgotten_by_generations(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 50)
    t, r = packing.WordTokenizer(vocabulary()), random.Random(3)
    for _ in range(60):
        x = " ".join(r.choice(["the", "of", f"w{r.randrange(400)}x", "Élan,"]) for _ in range(30))
        assert list(np.frombuffer(t.encode(x), "<u4")) == t.whole.encode(x, add_special_tokens=False).ids
        assert len(t.known) + len(t.before) < 200


def test_other_tokenizers_are_used_whole():
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not t.fast
    for x in ("Hello there,  world\n\n x", " a", ""):
        assert list(np.frombuffer(t.encode(x), "<u4")) == t.whole.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [16, 4096])
def test_pieces_and_sequences(spark, length):
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("start", F.lit(1))
    got = packing.pack(docs, vocabulary(), length=length, group=4, keep_ids=True).collect()
    t = packing.tokenizer(vocabulary()).whole
    want = sorted([(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in TEXTS], key=str)
    by_doc = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append(r)
    for d, ids in want:
        copies = sum(x == d for x, _ in want)
        parts = sorted(by_doc[d], key=lambda r: r.start)[::copies]
        assert [i for p in parts for i in np.frombuffer(p.ids, "<u4")] == ids
        assert {p.doc_tokens for p in parts} == {len(ids)}
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert packing.pack(docs.where("false"), vocabulary()).count() == 0


def test_rows_of_one_id_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(600)] + [(1, "the same")] * 600, DOCS).repartition(6)
    got = packing.pack(docs, vocabulary(), group=50).collect()
    groups = collections.Counter((r.doc_id, r.sequence_id >> 32) for r in got)
    assert len(got) == 1200
    assert max(groups.values()) < 120
    texts = spark.createDataFrame([(4, f"w{i} x") for i in range(8)], DOCS)
    a, b = (sorted(map(tuple, packing.pack(texts.coalesce(1).orderBy(F.col("text").desc() if k else F.col("text")).coalesce(1), vocabulary(), group=100).collect())) for k in (0, 1))
    assert a == b


def test_first_fit_takes_the_first_that_fits():
    r = random.Random(1)
    for n in (0, 1, 5, 300):
        lengths = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        free, want = [], []
        for x in lengths:
            b = next((i for i, f in enumerate(free) if f >= x), len(free))
            if b == len(free):
                free.append(100)
            want.append((b, 100 - free[b]))
            free[b] -= x
        assert list(zip(*packing.first_fit(lengths, 100), strict=True)) == want


# ---- language model ----


def brute_lm(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["</s>"] for _, t in docs]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    c, b = collections.Counter(), collections.Counter()
    for w, o in zip(toks, out, strict=True):
        if not o:
            c.update(w)
            b.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    n2, pre = collections.Counter(b.values()), collections.Counter(w for _, w in b)
    n1 = collections.Counter(pre.values())
    d2, d1 = lm.discounts([n2[i] for i in (1, 2, 3, 4)]), lm.discounts([n1[i] for i in (1, 2, 3, 4)])
    hc, hs = collections.Counter(), collections.defaultdict(float)
    for (u, _), k in b.items():
        hc[u] += k
        hs[u] += d2[min(k, 3)]
    seen = sum(pre.values())
    rest = sum(d1[min(p, 3)] for p in pre.values()) / seen if seen else 1.0
    low = lambda w: max(pre[w] - d1[min(pre[w], 3)], 0) / max(seen, 1) + rest / (v + 1)
    p = lambda u, w: max(b[u, w] - d2[min(b[u, w], 3)], 0) / hc[u] + hs[u] / hc[u] * low(w) if u in hc else low(w)
    rows_ = []
    for (d, _), w, o in zip(docs, toks, out, strict=True):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        rows_.append((d, o, len(w), sum(x in c for x in w), n, base, sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True))))
    return rows_


@pytest.mark.parametrize(("docs", "shards"), [(near_copies(4), 3), (near_copies(5, 30) + [(900 + i, "the x the y " * 400) for i in range(3)], 8), ([(i, "a") for i in (0, 3)], 2)])
def test_scores_are_the_models(spark, tmp_path, docs, shards):
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    model = lm.train(df.where(~lm.held_out(F.col("doc_id"))).select("text"), str(tmp_path / "lm"), shards)
    scored = lm.score(df, model).select("doc_id", lm.held_out(F.col("doc_id")).alias("o"), "n_tokens", "n_known", F.lit(model.total).alias("n"), "base_score", "score")
    got, want = rows(scored), sorted(brute_lm(docs), key=str)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_model_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    model = lm.train(none.select("text"), str(tmp_path / "lm"), 2)
    got = lm.score(spark.createDataFrame([(1, "a b")], DOCS), model).first()
    assert (got.n_tokens, got.n_known, got.score) == (3, 0, 0.0)
    assert lm.score(none, model).count() == 0


# ---- classifier ----


def test_classifier_on_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = got.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(judged) > 80
    assert sum(r.predicted == r.quality for r in judged) >= 0.97 * len(judged)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows(got) == rows(quality.query(spark, sf))


def test_learning_and_scores_by_brute_force(spark):
    docs, marks = corpus(8)
    df = spark.createDataFrame(docs, DOCS + ", lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    order = labels.select("doc_id", "quality", F.xxhash64(F.lit(7), "doc_id").alias("at"), quality.held_out(F.col("doc_id")).alias("out")).collect()
    order = [r for r in sorted(order, key=lambda r: r["at"]) if not r.out][:30]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= 1e-3 else (math.copysign(1e-3, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.5 + 1e-3)
    parsed = {d[0]: [(int(i), float(x)) for i, x in zip(*next(iter(quality.vectors(pa.array([d[1] or ""])))), strict=True)] for d in docs}
    for _ in range(2):
        for r in order:
            row = parsed[r.doc_id]
            p = 1 / (1 + math.exp(-sum(weight(i) * x for i, x in row)))
            for i, x in row:
                g, w = (p - r.quality) * x, weight(i)
                z[i], n[i] = z[i] + g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w, n[i] + g * g
    w = quality.fit(df, labels, most_rows=30)
    assert {int(i) for i in np.flatnonzero(w)} <= set(z)
    assert max(abs(w[i] - weight(i)) for i in z) < 1e-5
    got = {r.doc_id: r.score for r in quality.score(df, w).collect()}
    for d in docs:
        assert got[d[0]] == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * x for i, x in parsed[d[0]]))), abs=1e-5)


def test_features_are_all_words_and_pairs():
    (at, x), (empty, _) = quality.vectors(pa.array(["a b a, a a", ""]))
    # words a b a , a a; pairs ab ba a, ,a aa; again: the last one but one twice (a b a, a , a), the last one once
    assert len(empty) == 1
    assert len(at) == 3 + 5 + 1 + 1
    assert sorted((x[:-1] * 14 / quality.SCALE).round().astype(int).tolist()) == [1, 1, 1, 1, 1, 1, 1, 3, 4]


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(0, None), (77, 1)], "doc_id long, quality int")
    w = quality.fit(docs, labels)
    assert {r.score for r in quality.score(docs, w).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == len(TEXTS)
    assert quality.keep_good(docs.where("false"), labels).count() == 0


# ---- pipeline ----


def test_pipeline_keeps_the_tokens(spark):
    import corpus_pipeline

    got = corpus_pipeline.pack(spark, spark.createDataFrame(TEXTS, DOCS), "").collect()
    t = packing.tokenizer(vocabulary()).whole
    assert {zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got} == {True}
    want = collections.Counter()
    for d, x in TEXTS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.update((d, i, tuple(ids[i : i + 4096])) for i in range(0, len(ids), 4096))
    assert collections.Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want


def corpus(seed=5):
    """Rows of documents and labels: prose and junk, near and exact copies, personal data, empty and long texts, three sources and none."""
    r = random.Random(seed)
    good = lambda n: " ".join(f"good{r.randrange(60)}" for _ in range(n))
    texts = [good(r.randrange(5, 120)) if i % 3 else " ".join(f"junk{r.randrange(30)}" for _ in range(r.randrange(5, 60))) for i in range(60)]
    texts += [texts[1], texts[2] + " end", texts[4], good(40) + " mail a.b@example.com or 10.0.0.1", good(30) + " Mr John Smith, 10.0.0.1", "", None, good(6000)]
    docs = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return docs, [(i, int(i % 3 > 0)) for i in range(60)]


def brute_mix(docs, tie):
    """The rows that the mix takes, by walking each source's run word by word; single spaces between words. tie: by doc_id."""
    names = sorted({d[3] for d in docs}, key=lambda x: (x is None, x or ""))
    size = {n: sum(len((d[1] or "").split()) for d in docs if d[3] == n) for n in names}
    weight = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    target, left, budget = {}, list(names), 1.5 * sum(size.values())
    while left:
        level = budget / sum(weight[n] for n in left)
        full = [n for n in left if 2 * size[n] < level * weight[n]]
        target |= {n: 2.0 * size[n] for n in full} if full else {n: level * weight[n] for n in left}
        budget -= sum(target[n] for n in full)
        left = [n for n in left if n not in full] if full else []
    seats = round(sum(target.values()) / 16)
    quotients = sorted((-target[n] / (2 * k + 1), i, n) for i, n in enumerate(names) for k in range(seats))[:seats]
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for rank, n in enumerate(names, 1):
        ring = 2 * size[n]
        quota = min(sum(q[2] == n for q in quotients), -(-ring // 16))
        own = sorted((d for d in docs if d[3] == n), key=lambda d: digest(f"7:{d[0]}:{tie[d[0]]}"))
        laid = [(d, w, at == 0) for d in own for at, w in enumerate((d[1] or "").split())] * 2
        first = int(digest(f"run 7:{rank}:0")[:15], 16) % ring // 16 * 16
        rows_ = []
        for at in range(first, first + min(quota * 16, ring)):
            d, w, begins = laid[at % ring]
            if begins or not rows_:
                rows_.append((d, []))
            rows_[-1][1].append(w)
        out += [(d[0], " ".join(ws), d[2], d[3], len(" ".join(ws))) for d, ws in rows_]
    return out


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    from rankloom.llm import pii

    docs, marks = corpus()
    spark.createDataFrame(docs, DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _, name: f"{tmp_path}/{name}")
    corpus_pipeline.run(spark, str(tmp_path))
    stage = {name: rows(spark.read.parquet(f"{tmp_path}/pipeline-{name}"), *(["doc_id", "text", "lang", "source", "n_chars"] if name != "packing" else ["doc_id", "start", "length", "sequence_id", "offset", "ids", "doc_tokens"])) for name, _ in corpus_pipeline.STAGES}

    w = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    want = []
    for d in docs:
        ((at, x),) = quality.vectors(pa.array([d[1] or ""]))
        if 1 / (1 + math.exp(-float(w[at] @ x))) >= 0.5:
            want.append(d)
    assert 40 <= len(want) < len(docs)
    assert stage["quality"] == sorted(want, key=str)

    first = {c for _, c, _ in brute_classes([d[:2] for d in want])}
    assert len(first) < len(want)
    want = [d for d in want if d[0] in first]
    assert stage["near_duplicates"] == sorted(want, key=str)

    private = re.compile(pii.ANY.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]"))
    found = {m[0] for d in want for m in private.finditer(d[1] or "")}
    assert found == {"a.b@example.com", "10.0.0.1", "Mr John Smith"}
    drawn = spark.createDataFrame([(x,) for x in sorted(found)], "e string").select("e", pii.surrogate(F.col("e"), "rankloom", F.lit(0)).alias("s"))
    other = {r.e: r.s for r in drawn.collect()}
    texts = [None if d[1] is None else private.sub(lambda m: other[m[0]], d[1]) for d in want]
    want = [(d[0], t, *d[2:4], len(t) if t is not None else None) for d, t in zip(want, texts, strict=True)]
    assert stage["private_data"] == sorted(want, key=str)

    before = spark.read.parquet(f"{tmp_path}/pipeline-private_data")
    want = brute_mix(want, {r.doc_id: r.tie for r in before.select("doc_id", mixing.content(before).alias("tie")).collect()})
    assert stage["mixing"] == sorted(want, key=str)

    t = packing.tokenizer(vocabulary()).whole
    pieces = []
    for d in want:
        ids = [*t.encode(d[1], add_special_tokens=False).ids, 2]
        pieces += [(-len(ids[i : i + 4096]), d[0], i, tuple(ids[i : i + 4096]), len(ids)) for i in range(0, len(ids), 4096)]
    pieces.sort()
    free, places = [], []
    for n, d, i, _, _ in pieces:
        b = next((k for k, f in enumerate(free) if f >= -n), len(free))
        free += [4096] * (b == len(free))
        places.append((d, i, -n, b, 4096 - free[b]))
        free[b] += n
    assert sorted(r[:5] for r in stage["packing"]) == sorted(places)
    assert sorted((-r[2], r[0], r[1], tuple(np.frombuffer(r[5], "<u4").tolist()), r[6]) for r in stage["packing"]) == pieces


def test_pipeline_stages_in_turn(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 4096").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private_data", "mixing", "packing"]


def test_small_tables_cost_few_jobs_and_partitions(spark):
    """Rounds of the classes and levels of a filter go by their rows, not by the session's number of partitions."""
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    try:
        chain = spark.range(300).selectExpr("id a", "id + 1 b").unionByName(spark.range(1000, 1200).selectExpr("id b", "1000 a").select("a", "b"))
        found = jaccard.connected(chain)
        assert found.rdd.getNumPartitions() <= sc.defaultParallelism
        assert {(r.v, r.component) for r in found.collect()} == {(i, 0) for i in range(301)} | {(i, 1000) for i in range(1000, 1200)}

        keys = spark.range(500).selectExpr("cast(id as string) key")
        sc.setJobGroup("level", "a level of a filter")
        cascade = url_filter.Cascade()
        cascade.add(keys, 500, 0.5)
        assert len(sc.statusTracker().getJobIdsForGroup("level")) < 10
        exact = url_filter.build_cascade(keys, keys.unionByName(spark.range(500, 3000).selectExpr("cast(id as string) key")), 500, 3000)
        judged = spark.range(3000).select("id", exact.contains(F.col("id").cast("string")).alias("has")).collect()
        assert all(r.has == (r.id < 500) for r in judged)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
