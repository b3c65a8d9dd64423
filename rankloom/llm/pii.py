"""PII surrogates: each detected entity is replaced by a keyed one of its own type, script and format.

Types: email addresses, telephone numbers, IPv4 addresses, card numbers, US social security numbers,
IBANs, cloud access keys, secrets given as `name = "value"`, and names after a title. A surrogate is
drawn by a keyed hash of the entity: digits stay digits, letters stay letters of their script and case,
separators stay, card numbers and IBANs keep their check digits' rules, social security numbers stay in the
ranges that are given out, octets stay octets, and a name is drawn from
names of the title's gender (of the word's script; other scripts are drawn by letter). So an entity has
the same surrogate in every text (coreference).

Collisions are checked over the whole corpus: among all distinct entities, those whose surrogate another
one holds already, or is an entity of the corpus, are drawn again with the next attempt until none is
left (distinctness). What had to be drawn again is an exception; the rest follows from the key alone, so
texts are rewritten in the scan. The exceptions go to the executors up to `most_exceptions`; beyond that
the replacements are joined instead (`_rewrite_by_join`).

At scale: texts never move (on the main path). What is shuffled are the distinct entities, combined in
each task first, so an entity in a third of all rows is one row a task.

Ties: of entities that draw alike the first by (attempt, canonical form) keeps what it drew, so reruns agree.
Defined results: a text of any length is rewritten whole; extra columns come back as they are, whatever they
are called (`replace` adds `_entities`, in place of a column of that name; `rewrite` keeps even that); a null text stays null with no entities; an empty one stays empty; texts without
entities come back byte for byte; repeated rows are rewritten alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: What counts as an entity, in order of precedence (Java patterns).
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*)(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|(?=[A-Za-z+/_\-]*\d)[A-Za-z0-9+/_\-]{8,})",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3\d{3}([ -]?)\d{6}\2\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": r"\b(?:Mrs?|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What each of the patterns needs somewhere in its match: a text without it has no entities.
HINT = r"[0-9@=:]|AKIA|ASIA|\b(?:Mrs?|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b"
#: Surrogate names by gender; surnames serve both.
NAMES = {
    "f": ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"],
    "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Mario", "Nils", "Oskar", "Pablo"],
    "last": ["Abel", "Baum", "Conti", "Duval", "Ernst", "Ferrer", "Graf", "Haller", "Iser", "Jansen", "Keller", "Leroy", "Moreau", "Neri", "Orell", "Prado"],
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\b"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONSONANT = "bcdfghjklmnpqrstvwxz"
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with the value computed once and named, so that expressions stay small."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _canonical(entity: Column, what: Column) -> Column:
    value = (
        F.when(what == "email", F.lower(entity))
        .when(what == "secret", F.regexp_replace(entity, r"^[^=:]*[=:]\s*[\"']?|[\"']$", ""))
        .when(what.isin("phone", "card", "ssn", "iban"), F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
        .otherwise(entity)
    )
    return F.concat_ws(":", what, value)


def canonical(entity: Column) -> Column:
    """What says that two spellings are one entity: the type, with the value alone.

    Emails count without regard to case, numbers without their separators, secrets without their names.
    """
    return let(entity, lambda e: let(kind(e), lambda what: _canonical(e, what)))


def _byte(seed: Column, i: Column) -> Column:
    """The i-th byte of the seed's stream of hex digits."""
    return F.conv(F.substring(seed, F.pmod(i * 2, F.lit(256)) + 1, F.lit(2)), 16, 10).cast("int")


def _draw(seed: Column, i: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), F.pmod(_byte(seed, i), F.lit(len(letters))) + 1, F.lit(1))


def _stream(canon: Column, key: str, attempt: Column) -> Column:
    """256 hex digits, keyed: SHA-512 of key, attempt and entity, twice."""
    one = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(n), attempt.cast("string"), canon), 512)
    return F.concat(one("1"), one("2"))


def _same_shape(text: Column, seed: Column, begin: int = 0, lower: str = LOWER) -> Column:
    """Each ASCII digit and letter, and each other letter by its script, drawn anew; the rest stays."""

    def one(c: Column, at: Column) -> Column:
        letters = F.when(c.rlike("^[0-9]$"), DIGITS).when(c.rlike(r"^\p{IsCyrillic}$"), CYRILLIC).when(c.rlike(r"^\p{IsGreek}$"), GREEK).when(c.rlike(r"^\p{Lu}$"), UPPER).when(c.rlike(r"^\p{Ll}$"), lower)
        return let(letters, lambda x: F.coalesce(F.substring(x, F.pmod(_byte(seed, at), F.length(x)) + 1, F.lit(1)), c))

    # separators don't count for the place, so that other spellings of a number draw the same digits
    place = lambda t, i: F.length(F.regexp_replace(F.substring(t, F.lit(1), i), r"[^\p{L}\p{N}]", "")) + begin
    return let(text, lambda t: F.array_join(F.transform(F.split(t, ""), lambda c, i: one(c, place(t, i))), ""))


def _octets(text: Column, seed: Column) -> Column:
    two = lambda i: _byte(seed, i * 2) * 256 + _byte(seed, i * 2 + 1)
    return F.array_join(F.transform(F.split(text, r"\."), lambda _, i: (F.pmod(two(i), F.lit(254)) + 1).cast("string")), ".")


def _luhn(number: Column, n: Column) -> Column:
    """The Luhn sum of a number of which n digits are whole: every second one, from the last but one back, counts twice."""
    digits = F.transform(F.split(F.regexp_replace(number, "[^0-9]", ""), ""), lambda c: c.cast("int"))
    twice = lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.reduce(F.transform(digits, twice), F.lit(0), lambda a, b: a + b)


def _card(text: Column, seed: Column) -> Column:
    """The first digit stays; the last one makes the Luhn sum right if it was right before."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    body = F.concat(F.substring(text, 1, 1), F.substring(_same_shape(text, seed), F.lit(2), F.length(text) - 2))
    right = lambda b: F.pmod(F.lit(10) - F.pmod(_luhn(b, n), F.lit(10)), F.lit(10)).cast("string")
    return let(body, lambda b: F.concat(b, F.when(F.pmod(_luhn(text, n), F.lit(10)) == 0, right(b)).otherwise(_draw(seed, F.lit(99), DIGITS))))


def _rest97(number: Column) -> Column:
    """The remainder by 97 of an IBAN's digits, with its first four signs last and letters as 10 to 35."""
    signs = F.regexp_replace(number, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 4))
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.reduce(F.transform(F.split(turned, ""), value), F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v, F.lit(97)))


def _iban(text: Column, seed: Column) -> Column:
    """The country stays; the check digits are right if they were right before."""
    drawn = F.concat(F.substring(text, 1, 2), F.lit("00"), F.substring(_same_shape(text, seed), F.lit(5), F.length(text)))
    check = lambda d: F.lpad((F.lit(98) - _rest97(d)).cast("string"), 2, "0")
    wrong = F.concat(_draw(seed, F.lit(98), DIGITS), _draw(seed, F.lit(99), DIGITS))
    return let(drawn, lambda d: F.concat(F.substring(d, 1, 2), F.when(_rest97(text) == 1, check(d)).otherwise(wrong), F.substring(d, F.lit(5), F.length(d))))


def _ssn(seed: Column) -> Column:
    """Areas 001 to 665, groups and serial numbers from 1 on."""
    two = lambda i: _byte(seed, F.lit(2 * i)) * 256 + _byte(seed, F.lit(2 * i + 1))
    part = lambda i, most, n: F.lpad((F.pmod(two(i), F.lit(most)) + 1).cast("string"), n, "0")
    return F.concat_ws("-", part(0, 665, 3), part(1, 99, 2), part(2, 9999, 4))


def _name(text: Column, seed: Column) -> Column:
    words = F.split(text, " ")
    n = F.size(words)
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in NAMES[names]]), F.pmod(_byte(seed, F.lit(at)), F.lit(len(NAMES[names]))) + 1)
    tail = F.concat(_draw(seed, F.lit(40), CONSONANT), F.lit("a"), _draw(seed, F.lit(41), CONSONANT), F.lit("e"), _draw(seed, F.lit(42), CONSONANT))
    first = F.when(text.rlike(FEMALE), pick("f", 1)).otherwise(pick("m", 1))
    latin = F.concat_ws(" ", F.element_at(words, 1), F.when(n > 2, first), F.concat(pick("last", 3), tail))  # the tail makes room for many distinct names
    other = F.concat(F.element_at(words, 1), F.lit(" "), _same_shape(F.array_join(F.slice(words, F.lit(2), n - 1), " "), seed))
    return F.when(F.element_at(words, 2).rlike(r"^\p{IsLatin}+$"), latin).otherwise(other)


def _email(text: Column, seed: Column) -> Column:
    """Local part by shape, up to at least ten signs; the domain's labels by shape, its ending kept."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    more = F.array_join(F.transform(F.sequence(F.lit(60), F.lit(59) + F.greatest(F.lit(1), F.lit(10) - F.length(local))), lambda i: _draw(seed, i, LOWER)), "")
    ending = F.substring_index(domain, ".", -1)
    host = _same_shape(F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1), seed, 80)
    shaped = _same_shape(local, seed)
    return F.lower(F.concat(let(shaped, lambda x: F.concat(F.substring(x, 1, 1), more, F.substring(x, F.lit(2), F.length(x)))), F.lit("@"), host, F.lit("."), ending))


def _after(head: Column, text: Column, seed: Column, lower: str = LOWER) -> Column:
    """The head of the text stays, the rest is drawn."""
    return let(head, lambda h: F.concat(h, _same_shape(F.substring(text, F.length(h) + 1, F.length(text)), seed, 0, lower)))


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    def drawn(e: Column, what: Column, seed: Column) -> Column:
        head = (
            F.when(what == "secret", F.regexp_extract(e, r"^[^=:]*[=:]\s*", 0))
            .when(what == "phone", F.regexp_extract(e, r"^\+(?:\d{1,3}(?=\D)|\d)", 0))
            .when(what == "access_key", F.substring(e, 1, 4))
            .otherwise(F.lit(""))
        )
        digits = (what == "secret") & e.rlike(r"[=:]\s*[\"']?[0-9a-f]+[\"']?$")  # a value in hexadecimal stays one
        shaped = F.when(digits, _after(head, e, seed, "abcdef")).otherwise(_after(head, e, seed))
        return F.when(what == "email", _email(e, seed)).when(what == "ip", _octets(e, seed)).when(what == "iban", _iban(e, seed)).when(what == "ssn", _ssn(seed)).when(what == "card", _card(e, seed)).when(what == "name", _name(e, seed)).otherwise(shaped)

    return let(entity, lambda e: let(kind(e), lambda what: let(_stream(_canonical(e, what), key, attempt), lambda seed: drawn(e, what, seed))))


def entities(text: Column) -> Column:
    """All entities of a text in their order; texts without a digit, "@", "=", ":", a key's head or a title are told at once."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def exceptions(docs: DataFrame, key: str, most_attempts: int = 50) -> DataFrame:
    """(entity, attempt) of the distinct entities that the first draw doesn't settle; entities in canonical form."""
    draw = lambda df: keep(df.withColumn("drawn", canonical(surrogate(F.col("raw"), key, F.col("attempt")))))
    found = docs.select(F.explode(entities(F.col("text"))).alias("raw")).groupBy("raw").agg(F.lit(0).alias("attempt"))
    state = draw(found.groupBy(canonical(F.col("raw")).alias("entity")).agg(F.min("raw").alias("raw"), F.min("attempt").alias("attempt")))
    for _ in range(most_attempts):
        # of those that drew alike the first by (attempt, entity) keeps what it drew, unless that is an entity of the corpus
        own = F.struct("attempt", "entity")
        held = state.groupBy("drawn").agg(F.min(own).alias("holder"), F.count("*").alias("n"))
        clash = held.join(state.select(F.col("entity").alias("drawn"), F.lit(True).alias("real")), "drawn", "left").where("n > 1 or real")
        lost = keep(state.join(clash, "drawn").where(F.coalesce("real", F.lit(False)) | (own != F.col("holder"))).select("entity", "raw", (F.col("attempt") + 1).alias("attempt")))
        if lost.isEmpty():
            return state.where("attempt > 0").select("entity", "attempt")
        state = keep(state.join(lost.select("entity"), "entity", "left_anti").unionByName(draw(lost)))
    raise RuntimeError("the surrogates of some type are used up")


def replace(docs: DataFrame, key: str, most_exceptions: int = 10_000) -> DataFrame:
    """docs(..., text, ...) with the text rewritten, and the entities found in `_entities`."""
    odd = exceptions(docs, key)
    found = docs.withColumn("_entities", entities(F.col("text")))
    if odd.count() > most_exceptions:
        return _rewrite_by_join(found, odd, key)
    rows = odd.collect()  # `most_exceptions` short rows at most
    fixed = F.create_map(*[F.lit(x) for r in rows for x in (r.entity, r.attempt)]) if rows else None
    attempt = lambda e: F.lit(0) if fixed is None else F.coalesce(F.try_element_at(fixed, canonical(e)), F.lit(0))
    return found.withColumn("text", _spliced(F.transform("_entities", lambda e: surrogate(e, key, attempt(e)))))


def _rewrite_by_join(found: DataFrame, odd: DataFrame, key: str) -> DataFrame:
    """The same where the exceptions are too many to send: the lists of entities are joined, each distinct one once."""
    lists = found.where(F.size("_entities") > 0).select("_entities").distinct().select("_entities", F.posexplode("_entities").alias("at", "e"))
    odd = odd.select(F.col("entity").alias("_odd"), "attempt")
    drawn = lists.join(odd, canonical(F.col("e")) == F.col("_odd"), "left").select("_entities", "at", surrogate(F.col("e"), key, F.coalesce("attempt", F.lit(0))).alias("s"))
    drawn = drawn.groupBy("_entities").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("_new"))
    joined = found.join(drawn.withColumnRenamed("_entities", "_list"), F.col("_entities") == F.col("_list"), "left")
    return joined.withColumn("text", _spliced(F.col("_new.s"))).drop("_list", "_new")


def rewrite(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text rewritten in place, and n_chars, where there is one, made to fit it."""
    done = replace(docs.select("text", F.struct("*").alias("_row")), key)
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("_row")).select("_row.*")


def _spliced(surrogates: Column) -> Column:
    gaps = F.split(F.col("text"), ANY, -1)
    whole = F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(surrogates, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), ""))
    return F.when(F.size("_entities") > 0, whole).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = replace(docs, "rankloom")
    kinds = F.array_sort(F.array_distinct(F.transform("_entities", kind)))
    return done.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))
