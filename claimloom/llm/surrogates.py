"""Surrogates for personal data, in DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, payment card numbers, social security
numbers, phone numbers, names behind forms of address, and in the same document the
same full names and family names without one.  Every entity is reduced to
a canonical form (lower case, digits only, without the form of address), so spellings
of one entity refer to the same one, and each canonical form gets one surrogate for
the whole corpus, derived from a keyed hash.  A name is taken word by word, given name
and family name, so "Mr John Smith", "Mr Smith" and "John Smith" stay one person:

* an address keeps its length, punctuation and last label, letter for letter and
  digit for digit;
* a number keeps its first digit and its punctuation, a card number a valid check digit;
* an IP address is four octets from 1 to 254;
* a name keeps its number of words, script (Latin, Cyrillic, Greek), the gender of its
  form of address and its capitals; its words are built from syllables.  A name without
  a gender takes that of the same name in its document, if one has it.  Latin family
  names have no gender.

Collision checks keep distinct entities distinct: a surrogate that equals a real entity
of the corpus, or another entity's surrogate, is drawn again with the next attempt
number, in rounds, until none collides; after ``WIDEN`` rounds it also grows, so the
rounds end.  Words are distinct by themselves, so whole names are too.  Text moves only
for documents with entities; those are staged once with their entities.

Defined cases: a null text stays null and has no entity; a text without entities is
unchanged; repeated rows with equal doc_id and text get equal results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, pin
from .common import stage

WIDEN = 8

# Forms of address by gender, and the patterns of entities.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Доктор"]
TITLES = "|".join(MALE + FEMALE + NEUTRAL)
WORD = r"\p{Lu}(?:\p{L}|-\p{L}|['’](?!s(?!\p{L}))\p{L})++"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])",
    "name": r"(?<!\p{L})(?:(?:" + TITLES + r")\.? ){1,3}" + WORD + "(?: " + WORD + ")?",
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "jo", "ka", "le", "mi", "no", "pe", "ra", "su", "ta", "ve", "zo"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "жо", "ка", "ле", "ми", "но", "пе", "ра", "су", "та", "ве", "зо"],
    "greek": ["βα", "δε", "φι", "γο", "χα", "ζο", "κα", "λε", "μι", "νο", "πε", "ρα", "σου", "τα", "βε", "ξο"],
}
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "l"},
    "cyrillic": {"m": "н", "f": "на", "n": "ко"},
    "greek": {"m": "νος", "f": "να", "n": "κη"},
}
ALL = "|".join(PATTERNS.values())
NUMBERS = ("card", "ssn", "phone")
NAMES = ("given", "family")
ADDRESS = r"^(?:(?:" + TITLES + r")\.? ){1,3}"
GENDERED = r"\p{IsCyrillic}|\p{IsGreek}"


def _kind(raw: Column) -> Column:
    kind = F.lit("name")
    for name in ("phone", "ssn", "card", "ip", "email"):
        kind = F.when(raw.rlike("^(?:" + PATTERNS[name] + ")$"), F.lit(name)).otherwise(kind)
    return kind


def _canonical(kind: Column, raw: Column) -> Column:
    """The form under which spellings of one entity agree, names apart."""
    return F.when(kind.isin(*NUMBERS), F.regexp_replace(raw, r"\D", "")).otherwise(F.lower(raw))


def _bare(raw: Column) -> Column:
    return F.regexp_replace(raw, ADDRESS, "")


def _gender(raw: Column) -> Column:
    """The gender of the forms of address in front of a name; null without one."""

    def among(titles: list[str]) -> Column:
        return F.regexp_extract(raw, ADDRESS, 0).rlike(r"(?<!\p{L})(?:" + "|".join(titles) + r")(?!\p{L})")

    return F.when(among(MALE), F.lit("m")).when(among(FEMALE), F.lit("f"))


def _parts(raw: Column, kind: Column, gender: Column) -> Column:
    """What is replaced by itself: the words of a name, or the whole entity."""

    def part(at: Column, own: Column, canonical: Column, word: Column) -> Column:
        return F.struct(
            at.cast("int").alias("at"), own.alias("kind"), canonical.alias("canonical"), word.alias("word")
        )

    def named(words: Column) -> Column:
        def one(word: Column, at: Column) -> Column:
            given = at < F.size(words) - 1
            shown = F.when(given | word.rlike(GENDERED), gender).otherwise("n")
            own = F.when(given, F.lit("given")).otherwise(F.lit("family"))
            return part(at, own, F.concat(shown, F.lit(":"), F.lower(word)), word)

        return F.transform(words, one)

    return F.when(kind == "name", let(F.split(_bare(raw), " "), named)).otherwise(
        F.array(part(F.lit(0), kind, _canonical(kind, raw), raw))
    )


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the digest, a different part of it for every i."""
    part = F.substring(digest, F.pmod(i * 2, F.lit(120)) + 1, F.lit(4))
    return F.pmod(F.conv(part, 16, 10).cast("int") + F.floor(i / 60).cast("int"), F.lit(n))


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), at + 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _like(canonical: Column, digest: Column) -> Column:
    """Letters for letters and digits for digits; the last label stays."""
    keep = F.char_length(F.regexp_extract(canonical, r"\.[a-z]+$", 0))

    def one(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(digest, i, 26) + 1, F.lit(1))
        return (
            F.when(i >= F.char_length(canonical) - keep, c)
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[0-9]"), _draw(digest, i, 10).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(canonical), one), "")


def _number(canonical: Column, digest: Column) -> Column:
    return F.array_join(
        F.transform(
            _chars(canonical),
            lambda c, i: F.when(i == 0, c).otherwise(_draw(digest, i, 10).cast("string")),
        ),
        "",
    )


def _checked(number: Column) -> Column:
    """The last digit replaced so that the number passes the check of payment cards."""

    def total(digits: Column) -> Column:
        n = F.size(digits)
        weighted = F.transform(
            digits,
            lambda c, i: F.when((n - 1 - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
            .when(i == n - 1, F.lit(0))
            .otherwise(c.cast("int")),
        )
        return F.aggregate(weighted, F.lit(0), lambda a, b: a + b)

    check = F.pmod(-let(_chars(number), total), F.lit(10)).cast("string")
    return F.concat(F.substring(number, F.lit(1), F.char_length(number) - 1), check)


def _name(canonical: Column, digest: Column) -> Column:
    gender = F.substring(canonical, 1, 1)

    def in_script(script: str) -> Column:
        ends = ENDINGS[script]
        end = F.when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"])
        return F.concat(*[_pick(SYLLABLES[script], _draw(digest, F.lit(j), 16)) for j in range(4)], end)

    return (
        F.when(canonical.rlike(r":.*\p{IsCyrillic}"), in_script("cyrillic"))
        .when(canonical.rlike(r":.*\p{IsGreek}"), in_script("greek"))
        .otherwise(in_script("latin"))
    )


def _surrogate(key: str, attempt: int) -> Column:
    """The surrogate of (kind, canonical) for an attempt."""
    kind, canonical = F.col("kind"), F.col("canonical")
    seed = F.concat_ws("|", F.lit(key), kind, canonical, F.lit(str(attempt)))
    wide = F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|wide")), 256), 1, 12), 16, 10)

    def made(digest: Column) -> Column:
        octets = [(1 + _draw(digest, F.lit(7 * j + 1), 254)).cast("string") for j in range(4)]
        return (
            F.when(kind == "email", _like(canonical, digest))
            .when(kind == "ip", F.concat_ws(".", *octets))
            .when(kind == "card", _checked(_number(canonical, digest)))
            .when(kind.isin(*NAMES), _name(canonical, digest))
            .otherwise(_number(canonical, digest))
        )

    out = let(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256)), made)
    if attempt < WIDEN:
        return out
    return F.when(kind == "email", F.concat(F.concat(F.lit("u"), wide), out)).otherwise(F.concat(out, wide))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical and a surrogate, one to one, for distinct (kind, canonical) rows.

    A surrogate is free if it is no real entity and nobody has it; of those that drew
    the same one, the first in order keeps it.
    """
    real = stage(entities.select("kind", "canonical").distinct(), "entities")
    done: DataFrame | None = None
    pending = real
    for attempt in count():
        drawn = pending.withColumn("surrogate", _surrogate(key, attempt))
        word = F.regexp_replace("canonical", "^[mfn]:", "")
        taken = real.select("kind", F.when(F.col("kind").isin(*NAMES), word).otherwise(F.col("canonical")).alias("surrogate"))
        if done is not None:
            taken = taken.unionAll(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        order = Window.partitionBy("kind", "surrogate").orderBy("canonical")
        won = free.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
        won = stage(won.select("kind", "canonical", "surrogate"), "surrogates")
        done = won if done is None else done.unionAll(won)
        pending = stage(pending.join(won, ["kind", "canonical"], "left_anti"), "pending")
        if pending.isEmpty():
            return done


def _written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the entity it stands for."""

    def numbered(letters: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"\D", ""))
            return F.when(c.rlike(r"\d"), F.substring(surrogate, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(letters, one), "")

    digits = F.char_length(F.regexp_replace(raw, r"\D", ""))
    number = F.concat(
        let(_chars(raw), numbered),
        F.substring(surrogate, digits + 1, F.greatest(F.char_length(surrogate) - digits, F.lit(0))),
    )
    address = F.array_join(
        F.transform(
            _chars(surrogate),
            lambda c, i: F.when(F.substring(raw, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c),
        ),
        "",
    )
    name = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin(*NUMBERS), number).when(kind.isin(*NAMES), name).when(kind == "ip", surrogate).otherwise(address)


def _again(entities: Column) -> Column:
    """Full names and family names behind forms of address, the longest first."""
    full = F.transform(F.filter(entities, lambda raw: raw.rlike(ADDRESS)), _bare)
    both = let(full, lambda names: F.concat(names, F.transform(names, lambda name: F.substring_index(name, " ", -1))))
    return F.array_sort(F.array_distinct(both), lambda a, b: F.char_length(b) - F.char_length(a))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, tie, text, the entities of every document in text order, and the gaps around them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hint = F.col("text").rlike(r"[@\d]|" + TITLES)
    listed = F.when(hint, F.regexp_extract_all("text", F.lit("(" + ALL + ")"), F.lit(1)))
    empty = F.expr("cast(array() as array<string>)")
    rows = pin(rows, "doc_id", "text", tie=F.xxhash64("text"), first=F.coalesce(listed, empty))
    rows = pin(rows, "doc_id", "text", "tie", "first", names=_again(F.col("first")))
    bare = F.concat(F.lit(r"(?<![\p{L}-])(?:"), F.array_join("names", "|"), F.lit(r")(?![\p{L}-])"))
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(ALL + "|"), bare)).otherwise(F.lit(ALL))
    rows = pin(rows, "doc_id", "text", "tie", "first", "names", pattern=pattern)
    both = F.regexp_extract_all("text", F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit(1))
    return pin(
        rows,
        "doc_id",
        "text",
        "tie",
        entities=F.when(F.size("names") > 0, both).otherwise(F.col("first")),
        gaps=F.when(F.size("first") > 0, F.split("text", F.col("pattern"), -1)),
    )


def _listed(some: DataFrame) -> DataFrame:
    """doc_id, tie, raw and the parts of every distinct entity of a document."""
    with_gender = F.filter(F.array_distinct("entities"), lambda raw: _gender(raw).isNotNull())
    known = F.transform(with_gender, lambda raw: F.struct(F.lower(_bare(raw)).alias("name"), _gender(raw).alias("gender")))
    rows = pin(some, "doc_id", "tie", "entities", known=known)
    rows = rows.select("doc_id", "tie", "known", F.explode(F.array_distinct("entities")).alias("raw"))

    def from_others(name: Column) -> Column:
        same = F.filter("known", lambda k: (k["name"] == name) | k["name"].endswith(F.concat(F.lit(" "), name)))
        return F.get(same, 0)["gender"]

    rows = pin(rows, "doc_id", "tie", "raw", "known", kind=_kind(F.col("raw")))
    gender = F.when(
        F.col("kind") == "name",
        F.coalesce(_gender(F.col("raw")), from_others(F.lower(_bare(F.col("raw")))), F.lit("n")),
    )
    rows = pin(rows, "doc_id", "tie", "raw", "kind", gender=gender)
    return rows.select("doc_id", "tie", "raw", F.inline(_parts(F.col("raw"), F.col("kind"), F.col("gender"))))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities and the text with surrogates, for every document."""
    rows = found(docs)
    plain = rows.where(F.size("entities") == 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    some = stage(rows.where(F.size("entities") > 0).select("doc_id", "tie", "entities", "gaps"), "private")
    listed = _listed(some)
    table = assign(listed, key)
    spelled = listed.join(table, ["kind", "canonical"]).select(
        "doc_id", "tie", "raw", "at", _written(F.col("kind"), F.col("word"), F.col("surrogate")).alias("new")
    )
    spelled = spelled.repartition("doc_id", "tie")
    whole = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("at", "new"))), lambda p: p["new"]), " ")
    entire = spelled.groupBy("doc_id", "tie", "raw").agg(whole.alias("new"))
    entire = entire.withColumn("new", F.concat(F.regexp_extract("raw", ADDRESS, 0), "new"))
    maps = entire.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("raw", "new")).alias("pairs"))
    maps = maps.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.map_from_entries("pairs").alias("spelling"))
    joined = some.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))

    def woven(gaps: Column) -> Column:
        return F.array_join(
            F.zip_with(
                gaps,
                F.col("entities"),
                lambda gap, raw: F.concat(gap, F.coalesce(F.element_at(F.col("spelling"), raw), F.lit(""))),
            ),
            "",
        )

    new = joined.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_entities"),
        woven(F.col("gaps")).alias("text"),
    )
    return plain.unionAll(new)
