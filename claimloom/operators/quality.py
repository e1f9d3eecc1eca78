"""Dataset quality, integrity, augmentation and exploration reports.

Most inputs are annotation documents.  Work per document stays in its row;
shuffles carry pre-aggregated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let
from ..functions.claims import type_dimension
from ..functions.constants import CLAIM_TYPES
from ..functions.matching import overlapping_pairs
from ..functions.ratios import safe_ratio
from ..functions.text import fingerprint, slice_text, strip, word_count
from ..session import stage
from ..sources.annotations import first_result
from .frequent import top_values
from .labels import with_share
from .quantiles import exact_quantiles

# Thresholds of the reports.
RARE_COUNT = 50
MIN_CLAIM_LENGTH, MAX_CLAIM_LENGTH = 3, 100
MIN_HAM_SHARE = 0.3
LOW_COVERAGE = 30
MAX_SHORT_SHARE, MAX_LONG_SHARE = 0.05, 0.1


def claim_rows(docs: DataFrame) -> DataFrame:
    """Documents with their labelled claims as an array ``spans``."""
    entries = F.transform(
        first_result(docs),
        lambda r, i: F.struct(
            F.coalesce(r["value"]["start"], F.lit(0)).alias("start"),
            F.coalesce(r["value"]["end"], F.lit(0)).alias("end"),
            F.get(r["value"]["labels"], F.lit(0)).alias("claim_type"),
            F.coalesce(r["value"]["text"], F.lit("")).alias("text"),
            i.alias("claim_id"),
            (F.coalesce(F.size(r["value"]["labels"]), F.lit(0)) > 0).alias("labelled"),
        ),
    )
    kept = F.filter(entries, lambda e: e["labelled"])
    empty = F.array().cast(
        "array<struct<start:int,end:int,claim_type:string,text:string,claim_id:int,labelled:boolean>>"
    )
    return docs.select(
        F.col("id").alias("message_id"),
        F.col("data.text").alias("text"),
        F.col("meta.label").alias("label"),
        (F.coalesce(F.size("annotations"), F.lit(0)) > 0).alias("annotated"),
        F.coalesce(kept, empty).alias("spans"),
    )


def claim_type_stats(rows: DataFrame) -> DataFrame:
    """Per type: count, share, claim lengths, rare and length flags."""
    s = rows.select(F.explode("spans").alias("s"))
    n = F.length("s.text")
    stats = s.groupBy(F.col("s.claim_type").alias("claim_type")).agg(
        F.count("*").alias("n"),
        F.avg(n).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
    )
    return with_share(stats, "n", "pct", 100.0).withColumns(
        {
            "rare": F.col("n") < RARE_COUNT,
            "length_warning": (F.col("min_length") < MIN_CLAIM_LENGTH)
            | (F.col("max_length") > MAX_CLAIM_LENGTH),
        }
    )


def claims_per_message_hist(rows: DataFrame) -> DataFrame:
    """Messages by claim count; messages without claims count as ham."""
    return (
        rows.where("annotated")
        .groupBy(F.size("spans").alias("n_claims"))
        .agg(F.count("*").alias("n_messages"))
        .withColumn("kind", F.when(F.col("n_claims") == 0, "HAM").otherwise("SMISH"))
    )


def _mismatches() -> Column:
    return F.size(
        F.filter("spans", lambda s: slice_text(F.col("text"), s["start"], s["end"]) != s["text"])
    )


def _overlaps() -> Column:
    return F.size(overlapping_pairs(F.col("spans")))


def boundary_mismatch(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum(_mismatches()), F.lit(0)).alias("boundary_mismatches"),
        F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("total_spans"),
    )


def dataset_quality_verdict(rows: DataFrame) -> DataFrame:
    """One row: totals, and the issues that apply.

    One pass: a message gives one entry without a type that carries its
    totals, and one entry per claim; sums per type are then added up.
    """
    names = ["total_messages", "ham_messages", "smish_messages", "span_overlaps", "boundary_mismatches"]
    values = [
        F.lit(1),
        (F.col("annotated") & (F.size("spans") == 0)).cast("int"),
        (F.size("spans") > 0).cast("int"),
        _overlaps(),
        _mismatches(),
    ]
    message = F.struct(
        F.lit(None).cast("string").alias("claim_type"), *[x.alias(n) for n, x in zip(names, values)]
    )
    claims = F.transform(
        "spans",
        lambda s: F.struct(s["claim_type"].alias("claim_type"), *[F.lit(0).alias(n) for n in names]),
    )
    sums = (
        rows.select(F.explode(F.concat(F.array(message), claims)).alias("e"))
        .groupBy("e.claim_type")
        .agg(F.count("*").alias("n"), *[F.sum(F.col("e")[n]).alias(n) for n in names])
    )
    rare = F.col("claim_type").isNotNull() & (F.col("n") < RARE_COUNT)
    both = sums.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count_if(rare).alias("rare_types")
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("ham_messages") < F.col("total_messages") * MIN_HAM_SHARE, "low_ham"),
            F.when(F.col("span_overlaps") > 0, "overlaps"),
            F.when(F.col("boundary_mismatches") > 0, "boundary_mismatches"),
            F.when(F.col("rare_types") > 0, "rare_types"),
        )
    )
    return both.withColumn("issues", F.array_join(issues, ",")).withColumn(
        "verdict", F.when(F.col("issues") == "", "GOOD").otherwise("ISSUES")
    )


# ---------------------------------------------------------------- integrity


def dup_ids_texts(docs: DataFrame) -> DataFrame:
    """Ids and trimmed texts that occur more than once, with counts.

    Texts are counted by digest and length; one of each repeated text is then
    looked up by the id it was seen under.
    """
    ids = (
        docs.groupBy(F.col("id").alias("value"))
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > 1) & (F.col("value") != ""))
        .select(F.lit("id").alias("kind"), "value", "n")
    )
    text = strip(F.col("data.text"))
    keyed = docs.select(F.col("id").alias("id"), F.md5(text).alias("h"), F.length(text).alias("len"))
    again = (
        keyed.where("len > 0")
        .groupBy("h", "len")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .where("n > 1")
    )
    shown = docs.select(F.col("id").alias("id"), text.alias("value")).withColumns(
        {"h": F.md5("value"), "len": F.length("value")}
    )
    texts = (
        shown.join(again, ["id", "h", "len"])
        .dropDuplicates(["h", "len"])
        .select(F.lit("text").alias("kind"), "value", "n")
    )
    return ids.unionByName(texts)


def dup_totals(docs: DataFrame) -> DataFrame:
    """Entries, distinct ids and distinct texts.

    Two plain group counts: a distinct count of both columns at once would
    expand every row twice, texts included.
    """
    ids = docs.groupBy(F.col("id")).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total_entries"), F.count("*").alias("unique_ids")
    )
    texts = docs.groupBy(F.md5(strip(F.col("data.text"))).alias("h")).agg(F.lit(1)).agg(
        F.count("*").alias("unique_texts")
    )
    return ids.join(F.broadcast(texts))


#: Places in which the rows of a crowded fingerprint learn how many keys it has.
FANS = 64


def near_dup_hash(messages: DataFrame, id_column: str, rows_per_key: int = 100_000) -> DataFrame:
    """Rows whose normalised text was seen under a smaller id.

    Ids and fingerprints are staged, so texts are read and normalised once.
    Only fingerprints that repeat are joined back, under as many salted keys as
    the copies of the most common one fill, ``rows_per_key`` each; a text
    with fewer copies uses the first few of them only.
    """
    marked = stage(
        messages.select(F.col(id_column).alias("id"), fingerprint(F.col("text")).alias("hash")), "prints"
    )
    groups = (
        marked.groupBy("hash")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    groups = stage(groups, "repeated")
    keys = F.ceil(F.col("copies") / F.lit(rows_per_key)).cast("int")
    crowded = groups.where(keys > 1).select("hash", keys.alias("keys"))
    # the number of keys reaches the rows in FANS places, so the copies of one text do not meet for it
    fan = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FANS)).cast("int").alias("fan")
    fanned = crowded.withColumn("fan", F.explode(F.sequence(F.lit(0), F.lit(FANS - 1))))
    salted = marked.select("id", "hash", fan).join(fanned, ["hash", "fan"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("keys")), F.lit(0)).cast("int")
    )
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), keys - 1)))
    return salted.join(dealt, ["hash", "salt"]).where("id > first_id").select(
        "id", "first_id", "hash", "copies"
    )


def _issues() -> Column:
    """The structural issues of a document as an array of texts."""

    def entry_issues(results: Column) -> Column:
        def of(r: Column, i: Column) -> Column:
            v = r["value"]

            def say(cond: Column, text: str) -> Column:
                return F.when(cond, F.concat(F.lit("result "), i.cast("string"), F.lit(f" missing {text}")))

            return F.when(v.isNull(), F.array(say(F.lit(True), "value field"))).otherwise(
                F.array(
                    say(v["start"].isNull() | v["end"].isNull(), "start/end"),
                    say(v["text"].isNull(), "text"),
                    say(v["labels"].isNull(), "labels"),
                )
            )

        return F.array_compact(F.flatten(F.transform(results, of)))

    first = F.get("annotations", F.lit(0))
    return (
        F.when(F.col("annotations").isNull(), F.array(F.lit("missing annotations field")))
        .when(F.size("annotations") == 0, F.array().cast("array<string>"))
        .when(first["result"].isNull(), F.array(F.lit("missing result field")))
        .otherwise(entry_issues(first["result"]))
    )


def structure_issues(docs: DataFrame) -> DataFrame:
    """One row per structural issue.  An absent field and a JSON null are the
    same under a fixed schema; both count as missing."""
    return docs.select(F.col("id").alias("message_id"), F.explode(_issues()).alias("issue"))


def integrity_vs_original(docs: DataFrame, original: DataFrame) -> DataFrame:
    """Documents whose text differs from the original of the same id.

    ``original``: id, text.  Non-augmented texts must be equal; augmented ones
    are checked by ``meta.original_text`` where it is present.
    """
    base = one_text_per_id(original).withColumnRenamed("text", "expected")
    joined = docs.join(base, "id")
    augmented = F.coalesce(F.col("meta.is_augmented"), F.lit(False))
    source = strip(F.col("meta.original_text"))
    current = strip(F.col("data.text"))
    issue = F.when(
        augmented, F.when(source != F.col("expected"), "original text mismatch")
    ).otherwise(F.when(current != F.col("expected"), "message text altered"))
    got = F.when(augmented, source).otherwise(current)
    return joined.select(
        F.col("id").alias("message_id"),
        issue.alias("issue"),
        "expected",
        got.alias("got"),
    ).where(F.col("issue").isNotNull())


def one_text_per_id(df: DataFrame, order: str | None = None) -> DataFrame:
    """Trimmed text per id; of repeated ids the last by ``order`` counts (the
    greatest text without one).  Combined before the shuffle, so a very
    common id reaches the join as one row."""
    text = strip(F.col("text"))
    pick = F.max(text) if order is None else F.max_by(text, F.col(order))
    return df.groupBy("id").agg(pick.alias("text"))


def cross_mismatches(left: DataFrame, right: DataFrame, order: str | None = None) -> DataFrame:
    """Ids on both sides whose texts differ, with both texts."""
    a = one_text_per_id(left, order).withColumnRenamed("text", "left_text")
    b = one_text_per_id(right, order).withColumnRenamed("text", "right_text")
    return a.join(b, "id").where(F.col("left_text") != F.col("right_text"))


def cross_check(left: DataFrame, right: DataFrame, order: str | None = None) -> DataFrame:
    """Ids common to both sides, on one side only, and text mismatches."""
    a = one_text_per_id(left, order).select("id", F.col("text").alias("a"), F.lit(True).alias("in_a"))
    b = one_text_per_id(right, order).select("id", F.col("text").alias("b"), F.lit(True).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return a.join(b, "id", "full_outer").agg(
        F.count_if(both).alias("common"),
        F.count_if(F.col("in_b").isNull()).alias("left_only"),
        F.count_if(F.col("in_a").isNull()).alias("right_only"),
        F.count_if(both & (F.col("a") != F.col("b"))).alias("mismatches"),
    )


def _digested(docs: DataFrame, name: str) -> DataFrame:
    """What the checks need of a document, without its text; staged once."""
    current = strip(F.col("data.text"))
    augmented = F.coalesce(F.col("meta.is_augmented"), F.lit(False))
    compared = F.when(augmented, strip(F.col("meta.original_text"))).otherwise(current)
    slim = docs.select(
        "id",
        F.when(current != "", F.md5(current)).alias("text"),
        F.md5(compared).alias("compared"),
        (F.size(_issues()) > 0).alias("broken"),
    )
    return stage(slim, name)


def integrity_summary(
    claim_docs: DataFrame, entity_docs: DataFrame, original: DataFrame
) -> DataFrame:
    """Which of the six checks fail, and how many do.

    Documents are read once for all row-local checks, and only ids and digests are
    grouped and joined; the cross check compares one text per id.
    """
    expected = one_text_per_id(original).select("id", F.md5("text").alias("expected"))

    def flat(docs: DataFrame) -> DataFrame:
        return docs.select("id", F.col("data.text").alias("text"))

    def entry(name: str, failed: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.coalesce(failed, F.lit(False)).alias("failed"))

    def of(docs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        slim = _digested(docs, kind)
        values = slim.select(F.explode(F.array(F.struct(F.lit("id").alias("k"), F.nullif("id", F.lit("")).alias("v")), F.struct(F.lit("text").alias("k"), F.col("text").alias("v")))).alias("x"))
        counted = values.where(F.col("x.v").isNotNull()).groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
        again = counted.agg(entry(f"{kind}_duplicates", F.max("n") > 1).alias("e"))
        local = slim.agg(entry(f"{kind}_structure", F.bool_or("broken")).alias("e"))
        lost = slim.join(expected, "id").agg(F.bool_or(F.col("compared") != F.col("expected")).alias("lost"))
        return again.unionAll(local).select("e.*"), lost

    claims, lost_claims = of(claim_docs, "claim")
    entities, lost_entities = of(entity_docs, "entity")
    lost = lost_claims.unionAll(lost_entities).agg(entry("integrity", F.bool_or("lost")).alias("e"))
    crossed = cross_check(flat(claim_docs), flat(entity_docs)).select(
        entry("cross_check", F.col("mismatches") > 0).alias("e")
    )
    table = claims.unionAll(entities).unionAll(lost.select("e.*")).unionAll(crossed.select("e.*"))
    total = table.agg(F.count_if("failed").alias("total_issues"))
    return table.join(F.broadcast(total))


# ---------------------------------------------------------------- augmentation


def claim_coverage(docs: DataFrame) -> DataFrame:
    """Messages per expected claim type, their share, missing and low flags."""
    seen = (
        docs.select(F.explode("meta.claim_types").alias("claim_type"))
        .groupBy("claim_type")
        .agg(F.count("*").alias("n"))
    )
    total = docs.agg(F.count("*").alias("_all"))
    expected = type_dimension(docs.sparkSession).select("claim_type")
    return (
        expected.join(seen, "claim_type", "left")
        .join(F.broadcast(total))
        .select(
            "claim_type",
            F.coalesce("n", F.lit(0)).alias("n"),
            safe_ratio(F.coalesce("n", F.lit(0)), F.col("_all"), 100.0).alias("pct"),
            F.col("n").isNull().alias("missing"),
            F.coalesce(F.col("n") < LOW_COVERAGE, F.lit(False)).alias("low"),
        )
    )


def expected_minus_seen(docs: DataFrame) -> DataFrame:
    expected = type_dimension(docs.sparkSession).select("claim_type")
    seen = docs.select(F.explode("meta.claim_types").alias("claim_type"))
    return expected.join(seen, "claim_type", "left_anti")


def augmentation_stats(docs: DataFrame) -> DataFrame:
    """Originals, and augmented messages by type as a share of the augmented."""
    augmented = F.coalesce(F.col("meta.is_augmented"), F.lit(False))
    kind = F.when(
        augmented, F.coalesce(F.col("meta.augmentation_type"), F.lit("unknown"))
    ).otherwise("original")
    counts = docs.groupBy(augmented.alias("is_augmented"), kind.alias("kind")).agg(
        F.count("*").alias("n")
    )
    total = counts.where("is_augmented").agg(F.sum("n").alias("_aug"))
    return counts.join(F.broadcast(total)).select(
        "is_augmented",
        "kind",
        "n",
        F.when(F.col("is_augmented"), safe_ratio(F.col("n"), F.col("_aug"), 100.0)).alias("pct"),
    )


def augment_verdict(docs: DataFrame) -> DataFrame:
    """One row of counts and the list of failed thresholds.

    One pass: everything is counted per fingerprint, then over the fingerprints.
    """
    length = F.length("data.text")
    types = [
        F.bool_or(F.coalesce(F.array_contains("meta.claim_types", t), F.lit(False))).alias(t)
        for t in CLAIM_TYPES
    ]
    prints = docs.groupBy(fingerprint(F.col("data.text")).alias("h")).agg(
        F.count("*").alias("n"),
        F.count_if(length < 50).alias("short"),
        F.count_if(length > 160).alias("long"),
        *types,
    )
    unseen = [F.when(F.coalesce(F.bool_or(t), F.lit(False)), 0).otherwise(1) for t in CLAIM_TYPES]
    row = prints.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("short"), F.lit(0)).alias("too_short"),
        F.coalesce(F.sum("long"), F.lit(0)).alias("too_long"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        sum(unseen[1:], unseen[0]).cast("long").alias("missing_types"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("duplicates") > 0, "duplicates"),
            F.when(F.col("too_short") > F.col("total") * MAX_SHORT_SHARE, "too_short"),
            F.when(F.col("too_long") > F.col("total") * MAX_LONG_SHARE, "too_long"),
            F.when(F.col("missing_types") > 0, "missing_types"),
        )
    )
    return row.withColumn("issues", F.array_join(issues, ","))


def balance_metadata(docs: DataFrame) -> DataFrame:
    ham = F.col("meta.label").eqNullSafe(F.lit("ham"))
    augmented = F.coalesce(F.col("meta.is_augmented"), F.lit(False))
    counts = docs.agg(
        F.count("*").alias("total_messages"),
        F.count_if(~ham).alias("phishing_messages"),
        F.count_if(ham).alias("ham_messages"),
        F.count_if(~ham & ~augmented).alias("original_phishing"),
        F.count_if(~ham & augmented).alias("augmented_phishing"),
    )
    return counts.withColumn(
        "balance_ratio", F.concat_ws(":", "phishing_messages", "ham_messages")
    )


# ---------------------------------------------------------------- exploration


def eda_summary(rows: DataFrame) -> DataFrame:
    """Overview numbers in long form (item, value).

    All of them come from one table of value counts: message lengths, word
    counts, entity counts and entity lengths by type.  It is as large as the
    number of different lengths, not as the data.
    """

    def entry(kind: str, claim_type: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), claim_type.alias("claim_type"), value.cast("long").alias("value")
        )

    none = F.lit(None).cast("string")
    entries = F.concat(
        F.array(
            entry("char_length", none, F.length("text")),
            entry("word_count", none, word_count(F.col("text"))),
            entry("entities_per_message", none, F.size("spans")),
        ),
        F.transform("spans", lambda s: entry("entity_length", s["claim_type"], F.length(s["text"]))),
    )
    counted = (
        rows.select(F.explode(entries).alias("e"))
        .groupBy("e.kind", "e.claim_type", "e.value")
        .agg(F.count("*").alias("n"))
    )
    kind, value, n = F.col("kind"), F.col("value"), F.col("n")

    def of(name: str, x: Column) -> Column:
        return F.when(kind == name, x)

    def mean(name: str, extra: Column = F.lit(True)) -> Column:
        return F.sum(F.when(extra, of(name, value * n))) / F.sum(F.when(extra, of(name, n)))

    def median(name: str) -> Column:
        # value counts are few, so the exact percentile's state is small
        return F.percentile(of(name, value), 0.5, F.when(kind == name, n).otherwise(F.lit(0)))

    overview = counted.agg(
        F.sum(of("char_length", n)).alias("total_messages"),
        F.sum(of("entity_length", n)).alias("total_entities"),
        mean("entities_per_message", value > 0).alias("avg_entities_per_message"),
        F.count_distinct(F.col("claim_type")).alias("entity_types"),
        mean("char_length").alias("avg_char_length"),
        median("char_length").alias("median_char_length"),
        F.min(of("char_length", value)).alias("min_char_length"),
        F.max(of("char_length", value)).alias("max_char_length"),
        mean("word_count").alias("avg_word_count"),
        median("word_count").alias("median_word_count"),
        mean("entity_length").alias("avg_entity_length"),
        median("entity_length").alias("median_entity_length"),
        F.min(of("entity_length", value)).alias("min_entity_length"),
        F.max(of("entity_length", value)).alias("max_entity_length"),
    )
    long = overview.select(*[F.col(c).cast("double").alias(c) for c in overview.columns]).unpivot(
        [], overview.columns, "item", "value"
    )
    by_type = with_share(
        counted.where(kind == "entity_length").groupBy("claim_type").agg(F.sum("n").alias("n")), "n", "pct", 100.0
    )
    per_type = by_type.select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("n:"), "claim_type").alias("item"), F.col("n").cast("double").alias("value")),
                F.struct(F.concat(F.lit("pct:"), "claim_type").alias("item"), F.round("pct", 2).alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    return long.unionByName(per_type)


def entity_length_by_type(rows: DataFrame) -> DataFrame:
    """Mean and quartiles of entity length per type, longest first."""
    lengths = rows.select(F.explode("spans").alias("s")).select(
        F.col("s.claim_type").alias("claim_type"), F.length("s.text").alias("n")
    )
    means = lengths.groupBy("claim_type").agg(F.avg("n").alias("avg_length"))
    quartiles = exact_quantiles(
        lengths, ["claim_type"], "n", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return means.join(quartiles, "claim_type").orderBy(F.col("avg_length").desc(), "claim_type")


def type_cooccurrence(rows: DataFrame, k: int = 15) -> DataFrame:
    """Unordered pairs of distinct types in one message, the k most frequent.

    Pairs are built inside the row: a message has at most 13 types.
    """
    types = F.sort_array(F.array_distinct(F.transform("spans", lambda s: s["claim_type"])))
    pairs = let(
        types,
        lambda ts: F.flatten(
            F.transform(
                ts,
                lambda a, i: F.transform(
                    F.slice(ts, i + 2, F.size(ts)),
                    lambda b: F.struct(a.alias("type_a"), b.alias("type_b")),
                ),
            )
        ),
    )
    return (
        rows.select(F.explode(pairs).alias("p"))
        .groupBy("p.type_a", "p.type_b")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "type_a", "type_b")
        .limit(k)
    )


def freq_desc(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Values by falling frequency; with ``k`` only the first, and rare values are not shuffled."""
    if k is not None:
        df = top_values(df, [], column, k).drop("rank")
        return df.orderBy(F.col("n").desc(), F.col(column))
    return (
        df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column))
    )


def top_entities_per_type(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent surface texts of each type; rare texts are ruled out before the shuffle."""
    spans = rows.select(F.explode("spans").alias("s")).select("s.claim_type", "s.text")
    return top_values(spans, ["claim_type"], "text", k)
