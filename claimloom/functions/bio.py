"""BIO tags: encoding from spans, decoding to spans, entity chunks.

All of it works on the arrays of one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import count_below, indices, let, ranges_hit
from .constants import MODEL_TYPES

IGNORED = -100


def _one_hit(hits: Column, last: bool) -> Column:
    """Of (l, r) pairs keep one per l: the first or the last r."""
    return let(
        F.sort_array(hits),
        lambda xs: F.filter(
            xs,
            (lambda x, i: F.coalesce(F.get(xs, i + 1)["l"] != x["l"], F.lit(True)))
            if last
            else (lambda x, i: (i == 0) | (F.get(xs, i - 1)["l"] != x["l"])),
        ),
    )


def _spread(n: Column, tagged: Column) -> Column:
    """Tags for all n positions from (idx, tag) entries in idx order: the
    gaps between them are filled with "O"."""

    def build(xs: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(xs, i)["idx"], F.lit(-1))

        def blanks(count: Column) -> Column:
            return F.array_repeat(F.lit("O"), count)

        filled = F.transform(
            xs, lambda x, i: F.concat(blanks(x["idx"] - at(i - 1) - 1), F.array(x["tag"]))
        )
        return F.concat(F.flatten(filled), blanks(n - at(F.size(xs) - 1) - 1))

    return let(tagged, build)


def word_hits(words: Column, spans: Column) -> Column:
    """array<struct<l, r>> of word and span positions that meet.

    ``words`` and ``spans`` are bound arrays; words follow each other in the
    text, so the words of a span are one range, found by bisection.
    """

    def ranges(starts: Column, ends: Column) -> Column:
        return F.flatten(
            F.transform(
                spans,
                lambda s, r: let(
                    F.struct(
                        count_below(ends, s["start"] + 1).alias("a"),
                        count_below(starts, s["end"]).alias("b"),
                    ),
                    lambda at: ranges_hit(at["a"], at["b"], r),
                ),
            )
        )

    return let(
        F.transform(words, lambda x: x["start"]),
        lambda starts: let(F.transform(words, lambda x: x["end"]), lambda ends: ranges(starts, ends)),
    )


def bio_encode_words(w: Column, ws: Column, spans: Column) -> Column:
    """One tag per word.  The first overlapping span in list order decides;
    a word is B when the span starts inside it or the word before carries
    another type, else I."""

    def build(words: Column, claims: Column) -> Column:
        hits = _one_hit(word_hits(words, claims), last=False)

        def tags(xs: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                span, word = F.get(claims, x["r"]), F.get(words, x["l"])
                opens = (word["start"] <= span["start"]) & (span["start"] < word["end"])
                before = F.get(xs, i - 1)
                goes_on = (before["l"] == x["l"] - 1) & (
                    F.get(claims, before["r"])["claim_type"] == span["claim_type"]
                )
                mark = F.when(opens | ~F.coalesce(goes_on, F.lit(False)), "B-").otherwise("I-")
                return F.struct(x["l"].alias("idx"), F.concat(mark, span["claim_type"]).alias("tag"))

            return F.transform(xs, one)

        return _spread(F.size(words), let(hits, tags))

    word_spans = F.zip_with(
        ws, w, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"))
    )
    return let(word_spans, lambda words: let(spans, lambda claims: build(words, claims)))


def tags_at(positions: Column, spans: Column, ascending: bool = False) -> Column:
    """The character tag at each position: the last span in list order that
    covers it decides; B at the span's first character, I after it.

    ``ascending`` promises positions in text order; others are put in order first.
    """

    def build(points: Column, claims: Column) -> Column:
        wide = F.transform(
            claims,
            lambda s: F.struct(s["start"], F.greatest(s["end"], s["start"] + 1).alias("end")),
        )
        hits = let(wide, lambda ws: _one_hit(word_hits(points, ws), last=True))

        def one(x: Column) -> Column:
            return let(
                F.struct(F.get(claims, x["r"]).alias("span"), F.get(points, x["l"]).alias("point")),
                lambda at: F.struct(
                    at["point"]["idx"].alias("idx"),
                    F.concat(
                        F.when(at["point"]["start"] == at["span"]["start"], "B-").otherwise("I-"), at["span"]["claim_type"]
                    ).alias("tag"),
                ),
            )

        tagged = F.transform(hits, one)
        return _spread(F.size(points), tagged if ascending else F.sort_array(tagged))

    points = F.transform(positions, lambda s, i: F.struct(s.alias("start"), (s + 1).alias("end"), i.alias("idx")))
    ordered = points if ascending else F.sort_array(points)
    return let(ordered, lambda p: let(spans, lambda c: build(p, c)))


def label_ids() -> Column:
    """tag -> id over the model's types; 0 is "O"."""
    cells = [F.lit("O"), F.lit(0)]
    for i, t in enumerate(MODEL_TYPES):
        cells += [F.lit(f"B-{t}"), F.lit(2 * i + 1), F.lit(f"I-{t}"), F.lit(2 * i + 2)]
    return F.create_map(*cells)


def bio_align_tokens(offsets: Column, text: Column, spans: Column) -> Column:
    """Label ids for token offsets: -100 for (0,0), 0 beyond the text."""
    def ids(offs: Column, tags: Column, n: Column) -> Column:
        return F.transform(
            offs,
            lambda o, i: F.when((o["start"] == 0) & (o["end"] == 0), F.lit(IGNORED))
            .when(o["start"] >= n, F.lit(0))
            .otherwise(F.coalesce(F.try_element_at(label_ids(), F.get(tags, i)), F.lit(0))),
        )

    def build(offs: Column) -> Column:
        tags = tags_at(F.transform(offs, lambda o: o["start"]), spans)
        return let(tags, lambda ts: let(F.length(text), lambda n: ids(offs, ts, n)))

    return let(offsets, build)


def bio_decode(tokens: Column, confidence: str = "mean") -> Column:
    """array<struct<start, end, claim_type, confidence>> from tagged tokens.

    B opens a claim and closes an open one; I of the same type extends it, I
    of another type is skipped without closing; O closes.  Tokens at (0, 0)
    are special and skipped.  ``confidence`` is "mean" over the claim's tokens
    or "pairwise": (so far + next) / 2 at every step.
    """

    def merge(members: Column) -> Column:
        if confidence == "mean":
            total = F.aggregate(members, F.lit(0.0), lambda a, m: a + m["confidence"])
            return total / F.size(members)
        rest = F.slice(members, F.lit(2), F.size(members))
        return F.aggregate(rest, F.get(members, F.lit(0))["confidence"], lambda a, m: (a + m["confidence"]) / 2)

    def claim(segment: Column) -> Column:
        kind = F.substr(F.get(segment, F.lit(0))["label"], F.lit(3))

        def close(members: Column) -> Column:
            return F.struct(
                F.get(members, F.lit(0))["start"].alias("start"),
                F.element_at(members, -1)["end"].alias("end"),
                kind.alias("claim_type"),
                merge(members).alias("confidence"),
            )

        stop = F.array_position(F.transform(segment, lambda t: t["label"]), F.lit("O"))
        alive = F.when(stop > 0, F.slice(segment, F.lit(1), (stop - 1).cast("int"))).otherwise(segment)
        return let(F.filter(alive, lambda t: F.substr(t["label"], F.lit(3)) == kind), close)

    def build(ts: Column) -> Column:
        opens = F.filter(
            indices(F.size(ts)), lambda i: F.startswith(F.get(ts, i)["label"], F.lit("B-"))
        )
        return let(
            opens,
            lambda starts: F.transform(
                starts,
                lambda s, k: let(
                    F.slice(ts, s + 1, F.coalesce(F.get(starts, k + 1), F.size(ts)) - s), claim
                ),
            ),
        )

    real = F.filter(tokens, lambda t: ~((t["start"] == 0) & (t["end"] == 0)))
    return let(real, build)


def tag_type(tag: Column) -> Column:
    return F.substr(tag, F.lit(3))


def entity_chunks(tags: Column) -> Column:
    """array<struct<claim_type, first, last>> of the tag runs.

    A run starts at B, at I after O and at a change of type.
    """

    def build(ts: Column) -> Column:
        def starts_at(i: Column) -> Column:
            tag, prev = F.get(ts, i), F.get(ts, i - 1)
            return F.coalesce(
                (tag != "O")
                & (
                    F.startswith(tag, F.lit("B-"))
                    | prev.isNull()
                    | (prev == "O")
                    | (tag_type(prev) != tag_type(tag))
                ),
                F.lit(False),
            )

        def ends_at(i: Column) -> Column:
            following = F.get(ts, i + 1)
            return (F.get(ts, i) != "O") & (
                following.isNull() | (following == "O") | starts_at(i + 1)
            )

        all_ = indices(F.size(ts))
        return F.zip_with(
            F.filter(all_, starts_at),
            F.filter(all_, ends_at),
            lambda a, b: F.struct(
                tag_type(F.get(ts, a)).alias("claim_type"), a.alias("first"), b.alias("last")
            ),
        )

    return let(tags, build)
