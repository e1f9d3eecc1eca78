"""A log-bilinear language model, trained by noise-contrastive estimation.

The model speaks of units: the end of a text, the most frequent words, and classes of all
other words by their last two bytes.  Every unit has a vector as context and one as
target; the two units before a token, each through a matrix of its own, add up to a
predicted vector, and a unit's logit is its product with the unit's target vector plus a
bias.  A word of a class then has its share of the class by counts with absolute
discounting; what the discount frees is the probability of an unknown word, which is one
event of each class.  So the probabilities of all known words, the end and the unknown
events sum to one in every context; the sum over units is a batch of matrix products.

Training passes once over all training texts, in rounds.  In a round every task takes
its texts of that round, starts from the common parameters and descends the
noise-contrastive loss in numpy; noise units are drawn from the counts and shared by a
mini-batch.  Spark then averages the tasks' parameters, weighted by tokens.  Parameters
are a few thousand rows, whatever the input.

Counts cover the whole corpus.  The ``FREQUENT`` most frequent words at most travel to
the tasks (16 MB); the others are joined by hash.  Such a word is rare in the corpus
and counted once per text, so no key of that join is hot.

Defined cases: a null text is an empty one, which is its end alone; a null doc_id counts
as the empty string when texts are dealt; repeated rows are separate texts; with no
training text every token is unknown and the units have equal probabilities; an empty
table gives no rows; columns other than doc_id and text are ignored; words are compared
by 64-bit hashes; a very long text is tokenised in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .shingles import mix
from .tokens import WORDS, Lookup, groups, hashed

UNITS = 2048
CLASSES = 256
FREQUENT = 1 << 20
WIDTH = 32
ROUNDS = 3
BATCH = 2048
NOISE = 48
RATE = 0.15
HELD = 1 << 21
SEEN_COUNTS = 1024
END = np.uint64(0xE5D0E5D0E5D0E5D1)

ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, "
    "units binary, rare array<struct<hash:long,cls:int,times:long>>"
)


def class_of(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    ending = before.astype(np.uint64) * np.uint64(256) + last
    return (mix(ending + np.uint64(77)) % np.uint64(CLASSES)).astype(np.int64)


def parted(docs: DataFrame, fold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, text as bytes (null: empty) and held_out: crc32 of the id as text leaves ``fold``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        (F.crc32(name.cast("binary")) % folds == fold).alias("held_out"),
    )


def _combined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys = np.concatenate([h[0] for h in held])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    classes = np.concatenate([h[1] for h in held])[order][first]
    times = np.concatenate([h[2] for h in held])[order]
    return keys[first], classes, np.add.reduceat(times, first) if len(first) else times


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the task's texts with their counts, combined before they are sent."""

    def out(words):
        return pa.RecordBatch.from_arrays(
            [pa.array(words[0].view(np.int64)), pa.array(words[1].astype(np.int32)), pa.array(words[2])],
            names=["hash", "cls", "times"],
        )

    held, size, ends = [], 0, 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ends += len(texts)
        for _, parts in groups(texts, WORDS):
            _, keys, last, before = hashed(parts, WORDS)
            held.append(_combined([(keys, class_of(last, before), np.ones(len(keys), dtype=np.int64))]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_combined(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(_combined(held))
    if ends:
        yield out((np.array([END]), np.array([-1]), np.array([ends], dtype=np.int64)))


@dataclass
class Vocabulary:
    """Counts of a corpus: the rare words as a table, the rest as arrays."""

    counts: DataFrame
    least: int
    tokens: int
    distinct: int
    discount: float
    keys: np.ndarray
    times: np.ndarray
    unit: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    ends: int

    @property
    def unit_counts(self) -> np.ndarray:
        """Training tokens of each unit: the end, the words, the classes."""
        words = np.zeros(UNITS - 1 - CLASSES)
        chosen = self.unit > 0
        words[self.unit[chosen] - 1] = self.times[chosen]
        return np.concatenate(([self.ends], words, self.class_tokens)).astype(np.float64)

    def arrays(self) -> dict:
        return {
            "keys": self.keys, "times": self.times, "unit": self.unit, "discount": self.discount,
            "class_tokens": self.class_tokens, "ends": self.ends,
        }


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts every word of the rows (doc_id, text as bytes) given."""
    parts = docs.select("text").mapInArrow(_counts, "hash long, cls int, times long")
    counts = stage(parts.groupBy("hash").agg(F.max("cls").alias("cls"), F.sum("times").alias("times")), "words")
    words = counts.where(F.col("cls") >= 0)
    cell = F.least("times", F.lit(SEEN_COUNTS)).alias("cell")
    cells = {r["cell"]: (r["n"], r["t"]) for r in words.groupBy(cell).agg(F.count("*").alias("n"), F.sum("times").alias("t")).collect()}
    ends = sum(r["times"] for r in counts.where("cls < 0").select("times").collect())
    tokens = sum(t for _, t in cells.values()) + ends
    room, least = FREQUENT, max(SEEN_COUNTS + 1, tokens // FREQUENT + 1)
    for times in sorted(cells, reverse=True):
        room -= cells[times][0]
        if room < 0:
            break
        least = times
    once, twice = (cells.get(i, (0, 0))[0] for i in (1, 2))
    top = words.where(F.col("times") >= least).toArrow()
    keys = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, times, cls = keys[order], top.column("times").to_numpy()[order], top.column("cls").to_numpy()[order]
    first = np.lexsort((keys, -times))[: UNITS - 1 - CLASSES]
    unit = np.zeros(len(keys), dtype=np.int32)
    unit[first] = np.arange(1, len(first) + 1)
    class_tokens, class_words = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in words.groupBy("cls").agg(F.sum("times").alias("t"), F.count("*").alias("n")).collect():
        class_tokens[r["cls"]], class_words[r["cls"]] = r["t"], r["n"]
    np.subtract.at(class_tokens, cls[first], times[first])
    np.subtract.at(class_words, cls[first], 1)
    return Vocabulary(
        words.where(F.col("times") < least), least, tokens, sum(n for n, _ in cells.values()) + (ends > 0),
        min(max(once / max(once + 2 * twice, 1), 0.1), 0.9), keys, times, unit, class_tokens, class_words, ends,
    )


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Texts (doc_id, text as bytes, held_out) as units, with the sums of the frequent words, written once.

    ``base`` adds up log10(c + 1) and ``share`` log10 of the share in the class; for a rare
    word ``share`` has the part of the class and ``rare`` the word.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab.arrays())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        lookup = Lookup(known["keys"])
        per_class = np.log10(np.maximum(known["class_tokens"], 1).astype(np.float64))
        base_log = np.append(np.log10(known["times"] + 1.0), 0.0)
        left_log = np.append(np.log10(known["times"] - known["discount"]), 0.0)
        unit = np.append(known["unit"], 0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            count, seen, base, share = (np.zeros(n, dtype=t) for t in (np.int64, np.int64, np.float64, np.float64))
            units: list[list[bytes]] = [[] for _ in range(n)]
            rare: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
            for rows, parts in groups(texts, WORDS):
                part, keys, last, before = hashed(parts, WORDS)
                cls = class_of(last, before)
                at = lookup(keys)
                own = unit[at]
                made = np.where(own > 0, own, UNITS - CLASSES + cls).astype("<u2")
                in_class = np.where(own > 0, 0.0, left_log[at] - per_class[cls])
                bounds = np.searchsorted(part, np.arange(len(parts) + 1))
                totals = [np.concatenate(([0.0], np.cumsum(x))) for x in (base_log[at], in_class, at >= 0)]
                odd = np.flatnonzero(at < 0)
                odd_bounds = np.searchsorted(odd, bounds)
                odd_keys, odd_cls = keys[odd], cls[odd]
                for i, doc in enumerate(rows):
                    a, b = bounds[i], bounds[i + 1]
                    count[doc] += b - a
                    base[doc] += totals[0][b] - totals[0][a]
                    share[doc] += totals[1][b] - totals[1][a]
                    seen[doc] += int(totals[2][b] - totals[2][a])
                    units[doc].append(made[a:b].tobytes())
                    a, b = odd_bounds[i], odd_bounds[i + 1]
                    if b > a:
                        rare[doc].append((odd_keys[a:b], odd_cls[a:b]))
            end = b"\0\0"
            lists, hashes, classes, times = [0], [], [], []
            for words in rare:
                if words:
                    keys, where, n_each = np.unique(np.concatenate([w[0] for w in words]), return_index=True, return_counts=True)
                    hashes.append(keys)
                    classes.append(np.concatenate([w[1] for w in words])[where])
                    times.append(n_each)
                lists.append(lists[-1] + (len(hashes[-1]) if words else 0))
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (hashes, classes, times)]
            structs = pa.StructArray.from_arrays(
                [
                    pa.array(flat[0].astype(np.uint64).view(np.int64)),
                    pa.array(flat[1].astype(np.int32)),
                    pa.array(flat[2].astype(np.int64)),
                ],
                names=["hash", "cls", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(count + 1),
                    pa.array(seen + (known["ends"] > 0)),
                    pa.array(base + np.log10(known["ends"] + 1.0)),
                    pa.array(share),
                    pa.array([b"".join(u) + end for u in units], type=pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists, type=pa.int32()), structs),
                ],
                names=[f.split()[0] for f in ENCODED.split(", ")],
            )
            row += n

    return stage(docs.select("doc_id", "text", "held_out").mapInArrow(encoded, ENCODED), "units")


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of texts in a row, the unit before, the one before that, and where texts start."""
    units = np.frombuffer(b"".join(texts), dtype="<u2").astype(np.int64)
    start = np.cumsum([0, *(len(t) // 2 for t in texts)])[:-1]
    one, two = np.empty_like(units), np.empty_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    second = start + 1
    one[start] = two[start] = UNITS
    two[second[second < len(units)]] = UNITS
    return units, one, two, start


@dataclass
class Model:
    """Context vectors, target vectors with biases, one matrix for each place; adagrad sums."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray
    squares: np.ndarray

    @classmethod
    def start(cls, unit_counts: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        width = WIDTH
        return cls(
            rng.normal(0, 0.1, (UNITS + 1, width)).astype(np.float32),
            rng.normal(0, 0.1, (UNITS, width)).astype(np.float32),
            np.log(noise_of(unit_counts)).astype(np.float32),
            np.concatenate((np.eye(width), 0.5 * np.eye(width))).astype(np.float32),
            np.full(2 * UNITS + 1 + 2 * width, 1e-3, dtype=np.float32),
        )

    def rows(self) -> np.ndarray:
        vectors = np.concatenate((self.context, self.target, self.place))
        bias = np.zeros(len(vectors), dtype=np.float32)
        bias[UNITS + 1 : 2 * UNITS + 1] = self.bias
        return np.column_stack((vectors, bias, self.squares))

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Model:
        rows = rows.astype(np.float32)
        a, b = UNITS + 1, 2 * UNITS + 1
        parts = rows[:a, :WIDTH], rows[a:b, :WIDTH], rows[a:b, WIDTH], rows[b:, :WIDTH], rows[:, WIDTH + 1]
        return cls(*(np.ascontiguousarray(p).copy() for p in parts))

    def learn(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One step on a mini-batch: real units against noise units shared by the batch."""
        a, b, w = UNITS + 1, 2 * UNITS + 1, WIDTH
        r1, r2 = self.context[one], self.context[two]
        hidden = r1 @ self.place[:w] + r2 @ self.place[w:]
        q, qn = self.target[unit], self.target[noise]
        real = np.einsum("ij,ij->i", hidden, q) + self.bias[unit] - log_noise[unit]
        fake = hidden @ qn.T + (self.bias[noise] - log_noise[noise])
        g_real = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        g_fake = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        g_hidden = g_real[:, None] * q + g_fake @ qn
        self._add(self.context, self.squares[:a], np.concatenate((one, two)), np.concatenate((g_hidden @ self.place[:w].T, g_hidden @ self.place[w:].T)))
        targets = np.concatenate((unit, noise))
        vectors = np.concatenate((g_real[:, None] * hidden, g_fake.T @ hidden))
        biases = np.concatenate((g_real, g_fake.sum(0)))
        self._add(self.target, self.squares[a:b], targets, vectors, self.bias, biases)
        g_place = np.concatenate((r1.T @ g_hidden, r2.T @ g_hidden)) / len(unit)
        self.squares[b:] += np.mean(g_place * g_place, axis=1)
        self.place += 0.1 * RATE * g_place / np.sqrt(self.squares[b:] + 1e-6)[:, None]

    @staticmethod
    def _add(vectors, squares, rows, steps, bias=None, bias_steps=None) -> None:
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        own = rows[first]
        summed = np.add.reduceat(steps[order], first)
        squares[own] += np.mean(summed * summed, axis=1)
        rate = RATE / np.sqrt(squares[own])
        vectors[own] += summed * rate[:, None]
        if bias is not None:
            bias[own] += np.add.reduceat(bias_steps[order], first) * np.minimum(rate, RATE)

    def log_sums(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the sum over all units for each context, by matrix products of bounded size."""
        first, second = self.context @ self.place[:WIDTH], self.context @ self.place[WIDTH:]
        made = np.empty(len(one), dtype=np.float32)
        for at in range(0, len(one), 1024):
            logits = (first[one[at : at + 1024]] + second[two[at : at + 1024]]) @ self.target.T
            logits += self.bias
            top = logits.max(axis=1)
            logits -= top[:, None]
            np.exp(logits, out=logits)
            made[at : at + 1024] = top + np.log(logits.sum(axis=1))
        return made


def noise_of(unit_counts: np.ndarray) -> np.ndarray:
    """Shares of the units by counts; one never seen has half a token."""
    held = np.maximum(unit_counts, 0.5)
    return held / held.sum()


def train(encoded: DataFrame, vocab: Vocabulary) -> Model:
    """One pass over the encoded training texts in ``ROUNDS`` rounds of averaged descent."""
    noise_share = noise_of(vocab.unit_counts)
    model = Model.start(vocab.unit_counts)
    names = [f"v{i}" for i in range(WIDTH + 2)]
    context = encoded.sparkSession.sparkContext
    for number in range(ROUNDS):
        sent = context.broadcast((model.rows(), noise_share))

        def learnt(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            rows, share = sent.value
            own = Model.of_rows(rows)
            log_noise = np.log(share * NOISE).astype(np.float32)
            upto = np.cumsum(share)
            rng = np.random.default_rng([number, TaskContext.get().partitionId()])
            tokens = 0
            for batch in batches:
                texts = batch.column("units").to_pylist()
                for at in range(0, len(texts), 512):
                    unit, one, two, _ = contexts(texts[at : at + 512])
                    order = rng.permutation(len(unit))
                    for i in range(0, len(unit), BATCH):
                        part = order[i : i + BATCH]
                        noise = np.minimum(np.searchsorted(upto, rng.random(NOISE)), UNITS - 1)
                        own.learn(unit[part], one[part], two[part], noise, log_noise)
                    tokens += len(unit)
            if tokens:
                made = own.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(made), dtype=np.int32)), pa.array(np.full(len(made), tokens, dtype=np.int64)), *(pa.array(made[:, i]) for i in range(made.shape[1]))],
                    names=["k", "tokens", *names],
                )

        own = encoded.where(f"pmod(xxhash64(row), {ROUNDS}) = {number}").select("units")
        parts = own.mapInArrow(learnt, "k int, tokens long, " + ", ".join(f"{n} float" for n in names))
        means = parts.groupBy("k").agg(*(F.expr(f"sum(double({n}) * tokens) / sum(tokens)").alias(n) for n in names))
        got = means.toArrow()
        if got.num_rows:
            rows = np.column_stack([got.column(n).to_numpy() for n in names])
            model = Model.of_rows(rows[np.argsort(got.column("k").to_numpy())])
        sent.unpersist()
    return model


_CACHE: dict = {}


def _scorer(model_rows: np.ndarray, key: str):
    """Log-probabilities of units; a worker keeps the sums of the contexts that it has met."""
    if _CACHE.get("key") != key:
        model = Model.of_rows(model_rows)
        one = model.context @ model.place[:WIDTH] @ model.target.T + model.bias
        two = model.context @ model.place[WIDTH:] @ model.target.T
        sums = np.full((UNITS + 1) * (UNITS + 1), np.nan, dtype=np.float32)
        _CACHE.update(key=key, model=model, one=one.ravel(), two=two.ravel(), sums=sums)
    model, logits_one, logits_two, sums = (_CACHE[k] for k in ("model", "one", "two", "sums"))

    def scored(unit, one, two):
        pair = one * (UNITS + 1) + two
        made = sums[pair]
        absent = np.isnan(made)
        if absent.any():
            new = np.unique(pair[absent])
            sums[new] = model.log_sums(new // (UNITS + 1), new % (UNITS + 1))
            made = sums[pair]
        return (logits_one[one * UNITS + unit] + logits_two[two * UNITS + unit] - made).astype(np.float64)

    return scored


def score(encoded: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """One row per encoded text with its base score and its log10 probability under the model."""
    rows = model.rows()
    key = str(hash(rows.tobytes()))
    sent = encoded.sparkSession.sparkContext.broadcast(rows)
    log10e = float(np.log10(np.e))

    def unit_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(sent.value, key)
        for batch in batches:
            texts = batch.column("units").to_pylist()
            sums = np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                unit, one, two, start = contexts(texts[at : at + 512])
                sums[at : at + len(start)] = np.add.reduceat(scored(unit, one, two), start) * log10e
            kept = [n for n in batch.schema.names if n != "units"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sums)], names=[*kept, "neural"])

    plain = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double"
    of_units = encoded.drop("rare").select(*[f.split()[0] for f in plain.split(", ")], "units").mapInArrow(unit_scores, f"{plain}, neural double")
    freed = F.create_map(*[x for c in range(CLASSES) for x in (F.lit(c), F.lit(_freed(vocab, c)))])
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.hash", "r.cls", F.col("r.times").alias("n"))
    rare = rare.join(vocab.counts.select("hash", "times"), "hash", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("times").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("times", F.lit(0)) + 1.0)).alias("rare_base"),
        F.sum(
            F.col("n") * F.coalesce(F.log10(F.col("times") - F.lit(vocab.discount)), freed[F.col("cls")])
        ).alias("rare_share"),
    )
    whole = float(np.log10(vocab.tokens + vocab.distinct + 1.0))
    return of_units.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("neural") + F.col("share") + F.coalesce("rare_share", F.lit(0.0))).alias("score"),
    )


def _freed(vocab: Vocabulary, cls: int) -> float:
    """log10 of the tokens that the discount frees in a class; a class without words is all unknown."""
    words = int(vocab.class_words[cls])
    return float(np.log10(vocab.discount * words)) if words else 0.0


def report(docs: DataFrame) -> DataFrame:
    """Learns from the texts that are not held out and scores all of them."""
    rows = parted(docs)
    vocab = vocabulary(rows.where("not held_out"))
    encoded = encode(rows, vocab)
    return score(encoded, vocab, train(encoded.where("not held_out"), vocab))
