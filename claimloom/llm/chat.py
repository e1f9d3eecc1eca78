"""Chat formatting: records of many layouts to canonical turns, to one template.

A record is a JSON object.  Its schema fingerprint is the SHA-256 of its nested field
paths, sorted, with ``[]`` for the elements of a list.  The fingerprint selects a
declarative mapping: either a list of messages with the names of its role and text
fields, or an order of fields with their roles.  Nothing else of a record decides
how it is read.  A record whose fingerprint is not known, or whose roles and texts are not
all strings or null, is reported with the fingerprint, without layout and turns; so is one
that is no JSON or nested too deep to be read, with the fingerprint of an empty record.

The template writes a turn as ``<s>``, role, newline, text, ``</s>``.  Control strings
inside roles and texts are broken by a backslash after their first character, own
backslashes are doubled and newlines in roles written as ``\\n``, so no text can
forge a turn and the texts come back exactly.  The loss mask lists the spans, in
code points of the output, of the texts of ``LOSS_ROLES``.

Defined cases: a null text or role is empty; equal turn numbers are ordered by role and
text; an empty list of messages gives no turns and an empty output; repeated rows are
repeated turns; a null conversation id is one conversation; an empty table gives
no rows; other columns are ignored.  One conversation is one row, as its output is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates.
CONTROLS = [
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
]
OPEN, CLOSE = "<s>", "</s>"
LOSS_ROLES = frozenset({"assistant"})
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout is read.

    ``each`` names a list field (dots for nesting) whose elements have a ``role`` and a
    ``text`` field; ``roles`` renames roles.  Without it, ``fields`` are (role, names)
    pairs in turn order; the texts of several names are joined by a newline, absent
    or empty ones are left out, and a pair without any gives no turn unless ``keep``.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    keep: bool = False

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield fingerprint_of((*self.required, *more))

    def turns(self, record: dict) -> list[tuple[str, str]] | None:
        """None when a role or text is neither a string nor null."""
        made = self._turns(record)
        return made if all(isinstance(x, str) for turn in made for x in turn) else None

    def _turns(self, record: dict) -> list[tuple]:
        if self.each:
            rows: object = record
            for part in self.each.split("."):
                rows = rows[part]
            names = dict(self.roles)
            pairs = [("" if r.get(self.role) is None else r[self.role], "" if r.get(self.text) is None else r[self.text]) for r in rows]
            return [(names.get(role, role) if isinstance(role, str) else role, text) for role, text in pairs]
        made = []
        for role, names in self.fields:
            texts = [record.get(n) for n in names]
            texts = [t for t in texts if t is not None and (t != "" or self.keep)]
            if texts:
                made.append((role, "\n".join(texts) if all(isinstance(t, str) for t in texts) else texts))
        return made


GIVEN = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = [
    Mapping("messages", ("id", "messages[].content", "messages[].role"), each="messages", role="role", text="content"),
    Mapping(
        "conversations",
        ("id", "conversations[].from", "conversations[].value"),
        each="conversations",
        role="from",
        text="value",
        roles=GIVEN,
    ),
    Mapping(
        "dialog",
        ("id", "data.dialog[].speaker", "data.dialog[].utterance"),
        ("data.topic",),
        each="data.dialog",
        role="speaker",
        text="utterance",
        roles=GIVEN,
    ),
    Mapping(
        "prompt",
        ("id", "prompt", "completion"),
        ("system",),
        fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
        keep=True,
    ),
    Mapping(
        "instruction",
        ("id", "instruction", "output"),
        ("input", "system"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping("no messages", ("id", "messages[]"), each="messages", role="role", text="content"),
]


_MARKS = re.compile(r"[\\.\[\]{}\n]")


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; marks of paths inside names are escaped."""
    if isinstance(value, dict):
        found: set[str] = set()
        for key, inner in value.items():
            key = _MARKS.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], key)
            found |= paths(inner, f"{at}.{key}" if at else key)
        return found or {at + "{}"}
    if isinstance(value, list):
        found = set()
        for inner in value:
            found |= paths(inner, at + "[]")
        return found or {at + "[]"}
    return {at}


def fingerprint_of(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode("utf-8", "surrogatepass")).hexdigest()


_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\n])?")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {None: "", "\\": "\\", "n": "\n"}[m[1]], text)


def render(turns: list[tuple[str, str]], loss_roles=LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def whole(text: str) -> str:
    """The text with U+FFFD for halves of surrogate pairs, which UTF-8 cannot hold."""
    return _HALF.sub("\ufffd", text)


_HALF = re.compile("[\ud800-\udfff]")


def _read(known: dict[str, Mapping]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            marks, names, turns = [], [], []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw else {}
                    mark = fingerprint_of(paths(record))
                except (ValueError, RecursionError):
                    record, mark = {}, fingerprint_of(paths({}))
                mapping = known.get(mark)
                made = mapping.turns(record) if mapping else None
                marks.append(mark)
                names.append(mapping.name if made is not None else None)
                turns.append(made if made is None else [{"role": whole(r), "text": whole(t)} for r, t in made])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks), pa.array(names, type=pa.string()), pa.array(turns, type=kind)],
                names=["conv_id", "fingerprint", "layout", "turns"],
            )

    return run


def canonical(records: DataFrame, mappings: list[Mapping] | None = None) -> DataFrame:
    """conv_id, fingerprint, layout and turns of (conv_id, record) rows."""
    known = {mark: m for m in mappings or MAPPINGS for mark in m.fingerprints()}
    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record"))
    return rows.mapInArrow(_read(known), f"conv_id long, fingerprint string, layout string, turns {TURNS}")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        made = [render([(t["role"], t["text"]) for t in turns or []]) for turns in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([text for text, _ in made], type=pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in made], type=span),
            ],
            names=["conv_id", "formatted", "loss"],
        )


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, the formatted text and its loss spans, of (conv_id, turns) rows."""
    return turns.select("conv_id", "turns").mapInArrow(
        _formatted, "conv_id long, formatted string, loss array<struct<start:long,stop:long>>"
    )


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        turns = [parse(t) for t in texts]
        masked = ["".join(unescape(t[s["start"] : s["stop"]]) for s in ss) for t, ss in zip(texts, spans, strict=True)]
        joined = ["".join(f"{r}\n{t}\n" for r, t in ts) for ts in turns]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(ts) for ts in turns], type=pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                pa.array([len(x) for x in masked], type=pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in masked]),
                pa.array([len(t) for t in texts], type=pa.int64()),
            ],
            names=[f.split()[0] for f in DIGESTS.split(", ")],
        )


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold, read from nothing but them."""
    return output.select("conv_id", "formatted", "loss").mapInArrow(_back, DIGESTS)


def records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation of (conv_id, turn, role, text) rows.

    A user turn and its answer become a prompt record, with a system turn in front an
    instruction record; longer ones take turns between the two message layouts.
    """
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("t")
    )
    shape = F.transform("t", lambda t: t["role"])
    listed = F.lit("user"), F.lit("assistant")
    identity = F.col("conv_id").cast("string").alias("id")
    identity = F.coalesce(identity, F.lit("")).alias("id")

    def text(i: int, name: str) -> Column:
        return F.get(F.col("t"), F.lit(i))["text"].alias(name)

    def each(role: str, body: str, rename: bool) -> Column:
        def one(t: Column) -> Column:
            new = t["role"]
            if rename:
                new = F.when(new == "user", "human").when(new == "assistant", "gpt").otherwise(new)
            return F.struct(new.alias(role), t["text"].alias(body))

        return F.transform("t", one)

    prompt = F.to_json(F.struct(identity, text(0, "prompt"), text(1, "completion")))
    instruction = F.to_json(F.struct(identity, text(0, "system"), text(1, "instruction"), text(2, "output")))
    spoken = F.to_json(F.struct(identity, each("from", "value", True).alias("conversations")))
    plain = F.to_json(F.struct(identity, each("role", "content", False).alias("messages")))
    common = F.forall(shape, lambda r: r.isin("user", "assistant", "system"))
    nonempty = F.forall("t", lambda t: t["text"] != "")
    record = (
        F.when(shape == F.array(*listed), prompt)
        .when((shape == F.array(F.lit("system"), *listed)) & nonempty, instruction)
        .when(common & (F.pmod("conv_id", F.lit(2)) == 0), spoken)
        .otherwise(plain)
    )
    return rows.select("conv_id", record.alias("record"))
