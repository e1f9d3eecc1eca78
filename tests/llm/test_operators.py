"""Each operator against a plain version, and the defined cases of its docstring."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import (
    chat,
    decontam,
    graph,
    jaccard,
    langid,
    licenses,
    linededup,
    packing,
    substrings,
    suffix,
    surrogates,
    winnow,
)

from . import brute

CLASHES = "row, doc, tie, body, sig, n, at, a, b, token, own, copy, kept, lines, picked, d, t, gone".split(", ")
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)


def frame(spark, rows, parts=3):
    """Documents with columns whose names clash with those used inside."""
    full = [(d, t, None, *["x"] * len(CLASHES)) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, repeated lines, empty, null, long and repeated rows."""
    rng = random.Random(5)
    rows = []
    for i in range(30):
        rows.append((i, "\n".join(words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9)))))
    base = words(rng, 120)
    for i in range(12):
        edited = base.split(" ")
        for _ in range(i % 4):
            edited[rng.randrange(len(edited))] = f"e{i}"
        rows.append((100 + i, " ".join(edited)))
    shared = "\n".join(words(rng, 12) for _ in range(5))
    for i in range(6):
        rows.append((200 + i, words(rng, 8) + "\n" + shared + "\n" + words(rng, 9 + i)))
    rows += [
        (300, None),
        (301, ""),
        (302, "   \n \n  "),
        (303, "one"),
        (304, "one two three four"),
        (305, "One two  THREE four"),
        (306, rows[0][1]),
        (306, rows[0][1]),
        (307, words(rng, 5000)),
        (308, "a" * 1500),
        (None, rows[3][1]),
        (None, "null id and no partner at all here"),
        (309, "x\n" * 7),
    ]
    return rows


def keyed(rows):
    return sorted(rows, key=repr)


EMPTY = "doc_id long, text string, lang string"


# --- decontamination -------------------------------------------------------


def test_decontamination_matches_alignment_by_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 14, 10**6).split())) for i in range(6)] + [(90, "too short"), (91, None)]
    docs = []
    for i in range(40):
        text = words(rng, 60, 10**6)
        if i % 2:
            item = list(items[i % 6][1])
            for _ in range(i % 14):
                at = rng.randrange(len(item))
                kind = rng.randrange(3)
                item[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("qzx")]
            text = text[: 100 + i] + " ".join(["", "".join(item).upper(), ""]) + text[100 + i :]
        docs.append((i, text))
    docs += [(50, None), (51, ""), (52, items[0][1]), (52, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(frame(spark, docs), bench).collect()
    expected = set()
    for doc, text in docs:
        for item, wanted in items:
            y = decontam.normal(wanted)
            if len(y) >= decontam.MIN_CHARS:
                e = brute.least_edits(y, decontam.normal(text))
                if e <= decontam.budget(len(y), decontam.Q, decontam.ERROR_RATE)[0]:
                    expected.add((doc, item, e))
    best = {}
    for r in found:
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
    assert {(*k, v) for k, v in best.items()} == expected
    assert sum(r.doc_id == 52 for r in found) == 2
    parted = decontam.find(frame(spark, docs), bench, block_chars=100).collect()
    assert sorted(parted) == sorted(found)
    kept = decontam.clean(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _, _ in expected}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(frame(spark, [(1, "x")]), none).count() == 0
    assert decontam.clean(frame(spark, [(1, "x")]), none).count() == 1
    one = spark.createDataFrame([(1, "x y z " * 30)], "item_id long, text string")
    assert decontam.find(spark.createDataFrame([], EMPTY), one).count() == 0


# --- fingerprints ----------------------------------------------------------


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] is not None and r[0] != 306]
    got = {r.doc_id: r for r in winnow.compare(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1
        if edited == text:
            assert got[doc].near_edited == 1 and got[doc].edited_fingerprint == got[doc].fingerprint
    assert got[300].fingerprint == "" == got[301].fingerprint
    assert got[307].near_edited > 0.4


def rolled(spark, texts, units_of):
    """Run hashes of every text by a plain rolling hash: one unit leaves, one enters."""
    full = (1 << 64) - 1

    def turn(x, by):
        return ((x << by) | (x >> (64 - by))) & full

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    units = [units_of(text) for _, text in texts]
    frame_of = spark.createDataFrame([(u,) for u in sorted({u for us in units for u in us})], "u string")
    hashed = {r.u: r.h & full for r in frame_of.selectExpr("u", "xxhash64(u) AS h").collect()}
    runs = []
    for own in units:
        h = [hashed[u] for u in own]
        if len(h) < winnow.K:
            runs.append([tuple(map(signed, h))] if h else [])
            continue
        now = 0
        for x in h[: winnow.K]:
            now = turn(now, 1) ^ x
        out = [now]
        for gone, new in zip(h, h[winnow.K :]):
            now = turn(now, 1) ^ turn(gone, winnow.K) ^ new
            out.append(now)
        runs.append([signed(x) for x in out])
    whole = {x for r in runs for x in r if not isinstance(x, tuple)}
    short = {x for r in runs for x in r if isinstance(x, tuple)}
    made = spark.createDataFrame([(x,) for x in whole], "x long").selectExpr("x", "shiftright(xxhash64(x), 24) AS h")
    final = {r.x: r.h for r in made.collect()}
    made = spark.createDataFrame([(list(x),) for x in short], "x array<long>")
    final |= {tuple(r.x): r.h for r in made.selectExpr("x", "shiftright(xxhash64(xxhash64(x)), 24) AS h").collect()}
    return [[final[x] for x in r] for r in runs]


def test_winnowing_takes_the_rightmost_smallest_of_every_window(spark):
    rng = random.Random(4)
    texts = [(i, words(rng, n, 3)) for i, n in enumerate([0, 1, 4, 5, 6, 8, 9, 40, 200])]
    texts.append((9, "some words and " + "".join(rng.choices("abcd", k=60)) + " more words after that"))
    got = {}
    for r in winnow.fingerprint(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, set()).add((r.hash, r.position))

    def units_of(text):
        return [u for w in text.split() for u in ([w] if len(w) <= 16 else list(w))]

    for (doc, _), hashes in zip(texts, rolled(spark, texts, units_of), strict=True):
        expected = set()
        for i in range(max(1, len(hashes) - winnow.W + 1)) if hashes else []:
            window = hashes[i : i + winnow.W]
            at = max(j for j, h in enumerate(window) if h == min(window))
            expected.add((window[at], i + at))
        assert got.get(doc, set()) == expected


def test_texts_without_blanks_stay_alike_after_an_insertion(spark):
    rng = random.Random(6)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(600))
    row = winnow.compare(frame(spark, [(1, text[:50] + "x" + text[50:]), (2, text)])).collect()
    assert all(r.near_next > 0.95 for r in row)


def test_fingerprints_of_one_document_repeated_rows_and_none(spark):
    one = winnow.compare(frame(spark, [(1, "a b c d e f g h i")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert winnow.compare(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")])).count() == 3
    assert winnow.compare(spark.createDataFrame([], EMPTY)).count() == 0


# --- line dedup ------------------------------------------------------------


def test_line_dedup(spark, corpus):
    got = linededup.report(frame(spark, corpus)).collect()
    expected = []
    for (doc, text), kept in zip(corpus, brute.line_dedup(corpus), strict=True):
        n = len((text or "").split("\n"))
        expected.append((doc, n, n - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()))
    assert keyed(map(tuple, got)) == keyed(expected)
    kept = linededup.kept(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns
    texts = ["\n".join(k) for k in brute.line_dedup(corpus)]
    expected = [(d, t) for (d, o), t in zip(corpus, texts, strict=True) if t == (o or "") or t.strip(" ")]
    assert keyed((r.doc_id, r.text) for r in kept.collect()) == keyed(expected)
    assert linededup.report(spark.createDataFrame([], EMPTY)).count() == 0


# --- surrogates ------------------------------------------------------------

PRIVATE = [
    (1, "Write to Ann.Lee@mail.example.org or ANN.LEE@mail.example.org, call +1 (386) 555-3733."),
    (2, "ann.lee@mail.example.org from 10.20.30.40, card 4944339490429605 or 4944-3394-9042-9605"),
    (3, "Mr. John Smith, Mrs Mary Jones and Mr JOHN SMITH; Господин Иванов"),
    (4, "nothing private, v1.2.3.4.5 and 12 apples"),
    (5, None),
    (6, ""),
    (7, " ".join(f"a{i}@b.co" for i in range(10))),
    (7, " ".join(f"a{i}@b.co" for i in range(10))),
    (8, "x" * 100_000 + " ssn 123-45-6789"),
]


def passes_check(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark):
    rows = surrogates.replace(frame(spark, PRIVATE), "k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(PRIVATE)
    mails = re.findall(r"\S+@[\w.]+\w", got[1].text)
    assert mails[0].lower() == mails[1].lower() == re.findall(r"\S+@[\w.]+\w", got[2].text)[0]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z]{4}\.[a-z]{7}\.org", mails[0])
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", got[1].text) and "555-3733" not in got[1].text
    cards = re.findall(r"\d{16}|\d{4}(?:-\d{4}){3}", got[2].text)
    assert cards[0] == cards[1].replace("-", "") != "4944339490429605" and passes_check(cards[0])
    assert re.search(r"from (\d{1,3}\.){3}\d{1,3},", got[2].text) and "10.20.30.40" not in got[2].text
    names = re.match(r"Mr\. (\w+ \w+), Mrs (\w+ \w+) and Mr (\w+ \w+); Господин (\w+)", got[3].text)
    assert names[3] == names[1].upper()
    assert names[1].split()[0].endswith("n") and names[2].split()[0].endswith("na")
    assert re.fullmatch("[а-яА-Я]+", names[4])
    assert (got[4].text, got[5].text, got[6].text) == tuple(t for _, t in PRIVATE[3:6])
    short = got[7].text.split()
    assert len(set(short)) == 10 and not set(short) & {f"a{i}@b.co" for i in range(10)}
    assert got[8].n_entities == 1 and "123-45-6789" not in got[8].text
    assert surrogates.replace(spark.createDataFrame([], EMPTY), "k").count() == 0


def test_surrogates_stay_distinct_when_the_format_is_nearly_full(spark):
    real = [("email", f"{a}@b.co") for a in "abcdefghijklmnopqrstuvw"]
    table = surrogates.assign(spark.createDataFrame(real, "kind string, canonical string"), "k").collect()
    new = [r.surrogate for r in table]
    assert len(table) == len(real) == len(set(new)) and not set(new) & {c for _, c in real}


PEOPLE = [
    (1, "Mr John Smith met Dr Jane Roe. Later John Smith called Mr Smith, and Smith's friend Jane Roe left."),
    (2, "Smith and John Smith are not named by anyone here."),
    (3, "Frau Anna-Maria O'Neil; Dr O'Neil; Herr Prof. Kurz and Kurz, Kurzweil and Vor-Kurz"),
    (4, "Господин Иван Петров, Доктор Иван Петров и Петров"),
]


def test_names_are_met_again_without_their_form_of_address(spark):
    key = "k"
    rows = surrogates.replace(frame(spark, PEOPLE), key).collect()
    got = {r.doc_id: r for r in rows}
    john = r"(?P<john>[A-Z]\w+n) (?P<smith>[A-Z]\w+l)"
    jane = r"(?P<jane>[A-Z]\w+l) (?P<roe>[A-Z]\w+l)"
    shape = rf"Mr {john} met Dr {jane}\. Later (?P=john) (?P=smith) called Mr (?P=smith), and (?P=smith)'s friend (?P=jane) (?P=roe) left\."
    assert re.fullmatch(shape, got[1].text) and got[1].n_entities == 6
    assert not re.search("John|Smith|Jane|Roe", got[1].text)
    assert got[2].text == PEOPLE[1][1] and got[2].n_entities == 0
    shape = r"Frau (\w+na) (\w+l); Dr (\w+l); Herr Prof\. (\w+l) and (\w+l), Kurzweil and Vor-Kurz"
    found = re.fullmatch(shape, got[3].text)
    assert found and found[2] == found[3] and found[4] == found[5]
    found = re.fullmatch(r"Господин (\w+н) (\w+н), Доктор (\w+) (\w+) и (\w+)", got[4].text)
    assert found and found[1] == found[3] and found[2] == found[4] == found[5]
    other = {r.doc_id: r.text for r in surrogates.replace(frame(spark, PEOPLE), "another").collect()}
    assert other[1] != got[1].text and other[2] == got[2].text


def test_surrogates_by_a_plain_weaving(spark):
    """Texts equal a plain version that replaces the entities of ``found`` one to one."""
    rng = random.Random(12)
    given, family = ["Ana", "Bo", "Carl", "Dora"], ["Stone", "Wood", "Reed"]
    texts = []
    for i in range(60):
        bits = []
        for _ in range(rng.randrange(12)):
            one, two = rng.choice(given), rng.choice(family)
            title = rng.choice(["Mr", "Mrs", "Dr"])
            bits.append(rng.choice([f"{title} {one} {two}", f"{title} {two}", f"{one} {two}", two, "said that", f"{one}@{two}.com"]))
        texts.append((None if i % 7 == 0 else i // 2, ". ".join(bits)))
    texts += texts[:4]
    rows = frame(spark, texts)
    got = sorted((r.text, r.n_entities) for r in surrogates.replace(rows, "k").collect())
    listed = surrogates._listed(surrogates.found(rows).where("size(entities) > 0"))
    new = {(r.kind, r.canonical): r.surrogate for r in surrogates.assign(listed, "k").collect()}
    assert len({(kind, s) for (kind, _), s in new.items()}) == len(new)
    real = {(kind, c.split(":")[-1]) for kind, c in new}
    assert not {(kind, s) for (kind, _), s in new.items()} & real
    title = r"(?:(?:Mr|Mrs|Dr) )"
    expected = []
    for _, text in texts:
        titled = re.findall(title + r"(\w+(?: \w+)?)", text)
        known = sorted({n for t in titled for n in (t, t.split()[-1])}, key=len, reverse=True)
        gender = {}
        for t, n in re.findall(r"(Mr|Mrs) (\w+ \w+)", text):
            gender.setdefault(n, "m" if t == "Mr" else "f")
        alone = "|".join([r"\b\w+@\w+\.com", title + r"\w+(?: \w+)?", *(rf"\b{n}\b" for n in known)])
        n = 0

        def put(match):
            nonlocal n
            n += 1
            raw = match[0]
            if "@" in raw:
                s = new["email", raw.lower()]
                return "".join(c.upper() if i < len(raw) and raw[i].isupper() else c for i, c in enumerate(s))
            head = re.match(title + "?", raw)[0]
            names = raw[len(head) :].split()
            own = {"Mr ": "m", "Mrs ": "f"}.get(head) or gender.get(" ".join(names), "n")
            out = [new["given", f"{own}:{w.lower()}"] for w in names[:-1]] + [new["family", "n:" + names[-1].lower()]]
            return head + " ".join(w.capitalize() for w in out)

        expected.append((re.sub(alone, put, text), n))
    assert got == sorted(expected)


# --- substring dedup -------------------------------------------------------


@pytest.mark.parametrize("crowded", [1 << 14, 2])
def test_substring_dedup(spark, corpus, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "HOT_PIECES", crowded)
    rng = random.Random(9)
    passage = words(rng, 130)
    rows = corpus + [(400 + i, words(rng, rng.randrange(60)) + passage[i * 7 :] + words(rng, 30)) for i in range(9)]
    rows += [(500, "é" * 250 + passage[:398]), (501, "ab" * 400), (502, passage[:400]), (503, passage[1:400])]
    got = substrings.dedup(frame(spark, rows)).collect()
    expected = [(d, *r) for (d, _), r in zip(rows, brute.substring_dedup([t for _, t in rows]), strict=True)]
    assert keyed((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == keyed(expected)


def test_substring_dedup_of_nothing(spark):
    assert substrings.report(spark.createDataFrame([], EMPTY)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    order = suffix.suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    for (a, b), shared in zip(zip(order, order[1:], strict=False), suffix.common_prefixes(text, order)[1:], strict=True):
        assert text[a : a + shared] == text[b : b + shared] and text[a + shared] != text[b + shared]


# --- license scan ----------------------------------------------------------


def test_license_scan_equals_exact_containment(spark, corpus):
    rng = random.Random(1)
    rows = list(corpus)
    for i, (_, text) in enumerate(licenses.TEMPLATES * 4):
        rows.append((600 + i, words(rng, rng.randrange(40)) + " " + text + " " + words(rng, rng.randrange(40))))
    partial = licenses.TEMPLATES[1][1].split(" ")
    rows.append((700, " ".join(partial[:24])))
    rows.append((701, " ".join(partial[:12])))
    got = licenses.scan(frame(spark, rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cur = con.execute(licenses.oracle())
    assert [d[0] for d in cur.description] == ["doc_id", "license", "containment", "first_word"]
    assert keyed((r.doc_id, r.license, round(r.containment, 9), r.first_word) for r in got) == keyed(
        (d, name, round(c, 9), o) for d, name, c, o in cur.fetchall()
    )
    assert {r.doc_id for r in got} >= {600 + i for i in range(4 * len(licenses.TEMPLATES))} | {700}
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_bands_reach_the_promised_odds():
    for sizes, window in (([1], 12), ([3, 4], 12), ([20], 60)):
        b = licenses.bands_needed(sizes, window, 0.75, 1e-6)
        common = min(-(-3 * n // 4) / (window + n - -(-3 * n // 4)) for n in sizes)
        assert (1 - common) ** b <= 1e-6 < (1 - common) ** (b - 1)


# --- chat formatting -------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "</s>"]), st.text("\\n<s>/[INST]|_imdtxof\n", max_size=30))))
def test_formatting_comes_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("</s>") == len(turns)


def test_layouts(spark):
    records = [
        (1, '{"id": "1", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (2, '{"id": "2", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}'),
        (3, '{"id": "3", "prompt": "a", "completion": "b"}'),
        (4, '{"id": "4", "instruction": "do", "input": "x", "output": "b"}'),
        (5, '{"id": "5", "data": {"dialog": [{"speaker": "human", "utterance": "a"}], "topic": "t"}}'),
        (6, '{"id": "6", "other": 1}'),
        (7, None),
        (8, "not json"),
        (9, '{"id": "9", "messages": []}'),
    ]
    got = {r.conv_id: r for r in chat.canonical(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    two = [("user", "a"), ("assistant", "b")]
    assert all([tuple(t) for t in got[i].turns] == two for i in (1, 2, 3))
    assert [tuple(t) for t in got[4].turns] == [("user", "do\nx"), ("assistant", "b")]
    assert [tuple(t) for t in got[5].turns] == [("user", "a")]
    assert all(got[i].layout is None and got[i].turns is None and got[i].fingerprint for i in (6, 7, 8))
    assert got[9].turns == []


def test_conversations_come_back(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 7)):
            text = rng.choice([None, "", "</s>", "[INST] hi \\", words(rng, 20), "ü\n<s>user\n"])
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "gpt"]), text))
    rows += [(40, 0, "user", "q"), (40, 1, "assistant", "a"), (41, 0, "system", "s"), (41, 1, "user", "q"), (41, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(chat.records(df)))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted(chat.canonical(chat.records(df.where("false"))))).count() == 0


# --- packing ---------------------------------------------------------------


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in corpus if r[0] != 306] + [(800, "a  b\n\n c \t d<|endoftext|>e"), (801, words(random.Random(0), 9000))]
    got = packing.pack(frame(spark, rows), block=4096).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in rows:
        if doc is None:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts), dtype="<u4").tolist() == ids
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *[r.length for r in parts]]).tolist()
        assert [r.offset for r in parts] == ends[:-1]
        assert ends[-1] <= packing.MAX_LENGTH and ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_placing_takes_the_cheapest_sequence_with_room():
    pieces = packing.place([5, 3, 8, 4, 4], 8, 1.0, 0.5)
    assert sorted((i, n) for i, _, n, _, _ in pieces) == [(0, 5), (1, 3), (2, 8), (3, 4), (4, 4)]
    assert {i: at for i, _, _, at, _ in pieces} == {2: 0, 0: 1, 3: 2, 4: 2, 1: 1}


# --- language identification ----------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got)
    assert right >= 0.97 * len(got) and not any(r.rejected for r in got)


def test_language_cases(spark):
    rng = random.Random(0)
    letters = {"xx": "abcde", "yy": "vwxyz"}
    rows = []
    for i in range(200):
        lang = ("xx", "yy")[i % 2]
        text = " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(30))
        rows.append((i, text, lang))
    odd = [(900, None, "xx"), (901, "", None), (902, "12 34 !", None), (903, "日本語 " * 20, None), (904, rows[0][1], None), (None, rows[1][1], None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in ("xx", "yy")
    assert (got[904].lang_pred, got[904].score) == (got[0].lang_pred, got[0].score)
    assert got[None].lang_pred == "yy" and got[None].held_out is False
    kept = langid.accepted(docs.withColumnRenamed("lang", "score"), model)
    assert {r.doc_id for r in kept.collect()} == {*range(200), 904, None} and kept.columns == ["doc_id", "text", "score"]
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


# --- Jaccard join ----------------------------------------------------------


def jaccard_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = words(rng, rng.choice([6, 12, 40, 90]), 10**6).split(" ")
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, 3 + len(text) // 15)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(99)}"
            rows.append((len(rows) * 3 + g, " ".join(text)))
    hot = words(rng, 14, 10**6)
    rows += [(1000 + i, hot + " " + words(rng, rng.randrange(2, 12), 10**6)) for i in range(40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, corpus, seed):
    rows = jaccard_rows(seed) + [(d if d is None else d + 5000, t) for d, t in corpus]
    got = jaccard.join(frame(spark, rows)).collect()
    expected = [
        (d, len(brute.shingles(t)), c) for (d, t), c in zip(rows, brute.jaccard_components(rows), strict=True)
    ]
    assert keyed((r.doc_id, r.n_shingles, r.component_id) for r in got) == keyed(expected)


def test_one_document_of_each_component_stays(spark):
    rows = jaccard_rows(3)
    kept = jaccard.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    expected = {d for (d, _), c in zip(rows, brute.jaccard_components(rows), strict=True) if d == c}
    assert {r.doc_id for r in kept.collect()} == expected
    assert jaccard.join(spark.createDataFrame([], EMPTY)).count() == 0


def test_lists_are_found_across_batches():
    rng = random.Random(8)
    rows = sorted({(rng.randrange(12), rng.randrange(30)) for _ in range(60)})
    rows = sorted(rows + rng.sample(rows, 10))
    expected = []
    for token in sorted({t for t, _ in rows}):
        sigs = sorted({s for t, s in rows if t == token})
        if len(sigs) > 1:
            expected += [(token, sigs[0], s) for s in sigs]
    for size in (1, 2, 3, 7, 1000):
        batches = []
        for i in range(0, len(rows), size):
            token, sig = zip(*rows[i : i + size], strict=True)
            batches.append(jaccard.arrow_batch(jaccard.POSTING, token, sig, [5] * len(sig), [0] * len(sig)))
        got = []
        for b in jaccard._lists(iter(batches)):
            got += [(r["token"], r["pivot"], r["sig"]) for r in b.to_pylist()]
        assert sorted(got) == expected


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_sketches_never_exceed_the_distance(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    assert jaccard.apart_at_least(jaccard.sketch(x), jaccard.sketch(y)) <= len(a ^ b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100}
