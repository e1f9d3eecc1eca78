"""CSV in ranges against Python's reader: quoted line breaks, many splits, several files."""

import csv
import io
import random

import pytest

from claimloom.sources import csv_ranges, tabular

WANTED = {"a": ["text"], "b": ["label", "kind"]}


def plain(files, wanted=WANTED):
    rows, number = [], 0
    for name in sorted(files):
        for row in csv.DictReader(io.StringIO(files[name], newline="")):
            rows.append((number, *(next((row[n] for n in names if row.get(n)), None) for names in wanted.values())))
            number += 1
    return sorted(rows, key=str)


def written(folder, files, encoding="utf-8"):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def read(spark, path, size, encodings=("UTF-8", "ISO-8859-1")):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = csv_ranges.read(spark, path, WANTED, list(encodings))
        return sorted(((r.row, r.a, r.b) for r in rows.collect()), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def table(rng, n, end="\n"):
    made = io.StringIO(newline="")
    out = csv.writer(made, lineterminator=end)
    out.writerow(["id", "text", "label"])
    for i in range(n):
        words = [rng.choice(["x", "wörd", '"', ",", "\n", "\r\n", ", ", '""', "long " * 9, ""]) for _ in range(rng.randrange(8))]
        out.writerow([i, "".join(words), rng.choice(["ham", "smish", ""])])
        if rng.random() < 0.1:
            made.write(end)
    return made.getvalue()


@pytest.mark.parametrize(("size", "end"), [(64, "\n"), (300, "\r\n"), (1 << 20, "\n")])
def test_rows_equal_the_plain_reader(spark, tmp_path, size, end):
    rng = random.Random(size)
    files = {f"f{i}.csv": table(rng, n, end) for i, n in enumerate((60, 0, 40))}
    path = written(tmp_path, files)
    got = read(spark, path, size)
    assert got == plain(files)
    if size == 64:
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("size", [16, 1000])
def test_odd_quotes_and_open_ends(spark, tmp_path, size):
    files = {
        "a.csv": 'text,label\nin"side,"x"\n"closed"tail,ham\n"two\nlines",smish\n\n"a ""quote""",ham\nshort\n',
        "b.csv": "",
        "c.csv": 'kind,other\nk,"open to the\nend',
        "d.csv": "text,label\r\none,ham\r\n\r\n\"two\r\nthree\",ham\r\n",
    }
    assert read(spark, written(tmp_path, files), size) == plain(files)


def test_every_file_has_its_own_encoding(spark, tmp_path):
    written(tmp_path, {"a.csv": 'text,label\ncafé,ham\n"x\ny",ham\n'}, "latin-1")
    written(tmp_path, {"b.csv": "text,label\nnaïve \ufffd,ham\n"})
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbftext,label\n\x93quoted\x94,ham\n")
    got = read(spark, str(tmp_path), 16, ("UTF-8", "cp1252", "ISO-8859-1"))
    assert [(a, b) for _, a, b in got][:3] == [("café", "ham"), ("x\ny", "ham"), ("naïve \ufffd", "ham")]
    assert [r for r, _, _ in got] == [0, 1, 2, 3]


def test_records_with_breaks_are_read_by_default(spark, tmp_path):
    written(tmp_path, {"a.csv": 'Message,type\n"line one\nline two",ham\nnext,SMISH\n,ham\nlast,ham\n'})
    got = [tuple(r) for r in tabular.read_raw_csv(spark, str(tmp_path)).orderBy("message_id").collect()]
    assert got == [("msg_000000", "line one\nline two", "ham"), ("msg_000001", "next", "smish"), ("msg_000003", "last", "ham")]
