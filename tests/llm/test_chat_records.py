"""Odd but legal chat records are read or reported, never an error."""

import json

from claimloom.llm import chat
from claimloom.llm.common import reach

ODD = {
    1: {"id": 1, "prompt": 5, "completion": "x"},
    2: {"id": 2, "messages": [{"role": "user", "content": 5}]},
    3: {"id": 3, "messages": [{"role": True, "content": "x"}]},
    4: {"id": 4, "data.dialog": [{"speaker": "human", "utterance": "x"}]},
    5: {"id": 5, "messages": [{"role": "user", "content": ["part"]}]},
    6: {"id": 6, "instruction": False, "output": "x"},
    7: {"id": 7, "messages": [{"role": "user", "content": 0}]},
    8: {"id": 8, "messages[]": {"role": "user", "content": "x"}},
    9: [1, 2],
    10: "text",
    11: {"id": 11, "messages": None},
}
READ = {
    20: ({"id": 20, "messages": [{"role": "user", "content": None}, {"role": None, "content": "a"}]}, [("user", ""), ("", "a")]),
    21: ({"id": 21, "messages": [{"role": "user", "content": "half \ud800 pair"}]}, [("user", "half � pair")]),
    22: ({"id": "x", "data": {"dialog": [{"speaker": "human", "utterance": "a.b[]{}"}]}}, [("user", "a.b[]{}")]),
    23: ({"id": 23, "prompt": "", "completion": "</s>"}, [("user", ""), ("assistant", "</s>")]),
    24: ({"id": 24, "messages": []}, []),
}


def test_odd_records(spark):
    reach(spark)
    rows = [(i, json.dumps(r)) for i, r in ODD.items()] + [(i, json.dumps(r)) for i, (r, _) in READ.items()]
    rows += [(30, "{not json"), (31, "[" * 100_000), (32, None), (33, ""), (None, rows[-1][1]), (20, rows[len(ODD)][1])]
    made = chat.canonical(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert len(made) == len(rows)
    for r in made:
        if r.conv_id in ODD or r.conv_id in (30, 31, 32, 33):
            assert (r.layout, r.turns) == (None, None), r
        elif r.conv_id is not None:
            assert [(t.role, t.text) for t in r.turns] == READ[r.conv_id][1]
    assert len({r.fingerprint for r in made if r.conv_id in (4, 22)}) == 2
    back = chat.read_back(chat.formatted(spark.createDataFrame(made))).collect()
    assert {r.conv_id: r.n_turns for r in back}[23] == 2


def test_null_ids_equal_turns_and_clashing_columns(spark):
    reach(spark)
    long = "w " * 600_000
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 0, None, None), (1, 0, "user", long), (1, 0, "user", long), (2, None, "assistant", "x")]
    given = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "conv_id long, turn int, role string, text string, record string, turns string, loss string")
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical(chat.records(given)).collect()}
    assert turns == {None: [("", ""), ("user", "a"), ("user", "b")], 1: [("user", long), ("user", long)], 2: [("assistant", "x")]}
