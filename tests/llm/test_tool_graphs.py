"""Calls that wait for several others, and rules of nested arguments, against plain versions."""

import random

from spanloom.llm import chat

CALLS = "conv_id string, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id string, turn long, call_id string, content string"


def plain_levels(waits):
    """Settle what waits for settled calls only, until nothing changes."""
    level = {}
    while True:
        new = {c: max([level[b] + 1 for b in before], default=0) for c, before in waits.items() if c not in level and all(b in level for b in before)}
        if not new:
            return {c: level.get(c) for c in waits}
        level |= new


def test_levels_of_graphs(spark):
    """Random graphs with diamonds, long chains, cycles, unknown and repeated prerequisites and nulls."""
    draw, rows, expected = random.Random(5), [], {}
    for conv in ("a", "b", "c"):
        ids = [f"k{i}" for i in range(60)]
        waits = {}
        for i, c in enumerate(ids):
            before = draw.sample(ids[:i], min(i, draw.choice([0, 1, 1, 1, 2, 3])))
            if conv == "c" and i in (20, 40):
                before = [*before, ids[i], ids[i + 5]]  # on itself
            if conv == "b" and i == 30:
                before = [ids[35]]
            if conv == "b" and i == 35:
                before = [ids[30], ids[2]]
            waits[c] = before
            given = [*before, *before[:1], "unknown", None] if i % 3 else before or None
            rows.append((conv, i, c, "f", "{}", given))
        expected |= {(conv, c): v for c, v in plain_levels(waits).items()}
    got = chat.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == expected
    assert {r["problems"] for r in got if r["level"] is None} == {"cycle"} and None in expected.values()
    one = spark.createDataFrame(rows, CALLS).selectExpr("conv_id", "turn", "call_id", "name", "arguments", "after[0] as after")
    first = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.link_calls(one, spark.createDataFrame([], RESULTS), {"f": {}}).collect()}
    chains = {}
    for conv in ("a", "b", "c"):
        chains |= {(conv, c): v for c, v in plain_levels({r[2]: (r[5] or [])[:1] if (r[5] or [""])[0] != "unknown" else [] for r in rows if r[0] == conv}).items()}
    assert first == chains
    empty = spark.createDataFrame([], CALLS)
    assert chat.link_calls(empty, spark.createDataFrame([], RESULTS), {"f": {}}).count() == 0


def test_rules_of_arguments(spark):
    schemas = {
        "f": {
            "unit": ("string", False, {"enum": ["m", "é", 3]}),
            "n": ("number", False, {"minimum": 0, "maximum": 10}),
            "tags": ("array", False, {"items": "string"}),
            "at": ("object", False, {"fields": {"x": ("integer", True, {"maximum": 5}), "deep": ("object", False, {"fields": {"y": ("string", True)}})}}),
        },
        "g": {"unit": ("string", True)},
    }
    cases = [
        ("f", "{}", ""),
        ("f", '{"unit": "m", "n": 10, "tags": ["a"], "at": {"x": 5, "deep": {"y": "z"}}}', ""),
        ("f", '{"unit": "é", "n": 0, "tags": []}', ""),
        ("f", '{"unit": "km", "n": 10.5}', "enum:unit,maximum:n"),
        ("f", '{"n": -1}', "minimum:n"),
        ("f", '{"n": "99"}', "kind:n"),
        ("f", '{"tags": ["a", 1]}', "items:tags"),
        ("f", '{"tags": [null]}', "items:tags"),
        ("f", '{"tags": "a"}', "kind:tags"),
        ("f", '{"at": {}}', "missing:at.x"),
        ("f", '{"at": {"x": 6, "z": 1}}', "extra:at.z,maximum:at.x"),
        ("f", '{"at": {"x": "6", "deep": {"w": 1}}}', "extra:at.deep.w,kind:at.x,missing:at.deep.y"),
        ("f", '{"at": 1}', "kind:at"),
        ("g", '{"unit": "km"}', ""),
        ("f", "[]", "arguments"),
        ("h", "{}", "tool"),
    ]
    calls = spark.createDataFrame([("a", i, f"k{i:02}", name, text, None) for i, (name, text, _) in enumerate(cases)], CALLS)
    got = {r["call_id"]: r["problems"] for r in chat.link_calls(calls, spark.createDataFrame([], RESULTS), schemas).collect()}
    assert got == {f"k{i:02}": want for i, (_, _, want) in enumerate(cases)}


def test_repeated_and_null_ids_are_kept(spark):
    calls = [("a", 1, "x", "f", "{}", None), ("a", 3, "x", "f", '{"k":1}', ["x"]), ("a", 1, "x", "f", "{}", None), ("a", 5, None, "f", "{}", None), ("a", 5, None, "f", "{}", None), (None, 6, "x", "g", None, None), ("a", 7, "y", "f", "{}", ["x"])]
    results = [("a", 2, "x", "one"), ("a", 2, "x", "one"), ("a", 4, "x", "two"), ("a", 8, "z", "z1"), ("a", 9, "z", "z2"), ("a", 9, None, "n"), (None, 9, "x", None), (None, 9, "x", None)]
    got = sorted(((r["kind"], r["turn"], r["call_id"], r["linked"], r["level"], r["problems"]) for r in chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": {}}).collect()), key=repr)
    assert got == sorted(
        [
            ("call", 1, "x", True, 0, "duplicate"),
            ("repeated_call", 1, "x", False, None, "duplicate"),
            ("repeated_call", 3, "x", False, None, "duplicate,extra:k"),
            ("call", 5, None, False, None, ""),
            ("call", 5, None, False, None, ""),
            ("call", 6, "x", False, None, "arguments"),
            ("call", 7, "y", False, 1, ""),
            ("repeated_result", 2, "x", False, None, ""),
            ("repeated_result", 4, "x", False, None, ""),
            ("orphan", 8, "z", False, None, ""),
            ("repeated_result", 9, "z", False, None, ""),
            ("orphan", 9, None, False, None, ""),
            ("orphan", 9, "x", False, None, ""),
            ("orphan", 9, "x", False, None, ""),
        ],
        key=repr,
    )
