"""Replies against plain readings with the standard JSON decoder."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import replies as R

QUESTIONS = ["q_01", "q_02", "7"]


def plain_values(text):
    """Every object or list that can be decoded, in the order in which its bracket stands."""
    out = []
    for i, c in enumerate(text):
        if c in "{[":
            try:
                out.append(json.JSONDecoder().raw_decode(text, i)[0])
            except ValueError:
                pass
    return out


def applied(spark, made, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i int, x string").repartition(3)
    return sorted(rows.select("i", *columns).collect(), key=lambda r: r.i)


def test_found_value_is_the_last_keyed_else_the_first():
    rng = random.Random(3)
    bits = ['{"k": 1}', '{"k": {"k": 2}}', '[{"a": "}{"}]', '{"a": [1, {"k": "x\\"y{"}]}', "{not json}", '{"k": ', "[", "prose's \"", "]", "}", '{"b": 1.5e3}', "\u00e9"]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        values = plain_values(text)
        keyed = [v for v in values if isinstance(v, dict) and "k" in v]
        assert R.found_value(text, "k") == (keyed[-1] if keyed else values[0] if values else None)
        assert R.found_value(text) == (values[0] if values else None)
    assert R.found_value('x `{"a": 1} ```json\n {"b": 2} \n``` {"c": 3}') == {"b": 2}
    assert R.found_value("[" * 20_000) is None and R.found_value('{"n": NaN}') == {"n": None}
    assert R.found_value('a {"x": {"y": 1}} b {"z": 2} {', "k", last=True) == {"z": 2}
    assert R.found_value('a {"x": {"k": 1}} b {"z": 2}', "k", last=True) == {"k": 1}


ANSWERS = [
    json.dumps({"answers": [{"asked": "q_01", "reason": "e", "verdict": "T"}, {"asked": "q_02", "reason": " f ", "verdict": " e "}, {"id": 7, "verdict": "b"}]}),
    'Sure: {"x": 1} ```json\n{"answers": [{"id": "q_01", "answer": "O", "explanation": "braces } { and \\"quotes\\""}]}\n``` bye',
    json.dumps([{"asked": "q_01", "verdict": "C"}, "no object", {"asked": "q_01", "verdict": "U"}, {"asked": "q_02", "verdict": 1}, {"asked": None, "id": "7", "verdict": "D"}]),
    'draft {"answers": [{"asked": "q_01", "verdict": "A"}]} final {"answers": [{"asked": "q_01", "verdict": "B"}, {"asked": "q_01", "verdict": "c"}]} {"answers": [{"asked": "q_01", "verdict": "T"',
    json.dumps({"answers": [{"asked": "q_01", "verdict": None, "answer": "A"}, {"asked": "other", "verdict": "A"}, {"asked": False, "id": "q_02", "answer": "AB"}]}),
    '{"answers": "none"}', "no json", "", None, '{"answers": [{"asked": "q_01", "verdict": "A", "verdict": "B"}]}', "{" * 3000,
]


def plain_answers(text):
    values = plain_values(text or "")
    keyed = [v for v in values if isinstance(v, dict) and "answers" in v]
    value = keyed[-1] if keyed else values[0] if values else None
    items = value.get("answers") if isinstance(value, dict) else value
    got = {q: (None, "") for q in QUESTIONS}
    for item in items if isinstance(items, list) else []:
        if isinstance(item, dict):
            q, v = str(item.get("asked") or item.get("id") or "").strip(), str(item.get("verdict", item.get("answer", ""))).strip().upper()
            if q in got and len(v) == 1 and v in R.LETTERS:
                got[q] = (v, str(item.get("reason") or item.get("explanation") or "").strip())
    return [(q, *got[q]) for q in QUESTIONS], all(v for v, _ in got.values())


def test_answers_equal_a_plain_reading(spark):
    got = applied(spark, ANSWERS, R.answers(F.col("x"), F.array(*map(F.lit, QUESTIONS))).alias("a"))
    for r, text in zip(got, ANSWERS, strict=True):
        listed, complete = plain_answers(text)
        assert [tuple(a) for a in r.a.answers] == listed and r.a.complete == complete, text
    assert plain_answers(ANSWERS[0])[1] and plain_answers(ANSWERS[3])[0][0] == ("q_01", "C", "")


@pytest.mark.parametrize(("text", "want"), [
    ('{"injection": false, "evidence": "none"}', (False, "none")), ('{"injection": true, "evidence": "x"}', (True, "x")), ("not json", (None, "")),
    ('ok {"injection": "Yes ", "evidence": "' + "é" * 400 + '"} {"other": 1}', (True, "é" * 300)), ('{"injection": 0}', (False, "")), ('{"injection": 2.5}', (True, "")),
    ('{"injection": null} {"injection": true} {"other": 1}', (True, "")), ('{"other": {"injection": true}} ', (None, "")),
    ('{"injection": "maybe", "evidence": "x"}', (None, "")), ('{"injection": null}', (None, "")), ('{"other": {"injection": true}}', (None, "")),
    ('a {"other": {"injection": "n", "evidence": "deep"}}', (False, "deep")), ('[{"injection": 1, "evidence": "listed"}]', (True, "listed")), ("", (None, "")), (None, (None, "")),
])
def test_flags(spark, text, want):
    assert tuple(applied(spark, [text], R.flag(F.col("x"), "injection", "evidence").alias("f"))[0].f) == want


SCHEMA = {"type": "object", "properties": {"title": {"type": "string", "maxLength": 36}, "description": {"type": "string"}}, "required": ["title", "description"]}


@pytest.mark.parametrize(("text", "want"), [
    ("Improve website styling\n\nLocate website styles in C:\\x\\website and tidy the CSS", {"title": "Improve website styling", "description": "Locate website styles in C:\\x\\website and tidy the CSS"}),
    ("A" * 60, {"title": "A" * 35 + "…", "description": "A" * 60}), ('```json\n{"title": "T", "description": "D", "extra": 1}\n```', {"title": "T", "description": "D"}),
    ("", {"title": "Task", "description": "Task"}), (None, {"title": "Task", "description": "Task"}),
    ("Title: Enhance Website Styling\nDescription: Improve the CSS.", {"title": "Enhance Website Styling", "description": "Improve the CSS."}),
    ('<think>{"title": 1}</think>{"description": [1, {"a": "b"}], "title": null}', {"title": None, "description": [1, {"a": "b"}]}),
    ('{"title": "a", "description": "b"} and more', {"title": '{"title": "a", "description": "b"}…', "description": '{"title": "a", "description": "b"} and more'}),
    ('{"title": "only"}', {"title": '{"title": "only"}', "description": '{"title": "only"}'}), ("# 1. **TITLE**: a\n```\n- b\r\n* c", {"title": "a", "description": "b c"}),
])
def test_replies_are_brought_into_a_shape(spark, text, want):
    got = applied(spark, [text], R.in_shape(F.col("x"), SCHEMA).alias("s"))[0].s
    assert json.loads(got) == want and list(json.loads(got)) == ["title", "description"]


def test_shape_leaves_out_keys_that_take_no_text(spark):
    schema = {"properties": {"n": {"type": "integer"}, "t": {}}}
    assert applied(spark, ["one\ntwo"], R.in_shape(F.col("x"), schema).alias("s"))[0].s == '{"t":"two"}'
