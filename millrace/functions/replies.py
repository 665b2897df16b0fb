"""Replies of judges and models: JSON found in free text, answers, flags, and replies brought into a shape.

One Arrow kernel finds the value; everything after it reads a VARIANT with built-in functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import let

LETTERS = "ABCDEFGHIJKLMNOPQRST"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
DECODER = json.JSONDecoder(parse_constant=lambda _: None)
FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
OPENING = re.compile(r"(?<!`)[{\[]")


def _fenced(text: str) -> Iterator[Any]:
    for m in FENCED.finditer(text):
        try:
            value = DECODER.decode(m.group(1))
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict | list):
            yield value


def _at(text: str, places: Sequence[int]) -> Iterator[Any]:
    for i in places:
        try:
            yield DECODER.raw_decode(text, i)[0]
        except (ValueError, RecursionError):
            continue


def whole_value(text: str) -> Any | None:
    """The JSON value that a text is, None if it is none."""
    try:
        return DECODER.decode(text.strip())
    except (ValueError, RecursionError):
        return None


def found_value(text: str, key: str | None = None, last: bool = False) -> Any | None:
    """The JSON object or list that free text holds, wherever its brackets begin, objects inside of others
    included: the last object that has `key`, else the first value (fenced ones before others). With `last` a
    text that is an object gives it, and the default is the last object in no other one. None where there is none."""
    if last and isinstance(whole := whole_value(text), dict):
        return whole
    places = [m.start() for m in OPENING.finditer(text)]
    if key is not None and json.dumps(key)[1:-1] in text:
        keyed = (v for v in _at(text, places[::-1]) if isinstance(v, dict) and key in v)
        got = next(keyed, None)
        if got is None:
            got = next((v for v in reversed(list(_fenced(text))) if isinstance(v, dict) and key in v), None)
        if got is not None:
            return got
    if not last:
        return next(_fenced(text), None) or next(_at(text, places), None)
    at, got = 0, None
    for i in places:
        if i >= at and text[i] == "{":
            try:
                got, at = DECODER.raw_decode(text, i)
            except (ValueError, RecursionError):
                continue
    return got


def _as_json(find: Callable[[str], Any | None], text: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        values = (None if x is None else find(x) for x in s)
        return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in values], dtype=object)

    return run(text)


def found_json(text: Column, key: str | None = None, last: bool = False) -> Column:
    """`found_value` of each text as JSON text; null where there is none or the text is null."""
    return _as_json(lambda x: found_value(x, key, last), text)


def whole_json(text: Column) -> Column:
    """A text that is one JSON value, as JSON text; else null. (`try_parse_json` passes over what follows a value.)"""
    return _as_json(whole_value, text)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def named(item: Column, *keys: str) -> Column:
    """The first of some keys of a VARIANT whose value says something, as trimmed text; empty where none
    does. Null, false, zero and what is empty say nothing."""
    said = [F.when(~F.schema_of_variant(_get(item, f"$.{k}", "variant")).isin("VOID", "BOOLEAN"), stripped(_get(item, f"$.{k}", "string"))) for k in keys]
    kept = [F.when((s != "") & ~((s == "0") & (F.schema_of_variant(_get(item, f"$.{k}", "variant")) != "STRING")), s) for s, k in zip(said, keys, strict=True)]
    return F.coalesce(*kept, F.lit(""))


def letter(text: Column) -> Column:
    """A verdict A..T, upper-cased; null for anything else."""
    one = F.upper(stripped(text))
    return F.when((F.length(one) == 1) & F.lit(LETTERS).contains(one), one)


def answers(reply: Column, questions: Column) -> Column:
    """struct(answers, complete) of a judge's reply: for each of the questions, in order, the last
    answer with a readable letter and its reason, and whether all have one.

    The reply's list stands under `answers`, or alone. A question is named by `asked` or `id`, its letter by
    `verdict`, or `answer` where there is no such key, its reason by `reason` or `explanation`.
    """

    def read(item: Column) -> Column:
        verdict = F.when(_get(item, "$.verdict", "variant").isNull(), _get(item, "$.answer", "string")).otherwise(_get(item, "$.verdict", "string"))
        return F.struct(named(item, "asked", "id").alias("question"), letter(verdict).alias("letter"), named(item, "reason", "explanation").alias("reason"))

    def judged(value: Column) -> Column:
        items = F.coalesce(_get(value, "$", "array<variant>"), _get(value, "$.answers", "array<variant>"), F.array().cast("array<variant>"))
        objects = F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT"))
        return F.filter(F.transform(objects, read), lambda a: a["letter"].isNotNull())

    def of_question(read_items: Column, q: Column) -> Column:
        mine = F.try_element_at(F.filter(read_items, lambda a: a["question"] == q), F.lit(-1))
        return F.struct(q.alias("question"), mine["letter"].alias("letter"), F.coalesce(mine["reason"], F.lit("")).alias("reason"))

    value = F.try_parse_json(found_json(reply, "answers"))
    listed = let(judged(value), lambda items: F.transform(questions, lambda q: of_question(items, q)))
    return F.transform(F.array(listed), lambda a: F.struct(a.alias("answers"), F.forall(a, lambda x: x["letter"].isNotNull()).alias("complete")))[0]


def truth(value: Column) -> Column:
    """A VARIANT as a boolean: true and false, numbers other than 0, and the words true, 1, yes, y,
    false, 0, no, n in any case; null for anything else."""
    word = F.lower(stripped(_get(value, "$", "string")))
    spoken = F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "BOOLEAN", _get(value, "$", "boolean")).when(number, _get(value, "$", "double") != 0).when(kind == "STRING", spoken)


def flag(reply: Column, key: str, note: str, most: int = 300) -> Column:
    """struct(flag, note) of a gate's reply: the truth of `key` in the reply's object (all of it, else
    the last one in it that has the key) and the first `most` characters of its note.
    Both are null and empty where there is no such object or its flag can't be read."""

    def read(value: Column) -> Column:
        said = F.when(F.schema_of_variant(value).startswith("OBJECT"), truth(_get(value, f"$.{key}", "variant")))
        text = F.coalesce(F.substring(_get(value, f"$.{note}", "string"), 1, most), F.lit(""))
        return F.struct(said.alias("flag"), F.when(said.isNotNull(), text).otherwise("").alias("note"))

    return let(F.try_parse_json(found_json(reply, key, last=True)), read)


def in_shape(reply: Column, schema: Mapping[str, Any]) -> Column:
    """A reply as JSON text with a schema's required keys in their order.

    An object with all of them, fenced or the whole reply, keeps their values. Else prose is dealt out: the
    first line to the first key, the others, joined, to every further one that takes text (the first
    line again where there are none), each cut to its `maxLength` with an ellipsis. Marks of lists and
    headings and leading `key:` labels are taken off; thinking goes; without a line the first is `Task`.
    """
    properties = schema.get("properties") or {}
    required = [k for k in schema.get("required") or [] if isinstance(k, str)] or list(properties)
    body = stripped(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", ""))

    def ready(text: Column) -> Column:
        def read(v: Column) -> Column:
            have = F.schema_of_variant(v).startswith("OBJECT")
            for k in required:
                have = have & _get(v, f"$.{k}", "variant").isNotNull()
            return F.when(have, F.to_json(F.struct(*(_get(v, f"$.{k}", "variant").alias(k) for k in required))))

        return let(F.try_parse_json(whole_json(text)), read)

    label = r"(?i)^\**(?:" + "|".join(re.escape(k) for k in required) + r")\**\s*:\s*"

    def dealt(lines: Column) -> Column:
        first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("Task"))
        rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
        fields = []
        for i, k in enumerate(required):
            rule = properties.get(k) or {}
            if rule.get("type") not in (None, "string"):
                continue
            value = first if i == 0 else F.when(rest == "", first).otherwise(rest)
            if isinstance(most := rule.get("maxLength"), int):
                cut = F.concat(F.rtrim(F.substring(value, 1, most - 1)), F.lit("…"))
                value = F.when(F.length(value) > most, cut).otherwise(value)
            fields.append(value.alias(k))
        return F.to_json(F.struct(*fields)) if fields else F.lit("{}")

    raw = F.filter(F.split(body, r"\r\n|[\n\r\f\x0B\x1C-\x1E\x85\u2028\u2029]"), lambda x: (stripped(x) != "") & ~x.startswith("```"))
    lines = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(stripped(x), r"^[#*\-\d.)\s]+", ""), label, ""))
    prose = let(F.filter(lines, lambda x: x != ""), dealt)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(ready(F.when(fenced != "", fenced)), ready(body), prose)
