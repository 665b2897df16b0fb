"""Observations and turns: edge cases, and the folds against plain loops."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions import observations as O
from millrace.functions import turns as T
from millrace.operators.turns import MARKER, turn_rows, whole


def values(spark, columns, *expressions):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(*(e.alias(f"x{i}") for i, e in enumerate(expressions))).first()
    return list(row)


def named(c):
    def words(text):
        return re.findall(r"[A-Za-z_][\w.\-/]{3,}", text)

    own = [w for s in re.findall(r"`([^`\n]{2,120})`", c) for w in words(s)] + [w for w in words(c) if re.search(r"[_./-]", w) or not w.islower()]
    return {x.lower() for w in own for x in (w, w.rsplit("/", 1)[-1]) if x}


def loop(turns):
    """Submits without work, turn by turn."""
    n, worked, as_is, again = 0, False, False, False
    asked, demand, edited = set(), set(), set()
    for t in turns:
        text = t.content
        if t.role != "assistant":
            as_is = t.nudge
            if not t.environment_observation:
                asked = named(text)
            if t.injected:
                again, demand = bool(asked & (demand - edited)), asked
            continue
        found = re.search(r"(?is)```(?:bash|sh|shell)[ \t]*\n(.*?)```|<(?:mswea_bash_command)>(.*?)</", text)
        command = (found[1] or found[2]).strip() if found else ""
        edit = "sed -i" in text
        if edit:
            edited |= named(command)
        if MARKER in command:
            n += not (worked or edit or as_is or again)
            worked = False
        else:
            every = {x.lower() for w in re.findall(r"[A-Za-z_][\w.\-/]{3,}", command) for x in (w, w.rsplit("/", 1)[-1])}
            worked = worked or edit or bool(every & asked)
    return n


def test_empty_submits_equal_a_loop(spark):
    rows = whole(turn_rows(spark, "/root/testdata/sf0.01"))
    got = rows.select("turns", T.empty_submits(F.col("turns"), MARKER).alias("n")).collect()
    assert [r.n for r in got] == [loop(r.turns) for r in got] and any(r.n for r in got)


def test_observations_of_nothing(spark):
    none = F.lit(None).cast("string")
    fmt = F.lit("openhands")
    got = values(spark, {"z": 1}, O.classify(none), O.valid_output(none, fmt), O.body(none, fmt), O.returncode(none), O.impossible_success(none, fmt, none), O.output_expectation(none), O.line_cap(none)["most"], O.unusable_turn(none), O.leaked_turn(none))
    assert got == ["openhands", False, "", None, False, "may_be_silent", None, "empty response", False]


@pytest.mark.parametrize("command, want", [("cat a.py", "must_print"), ("git status", "must_print"), ("rm x", "may_be_silent"), ("python x.py", "not_derivable"), ("echo a >> b.txt", "may_be_silent"), ("cd a && cat b.py", "must_print"), ("grep 'a && b' c", "may_be_silent")])
def test_expectations(spark, command, want):
    assert values(spark, {"c": command}, O.output_expectation(F.col("c"))) == [want]


def test_caps_and_views(spark):
    raw, hands = "\n".join("abcdef"), F.lit("openhands")
    c = F.col("c")
    assert values(spark, {"c": "cat x | head -2", "r": raw}, O.too_many_lines(F.col("r"), hands, c), O.capped_body(F.col("r"), hands, c)) == ["too_many_lines:6>2", "a\nb"]
    assert values(spark, {"c": "tail -n 2 x.txt", "r": raw}, O.capped_body(F.col("r"), hands, c)) == ["e\nf"]
    assert values(spark, {"c": "sed -n '3,4p;7,9p' x.py"}, O.line_cap(c)["most"]) == [5]
    assert values(spark, {"c": "a && cat x | head -2"}, O.line_cap(c)["most"]) == [None]
    view = "     7\tx\n     8\ty\n     8\tz"
    assert values(spark, {"c": "cat -n a.py", "r": view}, O.renumbered(F.col("r"), c)) == ["     7\tx\n     8\ty\n     9\tz"]
    assert values(spark, {"c": "sed -n '9,11p' a.py | cat -n", "r": view}, O.renumbered(F.col("r"), c)) == ["     9\tx\n    10\ty\n    11\tz"]
    assert values(spark, {"c": "grep -n x a.py | cat -n", "r": view}, O.renumbered(F.col("r"), c)) == [view]


def test_return_codes(spark):
    raw = "<returncode>0</returncode>\n<output>\nx\ncat: a: No such file or directory\n</output>"
    fmt, c = F.lit("returncode"), F.col("c")
    assert values(spark, {"c": "cat a", "r": raw}, O.correct_returncode(F.col("r"), fmt, c))[0].startswith("<returncode>1</returncode>\n<output>\nx\n")
    assert values(spark, {"c": "python a", "r": raw}, O.correct_returncode(F.col("r"), fmt, c)) == [raw]
    assert values(spark, {"r": "x [Command finished with exit code -1]"}, O.returncode(F.col("r"))) == [-1]


def test_scripts_and_ranks(spark):
    text = "<bash>ls</bash> then\n```bash\npwd\n```"
    assert values(spark, {"t": text}, O.first_script(F.col("t")), O.action_blocks(F.col("t"))) == ["ls", ["pwd", "ls"]]
    good = "<returncode>0</returncode>\n<output>\nx\n</output>"
    fmt = F.lit("returncode")
    ranks = [values(spark, {"r": r, "c": "cat a.py"}, O.rank(F.col("r"), fmt, F.col("c")))[0] for r in ("no", "<returncode>0</returncode>\n<output>\n\n</output>", "<returncode>0</returncode>\n<output>\nLet me see\n</output>", good)]
    assert ranks == [0, 1, 2, 3]


def test_submit_commands_and_names(spark):
    said = "array(struct('user' AS role, 'Run `echo DONE_MARK` at the end.' AS content), struct('assistant' AS role, 'echo DONE_MARK now' AS content))"
    assert spark.range(1).select(T.stated_command(F.expr(said), MARKER)).first()[0] == "echo DONE_MARK"
    assert values(spark, {"n": "MCMXCIV"}, N.from_roman(F.col("n")), N.from_roman(F.lit("IIII")), N.roman(F.lit(0))) == [1994, None, None]
    assert values(spark, {"u": "file:///x"}, N.bucket_and_key(F.col("u"))["bucket"]) == [None]
    assert values(spark, {"o": "a\nexited with code 3"}, T.split_status(F.col("o"))["code"]) == [3]
    with pytest.raises(Exception, match="unexpected prompt structure"):
        values(spark, {"p": "<|im_start|>user\nx<|im_end|>"}, T.system_and_user(F.col("p")))
    found = "array(struct('ls' AS command, 7 AS count, 5 AS longest_run), struct('pwd' AS command, 2 AS count, 1 AS longest_run))"
    assert spark.range(1).select(T.loop_explanation(F.expr(found), 1)).first()[0] == "Looping commands: `ls` 7x (5 consecutive); and 1 more."
