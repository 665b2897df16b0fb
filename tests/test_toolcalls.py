"""Conversations with tool calls against a plain loop over their turns."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import toolcalls as T


def plain(turns):
    """A loop with the thoughts that wait for the next call that is written."""
    turns = [t for t in turns if isinstance(t, dict)]
    out, waiting, edits = [], [], []
    results = [str(t.get("content") or "").strip() for t in turns if str(t.get("role") or "").lower() == "tool"]
    told = next((tagged(r) is not None for r in results if r), False)

    def observe(text):
        text = (tagged(text) or text) if told else text
        if text and T.LOGGED not in text.lower():
            out.append(("user", text))

    i = 0
    while i < len(turns):
        t, role = turns[i], str(turns[i].get("role") or "").lower()
        thought = next((str(t[k]).strip() for k in ("content", "reasoning_content", "think") if t.get(k)), "")
        calls = t.get("tool_calls")
        calls = json.loads(calls) if isinstance(calls, str) and calls.startswith("[") else calls if isinstance(calls, list) else []
        calls = [c for c in calls if isinstance(c, dict)]
        i += 1
        if role == "tool":
            observe(str(t.get("content") or "").strip())
        elif role in ("system", "user"):
            out += [(role, thought)] if thought else []
        elif role == "assistant" and not calls:
            waiting.append(thought)
        elif role == "assistant":
            got = []
            while i < len(turns) and str(turns[i].get("role") or "").lower() == "tool":
                got.append(str(turns[i].get("content") or "").strip())
                i += 1
            for k, c in enumerate(calls):
                text, edit, kind = told_call(c)
                if kind == "think":
                    waiting += [thought, text]
                    thought = ""
                    continue
                if text:
                    head = "\n\n".join(x for x in (*waiting, thought) if x)
                    waiting, thought = [], ""
                    out.append(("assistant", f"THOUGHT: {head}\n\n{text}" if head else text))
                    edits.append(edit)
                if k < len(got):
                    observe(got[k])
            for r in got[len(calls) :]:
                observe(r)
    return out, edits.index(True) + 1 if True in edits else 0


def tagged(text):
    try:
        d = json.loads(text)
    except ValueError:
        return None
    if not isinstance(d, dict) or "returncode" not in d or not set(d) <= set(T.DIALECT):
        return None
    head = f"<returncode>{d['returncode']}</returncode>\n"
    if d.get("exception_info"):
        head += f"<exception_info>{d['exception_info']}</exception_info>\n"
    if "output_head" in d:
        return f"{head}<warning>\n{d.get('warning') or ''}\n</warning><output_head>\n{d['output_head']}\n</output_head>\n<elided_chars>\n{d.get('elided_chars')} characters elided\n</elided_chars>\n<output_tail>\n{d.get('output_tail') or ''}\n</output_tail>"
    return f"{head}<output>\n{d.get('output') or ''}</output>"


def told_call(c):
    f = c.get("function") or {}
    name, args = (f.get("name") or c.get("name") or "").lower(), f.get("arguments", c.get("arguments"))
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except ValueError:
            args = {}
    args = args if isinstance(args, dict) else {}
    block = lambda x: f"```bash\n{x.strip()}\n```"
    if name in T.THINKERS:
        return args.get("thought") or args.get("text") or "", False, "think"
    if name in T.FINISHERS:
        return block(T.FINISHED), False, "done"
    if name in T.SHELLS:
        cmd = args.get("command") or args.get("cmd") or ""
        return block(cmd), cmd.startswith(("sed -i", "echo x >")), "action"
    if name in T.EDITORS:
        what, path = args.get("command"), args.get("path") or args.get("file_path") or ""
        texts = {
            "view": block("sed -n '{},{}p' {} | cat -n".format(*args["view_range"], path) if args.get("view_range") else f"cat -n {path}"),
            "create": block(f"cat > {path} <<'EOF'\n{args.get('file_text')}\nEOF"), "insert": block(f"sed -i '{args.get('insert_line')}a\\\n{args.get('new_str')}' {path}"),
            "str_replace": f"Editing `{path}`:\n\n```\n<<<<<<< SEARCH\n{args.get('old_str')}\n=======\n{args.get('new_str')}\n>>>>>>> REPLACE\n```", "undo_edit": block(f"git checkout -- {path}"),
        }
        return texts.get(what, block(f"# {what} {path}")), what in T.EDITS, "action"
    return "", False, "unknown"


def call(name, args, text=True, bare=False):
    f = {"name": name, "arguments": json.dumps(args) if text else args}
    return f if bare else {"function": f}


def random_call(rng):
    word = rng.choice(["a.py", "b c", "é"])
    return rng.choice([
        call("bash", {"command": f" ls {word}\n"}), call("Shell", {"cmd": f"sed -i 's/a/b/' {word}"}, False), call("execute_bash", {"command": "echo x > f"}, bare=True), call("bash", {"command": f"ls 2>&1 -> {word}"}),
        call("think", {"thought": f"hm {word}"}), call("think", {}), call("finish", {}), call("odd", {"x": 1}), call("bash", "not json"), call("bash", None), {"function": None, "name": "submit"}, "no object",
        call("file_editor", {"command": "view", "path": word, "view_range": [1, 20]}), call("edit_file", {"command": "create", "file_path": word, "file_text": "x\ny"}, False),
        call("str_replace_editor", {"command": "str_replace", "path": word, "old_str": "o", "new_str": "n"}), call("file_editor", {"command": "insert", "path": word, "insert_line": 3, "new_str": "z"}),
        call("file_editor", {"command": "undo_edit", "path": word}), call("file_editor", {"command": "other", "path": word}), call("file_editor", {"command": "view", "path": word}),
    ])


def random_turns(rng):
    harness = rng.random() < 0.4
    out = []
    for k in range(rng.randint(0, 9)):
        role = rng.choice(["assistant", "assistant", "Tool", "tool", "user", "system", "other"])
        text = rng.choice(["", None, f" text {k}\n", "Your thought has been logged.", "[1]"])
        if role.lower() == "tool" and harness:
            text = json.dumps(rng.choice([{"returncode": k, "output": "o\n"}, {"returncode": -1, "output": "", "exception_info": "late"}, {"returncode": 0, "output_head": "h", "output_tail": "t", "elided_chars": 42, "warning": "w"}, {"returncode": 1, "x": 2}]))
        t = {"role": role, "content": text}
        if rng.random() < 0.2:
            t[rng.choice(["reasoning_content", "think"])] = f"deep {k}"
        if role == "assistant" and rng.random() < 0.8:
            calls = [random_call(rng) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
            t["tool_calls"] = rng.choice([calls, json.dumps(calls), calls])
        out.append(t)
        if role == "assistant":
            out += [{"role": "tool", "content": rng.choice(["result", f"r{k}", "your THOUGHT has been logged"]) if not harness else json.dumps({"returncode": 0, "output": f"r{k}"})} for _ in range(rng.randint(0, 3))]
    return out + ([None, "x"] if rng.random() < 0.2 else [])


def test_conversations_equal_a_plain_loop(spark):
    rng = random.Random(8)
    made = [random_turns(rng) for _ in range(250)] + [[], [{}], [{"role": "tool", "content": "alone"}]]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(made)], "i int, trajectory string").repartition(4)
    for r in rows.select("i", T.rendered(T.turns_of(rows)).alias("r")).collect():
        turns, first = plain(made[r.i])
        assert [tuple(t) for t in r.r.turns] == turns and r.r.first_edit == first, made[r.i]


def test_where_turns_stand(spark):
    kind = "i int, messages array<struct<role: string, content: string>>, turns string, trajectory string"
    rows = spark.createDataFrame([(0, [("user", "a")], None, None), (1, None, '{"turns": [{"role": "user"}, 2]}', "[]"), (2, None, "not json", '[{"role": "x"}]'), (3, None, None, None)], kind)
    got = {r.i: r.n for r in rows.select("i", F.size(T.turns_of(rows)).alias("n")).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 0}


@pytest.mark.parametrize(("command", "edit"), [
    ("sed -i s/a/b/ f", True), ("sed -n 1p f", False), ("ls | tee out", True), ("cat > f", True), ("cat f", False), ("git apply p", True), ("patch -p1", True), ("cp a b", True), ("mv ./a b", True),
    ("echo x >> log.txt", True), ("ls 2>err", False), ("ls > /dev/null", False), ("ls &> f", False), ("a -> b", False), ("ls 2>&1", False), ("echo>f", True), ("cat >/tmp/x", True), ("", False),
])
def test_commands_that_write(spark, command, edit):
    assert spark.range(1).select(T.changes_files(F.lit(command)).alias("e")).first().e is edit
