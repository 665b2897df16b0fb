"""Order-dependent text functions on transcripts: command chains, replies, diffs, edits, replays.

Each is a plain function of one row. `column` makes an Arrow-batched Column function of any of them.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import shlex
from collections.abc import Callable, Iterable
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import functions as F


def column(f: Callable, kind: str):
    """A Column function that applies f to each value, nulls giving null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


HEREDOC = re.compile(r"<<-?\s*(['\"]?)(\w+)\1")


def heredocs(script: str) -> list[tuple[str, str]]:
    """(tag, body) of every here-document, in order."""
    out, lines, i = [], script.split("\n"), 0
    while i < len(lines):
        tags = [m[2] for m in HEREDOC.finditer(lines[i])]
        i += 1
        for tag in tags:
            body = []
            while i < len(lines) and lines[i].strip() != tag:
                body.append(lines[i])
                i += 1
            i += 1
            out.append((tag, "\n".join(body)))
    return out


def command_chain(script: str) -> list[str]:
    """Commands of a script, split at && || ; and line ends outside quotes and here-documents."""
    out, now, quote, i, waiting = [], "", "", 0, []
    while i < len(script):
        c, two = script[i], script[i : i + 2]
        if quote:
            now += two if c == "\\" and quote == '"' else c
            i += 2 if c == "\\" and quote == '"' else 1
            quote = "" if c == quote else quote
            continue
        if c in "'\"":
            quote, now, i = c, now + c, i + 1
        elif c == "\\":
            now, i = now + two, i + 2
        elif two == "<<" and (m := HEREDOC.match(script, i)):
            waiting.append(m[2])
            now, i = now + m[0], m.end()
        elif c == "\n" and waiting:
            now, i = now + c, i + 1
            while waiting:
                end = script.find("\n", i)
                line = script[i : len(script) if end < 0 else end]
                now += line + "\n"
                i = len(script) if end < 0 else end + 1
                if line.strip() == waiting[0]:
                    waiting.pop(0)
                if end < 0:
                    break
            out.append(now.rstrip("\n"))
            now = ""
        elif two in ("&&", "||") or c in ";\n":
            out.append(now)
            now, i = "", i + (2 if two in ("&&", "||") else 1)
        else:
            now, i = now + c, i + 1
    return [x.strip() for x in [*out, now] if x.strip()]


def outside_fences(text: str, change: Callable[[str], str]) -> str:
    return "".join(p if i % 2 else change(p) for i, p in enumerate(re.split(r"(```.*?(?:```|\Z))", text, flags=re.S)))


def without_reasoning(text: str) -> str:
    """Thinking blocks outside fences removed; a block that never closes goes to the end."""
    return outside_fences(text, lambda t: re.sub(r"<think>.*?(?:</think>|\Z)", "", t, flags=re.S).replace("</think>", "")).strip()


def canonical_hash(value) -> str:
    """Hash of a JSON value with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def json_text_hash(text: str) -> str | None:
    try:
        return canonical_hash(json.loads(text))
    except ValueError:
        return None


def tail_period(text: str, window: int = 512, most: int = 128) -> int:
    """Smallest period of the last `window` characters, 0 if none up to `most`."""
    tail = text[-window:]
    if len(tail) < window:
        return 0
    return next((p for p in range(1, most + 1) if tail[p:] == tail[:-p]), 0)


def collapsed_lines(text: str, run: int = 25) -> str:
    """Runs of at least `run` equal lines cut to one and a note."""
    out: list[str] = []
    lines, i = text.split("\n"), 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j] == lines[i]:
            j += 1
        out += [lines[i], f"[{j - i - 1} equal lines]"] if j - i >= run else lines[i:j]
        i = j
    return "\n".join(out)


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff(old: str, new: str, path: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


def hunks(patch: str) -> list[dict]:
    """Hunks of a unified diff: path, numbers, lines."""
    out, path = [], None
    for line in patch.split("\n"):
        if line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].split("\t")[0].strip())
        elif m := HUNK.match(line):
            out.append({"path": path, "old": int(m[1]), "old_n": int(m[2] or 1), "new": int(m[3]), "new_n": int(m[4] or 1), "lines": []})
        elif out and line[:1] in " +-\\" and line and not line.startswith("--- "):
            out[-1]["lines"].append(line)
    return out


def patch_faults(patch: str) -> list[str]:
    """Hunks whose counts disagree with their lines, and hunks without a file."""
    out = []
    for k, h in enumerate(hunks(patch)):
        old, new = (sum(x[0] in kinds for x in h["lines"]) for kinds in (" -", " +"))
        if (old, new) != (h["old_n"], h["new_n"]):
            out.append(f"hunk {k}: counts {h['old_n']},{h['new_n']} but lines {old},{new}")
        if not h["path"]:
            out.append(f"hunk {k}: no file")
    return out


def applied(text: str, parts: Iterable[dict]) -> str | None:
    """text with the hunks applied where their context is found nearest to its place; null if it isn't."""
    lines, shift = text.split("\n"), 0
    for h in parts:
        old = [x[1:] for x in h["lines"] if x[0] in " -"]
        new = [x[1:] for x in h["lines"] if x[0] in " +"]
        want = max(0, h["old"] - 1 + shift)
        places = [i for i in range(len(lines) - len(old) + 1) if lines[i : i + len(old)] == old]
        if not places:
            return None
        at = min(places, key=lambda i: abs(i - want))
        lines[at : at + len(old)] = new
        shift += len(new) - len(old)
    return "\n".join(lines)


SED = re.compile(r"^(?:(\d+|\$)(?:,(\d+|\$))?)?\s*([sdaic])(.*)$", re.S)


def sed(program: str, text: str) -> str | None:
    """A one-command sed program with line addresses applied to a text; null if it isn't understood."""
    m = SED.match(program.strip())
    if not m:
        return None
    lines = text.split("\n")
    final = lines.pop() if lines[-1] == "" else None
    number = lambda x: len(lines) if x == "$" else int(x)
    first = number(m[1]) if m[1] else 1
    last = number(m[2]) if m[2] else (first if m[1] else len(lines))
    out = []
    edit = None
    if m[3] == "s":
        cut = m[4][:1]
        parts = re.split(rf"(?<!\\){re.escape(cut)}", m[4][1:])
        if len(parts) != 3 or set(parts[2]) - set("gI"):
            return None
        edit = re.compile(re.sub(r"\\([(){}|+?])|([(){}|+?])", lambda g: g[1] or "\\" + g[2], parts[0]), re.I if "I" in parts[2] else 0)
    for i, line in enumerate(lines, 1):
        here = first <= i <= last
        if here and edit:
            line = edit.sub(re.sub(r"(?<!\\)&", r"\\g<0>", parts[1]), line, 0 if "g" in parts[2] else 1)
        if here and m[3] == "d":
            continue
        added = m[4].strip().removeprefix("\\").lstrip("\n ")
        if here and m[3] == "i":
            out.append(added)
        out.append(added if here and m[3] == "c" else line)
        if here and m[3] == "a":
            out.append(added)
    return "\n".join([*out, *([final] if final is not None else [])])


#: Commands whose status is the same whatever the files are.
STATUS = {"echo": "succeeds", "printf": "succeeds", "true": "succeeds", ":": "succeeds", "false": "fails"}


def replayed(files: dict[str, str | None], commands: Iterable[str]) -> dict[str, str | None]:
    """Files after simple write commands; null stands for a file whose text isn't known any more, or
    that may be gone: whether a stage behind && or || runs is known only after commands that can't fail."""
    now = dict(files)
    for command in commands:
        at, status = 0, None
        for one in command_chain(command):
            begin = max(command.find(one, at), at)
            glue = command[at:begin].rstrip()[-2:]
            at = begin + len(one)
            if (glue == "&&" and status == "fails") or (glue == "||" and status == "succeeds"):
                continue
            unsure = glue in ("&&", "||") and status is None
            before = dict(now)
            status = None if unsure else STATUS.get(one.split()[0])
            body = heredocs(one)
            head = one.split("\n")[0]
            to = re.search(r"(>>?)\s*([\w./-]+)", head)
            try:
                words = shlex.split(HEREDOC.sub("", head.split(">")[0]))
            except ValueError:
                continue
            if not words:
                continue
            name, args = words[0], [w for w in words[1:] if not w.startswith("-")]
            if to:
                text = body[0][1] + "\n" if body else (" ".join(args) + "\n" if name == "echo" else None)
                if to[1] == ">>" and text is not None and now.get(to[2], "") is not None:
                    text = (now.get(to[2]) or "") + text
                now[to[2]] = text
            elif name == "rm":
                now = {p: t for p, t in now.items() if not any(p == a or p.startswith(a.rstrip("/") + "/") for a in args)}
            elif name in ("mv", "cp") and len(args) == 2 and args[0] in now:
                now[args[1]] = now.pop(args[0]) if name == "mv" else now[args[0]]
            elif name == "touch":
                for a in args:
                    now.setdefault(a, "")
            elif name == "sed" and any(w.startswith("-i") for w in words) and len(args) >= 2:
                for a in args[1:]:
                    if now.get(a) is not None:
                        now[a] = sed(args[0], now[a])
            if unsure:
                now = {p: now.get(p) if p in now and p in before and now[p] == before[p] else None for p in [*before, *(p for p in now if p not in before)]}
    return now


def tree_status(head: dict[str, str], index: dict[str, str], work: dict[str, str]) -> dict[str, str]:
    """Two-letter status of each path that differs between the three trees."""
    out = {}
    for p in sorted({*head, *index, *work}):
        x = " " if head.get(p) == index.get(p) else "A" if p not in head else "D" if p not in index else "M"
        y = " " if index.get(p) == work.get(p) else "?" if p not in index else "D" if p not in work else "M"
        if x + y != "  ":
            out[p] = "??" if y == "?" else x + y
    return out


def ignored(path: str, rules: list[str]) -> bool:
    """Whether the last rule that matches a path excludes it."""
    out = False
    for rule in rules:
        keep = rule.startswith("!")
        pattern = rule.removeprefix("!").rstrip("/")
        if fnmatch(path, pattern) or fnmatch(path.split("/")[-1], pattern) or path.startswith(pattern.lstrip("/") + "/"):
            out = not keep
    return out


def trailing_repeats(commands: list[str]) -> int:
    """How many of the last commands are equal."""
    n = 0
    for c in reversed(commands):
        if c != commands[-1]:
            break
        n += 1
    return n
