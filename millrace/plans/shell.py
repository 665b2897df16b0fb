"""Shell search commands to DataFrame plans over a table `files(path, text)`.

A command is parsed to stages; the first reads files, the others work on the lines that come out.
What the planner can't answer exactly it declines, by raising Declined; it never guesses.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field
from fnmatch import translate as glob_to_regex

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Declined(ValueError):
    """The command can't be answered exactly."""


@dataclass
class Stage:
    name: str
    flags: dict[str, str | bool] = field(default_factory=dict)
    args: list[str] = field(default_factory=list)


VALUED = {"grep": "meABC", "head": "nc", "tail": "nc", "sort": "k", "find": "", "wc": "", "cat": "", "uniq": "", "sed": ""}
KNOWN = {"grep": "nclLviwxFErRm", "head": "n", "tail": "n", "sort": "urn", "wc": "lwc", "cat": "n", "uniq": "c", "sed": "n"}


def parse(command: str) -> list[Stage]:
    """Stages of a pipeline of simple commands."""
    lexer = shlex.shlex(command, posix=True, punctuation_chars="|&;<>()")
    lexer.whitespace_split = True
    words: list[list[str]] = [[]]
    for token in lexer:
        if token == "|":
            words.append([])
        elif re.fullmatch(r"[|&;<>()]+", token):
            raise Declined(f"{token} isn't a plain pipeline")
        else:
            words[-1].append(token)
    return [stage(w) for w in words]


def stage(words: list[str]) -> Stage:
    if not words:
        raise Declined("empty stage")
    out = Stage(words[0])
    if out.name == "find":
        return find_stage(words)
    if out.name not in KNOWN:
        raise Declined(f"{out.name} isn't known")
    rest = iter(words[1:])
    plain = False
    for w in rest:
        if plain or not w.startswith("-") or w == "-":
            out.args.append(w)
        elif w == "--":
            plain = True
        elif w.startswith("--"):
            name, eq, value = w[2:].partition("=")
            if name not in ("include", "exclude", "exclude-dir") or not eq:
                raise Declined(w)
            out.flags[name] = value
        elif re.fullmatch(r"-\d+", w) and out.name in ("head", "tail"):
            out.flags["n"] = w[1:]
        else:
            letters = w[1:]
            for i, c in enumerate(letters):
                if c in VALUED[out.name]:
                    out.flags[c] = letters[i + 1 :] or next(rest, "")
                    break
                if c not in KNOWN[out.name]:
                    raise Declined(f"{out.name} -{c}")
                out.flags[c] = True
    return out


def find_stage(words: list[str]) -> Stage:
    out, rest = Stage("find"), iter(words[1:])
    for w in rest:
        if not w.startswith("-"):
            out.args.append(w)
        elif w in ("-name", "-iname", "-path", "-type", "-maxdepth"):
            out.flags[w[1:]] = next(rest, "")
        else:
            raise Declined(f"find {w}")
    return out


def java_regex(pattern: str, extended: bool, fixed: bool) -> str:
    """A basic or extended expression in Java's syntax."""
    if fixed:
        return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    if re.search(r"\[\[?[.=]|\\[1-9<>bBwWsS`']", pattern):
        raise Declined("back references and GNU escapes aren't translated")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if inside:
            inside = c != "]" or out[-1] in ("[", "[^")
            name = re.match(r"\[:(\w+):\]", pattern[i:])
            if name:
                out.append({"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}"}[name[1]])
                i += len(name[0])
                continue
            out.append("\\" + c if c in "\\[&" and inside else c)
        elif c == "[":
            inside = True
            out.append("[^" if two == "[^" else "[")
            i += two == "[^"
        elif c == "\\" and len(two) == 2:
            special = two[1] in "(){}|+?"
            out.append(two[1] if special and not extended else two)
            i += 1
        elif c in "(){}|+?" and not extended:
            out.append("\\" + c)
        elif not extended and ((c == "^" and out and pattern[i - 2 : i] not in (r"\(", r"\|")) or (c == "$" and i + 1 < len(pattern) and pattern[i + 1 : i + 3] not in (r"\)", r"\|")) or (c == "*" and (not out or out[-1] in ("(", "|", "^")))):
            out.append("\\" + c)  # away from the ends of a basic expression these are literal
        else:
            out.append(c)
        i += 1
    return "".join(out)


def glob(pattern: str) -> str:
    return glob_to_regex(pattern).replace(r"(?s:", "(?s:").replace(r"\z", "$").replace(r"\Z", "$")


def under(paths: list[str]):
    cond = F.lit(False)
    for p in paths:
        p = p.rstrip("/").removeprefix("./")
        cond = cond | F.lit(p in ("", ".")) | (F.col("path") == p) | F.col("path").startswith(p + "/")
    return cond


def selected(files: DataFrame, s: Stage) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    if "include" in s.flags:
        files = files.where(name.rlike("^" + glob(s.flags["include"])))
    if "exclude" in s.flags:
        files = files.where(~name.rlike("^" + glob(s.flags["exclude"])))
    if "exclude-dir" in s.flags:
        part = "^" + glob(s.flags["exclude-dir"])
        files = files.where(~F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda d: d.rlike(part)))
    return files


def file_lines(files: DataFrame) -> DataFrame:
    """(path, i, line); the empty piece after a final newline isn't a line."""
    text = F.regexp_replace("text", r"\n$", "")
    return files.where(F.length("text") > 0).select("path", F.posexplode(F.split(text, "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("i"), "line")


def matcher(s: Stage, pattern: str):
    regex = java_regex(pattern, bool(s.flags.get("E")), bool(s.flags.get("F")))
    if s.flags.get("x"):
        regex = f"^(?:{regex})$"
    elif s.flags.get("w"):
        regex = rf"(?<![A-Za-z0-9_])(?:{regex})(?![A-Za-z0-9_])"
    hit = F.col("line").rlike(("(?i)" if s.flags.get("i") else "") + regex)
    return ~hit if s.flags.get("v") else hit


def grep(files: DataFrame, s: Stage) -> DataFrame:
    args = list(s.args)
    pattern = s.flags.get("e") or (args.pop(0) if args else None)
    if pattern is None or not args:
        raise Declined("grep needs a pattern and files")
    if not (s.flags.get("r") or s.flags.get("R")):
        files = files.where(F.col("path").isin([a.removeprefix("./") for a in args]))
    else:
        files = selected(files.where(under(args)), s)
    found = file_lines(files).withColumn("hit", matcher(s, str(pattern)))
    before, after = int(s.flags.get("B") or s.flags.get("C") or 0), int(s.flags.get("A") or s.flags.get("C") or 0)
    if s.flags.get("c"):
        n = found.groupBy("path").agg(F.count_if("hit").alias("n"))
        return files.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    if s.flags.get("l"):
        return found.where("hit").select("path").distinct()
    if s.flags.get("L"):
        return files.select("path").join(found.where("hit").select("path").distinct(), "path", "left_anti")
    if s.flags.get("m"):
        nth = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("path").orderBy("i"))
        found = found.withColumn("k", nth).where(f"hit AND k <= {int(s.flags['m'])}").drop("k")
    if before or after:
        near = Window.partitionBy("path").orderBy("i").rowsBetween(-after, before)
        return found.withColumn("near", F.max(F.col("hit").cast("int")).over(near)).where("near = 1").drop("near")
    return found.where("hit").drop("hit")


def find(files: DataFrame, s: Stage) -> DataFrame:
    """Paths of files and of the directories above them."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.when(k == F.size(parts), "f").otherwise("d").alias("type"), k.alias("depth")))
    every = files.select(F.explode(steps).alias("s")).select("s.*").distinct().where(under(s.args or ["."]))
    name = F.element_at(F.split("path", "/"), -1)
    top = 0 if (s.args or ["."])[0] in (".", "./") else len(s.args[0].rstrip("/").split("/"))
    if "name" in s.flags:
        every = every.where(name.rlike("^" + glob(s.flags["name"])))
    if "iname" in s.flags:
        every = every.where(F.lower(name).rlike("^" + glob(s.flags["iname"].lower())))
    if "path" in s.flags:
        every = every.where(F.col("path").rlike("^" + glob(s.flags["path"].removeprefix("./"))))
    if "type" in s.flags:
        every = every.where(F.col("type") == s.flags["type"])
    if "maxdepth" in s.flags:
        every = every.where(F.col("depth") <= top + int(s.flags["maxdepth"]))
    return every.select(F.col("path").alias("line"), F.col("path"), F.lit(1).alias("i"))


def read(files: DataFrame, s: Stage) -> DataFrame:
    """cat, head, tail, sed -n a,bp, wc of named files."""
    args = list(s.args)
    script = args.pop(0) if s.name == "sed" else ""
    files = files.where(F.col("path").isin([a.removeprefix("./") for a in args]))
    if s.name == "wc":
        words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
        each = files.select("path", F.regexp_count("text", F.lit("\n")).alias("l"), words.alias("w"), F.octet_length("text").alias("c"))
        wanted = [k for k in "lwc" if s.flags.get(k)] or list("lwc")
        sums = [F.sum(k).alias(k) for k in wanted]
        return (each.rollup("path") if len(set(args)) > 1 else each.groupBy("path")).agg(*sums)
    got = file_lines(files)
    if s.name == "cat":
        return got
    if s.name == "sed":
        m = re.fullmatch(r"(\d+)(?:,(\d+|\$))?p", script)
        if not m or not s.flags.get("n"):
            raise Declined(f"sed {script}")
        last = m[1] if m[2] is None else m[2]
        return got.where(F.col("i") >= int(m[1])) if last == "$" else got.where(F.col("i").between(int(m[1]), int(last)))
    n = int(str(s.flags.get("n") or 10).lstrip("+"))
    if s.name == "head":
        return got.where(F.col("i") <= n)
    if str(s.flags.get("n") or "").startswith("+"):
        return got.where(F.col("i") >= n)
    return got.withColumn("of", F.max("i").over(Window.partitionBy("path"))).where(F.col("i") > F.col("of") - n).drop("of")


ORDERED = ("path", "i")


def pipe(rows: DataFrame, s: Stage, order: list) -> tuple[DataFrame, list]:
    """One later stage over lines in a stated order."""
    if "line" not in rows.columns:
        raise Declined(f"{s.name} can't follow a count")
    if s.name == "grep":
        return rows.where(matcher(s, str(s.flags.get("e") or s.args[0]))), order
    if s.name == "head":
        return rows.orderBy(*order).limit(int(s.flags.get("n") or 10)), order
    if s.name == "sort":
        if s.flags.get("u"):
            rows = rows.select("line").distinct()
        number = F.coalesce(F.regexp_extract("line", r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
        keys = [number, F.col("line")] if s.flags.get("n") else [F.col("line")]
        return rows, [k.desc() if s.flags.get("r") else k.asc() for k in keys]
    if s.name == "uniq":
        if not any("line" in str(o) for o in order):
            raise Declined("uniq needs sorted lines here")
        got = rows.groupBy("line").agg(F.count("*").alias("n"))
        return got.select(F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 7, " "), "line").alias("line"), "n") if s.flags.get("c") else got.select("line"), [F.col("line").asc()]
    if s.name == "wc" and s.flags.get("l"):
        return rows.agg(F.count("*").alias("n")), []
    raise Declined(f"{s.name} in a pipe")


def run_command(files: DataFrame, command: str) -> DataFrame:
    """The answer of a command over files(path, text); lines come ordered where the shell orders them."""
    first, *rest = parse(command)
    makers = {"grep": grep, "find": find, "cat": read, "head": read, "tail": read, "sed": read, "wc": read}
    if first.name not in makers:
        raise Declined(first.name)
    rows, order = makers[first.name](files, first), [F.col(c) for c in ORDERED]
    for s in rest:
        rows, order = pipe(rows, s, order)
    return rows.orderBy(*order) if rest and order else rows
