"""Paths that transcripts show to exist and paths that commands name, held against listings of files by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table

# Sentences by which an editor reports, signs of an absent file, folders of a checkout.
CREATED = "File created successfully at:"
VIEWED = "Here's the result of running"
LISTED = "Here's the files and directories up to"
ABSENT = ("No such file or directory", "cannot access", "can't read", "can't open file", "does not exist")
CHECKOUT = r"(?:/testbed|/workspace/[A-Za-z0-9_.+-]+__[A-Za-z0-9_.+-]+)(?![A-Za-z0-9_.+-])"
# Programs whose first argument, or the value of an option, is data; those that run code of an option;
# those that make their last argument.
PATTERNS = {"sed": ("-e", "--expression"), "grep": ("-e", "--regexp"), "egrep": ("-e",), "fgrep": ("-e",), "rg": ("-e",), "awk": ()}
CODE = {"python": "-c", "node": "-e", "perl": "-e", "bash": "-c", "sh": "-c"}
COPIERS, MAKERS = ("cp", "mv", "install"), ("tee", "touch", "mkdir")

_BREAKS = re.compile(r"[\s|;&<>()\"']+")
_LEXEME = re.compile(r"""(?P<stop>\|\|?|&&?|;|\n|[()])|(?P<redirect>\d*>>?|<)|(?P<word>(?:[^\s|;&()<>'"\\]|\\.|'[^']*'|"(?:[^"\\]|\\.)*")+)|(?P<odd>["'\\])""", re.DOTALL)
_QUOTED = re.compile(r"""'([^']*)'|"((?:[^"\\]|\\.)*)"|\\(.)""", re.DOTALL)
_HERE = re.compile(r"<<-?[ \t]*(['\"]?)(\w+)\1[^\n]*\n(?P<body>.*?)(?:\n[ \t]*\2[ \t]*(?=\n|\Z)|\Z)", re.DOTALL)
_TARGET = re.compile(r">>?\s*[^\s|;&()\"'<>]+")
_DESTINATION = re.compile(rf"\b(?:(?:{'|'.join(COPIERS)})\s+(?:-\S+\s+)*\S+|(?:{'|'.join(MAKERS)})(?:\s+-\S+)*)\s+(\S+)")
_FILE = re.compile(r"\.?[\w@.-]+\.[A-Za-z][A-Za-z0-9]*")
_ROOT = re.compile(CHECKOUT)


def checkout_path(word: str) -> str | None:
    """The path from the checkout's root ("" for the root itself) that a word names; None for what lies outside."""
    inside = not word.startswith("/")
    parts: list[str] = []
    for part in word.split("/"):
        if part == "..":
            if inside and not parts:
                return None
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    if inside:
        return "/".join(parts)
    whole = "/" + "/".join(parts)
    root = _ROOT.match(whole)
    return whole[root.end() :].lstrip("/") if root else None


def _bare(word: str) -> str:
    return _QUOTED.sub(lambda m: next(g for g in m.groups() if g is not None), word)


def data_of(command: str) -> list[str]:
    """Spans of a command that are data, not names of files: bodies of here-documents, scripts of sed and awk, patterns
    of grep, code that an interpreter takes as an option. With an open quote only the bodies are known."""
    bodies = [m["body"] for m in _HERE.finditer(command)]
    calls: list[list[str]] = [[]]
    skip = False
    for m in _LEXEME.finditer(_HERE.sub("\n", command)):
        if m["odd"]:
            return bodies
        if m["stop"]:
            calls.append([])
        elif m["redirect"]:
            skip = True
        else:
            if not skip:
                calls[-1].append(_bare(m["word"]))
            skip = False
    spans: list[str] = []
    for call in filter(None, calls):
        while len(call) > 1 and re.fullmatch(r"\w+=.*", call[0], re.DOTALL):  # settings before the program
            call = call[1:]
        name, args = re.sub(r"[\d.]+$", "", call[0]), call[1:]
        if CODE.get(name) in args[:-1]:
            spans.append(args[args.index(CODE[name]) + 1])
        if name in PATTERNS:
            valued = [v for o, v in zip(args, args[1:]) if o in PATTERNS[name]]
            spans += valued or [a for a in args if not a.startswith("-")][:1]
    return bodies + spans


def words_of(command: str) -> Iterator[tuple[str, bool, bool]]:
    """(path, may be missing, must lie in a known folder) of each word that could name a file of the checkout.

    Targets of redirections, options, addresses and words with wildcards, variables or assignments name none. What is data
    or made by the command may be there, but is never missing.
    """
    made = {m[1] for m in _DESTINATION.finditer(command)}
    data = {w for span in data_of(command) for w in _BREAKS.split(span)}
    for word in _BREAKS.split(_TARGET.sub(" ", command)):
        if not word or word.startswith("-") or "://" in word or any(c in word for c in "*?[]{}$`="):
            continue
        path = checkout_path(word)
        if path:
            hidden = "/" not in path and path.startswith(".")
            sure = word.startswith("/") or hidden or bool(_FILE.fullmatch(path.rpartition("/")[2]))
            yield path, word not in made and word not in data, not sure


def _words(command: Column) -> Column:
    @F.pandas_udf("array<struct<place: int, path: string, open: boolean, known: boolean>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: [dict(place=i, path=p, open=o, known=k) for i, (p, o, k) in enumerate(words_of(c or ""))])

    return run(command)


def _absent(c: Column) -> Column:
    return c.rlike("|".join(ABSENT))


def attested_paths(turns: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(key, path): paths that an observation of the transcript showed to exist, each once.

    Those are files reported as created, files and folders whose view isn't an error, and the entries of a listed folder up to
    its first line of another form. Turns of the assistant attest nothing; a null or empty text has no paths. Built-in
    expressions only; one row for each path found is shuffled.
    """
    seen = turns.where(F.coalesce(F.lower(role), F.lit("")) != "assistant").where(F.col(text).isNotNull())
    every = lambda pattern, group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    created = every(rf"(?m)^{CREATED}\s*(\S+)\s*$", 1)
    view = rf"(?m)^\s*{VIEWED} `[^`]+` on (\S+?):[^\S\n]*(?=\n|\z)(?:\s*\n)?([^\n]*)"
    views = F.transform(
        F.filter(F.arrays_zip(every(view, 1).alias("path"), every(view, 2).alias("line")), lambda v: ~_absent(v["line"])), lambda v: F.btrim(v["path"], F.lit("`"))
    )
    block = rf"(?m)^{LISTED} \d+ levels? deep in \S+?[,:][^\n]*((?:\n[^\S\n]{{0,4}}+/[^\s:]++[^\S\n]*+(?=\n|\z))*+)"
    entries = F.transform(F.flatten(F.transform(every(block, 1), lambda b: F.split(b, "\n"))), lambda e: F.rtrim(F.regexp_replace(e, r"\s", ""), F.lit("/")))
    found = seen.select(key, F.explode(F.array_distinct(F.concat(created, views, entries))).alias("path"))
    return found.where((F.col("path") != "") & ~_absent(F.col("path"))).distinct()


def named_paths(commands: DataFrame, files: DataFrame, attested: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, place, path, status) of the paths that commands name, each path of a command once, in order of place.

    commands: (key, tree, command), files: (tree, path), attested: (key, path). Status is `present` for a file of the tree,
    `vouched` for one that only the transcript showed, `missing` for a path of the checkout that neither knows. Folders
    of the tree, paths outside the checkout and words that don't look like files get no row. A null command names nothing; a
    tree without files has only missing ones. Words meet files and folders as keys of equi-joins, so a tree may be of any
    size and no listing is held whole; the tree's side has one row a key, so a frequent word can be split by adaptive joins.
    """
    own = commands.select(key, "tree", F.explode(_words(F.col("command"))).alias("w")).select(key, "tree", "w.*")
    own = own.groupBy(key, "tree", "path").agg(F.min("place").alias("place"), F.max("open").alias("open"), F.min("known").alias("known"))
    parts = F.split("path", "/")
    folders = files.select("tree", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"), F.col("path").alias("whole"))
    known = folders.groupBy("tree", "path").agg(F.max(F.col("path") == F.col("whole")).alias("is_file"))
    tops = known.where(~F.col("is_file") & ~F.contains("path", F.lit("/"))).select("tree", F.col("path").alias("top"), F.lit(True).alias("under"))
    rows = own.withColumn("top", F.substring_index("path", "/", 1)).join(known, ["tree", "path"], "left").join(tops, ["tree", "top"], "left")
    rows = rows.where("is_file OR (is_file IS NULL AND open AND (NOT known OR under))")
    if attested is None:
        status = F.when(F.col("is_file"), "present").otherwise("missing")
        return rows.select(key, "place", "path", status.alias("status"))
    inside = F.regexp_replace("path", f"^{CHECKOUT}/*", "")
    shown = attested.select(key, F.when(~F.startswith(inside, F.lit("/")), inside).alias("path"), F.lit(True).alias("shown")).where("path <> ''").distinct()
    status = F.when(F.col("is_file"), "present").when(F.col("shown"), "vouched").otherwise("missing")
    return rows.join(shown, [key, "path"], "left").select(key, "place", "path", status.alias("status"))


_TURNS = """
SELECT conv_id, turn, role, length(t) AS n, w[{0}] AS a, w[{1}] AS b, w[{2}] AS c, w[{3}] AS d, t FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t, {concat}(regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1), {pad}) AS w FROM conversations)"""
_SPARK = _TURNS.format(0, 1, 2, 3, concat="concat", pad="array('a', 'b', 'c', 'd')")
_DUCK = _TURNS.format(1, 2, 3, 4, concat="list_concat", pad="['a', 'b', 'c', 'd']")
#: What an observation shows: created files, views of files there and absent, listings that other lines end.
_SHOWN = f"""t || chr(10) || CASE n % 5
    WHEN 0 THEN '{CREATED} /testbed/' || a || '/' || b || '.py  ' || chr(10) || 'done' WHEN 1 THEN ' {VIEWED.replace("'", "''")} `cat -n` on /testbed/' || c || '/' || d || '.py:' || chr(10) || chr(10) || '     1  ' || a
    WHEN 2 THEN '{VIEWED.replace("'", "''")} `cat -n` on /testbed/' || a || '/' || d || '.py:' || chr(10) || 'cat: No such file or directory'
    WHEN 3 THEN '{LISTED.replace("'", "''")} 2 levels deep in /testbed, without hidden items:' || chr(10) || '/testbed/' || a || '/' || chr(10) || '  /testbed/' || b || '/' || c || '.py' || chr(10) || 'and ' || d || chr(10) || '/testbed/' || d
    ELSE '' END"""
_FOUND = """
SELECT DISTINCT conv_id, path FROM (
    SELECT conv_id, unnest(CASE n % 5 WHEN 0 THEN ['/testbed/' || a || '/' || b || '.py'] WHEN 1 THEN ['/testbed/' || c || '/' || d || '.py'] WHEN 3 THEN ['/testbed/' || a, '/testbed/' || b || '/' || c || '.py'] ELSE [] END) AS path
    FROM t WHERE lower(role) <> 'assistant')"""
#: Commands of every kind: paths with dots, scripts, copies and paths outside, here-documents, patterns, variables.
_COMMAND = """CASE n % 6
    WHEN 0 THEN 'cat -n ./' || a || '/../' || c || '/' || b || '.py /testbed/' || b || '/' || a || '.py | head -3'
    WHEN 1 THEN 'sed -i ''s/' || a || '/' || b || '.' || c || '/'' ' || c || '/' || d || '.py > ' || a || '.log'
    WHEN 2 THEN 'cp ' || a || '/' || b || '.py ' || b || '/' || c || '.py && ls /usr/lib/' || d || '.py'
    WHEN 3 THEN 'cat > /tmp/' || a || '.py <<''EOF''' || chr(10) || 'open("' || b || '/' || c || '.py")' || chr(10) || 'EOF' || chr(10) || 'python3 ' || c || '/' || a || '.py'
    WHEN 4 THEN 'grep -rn ' || a || '.' || b || ' ' || c || ' /workspace/o__r/' || c || '/' || d || '.py'
    ELSE 'ls ' || a || ' ' || a || '/ ' || b || '/' || d || ' $X/' || c || '.py http://x/' || d || '.py *.py' END"""
_PATH = "CASE WHEN n % 7 = 0 THEN '' ELSE a || '/' END || b || CASE WHEN n % 4 = 0 THEN '.md' ELSE '.py' END"


@query(f"WITH t AS ({_DUCK}) {_FOUND}")
def attested_paths_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA59: turns with reports of an editor behind their own texts."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return attested_paths(spark.sql(f"SELECT conv_id, role, {_SHOWN} AS text FROM ({_SPARK})"))


@query(f"""
WITH t AS ({_DUCK}), f AS (SELECT DISTINCT role, {_PATH} AS path FROM t), v AS (SELECT conv_id, replace(path, '/testbed/', '') AS path FROM ({_FOUND})),
tops AS (SELECT DISTINCT role, split_part(path, '/', 1) AS top FROM f WHERE contains(path, '/')),
p AS (SELECT conv_id, turn, role, x.path AS path, bool_or(x.o) AS o, bool_and(x.k) AS k FROM (SELECT conv_id, turn, role, unnest(CASE n % 6
    WHEN 0 THEN [{{'path': c || '/' || b || '.py', 'o': true, 'k': false}}, {{'path': b || '/' || a || '.py', 'o': true, 'k': false}}]
    WHEN 1 THEN [{{'path': c || '/' || d || '.py', 'o': true, 'k': false}}]
    WHEN 2 THEN [{{'path': a || '/' || b || '.py', 'o': (a || '/' || b) <> (b || '/' || c), 'k': false}}, {{'path': b || '/' || c || '.py', 'o': false, 'k': false}}]
    WHEN 3 THEN [{{'path': b || '/' || c || '.py', 'o': false, 'k': false}}, {{'path': c || '/' || a || '.py', 'o': (c || '/' || a) <> (b || '/' || c), 'k': false}}]
    WHEN 4 THEN [{{'path': c || '/' || d || '.py', 'o': true, 'k': false}}]
    ELSE [{{'path': b || '/' || d, 'o': true, 'k': true}}] END) AS x FROM t) GROUP BY ALL)
SELECT conv_id, turn, path, CASE WHEN is_file THEN 'present' WHEN shown THEN 'vouched' ELSE 'missing' END AS status FROM (
    SELECT p.*, f.path IS NOT NULL AS is_file, v.path IS NOT NULL AS shown, tops.top IS NOT NULL AS under
    FROM p LEFT JOIN f ON f.role = p.role AND f.path = p.path LEFT JOIN v ON v.conv_id = p.conv_id AND v.path = p.path LEFT JOIN tops ON tops.role = p.role AND tops.top = split_part(p.path, '/', 1))
WHERE is_file OR (o AND (NOT k OR under))""")
def named_paths_of_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY TX30: a command made of each turn's words, against a tree of files for each role, with what the conversation showed."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(f"SELECT conv_id, turn, role AS tree, struct(conv_id, turn) AS id, {_COMMAND} AS command, {_PATH} AS path FROM ({_SPARK})")
    shown = attested_paths(spark.sql(f"SELECT conv_id, role, {_SHOWN} AS text FROM ({_SPARK})"))
    turns = rows.select("conv_id", "id")
    files = rows.select("tree", "path").distinct()
    got = named_paths(rows, files, shown.join(turns, "conv_id").select("id", "path"))
    return got.select("id.conv_id", "id.turn", "path", "status")
