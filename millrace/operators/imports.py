"""Files that Python code imports, and those they import in turn, as joins with a listing of files."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.plans.registry import query
from millrace.session import table

ROOTS = ("", "src")
#: Rows of one key that are joined with a list in one task.
PART = 1000


def module_names(code: str) -> list[str]:
    """Modules that code imports by their full names, names taken from a module tried as modules of it; none of code
    that can't be read, and none of relative imports."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            nodes = list(ast.walk(ast.parse(code)))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []

    def named() -> Iterator[str]:
        for n in nodes:
            if isinstance(n, ast.Import):
                yield from (a.name for a in n.names)
            elif isinstance(n, ast.ImportFrom) and n.module and n.level == 0:
                yield from (n.module, *(f"{n.module}.{a.name}" for a in n.names))

    return list(dict.fromkeys(named()))


def _names(code):
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: module_names(x) if x else [])

    return run(code)


def _dealt(rows: DataFrame, lists: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with lists, which has one row of each key. A key of more than PART rows is dealt, by the column `by`, to
    as many parts as it takes, so that no task makes what all its rows are joined with."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PART).select(key, F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = rows.join(many, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), "parts").cast("int"), F.lit(0))).drop("parts")
    each = lists.join(many, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(each.hint("merge"), [key, "part"]).drop("part")  # not broadcast: Spark sizes it as if it were not exploded


def imported_files(sources: DataFrame, files: DataFrame, levels: int = 2) -> DataFrame:
    """(id, path, level): files of a source's tree that its code imports, and those that they import, `levels` deep, each with
    the first level that reaches it (SURVEY XA62).

    sources: (id, tree, code, folder); files: (tree, path, text). A module is looked for from the root, from `src` and
    from the importing file's folder, as a file or a package. A file that imports itself, or one found before, is
    followed once. Names become files once for each source and each path, whose texts count together; what lies
    deeper is found once for all sources that start from the same files, and only the result has rows for each of them.
    """

    def node(path) -> Column:
        """A file as one string; the hexadecimal tree holds no slash."""
        return F.concat(F.hex(F.col("tree").cast("string")), F.lit("/"), path)

    def paths(nodes) -> Column:
        return F.array_distinct(F.transform(nodes, lambda n: F.substr(n, F.instr(n, F.lit("/")) + 1)))

    known = files.select(node("path").alias("node")).distinct()

    def found(names: DataFrame, key: str) -> DataFrame:
        """names (key, tree, folder, name) as (key, node), the files of the tree that they stand for."""
        base = F.replace("name", F.lit("."), F.lit("/"))
        roots = F.array(*(F.lit(r) for r in ROOTS), "folder")
        ways = F.flatten(F.transform(roots, lambda r: F.array(*(F.concat(F.when(r == "", "").otherwise(F.concat(r, F.lit("/"))), base, F.lit(end)) for end in (".py", "/__init__.py")))))
        return names.select(key, "tree", F.explode(F.array_distinct(ways)).alias("path")).select(key, node("path").alias("node")).join(known, "node").select(key, "node").distinct()

    folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*\z", 1)
    graph = found(files.select(node("path").alias("at"), "tree", folder.alias("folder"), F.explode(_names("text")).alias("name")).distinct(), "at")
    graph = graph.groupBy("at").agg(F.collect_list("node").alias("nodes"))
    names = sources.select("id", "tree", F.coalesce("folder", F.lit("")).alias("folder"), F.explode(_names("code")).alias("name"))
    own = found(names, "id").groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("start"))
    reached = own.select("start").distinct().select("start", F.col("start").alias("now"), F.col("start").alias("all"), F.transform(paths("start"), lambda p: F.struct(p.alias("path"), F.lit(1).alias("level"))).alias("found"))
    for level in range(2, levels + 1):
        next_ = _dealt(reached.select("start", F.explode("now").alias("at")), graph, "at", "start").groupBy("start").agg(F.flatten(F.collect_list("nodes")).alias("next"))
        reached = reached.join(next_, "start", "left").withColumn("now", F.array_except(F.coalesce("next", F.array().cast("array<string>")), "all"))
        fresh = F.transform(F.array_except(paths("now"), F.transform("found", lambda f: f["path"])), lambda p: F.struct(p.alias("path"), F.lit(level).alias("level")))
        reached = reached.select("start", "now", F.concat("all", "now").alias("all"), F.concat("found", fresh).alias("found"))
    return _dealt(own, reached.select("start", "found"), "start", "id").select("id", F.explode("found").alias("f")).select("id", "f.path", "f.level")


_CODE = """
SELECT doc_id AS id, lang AS tree, {first} AS path, 'import ' || w[{a}] || ', ' || w[{b}] || '.' || w[{c}] || chr(10) || 'from ' || w[{d}] || ' import ' || w[{e}] || ' as q' || chr(10) || 'from . import ' || w[{c}] AS code
FROM (SELECT doc_id, lang, length(text) AS n, {slice}({concat}(regexp_extract_all(lower(text), '([a-z]+)', 1), {pad}), 1, 6) AS w FROM documents WHERE text IS NOT NULL)"""
_WHERE = "CASE n % 3 WHEN 0 THEN 'src/' WHEN 1 THEN w[{b}] || '/' ELSE '' END || w[{a}] || CASE WHEN n % 5 = 0 THEN '/__init__.py' ELSE '.py' END"
_PAD = "'a', 'b', 'c', 'd', 'e', 'f'"


@query(f"""
WITH s AS ({_CODE.format(first=_WHERE.format(a=1, b=2), a=3, b=1, c=2, d=4, e=1, slice='list_slice', concat='list_concat', pad=f'[{_PAD}]')}),
f AS (SELECT tree, path, code, regexp_replace(CASE WHEN contains(path, '/') THEN path ELSE '/' END, '/[^/]*$', '') AS folder FROM s),
n AS (SELECT tree, path, folder, unnest([regexp_extract(code, 'import (\\w+),', 1), regexp_extract(code, ', (\\w+\\.\\w+)', 1), regexp_extract(code, 'from (\\w+) ', 1), regexp_extract(code, 'from (\\w+) ', 1) || '.' || regexp_extract(code, 'import (\\w+) as', 1)]) AS name,
    code FROM f WHERE NOT regexp_matches(code, '\\b(?:as|in|is|if|or|and|not|for|def|del|try|from|with|else|elif|pass|import|class|global|while|yield|raise|return|except|lambda|assert|async|await|break|continue|finally|nonlocal)\\b(?: import\\b|,|\\.| as\\b|$|\\n)')),
c AS (SELECT DISTINCT tree, path, code, r || replace(name, '.', '/') || e AS target
    FROM (SELECT *, unnest(['', 'src/', CASE WHEN folder = '' THEN '' ELSE folder || '/' END]) AS r FROM n), (SELECT unnest(['.py', '/__init__.py']) AS e)),
g AS (SELECT DISTINCT c.tree, c.path, c.code, c.target FROM c JOIN (SELECT DISTINCT tree, path FROM s) k ON k.tree = c.tree AND k.path = c.target)
SELECT id, path, CAST(min(level) AS int) AS level FROM (
    SELECT s.id, g.target AS path, 1 AS level FROM s JOIN g ON g.tree = s.tree AND g.path = s.path AND g.code = s.code
    UNION ALL SELECT s.id, h.target, 2 FROM s JOIN g ON g.tree = s.tree AND g.path = s.path AND g.code = s.code JOIN g h ON h.tree = g.tree AND h.path = g.target) GROUP BY ALL""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA62: documents as files of code in a tree of each language, named and filled with their own words; several
    documents may give one path its texts. Words of the language are no names, and such code can't be read."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    rows = spark.sql(_CODE.format(first=_WHERE.format(a=0, b=1), a=2, b=0, c=1, d=3, e=0, slice="slice", concat="concat", pad=f"array({_PAD})"))
    folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*\z", 1)
    return imported_files(rows.select("id", "tree", "code", folder.alias("folder")), rows.select("tree", "path", F.col("code").alias("text")))
