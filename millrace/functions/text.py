"""Column builders for text: normalisation, shingles, identifiers, quality checks.

Everything here is a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's variable stands for it."""
    return F.transform(F.array(value), use)[0]


def norm_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "_interface$", "")


def repo_slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "__", "/"), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def pr_key(repo: Column, number: Column) -> Column:
    return F.concat(repo_slug(repo), F.lit("#"), number.cast("bigint").cast("string"))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; accented letters split a word."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def norm_text(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of k words; an empty array for fewer words."""


    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


#: Fixed patterns of task identifiers.
SMITH = r"^(.+?)__(.+?)\.[0-9a-f]{7,8}\.(.+)$"
SWE = r"^(.+?)__(.+)-(\d+)(?:_[a-z]+)?$"
AACR = r"^(.+)-pr-(\d+)(?:-[0-9a-f]+)?(?:__\w+)?$"
PR_URL = r"github\.com/([^/]+/[^/]+)/pull/(\d+)"


def parse_id(c: Column) -> Column:
    """struct(repo, number) of an identifier in one of three grammars; null if none fits."""
    iid = F.trim(c)

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(iid, pattern, i)

    tail = part(SMITH, 3)
    smith = F.when(tail.rlike(r"^pr_\d+$"), F.struct(F.concat_ws("/", part(SMITH, 1), part(SMITH, 2)).alias("repo"), F.regexp_extract(tail, r"\d+", 0).try_cast("bigint").alias("number")))
    swe = F.struct(F.concat_ws("/", part(SWE, 1), part(SWE, 2)).alias("repo"), part(SWE, 3).try_cast("bigint").alias("number"))
    aacr = F.when(~part(AACR, 1).contains("__"), F.struct(part(AACR, 1).alias("repo"), part(AACR, 2).try_cast("bigint").alias("number")))
    return F.when(iid.rlike(SMITH), smith).when(iid.rlike(SWE), swe).when(iid.rlike(AACR), aacr)


def family(c: Column) -> Column:
    """Kind of a generated task, by the tail of its identifier."""
    tail = F.element_at(F.split(c, r"\."), -1)
    return F.when(tail.startswith("pr_"), "pr").when(tail.startswith("lm_"), "lm").when(tail.startswith("combine"), "combine").otherwise("mechanical")


def python_words(c: Column) -> Column:
    """What Python's str.split() gives."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def trigram_diversity(words: Column) -> Column:
    n = F.size(words) - 2
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), "\u0001"))
    return F.when(n >= 1, F.size(F.array_distinct(each)) / n)


def quality_reason(c: Column) -> Column:
    """First failing text check in fixed order, null if all pass."""
    high = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))

    def later(words: Column) -> Column:
        low = F.transform(words, F.lower)
        return (
            F.when(F.size(words) < 5, "short")
            .when(trigram_diversity(words) < 0.15, "repetitive")
            .when((F.length(c) > 20) & (high / F.length(c) > 0.6), "encoding")
            .when((F.size(words) >= 8) & (F.size(F.array_distinct(low)) / F.size(words) < 0.3), "vocabulary")
        )

    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*\z"), "empty").otherwise(let(python_words(c), later))


def blob_sha1(c: Column) -> Column:
    """Object id that version control gives a file with this content."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(c).cast("string").cast("binary"), F.lit("\u0000").cast("binary"), c.cast("binary")))


#: What five verdict letters are worth; the letters between them lie on straight lines.
LETTER_ANCHORS = {"A": 0.0, "E": 0.15, "J": 0.35, "O": 0.70, "T": 1.0}


def letter_value(c: Column) -> Column:
    """What a verdict letter A..T is worth, to six places; null for anything else."""
    letter = F.upper(F.trim(c))
    at, value, ends = F.ascii(letter), None, list(LETTER_ANCHORS.items())
    for (a, low), (b, high) in zip(ends, ends[1:], strict=False):
        here = F.round(F.lit(low) + (at - ord(a)) * F.lit((high - low) / (ord(b) - ord(a))), 6)
        reached = (F.length(letter) == 1) & at.between(ord(a), ord(b))
        value = F.when(reached, here) if value is None else value.when(reached, here)
    return value


def concise_fault(c: Column) -> Column:
    """The last line that names an error, else the last line, 300 characters of it."""
    lines = F.filter(F.split(F.trim(c), "\n"), lambda x: F.trim(x) != "")
    named = F.filter(lines, lambda x: x.rlike(r"^\w*(Error|Exception)\b"))
    return F.substring(F.trim(F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(lines, F.lit(-1)))), 1, 300)


def edited_paths(c: Column) -> Column:
    """Files that a command edits in place or writes by redirection."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:sed\s+-i\S*\s+\S+\s+|>>?\s*)([\w./-]+)"), F.lit(1)))


def span_key(c: Column) -> Column:
    """Spans compared without line numbers, smart quotes and runs of white space."""
    plain = F.translate(c, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?m)^\s*\d+[:|\t]\s?", ""), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
