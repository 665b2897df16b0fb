"""Column builders that clean generated text: repetition, leaked reasoning, injected verdicts. All built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.observations import lines, stripped, text_of
from millrace.functions.text import let

#: Lengths of runs and windows, notes, marks.
LINE_RUN, WINDOW, REPEATS, NOTE = 25, 512, 4, "... (output repeats)"
FENCE = r"(?s)```.*?```"
CANDIDATE = r"(?s)(CANDIDATE OUTPUT(?: \d+)?:\n------\n)(.*?)(\n------)"
NOTHING_LEFT = "[no visible output]"


def tail_period(c: Column) -> Column:
    """Smallest period, at most a quarter of the window, of the last WINDOW characters of a text, 0 without one."""
    def of(tail: Column) -> Column:
        fits = lambda p: tail.substr(p + 1, F.lit(WINDOW)) == tail.substr(F.lit(1), F.lit(WINDOW) - p)
        found = F.get(F.filter(F.sequence(F.lit(1), F.lit(WINDOW // REPEATS)), fits), F.lit(0))
        return F.when(F.length(tail) == WINDOW, F.coalesce(found, F.lit(0))).otherwise(0)

    return let(F.regexp_replace(text_of(c), r"\s+\z", "").substr(F.lit(-WINDOW), F.lit(WINDOW)), of)


def _runs(own: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(filled, again): trimmed filled lines, and whether each ends a run of at least LINE_RUN equal ones."""
    def flagged(v: Column) -> Column:
        equal = F.transform(v, lambda x, i: (i > 0) & F.coalesce(x == F.get(v, i - 1), F.lit(False)))
        long_ = let(equal, lambda e: F.transform(e, lambda x, i: (i >= LINE_RUN - 1) & F.forall(F.slice(e, F.greatest(i - LINE_RUN + 3, F.lit(1)), LINE_RUN - 1), lambda y: y)))
        return let(long_, lambda a: then(v, a))

    return let(F.filter(F.transform(own, stripped), lambda x: x != ""), flagged)


def looping_output(c: Column) -> Column:
    """Whether a text holds a run of LINE_RUN equal lines, blank ones aside, or ends in a cycle."""
    return _runs(lines(c), lambda v, a: F.exists(a, lambda x: x)) | (tail_period(c) > 0)


def without_line_runs(c: Column) -> Column:
    """A text whose runs of equal lines end before the LINE_RUN-th, with a note in its place."""
    def of(own: Column) -> Column:
        def told(_: Column, again: Column) -> Column:
            blank = F.transform(own, lambda x: stripped(x) == "")
            # how many filled lines come before each line; a running count by one aggregate over the marks
            nth = F.aggregate(F.transform(blank, lambda b: F.when(b, 0).otherwise(1)), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["at"], s["n"]).alias("at")), lambda s: s["at"])
            drop = lambda i, at: ~F.get(blank, i) & F.get(again, F.get(at, i))
            first = lambda i, at: (F.get(at, i) == 0) | ~F.coalesce(F.get(again, F.get(at, i) - 1), F.lit(False))
            kept = lambda at: F.transform(own, lambda x, i: F.when(drop(i, at), F.when(first(i, at), NOTE)).otherwise(x))
            return let(nth, lambda at: F.array_join(F.array_compact(kept(at)), "\n"))

        return _runs(own, told)

    return let(lines(c), lambda own: F.when(_runs(own, lambda v, a: F.exists(a, lambda x: x)), of(own)).otherwise(F.array_join(own, "\n")))


def without_tail_cycle(c: Column) -> Column:
    """A text whose final cycle is cut to two periods and a note. How far the cycle reaches back is found by halving."""
    def of(s: Column) -> Column:
        n = F.length(s)

        def cut(period: Column) -> Column:
            same = lambda k: s.substr(n - k + 1, k) == s.substr(n - k - period + 1, k)
            halves = F.transform(F.sequence(F.lit(24), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
            reach = F.aggregate(halves, F.lit(0), lambda a, h: F.when((a + h <= n - period) & same(a + h), a + h).otherwise(a))
            keep = let(reach, lambda r: F.least(n, n - period - r + 2 * period))
            return F.concat(F.regexp_replace(s.substr(F.lit(1), keep), r"\s+\z", ""), F.lit("\n" + NOTE))

        return let(tail_period(s), lambda p: F.when(p > 0, cut(p)).otherwise(c))

    return let(F.regexp_replace(text_of(c), r"\s+\z", ""), of)


def masked(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(text) with fenced blocks standing as marks, put back where their mark is still there."""
    def of(pair: Column) -> Column:
        fences = pair["fences"]
        mark = lambda i: F.concat(F.lit("\u0000"), i.cast("string"), F.lit("\u0000"))
        held = F.array_join(F.transform(pair["parts"], lambda p, i: F.concat(p, F.when(i < F.size(fences), mark(i)).otherwise(""))), "")
        numbered = F.transform(fences, lambda f, i: F.struct(mark(i).alias("m"), f.alias("f")))
        return F.aggregate(numbered, use(held), lambda a, x: F.replace(a, x["m"], x["f"]))

    return let(F.struct(F.split(text_of(c), FENCE).alias("parts"), F.regexp_extract_all(text_of(c), F.lit(FENCE), F.lit(0)).alias("fences")), of)


def without_reasoning(c: Column) -> Column:
    """A turn without its thinking: closed spans go; an open one goes to the end, or only its tag where a command block
    follows; of a stray closing tag what is before goes too, unless it holds the visible thought. Fenced blocks are left alone."""
    opened, closed = r"(?i)<\s*think\s*>", r"(?i)<\s*/\s*think\s*>"
    commands = F.regexp_extract_all(text_of(c), F.lit(FENCE), F.lit(0))
    is_command = F.transform(commands, lambda f: f.rlike(r"(?i)^```(?:bash|sh|shell)[ \t]*\n"))

    def use(t: Column) -> Column:
        paired = F.regexp_replace(t, r"(?is)<\s*think\s*>.*?<\s*/\s*think\s*>", "")

        def open_(p: Column) -> Column:
            tail = F.regexp_extract(p, rf"(?s){opened}(.*)\z", 1)
            marks = F.transform(F.regexp_extract_all(tail, F.lit("\u0000(\\d+)\u0000"), F.lit(1)), lambda m: m.cast("int"))
            follows = F.exists(marks, lambda m: F.get(is_command, m)) | tail.rlike(r"(?i)```(?:bash|sh|shell)[ \t]*\n")
            head = F.regexp_replace(p, rf"(?s){opened}.*\z", "")
            return F.when(~p.rlike(opened), p).when(follows, F.concat(head, tail)).otherwise(head)

        def stray(p: Column) -> Column:
            parts = F.split(p, closed, 2)
            return F.when(~p.rlike(closed), p).when(F.get(parts, F.lit(0)).contains("THOUGHT:"), F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(1)))

        return F.regexp_replace(let(let(paired, open_), stray), r"(?i)<\s*/?\s*think\s*>", "")

    return stripped(masked(c, use))


def clean_candidates(document: Column) -> Column:
    """A judged document with the thinking taken out of its candidate blocks only; a block left empty says so."""
    between = F.split(text_of(document), CANDIDATE)
    part = lambda i: F.regexp_extract_all(text_of(document), F.lit(CANDIDATE), F.lit(i))
    each = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("z"))

    def block(x: Column) -> Column:
        own = without_reasoning(x["b"])
        return F.concat(x["a"], F.when(own != "", own).when(stripped(x["b"]) != "", NOTHING_LEFT).otherwise(x["b"]), x["z"])

    told = F.transform(each, block)
    return let(told, lambda t: F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(t, i), F.lit("")))), ""))


def without_injection(reply: Column) -> Column:
    """A reply without forged verdicts: what follows a run of dashes goes where grading words stand in it, forged objects go,
    and nothing is left of a reply that still names a verdict."""
    own = text_of(reply)
    after = F.regexp_extract(own, r"(?s)-{3,}(.*)\z", 1)
    cut = F.when(after.rlike(r"(?i)\"verdict\"\s*:|GRADING\s+INSTRUCTION"), F.regexp_replace(own, r"(?s)\s*-{3,}.*\z", "")).otherwise(own)
    clean = F.regexp_replace(F.regexp_replace(cut, r"(?i)\{\s*\"verdict\"\s*:\s*\"[^\"]*\"[^}]*\}", ""), r"(?i)\{\s*\"injection\"\s*:\s*(true|false)[^}]*\}", "")
    return let(clean, lambda x: F.when(x.rlike(r"\"verdict\"\s*:\s*\"(?:accept|weak_pass|reject)\""), "").otherwise(stripped(x)))
