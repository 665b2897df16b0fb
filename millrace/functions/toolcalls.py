"""Conversations with tool calls as plain turns: what a call does written as an agent would write it, one turn a call.

Turns are VARIANT values, so rows whose calls, results and arguments differ in shape go through the same
expressions. Everything is built in; a conversation's turns are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.replies import stripped
from millrace.functions.text import let

#: Tools by what they do, where a row's turns may stand, what stands for a finished task and a logged thought.
SHELLS = ("bash", "execute_bash", "run_bash_cmd", "shell")
EDITORS = ("str_replace_editor", "str_replace_based_edit_tool", "edit_file", "file_editor")
THINKERS, FINISHERS = ("think",), ("finish", "submit", "complete")
EDITS = ("create", "str_replace", "insert", "undo_edit", "write")
TURN_KEYS, NESTED_KEYS = ("messages", "turns", "conversation", "trajectory"), ("messages", "turns", "conversation")
FINISHED, LOGGED = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", "your thought has been logged"
DIALECT = ("returncode", "output", "output_head", "output_tail", "elided_chars", "warning", "exception_info")

#: Commands that change files: programs with the word that makes them do so, programs that write the path they are
#: given, and output sent to a file (not a number's or both streams, not an arrow) whose name begins here or with a letter.
WRITING_FORMS = (("sed", "-i"), ("git", "apply"), ("patch", "-p"), ("applypatch", ""))
WRITING_PROGRAMS = ("tee", "cp", "mv")
_WRITES = "|".join([
    *(rf"{a}\s+{b}" if b else a for a, b in WRITING_FORMS), rf"(?:{'|'.join(WRITING_PROGRAMS)})\s+[\w./-]",
    r"cat\s*>", r"(?:^|[^-\d&])>{1,2}\s*[\w.]",
])


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def said(value: Column, *keys: str) -> Column:
    """The first of some keys whose value is neither null, empty, zero nor false, as text; empty where none is."""
    found = []
    for k in keys:
        kind, text = F.schema_of_variant(_get(value, k)), _get(value, k, "string")
        number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        empty = (text == "") | (kind == "VOID") | (number & (_get(value, k, "double") == 0)) | ((kind != "STRING") & text.isin("[]", "{}", "false"))
        found.append(F.when(~empty, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)))
    return F.coalesce(*found, F.lit(""))


def as_variant(df: DataFrame, name: str) -> Column:
    """A column as a VARIANT, whether it holds JSON text, nested values or a VARIANT; null where the text isn't JSON."""
    kind = dict(df.dtypes)[name]
    return F.col(name) if kind == "variant" else F.try_parse_json(name) if kind == "string" else F.to_variant_object(name)


def turns_of(df: DataFrame) -> Column:
    """array<variant>: a row's turns, from the first of its columns `messages`, `turns`, `conversation`,
    `trajectory` that holds a list, or an object with one under such a key. Empty where none does."""
    lists = []
    for name in TURN_KEYS:
        if name in df.columns:
            v = as_variant(df, name)
            nested = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in NESTED_KEYS))
            lists += [F.try_variant_get(v, "$", "array<variant>"), nested]
    return F.coalesce(*lists, F.array().cast("array<variant>"))


def _object(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def arguments(call: Column) -> Column:
    """A call's arguments as a VARIANT object: an object, or JSON text of one, under `function` or beside it; an
    empty one for anything else."""
    own = F.coalesce(F.when(F.schema_of_variant(_get(call, "function.arguments")) != "VOID", _get(call, "function.arguments")), _get(call, "arguments"))
    read = F.when(F.schema_of_variant(own) == "STRING", F.try_parse_json(F.try_variant_get(own, "$", "string"))).otherwise(own)
    return F.coalesce(_object(read), F.parse_json(F.lit("{}")))


def tool_name(call: Column) -> Column:
    return F.coalesce(F.nullif(said(_get(call, "function"), "name"), F.lit("")), said(call, "name"))


def shell_block(command: Column) -> Column:
    return F.concat(F.lit("```bash\n"), stripped(command), F.lit("\n```"))


def changes_files(command: Column) -> Column:
    """Whether a shell command writes files."""
    return command.rlike(_WRITES)


def editor_text(args: Column) -> Column:
    """struct(text, edit): an editor's call as the command or the change that says the same."""
    command, path = stripped(said(args, "command")), stripped(said(args, "path", "file_path"))
    ends = _get(args, "view_range", "array<variant>")
    ranged = F.when(F.size(ends) == 2, F.concat(F.lit("sed -n '"), F.try_variant_get(ends[0], "$", "string"), F.lit(","), F.try_variant_get(ends[1], "$", "string"), F.lit("p' "), path, F.lit(" | cat -n")))
    line = F.coalesce(_get(args, "insert_line", "string"), F.lit("None"))
    texts = {
        ("view",): shell_block(F.coalesce(ranged, F.concat(F.lit("cat -n "), path))),
        ("create", "write"): shell_block(F.concat(F.lit("cat > "), path, F.lit(" <<'EOF'\n"), said(args, "file_text", "content"), F.lit("\nEOF"))),
        ("insert",): shell_block(F.concat(F.lit("sed -i '"), line, F.lit("a\\\n"), said(args, "new_str", "insert_line_text"), F.lit("' "), path)),
        ("str_replace",): F.concat(F.lit("Editing `"), path, F.lit("`:\n\n```\n<<<<<<< SEARCH\n"), said(args, "old_str"), F.lit("\n=======\n"), said(args, "new_str"), F.lit("\n>>>>>>> REPLACE\n```")),
        ("undo_edit",): shell_block(F.concat(F.lit("git checkout -- "), path)),
    }
    text = shell_block(stripped(F.concat(F.lit("# "), command, F.lit(" "), path)))
    for names, made in texts.items():
        text = F.when(command.isin(*names), made).otherwise(text)
    return F.struct(text.alias("text"), command.isin(*EDITS).alias("edit"))


def call_text(call: Column) -> Column:
    """struct(text, edit, kind) of a tool call. kind: think, done, action, or unknown with an empty text."""
    name = F.lower(tool_name(call))

    def of(args: Column) -> Column:
        command, edited = said(args, "command", "cmd"), editor_text(args)
        made = lambda text, edit, kind: F.struct(text.alias("text"), edit.alias("edit"), F.lit(kind).alias("kind"))
        return (
            F.when(name.isin(*THINKERS), made(said(args, "thought", "text"), F.lit(False), "think"))
            .when(name.isin(*FINISHERS), made(shell_block(F.lit(FINISHED)), F.lit(False), "done"))
            .when(name.isin(*SHELLS), made(shell_block(command), changes_files(command), "action"))
            .when(name.isin(*EDITORS), made(edited["text"], edited["edit"], "action"))
            .otherwise(made(F.lit(""), F.lit(False), "unknown"))
        )

    return let(arguments(call), of)


def json_observation(text: Column) -> Column:
    """A command's result that a harness reports as a JSON object, as tagged text; null for any other text."""
    keys = F.json_object_keys(text)

    def of(v: Column) -> Column:
        head = F.concat(F.lit("<returncode>"), F.coalesce(_get(v, "returncode", "string"), F.lit("None")), F.lit("</returncode>\n"))
        fault = said(v, "exception_info")
        head = F.concat(head, F.when(fault != "", F.concat(F.lit("<exception_info>"), fault, F.lit("</exception_info>\n"))).otherwise(""))
        cut = F.concat(
            F.lit("<warning>\n"), said(v, "warning"), F.lit("\n</warning><output_head>\n"), F.coalesce(_get(v, "output_head", "string"), F.lit("None")),
            F.lit("\n</output_head>\n<elided_chars>\n"), F.coalesce(_get(v, "elided_chars", "string"), F.lit("None")),
            F.lit(" characters elided\n</elided_chars>\n<output_tail>\n"), said(v, "output_tail"), F.lit("\n</output_tail>"))
        whole = F.concat(F.lit("<output>\n"), said(v, "output"), F.lit("</output>"))
        return F.concat(head, F.when(F.array_contains(keys, "output_head"), cut).otherwise(whole))

    fits = F.array_contains(keys, "returncode") & (F.size(F.array_except(keys, F.array(*map(F.lit, DIALECT)))) == 0)
    return F.when(F.coalesce(fits, F.lit(False)), let(F.try_parse_json(text), of))


def _heads(turns: Column) -> Column:
    """Places, from 1, of the turns that aren't results, before them 0 for results that come first."""
    return F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: turns[i - 1]["role"] != "tool"))


def rendered(turns: Column) -> Column:
    """struct(turns array<struct<role, content>>, first_edit): a conversation without tool calls.

    Every call becomes a turn of its own, followed by its own result, in order; results without a call follow.
    Thoughts (texts of turns without calls, think calls, a turn's own text) stand before the next call
    that is written. Calls of unknown tools go, their results stay. Results that are JSON of a harness become tagged
    text where the conversation's first result is such. first_edit: the number, from 1, of the first turn
    that changes files, 0 without one. An empty list gives an empty one; a turn that isn't an object goes.
    """

    def read(t: Column) -> Column:
        calls = F.coalesce(_get(t, "tool_calls", "array<variant>"), F.try_variant_get(F.try_parse_json(_get(t, "tool_calls", "string")), "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.struct(
            F.lower(said(t, "role")).alias("role"), stripped(said(t, "content", "reasoning_content", "think")).alias("thought"), stripped(said(t, "content")).alias("result"),
            F.transform(F.filter(calls, lambda c: F.schema_of_variant(c).startswith("OBJECT")), call_text).alias("calls"))

    def event(kind: str | Column, text: Column, edit: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), text.alias("text"), (F.lit(False) if edit is None else edit).alias("edit"))

    def segment(turns: Column, head: Column, following: Column) -> Column:
        """The events of a turn and the results behind it."""
        turn, results = F.get(turns, head - 1), F.transform(F.slice(turns, head + 1, following - head - 1), lambda t: event("result", t["result"]))
        calls = F.coalesce(turn["calls"], F.array().cast("array<struct<text: string, edit: boolean, kind: string>>"))
        written = lambda c: ((c["kind"] == "think") | ((c["kind"] != "unknown") & (c["text"] != "")))
        own = F.when(F.exists(calls, written), F.array(event("thought", turn["thought"]))).otherwise(F.array().cast("array<struct<kind: string, text: string, edit: boolean>>"))

        def of_call(c: Column, k: Column) -> Column:
            made = F.when(c["kind"] == "think", F.array(event("thought", c["text"]))).otherwise(
                F.concat(F.when(written(c), F.array(event("assistant", c["text"], c["edit"]))).otherwise(F.slice(results, 1, 0)), F.slice(results, k + 1, 1)))
            return made

        called = F.concat(own, F.flatten(F.transform(calls, of_call)), F.slice(results, F.size(calls) + 1, F.greatest(F.size(results), F.lit(1))))
        plain = F.concat(F.array(event(F.when(turn["role"] == "assistant", "thought").otherwise(turn["role"]), turn["thought"])), results)
        return F.when((turn["role"] == "assistant") & (F.size(calls) > 0), called).when(turn["role"].isin("system", "user", "assistant"), plain).otherwise(results)

    def folded(events: Column) -> Column:
        places = F.array_compact(F.transform(events, lambda e, i: F.when(e["kind"] == "assistant", i + 1)))

        def with_thoughts(e: Column, i: Column) -> Column:
            before = F.coalesce(F.array_max(F.filter(places, lambda p: p <= i)), F.lit(0))
            thoughts = F.filter(F.slice(events, before + 1, i - before), lambda x: x["kind"] == "thought")
            text = F.array_join(F.transform(thoughts, lambda x: x["text"]), "\n\n")
            return F.when((e["kind"] == "assistant") & (text != ""), F.struct(e["kind"].alias("role"), F.concat(F.lit("THOUGHT: "), text, F.lit("\n\n"), e["text"]).alias("content"))).otherwise(
                F.struct(F.when(e["kind"] == "result", "user").otherwise(e["kind"]).alias("role"), e["text"].alias("content")))

        out = F.filter(F.transform(events, with_thoughts), lambda x: x["role"] != "thought")
        edits = F.transform(F.filter(events, lambda e: e["kind"] == "assistant"), lambda e: e["edit"])
        return F.struct(out.alias("turns"), F.array_position(edits, F.lit(True)).alias("first_edit"))

    def of(read_turns: Column) -> Column:
        first = F.filter(read_turns, lambda t: (t["role"] == "tool") & (t["result"] != ""))
        told = F.coalesce(json_observation(F.get(first, F.lit(0))["result"]).isNotNull(), F.lit(False))

        def observed(t: Column) -> Column:
            return t.withField("result", F.when(told & (t["role"] == "tool"), F.coalesce(json_observation(t["result"]), t["result"])).otherwise(t["result"]))

        def events(turns: Column) -> Column:
            heads = _heads(turns)
            return let(heads, lambda h: F.flatten(F.transform(h, lambda head, k: segment(turns, head, F.coalesce(F.get(h, k + 1), F.size(turns) + 1)))))

        made = let(F.transform(read_turns, observed), events)
        kept = F.filter(made, lambda e: (e["text"] != "") & ~((e["kind"] == "result") & F.lower(e["text"]).contains(LOGGED)))
        return let(kept, folded)

    objects = F.filter(turns, lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    return F.when(F.size(objects) > 0, let(F.transform(objects, read), of)).otherwise(
        F.struct(F.array().cast("array<struct<role: string, content: string>>").alias("turns"), F.lit(0).cast("bigint").alias("first_edit")))


def turn_text(turn: Column) -> Column:
    """A turn's text with its calls behind it, set apart by empty lines: a shell call as a block, one that says something
    (thought, message, answer, summary) as that, any other as its name with its plain arguments in the order of their
    names. A turn that is no object is its own text, null an empty one."""

    def quoted(v: Column, kind: Column) -> Column:
        escaped = F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        double = escaped.contains("'") & ~escaped.contains('"')
        text = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.initcap(v)).otherwise(v)

    def of(call: Column) -> Column:
        function = F.coalesce(_object(_get(call, "function")), call)
        name = stripped(F.coalesce(_get(function, "name", "string"), F.lit("")))

        def told(args: Column) -> Column:
            command = F.when(name.isin(*SHELLS), stripped(_plain(args, "command")))
            spoken = F.coalesce(*(F.nullif(stripped(_plain(args, k)), F.lit("")) for k in ("thought", "message", "answer", "summary")))
            each = F.transform(F.array_sort(F.map_keys(F.try_variant_get(args, "$", "map<string, variant>"))), lambda k: F.struct(k.alias("k"), F.try_variant_get(args, "$", "map<string, variant>")[k].alias("v")))
            kind = lambda e: F.schema_of_variant(e["v"])
            shown = F.filter(each, lambda e: ~(kind(e).startswith("OBJECT") | kind(e).startswith("ARRAY") | (kind(e) == "VOID")) & (stripped(F.try_variant_get(e["v"], "$", "string")) != ""))
            detail = F.array_join(F.transform(shown, lambda e: F.concat(e["k"], F.lit("="), quoted(F.try_variant_get(e["v"], "$", "string"), kind(e)))), " ")
            listed = F.concat(F.lit("["), name, F.when(detail == "", "").otherwise(F.concat(F.lit(" "), detail)), F.lit("]"))
            return F.coalesce(F.when(command != "", shell_block(command)), spoken, F.when(name == "", "").otherwise(listed))

        return let(arguments(F.coalesce(_object(call), F.parse_json(F.lit("{}")))), told)

    body = F.coalesce(*(F.when(F.schema_of_variant(_get(turn, k)) != "VOID", _get(turn, k, "string")) for k in ("content", "text", "value", "message")), F.lit(""))
    calls = F.coalesce(_get(turn, "tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    made = F.filter(F.transform(calls, of), lambda x: x != "")
    whole = F.when(F.size(made) > 0, F.array_join(F.filter(F.concat(F.array(stripped(body)), made), lambda x: x != ""), "\n\n")).otherwise(body)
    return F.coalesce(F.when(F.schema_of_variant(turn).startswith("OBJECT"), whole), F.try_variant_get(turn, "$", "string"), F.lit(""))


def _plain(args: Column, key: str) -> Column:
    """The text under a key; null where it is none."""
    return F.when(F.schema_of_variant(_get(args, key)) == "STRING", _get(args, key, "string"))
