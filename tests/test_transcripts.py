from __future__ import annotations

from millrace.functions import transcripts as X


def test_chains():
    assert X.command_chain("cd a && ls; echo 'x; y' || true\npwd") == ["cd a", "ls", "echo 'x; y'", "true", "pwd"]
    script = "cat <<'EOF' > f\na; b\nEOF\necho done"
    assert X.command_chain(script) == ["cat <<'EOF' > f\na; b\nEOF", "echo done"]
    assert X.heredocs(script) == [("EOF", "a; b")]


def test_replies():
    assert X.without_reasoning("<think>a</think>b ```<think>c</think>```") == "b ```<think>c</think>```"
    assert X.canonical_hash({"b": 1, "a": 2}) == X.canonical_hash({"a": 2, "b": 1})


def test_periods_and_runs():
    assert X.tail_period("x" + "abc" * 300) == 3 and X.tail_period("short") == 0
    assert X.collapsed_lines("\n".join(["a"] * 30 + ["b"])) == "a\n[29 equal lines]\nb"
    assert X.trailing_repeats(["a", "b", "b"]) == 2 and X.trailing_repeats([]) == 0


def test_diffs():
    old, new = "a\nb\nc\nd\n", "a\nB\nc\nd\ne\n"
    patch = X.diff(old, new, "f.txt")
    parts = X.hunks(patch)
    assert parts[0]["path"] == "f.txt" and X.patch_faults(patch) == []
    assert X.applied(old, parts) == new and X.applied("zzz", parts) is None
    assert X.patch_faults(patch.replace("@@ -1,4", "@@ -1,9"))


def test_sed():
    assert X.sed("2s/b/X&X/", "a\nbb\n") == "a\nXbXb\n"
    assert X.sed("s/b/y/g", "abb\nb") == "ayy\ny"
    assert X.sed("1,2d", "a\nb\nc\n") == "c\n"
    assert X.sed("$a end", "a\n") == "a\nend\n"
    assert X.sed("y/a/b/", "a") is None


def test_replay_and_status():
    got = X.replayed({"a": "1\n", "d/x": "2"}, ["echo hi > b && mv a c", "rm -r d; touch e", "cat <<EOF >> b\nmore\nEOF", "sed -i 's/1/9/' c", "make > f"])
    assert got == {"b": "hi\nmore\n", "c": "9\n", "e": "", "f": None}
    unsure = X.replayed({"a": "1", "b": "2"}, ["test -f zz && rm a", "false && echo hi > q", "true || rm b", "make || echo no > r"])
    assert unsure == {"a": None, "b": "2", "r": None}
    assert X.tree_status({"a": "1", "b": "1"}, {"a": "2", "b": "1"}, {"a": "2", "b": "3", "n": "0"}) == {"a": "M ", "b": " M", "n": "??"}
    assert X.ignored("build/x.o", ["*.o"]) and not X.ignored("keep.o", ["*.o", "!keep.o"])
