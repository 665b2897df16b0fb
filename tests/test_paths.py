"""Paths that commands name and transcripts show, against loops over whole listings."""

from __future__ import annotations

import random

import pytest

from millrace.operators import paths as P


def test_checkout_path():
    inside = {"a/b.py": "a/b.py", "./a//b/": "a/b", "a/../b": "b", "/testbed/x/y.py": "x/y.py", "/testbed": "", "/workspace/o__r__1.0/src/g.py": "src/g.py", "/tmp/../testbed/z": "z", "": ""}
    assert {w: P.checkout_path(w) for w in inside} == inside
    assert [P.checkout_path(w) for w in ("../a", "a/../../b", "/tmp/a", "/testbeds/a", "/usr/lib/python3/a.py", "/")] == [None] * 6


@pytest.mark.parametrize(
    ("command", "data"),
    [
        ("sed -i -e 's/a/b/' -e 's/c/d/' src/x.py", ["s/a/b/", "s/c/d/"]),
        ("sed -n '1,5p' x.py | grep -v \"a b\" && awk '/x.y/' z", ["1,5p", "a b", "/x.y/"]),
        ("X=1 python3.11 -c 'import a.b' q.py > out.txt", ["import a.b"]),
        ("cat > a.py <<'EOF'\nopen('b.py')\nEOF\ngrep x.y c.py", ["open('b.py')", "x.y"]),
        ("cat <<A\nleft open", ["left open"]),
        ("grep 'left open", []),
        ("", []),
    ],
)
def test_data_of(command, data):
    assert P.data_of(command) == data


COMMANDS = {
    "cat > /tmp/r.py <<'EOF'\nimport datetime as dt\nprint(dt.datetime.now())\nEOF": {},
    "cat > /tmp/r.py <<'EOF'\ncontent = open('src/docx/run.py').read()\nEOF": {"src/docx/run.py": "present"},
    "sed -i 's/a/b/' nope/gone.py": {"nope/gone.py": "missing"},
    "sed -i '112s/self.font.bold = True/self.font.bold = None/' src/docx/run.py": {"src/docx/run.py": "present"},
    "python3 -c 'from src.docx import run; print(run)'": {},
    "python3 -c \"open('README.md')\"": {"README.md": "present"},
    "grep -rn src.docx src": {},
    "cat /usr/lib/python3.11/site-packages/docx/run.py": {},
    "cat /workspace/o__r__1.0/src/docx/gone.py": {"src/docx/gone.py": "missing"},
    "cp README.md copy.md && tee -a log.txt && mkdir -p src/new.d": {"README.md": "present"},
    "cat src/nofile other/nofile .hidden /testbed/plain run_tests.sh": {"src/nofile": "missing", ".hidden": "missing", "plain": "missing", "run_tests.sh": "vouched"},
    "ls src src/docx/ . .. *.py $HOME/a.py http://x/a.py A=b.py": {},
    "cat README.md ./README.md /testbed/README.md 2> err.txt": {"README.md": "present"},
}


def test_commands(spark):
    files = spark.createDataFrame([("t", "src/docx/run.py"), ("t", "README.md"), ("u", "nope/gone.py"), ("t", "README.md")], "tree string, path string")
    rows = [(i, "t", c) for i, c in enumerate(COMMANDS)] + [(90, "t", None), (91, "none", "cat README.md"), (92, None, "cat README.md")]
    commands = spark.createDataFrame(rows, "id int, tree string, command string")
    seen = spark.createDataFrame([(i, "/testbed/run_tests.sh") for i in range(len(COMMANDS))] + [(91, "/tmp/README.md"), (92, "/testbed")], "id int, path string")
    got = {}
    for r in P.named_paths(commands, files, seen).collect():
        got.setdefault(r.id, {})[r.path] = r.status
    want = {i: w for i, w in enumerate(COMMANDS.values()) if w}
    assert got == want | {91: {"README.md": "missing"}, 92: {"README.md": "missing"}}
    assert {r.status for r in P.named_paths(commands, files).collect()} == {"present", "missing"}
    assert P.named_paths(commands.limit(0), files).count() == 0 and P.named_paths(commands, files.limit(0), seen).where("status = 'present'").count() == 0


def test_ten_thousand_paths_against_a_scan(spark):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    some = lambda: "/".join(part() for _ in range(rng.randint(1, 5))) + rng.choice((".py", ".md", ""))
    trees = {t: {p for p in (some() for _ in range(10_000))} for t in "xy"}
    trees = {t: {p for p in own if not any(q in own for q in (p.rpartition("/")[0], "/".join(p.split("/")[:1]))) or "/" not in p} for t, own in trees.items()}
    flat = sorted(trees["x"])
    word = lambda: rng.choice((rng.choice(flat), some(), some().rpartition("/")[0] + "/", "/testbed/" + some()))
    rows = [(i, rng.choice("xy"), f"{rng.choice(('cat', 'ls', 'cp', 'touch'))} " + " ".join(word() for _ in range(rng.randint(1, 6)))) for i in range(300)]
    got = {(r.id, r.path): (r.place, r.status) for r in P.named_paths(spark.createDataFrame(rows, "id int, tree string, command string"), spark.createDataFrame([(t, p) for t, own in trees.items() for p in own], "tree string, path string")).collect()}
    want = {}
    for i, t, command in rows:
        own, first = trees[t], {}
        for place, (path, may, known) in enumerate(P.words_of(command)):
            place, *was = first.get(path, (place, False, True))
            first[path] = (place, was[0] or may, was[1] and known)
        for path, (place, may, known) in first.items():
            if path in own:
                want[i, path] = (place, "present")
            elif may and not any(p.startswith(path + "/") for p in own) and (not known or any(p.startswith(path.split("/")[0] + "/") for p in own)):
                want[i, path] = (place, "missing")
    assert got == want and len({s for _, s in got.values()}) == 2


def test_attested_paths(spark):
    view = "Here's the result of running `cat -n` on "
    turns = [
        (1, "tool", "x\nFile created successfully at: /testbed/a.py \nFile created successfully at:\n b.py"),
        (1, "assistant", "File created successfully at: no.py"),
        (1, "user", view + "`/testbed/v.py`:\n\n\n  1 text\n" + view + "gone.py:\n\ncat: No such file or directory\n" + view + "last.py:"),
        (2, None, "Here's the files and directories up to 2 levels deep in /w, without hidden:\n/w/\n  /w/a b\n/w/no"),
        (2, "USER", "Here's the files and directories up to 1 level deep in /w:\n/w/d/\n    /w/d/e.py  \n\n/w/no\nFile created successfully at: /w/d/e.py"),
        (3, "user", None),
        (3, "user", ""),
        (4, "user", "Here's the files and directories up to 1 level deep in /w:\n" + "/w/f\n" * 30_000),
    ]
    got = sorted(tuple(r) for r in P.attested_paths(spark.createDataFrame(turns, "conv_id int, role string, text string")).collect())
    assert got == sorted([(1, "/testbed/a.py"), (1, "b.py"), (1, "/testbed/v.py"), (1, "last.py"), (2, "/w"), (2, "/w/d"), (2, "/w/d/e.py"), (4, "/w/f")])
