"""Each operator against a brute-force version on small, awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import decontamination, html_text, jaccard, langid, packing, ppm, quality, repeats, sharding, warc
from millrace.llm import kernels as K
from millrace.llm.tokens import WordBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [(901, None), (902, ""), (903, " \n\t "), (904, "é" * 150), (905, "日本語 テキスト"), (906, "A b"), (907, "a B"), (None, "n" * 300), (908, "x" * 199), (909, "no letters 123"[11:])]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 30, 120, 300]))) for _ in range(8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w += rng.choice(base).split()[: rng.randint(1, 90)]
        out.append(" ".join(w))
    return out


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, h string, n int, ranges string")
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def rows():
    t = texts(3, 60)
    return [(i, x) for i, x in enumerate(t)] + AWKWARD + [(5, t[5])]


def key(r):
    return tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 9)) for x in r)


def test_repeats(spark, rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for (k, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in repeats.summary(frame(spark, rows, True)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_repeats_periodic_text():
    for text in ("ab" * 400, "a" * 333, "xyz " * 90 + "q" + "xyz " * 90):
        t = K.Texts(pa.array([text, text[7:], "", text[:150]]))
        doc, start, count, _ = repeats.anchors(t)
        windows = {(d, s + i) for d, s, n in zip(doc, start, count, strict=True) for i in range(n)}
        assert windows == {(d, i) for d in range(4) for i in range(t.length[d] - 199)}


def test_packing(spark, rows):
    tok = Tokenizer.from_file(PATH)
    big = [*rows, (77, "word " * 9000)]
    got = packing.pack_documents(frame(spark, big, True), PATH).collect()
    want = []
    for k, t in big:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((k, p, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096


def test_bin_completion_is_optimal():
    def fewest(lengths, room):
        best = [len(lengths)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= room and bins[k] not in bins[:k]:
                    bins[k] += lengths[i]
                    place(i + 1, bins)
                    bins[k] -= lengths[i]
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return best[0]

    rng = random.Random(2)
    for turn in range(240):
        low, high, most = ((1, 100, 10), (20, 50, 14), (30, 60, 12))[turn % 3]
        lengths = sorted((rng.randint(low, high) for _ in range(rng.randint(1, most))), reverse=True)
        got, proven = packing.bin_completion(lengths, 100, 20_000)
        assert sorted(x for b in got for x in b) == sorted(lengths) and max(map(sum, got)) <= 100
        assert proven and packing.lower_bound(lengths, 100) <= len(got) == fewest(lengths, 100)


def test_bin_completion_beats_best_fit_and_runs_where_best_fit_is_optimal():
    lengths = [44, 44, 31, 31, 25, 25]  # best fit needs three: 44 44, 31 31 25, 25
    assert len(packing.best_fit(lengths, 100)) == 3
    assert packing.bin_completion(lengths, 100) == ([[44, 31, 25], [44, 31, 25]], True)
    lengths = [60, 50, 40, 30, 20]
    assert len(packing.best_fit(lengths, 100)) == packing.lower_bound(lengths, 100) == 2
    best, proven = packing.search(lengths, 100, 2, (1, 3), 1000)
    assert proven and packing.bin_completion(lengths, 100) == (best, True)
    assert packing.bin_completion([], 100) == ([], True) and packing.bin_completion([7, 7, 7], 7) == ([[7]] * 3, True)
    assert packing.bin_completion([33] * 7, 100, 0)[0] == [[33] * 3, [33] * 3, [33]]  # no effort: best fit


def test_bins_completed_anew():
    rng = random.Random(3)
    triples = [n for a, b in ((rng.randint(1000, 1600), rng.randint(1000, 1600)) for _ in range(600)) for n in (a, b, 4096 - a - b)]
    best = packing.best_fit(sorted(triples, reverse=True), 4096)
    got, _ = packing.bin_completion(triples, 4096)
    assert sorted(n for b in got for n in b) == sorted(triples) and max(map(sum, got)) <= 4096
    assert packing.lower_bound(triples, 4096) == 600 and len(best) == 655 and len(got) <= 602
    assert packing.bin_completion(triples, 4096)[0] == got  # the chances are of a fixed seed
    for n in range(60):
        some = [rng.randint(1, 40 + n) for _ in range(n)]
        bins = packing.completed(some, 100, rng)
        assert sorted(x for b in bins for x in b) == sorted(some) and all(sum(b) <= 100 for b in bins)
        start = packing.best_fit(sorted(some, reverse=True), 100)
        again = packing.recompleted(start, 100, packing.lower_bound(some, 100) if n else 0, 20)
        assert sorted(x for b in again for x in b) == sorted(some) and len(again) <= len(start)
    # the first bin's filling wastes least among all fillings
    for _ in range(50):
        head, *rest = sorted((rng.randint(10, 60) for _ in range(9)), reverse=True)
        sums = {sum(c) for k in range(9) for c in combinations(rest, k)}
        assert sum(packing.completed([head, *rest], 100, rng)[0]) == head + max(x for x in sums if x <= 100 - head)


def test_runs_of_an_index():
    rng = np.random.default_rng(4)
    for turn in range(40):
        sig = np.sort(rng.integers(0, rng.integers(1, 12), rng.integers(0, 60)))
        ids = np.arange(len(sig))
        at = np.sort(rng.integers(0, len(sig) + 1, turn % 7))
        batches = [pa.RecordBatch.from_arrays([pa.array(s), pa.array(i)], ["sig", "set_id"]) for s, i in zip(np.split(sig, at), np.split(ids, at), strict=True)]
        want = [ids[sig == v].tolist() for v in np.unique(sig) if (sig == v).sum() > 1]
        assert [g[0].tolist() for g in jaccard._groups(iter(batches))] == want


def test_thinly_spread_shingles_are_counted(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    line = "this one line stands in all of them and often enough to be met"
    docs = [(i, " ".join(word() for _ in range(20)) + " " + line) for i in range(3000)]
    monkeypatch.setattr(jaccard, "LOCAL", 10**9)  # no window sees anything
    made = jaccard._sets_and_counts(spark.createDataFrame(docs, "key bigint, text string"))
    got = jaccard._frequent(made.where("shingle IS NOT NULL"))
    want = jaccard.document_sets(jaccard.K.Texts(pa.array([line])))[0]
    assert set(want.tolist()) == set(got.tolist())


def test_tokens_equal_the_library():
    rng = random.Random(1)
    some = ["".join(rng.choice("aAbBeE's'll''t've'!?..,,  \n\t09½²ÀéßñŒœ€日本́<|> Σσς") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    some += ["", None, "don't we'LL 'still !!'s", "<|endoftext|> hi", "aaaaaaa aaaa", "İI"]
    bpe = WordBpe(PATH)
    ids, counts = bpe.ids(pa.array(some))
    at = 0
    for t, n in zip(some, counts, strict=True):
        assert ids[at : at + n].tolist() == bpe.library.encode(t or "", add_special_tokens=False).ids
        at += n


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=#>Home</a></nav><div id="cookie-notice">We use cookies on this site to improve what you do here.</div>
<div class="wrap"><div class="post"><h2>Title</h2><p>First paragraph with a fair amount of text &amp; more, to be read by people.<p>Short.<ul><li>item one<li>item two</ul><p>Another long
paragraph, which goes on about nothing in particular, &eacute;t&eacute;.<form><label>Mail</label><input></form></div><aside>Side stuff, long enough to look like text for real.</aside>
<div class="comments"><p>I liked this text so much, thank you very much for writing it!</p></div></div><footer>c 2020</footer><script>x="<p>no</p>"</script></body></html>"""


def test_html():
    assert html_text.main_text(PAGE).split("\n") == ["Title", "First paragraph with a fair amount of text & more, to be read by people.", "Short.", "item one", "item two", "Another long paragraph, which goes on about nothing in particular, été."]
    assert [html_text.main_text(x) for x in (None, "", "plain", "<p>a<p>b", "<nav>x</nav>")] == ["", "", "plain", "a\nb", ""]


def test_html_keeps_the_whole_article():
    long, part, menu = "long body text " * 40, "second section, shorter " * 8, "<div><a href=/>Home</a></div>"
    for page, want in (
        (f"<body>{menu}<article><section><p>{long * 2}</section><section><p>{part}</section></article></body>", [long * 2, part]),
        (f"<body>{menu}<main><div><section><h2>A</h2><p>{long * 2}</section><section><p>{part}</section></div></main></body>", ["A", long * 2, part]),
        (f"<body>{menu}<article><h1>T</h1><div><p>{long}</p></div></article></body>", ["T", long]),
        (f"<body>{menu}<main><p>By A.</p><article><h1>T</h1><div><p>{long}</p></div><p>End.</p></article></main></body>", ["By A.", "T", long, "End."]),
        (f"<body>{menu}<div><h1>T</h1><div><p>{long}</p></div></div></body>", ["T", long]),
        (f"<body>{menu}<p>Short.</p><p>Two.</p><p>{long}</p><p>{long}</p><p>x</p><p>y</p><p>The end.</p>{menu}</body>", ["Short.", "Two.", long, long, "x", "y", "The end."]),
    ):
        assert html_text.main_text(page).split("\n") == [x.strip() for x in want]


def test_html_class_words_only_cast_doubt():
    six = "".join(f"<p>Paragraph {i} with a fair amount of running text in it, so that it reads like prose.</p>" for i in range(6))
    lines = re.findall("<p>(.*?)</p>", six)
    nav, links = "<nav><a href=#>Home</a></nav>", "".join(f"<li><a href=/{i}>Reference number {i}</a>" for i in range(3))
    for page, want in (
        *((f"<body>{nav}<div {w}>{six}</div></body>", lines) for w in ('id=content class="no-sidebar"', 'class="wrap has-sidebar"', 'class="entry search-result"', 'class="blog-post promo"', 'class="post comments-open"')),
        *((f"<body>{nav}<div {w}>{six}</div></body>", [""]) for w in ('class="comments"', 'class="sidebar"', 'class="post-comments"', 'class="ad"')),
        (f"<body>{nav}<div class=p1>{six * 4}</div><div class=p2>{six}</div></body>", lines * 5),
        (f"<body>{nav}<article>{six}<ul>{links}</ul></article></body>", [*lines, *(f"Reference number {i}" for i in range(3))]),
        (f"<body>{nav}<article><ul>{links}</ul>{six}</article></body>", lines),
        (f"<body><header><h1>Site</h1></header>{nav}<div class=post><header><h1>Title</h1></header><div class=body>{six}</div></div></body>", ["Title", *lines]),
        (f"<body><article>{six}<section class=comments><article>{six * 3}</article></section></article></body>", lines),
        (f"<body><div class='has-sidebar'><article><h1>T</h1>{six}</article><div class='sidebar'>{six * 3}</div></div></body>", ["T", *lines]),
    ):
        assert html_text.main_text(page).split("\n") == want, page


def test_html_forms_and_menus_are_measured():
    body = "".join(f"<p>Sentence number {i} of the article, long enough to count as text of a page.</p>" for i in range(6))
    want = "\n".join(f"Sentence number {i} of the article, long enough to count as text of a page." for i in range(6))
    login = '<form action="/in"><label>Name of the user</label><input name="u"><p>Forgot the password?</p></form>'
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(5)) + "</ul></nav>"
    for page in (
        f'<body><form id="aspnetForm">{menu}<div>{body}</div><footer>c</footer></form>', f"<body><form><article>{body}</article></form>", f"<body>{login}{menu}<article>{body}</article>",
        f"<body>{menu[:-6]}<article>{body}</article><footer>end</footer>", f"<body>{menu[:-6]}<main>{body}{login}</main>", f"<body>{menu}<div>{body}</div>{login}",
    ):
        assert html_text.main_text(page) == want, page


def test_html_class_words_of_inline_elements_say_nothing():
    tail = "<p>And here some more words follow, so that this is a page of text.</p>"
    page = f"<article><p>It was a <b class='alert'>very serious</b> flood in <span class='hidden-gem'>the best</span> town, says <a class='related-link' href='/o'>the older report</a> of it.</p>{tail}</article>"
    assert html_text.main_text(page).split("\n")[0] == "It was a very serious flood in the best town, says the older report of it."
    assert "gone" not in html_text.main_text(f"<article><p>Here <span hidden>gone</span> it <b style='display:none'>gone</b> is, a text that is kept as it stands.</p>{tail}</article>")
    cells = f"<table><tr><td class='sidebar'><p>Side words of the page</p></td><td><p>The text of the page stands in the other cell of the table.</p>{tail}</td></tr></table>"
    assert "Side words" not in html_text.main_text(cells) and "other cell" in html_text.main_text(cells)


def test_html_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(re.sub(r"</?b>", "", x).replace("<br>", " ").split()) for x in re.split(r"</?(?:h1|p)>", article)]
        from html import unescape

        want = "\n".join(" ".join(unescape(b).split()) for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def edits(item, text):
    """Least edits of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(3)
    phrase = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(n))
    items = [(i, phrase(rng.randint(5, 40))) for i in range(15)] + [(50, "ab"), (51, None)]
    docs = []
    for k in range(60):
        t = list(rng.choice(items[:15])[1])
        for _ in range(rng.randint(0, int(len(t) * 0.15))):
            t[rng.randrange(len(t))] = rng.choice(["", "a", "zz"])
        docs.append((k, f"{phrase(9)} {''.join(t).upper() if k % 4 == 0 else ''.join(t)} \n {phrase(5)}"))
    docs += [(900, None), (901, "")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contained_items(frame(spark, docs, True), spark.createDataFrame(items, "item_id long, text string")).collect()}
    flat = lambda t: " ".join(lower(t).split()) if (t or "").strip() else ""
    spaced = lambda t: re.sub(r"[ \t-\r]+", " ", lower(t))
    want = {}
    for k, t in docs:
        for i, x in items:
            if len(flat(x)) >= decontamination.MIN_ITEM and (e := edits(flat(x), spaced(t))) <= len(flat(x)) // 10:
                want[k, i] = e
    assert got == want and want
    clean = decontamination.clean_documents(frame(spark, docs, True), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in docs} - {k for k, _ in want} and len(clean.columns) == 5


def test_decontamination_of_short_items(spark, tmp_path):
    from millrace.llm.queries import QUERIES

    spark.createDataFrame([(1, "Forty  two"), (2, "x"), (3, "ab-c"), (4, " "), (5, "is the answer 42 here?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["say forty\nTWO.", "forty twos, forty two", "aforty two", "forty too", "a x", "axa", "(ab-c)", "ab-cd", "x", "is the answer 42 here?", "is the answer 43 here?", "", " forty two "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end], r.distance) for r in QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1, "forty\nTWO", 0), (1, 1, "forty two", 0), (4, 2, "x", 0), (6, 3, "ab-c", 0), (8, 2, "x", 0), (9, 5, texts[9], 0), (12, 1, "forty two", 0)}


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = langid.remainder(docs.doc_id, 5) == 0
    machines = langid.fit(docs.where(~part))
    got = langid.predict(docs.where(part), machines).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predict(frame(spark, AWKWARD), machines).collect()}
    assert odd[901].lang_pred == odd[902].lang_pred == odd[903].lang_pred == odd[909].lang_pred == "und" and odd[901].score == 0
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), none).collect()} == {"und"}


@pytest.mark.parametrize("frequent, local", [(64, 4), (4, 1)])
def test_jaccard(spark, rows, monkeypatch, frequent, local):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LOCAL", local)
    rows = [r for r in rows if r[0] is not None] + [(1000 + i, t) for i, t in enumerate(texts(8, 150))]
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    want = sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, jaccard.linked_documents(frame(spark, rows, True)).collect())) == want
    kept = jaccard.one_of_each(frame(spark, rows, True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[2] for x in want}) and len(kept.columns) == 5


def test_jaccard_broadcasts_no_table_that_spark_sizes_too_low(spark):
    """Plans as they ran: neither the rows of one component for each part, nor sets of shingles, go to the driver."""
    rows = [(i, t) for i, t in enumerate(texts(8, 60))]
    linked = jaccard.linked_documents(frame(spark, rows))
    linked.collect()
    joins = [line for line in linked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in line]
    assert [("SortMergeJoin" in line) for line in joins if "salt" in line] == [True], joins
    ids = frame(spark, rows).selectExpr("doc_id key", "text")
    sets = jaccard._sets_and_counts(ids).where("set_id IS NOT NULL").selectExpr("set_id", "xxhash64(key) AS r")
    pairs = sets.selectExpr("set_id a").join(sets.selectExpr("set_id b")).where("a < b").distinct()
    plans, keep = [], jaccard.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
        assert jaccard._verified(pairs, ids.selectExpr("xxhash64(key) AS r", "text"), sets).count()
    plan = dict(plans)["links"]
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan, plan


def test_warc(spark):
    pages = [(1, "http://a/ü", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "u", "x" * 200_000), (None, "n", "same"), (1, "http://a/ü", "same")]
    pages += [(10 + i, f"http://d/{i}", f"<p>page {i % 40}</p>" * 20) for i in range(90)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    first = {}
    for k, _, h in pages:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, _, h in pages:
        b = (h or "").encode()
        again = first.get(h or "") not in (None, k)
        want.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_warc_rejects_damage():
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, b"")
    w.add(warc.record("response", {"WARC-Record-ID": "<urn:x>"}, b"hello"))
    data = out.getvalue()
    assert [warc.parse(f)[1] for f in warc.frames(io.BytesIO(data))] == [b"hello"]
    for bad in (data[:-3], b"x" + data[1:], data[:5]):
        with pytest.raises(warc.WarcError):
            [warc.parse(f) for f in warc.frames(io.BytesIO(bad))]
    with pytest.raises(warc.WarcError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: 9\r\n\r\nhello\r\n\r\n")


def test_ppm_reads_long_texts_in_parts(spark, rows, monkeypatch):
    long = [(i, " ".join(t for _, t in rows if t)[i * 9 :] + "é" * 700 + " end") for i in range(20, 34)]
    want = sorted(map(tuple, ppm.scored(frame(spark, long)).collect()))
    monkeypatch.setattr(ppm, "CHUNK", 500)
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", 200)
    monkeypatch.setattr(ppm, "MAX_WORDS", 20)
    got = sorted(map(tuple, ppm.scored(frame(spark, long)).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_ppm_bounds_memory_by_parts():
    raw = "ab cd éf " * 2_500_000  # 25 MB
    batch = pa.RecordBatch.from_pydict({"h": [1], "text": [raw]})
    made = list(ppm.parts(iter([batch]), "text"))
    assert sum(len(c[0].as_py().encode()) for _, c, _, _ in made) == len(raw.encode()) and [last for *_, last in made] == [False] * (len(made) - 1) + [True]
    assert max(len(c[0].as_py().encode()) for _, c, _, _ in made) <= ppm.CHUNK + 8
    data, at, _ = ppm.symbols(K.Texts(made[1][1]), 5, made[1][2], False)
    whole = b"\xff" * 5 + raw[: 2 * ppm.CHUNK].encode()
    first = len(made[0][1][0].as_py().encode())
    assert data[at[0] - 5 : at[0] + 1].tobytes() == whole[first : first + 6]


def test_overlaps_in_a_very_long_text():
    item = "the quick brown fox jumps over the lazy dog and runs away"
    text = "zz y" * 5_200_000 + " " + item.replace("lazy", "lzy") + " " + "q" * 100  # beyond 16 MB
    found = decontamination.overlaps(decontamination.Items([7], [item], True), K.Texts(pa.array([text, item])))
    assert [(d, i, k) for d, i, _, _, k in found] == [(0, 0, 1), (1, 0, 0)] and text[found[0][2] : found[0][3]].startswith("the quick")


@pytest.mark.parametrize("order", [2, 5])
def test_ppm(spark, rows, monkeypatch, order):
    monkeypatch.setattr(ppm, "MAX_WORDS", 20)
    rows = [r for r in rows if r[0] is not None]
    learned = lambda k: zlib.crc32(str(k).encode()) % 10 != 0
    words, ends, seen = Counter(), 0, [defaultdict(Counter) for _ in range(order + 1)]
    for k, t in rows:
        if learned(k):
            words.update(WORD.findall(lower(t)))
            ends += 1
            b = b"\xff" * order + lower(t).encode() + b"\xff"
            for i in range(order, len(b)):
                for o in range(order + 1):
                    seen[o][b[i - o : i]][b[i]] += 1
    total, scale = sum(words.values()) + ends, sum(words.values()) + ends + 0.1 * (len(words) + 2)
    want = []
    for k, t in rows:
        w = WORD.findall(lower(t))
        base = sum(math.log10((words[x] + 0.1) / scale) for x in w) + math.log10((ends + 0.1) / scale)
        b, score = b"\xff" * order + lower(t).encode() + b"\xff", 0.0
        for i in range(order, len(b)):
            gone, p = set(), 1.0
            for o in range(order, -1, -1):
                left = {x: n for x, n in seen[o].get(b[i - o : i], {}).items() if x not in gone}
                if left:
                    whole = sum(left.values()) + len(left)
                    if b[i] in left:
                        p *= left[b[i]] / whole
                        break
                    p *= len(left) / whole
                    gone |= set(left)
            else:
                p /= 256 - len(gone)
            score += math.log10(p)
        want.append((k, not learned(k), len(w) + 1, sum(words[x] > 0 for x in w) + 1, total, base, score))
    got = sorted(map(tuple, ppm.scored(frame(spark, rows, True), order=order).collect()))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_ppm_keeps_every_context(spark, monkeypatch):
    rng, order = random.Random(8), 5
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrst", k=9_000))) for i in range(44)] + [(i, "abc " * 300) for i in range(44, 60)]
    seen, learned = [defaultdict(Counter) for _ in range(order + 1)], lambda k: zlib.crc32(str(k).encode()) % 10 != 0
    padded = [b"\xff" * order + t.encode() + b"\xff" for _, t in rows]
    for (k, _), b in zip(rows, padded, strict=True):
        for i in range(order, len(b) if learned(k) else 0):
            for o in range(order + 1):
                seen[o][b[i - o : i]][b[i]] += 1
    assert sum(map(len, seen[order].values())) > 320_000 and not all(learned(k) for k, _ in rows)
    monkeypatch.setattr(ppm, "PAIRS", 5_000, raising=False)
    for most in (1_000_000, 30):
        monkeypatch.setattr(ppm, "MAX_CONTEXTS", most, raising=False)
        got = {r.doc_id: r.score for r in ppm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for (k, _), b in zip(rows, padded, strict=True):
            want = 0.0
            for i in range(order, len(b)):
                gone = set()
                for o in range(order, -1, -1):
                    left = {x: n for x, n in seen[o].get(b[i - o : i], {}).items() if x not in gone}
                    whole = sum(left.values()) + len(left)
                    if b[i] in left:
                        want += math.log10(left[b[i]] / whole)
                        break
                    want += math.log10(len(left) / whole) if left else 0
                    gone |= set(left)
                else:
                    want -= math.log10(256 - len(gone))
            assert got[k] == pytest.approx(want, abs=1e-6)


def test_quality_counts():
    some = [*texts(5, 40), None, "", " \n ", "a b c a b c", "x\nx\n\nx y\nx y", "# $ é日 <b>"]
    got = quality.statistics(pa.array(some))
    for i, t in enumerate(some):
        w = WORD.findall(t or "")
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        own = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert [got[c][i] for c in quality.COUNTS] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(covered)]


def test_quality_keeps_and_drops(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(200)]
    bad = [(1000 + i, " ".join(word() + "###" for _ in range(80))) for i in range(40)]
    docs = frame(spark, [*good, *bad, (5000, None), (5001, "")], True)
    labels = spark.createDataFrame([(k, int(k < 1000)) for k, _ in [*good, *bad][::2]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert sum(got[k].kept for k, _ in good) >= 198 and sum(got[k].kept for k, _ in bad) == 0
    assert got[5000].base_failed and not got[5000].kept
    everything = quality.judge(docs, quality.fit(docs, labels.where("false"))).collect()
    assert all(r.kept != r.base_failed for r in everything)


def test_quality_thresholds_come_from_all_labelled_rows(spark):
    rng = random.Random(3)
    good = [(i, " ".join("x#" if rng.random() < (0.6 if i % 400 == 0 else 0.02) else f"w{j}" for j in range(60))) for i in range(10_000)]
    bad = [(20_000 + i, " ".join(f"w{j}" + "#" * (1 + i % 9) for j in range(60))) for i in range(90)]
    docs = frame(spark, [*good, *bad]).repartition(5)
    labels = spark.createDataFrame([(k, int(k < 20_000)) for k, _ in [*good, *bad]], "doc_id long, quality int")
    stats = quality.statistics(pa.array([t for _, t in [*good, *bad]]))
    model, use = quality.fit(docs, labels), ~quality.base_failed(stats)
    n = int(use[: len(good)].sum())
    assert 9_950 < n and use[len(good) :].all()
    for forest, view, cut in zip(model.forests, quality.VIEWS, model.cuts, strict=True):
        score = forest.score(quality.features(stats)[use][:, list(view)])
        floor = np.sort(score[:n])[-10]  # nine rows, 0.1 %, may lie above
        above = score[n:][score[n:] > floor]
        assert cut == (floor + above.min() if len(above) else float("inf")) / 2
    assert min(model.cuts) < float("inf")
    assert quality.fit(docs.repartition(2), labels.repartition(7)).cuts == model.cuts
    copies = docs.where("doc_id <= 1 OR doc_id >= 20080").selectExpr("*", "explode(sequence(1, if(doc_id < 2, 70000, 3)))").drop("col")
    got = quality.judged(copies, labels).groupBy("doc_id").agg({"kept": "min", "anomaly": "max", "*": "count"}).toPandas()
    assert dict(zip(got["doc_id"], got["count(1)"], strict=True)) == {0: 70_000, 1: 70_000, **{20_000 + i: 3 for i in range(80, 90)}}
    assert not got[got.doc_id >= 20_000]["min(kept)"].any() and got[got.doc_id == 1]["min(kept)"].all()


def test_sharding(spark, rows):
    got = sharding.shard(frame(spark, rows, True), "doc_id", "text", 8).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows), key=key)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.map_version == 1 and r.next_shard in (r.shard, 8) for r in got)
    rng = random.Random(1)
    load = [rng.randint(0, 90) for _ in range(4096)]
    m = sharding.balanced(load, 8)
    sums = [sum(w for w, k in zip(load, m.shard_of, strict=True) if k == s) for s in range(8)]
    assert max(sums) - min(sums) <= 90
    g = m.grow(load)
    assert g.version == 2 and g.n_shards == 9 and all(b in (a, 8) for a, b in zip(m.shard_of, g.shard_of, strict=True))
    assert abs(sum(w for w, k in zip(load, g.shard_of, strict=True) if k == 8) - sum(load) / 9) <= 90


def test_sharding_of_real_rows_and_the_stored_map(spark, sf, tmp_path):
    docs, where = spark.read.parquet(f"{sf}/documents.parquet"), f"file://{tmp_path}/map"
    got = sharding.shard(docs, "doc_id", "text", 8, where=where).collect()
    bytes_, grown = Counter(), Counter()
    for r in got:
        bytes_[r.shard] += r["size"]
        grown[r.next_shard] += r["size"]
    most = max(r["size"] for r in got)
    assert len(bytes_) == 8 and max(bytes_.values()) - min(bytes_.values()) <= 2 * most
    assert 0 < grown[8] <= sum(grown.values()) / 9
    moved = {r.slot_id for r in got if r.shard != r.next_shard}
    first, second = sharding.load(spark, where, 1), sharding.load(spark, where, 2)
    assert (first.n_shards, second.n_shards) == (8, 9) and moved <= {s for s in range(4096) if first.shard_of[s] != second.shard_of[s]}
    again = sharding.shard(docs, "doc_id", "text", 8, where=where, version=2).collect()
    assert {r.doc_id: r.shard for r in again} == {r.doc_id: r.next_shard for r in got}
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.store(spark, where, first)


def test_sharding_spreads_a_repeated_or_missing_key(spark):
    rows = [(7 if i % 2 else None if i % 4 else i, f"text {i} " + "x" * (i % 50)) for i in range(8000)]
    got = sharding.shard(frame(spark, rows), "doc_id", "text", 8).collect()
    total = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert len(got) == 8000 and max(total) < 1.01 * min(total)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_sharding_ties():
    m = sharding.balanced([5, 5, 5, 5], 2)
    assert m.shard_of == [0, 1, 0, 1]


@pytest.mark.parametrize("name", ["html", "decontamination", "decontamination of nothing", "repeats", "packing", "language", "jaccard", "ppm", "sharding", "quality", "warc"])
def test_empty_tables(spark, name):
    docs = frame(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items, none = spark.createDataFrame([(1, "some words to find")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    made = {
        "html": lambda: html_text.extract(pages), "decontamination": lambda: decontamination.contained_items(docs, items),
        "decontamination of nothing": lambda: decontamination.contained_items(frame(spark, [(1, "some words to find")]), none),
        "repeats": lambda: repeats.summary(docs), "packing": lambda: packing.pack_documents(docs, PATH), "language": lambda: langid.predict(docs, langid.fit(docs.selectExpr("*", "text AS lang"))),
        "jaccard": lambda: jaccard.one_of_each(docs), "ppm": lambda: ppm.scored(docs), "sharding": lambda: sharding.shard(docs, "doc_id", "text", 8), "quality": lambda: quality.judge(docs, quality.fit(docs, labels)), "warc": lambda: warc.round_trip(pages),
    }
    assert made[name]().collect() == []
