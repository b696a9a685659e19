"""Ranked search, main text of pages, periodic runs: against plain forms, on small rows of every kind."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import pytest

from skeinwork.llm import extraction, queries, runs, search

from ..oracle import SF

EXTRA = "score double, term string, words string, n long, g long, rank long, best string"


def with_extras(spark, rows, schema):
    """rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1.0, "t", "w", 1, 2, 3, "b") for r in rows], f"{schema}, {EXTRA}")


# periodic runs


def plain_runs(words):
    """Every maximal stretch with words q apart equal, for every q; the smallest q of a stretch."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(n=150):
    random.seed(7)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("ab") * 4, list("ab") * 3, list("abc") * 4 + ["a"], list("aab") * 60 + list("aaaaaab") * 9]
    for _ in range(n):
        words = []
        while len(words) < random.randint(0, 120):
            piece = random.choices("ab" if random.random() < 0.5 else "abcdefgh", k=random.randint(1, 7))
            words += piece * random.choice((1, 1, 2, 3, 4, 5, 9))
        out.append(words)
    return out


def test_runs_equal_a_search_of_all_periods(spark):
    texts = periodic_texts()
    got = {r.doc_id: r for r in runs.find_runs(with_extras(spark, [(i, "\t".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()}
    for i, words in enumerate(texts):
        want = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want and got[i].n_words == len(words)
        assert got[i].collapsed == collapsed(words, want)


def test_overlap_is_the_least_that_a_run_has():
    assert runs.OVERLAP == 5 and all(n - q >= runs.OVERLAP for q in range(1, 50) for n in range(max(6, 4 * q), 300))


def test_runs_of_null_empty_repeated_and_long_texts(spark):
    long = ["x"] * 10 + [f"w{i}" for i in range(30_000)] + ["y", "z"] * 20_000
    rows = [(None, None), (1, ""), (1, " \n "), (2, "a a a a a a"), (2, "a a a a a a"), (3, " ".join(long)), (None, "b " * 9)]
    got = runs.run_digests(runs.find_runs(with_extras(spark, rows, "doc_id long, text string"))).collect()
    assert sorted((r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got if r.n_words < 20) == [(0, 0, None, None, None, None)] * 3 + [(6, 1, 0, 6, 1, 6000)] * 2 + [(9, 1, 0, 9, 1, 9000)]
    (r,) = (r for r in got if r.doc_id == 3)
    assert (r.n_runs, r.start, r.length, r.period) == (2, 30_010, 40_000, 2) and r.runs_sha256 == hashlib.sha256(b"0,10,1\n30010,40000,2\n").hexdigest()
    assert r.collapsed_sha256 == hashlib.sha256(" ".join(["x"] + long[10:30_010] + ["y", "z"]).encode()).hexdigest()
    assert runs.run_digests(runs.find_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_planted_tails_and_digests(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)]
    got = {r.doc_id: r for r in runs.run_digests(runs.find_runs(runs.with_planted_tails(with_extras(spark, rows, "doc_id long, text string")))).collect()}
    for i, text in rows:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        assert (got[i].start, got[i].length, got[i].period, got[i].n_runs) == (*best, len(found))
        assert got[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
plain_terms = lambda text: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out, asked = [], {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // max(1, total)
            scored.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t]), i))
        scored = sorted((s for s in scored if s[0]), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return sorted(out, key=str)


def searched(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def search_rows():
    random.seed(3)
    words = ["The", "of", "señor", "SEÑOR", "x1", "a_b", "漢字", "İ", "q", "r", "s", "t"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, "copy of the same x1") for i in range(40)] + [(None, "copy of the same x1"), (7, "copy"), (7, "copy"), (500, None), (501, "")]
    items = [(1, "the same"), (2, "X1, señor!"), (3, ""), (4, None), (5, "nowhere"), (None, "copy"), (6, "q"), (6, "r q r")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 500])
def test_search_equals_scoring_all(spark, k):
    docs, items = search_rows()
    found = search.search(with_extras(spark, docs, "doc_id long, text string").repartition(7), with_extras(spark, items, "item_id long, text string"), k)
    assert searched(found) == plain_search(docs, items, k)


def test_search_in_blocks_and_shards(spark, monkeypatch):
    docs, items = search_rows()
    monkeypatch.setattr(search, "SHARD_BYTES", 100)
    frame = with_extras(spark, docs, "doc_id long, text string").coalesce(1)
    index, n = search.index_documents(frame)
    assert index.count() > 10
    assert searched(search.search_index(index, n, with_extras(spark, items, "item_id long, text string"), 10, block=2)) == plain_search(docs, items, 10)


def test_search_of_empty_tables_and_long_texts(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, one).collect() == [] and search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), one.where("false")).collect() == []
    docs = [(1, "a " * 60_000 + "b"), (2, "a b"), (3, "c")]
    assert searched(search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "b"), (2, "a b")], "item_id long, text string"))) == plain_search(docs, [(1, "b"), (2, "a b")], 10)


# main text of pages


def cost(label, content, boilerplate, edges):
    return sum(b if on else c for on, c, b in zip(label, content, boilerplate, strict=True)) + sum(w for i, j, w in edges if label[i] != label[j])


def test_cut_is_least_of_all_labellings():
    random.seed(5)
    for _ in range(400):
        n = random.randint(0, 8)
        content, boilerplate = ([random.choice((0, 1, 2, 5, 9, 30)) for _ in range(n)] for _ in range(2))
        edges = [(i, j, random.randint(1, 9)) for i, j in itertools.combinations(range(n), 2) if random.random() < 0.5]
        got = extraction.minimum_cut(content, boilerplate, edges)
        assert cost(got, content, boilerplate, edges) == min(cost(x, content, boilerplate, edges) for x in itertools.product((False, True), repeat=n))


def test_flow_alone_gives_the_same_cut():
    random.seed(6)
    for _ in range(200):
        n = random.randint(2, 9)
        odds = [random.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, random.randint(1, 6)) for i, j in itertools.combinations(range(n), 2) if random.random() < 0.6]
        flow = extraction.Flow(n + 2)
        for i, x in enumerate(odds):
            flow.edge(*((n, i) if x > 0 else (i, n + 1)), abs(x), 0)
        for i, j, w in edges:
            flow.edge(i, j, w, w)
        content, boilerplate = [max(0, x) for x in odds], [max(0, -x) for x in odds]
        assert cost(flow.cut(n, n + 1)[:n], content, boilerplate, edges) == cost(extraction.minimum_cut(content, boilerplate, edges), content, boilerplate, edges)


PROSE = ["A first long paragraph about rivers, their banks and the towns along them, as they were once.", "Short one.", "Then another paragraph that goes on about boats, with commas, clauses &amp; an entity.", "Fin."]
WANT = "\n".join(["A title", *map(html.unescape, PROSE)])
BODY = "<h1>A  title</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul>"
REMARKS = "<div class='comment'><b>Ann</b><p>I liked this piece a lot, it says what I have always thought about rivers.</p></div>"
LAYOUTS = {
    "elements": f"<header><h2>Site</h2><nav>{MENU}</nav></header><main><article>{BODY}</article><aside><p>Read this next, it is very good and long enough to count.</p></aside></main><footer><p>© 2024 Us. All rights reserved.</p></footer>",
    "classes": f"<div class='header'>Site</div><div id='menu'>{MENU}</div><div class='sidebar'><p>Read this next, it is very good and long enough to count.</p></div><div class='content'>{BODY}</div><div class='comments'>{REMARKS}{REMARKS}</div><div class='footer'>© 2024 Us</div>",
    "notices": f"<body class='no-sidebar'><div class='cookie-notice'><p>We use cookies to make this site better for you, and for others.</p><button>Accept</button></div><article>{BODY}<div class='share'><a href='#'>Share</a></div><section id='comments'><h3>Comments</h3>{REMARKS}<form><label>Name<input></label><textarea>say</textarea><button>Send</button></form></section></article>",
    "no marks": f"<div>{MENU}</div><div>{BODY}</div><div><a href='/x'>Next page</a> <a href='/y'>Last page</a></div><div>© 2024 Us. All rights reserved.</div>",
    "adverts inside": f"<article><h1>A title</h1><p>{PROSE[0]}</p><div class='ad'>Buy our very fine boats today. They float.</div>" + "".join(f"<p>{p}</p>" for p in PROSE[1:]) + "</article>",
    "unclosed": f"<nav>{MENU}</nav><article><h1>A title</h1><p>" + "<p><b>".join(PROSE) + f"</article><footer>© Us &middot; {PROSE[0]}",
    "table": f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>",
    "markup": f"<head><title>A title</title><style>p{{x:1}}</style></head><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><article>{BODY}<template><p>no</p></template><p style='display: none'>hidden words of some length, no reader sees them.</p></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert extraction.main_text(f"<!DOCTYPE html><html><body>{LAYOUTS[name]}</body></html>") == WANT


def test_text_of_a_block():
    assert extraction.main_text("<article><p> a&lt;b\n\t&amp;amp; &nbsp;c<br>d <i>e</i>f, long enough to be a sentence. </p><p> </p><p>x < y and more of it here, as before.</p></article>") == "a<b &amp; c d ef, long enough to be a sentence.\nx < y and more of it here, as before."


def test_pages_of_every_kind(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p"), (2, "u", "<article>" + "<p>One more sentence, of the same kind.</p>" * 30_000), (3, "u", "<div>" * 30_000 + "deep"), (4, "u", "<a href=x>" * 2000)]
    got = {(r.page_id, r.n_blocks): r for r in extraction.extract_pages(with_extras(spark, rows, "page_id long, url string, html string")).collect()}
    assert (got[1, 0].text, got[1, 0].n_chars) == ("", 0) and got[2, 30_000].n_content == 30_000 and (3, 1) in got and (4, 0) in got
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_query_gives_the_articles(spark):
    got = {r.page_id: r for r in queries.op12_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<br>", " ")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", article)) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
