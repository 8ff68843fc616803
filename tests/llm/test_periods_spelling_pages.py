"""Periodic runs, spelling variants and page texts against brute-force versions and hand-made cases."""

import collections
import hashlib
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from burstlake.llm import pagetext, periods, queries, spelling

from .helpers import SCHEMA, frame, messy, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture()
def rng():
    return random.Random(11)


@pytest.fixture()
def mess(spark, rng):
    return messy(spark, rng).cache()


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(df, tmp_path, name="documents"):
    df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


# ---- 11 ----


def brute_runs(w, times=4, least=6):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    out = []
    while len(out) < n:
        cell = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        out += (cell * rng.randint(1, 7))[: rng.randint(1, 40)] if rng.random() < 0.7 else out[rng.randint(0, len(out)) :][:30]
    return out[:n]


def test_runs_equal_brute_force(rng):
    for _ in range(3000):
        w = periodic(rng, rng.randint(0, 90))
        for times, least in ((4, 6), (2, 2), (3, 5)):
            number = {c: i for i, c in enumerate(dict.fromkeys(w))}
            assert sorted(periods.runs_of([number[c] for c in w], times, least), key=lambda r: (r[0], r[2])) == brute_runs(w, times, least)
            assert periods.text_runs(w, times, least) == brute_runs(w, times, least)


def test_factors_are_the_longest_earlier_strings(rng):
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        at = 0
        for begin, size, source in periods.factors(w):
            assert begin == at
            longest = max((k for s in range(begin) for k in range(1, len(w) - begin + 1) if w[s : s + k] == w[begin : begin + k]), default=0)
            assert size == max(1, longest) and (source < begin and w[source : source + size] == w[begin : begin + size] if longest else source == -1)
            at += size
        assert at == len(w)


def brute_op11(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept)


def test_op11_query_equals_brute_force(spark, rng, mess, tmp_path):
    texts = [" ".join(periodic(rng, rng.randint(0, 200))) for _ in range(150)] + [words(rng, 300) for _ in range(30)]
    docs = frame(spark, texts).unionByName(mess.withColumn("doc_id", F.col("doc_id") + 1000))
    got = queries.op11_factor_runs(spark, save(docs, tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute_op11(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert sum(r["n_runs"] for r in got) > 300


def test_runs_of_empty_clashing_and_long(spark, empty):
    assert periods.periodic_runs(empty).count() == 0
    long = " ".join(["la"] * 400_000)
    docs = frame(spark, [long, None, "a b " * 5]).withColumn("runs", F.lit("old")).withColumn("row", F.lit(7)).withColumn("Collapsed_Text", F.lit("old"))
    got = {r["doc_id"]: r for r in periods.periodic_runs(docs).collect()}
    assert got[0]["runs"] == [(0, 400_000, 1)] and got[0]["collapsed_text"] == "la"
    assert got[1]["runs"] == [] and got[1]["collapsed_text"] == "" and got[2]["runs"] == [(0, 10, 2)] and got[2]["collapsed_text"] == "a b" and got[2]["row"] == 7


# ---- 12 ----


def brute_words(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(known):
    near = {w: [x for x in known if one_edit(w, x)] for w in known}
    form = {}
    for w, each in near.items():
        best = min(each, key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 10 * known[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), known.get(form.get(w)) or 0) for w, n in known.items())


def as_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_op12_query_equals_brute_force(spark, rng, mess, tmp_path):
    base = ["colours", "Programme", "ÀÉécole", "naïvetés", "aaaaaaa", "bookkeeper", "×÷éèàâäö", "mississippi"]
    texts = []
    for i in range(400):
        out = []
        for _ in range(40):
            w = base[min(rng.randrange(12), 7)]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                k, c = rng.randrange(len(w)), rng.choice("abé")
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]))
            out.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice((" ", "-", "1")).join(out))
    docs = frame(spark, texts).unionByName(mess.withColumn("doc_id", F.col("doc_id") + 1000))
    known = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = brute_spelling(known)
    assert as_rows(queries.op12_edit_neighbourhoods(spark, save(docs, tmp_path))) == want
    assert len(want) > 300 and any(f and f != r for _, f, r, *_ in want) and max(n for *_, n, _ in want) > 20


def test_chains_ties_and_long_words(spark):
    stem, long = "abcdefghij", "xy" * 1500
    chain = {stem[:7]: 1000, stem[:8]: 100, stem[:9]: 10, stem: 1, "zbcdefg": 100, "ybcdefg": 100, long: 5, long + "x": 2, long[:700] + "z" + long[701:]: 2, "aaaaaaaa": 2, "aaaaaaaaa": 2}
    got = as_rows(spelling.spelling_groups(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute_spelling(chain)
    assert {w: r for w, _, r, *_ in got}[stem] == stem[:7]


def test_a_full_filter_only_costs_time(spark, monkeypatch, rng):
    monkeypatch.setattr(spelling, "FILTER_BITS", 16)
    monkeypatch.setattr(spelling, "BITS_A_WORD", 1)
    known = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))): rng.choice((2, 3, 50)) for _ in range(400)}
    assert as_rows(spelling.spelling_groups(spark.createDataFrame(list(known.items()), "word string, n long"))) == brute_spelling(known)


def test_no_words(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(frame(spark, [None, "", "short words only", "uniquely unrepeated"])).count() == 0


# ---- 13 ----

A = "The first paragraph of the story is long enough, has commas, and says something about rivers."
B = "A second one follows, which is not short either, and it tells what happened to the bridge."
C = "Short end."
CHROME = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no, no, no";</script></head><body class="has-sidebar post"><header><h1>Site</h1><p>Slogan, of the site, here.</p></header>'
    '<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div id="cookie-notice"><p>We use cookies, all of them, for reasons, that we do not tell, at length.</p></div>',
    '<aside><p>Something else, not of the story, in a box at the side, of some length.</p></aside><div class="comments"><p>' + "I think, as a reader, that, well, it is so. " * 30 + "</p></div>"
    '<form action="/s"><label>Find</label><input name="q"></form><noscript>Turn it on</noscript><footer>&copy; Somebody, all rights reserved.</footer></body></html>',
)
PAGES = {
    "article": (f"<article><h1>Head</h1><p>{A}</p><p>{B}</p></article>", f"Head {A} {B}"),
    "article header": (f'<article><header class="entry-header"><h1>Head</h1><p class="by">By me</p></header><p>{A}</p><footer>Tags</footer></article>', f"Head {A}"),
    "main": (f'<main><div class="share"><a href="#">Tell</a></div><h2>Head</h2><div><p>{A}</p></div><ul><li>one<li>two</ul></main>', f"Head {A} one two"),
    "div": (f'<div class="wrapper with-sidebar"><div id="content"><h1>Head</h1><p>{A}<p>{B}<blockquote>{C}</blockquote></div><div class="sidebar"><p>{C}</p></div></div>', f"Head {A} {B} {C}"),
    "parts": (f'<div><h1>Head</h1><div class="part"><p>{A}</p><p>{B}</p></div><div class="part"><p>{B}</p></div><div><a href="/">x</a> <a href="/">y</a> <a href="/">z</a></div></div>', f"Head {A} {B} {B}"),
    "breaks": (f'<div class="story">{A}<br><br>{B}<br/>{C}</div>', f"{A} {B} {C}"),
    "table": (f"<table><tr><td width=100><a href=/1>1</a><br><a href=/2>2</a><br><a href=/3>3</a><td><p>{A}</p><p>{B}</p></table>", f"{A} {B}"),
    "form around all": (f'<form id="aspnetForm"><div class="body"><p>{A}</p><p>{B}</p></div></form>', f"{A} {B}"),
    "inline": ("<article><p>a<b>b</b><i>c</i> d&eacute;&amp;&lt;x&gt;&#x41;&#66 <!-- no --> e\n\t f&nbsp;g</p><p>h<wbr>i</p></article>", "abc d\u00e9&<x>AB e f g hi"),
    "hidden": (f'<article><p>{A}</p><p hidden>no</p><div style="display: none">no</div><span class="ad">no</span><p aria-hidden="true">no</p></article>', A),
    "tiny": ("<article><p>Be.</p></article>", "Be."),
    "links in text": (f'<article><p>{A} <a href="/x">more</a></p><div class="related"><a href="/r">no</a></div><ul><li><a href=1>p</a><li><a href=2>q</a><li><a href=3>r</a></ul></article>', f"{A} more"),
    "odd quotes": (f"<article title='a > b'><p data-x=\"<p>\">{A}</p><p class=>{C}</article>", f"{A} {C}"),
    "names in one word": (f'<article><div class="topnav">no</div><div id="sidebarRight">no</div><p>{A}</p><div class="commentForm">no</div><p class="community">{C}</p></article><div class="siteFooter">no</div>', f"{A} {C}"),
    "reader comments": (f'<article class="post"><p>{A}</p></article><section id="comments"><article class="comment"><p>{(B + " ") * 9}</p></article></section>', A),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_layouts(name):
    page, want = PAGES[name]
    assert pagetext.main_text(CHROME[0] + page + CHROME[1]) == want
    assert pagetext.main_text(page) == want


def test_broken_pages():
    text = pagetext.main_text
    assert text("") == "" and text("   ") == "" and text("plain, no tags") == "plain, no tags" and text("<p>a <b>b") == "a b"
    assert text("<p>a</p><!-- never ends <p>b</p>") == "a" and text("<p>a<script>never ends <p>b</p>") == "a" and text("a < b <3 c") == "a < b <3 c"
    assert text('<p>one</p><p class="unclosed>two</p><p>three</p>').startswith("one") and text("</p></div></td>x</article>") == "x"
    deep = "<div>" * 50_000 + "in, here" + "</div>" * 50_000
    assert text(deep) == "in, here"
    assert text("<a href=1" * 50_000) == "" and len(text("<p>" + "word, " * 400_000)) == 6 * 400_000 - 1


def test_op13_query(spark, sf_dir, tmp_path):
    got = {r["page_id"]: r for r in queries.op13_tree_scoring(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]
    rows = [(1, None, None), (None, "u", ""), (2, "u", f"<p>{A}</p>"), (2, "u", f"<p>{A}</p>")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("row", F.lit(1))
    assert sorted(r["n_chars"] for r in pagetext.main_texts(odd).collect()) == [0, 0, len(A), len(A)]
    assert pagetext.main_texts(odd.limit(0)).count() == 0
