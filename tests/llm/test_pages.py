"""Pages: main text, media sequences, url rules."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.llm import queries as Q
from storyloom.llm.html_text import Page, host_of, main_text, recurring, subtrees
from storyloom.llm.media import feature, figure_html, from_png, padded, resolved, sequence_of, sequences, text_media, to_png
from storyloom.llm.url_rules import fitting_rule, judged, matched, mined_rules, url_parts, url_tokens

PAGES = "page_id long, url string, html string, host string, subtree long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], PAGES)


# ---- main text ----


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  words &amp; more", "plain words & more"), ("<p>one<p>two<br>three<div>four</div>", "one\n\ntwo three\n\nfour"),
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c</p></article><footer>f</footer>", "T\n\na bc"), ("<article><p>x</p><aside>no</aside><form>no<input></form><p>y", "x\n\ny"),
        ("<body><header>site</header><div class='side-bar menu'>m</div><main>k</main><div>outside</div>", "k"), ("<article><header><h1>Title</h1></header><p>t</p></article>", "Title\n\nt"),
        ("<script>if (a<b) document.write('<p>x</p>')</script><p>y</p>", "y"), ("<style>p{}</style><!-- <p>no</p> --><p>y</p>", "y"), ("<p>cut here <a hre", "cut here"), ("<p>2 < 3 and 4 > 1</p>", "2 < 3 and 4 > 1"),
        ("<article><p>t</p><section class=comments><p>reader</p></section></article>", "t"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<title>no</title><p>a&nbsp;b&#233;&lt;i&gt;</p>", "a bé<i>"),
        ("<p>a<script>x", "a"), ("<P CLASS=x>up<BR/>per</P>", "up per"), ("<article>one</article><article>two</article>", "one\n\ntwo"), ("<p title='a>b'>q</p>", "q"), ("<div role=navigation>n</div><p>y</p>", "y"), ("</p></div>z", "z"),
        ("<head><title>t</title><body><p>b</p>", "b"), ("<p>&amp;amp; &ampx</p>", "&amp; &x"),
        ('<form id="f"><article><p>Main text here.</p></article><input><button>Go</button></form>', "Main text here."), ("<div class='overlay'><p>x</p><main><p>m</p></main></div>", "m"),
        ('<article><p>Main.</p><section><article class="comment"><p>Reader says hi</p></article></section></article>', "Main."), ("<article><p>Main.</p><div><article><p>Reader says hi</p></article></div></article>", "Main."),
        ("<article><article><h1>T</h1><p>inner</p></article></article>", "T\n\ninner"), ("<main><p>the text</p></main><aside><article><p>teaser</p></article></aside>", "the text"), ("<aside><article><p>only one</p></article></aside>", "only one"),
        ("<form><main><p>m</p><form><p>in it</p></form></main></form>", "m"), ("<article class=promo><p>all there is</p></article>", "all there is"),
    ],
)
def test_text_of_one_page(html, text):
    assert Page(html).text()[0] == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "x", " ", "<", "&", "<!--", "-->", "<script>", "</script>", "'", '"', "<a href='", ">", "<br", "é"]), max_size=25))
def test_any_markup_is_read(parts):
    p = Page("".join(parts))
    assert isinstance(p.text()[0], str) and len(p.hashes()) == len(p.tag)


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000, "<span>" * 100_000 + "</em>" * 100_000, "<em><div>" + "<span>" * 100_000 + "</em>" * 100_000, "<p><table><tr><td>" + "<div>" * 100_000, "<ul>" + "<li><span>" * 50_000, "<p><b>" * 50_000, "<article>" * 50_000, "<dl>" + "<dt><i><dd>" * 30_000],
)
def test_depth_costs_no_more_than_length(html):
    began = time.process_time()
    assert Page(html + "deep").text()[0].endswith("deep")
    assert time.process_time() - began < 4


def test_headings_between_texts_of_their_own_stay(spark):
    """20 recipes with equal headings and steps; 40 pages without marks, of which a fifth has a heading in common."""
    recipe = lambda i: f"<nav>menu</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>salt</li><li>thing {i}</li></ul><h2>Method</h2><p>Do number {i} with it</p></article>"
    got = main_text(pages(spark, [(i, f"http://r.example/{i}", recipe(i)) for i in range(20)])).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Dish {i}\n\nIngredients\n\nsalt\n\nthing {i}\n\nMethod\n\nDo number {i} with it" for i in range(20)}
    plain = lambda i: "<div>" + ("<h2>History</h2>" if i % 5 == 0 else "") + f"<p>Place {i} was founded in {1500 + i}.</p></div><div><h2>Also here</h2><p>Call the office today</p></div>"
    got = main_text(pages(spark, [(i, f"http://p.example/{i}", plain(i)) for i in range(40)])).collect()
    assert {r.page_id: r.text for r in got} == {i: ("History\n\n" if i % 5 == 0 else "") + f"Place {i} was founded in {1500 + i}." for i in range(40)}


def test_deep_and_long_pages():
    assert Page("<div>" * 30000 + "deep").text()[0] == "deep"
    t = "word " * 200000
    assert Page(f"<p>{t}</p>").text()[0] == t.strip()


def site(n, host="a.example.com"):
    return [(i, f"http://{host}/{i}", f"<div><p>Welcome to the site</p><p>Call us</p></div><div><p>Text number {i} here</p></div><p>Sign up today</p>") for i in range(n)]


def test_template_of_a_site_goes(spark):
    rows = [*site(12), (50, "http://b.example.com/1", "<p>Welcome to the site</p><p>own</p>"), (51, None, "<p>Welcome to the site</p>"), (52, "no host", "<p>Sign up today</p>")]
    for bound in (400_000, 0):  # by broadcast, and by the join
        got = {r.page_id: r.text for r in main_text(pages(spark, rows), bound).collect()}
        assert all(got[i] == f"Text number {i} here" for i in range(12))
        assert got[50] == "Welcome to the site\n\nown" and got[51] == "Welcome to the site" and got[52] == "Sign up today"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://c.example.com/{i}", "<p>One article</p><p>that is copied</p>") for i in range(30)] + [(100 + i, f"http://c.example.com/x{i}", f"<p>other {i}</p>") for i in range(8)]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert got[3] == "One article\n\nthat is copied"


def test_article_paragraphs_that_recur_stay(spark):
    rows = [(i, f"http://d.example.com/{i}", f"<article><p>{'Quoted often.' if i % 3 == 0 else f'own {i}'}</p><p>text {i}</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert got[3] == "Quoted often.\n\ntext 3"


def test_pages_odd_rows(spark):
    rows = [(1, "http://e/1", None), (1, "http://e/1", ""), (None, None, "<p>x</p>"), (2, "http://e/2", "<p>y</p>"), (2, "http://e/2", "<p>y</p>")]
    for bound in (400_000, 0):
        assert sorted((r.page_id or -1, r.text, r.n_chars) for r in main_text(pages(spark, rows), bound).collect()) == [(-1, "x", 1), (1, "", 0), (1, "", 0), (2, "y", 1), (2, "y", 1)]
    assert main_text(pages(spark, [])).count() == 0 and recurring(subtrees(pages(spark, []))).count() == 0
    assert [host_of(u) for u in ("HTTP://A.b/c", "//x", None, "a://B?x", "a://b#c", "x://u@H:8/y")] == ["a.b", "", "", "b", "b", "u@h:8"]


def plain_site(n, host, some=lambda i: True):
    """Pages that mark nothing: every part is a div, the site's parts are on those pages that ``some`` names."""
    parts = '<div><div>Home</div><div>News</div></div><div>We use small files to keep the site going</div>', '<div><div>All rights are ours</div><a>Terms</a></div>'
    story = lambda i: f"<div><div>Story {i} begins with words of its own {i * 7}</div><div>and ends {i * 13} pages later in the same way {i}</div></div>"
    text = lambda i: f"Story {i} begins with words of its own {i * 7}\n\nand ends {i * 13} pages later in the same way {i}"
    return [(i, f"http://{host}/{i}", (parts[0] if some(i) else "") + story(i) + (parts[1] if some(i) else "")) for i in range(n)], [text(i) for i in range(n)]


@pytest.mark.parametrize("every", [1, 2, 6])  # on all pages, on half of them and on 17 %
def test_counting_decides_where_pages_mark_nothing(spark, every):
    rows, wanted = plain_site(60, "plain.example.com", lambda i: i % every == 0)
    on = {r.page_id: r for r in main_text(pages(spark, rows)).collect()}
    off = {r.page_id: r for r in main_text(pages(spark, rows), counting=False).collect()}
    bearing = [i for i in range(60) if i % every == 0]
    assert sum(on[i].text != off[i].text for i in bearing) > 0.9 * len(bearing) and all(on[i].n_template > 0 for i in bearing)
    assert [on[i].text for i in range(60)] == wanted and all(r.n_template == 0 for r in off.values())


def test_real_pages_without_their_marks(spark):
    """The given pages with article, nav, footer and class taken away: only recurrence can tell the site's parts."""
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)>", "<$1div>"), 'class="ad"', "")
    some = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where(F.expr("url like '%://blog.tionsh.example.com/%'"))
    on = {r.page_id: r for r in main_text(some.withColumn("html", bare)).collect()}
    off = {r.page_id: r for r in main_text(some.withColumn("html", bare), counting=False).collect()}
    bearing = [i for i, r in on.items() if r.n_template]
    assert len(bearing) > 0.5 * len(on) and sum(on[i].text != off[i].text for i in bearing) > 0.9 * len(bearing)
    whole = {r.page_id: r.text for r in main_text(some).collect()}
    lost = [i for i, t in whole.items() if not set(t.split("\n\n")) <= set(on[i].text.split("\n\n"))]
    assert len(lost) < 0.05 * len(whole)


def test_both_ways_agree_on_ids_that_repeat(spark):
    a, _ = plain_site(20, "a.example.com")
    rows = [*((i if i % 3 else None, u, h) for i, u, h in a), *((i, f"http://b.example.com/{i}", a[0][2]) for i in (0, 1, None))]
    by = [sorted((r.page_id is None, r.page_id or 0, r.url, r.text, r.n_template) for r in main_text(pages(spark, rows), bound).collect()) for bound in (400_000, 0)]
    assert by[0] == by[1] and sum("We use small files" in r[3] for r in by[0]) == 3


def test_words_of_a_compound_mark_nothing():
    page = '<article><p id="comment-on-policy">Main text.</p><div class="social-history">Then.</div><p class="alert">Do this.</p><p>rest</p></article>'
    assert Page(page).text()[0] == "Main text.\n\nThen.\n\nDo this.\n\nrest"
    assert Page('<article><p>t</p><div class="box ad">buy</div></article>').text()[0] == "t"


class Naive(HTMLParser):
    """A tree of nested lists: tag, attributes, children; the pages of the given tables close all but b, br and p."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.root = ["#", "", []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "div", "ul", "article", "footer", "nav", "h1") and any(n[0] == "p" for n in self.stack):
            self.handle_endtag("p")
        node = [tag, " ".join(f"{k}={v}" for k, v in attrs if k in ("class", "id", "role")), []]
        self.stack[-1][2].append(node)
        if tag not in ("br", "meta"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)

    handle_entityref = lambda self, name: self.stack[-1][2].append(f"&{name};")
    handle_charref = lambda self, name: self.stack[-1][2].append(f"&#{name};")


def naive_blocks(node, gone):
    parts = []

    def walk(n):
        if isinstance(n, str):
            parts.append(n)
        elif not gone(n):
            edge = "\0" if n[0] in ("p", "li", "ul", "div", "article", "footer", "nav", "h1", "body", "html", "head") else " " if n[0] == "br" else ""
            parts.append(edge)
            for c in n[2]:
                walk(c)
            parts.append(edge)

    walk(node)
    return [b for b in (" ".join(unescape(x).split()) for x in "".join(parts).split("\0")) if b]


def naive_texts(rows):
    """Main text of pages that all mark an article: what recurs in 60 % of a host's stories goes, in and out of it."""
    trees = {i: Naive(h or "") for i, _, h in rows}
    nodes = lambda n: [n, *(x for c in n[2] if not isinstance(c, str) for x in nodes(c))]
    raw = lambda n: n[0] in ("script", "style", "title")
    stories = {i: tuple(sorted(naive_blocks(t.root, raw), key=lambda b: (-len(b), b))[:4]) for i, t in trees.items()}
    seen, sizes = {}, {}
    for i, url, _ in rows:
        sizes.setdefault(host_of(url), set()).add(stories[i])
        for n in nodes(trees[i].root):
            seen.setdefault((host_of(url), repr(n)), set()).add(stories[i])
    out = {}
    for i, url, _ in rows:
        article = next(n for n in nodes(trees[i].root) if n[0] == "article")
        often = lambda n, h=host_of(url): len(seen[h, repr(n)]) >= max(4, 0.6 * len(sizes[h])) and n[0] not in ("article", "b", "a")
        out[i] = "\n\n".join(naive_blocks(article, lambda n: raw(n) or often(n) or n[0] in ("nav", "footer")))
    return out


def test_query_agrees_with_a_naive_version(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert {r.page_id: r.text for r in Q.op2_html_text(spark, "/root/testdata/sf0.01").collect()} == naive_texts(rows)


def test_query_gives_the_articles(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    html = {r.page_id: (r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    checked = 0
    for r in Q.op2_html_text(spark, "/root/testdata/sf0.01").collect():
        url, page = html[r.page_id]
        if "</article>" in page and "&" not in page.split("</h1>")[0].split("<h1>")[1]:
            lines = docs[int(re.search(r"/(\d+)(?:\.html)?/?(?:[?#]|$)", url)[1])].split("\n")
            want = [" ".join(lines[0][:60].split()), *(" ".join(x.split()) for x in lines)]
            assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)
            checked += 1
    assert checked > 150


# ---- media ----


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_image_round_trip(raw):
    p = padded(raw)
    assert len(p) % 576 == 0 and len(p) > 0 and p[: len(raw)] == raw and set(p[len(raw) :]) <= {255} and len(p) - len(raw) <= 576
    assert from_png(to_png(p)) == p and feature(p) == feature(bytes(p))


def test_damage_is_found():
    image = bytearray(to_png(padded(b"abc" * 400)))
    for at in (0, 20, 45, len(image) - 3):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(Exception):  # noqa: B017
            from_png(bytes(bad))


def test_sequence_keeps_order_and_captions():
    html = "<p>one &amp; <b>two</b></p><figure><img alt=alt src='sha256:AB'><figcaption>the <i>cap</i>tion</figcaption></figure>three<img src=sha256:cd alt=\"own\"><script>no</script><img src=http://x>four<video src=\"sha256:ef\"></video>"
    got = [(i["pos"], i["kind"], i["text"], i["digest"], i["caption"]) for i in sequence_of(html)]
    assert got == [
        (0, "text", "one & two", None, None), (1, "media", None, "ab", "the caption"), (2, "text", "three", None, None), (3, "media", None, "cd", "own"), (4, "text", "four", None, None), (5, "media", None, "ef", None),
    ]
    assert sequence_of(None) == [] and sequence_of("<figure>") == []


def test_references_meet_payloads(spark):
    d = spark.createDataFrame([(1, "x<img src=sha256:aa>y<img src=sha256:zz>"), (2, "<img src=sha256:aa>"), (3, None)], "k long, html string")
    p = spark.createDataFrame([("aa", 10), ("bb", 20)], "digest string, size int")
    got = sorted((r.k, r.pos, r.kind, r.size) for r in resolved(sequences(d, "k"), "k", p).collect())
    assert got == [(1, 0, "text", None), (1, 1, "media", 10), (1, 2, "text", None), (1, 3, "media", None), (2, 0, "media", 10)]


def test_texts_as_media(spark):
    rows = [(1, None), (2, ""), (3, "né" * 400), (4, "né" * 400), (4, "né" * 400), (None, "z" * 576), (5, "<p>&amp;</p>" * 5000)]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, media string")
    got = text_media(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw, r = (t or "").encode(), by[i]
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = to_png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(m), hashlib.sha256(m).hexdigest(), feature(p))
        assert r.position == 0 and r.caption == f"document {'' if i is None else i}, {len(raw)} bytes"
    assert text_media(d.limit(0)).count() == 0
    assert spark.range(1).select(figure_html(F.lit("aa"), F.lit("c")).alias("h")).first().h == '<figure><img src="sha256:aa"><figcaption>c</figcaption></figure>'


# ---- urls ----

RULES = Q.URL_RULES


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda f: len(f[0])) if fit else (None, None))


URLS = [
    None, "", "nothing", "http://a.NET/", "http://net", "http://example.net/en/1", "http://x.example.net/en", "https://b.example.net/fr/?en/", "http://example.com/de/2#x", "http://badexample.com/de/", "http://m.example.com/de", "ftp://a.org/fr/x",
    "http://org/fr/", "a://b://net/c", "://net/x", "http://é.net/ü", "http://a.net?x/", "http://a.net#/", "http://A.Example.Com/DE/",
]


def test_rules_and_parts(spark):
    d = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = url_parts(F.col("url"))
    rows = d.select("page_id", host.alias("h"), path.alias("p")).withColumn("f", fitting_rule(F.col("h"), F.col("p"), RULES)).collect()
    for r in rows:
        assert (r.h, r.p, r.f.rule if r.f else None, r.f.verdict if r.f else None) == plain_judge(URLS[r.page_id]), URLS[r.page_id]


def labelled(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bad = r.random() < 0.4
        out.append((f"http://{'m' if r.random() < 0.5 else 'www'}.{'casino-win' if bad else 'garden'}.example.{r.choice(['com', 'org'])}/{r.choice(['en', 'de'])}/{r.randrange(99)}{'?ref=1' if r.random() < 0.3 else ''}", "block" if bad and r.random() < 0.9 else "allow"))
    return out


def wilson(p, m, z):
    return (p + z * z / (2 * m) - z * math.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m)


def naive_rules(rows, confidence=0.2, lift=1.02):
    """All sets of tokens that some url of ``(url, tokens, verdict)`` has, counted one by one; they must hold on the third of the urls that is held out."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    held = [(t, v) for u, t, v in rows if signed(xxhash.xxh64_intdigest(u.encode(), 42)) % 3 == 0]
    sets = [(t, v) for u, t, v in rows if signed(xxhash.xxh64_intdigest(u.encode(), 42)) % 3]
    n, base, have = len(sets), Counter(v for _, v in sets), Counter()
    both = Counter()
    for tokens, v in sets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                have[frozenset(c)] += 1
                both[frozenset(c), v] += 1
    found = {}
    for (tokens, v), hit in both.items():
        p, rate, m = hit / have[tokens], base[v] / n, have[tokens]
        sure = (wilson(p, m, 1) - rate) / (1 - rate)
        others = [w == v for t, w in held if tokens <= t]
        if not others or wilson(sum(others) / len(others), len(others), 1.64) <= sum(w == v for _, w in held) / len(held):
            continue
        if hit >= max(math.ceil(0.002 * n), 10) and p >= confidence and p / rate >= lift and sure > 0:
            found[tokens, v] = (p, hit / n, p / rate, sure)
    return {k: f for k, f in found.items() if not any(t < k[0] and v == k[1] and g[3] >= f[3] for (t, v), g in found.items())}


def test_mined_rules_by_brute_force(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "url string, verdict string")
    sets = [(frozenset(r.t), v) for r, (_, v) in zip(df.select(url_tokens(F.col("url")).alias("t")).collect(), rows)]
    rules = mined_rules(df).collect()
    assert rules and {"name=casino"} in [set(r.tokens) for r in rules if r.verdict == "block"]
    naive = naive_rules([(u, s, v) for (u, _), (s, v) in zip(rows, sets)])
    assert {(frozenset(r.tokens), r.verdict) for r in rules} == set(naive) and {r.verdict for r in rules} == {"allow", "block"}
    for r in rules:
        assert (r.confidence, r.support, r.lift, r.certainty) == pytest.approx(naive[frozenset(r.tokens), r.verdict]) and r.under in r.tokens
    # every url's verdict is that of the surest of the rules that fit it, found without the index
    tokens = dict(zip((u for u, _ in rows), (s for s, _ in sets)))
    for m in matched(df, spark.createDataFrame(rules)).collect():
        fit = [r for r in rules if set(r.tokens) <= tokens[m.url]]
        best = max(fit, key=lambda r: (r.certainty, r.confidence, r.support, len(r.tokens), r.verdict == "allow", r.tokens))
        assert (m.mined.verdict, m.mined.tokens, m.mined.lift) == (best.verdict, best.tokens, best.lift)
    assert {m.url for m in matched(df, spark.createDataFrame(rules)).collect()} == {u for u, s in tokens.items() if any(set(r.tokens) <= s for r in rules)}


def test_rules_by_chance_are_dropped(spark):
    """Labels drawn without a look at the url teach nothing, however many sets of tokens are tried; on the given pages a rule is kept only if it beats the rate of its label on urls that it wasn't mined from."""
    r = random.Random(9)
    kept = mined_rules(spark.createDataFrame([(u, "block" if r.random() < 0.15 else "allow") for u, _ in labelled(1500, 4)], "url string, verdict string")).collect()
    assert len(kept) <= 2
    sf = "/root/testdata/sf0.1"
    pages_, labels = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf}/labels.parquet")
    number = F.regexp_extract(url_parts(F.col("url"))[1], "([0-9]{1,18})(?:[.][a-z]+)?/?$", 1).try_cast("long")
    known = pages_.withColumn("of", number).join(labels.where("quality is not null"), F.col("of") == F.col("doc_id")).select("url", F.when(F.col("quality") == 0, "block").otherwise("allow").alias("verdict"))
    assert all(x.held_confidence > x.held_rate for x in mined_rules(known).collect())


def test_judged_rows(spark):
    mined = mined_rules(spark.createDataFrame(labelled(), "url string, verdict string"))
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100, "http://casino-win.example.com/en/5"), (101, "http://garden.example.com/en/5"), (101, "http://garden.example.com/en/5"), (None, "http://casino-win.example.net/en/1")]
    d = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in rows], "page_id long, url string, verdict string, host string, mined string")
    got = judged(d, RULES, mined).collect()
    assert len(got) == len(rows)
    v = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for i, u in enumerate(URLS):
        assert v[i][:3] == plain_judge(u)[:3] and v[i][3] == (plain_judge(u)[3] or v[i][3])
    assert v[100] == ("casino-win.example.com", "/en/5", None, "block") and v[101][3] == "allow" and v[None][2:] == ("example.net/en/", "allow")
    assert judged(d.limit(0), RULES, mined).count() == 0


def test_nothing_labelled(spark):
    none = mined_rules(spark.createDataFrame([], "url string, verdict string"))
    assert none.count() == 0
    d = spark.createDataFrame([(1, "http://a.xyz/")], "page_id long, url string")
    assert judged(d, RULES, none).first().verdict == "allow"
    assert mined_rules(spark.createDataFrame([(None, "block"), ("http://a/", None)], "url string, verdict string")).count() == 0


def test_rules_of_both_sides_decide_at_scale(spark):
    """100,000 urls of which a seventh is to be blocked: a word that doubles or trebles that share blocks, one that lowers it allows, others leave it to the base rate."""
    n = F.col("id")
    word = F.element_at(F.array(*(F.lit(w) for w in ("casino", "pills", "garden", "news", "shop"))), (n % 5 + 1).cast("int"))
    bad = F.pmod(F.xxhash64(n), F.lit(100)) < F.element_at(F.array(*(F.lit(x) for x in (45, 30, 1, 2, 2))), (n % 5 + 1).cast("int"))
    urls = spark.range(100_000).select(
        n.alias("page_id"), F.concat(F.lit("http://"), word, F.lit("-"), (n % 7).cast("string"), F.lit(".example.biz/x"), (n % 1000).cast("string"), F.lit("/")).alias("url"), F.when(bad, "block").otherwise("allow").alias("verdict")
    )
    got = judged(urls, RULES, mined_rules(urls)).groupBy("verdict", F.regexp_extract("host", "^[a-z]+", 0).alias("word"), F.col("mined_rule").isNotNull().alias("by_rule")).count().collect()
    assert {(r.word, r.verdict) for r in got if r.by_rule} == {("casino", "block"), ("pills", "block"), ("garden", "allow"), ("news", "allow"), ("shop", "allow")} and all(r.by_rule for r in got)


def test_query_of_urls_by_brute_force(spark, tables):
    """The whole query on a small fixture: fixed rules first, then the naive rules of the labelled pages."""
    r = random.Random(5)
    words = ["casino", "garden", "news"]
    urls = [f"http://{r.choice(words)}.example.{r.choice(['com', 'org', 'net'])}/{r.choice(['en', 'fr', 'de'])}/{i}{r.choice(['', '.html', '/'])}" for i in range(600)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(700, None), (701, "nothing")]
    quality = [(i, 0 if ("casino" in u) == (r.random() < 0.7) else 1, 0) for i, u in enumerate(urls) if i % 3]
    folder = tables(pages=spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string"), labels=spark.createDataFrame(quality, "doc_id long, quality int, toxic int"))
    split = {u: frozenset(t.t) for u, t in zip(urls, spark.createDataFrame([(u,) for u in urls], "url string").select(url_tokens(F.col("url")).alias("t")).collect())}
    known = naive_rules([(urls[i], split[urls[i]], "allow" if q else "block") for i, q, _ in quality])
    for row in Q.op10_url_filter(spark, folder).collect():
        url = dict(rows)[row.page_id]
        host, path, rule, verdict = plain_judge(url)
        fit = [(f[3], f[0], f[1], len(t), v == "allow", sorted(t), v) for (t, v), f in known.items() if t <= split.get(url, frozenset())]
        if rule is None:
            best = max(fit) if fit else None
            verdict = best[-1] if best else "allow"
            assert row.mined_rule == (" ".join(best[5]) if best else None)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)
