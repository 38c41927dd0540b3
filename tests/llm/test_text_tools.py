"""HTML extraction, ranked search and fill-in-the-middle against plain forms, and their results for odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from listingwatch.llm import fill_middle, html_text, lexical_search, queries

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, n_chars int"
DOCS = "doc_id long, text string, score long, rank int, item string"

# 11 -- main text of pages

FRAME = (
    '<nav><ul><li><a href="/a">Shop</a></li><li><a href="/b">Help and service for customers</a></li></ul></nav>'
    '<header class="top">A slogan that is longer than many a paragraph of the page</header><div id="cookie-notice">We use cookies to make this site work for you.</div>'
)
AFTER = (
    '<aside><p>Most read: something that stands in the sidebar and is not short either.</p></aside><form><p>Write to us</p><input name="q"></form>'
    '<section class="comments"><p>First! A reader writes a long comment on the article, longer than the article itself is by far.</p></section>'
    "<footer>&copy; nobody &middot; all rights reserved</footer><script>document.write('<p>no text</p>')</script>"
)


def page(article, before=FRAME, after=AFTER):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("just words &amp; a &lt;tag&gt;", "just words & a <tag>"),
        (page(""), ""),
        ('<body><ul><li><a href="/">one</a></li><li><a href="/x">two</a></li></ul></body>', ""),
        (page("<article><h1>Title</h1><p>One\n  line</p><p>Two <b>bold</b> and <a href='/'>linked</a></p></article>"), "Title\n\nOne line\n\nTwo bold and linked"),
        (page("<div class='entry'><h2>Title</h2><p>First paragraph, of some length.<p>Second, whose end is missing.<br>Next line</div>"), "Title\n\nFirst paragraph, of some length.\n\nSecond, whose end is missing. Next line"),
        (page("<article><header><h1>In the article</h1></header><p>Of.</p><p>Short.</p></article>"), "In the article\n\nOf.\n\nShort."),
        (page("<main><section><p>Part one is the longer part of the two parts here.</p></section><section><p>Part two is shorter.</p></section></main>"), "Part one is the longer part of the two parts here.\n\nPart two is shorter."),
        (page("<article><p>Before<div class='ad'>Buy this now, it is cheap</div><p>after</article>"), "Before\n\nafter"),
        ("<body><article><p>cut off in the mid", "cut off in the mid"),
        ("<body><p>cut off <b>in a tag</p><p>more<", "cut off in a tag\n\nmore<"),
        (page("<article><p>a &amp;amp; b &#233; &eacute;</p></article>"), "a &amp; b é é"),
        (page("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>a\n  b</pre></article>"), "one\n\ntwo\n\nx\n\ny\n\na b"),
    ],
)
def test_pages_by_hand(html, text):
    assert html_text.main_text(html) == text


def test_deep_and_long_pages_end():
    deep = "<div>" * 20_000 + "<p>down here</p>"
    assert html_text.main_text(deep) == "down here"
    long = page("<article>" + "<p>" + "word " * 200_000 + "</p>" + "</article>")
    assert len(html_text.main_text(long)) == 5 * 200_000 - 1


def test_articles_of_the_table_are_found_whole(spark):
    """The table's pages hold one article element: the text is that element's, though the method doesn't look for it."""
    rows = queries.op11_html_extraction(spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if x == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_density_alone_tells_article_from_links(spark):
    """Without names and frame elements, in one flat page of divs."""
    links = "".join(f"<div><a href='/{i}'>a link with several words in it</a></div>" for i in range(30))
    text = "".join(f"<p>Paragraph {i} says something about a matter in a sentence or two, as articles do.</p>" for i in range(5))
    found = html_text.main_text(f"<body><div>{links}</div><div>{text}</div></body>")
    assert found.count("Paragraph") == 5 and "a link" not in found


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None, "clash", 3), (1, "u", "<p>x</p>", None, None), (1, "u", "<p>x</p>", None, None), (None, None, "<p>y</p>", None, None)]
    out = html_text.extract(spark.createDataFrame(rows, PAGES))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, out.collect())) == Counter([(1, "u", "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (None, None, "y", 1)])
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


# 12 -- ranked search


def ranked_plain(docs, items, k):
    """Every item against every document, term by term."""
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

    def terms(text):
        return term.findall((text or "").translate(lower))

    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item_id, text in {x for x in items if x[1] is not None}:
        scored = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for place, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item_id, place, None if null else i, -score] += 1
    return out


def searched(spark, docs, items, k, **small):
    before = {n: getattr(lexical_search, n) for n in small}
    try:
        for n, v in small.items():
            setattr(lexical_search, n, v)
        made = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in docs], DOCS).repartition(3)
        return Counter(map(tuple, lexical_search.rank(made, spark.createDataFrame(items, "item_id long, text string"), k).collect()))
    finally:
        for n, v in before.items():
            setattr(lexical_search, n, v)


def test_search_equals_plain_ranking(spark):
    rng = random.Random(8)
    words = ["the", "of", "Ünder", "日本", "x42", "it's", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choices(words, weights=[40, 30] + [3] * 64, k=rng.choice([0, 1, 3, 10, 40, 400])))) for i in range(600)]
    docs += [(i + 600, docs[i][1]) for i in range(100)]  # ties
    docs += [(5, None), (5, ""), (None, "w1 w2 THE"), (7, docs[7][1]), (9999, "w3 " * 60_000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)] + [(3, "w5 w6"), (3, "w5 w6"), (40, None), (41, ""), (42, "nowhere"), (None, "of w9"), (43, "the of")]
    for small in ({}, {"BLOCK_DOCS": 50, "FIRST_STRATA": 1}, {"BLOCK_POSTINGS": 300, "ITEMS": 7, "PIECE": 5}):
        assert searched(spark, docs, items, 10, **small) == ranked_plain(docs, items, 10)


def test_strata_that_cannot_win_are_not_visited():
    """A stratum whose bound is below the k-th score adds nothing, and its postings are not summed up."""
    import numpy as np

    lengths = np.array([10] * 5 + [5000] * 5)
    block = lexical_search.Strata(lengths, np.zeros(10, np.int32), np.ones(10, np.int32), np.arange(10, dtype=np.int32), np.array([1000]), 10, int(lengths.sum()))
    visited = []
    real = lexical_search.spans
    lexical_search.FIRST_STRATA, before = 1, lexical_search.FIRST_STRATA
    try:
        lexical_search.spans = lambda a, b: visited.append(int((b - a).sum())) or real(a, b)
        scores, ids = block.best(np.array([0]), 3, (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.arange(10))
    finally:
        lexical_search.spans, lexical_search.FIRST_STRATA = real, before
    assert list(ids) == [0, 1, 2] and len(set(scores)) == 1
    assert visited == [2, 5]  # the item's two lists, then the five postings of the short documents alone


def test_search_of_empty_tables(spark):
    assert not searched(spark, [], [(1, "a")], 5)
    assert not searched(spark, [(1, "a")], [], 5)
    assert not searched(spark, [(1, None)], [(1, "a")], 5)


# 13 -- fill in the middle


def cut_plain(doc_id, text, units, rate=100, spm=50, seed=7):
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if units == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(parts)
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units, options", [("line", {}), ("char", {}), ("line", {"rate": 40, "spm_rate": 90, "seed": 3})])
def test_fill_in_middle_equals_plain_cuts(spark, units, options):
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\na", "has <P> in it", "<S>", "ends with <", "<P", "é😀\n" * 50, "x" * 100_000, "l\n" * 30_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "😀", "word ", "<", "S>", "\r\n", "\x00"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, 1, 1, "x") for i, t in enumerate(texts)] + [(9, "a\nb", 0, 0, ""), (9, "a\nb", 0, 0, ""), (None, "a\nb\nc", 0, 0, "")]
    made = fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame(rows, DOCS), units, **options)).collect()
    names = {"rate": "rate", "spm_rate": "spm", "seed": "seed"}
    expected = Counter(cut_plain(r[0], r[1], units, **{names[k]: v for k, v in options.items()}) for r in rows)
    assert Counter(tuple(r)[:6] for r in made) == expected
    by_output = defaultdict(set)
    for r in rows:
        by_output[cut_plain(r[0], r[1], units, **{names[k]: v for k, v in options.items()})[::5]].add(r[1] or "")
    assert all({r["restored"]} == by_output[r["doc_id"], r["output"]] for r in made)


def test_skip_list_reaches_every_rank():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 64, 1000):
        import numpy as np

        widths = np.array([rng.randrange(1, 9) for _ in range(n)])
        lanes = fill_middle.SkipList(widths)
        assert [lanes.offset(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        assert all(int(u.sum()) == n and int(p.sum()) == int(widths.sum()) for u, p, _, _ in lanes.lanes)
    assert len(lanes.lanes) > 3


def test_fill_in_middle_of_an_empty_table(spark):
    assert fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame([], DOCS))).count() == 0
    assert spark.createDataFrame([("psm", "<P>a<S>c<M>b")], "form string, output string").transform(fill_middle.restore).select(F.col("restored")).first()[0] == "abc"
