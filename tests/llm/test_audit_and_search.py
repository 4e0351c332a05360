"""Source divergence, ranked search and HTML extraction against brute force."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import divergence, extraction, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 11: divergence ---------------------------------------------------------


def corpus():
    out = []
    for i in range(260):
        words = [f"{'abcdefgh'[(i * k + k * k) % 8]}{'xyzäßЖ日'[(i + k) % 7]}" for k in range(1 + i % 23)]
        lang = [None, "", "de", "en"][i % 4] if i % 13 else "xx"
        out.append((i, " ".join(words) + (" ÉCOLE Straße A" if i % 3 else "3 4_a"), lang, f"s{i * i % 5}" if i % 11 else None, None))
    out += [(1, None, "de", "only null", None), (1, "", "en", "only empty", None), (None, "1 2 3", "qq", "one", None)]
    out += [(2, "ax ax ax " * 4000, "en", "s1", None)] + [(3, "same text here", "de", "s4", None)] * 40
    return out


def brute_divergence(rows):
    docs = [((r[2] or ""), (r[3] or ""), LETTERS.findall((r[1] or "").translate(LOWER))) for r in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, c in df[lang].items() if c >= 30)
        sources = sorted((s for g, s in n if g == lang), key=str.encode)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept]

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[h])), h.encode()) for h in sources if h != s))
            out += [(lang, s, "pair", h.decode(), -v, k) for k, (v, h) in enumerate(pairs, 1)]
            terms = sorted((b - a, t.encode()) for a, b, t in zip(p[s], q, kept) if n[lang, s][t] and a > b)
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:50], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"leaves": 8, "side": 2, "most_held": 20}])
def test_divergence_is_exact(spark, how):
    rows = corpus()
    own = ("count", "docs", "term", "id", "g", "n", "v", "item", "value", "rank", "part", "block")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("own") for c in own})
    assert got(divergence.divergence(docs, **how)) == brute_divergence(rows)


def test_divergence_of_nothing(empty):
    assert got(divergence.divergence(empty)) == []


def test_trees_share_equal_subtrees():
    counts = np.zeros((3, 16), np.int64)
    counts[1, 5] = counts[2, 5] = counts[2, 13] = 7
    trees = divergence.CountTrees(counts)
    # Leaves 0 and 7; on every level one empty node and one for each content below.
    assert [len(left) for left, _ in trees.below] == [2, 2, 2, 3]
    a, b, places = trees.leaf_pairs(1, 2)
    assert sorted(zip(trees.values[a], trees.values[b], places)) == [(0, 0, 14), (0, 7, 1), (7, 7, 1)]
    at, a, b = trees.counted_leaves(2, 0)
    assert sorted(at) == [5, 13] and set(trees.values[a]) == {7}


def test_shares_are_exact_beyond_64_bits():
    n = 10**14
    assert divergence.share(np.array([n, 0, -1]), 3 * n, 7).tolist() == [1 + 10**9 * (n + 5) // (3 * n + 35), 1 + 5 * 10**9 // (3 * n + 35), 0]


# --- 12: ranked search ------------------------------------------------------


def brute_search(items, rows, top=10):
    bags = [(r[0], Counter(ALNUM.findall((r[1] or "").translate(LOWER)))) for r in rows]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        asked = Counter(ALNUM.findall(text.translate(LOWER)))
        found = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // length
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t, q in asked.items() if t in bag
            )
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, k, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [
    (1, "alpha3 alpha4 ALPHA4 one w3 w4"), (2, None), (3, ""), (4, "no such words"), (5, "one two two"), (5, "one two two"),
    (6, "w1 w2 w3 w4 w5 w5 w5"), (7, "日本 café naïve"), (None, "card 4111 mail w9"), (6, "word7919 x1"), (8, "x" * 70_000),
]


@pytest.mark.parametrize("most_sent,part_items", [(200_000, 256), (0, 3)])
def test_search_ranks_all_documents(spark, docs, odd, rows, most_sent, part_items):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("k", "part", "term", "q", "id")})
    want = brute_search(ITEMS, rows)
    assert got(ranked.search(items, docs, most_sent=most_sent, part_items=part_items)) == want
    assert got(ranked.search(items, odd, most_sent=most_sent, part_items=part_items)) == want


def test_search_with_small_blocks_ties_and_copies(spark):
    rows = [(i, "tie word " * (1 + i % 3) + f"w{i % 5} " * (i % 4), None, None, None) for i in range(300)]
    rows += [(1000 + i, "copy of one text", None, None, None) for i in range(100)] + [(7, "copy of one text", None, None, None)] * 12
    items = [(1, "tie"), (2, "word w3 w4"), (3, "copy text text"), (4, "one w1")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = ranked.search(spark.createDataFrame(items, "item_id long, text string"), docs, block_docs=7, block_hits=30)
    assert got(found) == brute_search(items, rows)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(ranked.search(items, empty)) == []
    assert got(ranked.search(items.limit(0), docs)) == []
    assert got(ranked.search(items.limit(0), docs, most_sent=-1)) == []


# --- 13: extraction ---------------------------------------------------------


def cost(gain, edges, label):
    return sum(-g if x else g for g, x in zip(gain, label)) + 2 * sum(w for a, b, w in edges if label[a] != label[b])


def test_minimum_cut_is_least():
    rnd = np.random.default_rng(3)
    for n in range(1, 11):
        for _ in range(25):
            gain = rnd.integers(-9, 10, n).tolist()
            edges = [(int(a), int(b), int(w)) for a, b, w in zip(rnd.integers(0, n, 2 * n), rnd.integers(0, n, 2 * n), rnd.integers(0, 9, 2 * n))]
            label = extraction.min_cut(gain, edges)
            least = min(cost(gain, edges, x) for x in itertools.product((False, True), repeat=n))
            assert cost(gain, edges, label) == least


P = "This is a paragraph of the story, with some words; it goes on and on. And then it ends here."
PAGES = {
    "article": (
        f"<html><head><title>T</title><style>p {{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a>"
        f"<li><a>About</a></ul></nav><div class=ad>Buy &amp; save now, it is cheap.</div><article><header><h1>The&nbsp;title</h1></header>"
        f"<p><b>{P}<br><p>Short.</p><script>var a = '</p>';</script><aside>{P}</aside><p title='a>b'>A &lt;tag&gt; &eacute; &copy 2 &#x41;</p></article>"
        f"<section id=comments><article class=comment><p>{P}</p></article></section><footer>&copy; all</footer></body></html>",
        f"The title\n{P}\nShort.\nA <tag> é © 2 A",
    ),
    "named": (
        f"<body><div id=top-menu><a>A</a> <a>B</a></div><div class='post-content'><h2>Title</h2><p>{P}<p>{P}<ul><li>one<li>two</ul>"
        f"<div class='ad-box'><p>{P}</p></div><p>End.</p></div><div class=sidebar><p>{P}</p></div><form><p>{P}<input name=a></form>"
        f"<div class=cookie-notice>We use cookies, as all do.</div><div class=comments><p>{P}</p></div></body>",
        f"Title\n{P}\n{P}\none\ntwo\nEnd.",
    ),
    "bare": (
        f"<div><a>Home</a> | <a>News</a> | <a>More</a></div><div><p>{P}</p><p>Yes.</p><p>{P}</p></div><div><a>Imprint</a></div>",
        f"{P}\nYes.\n{P}",
    ),
    "wrapped": (f"<form id=f><div class='layout-sidebar'><main><h1>T</h1><p>{P}</p></main></div></form>", f"T\n{P}"),
    "hidden": (f"<article><p>{P}</p><div hidden><p>{P}</p></div><div style='display: none'>{P}</div><noscript>{P}</noscript></article>", P),
    "cut": (f"<article><p>{P}</p><p>Next one &am", f"{P}\nNext one &am"),
    "cut in a tag": (f"<article><p>{P}</p><a href='x", P),
    "none": ("<nav><a>Home</a></nav>", ""), "blank": (" \n ", ""), "empty": ("", ""), "null": (None, ""),
    "long": ("<article>" + f"<p>{P}</p>" * 5000 + "</article>", "\n".join([P] * 5000)),
}


def test_extraction_of_known_pages(spark):
    rows = [(k, name, PAGES[name][0], "own") for k, name in enumerate(PAGES)]
    rows += [rows[0], (None, None, PAGES["named"][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("hash", F.lit("own"))
    want = [(r[0], r[1], PAGES[r[1] or "named"][1]) for r in rows]
    assert got(extraction.extract(pages)) == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert got(extraction.extract(pages.limit(0))) == []


def test_extraction_time_grows_with_the_page_only():
    for body in ("<a" * 100_000, '<a x=">"' * 50_000, '="' * 100_000, "<!--" * 50_000, "<li><ul>" + "<div>" * 30_000 + "<li></li>" * 30_000):
        assert extraction.main_text(body, extraction.START) == ""


def test_extraction_of_the_test_pages(spark, sf):
    import html

    from litmill.llm.common import table

    pages = table(spark, sf, "pages")
    found = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        main = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</h1>", main))
        assert found[r["page_id"]] == "\n".join(x for x in parts if x)
