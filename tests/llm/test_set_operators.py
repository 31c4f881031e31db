"""Near duplicates, pages, conversations, language models, neighbours, the pipeline: against brute force, and odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docmill.llm import ann, brown_lm, chat, html_extract, queries, simhash
from tests.llm.conftest import SF


def naive_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [a + b" " + b for a, b in zip(w, w[1:])] or w
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def naive_groups(fps, ids):
    n = len(fps)
    near = [[j for j in range(n) if j != i and bin(fps[i] ^ fps[j]).count("1") <= 6] for i in range(n)]
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in near[i]:
            comp[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], f"{fps[i]:016x}", len(near[i]), least.get(find(i))) for i in range(n)]


order = lambda rows: sorted(rows, key=repr)


def test_fingerprints_link_as_brute_force(docs, rows):
    fps = [naive_fingerprint(t) for _, t, _ in rows]
    got = [tuple(r[c] for c in ("doc_id", "fingerprint", "n_near", "component_id")) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order(naive_groups(fps, [i for i, _, _ in rows]))


@pytest.mark.parametrize("chain", [1, 2, 3])
def test_pigeonring_loses_no_link(spark, chain):
    r = random.Random(chain)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # walks of a few bits each, so that pairs at 0 to 12 bits abound
        f = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 7)):
            f ^= 1 << b
        fps.append(f)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = simhash.links(spark.createDataFrame([(f, 1) for f in signed], "fp long, n long"), chain).collect()
    pairs = [frozenset((x["a"], x["b"])) for x in got]
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(501, 560)] + [(700, 700 + 1)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 500 for i in range(500, 560)}, 700: 700, 701: 700}


def test_near_duplicate_query(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = [tuple(r[c] for c in ("doc_id", "fingerprint", "n_near", "component_id")) for r in queries.op2_simhash_near_dedup(spark, SF).collect()]
    assert order(got) == order(naive_groups([naive_fingerprint(r["text"]) for r in t], [r["doc_id"] for r in t]))


def test_hot_fingerprints_and_chains_change_nothing(docs, rows):
    want = order(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert want == order(tuple(r) for r in simhash.near_duplicates(docs, chain=3, hot_rows=1).collect())
    assert [simhash.best_chain(n) for n in (0, 10**6, 10**9)] == [2, 2, 3]


def test_tables_of_nodes_and_links_are_not_broadcast(spark, docs, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keep = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: plans.append((name, plan(df))) or keep(df, name))
    last = plan(simhash.near_duplicates(keep(docs.select("doc_id", "text"), "docs")))
    assert {"links", "edges", "joined"} <= {name for name, _ in plans}
    assert [name for name, p in plans if "BroadcastExchange" in p] == []
    assert last.count("BroadcastHashJoin") == 1  # hot fingerprints


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p > b {}</style></head><body class="home">
<header class="site-header"><a href="/">Home</a> Big Site</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all, please, now.</div><aside class=sidebar><p>Popular: a long enough sentence about other things.</p></aside>
<main><article><header><h1>A &amp; B&nbsp;title</h1></header><p>First   para with <b>bold</b> and a<br>break &lt;tag&gt; &#233;&#x1F600;.<p>Second para, rather longer than the first one is.
<script>document.write("<p>no</p>")</script><div class="ad">Buy this now, it is on sale today!</div><ul><li>Item one of the list</li><li>Item two</li></ul>
<form><label>Mail</label><input name=q><button>Send</button></form><blockquote>Quoted <a href="z">with a link</a> inside of it.</blockquote></article>
<section id="comments"><h2>Comments</h2><p>I am a reader and I liked this article very much.</p></section></main>
<footer>&copy; 2024 Big Site. All rights reserved.</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "\n\n".join(["A & B title", "First para with bold and a break <tag> é\U0001f600.", "Second para, rather longer than the first one is.", "Item one of the list", "Item two", "Quoted with a link inside of it."])
    plain = "<p>" + "A text with sentences, and without any article. " * 3 + "</p>"
    assert html_extract.main_text(f"<nav><a href=a>Menu</a></nav>{plain}") == ("A text with sentences, and without any article. " * 3).strip()
    for empty in (None, "", "<p> </p>", "<nav><a href=a>Menu</a></nav>", "<!-- x", "<script>x"):
        assert html_extract.main_text(empty) == ""
    assert html_extract.main_text("<article><p>" + "x" * 200_000 + ".</p><p>Unclosed <b>tail.").endswith("\n\nUnclosed tail.")


STORY = ["A first paragraph of the story, with a few clauses, long enough to count.", "Short one.", "Third paragraph, which ends here after some words."]
_P = "".join(f"<p>{p}</p>" for p in STORY)


@pytest.mark.parametrize("html", [
    f'<div id="topnav"><a href=a>Home</a> <a href=b>News</a></div><div class="header"><h2>Site name</h2></div><div id="content"><h1>Big title</h1>{_P}</div><div id="right-col"><p>Subscribe to our newsletter for weekly updates, it is free.</p></div><div class="comments"><p>Nice article, I liked reading it a lot.</p></div><div id="pagefooter">Copyright 2024, all rights reserved.</div>',
    f'<ul class="menu"><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Big title</h1>{_P}<form action=x><p>Your name</p><input></form><p class="notice">This site uses cookies, please accept them all.</p>',
    f"<article><h1>Big title</h1>{_P}<section><h2>3 Comments</h2><p>bob: I disagree with this article, sorry to say.</p><p>ann: me too.</p></section></article>",
    f"<main><h1>Big title</h1>{_P}<h3>Comments</h3><p>bob: I disagree with this article, sorry to say.</p></main>",
    f'<article><div class="article-header"><h1>Big title</h1></div><div class="entry-content">{_P}<div class="share-buttons"><a href=x>Share</a></div><div class="advertisement">Buy now, today only, at a low price!</div></div></article><div class="related"><p>Related: another story that you may like to read.</p></div>',
    f'<div role="banner"><h2>Site</h2></div><div role="main"><h1>Big title</h1>{_P}</div><div role="complementary"><p>Trending: a sentence of some length, for the sidebar.</p></div><div role="contentinfo"><p>Contact us by mail, we reply soon.</p></div>',
    f'<article><h1>Big title</h1><p style="display:none">Hidden text that nobody should ever see here.</p>{_P}<div hidden><p>More hidden.</p></div></article>',
])
def test_templates(html):
    assert html_extract.main_text(f"<html><body>{html}</body></html>") == "\n\n".join(["Big title", *STORY])


@pytest.mark.parametrize("name", ["overflow-hidden", "has-sidebar", "no-sidebar", "sidebar-right", "comments-open", "post tag-politics", "sidebar", "x hidden"])
def test_layout_wrappers_keep_their_article(name):
    want = "\n\n".join(["Big title", *STORY])
    assert html_extract.main_text(f'<body><div class="{name}"><article><h1>Big title</h1>{_P}</article></div></body>') == want
    assert html_extract.main_text(f'<body><div class="{name}"><h1>Big title</h1>{_P}</div><div class="related"><p>Read this other story, too.</p></div></body>') == want


def test_cues_are_outweighed_by_long_text_only():
    story, aside = "A sentence of the story, with clauses. " * 30, "Buy this now, it is on sale today!"
    page = f'<main><p>{story}</p><div class="notice"><p>{story}</p></div><div class="ad">{aside}</div><div class="related"><article><p>{aside}</p></article></div></main>'
    assert html_extract.main_text(page) == "\n\n".join([story.strip()] * 2)


def test_readers_heading_marks_what_follows_it_only():
    body = "A body of the post, lying directly in its element, long enough to count."
    readers = "<p>bob: I disagree, sorry to say.</p>"
    assert html_extract.main_text(f'<body><div class="post">{body}<br>More of it.<h3>Comments</h3>{readers}</div></body>') == f"{body} More of it."
    for word in ("Response", "Comment", "Comments"):
        got = html_extract.main_text(f"<article><h1>Big title</h1><p>{body}</p><h2>{word}</h2>{readers}<h3>Lower</h3>{readers}<h2>Next section</h2>{_P}</article>")
        assert got == "\n\n".join(["Big title", body, "Next section", *STORY])
    long = "A section of the article that is headed so, in whole sentences. " * 20
    assert long.strip() in html_extract.main_text(f"<article><h1>Big title</h1><p>{body}</p><h2>Response</h2><p>{long}</p></article>")


def test_cut_is_minimum():
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(1, 8)
        costs = [r.choice([-2, -1, -0.5, 0.5, 1, 2]) + r.random() / 10 for _ in range(n)]
        edges = [(a, b, r.random() * 2) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        paid = lambda ls: sum(-c if c < 0 and l else c if c > 0 and not l else 0 for c, l in zip(costs, ls)) + sum(w for a, b, w in edges if ls[a] != ls[b])  # noqa: B023, E731, E741
        best = min(paid([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert math.isclose(paid(html_extract.cut(costs, edges)), best, abs_tol=1e-9)


def test_labels_are_a_minimum_cut_of_the_page():
    """Over every labelling of a small page's blocks and regions none costs less than the one chosen, and the cut does change labels."""
    r, changed = random.Random(9), 0
    sentence = lambda: " ".join(r.choices(["word", "another", "of", "text"], k=r.choice([1, 3, 20, 150]))) + r.choice([".", ""])
    for _ in range(120):
        part = lambda: "".join(r.choice(["<p>{}</p>", "<li><a href=x>{}</a>", "<h2>{}</h2>", "<div>{}</div>", "<h3>Comments</h3><p>{}</p>"]).format(sentence()) for _ in range(r.randint(1, 2)))
        page = "".join(r.choice(["<article>{}</article>", "<nav>{}</nav>", "<div class=ad>{}</div>", "{}"]).format(part()) for _ in range(2))
        found = html_extract.blocks(page)
        costs, edges = html_extract.graph(found)
        assert len(costs) <= 14
        labels = (np.arange(1 << len(costs))[:, None] >> np.arange(len(costs)) & 1).astype(bool)
        paid = np.where(labels, np.maximum(0, -np.array(costs)), np.maximum(0, np.array(costs))).sum(1) + sum(w * (labels[:, a] != labels[:, b]) for a, b, w in edges)
        got = html_extract.cut(costs, edges)
        assert math.isclose(paid[sum(1 << k for k, x in enumerate(got) if x)], paid.min(), abs_tol=1e-6)
        changed += sum((c > 0) != keep for _, c, keep in html_extract.labelled(page))
    assert changed > 50


def test_built_pages():
    """Pages put together from blocks of known kind, in many layouts: the text is the article's blocks, exactly."""
    r = random.Random(21)
    words = "the river town council said that it would open a new bridge over water in spring after years of work".split()
    say = lambda a, b: " ".join(r.choices(words, k=r.randint(a, b))).capitalize()
    article_tags = [("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ('<main><article class="post">', "</article></main>"), ('<div id="content">', "</div>")]
    before = [lambda: f"<nav><ul>{''.join(f'<li><a href=x>{say(1, 2)}</a>' for _ in range(5))}</ul></nav>", lambda: f'<header class="site-header"><a href=/>{say(1, 3)}</a></header>', lambda: f'<div class="cookie-notice">{say(5, 12)}.</div>', lambda: f'<ul class="menu"><li><a href=x>{say(1, 1)}</a></ul>']
    after = [lambda: f"<footer><p>{say(8, 30)}.</p><p>&copy; {say(2, 4)}</p></footer>", lambda: f"<aside><h3>{say(2, 3)}</h3><p>{say(8, 40)}.</p></aside>", lambda: f'<div id="comments"><h3>Comments</h3>{"".join(f"<p>{say(4, 30)}.</p>" for _ in range(4))}</div>', lambda: f'<form><p>{say(4, 8)}:</p><input></form>', lambda: f'<div class="newsletter-box"><p>{say(6, 20)}.</p></div>']
    inside = [lambda: f'<div class="ad">{say(4, 12)}.</div>', lambda: "<script>var x = '<p>no</p>';</script>", lambda: f'<div class="share-buttons"><a href=x>{say(1, 1)}</a></div>', lambda: f"<aside>{say(5, 15)}.</aside>"]
    for n in range(200):
        title, paras = say(3, 9), [say(*r.choice([(1, 3), (10, 30), (60, 120)])) + "." for _ in range(r.randint(3, 9))]
        body = f"<h1>{title}</h1>"
        for p in paras:
            body += r.choice([f"<p>{p}</p>", f"<p>{p}", f"<ul><li>{p}</li></ul>", f"<blockquote>{p}</blockquote>"]) + (r.choice(inside)() if r.random() < 0.25 else "")
        a, b = r.choice(article_tags)
        page = f"<html><head><title>T</title></head><body>{''.join(f() for f in r.sample(before, 2))}{a}{body}{b}{''.join(f() for f in r.sample(after, 3))}</body></html>"
        assert html_extract.main_text(page) == "\n\n".join([title, *paras]), n


def test_words_in_names_lose_no_article():
    long = "A review of the new bridge, which opened in spring after years of work. " * 6
    for name in ("review", "feedback", "legal", "tags", "discussion", "related", "alert", "search"):
        assert html_extract.main_text(f'<div class="{name}"><p>{long}</p></div>') == long.strip(), name
    assert html_extract.main_text(f"<article><h1>Big title</h1><p>{long}</p><h2>Responses</h2><p>{long}</p><p>{long}</p></article>").count("A review") >= 6


def test_time_is_linear():
    import time

    for make in (lambda k: "<a" * k, lambda k: "<!" * k, lambda k: "<script" * k, lambda k: "<div>" * k + "</p>" * k, lambda k: "<div>" * k + "<h3>Comments</h3>" + "<i>x</i><div>" * k, lambda k: '<a "' * k, lambda k: "<p>one" * k, lambda k: "&#" + "9" * k, lambda k: f'<p class="{"menu_" * k}!">x'):
        best = []
        for k in (6_000, 48_000):
            began = time.process_time()
            html_extract.main_text(make(k))
            best.append(time.process_time() - began)
        assert best[1] < 30 * max(best[0], 0.02), make(3)


def test_pages_query(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, SF).collect()
    assert len(got) == len(html) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r in got:
        assert r["text"] == html_extract.main_text(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) and r["text"] and "track(" not in r["text"]
    odd = spark.createDataFrame([(1, None, 5), (1, "", 6), (2, PAGE, 7)], "page_id long, html string, text int")
    assert sorted((r["page_id"], r["n_chars"] > 0) for r in html_extract.extract(odd).collect()) == [(1, False), (1, False), (2, True)]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_conversations(spark):
    rows, make = [], lambda c, *ts: rows.extend((c, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(ts))
    make(1, "a", "b", "c")
    make(2, "a", "b")  # a prefix of 1
    make(3, "a")  # and of both
    make(4, "a", "c")
    make(5, "a", "b", "c")  # equal to 1
    make(6, "b", "a")  # the same turns in another order
    make(7, "", None)
    make(8, "solo")
    rows += [(9, None, None, None, "x"), (9, 1, "user", "z", "x"), (None, 0, "user", "a", "x"), (8, 0, "user", "solo", "repeat"), (10, 3, "user", "late", "x"), (10, 0, "system", "early", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    line = lambda role, t: f"<|im_start|>{role}\n{t}<|im_end|>\n"
    got = {r["conv_id"]: (r["n_turns"], r["n_same"], r["rendered"]) for r in chat.render(df).collect()}
    assert got == {
        1: (3, 2, line("user", "a") + line("assistant", "b") + line("user", "c")), 4: (2, 1, line("user", "a") + line("assistant", "c")), 6: (2, 1, line("user", "b") + line("assistant", "a")),
        7: (2, 1, line("user", "") + line("assistant", "")), 8: (1, 1, line("user", "solo")), 9: (2, 1, line("", "") + line("user", "z")), 10: (2, 1, line("system", "early") + line("user", "late")),
    }
    assert chat.render(df.limit(0)).count() == 0


def test_turns_of_one_place_go_by_text(spark):
    import duckdb

    rows = [(1, 0, "user", t) for t in ("b", "a", "é", "Z", "", "ab", "z" * 40)] + [(2, 0, "user", t) for t in ("", "Z", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    conversations = df.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(chat.SQL).select("conv_id", "n_turns", "n_same", "rendered").fetchall())
    assert sorted(tuple(r) for r in chat.render(df).select("conv_id", "n_turns", "n_same", "rendered").collect()) == want and len(want) == 1


def naive_scores(train, texts):
    """log10 probabilities where all words are of one class: the model by its definition."""
    words = lambda t: (t or "").lower().split()
    c = Counter(w for t in train for w in words(t))
    ones, twos = (sum(n == k for n in [*c.values(), len(train)]) for k in (1, 2))
    discount = ones / (ones + 2 * twos + 1)
    tail = lambda w: 2 + zlib.crc32(w.encode()[-3:]) % brown_lm.TAILS
    table = np.zeros((2 + brown_lm.TAILS, 2 + brown_lm.TAILS))
    size, new = 0.0, Counter()
    for t in train:
        seq = [None, *words(t), None]
        for a, b in zip(seq, seq[1:]):
            kinds = lambda w: [(1, True)] if w is None else [(0, True)] + [(tail(w), False)] * (c[w] == 1)
            share = 1.0
            for x, old_x in kinds(a):
                for y, old_y in kinds(b):
                    share = (1 - discount if old_y else discount) if b is not None and c[b] == 1 else 1.0
                    table[x, y] += share
                    if old_x and old_y and b is not None:
                        size += share
                    if old_x and not old_y:
                        new[y] += 1
    own = table.sum(0) + 0.5
    p = np.log10((table + 20 * own / own.sum()) / (table.sum(1, keepdims=True) + 20))
    out = []
    for t in texts:
        total, before = 0.0, 1
        for w in [*words(t), None]:
            if w is None:
                total, before = total + p[before, 1], 1
            elif w in c:
                total += p[before, 0] + math.log10((c[w] - discount * (c[w] == 1)) / size)
                before = 0
            else:
                total += p[before, tail(w)] - math.log10(new[tail(w)] + 1)
                before = tail(w)
        out.append(total)
    return out


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_lm_scores_are_those_of_brute_force(spark, hot):
    r = random.Random(hot)
    vocabulary = ["the", "a", "of", "once", "river", "bridge", "Bridge", "ö"] + [f"rare{i}" for i in range(30)]
    texts = [" ".join(r.choices(vocabulary, weights=[8, 6, 5, 1, 3, 2, 1, 1] + [0.3] * 30, k=r.randint(0, 25))) for _ in range(40)] + ["unseen words here once", "rare1 brandnew rare2", None]
    held = [i % 4 == 3 or i >= 40 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, h boolean").repartition(3)
    got = {x["doc_id"]: x["score"] for x in brown_lm.score(docs, held_out="h", classes=1, hot=hot, slice_tokens=50).collect()}
    want = naive_scores([t for t, h in zip(texts, held) if not h], texts)
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9) for i, w in enumerate(want)), [(got[i], w) for i, w in enumerate(want)][:5]


def naive_lm(rows, train):
    words = [[*((t or "").encode().lower().split()), None] for t in rows]
    c = Counter(x for w, keep in zip(words, train) if keep for x in w)
    n, v = sum(c.values()), len(c)
    return n, [(len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in words]


@pytest.mark.parametrize("hot", [0, 5, 200_000])
def test_lm_counts_of_every_word(docs, rows, hot):
    got = brown_lm.score(docs, hot=hot, clustered=4, classes=2).collect()
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _, _ in rows]
    total, want = naive_lm([t for _, t, _ in rows], train)
    assert {r["train_tokens"] for r in got} == {total}
    key = lambda i, held, n, k, b: (-1 if i is None else i, held, n, k, round(b, 6))
    assert sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got) == sorted(key(i, not t, *w) for (i, _, _), t, w in zip(rows, train, want))
    assert all(r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9) for r in got)


def test_lm_score_is_the_same_however_words_travel(docs):
    a, b = (sorted((repr(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in brown_lm.score(docs, hot=h, clustered=4, classes=2).collect()) for h in (6, 200_000))
    # with 6 hot words the 4 clustered ones are the same; all others are joined
    assert a == b


def test_lm_score_is_the_same_whatever_the_buckets(docs, monkeypatch):
    got = []
    for most in (250_000, 20):
        monkeypatch.setattr(brown_lm, "BUCKET_WORDS", most)
        got.append(sorted(repr(tuple(r)) for r in brown_lm.score(docs, hot=6, clustered=4, classes=2, slice_tokens=300).collect()))
    assert got[0] == got[1]


def test_lm_is_a_distribution():
    """Over a closed vocabulary the model's shares sum to one after any class."""
    n = np.array([[5, 2, 1, 1], [3, 0, 2, 4], [1, 3, 1, 0], [0, 4, 1, 0]], dtype=float)
    of = brown_lm.exchange(n, 2, 2)
    assert np.allclose((10 ** brown_lm._probabilities(n, of, 2)).sum(1), 1)


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(3)
    kinds = np.arange(12) % 3  # three kinds of words, each followed by the next kind
    n = np.zeros((13, 13))
    for a in range(12):
        for b in range(12):
            n[a, b] = r.poisson(50 if kinds[b] == (kinds[a] + 1) % 3 else 1)
    start = brown_lm.exchange(n, 12, 3, rounds=0)
    of = brown_lm.exchange(n[np.ix_(p := np.r_[r.permutation(12), 12], p)], 12, 3)

    def likelihood(of, n):
        t = np.zeros((4, 4))
        np.add.at(t, (of[:, None], of[None, :]), n)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    assert {frozenset(kinds[p[:12]][of[:12] == c]) for c in range(3)} == {frozenset({0}), frozenset({1}), frozenset({2})}
    assert likelihood(of, n[np.ix_(p, p)]) >= likelihood(start, n) - 1e-6


def test_lm_clusters_rare_words_too(spark):
    """Rare words that take the place of a frequent kind of words are of its class, whatever their last bytes are."""
    r = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(3)] for k in "ab"]
    texts = [" ".join(str(r.choice(kinds[i % 2])) for i in range(20)) for _ in range(60)]
    texts += [f"a0 b1 {x} b2 a1 {y} a2 b0" for x, y in zip(("rarezzq", "oddzzq", "scarcezzq"), ("fewzzq", "slimzzq", "thinzzq"))]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(900, "b0 rarezzq b1", True), (901, "a0 rarezzq a1", True)], "doc_id long, text string, h boolean")
    for hot in (6, 200_000):
        got = {x["doc_id"]: x for x in brown_lm.score(docs, held_out="h", clustered=6, classes=2, hot=hot).where("held_out").collect()}
        assert got[900]["n_known"] == got[901]["n_known"] == 4
        assert got[900]["score"] > got[901]["score"] + 1  # ten times as likely where a word of kind a belongs


def test_lm_words_are_those_of_bytes():
    import pyarrow as pa

    texts = [None, "", " ", "\x00 \x00a", *(f" A{chr(i)}bÉ{chr(i)}" for i in range(128)), "\x85 \xa0 É", "a  B\n\n"]
    words, sizes = brown_lm._words(pa.array(["left out", *texts])[1:])
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


def test_lm_rare_words_travel_packed(spark):
    """Words that aren't hot go to their buckets and back in a row for each slice and bucket, not in one for each word and neighbour."""
    texts = [" ".join(f"w{(7 * i + j) % 3000}" for j in range(600)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)

    def records():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = stages()
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = records()
    brown_lm.counts(docs).collect()
    counted = records() - before
    assert len(brown_lm.score(docs, hot=0, classes=2).collect()) == 40
    assert records() - before - counted < 2 * counted


def test_lm_texts_and_slices_travel_in_small_lots(spark, tmp_path, monkeypatch):
    """Batches of texts are bounded by bytes while score() runs, all of its jobs over slices have the bound, and the session keeps its own."""
    def watched(batches):
        for batch in batches:
            with (tmp_path / "sent").open("a") as f:
                f.write(f"{batch.nbytes}\n")
            yield batch

    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "word other words " * 30_000  # 0.5 MB
    docs = spark.range(0, 64, 1, 1).select("id", F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).mapInArrow(watched, "id long, text string")
    bounds = []
    for at, name in ((brown_lm, "written"), (type(docs), "toPandas")):
        f = getattr(at, name)
        monkeypatch.setattr(at, name, lambda df, *a, f=f, **k: (bounds.append(spark.conf.get(key)), f(df, *a, **k))[1])
    before = spark.conf.get(key)
    got = brown_lm.score(docs, id_col="id", classes=2).collect()
    assert sorted(r["id"] for r in got) == [*range(64)] and {r["n_tokens"] for r in got} == {90_002}
    sent = [int(x) for x in (tmp_path / "sent").read_text().split()]
    assert sum(sent) >= 2 * 64 * len(text) and max(sent) <= brown_lm.LOT + 1.1 * len(text)
    assert len(bounds) > 8 and {*bounds} == {str(brown_lm.LOT)} and spark.conf.get(key) == before


def test_lm_edges(spark, docs, none):
    assert brown_lm.score(none).count() == 0
    held = docs.selectExpr("doc_id", "text", "true AS h")
    got = brown_lm.score(held, held_out="h").collect()
    assert {r["train_tokens"] for r in got} == {0} and all(r["score"] == r["base_score"] == 0.0 for r in got)


def test_lm_query(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op9_lm_scoring(spark, SF).collect()}
    total, want = naive_lm([r["text"] for r in t], [zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in t])
    held = [0.0, 0.0]
    for r, (n, known, base) in zip(t, want):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (n, known, total) and math.isclose(g["base_score"], base, rel_tol=1e-9)
        if g["held_out"]:
            held = [held[0] + g["base_score"], held[1] + g["score"]]
    assert held[1] > held[0]  # the classes predict unseen texts better than words alone


def naive_nearest(rows, queries_, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good if i in queries_}:
        d = sorted((float(np.sqrt(((v - np.array(x)) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))
        out += [(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim, block", [(3, 6), (64, 4_000_000), (70, 200)])
def test_neighbours(spark, dim, block):
    r = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in r.standard_normal(dim)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [0.0] * dim), (205, [float("nan")] * dim), (206, [None] + [1.0] * (dim - 1)), (207, [float("inf")] * dim), (None, [1.0] * dim), (208, [1.0] * (dim + 1)), (5, rows[5][1]), (209, [9.0] * dim)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    asked = {0, 5, 10, 77, 200, 202, 204, 208}
    got = ann.search(df, df.where(df.vec_id.isin(list(asked))), 10, block_numbers=block)
    assert sorted((g["query_id"], g["rank"], g["vec_id"], round(g["score"], 9)) for g in got.collect()) == naive_nearest(rows, asked, 10)
    few = df.where("vec_id < 4")
    assert ann.search(few, few, 10).count() == 12 and ann.search(df.limit(0), df.limit(0)).count() == 0 and ann.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("cells, gather", [(2, 0.0), (9, 0.2), (40, 0.02)])
def test_cells_change_no_result(spark, cells, gather):
    """Vectors around some points, one with a third of all, many equal: the neighbours are those of brute force."""
    r = np.random.default_rng(cells)
    heads = r.standard_normal((12, 24))
    rows = [(int(i), [float(x) for x in np.float32(heads[0 if i % 3 == 0 else i % 12] + (gather or 1.0) * r.standard_normal(24) * (i % 7 > 0))]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = set(range(0, 600, 20))
    got = ann.search(df, df.where("vec_id % 20 = 0"), 10, block_numbers=240, cells=cells)
    assert sorted((g["query_id"], g["rank"], g["vec_id"], round(g["score"], 9)) for g in got.collect()) == naive_nearest(rows, asked, 10)


def test_least_distances_hold_and_spare_cells():
    r = np.random.default_rng(2)
    heads = r.standard_normal((10, 16)) * 4
    x = heads[r.integers(0, 10, 3000)] + 0.3 * r.standard_normal((3000, 16))
    found = ann.centres(x[:500], 10)
    of, far = ann.nearest_centre(x, found)
    shells = [np.array([f(far[of == c]) if (of == c).any() else np.nan for c in range(len(found))]) for f in (np.min, np.max)]
    qs = x[:50]
    least = ann.least_distances(qs, found, *shells)
    d = np.sqrt(((qs[:, None] - x[None]) ** 2).sum(2))
    for c in range(len(found)):
        if (of == c).any():
            assert (d[:, of == c].min(1) >= least[:, c]).all()
    tenth = np.sort(d, axis=1)[:, 10]
    assert (least <= tenth[:, None]).sum(1).mean() < 3  # of ten cells


def test_neighbours_of_repeated_ids(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(99, [0.0, 1.5]), (99, [7.0, 1.5])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.search(df, asked, 3).collect())
    assert got == [(1, 0), (1, 7), (2, 1), (2, 6), (3, 2), (3, 5)]


def test_neighbours_of_many_dimensions(spark):
    many = spark.range(1, 1301).selectExpr("id AS vec_id", "array_repeat(CAST(1 AS FLOAT), CAST(id AS INT)) AS embedding")
    dims = [3, 200, 777, 900, 1299]
    few = many.where(many.vec_id.isin(dims)).selectExpr("vec_id + 5000 AS vec_id", "embedding")
    assert sorted(r["query_id"] for r in ann.search(few, many, 1).collect()) == dims


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((3000, 64)), r.standard_normal(64)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, size, own = ann.encode(x, np.zeros(64), turn)
    est, bound = ann.estimates(codes, own, q @ turn / np.linalg.norm(q))
    true = x @ q / size / np.linalg.norm(q)
    assert (np.abs(est - true) <= bound).mean() > 0.999 and np.abs(est - true).mean() < 0.15


def test_neighbour_query_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in t]
    want = naive_nearest(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = sorted((g["query_id"], g["rank"], g["vec_id"], round(g["score"], 9)) for g in queries.op10_nearest_neighbours(spark, SF).collect())
    assert len(got) == len(want) and len(set(got) & set(want)) / len(want) >= 0.99
