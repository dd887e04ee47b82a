import random
import time

import numpy as np

from recordmill.llm import decontaminate, htmltext, nearest


def test_nearest_finds_most_of_brute_force_and_takes_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(16).astype(np.float32).tolist() for i in range(1, 1500)}
    vectors |= {100: vectors[7], 200: vectors[7], 300: vectors[7]}
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [1.0] * 14), (2004, [1.0]), (2100, [float("inf")] * 16)]
    table = spark.createDataFrame(list(vectors.items()) + odd + [(7, vectors[7])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS id")
    got: dict[int, list] = {}
    for r in nearest.search(table, table.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array(list(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    hits = 0
    assert set(got) == {i for i in vectors if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 10 and q not in [i for i, _ in found] and all(abs(s - d[ids == i][0]) < 1e-12 for i, s in found)
        assert [(s, i) for i, s in found] == sorted((s, i) for i, s in found)
    assert hits >= 0.9 * 10 * len(got) and [i for i, _ in got[100][:3]] == [7, 200, 300]
    assert nearest.search(table.limit(0), table, 10).count() == 0
    named = table.selectExpr("CASE WHEN vec_id = 100 THEN 'a' ELSE CAST(vec_id AS STRING) END AS vec_id", "embedding")
    assert {r["vec_id"] for r in nearest.search(named, named.where("vec_id = '200'"), 2).collect()} == {7, 300}


def test_repeated_rows_and_ids_take_no_place_of_others(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(8).astype(np.float32).tolist() for i in range(1, 600)}
    once = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    asked = once.where("vec_id % 100 = 0")
    found = lambda table: [tuple(r) for r in nearest.search(table, asked, 10).orderBy("query_id", "rank").collect()]
    expected = found(once)
    assert len(expected) == 50 and found(once.unionByName(once).unionByName(once)) == expected
    # one id in many rows near a query, all different
    many = [(7, (np.array(vectors[100]) + 0.001 * rng.standard_normal(8)).tolist()) for _ in range(600)]
    table = once.where("vec_id <> 7").unionByName(spark.createDataFrame(many, "vec_id long, embedding array<float>"))
    ids = [x for q, _, x, _ in found(table) if q == 100]
    others = [x for q, _, x, _ in expected if q == 100 and x != 7]
    assert ids == [7, *others[:9]]


def impacts(entries: list[list[str]], threshold: float) -> list[dict[str, float]]:
    """BM25 of every entry's words over what the entry's score must reach, by the formula."""
    n, average = len(entries), sum(map(len, entries)) / len(entries)
    out = []
    for e in entries:
        own = {}
        for t in set(e):
            df, tf = sum(t in x for x in entries), e.count(t)
            own[t] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(e) / average))
        out.append({t: x / (threshold * sum(own.values())) for t, x in own.items()})
    return out


def test_a_repeated_query_id_has_the_neighbours_of_all_its_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 1, 6).tolist()) for i in range(1, 120)]
    twice = [(0, [9.0] * 6), (0, [-9.0] * 6), (0, [9.0] * 6)]
    want = sorted((min(float(np.linalg.norm(np.array(v) - q[1])) for q in twice), i) for i, v in vectors)[:10]
    for order in (twice, twice[::-1], [twice[1], twice[0]]):
        table = spark.createDataFrame(vectors + order, "vec_id long, embedding array<double>")
        got = nearest.search(table, table.where("vec_id = 0")).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [i for _, i in want] and all(abs(r["score"] - d) < 1e-9 for r, (d, _) in zip(got, want))


def test_wand_finds_what_full_scoring_finds(monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 70))), None) for i in range(60)]
    index = decontaminate.build(items, threshold=0.3)
    entries = [e for _, q, _ in items for e in decontaminate.cut(q.split())]
    own = impacts(entries, 0.3)
    texts = [rng.choices(vocabulary, k=rng.choice([0, 20, 96, 400])) for _ in range(60)]
    docs = [np.array([index.terms.get(w, -1) for w in t], np.int32) for t in texts]
    want = {}
    for d, text in enumerate(texts):
        for start in range(0, max(1, 48 * (-(-len(text) // 48) - 1)), 48):
            passage = set(text[start : start + 96])
            want |= {(d, start, e): s for e, x in enumerate(own) if (s := sum(v for t, v in x.items() if t in passage)) >= 1 - 1e-9}
    got = {(d, start, e): s for d, start, e, s in decontaminate.hits(index, docs)}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for name, value in (("PASSAGES", 1), ("CELLS", 1), ("CELLS", 20)):
        monkeypatch.setattr(decontaminate, name, value)
        assert {(d, start, e) for d, start, e, _ in decontaminate.hits(index, docs)} == set(want)
    for common in (1, 10**6):  # no common words, and nothing else
        monkeypatch.setattr(decontaminate, "COMMON", common)
        again = decontaminate.build(items, threshold=0.3)
        assert {(d, start, e) for d, start, e, _ in decontaminate.hits(again, docs)} == set(want)


def test_contamination_is_what_brute_force_over_all_passages_and_items_finds(spark):
    """Partial copies around both limits, questions and answers, and any number of indexes."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 20, 60]))), " ".join(rng.choices(vocabulary, k=rng.choice([2, 9, 30]))) if i % 2 else None) for i in range(50)]
    docs = []
    for d in range(150):
        _, q, a = items[d % 50]
        copied = (q + " " + (a or "")).split()
        copied = [w if rng.random() > d % 5 * 0.01 else "other" for w in copied][: rng.choice([None, None, -3, len(copied) * 3 // 4])]
        docs.append((d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)) + copied + rng.choices(vocabulary, k=rng.randint(0, 120)))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, q string, a string")
    parts = [(i, e) for i, (_, q, a) in enumerate(items) for e in decontaminate.cut((q + " " + (a or "")).split())]
    own, shingles = impacts([e for _, e in parts], 0.75), lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, text in docs:
        words = text.split()
        for start in range(0, max(1, 48 * (-(-len(words) // 48) - 1)), 48):
            passage = set(words[start : start + 96])
            for (i, _), x in zip(parts, own, strict=True):
                score = sum(v for t, v in x.items() if t in passage)
                if score < 1 - 1e-9:
                    continue
                _, q, a = items[i]
                q, a = q.split(), (a or "").split()
                n = len(q) + len(a)
                if a:
                    sides = [(shingles(w, min(5, len(w))), min(5, len(w))) for w in (q, a)]
                else:
                    every = [tuple(q[k : k + 5]) for k in range(len(q) - 4)]
                    sides = [({s for k, s in enumerate(every) if (2 * k < len(every)) == first}, 5) for first in (True, False)]
                around = words[max(0, start - n) : start + 96 + n]
                found = [len(s & shingles(around, size)) for s, size in sides]
                if sum(found) >= 0.8 * sum(len(s) for s, _ in sides) and all(f >= 0.5 * len(s) for f, (s, _) in zip(found, sides, strict=True)):
                    want[d, i] = max(want.get((d, i), 0.0), score * 0.75)
    for words in (10**6, 400):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(table, bench, question_col="q", answer_col="a", index_words=words).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 30 < len(want) < 150


def test_repeated_null_and_text_item_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta", "uno due tre quattro cinque sei sette", "eins zwei drei vier fuenf sechs sieben")
    bench = spark.createDataFrame([("x", one), ("x", one), ("x", two), (None, three), (None, one)], "item_id string, text string")
    docs = spark.createDataFrame([("d1", f"{one} and {two}"), ("d1", f"{one} and {two}"), ("d2", three), (None, two), ("d3", "none")], "doc_id string, text string")
    for words in (10**6, 8):
        got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.contaminated(docs, bench, index_words=words).collect())
        assert got == sorted([("d1", "x"), ("d1", "None")] * 2 + [("d2", "None"), ("None", "x")])
        assert [r["doc_id"] for r in decontaminate.clean(docs, bench, index_words=words).collect()] == ["d3"]


def test_contamination_finds_planted_items_in_odd_tables(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    items = [(i, " ".join(word() for _ in range(rng.choice([8, 30, 120])))) for i in range(40)] + [(90, "tiny item"), (91, None), (92, "?!")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs, truth = [], set()
    for d in range(120):
        text = noise(rng.randint(0, 400))
        if d % 3 == 0:
            item, body = items[d % 40]
            text += ("\n" + body.upper() + ". ") + noise(50)
            truth.add((d, item))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "long " * 30000 + items[0][1]), (503, " ".join(items[1][1].split()[:3]))]
    truth |= {(502, 0)}
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for words in (10**6, 500):
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, bench, index_words=words).collect()}
        assert {p for p in found if p[1] != 90} == truth
    clean = {r["doc_id"] for r in decontaminate.clean(table, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0 == decontaminate.contaminated(table.limit(0), bench).count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><a href=/>Home site</a></header>
<nav><ul><li>Menu one</li></ul></nav><div class="cookie-notice">We use cookies here</div><article><h1>Big &amp; bold</h1><p>First para with <b>words</b> that go on<br>and on.
<p>Second   one, &lt;tag&gt; &#233;.</p><aside>Related things</aside><form>Mail <input name=a></form><div class="ad">Buy now</div><p>Last words of the story here.</p>
<section id="comments"><p>I liked it a lot, thanks.</p></section></article><footer>&copy; us</footer>"""


def test_main_text(spark):
    want = "Big & bold\n\nFirst para with words that go on and on.\n\nSecond one, <tag> é.\n\nLast words of the story here."
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, "u", "", "t"), (4, "u", "plain words only <b>bold", "t"), (5, "u", "<p>" + "word " * 50000, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    got = htmltext.main_text(spark, pages).collect()
    assert len(got) == 6
    for r in got:
        text = {1: want, 2: "", 3: "", 4: "plain words only bold", 5: ("word " * 50000).strip()}[r["page_id"]]
        assert r["text"] == text and r["n_chars"] == len(text)
    assert htmltext.main_text(spark, pages.limit(0)).count() == 0
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert htmltext.extract_text(bare, htmltext.weights({})) == want


def test_the_region_is_the_best_scoring_run():
    weight = {"word": 1.0, "tag": -2.0, "word:link": -1.0}
    page = "<p>a b</p><p><i><i><i><i>c d e f g h</i></i></i></i></p>"
    assert htmltext.extract_text(page, weight) == "c d e f g h"
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 4]) for _ in range(rng.randint(0, 25))]
        start, end, best = htmltext.best_run(scores)
        runs = [(sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        most = max(runs, default=(0, 0, 0))
        if most[0] <= 0:
            assert (start, end, best) == (0, 0, 0.0)
        else:
            assert sum(scores[start:end]) == best == most[0]


ARTICLE = "<h1>Big title here</h1><p>First para with <b>words</b> that go on and on.</p><p>Second one.</p><p>End.</p>"
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul>"
FOOT = "<footer>copyright us 2020</footer>"
LIKED = "<p>I liked it a lot thanks very much for this really great article my friends.</p>"
SHAPES = {
    "a class that hides overflow": f'<nav>{MENU}</nav><div class="overflow-hidden">{ARTICLE}</div>{FOOT}',
    "content without adverts": f'<nav>{MENU}</nav><div class="entry-content ad-free">{ARTICLE}</div>{FOOT}',
    "a post related to something": f'<nav>{MENU}</nav><div class="post related-to-x">{ARTICLE}</div>{FOOT}',
    "a story of search results": f'<nav>{MENU}</nav><div id="search-results-story">{ARTICLE}</div>{FOOT}',
    "a widget that is the page": f'<nav>{MENU}</nav><div class="widget">{ARTICLE}</div>{FOOT}',
    "an apostrophe in a value": f'<nav>{MENU}</nav><div>{ARTICLE.replace("<p>First", "<p data-x=O\'Brien>First").replace("<p>Second", "<p title=don\'t>Second")}</div>{FOOT}',
    "a stray quote": f'<div>{ARTICLE.replace("<p>Second", "<p title=a\" b>Second")}</div>',
    "a menu that never ends": f"<nav>{MENU}<div>{ARTICLE}</div>{FOOT}",
    "a menu without a name": f"<div>{MENU}</div><div>{ARTICLE}</div>{FOOT}",
    "comments within": f'<article>{ARTICLE}<section id="comments"><article class="comment">{LIKED}</article></section></article>{FOOT}',
    "comments longer than the article": f'<div class=main>{ARTICLE}</div><div id="comments"><div class="comment-body">{LIKED * 20}</div></div>{FOOT}',
    "a form around the page": f"<form id=all><nav>{MENU}</nav><div>{ARTICLE}</div></form>{FOOT}",
    "a header with the title": f"<header><a href=/>Site</a></header><main><header>{ARTICLE[:23]}</header>{ARTICLE[23:]}</main>",
    "a sidebar by name": f'<div class="content with-sidebar">{ARTICLE}</div><div class="article-sidebar">{LIKED}</div>',
    "an advert and an aside within": f"<article>{ARTICLE.replace('<p>Second', '<div class=ad>Buy now this great product</div><aside>see also</aside><p>Second')}</article>",
    "a notice": f'<div class="cookie-notice">{LIKED}</div><div hidden>{LIKED}</div><div style="display:none">{LIKED}</div><div>{ARTICLE}</div>',
    "an article's own head": f'<div class="page"><div class="entry-header"><h2>Big title here</h2></div>{ARTICLE[23:]}</div>{FOOT}',
    "a page title before the article": f"<nav>{MENU}</nav><main>{ARTICLE[:23]}<article>{ARTICLE[23:]}</article></main>{FOOT}",
    "a comment by its text": f'<div class="post">{ARTICLE}</div><div class="comment-text">{LIKED}</div>{FOOT}',
    "a sidebar's content": f'<div class="sidebar-content">{LIKED}</div><div class="content">{ARTICLE}</div><div class="footer-text">{LIKED}</div>',
    "related articles": f'<div class="content">{ARTICLE}</div><div class="related-articles">{LIKED}</div><div class="newsletter-text">{LIKED}</div><div class="ad-text">{LIKED}</div>',
    "comments as themes have them": f'<article class="post">{ARTICLE}</article><ol class="comment-list"><li class="comment"><div class="comment-body">{LIKED}</div></li></ol><form class="comment-form">Reply</form>',
    "bare parts": f"<div><div>{MENU}</div><div><div>{ARTICLE}</div></div><div>{MENU}</div></div>",
    "words without scripts": f"<div>{ARTICLE.replace('<p>End.', '<button>Share</button><noscript><p>End.').replace('End.</p>', 'End.</p></noscript>')}</div>",
    "a small teaser marked as an article": f"<nav>{MENU}</nav><div>{ARTICLE * 3}</div><article class=teaser>short</article>",
}


def test_articles_of_many_shapes():
    want = "Big title here\n\nFirst para with words that go on and on.\n\nSecond one.\n\nEnd."
    for weight in (htmltext.weights({}), htmltext.weights({k: tuple(v) for k, v in htmltext.counts(PAGE * 20).items()})):
        for shape, page in SHAPES.items():
            got = htmltext.extract_text(page, weight)
            assert got.startswith("\n\n".join([want] * 3)) if "teaser" in shape else got == want, (shape, got)


def test_a_body_in_parts_outlives_the_articles_below_it():
    body, card = "<p>" + "body " * 78 + "</p>", "<article><h3>Card</h3><p>" + "card " * 60 + "</p></article>"
    for weight in (htmltext.weights({}), htmltext.weights({k: tuple(v) for k, v in htmltext.counts(PAGE * 20).items()})):
        got = htmltext.extract_text(f"<div>{body * 5}</div>{card * 3}", weight)
        assert got.count("body") == 390
        assert htmltext.extract_text(f'<div class="comments">{body}</div>', weight).count("body") == 78


def test_bad_nesting_costs_no_more_than_its_length():
    start = time.time()
    for page in ("<div>" * 20_000 + "</section>" * 20_000, "<nav>" * 20_000 + "<p>a" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<article>" * 20_000 + "x", "<li>" * 20_000 + "<td>" * 20_000):
        htmltext.extract_text(page, htmltext.weights({}))
    assert time.time() - start < 10


def test_markup_by_the_rules_of_html():
    weight = htmltext.weights({})
    for page, want in (
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", "Let x=1 be."),
        ("<p>a < b and c > d &lt;b&gt; &amp;amp; x</p>", "a < b and c > d <b> &amp; x"),
        ('<p>good text</p><p class="x', "good text"),
        ("<p>before</p><script>var x=1; if (a<b) {}", "before"),
        ("<p>one<!-- two --> and more<!-- four", "one and more"),
        ("<p>un<b>believ</b>able and\u00a0 more\n here<br>now", "unbelievable and more here now"),
        ("<ul><li>one thing or two<li>three things or four</ul>", "one thing or two\n\nthree things or four"),
    ):
        assert htmltext.extract_text(page, weight) == want
