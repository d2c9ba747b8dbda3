"""Operators that look at one text at a time, against brute force or held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trolley.llm import decontaminate, html_extract, license_scan, lm_score, quality, subword, tokens, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.1"


# -- words


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_words(size):
    texts = ["a b  c", None, "", " x\x0by é z ", "Ab-c 9", "\x1f", "日本 語"]
    for outside, pattern in ((tokens.SPACE, r"[^\x20\x09-\x0D]+"), (tokens.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for _, part in tokens.chunks(pa.array(texts), size):
            w = tokens.words(part, outside, lower=True)
            got += [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


# -- licences


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    (1, "Licensed under CC BY-NC 4.0. all rights reserved, ALL Rights Reserved cc by cc by"),
    (2, None), (3, ""), (4, "..."), (5, "cc"), (6, "by all rights"),
    (7, "x " * 5000 + "This work is licensed under the GNU General Public License, version 3."),
    (8, "Released under the MIT License"), (9, "Released it under the MIT License"), (10, "the MIT License"),
    (11, "licensed under the apache license general public license version 2 0"), (11, "CcK by"),
]


def test_license_scan(documents):
    got = license_scan.scan_licenses(documents(LICENSED)).collect()
    base = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert base == Counter((i, *brute_base(t)) for i, t in LICENSED)
    labels = {r.doc_id: r.labels for r in got if r.doc_id != 11}
    assert labels[1] == "cc-by,cc-by-nc-4.0,reserved"
    assert labels[7] == "gpl,gpl-3.0"
    assert labels[8] == labels[9] == "mit" and labels[10] == labels[3] == ""
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_license_bodies(documents):
    """Passages of the licences themselves, wrapped over lines and with a word changed, without a notice."""
    bodies = {
        "gpl-3.0": "For the developers' and authors' protection, the GPL requires that modified versions\nbe marked as changed, so that their problems will not be attributed erroneously to authors of earlier versions.",
        "lgpl": "When a program is linked with a library, whether statically or using\na shared library, the combination of the two is legally a combined work, a derivative of the original library.",
        "agpl": "It requires the operator of a network server to\nprovide the source code of the modified version running there to the users of that server.",
        "epl": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE,\nREPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
        "artistic-2.0": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
        "public-domain": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, and by any means.",
        "cc-by-nc": "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation.",
        "": "under the terms of the General Public Library, provided that the output of the program is a work",
    }
    got = license_scan.scan_licenses(documents(list(enumerate(bodies.values())))).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == list(bodies)


def test_matching_statistics():
    """The automaton's longest matches, against a search for every substring."""
    scanner = license_scan.Scanner(templates=(("t", "a b c a b d"), ("u", "b c b c a")), base=(("a b", "x"),), min_run=1)
    known = {"a": 0, "b": 0, "c": 0, "d": 0}
    h = tokens.words(pa.array([" ".join(known)], pa.large_string()), tokens.NOT_ALNUM).hashes()
    number = dict(zip(known, np.searchsorted(scanner.vocabulary, h).tolist()))
    grams = {tuple(s[i:j]) for s in ("a b c a b d".split(), "b c b c a".split()) for i in range(6) for j in range(i + 1, 7)}
    rng = np.random.RandomState(1)
    for _ in range(50):
        text = rng.choice(list("abcd"), 12).tolist()
        runs, places = scanner.matches([number[c] for c in text], 0)
        longest = [max(n for n in range(e + 1) if n == 0 or tuple(text[e - n : e]) in grams) for e in range(1, 13)]
        maximal = {(e, n) for e, n in enumerate(longest, 1) if n and (e == 12 or longest[e] != n + 1)}
        assert {(e, n) for e, n, _ in runs} == maximal
        assert sorted(p for p, _ in places) == [i for i in range(11) if text[i : i + 2] == ["a", "b"]]


# -- classifiers


@pytest.mark.parametrize("model,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(shipped, model, label, least):
    docs = shipped.read.parquet(f"{SMALL}/documents.parquet")
    labels = shipped.read.parquet(f"{SMALL}/labels.parquet")
    score = model.score_quality if model is quality else model.score_toxicity
    got = score(docs, model.fit(docs, labels))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= model.THRESHOLD)
    known = [(rows[r.doc_id].predicted, r[label]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(p == y for p, y in known) / len(known) >= least


@pytest.mark.parametrize("table,least", [("sf0.01", 0.5), ("sf0.1", 0.7)])
def test_toxic_rows_are_found(shipped, table, least):
    """Held-out toxic rows, by few labels and by more; accuracy alone is high if none is found."""
    docs = shipped.read.parquet(f"/root/testdata/{table}/documents.parquet")
    labels = shipped.read.parquet(f"/root/testdata/{table}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    found = [rows[r.doc_id].predicted for r in labels.where("toxic = 1").collect() if rows[r.doc_id].held_out]
    assert sum(found) / len(found) >= least


def test_few_rows_follow_the_base_rate():
    spec = subword.Spec(telling=True)
    model = subword.train(["some words", "other words", "more of them", "bad words"], [0, 0, 0, 1], spec)
    assert subword.score(["nothing known"], model)[0] < 0.5


def test_classifier_edges(shipped, documents):
    spec = subword.Spec(epochs=3, min_texts=1)
    rows = [(i, "good words here" if i % 2 else "### $$$ ###") for i in range(40)] + [(100, None), (101, ""), (102, " \n"), (None, "good")]
    docs = documents(rows + [(101, "")])
    labels = shipped.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (100, 0), (3, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, spec)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert got[100].score == got[101].score == got[102].score == 0.0 and got[None].held_out is False
    assert got[1].score > 0.5 > got[2].score
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 5}
    # No labels at all, or one class only, still give a score.
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert quality.score_quality(docs, quality.fit(docs, some, spec)).count() == docs.count()
    assert quality.score_quality(documents([]), model).collect() == []


def test_scores_do_not_depend_on_the_batch():
    model = subword.train(["a b c", "x y z"] * 6, [1, 0] * 6, subword.Spec(epochs=2, min_texts=1))
    texts = ["a b", "", "z z", "a\tx  b", "y"]
    together = subword.score(texts, model)
    assert np.allclose(together, [subword.score([t], model)[0] for t in texts])


# -- language models


def test_lm_scores(shipped, documents):
    rows = [(i, "the cat sat on the mat the cat") for i in range(10)] + [(100 + i, "zug um zug um zug") for i in range(10)]
    rows += [(200, None), (201, ""), (202, "?!"), (None, "the cat"), (203, "unseen words only")]
    target = shipped.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r for r in lm_score.score_corpus(documents(rows), target).collect()}
    assert got[1].score > 0 > got[101].score
    assert got[200].score == got[201].score == got[202].score == 0.0 and got[None].score > 0


def test_lm_membership_is_no_merit(shipped, documents):
    """A target document and a twin of it that is none score alike once their own counts are out."""
    rng = np.random.RandomState(4)
    text = lambda: " ".join(f"w{rng.zipf(1.3) % 500}" for _ in range(120))
    inside, outside = [(i, text()) for i in range(40)], [(1000 + i, text()) for i in range(40)]
    ids = shipped.createDataFrame([(i,) for i, _ in inside], "doc_id bigint")
    got = {r.doc_id: r.score for r in lm_score.score_corpus(documents(inside + outside), ids).collect()}
    means = [np.mean([got[i] for i, _ in some]) for some in (inside, outside)]
    spread = np.std([got[i] for i, _ in outside])
    assert abs(means[0] - means[1]) < spread


def test_lm_scores_count_every_word(shipped, documents):
    """Every word has its own counts, without those of the text itself; against brute force."""
    rows = [(i, " ".join(f"r{i * 150 + j}x" for j in range(150)) + " the cat sat") for i in range(20)]
    rows += [(100 + i, f"r{i}x the R{i + 1}X the r{i}x") for i in range(20)] + [(200, None), (201, "?!"), (None, "the cat"), (None, "the cat"), (3, "the cat")]
    target = {i for i in range(100, 110)} | {3}
    ids = shipped.createDataFrame([(i,) for i in [*target, 100, None, 999]], "doc_id bigint")
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    size = len({w for _, t in rows for w in words(t)})

    def loss(text, others):
        """The text's loss by a model of the other texts."""
        pairs = Counter(p for t in others for p in zip(["", *words(t)], words(t)))
        unigram, context = Counter(), Counter()
        for (v, w), n in pairs.items():
            unigram[w] += n
            context[v] += n
        total = sum(pairs.values())
        m = max(1.0, lm_score.SMOOTHING * total)
        found = [
            np.log((pairs[v, w] + m * (unigram[w] + 1) / (total + size)) / (context[v] + m)) for v, w in zip(["", *words(text)], words(text))
        ]
        return -np.mean(found) if found else 0.0

    want = []
    for row, (i, t) in enumerate(rows):
        others = [(k, x) for at, (k, x) in enumerate(rows) if at != row]
        want.append((-1 if i is None else i, len(words(t)), loss(t, [x for k, x in others if k in target]), loss(t, [x for _, x in others])))
    want.sort()
    # One block and bucket, and many of both.
    for small in ({}, {"block_bytes": 3000, "bucket_bytes": 5000}):
        got = lm_score.score_corpus(documents(rows), ids, **small).collect()
        found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.loss_target, r.loss_background) for r in got)
        assert np.allclose(found, want, rtol=1e-9, atol=1e-12)
        assert all(r.score == r.loss_background - r.loss_target for r in got)
    assert lm_score.score_corpus(documents([]), ids).collect() == []
    assert len(lm_score.score_corpus(documents(rows), ids.limit(0)).collect()) == len(rows)


# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";x<y</script></head><body><nav><ul><li><a href="/x">M</a></ul></nav>
<div class="ad">buy</div><article><header><h1>Head &amp; more</h1></header><p><b>One<br>two  three<p>four &lt;x&gt; <i>five</i></p>
<section id="comments"><p>nice</p></section><form><input></form></article><aside>side</aside><footer>&copy; f</footer></body></html>"""


def test_main_text():
    page = html_extract.text_of
    assert page(html_extract.parse(PAGE), set()) == "Head & more\n\nOne two three\n\nfour <x> five"
    assert page(html_extract.parse(""), set()) == ""
    assert page(html_extract.parse("just text &nbsp; <p>a<p>b it's <a href='x>y' \"z>ok"), set()) == "just text\n\na\n\nb it's ok"
    assert page(html_extract.parse("<p>" * 3000 + "deep"), set()) == "deep"
    assert page(html_extract.parse("<div>a<!-- b --><div style='display: none'>c</div>d</div>"), set()) == "a\n\nd"


@pytest.mark.parametrize(
    "html,text",
    [
        ('<p>See <a href="/hidden-lake" title="A">the lake</a></p>', "See the lake"),
        ('<article data-title="the hidden valley" data-style="display:none"><p>Walk</p></article>', "Walk"),
        ("<p>a<b class='x' class='ad'>b</b><i HIDDEN>c</i><u aria-hidden=true>d</u><s hidden=''>e</s></p>", "ab"),
        *((f'<div class="{c}"><p>Long text</p></div>', "Long text") for c in ("content has-sidebar", "content no-sidebar", "post comments-open", "social-policy", "search-engines", "notice-of-appeal")),
        *((f'<p>x</p><div class="{c}"><p>gone</p></div>', "x") for c in ("ad", "site-footer", "main-nav", "comments-area", "cookie_consent-banner", "x social-share-buttons", "widget-2", "related-posts")),
        # A wrapper of the main element or of the page's article stays, whatever it is called.
        ('<div>top</div><div class="widget"><main><p>Text</p></main></div>', "Text"),
        ('<form><div class="page social"><article class="related"><p>All of the text</p></article></div></form><p>low</p>', "All of the text"),
        ('<main><h1>H</h1><div class="popup"><article>All of the text</article></div></main>', "All of the text"),
        # Teasers and what the page hides itself do not.
        ("<article>Text of the page</article><aside><article>Another page, with a long teaser</article></aside>", "Text of the page"),
        ('<p>Text of this page</p><div class="related"><article>Teaser</article></div>', "Text of this page"),
        ("<p>Text</p><div hidden><article>Not shown, though it is longer</article></div>", "Text"),
    ],
)
def test_only_whole_names_hide(html, text):
    assert html_extract.text_of(html_extract.parse(html), set()) == text


def test_style_tree(shipped, stages):
    """Unnamed boilerplate goes because it is alike on all pages of its host; content stays."""
    def page(i):
        return f"<body><div class=top>Our site</div><div class=text><p>Story {i} tells <b>things</b> of {i * i}</p></div><div class=low><p>Call us</p></div></body>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(8)] + [(50, "http://b.example/1", page(1)), (60, None, None), (61, "x", "")]
    rows += [(70, "http://a.example/copy", page(3))] * 2
    pages = shipped.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_extract.extract(pages, stages).collect()}
    assert got[4].text == "Story 4 tells things of 16" and got[4].n_chars == len(got[4].text)
    assert got[70].text == got[3].text
    assert got[50].text == "Our site\n\nStory 1 tells things of 1\n\nCall us"
    assert got[60].text == got[61].text == "" and got[60].url is None
    assert html_extract.extract(pages.limit(0), stages).collect() == []


def test_entropy_against_counting(shipped, stages):
    """Importance of every path against plain counts, and the noise they give."""
    import math

    def page(i):
        return (f"<body><div class=a>same</div><div class=b><p>t{i % 2}</p></div><div class=c><p>all {i}</p><ul>{'<li>x' * (i % 3)}</ul></div>"
                f"<nav><ul><li>menu</ul></nav><span class=s>fixed</span></body>")

    pages = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(99, None, page(3)), (98, "/relative", page(4))]
    df = html_extract.named(shipped.createDataFrame(pages, "page_id bigint, url string, html string"))
    seen = {}
    for i in range(12):
        for p, (look, text) in html_extract.nodes(html_extract.parse(page(i))).items():
            seen.setdefault(p, []).append((look, text))

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in Counter(values).values())

    worth = {p: max(entropy([v[0] for v in vs]), entropy([v[1] for v in vs])) for p, vs in seen.items()}
    low = {p for p in worth if all(worth[q] < html_extract.MIN_IMPORTANCE and len(seen[q]) >= html_extract.MIN_PAGES
                                   for q in worth if q == p or q.startswith(p + "/"))}
    inline = lambda p: p.rsplit("/", 1)[-1].split(".")[0] in html_extract.INLINE
    want = {p for p in low if p.rsplit("/", 1)[0] not in low or inline(p.rsplit("/", 1)[0])}
    got = {r["_host"]: set(r["_noise"]) for r in html_extract.style_tree(df, stages).collect()}
    assert got == {"h.example": want} and {"/body/div.a", "/body/nav", "/body/span.s"} <= want
    texts = {r.page_id: r.text for r in html_extract.extract(shipped.createDataFrame(pages, "page_id bigint, url string, html string"), stages, names=False).collect()}
    assert texts[4].startswith("t0\n\nall 4") and "same" not in texts[4] and "menu" not in texts[4]
    assert texts[99].startswith("same") and "menu" in texts[98]  # no host, no tree


def _shares(whole, found):
    """(mean share of a page's words found, mean share of further words)."""
    out = []
    for p, text in whole.items():
        a, b = Counter(text.split()), Counter(found[p].split())
        if a:
            out.append((sum((a & b).values()) / sum(a.values()), sum((b - a).values()) / sum(a.values())))
    return np.mean(out, axis=0)


def test_pages_stripped_of_names(shipped, stages):
    """The given pages without article tags, classes, ids and roles: the text is found with little else."""
    from pyspark.sql import functions as F

    pages = shipped.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.text for r in html_extract.extract(pages, stages).collect()}
    bare = F.regexp_replace(F.regexp_replace("html", "(?i)<(/?)article", "<$1div"), """(?i)\\s(class|id|role)\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>]+)""", "")
    found = html_extract.extract(pages.withColumn("html", bare), stages).collect()
    kept, extra = _shares(whole, {r.page_id: r.text for r in found})
    assert kept >= 0.9 and extra <= 0.1


def test_tree_decides_without_any_name(shipped, stages):
    """The given pages' articles in one site's frame of plain divs: the tree alone finds them, without it the frame stays."""
    pages = shipped.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.text for r in html_extract.extract(pages, stages).collect()}
    whole = {p: t for p, t in list(whole.items())[:60] if t}
    frame = "<div>" + "".join(f"<p>Menu entry {i} of the site</p>" for i in range(30)) + "</div>"
    rows = [(p, f"http://one.example/{p}", f"<body>{frame}<div>" + "".join(f"<p>{x}</p>" for x in t.split("\n\n")) + f"</div>{frame}</body>")
            for p, t in whole.items()]
    df = shipped.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = lambda **how: {r.page_id: r.text for r in html_extract.extract(df, stages, names=False, **how).collect()}
    kept, extra = _shares(whole, found())
    assert kept >= 0.9 and extra <= 0.1
    assert _shares(whole, found(min_pages=10**9))[1] > 0.5


# -- benchmark passages


def brute_tiles(text, item, least):
    """Greedy string tiling by trying every pair of starts."""
    mt, mi, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = 0
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and not mt[t + n] and not mi[p + n]:
                    n += 1
                if n > best:
                    best, at = n, (t, p)
        if best < least:
            return total
        for n in range(best):
            mt[at[0] + n] = mi[at[1] + n] = True
        total += best


def test_tiling():
    rng = np.random.RandomState(3)
    for _ in range(60):
        text, item = rng.randint(1, 5, 30).astype(np.uint64), rng.randint(1, 5, 14).astype(np.uint64)
        tiles = decontaminate.tile(text, item, 3)
        assert sum(t[2] for t in tiles) == brute_tiles(text.tolist(), item.tolist(), 3)


def test_leaks(shipped, documents):
    item = [f"q{i}" for i in range(24)]
    other = "some other question about nothing at all here"
    mixed = " ".join(item[12:]) + " and then " + " ".join(item[:12])
    rows = [
        (1, "start " + " ".join(item).upper() + ", end"), (2, mixed), (3, "clean text with nothing in it"), (4, None), (5, ""),
        (6, " ".join(item[:8])), (7, "x " * 3000 + other + "!"), (8, "short one"), (9, " ".join(item)), (9, " ".join(item)),
    ]
    bench = shipped.createDataFrame([(0, " ".join(item)), (1, other), (2, None), (3, "..."), (4, "short one")], "item_id bigint, text string")
    big = bench.unionByName(shipped.createDataFrame([(100 + i, f"filler{i} " * 9 + f"words{i}") for i in range(300)], bench.schema))
    for benchmark in (bench, big.repartition(7)):
        got = {r.doc_id: r for r in decontaminate.leaking_documents(documents(rows), benchmark).collect()}
        assert {i: r.item_ids for i, r in got.items()} == {1: [0], 2: [0], 7: [1], 8: [4], 9: [0]}
        assert got[2].coverage == 1.0
        kept = decontaminate.keep_clean(documents(rows), benchmark)
        assert kept.columns == documents(rows).columns
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaking_documents(documents(rows), bench.limit(0)).collect() == []
    assert decontaminate.leaking_documents(documents([]), bench).collect() == []
    assert decontaminate.keep_clean(documents(rows), bench.limit(0)).count() == len(rows)


def test_leaks_against_tiling_every_pair(shipped, documents, monkeypatch):
    """Every document with every item, by the plain tiling; bitmaps of any size give the same."""
    rng = np.random.RandomState(11)
    item = lambda n: " ".join(f"w{rng.randint(6)}" for _ in range(n))
    items = [(i, item(rng.randint(1, 16))) for i in range(12)] + [(5, item(9)), (None, item(7))]
    rows = [(i, item(rng.randint(0, 40))) for i in range(50)]
    rows += [(100 + i, item(8) + " " + t + " " + item(5)) for i, (_, t) in enumerate(items)] + [(None, items[2][1]), (100, items[3][1])]
    bench = shipped.createDataFrame(items + items[:2], "item_id bigint, text string")
    want = []
    for d, t in rows:
        for i, x in set(items):
            text, words = t.split(), x.split()
            n = brute_tiles(text, words, min(4, len(words)))
            if n >= decontaminate.MIN_COVER * len(words):
                want.append((d, i, len(words), n))
    docs = documents(rows).selectExpr("*", "1 AS _item", "2 AS item_id", "3 AS _d")
    for bits in (3, decontaminate.MIN_BITS):
        monkeypatch.setattr(decontaminate, "MIN_BITS", bits)
        monkeypatch.setattr(decontaminate, "MAX_BITS", max(bits, 5))
        got = decontaminate.leaks(docs, bench, ["doc_id"]).collect()
        assert sorted(((r._k0, r.item_id, r.n_item_words, r.n_covered) for r in got), key=str) == sorted(want, key=str)
    leaking = {(d, t) for d, t in rows if any(w[0] == d and brute_tiles(t.split(), x.split(), min(4, len(x.split()))) >= 0.6 * len(x.split())
                                              for w in want for _, x in items)}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((x for x in rows if x not in leaking), key=str)


def test_documents_are_read_once_for_any_benchmark(shipped, tmp_path):
    shipped.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    docs = shipped.read.parquet(str(tmp_path / "docs"))
    found = decontaminate.seeded(docs, ["doc_id"], [4], decontaminate.Bitmap(20))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    bench = shipped.createDataFrame([(i, f"some words of item {i}") for i in range(500)], "item_id bigint, text string")
    out = decontaminate.leaks(docs, bench, ["doc_id"])
    assert f"{tmp_path}/docs" not in out._jdf.queryExecution().executedPlan().toString()  # what follows reads the stage tables


def test_scores_are_a_softmax_over_bags():
    """Scores against plain sums over each text's bag, and training against the loss's numeric gradient."""
    import math

    spec = subword.Spec(epochs=3, min_texts=1, min_steps=1)
    texts = ["a b c d", "x y z w x", "a b", "q", "  a\tb ", "long word " * 300]
    model = subword.train(["a b c", "x y z"] * 6, [1, 0] * 6, spec)
    for text, got in zip(texts, subword.score(texts, model)):
        buckets, share = subword.bag(text, spec)
        z = sum(float(model.weight[b]) * float(s) for b, s in zip(buckets, share)) + model.bias
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert share.sum() == pytest.approx(1, abs=1e-4) and len(set(buckets.tolist())) == len(buckets)

    def loss(m):
        p = subword.score(["a b c", "x y z"], m)
        return -math.log(p[0]) - math.log(1 - p[1])

    # More steps go down the loss, and each learned bucket's weight has the sign that lowers it.
    assert loss(subword.train(["a b c", "x y z"] * 6, [1, 0] * 6, subword.Spec(epochs=30, min_texts=1))) < loss(model) < 2 * math.log(2)
    for text, sign in (("a b c", 1), ("x y z", -1)):
        other = set(subword.bag("x y z" if sign > 0 else "a b c", spec)[0].tolist())
        assert all(sign * model.weight[b] > 0 for b in subword.bag(text, spec)[0] if b not in other)


def test_fit_runs_in_a_task_and_equals_local_training(shipped, documents):
    rows = [(i, "good words here" if i % 2 else "bad noise there") for i in range(60)] + [(60, None), (None, "good")]
    labels = shipped.createDataFrame([(i, i % 2) for i in range(61)] + [(None, 1)], "doc_id bigint, quality int")
    spec = subword.Spec(epochs=2, min_texts=1)
    model = subword.fit(documents(rows), labels, "quality", spec)
    import zlib

    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    want = subword.train([rows[i][1] for i in known], [i % 2 for i in known], spec)
    assert np.allclose(model.weight, want.weight) and model.bias == pytest.approx(want.bias)
    none = subword.fit(documents([]), labels, "quality", spec)
    assert none.weight.any() == 0 and subword.score(["x"], none)[0] == pytest.approx(0.5)
