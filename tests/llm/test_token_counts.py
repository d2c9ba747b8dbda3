"""Token counts against the library itself, text by text."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trolley.llm import token_counts as TC

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "  ", "\n\n  x", "It's we'll I'VE 'sabc ''s 's's", "a  b\t\tc \n d e  f", "12 345a6٣²",
    "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endoftext", "naïve Übergröße 日本語テキスト العربية 👩‍👩‍👧 é",
    "՘ ꟎႔0 x", "\x85a\x1cb᠎c​d", "a" * 5000, "ab " * 70000, "\x00\x01 \x7f", "thatthing" * 3,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(documents, rows, parts=3):
    docs = documents(rows, parts)
    return TC.count_tokens(docs, TC.frequent_table(docs, PATH))


def test_equal_to_the_library(documents, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counted(documents, rows).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert got == sorted(want, key=str)


def test_all_characters_beside_each_other(library):
    """Every code point, in texts where its neighbours make its class matter."""
    counter = TC.Counts(open(PATH, encoding="utf-8").read(), {})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{x}{c}" for c in points[i : i + 97]) for i in range(0, len(points), 97 * 8) for x in "a ' 1"]
    assert counter.count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table_and_cache_only_change_the_speed(library, monkeypatch):
    json = open(PATH, encoding="utf-8").read()
    texts = [t for t in HARD if t] * 2
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TC.Counts(json, {}).count(texts) == want
    full = TC.Counts(json, {p: len(library.encode(p).ids) for t in texts for p in TC.Counts(json, {}).pattern.findall(t)})
    assert full.count(texts) == want and full.misses == 0
    again = TC.Counts(json, {})
    again.count(texts)
    first = again.misses
    again.count([t for t in texts if len(t) < 100])
    assert again.misses == first  # remembered
    monkeypatch.setattr(TC, "CACHE_SIZE", 4)
    monkeypatch.setattr(TC, "SLICE", 16)
    small = TC.Counts(json, {})
    assert small.count(texts) == want and len(small.cache) <= 4


def test_plan_has_no_shuffle_and_other_columns_do_not_matter(documents, library):
    docs = documents([(1, "some text"), (2, None)]).selectExpr("*", "1 AS n_tokens", "2 AS n_bytes", "3 AS _text")
    out = TC.count_tokens(docs, TC.frequent_table(docs, PATH))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Scan")[0].split("MapInArrow")[0]
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(1, len(library.encode("some text").ids)), (2, 0)]


def test_empty_table(documents):
    assert counted(documents, [(1, "x")]).where("doc_id > 1").count() == 0
    docs = documents([(1, "x")]).where("doc_id > 1")
    assert TC.count_tokens(docs, TC.frequent_table(docs, PATH)).collect() == []
