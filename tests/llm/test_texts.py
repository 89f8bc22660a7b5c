"""Problems 6, 7 and 8."""

import base64
import random

import pytest

from lamella.llm import leak, pii, tokens
from lamella.llm.pii_examples import compose
from lamella.llm.words import words

ODD = [None, "", "   \n\t", "plain text", "café naïve é", "漢字かな🔋👩‍🔬", "<|endoftext|> x", "a" * 5000, "it's we'll 'S  123456\r\n\r\n  end "]


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(tokens.DEFAULT_RANKS)


def test_ids_match_the_merges(ranks):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, r = tokens.Encoder(ranks), random.Random(3)
    texts = ODD + ["".join(r.choice("abet hing'sé漢🔋 \n\t01-=tio") for _ in range(r.randrange(80))) for _ in range(800)] + ["".join(r.choice("aeinrst") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert e.encode(t) == ref.encode_ordinary(t or "")
    bytes_of = {i: b for b, i in ranks.items()}
    for t in texts:
        assert "".join(tokens.decode_stream(e.encode(t), bytes_of)) == (t or "")


def test_stream_decoder_at_any_cut():
    r = random.Random(1)
    for _ in range(400):
        b = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x94, 0x8B, 0xED, 0xA0, 0x80, 0xFF]) for _ in range(16))
        m, cut = tokens.Utf8Stream(), r.randrange(17)
        assert m.feed(b[:cut]) + m.feed(b[cut:]) + m.close() == b.decode("utf-8", "replace")


def test_corpus_ids(spark):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(ODD)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.corpus_ids(df).collect()}
    assert got[0] == [] and got[1] == [] and got[2] and len(got) == len(ODD)
    assert tokens.corpus_ids(df.limit(0)).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
SHORT = "alpha beta gamma delta epsilon zeta eta theta"
DOCS = [
    (1, "xx " + " ".join(ITEM.split()[:12]) + " yy"), (2, " ".join(ITEM.split()[:11]) + " zz"), (3, ITEM.upper().replace(" ", ", ")), (4, "<b>one</b> two three four five six se-\n> ven eight n​ine ten elev­en twelve"),
    (5, "pre " + SHORT + " post"), (6, " ".join(SHORT.split()[:7])), (7, None), (8, ""), (9, " \n"), (10, "Ｏne two three four five six seven eight nine ten *eleven* __twelve__"), (11, "w " * 30000 + ITEM),
]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_leaks_by_both_ways(spark, bound):
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "s"), (1, ITEM, "s"), (2, SHORT, "s"), (3, None, "s"), (4, "...", "s"), (5, "", "s")], "item_id bigint, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in leak.leaked_items(docs, items, item_words=bound).collect()]
    assert sorted(got) == [(1, 1), (3, 1), (4, 1), (5, 2), (10, 1), (11, 1)]
    assert leak.leaked_items(docs, items.limit(0), item_words=bound).count() == 0
    assert leak.leaked_items(docs.limit(0), items, item_words=bound).count() == 0


def test_both_ways_agree_on_the_tables(spark):
    from tests.conftest import SMALL

    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "eval_items"))
    one, two = ({tuple(r) for r in leak.leaked_items(docs, items, item_words=n).collect()} for n in (10**7, 0))
    assert one == two and one


def test_leaks_match_brute_force():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 40)))) for i in range(60)]
    docs = [" ".join(r.choice(vocab) for _ in range(300)) + " " + r.choice(texts)[1] for _ in range(30)]
    held = leak.Items(texts)
    from lamella.llm.words import WordHash

    h = WordHash()
    got = set(held.given_away([h(words(d)) for d in docs]))
    want = {(n, i) for n, d in enumerate(docs) for i, t in texts if any(f" {' '.join(t.split()[k : k + m])} " in f" {d} " for m in [min(12, len(t.split()))] for k in range(len(t.split()) - m + 1))}
    assert got == want


def test_words():
    assert words(f"one <span title='{'x ' * 400}'>two</span> three") == ["one", "two", "three"]
    assert words("PrÃ¼fbogen Pr&uuml;fbogen Prüfbogen prüf-\r\nbogen oﬀen") == ["prüfbogen"] * 4 + ["offen"]
    assert words(None) == [] and words(" ") == []


@pytest.fixture(scope="module")
def finder():
    return pii.fit_finder(["Fenna", "Orlan", "Élodie", "Jacinto", "Petra", "Quill"], examples=3000)


def test_held_out_accuracy(finder):
    """At least 0.95 of the places of composed texts of another seed, and at most 0.03 false ones."""
    hit = miss = false = 0
    for text, truth in compose(500, sorted(finder.given), 77):
        got, want = {(k, a) for k, a, _ in finder.find(text)}, {(k, a) for k, a, _ in truth}
        hit, miss, false = hit + len(got & want), miss + len(want - got), false + len(got - want)
    assert hit / (hit + miss) > 0.95 and false / (hit + false) < 0.03


def test_found_places(finder):
    t = "From: Fenna Tarrwick <f.wick AT lab DOT example>\nCall (555) 010-2252 if lane 6 stalls. Badge HL-05-75852 was used to open the chamber. Order no. 9178-258-L, catalogue 321-6242, shelf 52."
    assert {(k, t[a:b]) for k, a, b in finder.find(t)} == {("name", "Fenna Tarrwick"), ("email", "f.wick AT lab DOT example"), ("phone", "(555) 010-2252"), ("id_number", "HL-05-75852")}
    assert "[EMAIL]" in pii.redact(t, finder.find(t)) and pii.redact(None, []) is None


@pytest.mark.parametrize("text", [None, "", " \n ", "1 " * 20000, "A" * 50000, "a.b-" * 9000, "+1-" * 9000, "x@" * 9000])
def test_odd_texts_end_soon(finder, text):
    import time

    began = time.time()
    finder.find(text)
    assert time.time() - began < 20


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Note by Petra Kestbury: retake needed.", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, kind string")
    names = spark.createDataFrame([("Petra", "en"), (None, "de"), ("Petra", "fr")], "given string, lang string")
    assert [tuple(r) for r in pii.find_personal(docs, names).collect()] == [(1, "name", 8)]
    got = {r["doc_id"]: (r["redacted"], r["n_places"]) for r in pii.redact_personal(docs, names).collect()}
    assert got == {1: ("Note by [NAME]: retake needed.", 1), 2: (None, 0), 3: ("", 0)}


def test_rank_file_is_not_copied():
    assert base64 and "/opt/tokenizers/" in tokens.DEFAULT_RANKS
