import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lookalike as L

SAME = [
    ("Hello", "Ｈｅｌｌｏ"), ("café", "café"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "﻿a­b"), ("соре", "cope"), ("ΑΒΕ", "ABE"),
    ("ガ", "ｶﾞ"), ("パ", "ﾊﾟ"), ("ё", "ë"), ("ệ", "ệ"), ("a͏b", "ab"), ("ｃоpе", "cope"), ("Ǻ", "Ǻ"), ("x y", "x y"), ("a️", "a"), ("όх", "óx"), ("á​̣", "ạ́"),
]
DIFFER = [("O", "0"), ("l", "1"), ("rn", "m"), ("A", "a"), ("cafe", "café"), ("a  b", "a b"), ("a\nb", "a\r\nb"), ("a.", "a"), ("В", "b"), ("ﬁ", "fi"), ("²", "2"), ("—", "-"), ("00:01", "00:02"), ("Ã©", "é"), ("\tb", " b"), ("к", "K"), ("½", "1/2"), ("’", "'")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert L.skeleton(a) == L.skeleton(b)


@pytest.mark.parametrize("a,b", DIFFER)
def test_differ(a, b):
    assert L.skeleton(a) != L.skeleton(b)


def test_skeleton_is_stable():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(32, 0x600), r.randrange(0x2000, 0x2070), r.randrange(0x3000, 0x3100), r.randrange(0xFF00, 0xFFEF)])) for _ in range(20))
        form = L.skeleton(text)
        assert L.skeleton(form) == form and L.skeleton(unicodedata.normalize("NFC", text)) == form


MORE = [("αγρυ", "aypu"), ("ꓐꓢ", "BS"), ("Ⲟ", "O"), ("ᗷ", "B"), ("ⲟ", "o"), ("Ѵ", "V"), ("к", "κ"), ("Г", "Γ"), ("г", "r")]
APART = [*DIFFER, ("Ь", "b"), ("З", "3"), ("б", "6"), ("I", "l"), ("О", "0"), ("𝐀", "A"), ("Ⅳ", "IV"), ("ɑ", "a"), ("ƨ", "2"), ("Ꮟ", "b"), ("m", "rn"), ("м", "м́")]


def test_public_table(spark):
    table = L._Table(L.look_alike_table(spark))
    for a, b in [*SAME, *MORE]:
        assert L.skeleton(a, table) == L.skeleton(b, table), (a, b)
    for a, b in APART:
        assert L.skeleton(a, table) != L.skeleton(b, table), (a, b)
    assert len(table) > 1000 and not any(o < 0x80 and chr(o).isprintable() for o in L.look_alike_table(spark))
    plain = L.look_alike_table(spark)
    assert all(plain.get(ord(x), x) == x for form in plain.values() for x in form)  # what comes out stays
    for o, form in plain.items():  # capital with capital, small with small
        if form.isascii() and form.isalpha() and unicodedata.category(chr(o)) in ("Lu", "Ll"):
            assert form.isupper() == (unicodedata.category(chr(o)) == "Lu"), (chr(o), form)


def variants(text, r):
    swap = {a: b for many, plain in L.SAME_SHAPE for b, a in zip(many, plain)}
    return "".join(swap.get(c, c) if r.random() < 0.3 else c + r.choice(["", "", "​"]) for c in text)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["the lantern waits", "accept Port cash", "", None, "  \n", "​", "другой"]
    rows = [(i, "hot copy of one text" if r.random() < 0.35 else (t if (t := r.choice(base)) is None or r.random() < 0.5 else variants(t, r))) for i in range(150)]
    rows += [(1000, variants("hot copy of one text", random.Random(9))), (None, "the lantern waits"), (1001, LONG := "word " * 30000), (1002, LONG.replace("o", "о"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form_key", F.lit(1))
    got = sorted(tuple(x) for x in L.lookalike_pairs(df).collect())
    seen = [(d, t) for d, t in rows if d is not None and t and L.skeleton(t).strip()]
    want = sorted((min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(seen, 2) if s != t and L.skeleton(s) == L.skeleton(t))
    assert got == want and (1001, 1002) in got


def test_large_spelling_is_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_PART", 20)
    rows = [(i, "one text of many copies") for i in range(500)] + [(1000, "one text of many cоpies"), (1001, "one\u00a0text of many copies"), (1002, "other")]
    got = {tuple(r) for r in L.lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(i, v) for i in range(500) for v in (1000, 1001)} | {(1000, 1001)}


def test_form_of_many_spellings_is_joined_in_slices(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_FORM", 5)
    monkeypatch.setattr(L, "PER_SLOT", 3)
    rows = [(i, "wait" + "\u200b" * i + " here") for i in range(40)] + [(100 + i, "wait here") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    members = L.lookalike_classes(L.fingerprints(df))
    assert {r.slices for r in members.collect()} == {8} and members.count() == 50
    got = sorted(tuple(r) for r in L.lookalike_pairs(df).collect())
    assert got == sorted((min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(rows, 2) if s != t)


def test_forms_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Ｈi")], "doc_id bigint, text string")
    assert {tuple(r) for r in L.normalised(df, ["doc_id"]).collect()} == {(1, None), (2, ""), (3, "Hi")}
    assert L.lookalike_pairs(df.limit(0)).count() == 0 and L.lookalike_pairs(df).count() == 0
