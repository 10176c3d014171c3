import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import tokens as K

LONG = "".join(f"{i}\n00:{i % 60:02d}:07,{i % 1000:03d} --> 00:{i % 60:02d}:09,000\nThe lantern can't wait, đèn lồng {i}.\r\n\r\n" for i in range(1500))
TEXTS = [
    None, "", " ", "\n\n", "a", "Hello world", LONG, LONG[5000:], "x" + LONG, "パン屋さん。" * 3000, "a" * 20000, "  \t\r\n" * 500, "<|endoftext|> is text", "é́" * 900, "🎬🎵 " * 800,
    "　全角　スペース nbsp thin" * 60, LONG,
]


def brute(text):
    return K.encoder().encode_ordinary(text) if text else []


def ids(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, list(r.ids)) for r in K.encode_corpus(df, **kw).collect()), key=repr)


def test_encode_equals_whole_texts(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id"), (None, LONG), (6, "same id")]
    assert ids(spark, rows) == sorted(((d, brute(t)) for d, t in rows), key=repr)


def test_hot_text_many_copies(spark):
    rows = [(i, LONG[:3000] if i % 3 == 0 else f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)  # one task meets 300 copies
    assert sorted((r.doc_id, list(r.ids)) for r in K.encode_corpus(df).collect()) == sorted((d, brute(t)) for d, t in rows)


class Part:
    @staticmethod
    def get():
        return Part

    @staticmethod
    def partitionId():
        return 3


def in_process(texts):
    """The three steps without Spark, so that their constants can be small."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    pieces = pa.Table.from_batches(K._split(iter([batch.slice(0, 1), batch.slice(1)]), K.encoder))
    grouped = pieces.sort_by([("key", "ascending"), ("place", "ascending"), ("again", "ascending")])
    encoded = pa.Table.from_batches(K._encode(iter(grouped.to_batches(max_chunksize=7)), K.encoder))
    ordered = encoded.sort_by([("row", "ascending"), ("pos", "ascending")])
    out = pa.Table.from_batches(K._assemble(iter(ordered.to_batches(max_chunksize=5)), "uint16"))
    return dict(zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist())), len(pieces)


WORD = st.sampled_from(["lantern", " can't", " it's", "\n", "\r\n", " ", "  ", "12", ":", "½", "日本語", " đèn", ".", "!?", "🎵", " "])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORD, max_size=60).map("".join), min_size=1, max_size=6))
def test_small_chunks_are_exact(texts):
    with pytest.MonkeyPatch.context() as m:
        for name, value in (("LEAST", 6), ("MASK", 3), ("TOGETHER", 2), ("REMEMBERED", 9), ("TaskContext", Part)):
            m.setattr(K, name, value)
        texts = [*texts, "".join(texts), texts[0] * 5, None, ""]
        got, pieces = in_process(texts)
        assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_small_chunks_have_seams(monkeypatch):
    for name, value in (("LEAST", 20), ("MASK", 7), ("TOGETHER", 2), ("TaskContext", Part)):
        monkeypatch.setattr(K, name, value)
    texts = [LONG[:9000], LONG[:9000], LONG[300:9000]]
    got, pieces = in_process(texts)
    assert got == {i: brute(t) for i, t in enumerate(texts)} and pieces > 300


def test_other_vocabulary_and_empty(spark):
    df = spark.createDataFrame([(1, "xin chào thế giới")], "doc_id int, text string")
    assert list(K.encode_corpus(df, vocabulary="byte_bpe_multi_50k").first().ids) == K.encoder(vocabulary="byte_bpe_multi_50k").encode_ordinary("xin chào thế giới")
    assert K.encode_corpus(df.limit(0)).count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)], "doc_id bigint, source string, text string")
    assert {r.doc_id: r.n_tokens for r in K.token_counts(df, ["doc_id", "source"]).collect()} == {i: len(brute(t)) for i, t in enumerate(TEXTS)}


def cuts(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data.tobytes(), K.chunk_cuts(data, np.array([0, len(data)], np.int64))[0]


def chunks(text):
    raw, found = cuts(text)
    at = [0, *(c for c, _, _ in found), len(raw)]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def test_seams_reach_certain_places():
    raw, found = cuts(LONG)
    safe = set(K.joins(np.frombuffer(raw, np.uint8)).tolist())
    assert any(a < c < b for c, a, b in found) and all({a, b} <= safe and a <= c <= b for c, a, b in found)
    assert all(b0 <= a1 for (_, _, b0), (_, a1, _) in zip(found, found[1:]))


PIECE = st.sampled_from(["a", "'s", "it's ", " don't", "12", "½", "\n", "\r\n", " ", "  ", "\t", "。", "日本", "é", " ", "　", "!", "...", "-->", "\x85", "🎵", "﻿", "ß", "x\n\ny", "，", "。", "、", "！", "？", "字", "カ", "の", "ー", "・", "〇", "々", "\u2003", "\u2028", "\u205f", "\u1680", "\u200b", "\x1c", "й", "\u0301", "\u3000", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, max_size=60))
def test_joins_are_exact(parts):
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = brute(text)
    for at in K.joins(data).tolist() if len(data) > 1 else []:
        assert brute(data[:at].tobytes().decode()) + brute(data[at:].tobytes().decode()) == whole


def test_chunks_are_content_defined():
    a, b = chunks(LONG), chunks("another beginning\n" * 40 + LONG)
    assert b"".join(a) == LONG.encode() and len(a) > 20
    assert len(set(a) & set(b)) >= len(a) - 3
    assert all(len(c) >= K.LEAST for c in a[:-1])


def test_rolling_hash_sees_window_only():
    r = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    full, part = K.rolling_hash(r), K.rolling_hash(r[100:])
    assert (full[100 + K.WINDOW :] == part[K.WINDOW :]).all()


def every_character():
    return [chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000]


def test_joins_before_white_space_for_every_character():
    """Each character of Unicode before a line end: if the place counts as a join, both sides encode as the whole."""
    coded = K.encoder().encode_ordinary
    n = 0
    for c in every_character()[::37] + [chr(o) for o in (*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3100))]:
        text = f"a{c}\n b"
        at = len(f"a{c}".encode())
        if at in K.joins(np.frombuffer(text.encode(), np.uint8)).tolist():
            n += 1
            assert coded(f"a{c}") + coded("\n b") == coded(text)
        else:
            assert c.isspace()
    assert n > 25_000


def test_joins_after_ideographs():
    coded, n = K.encoder().encode_ordinary, 0
    for c in [chr(o) for o in (*range(0x3040, 0x3100), *range(0x3400, 0xA000, 7), *range(0xAC00, 0xD7A4, 501), *range(0xF900, 0xFB00, 3), *range(0xFF00, 0xFFF0))]:
        for mark in "。、，！？":
            text = f"x{c}{mark}'s字"
            at = len(f"x{c}".encode())
            if at in K.joins(np.frombuffer(text.encode(), np.uint8)).tolist():
                n += 1
                assert coded(f"x{c}") + coded(f"{mark}'s字") == coded(text)
    assert n > 10_000


@pytest.mark.parametrize("letters,end", [("我们在海边等了很久灯笼还没有亮起来你看见吗", "\n"), ("мыждалиуморяоченьдолгоифонарьнезажёгся", "\n"), ("我们在海边等了很久灯笼还没有亮起来你看见吗", "。"), ("カタカナとひらがな", "、")])
def test_other_scripts_are_cut(spark, letters, end):
    r = random.Random(5)
    text = "".join("".join(r.choices(letters, k=r.randrange(5, 30))) + end for _ in range(1500))
    raw, found = cuts(text)
    assert len(found) > 10
    assert ids(spark, [(1, text), (2, text[7:])]) == [(1, brute(text)), (2, brute(text[7:]))]
