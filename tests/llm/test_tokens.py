import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import tokens as t

TEXTS = [
    None, "", " ", "\n\n\t ", "Hello world", "don't we're I'll", "<|endoftext|>", "naïve café 日本語のテキスト。漢字、かな", "a" * 30_000, "word " * 9_000, "x​﻿\x00\x1b[31m", "é" * 25_000,
    "mixed\r\nline\rends\n" * 2_000, "漢字かな。" * 9_000, "1234567890" * 4_000, " " * 25_000 + "end", "👩‍👩‍👧‍👦🏳️‍🌈" * 50, "=-" * 12_000, "don't " * 8_000, "a b c\x1cd\x85e" * 3_000,
]


@pytest.fixture(scope="module")
def ranks(spark):
    return t.rank_file(spark)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(4, "Hello world")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("i"), "n_tokens": F.lit(1)})


def whole(ranks, text):
    return list(t.encoding(ranks).encode_ordinary(text)) if text else []


def test_ids_are_those_of_the_whole_text(spark, ranks, frame):
    got = t.encode(frame, ranks).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.ids == whole(ranks, TEXTS[r.doc_id]) for r in got)
    assert {r.doc_id: r.n_tokens for r in t.count_tokens(frame, ranks).collect()} == {i: len(whole(ranks, x)) for i, x in enumerate(TEXTS)}


def test_other_library_agrees(ranks):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{t.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in TEXTS:
        if text and len(text) < 20_000:
            assert other.encode(text, add_special_tokens=False).ids == whole(ranks, text)


def test_pieces_at_random(ranks):
    rng = random.Random(7)
    parts = ["a", "B", "9", " ", "  ", "\n", "'s", "'", "é", "漢", "。", "-", " ", "\x1c", "don't", "👍", "\t"]
    bpe = t.encoding(ranks)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        limit = rng.randint(1, 20)
        assert "".join(t.safe_pieces(text, limit)) == text
        assert list(t.encode_text(bpe, text, limit)) == list(bpe.encode_ordinary(text))


def test_round_trip(spark, ranks, frame):
    got = t.decode(t.encode(frame, ranks), ranks).collect()
    assert all(r.text == (TEXTS[r.doc_id] or "") for r in got)


def test_cut_and_unknown_ids(spark, ranks):
    df = spark.createDataFrame([(1, whole(ranks, "漢")[:1]), (2, [999_999, -1]), (3, None), (4, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in t.decode(df, ranks).collect()} == {1: "�", 2: "", 3: "", 4: ""}


def test_empty_and_other_keys(spark, ranks):
    assert t.encode(spark.createDataFrame([], "doc_id bigint, text string"), ranks).collect() == []
    df = spark.createDataFrame([("k", "Hello world")], "name string, body string")
    row = t.encode(df, ranks, "name", "body").first()
    assert (row.name, row.ids) == ("k", whole(ranks, "Hello world"))
