import json
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segqa.llm import bpe

ODD = [
    "", " \n ", "Hello  WORLD don't 123 naïve <|endoftext|>日本 \n x", "ΟΔΟΣ ΣΑΣ", "İstanbul ﬁ ½ ² x\x1cy \x1d z",
    "<|ENDOFTEXT|><|startoftext|>abc<|startoftext|", "a" * 5001, "aaa aaaa aaaaa", "!!!???...''s 's'S", "é<|endoftext|>́",
    "🙂👍🏽 \x00 ﻿​  x\u0085y　z", "Ⅷ ४५ ٣ ₔ₝퉒", "word " * 20_000,
]


@pytest.fixture(scope="module")
def coder(vocabulary):
    with open(vocabulary, encoding="utf-8") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == expected, ascii(text[:80])
        assert coder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_equals_the_library_on_odd_texts(coder, library):
    same(coder, library, ODD)


def test_equals_the_library_on_mixed_scripts(coder, library):
    rnd = random.Random(3)
    ranges = [(32, 127), (0x80, 0x250), (0x300, 0x370), (0x370, 0x530), (0x1E00, 0x2100), (0xAC00, 0xD7A3)]
    texts = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) if rnd.random() < 0.85 else " " for _ in range(60)) for _ in range(500)]
    same(coder, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_equals_the_library_on_any_text(coder, library, texts):
    same(coder, library, texts)


def test_small_blocks_and_a_full_memory_change_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    same(coder, library, [f"text number {i} of theirs" for i in range(30)])


def test_refuses_other_vocabularies(vocabulary):
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="merge"):
        bpe.Vocabulary(json.dumps(spec))
    spec["model"]["end_of_word_suffix"] = None
    with pytest.raises(ValueError, match="word ends"):
        bpe.Vocabulary(json.dumps(spec))


def test_table_with_nulls_extra_and_clashing_columns(spark, vocabulary, library):
    df = spark.createDataFrame([(1, None, "x"), (None, "Two words", "y"), (None, "Two words", "y")], "doc_id long, text string, ids string")
    got = bpe.encode(df, "text", vocabulary, decoded_col="back")
    assert got.columns == ["doc_id", "text", "ids", "back"]
    rows = got.collect()
    assert [r.ids for r in rows] == [[], *[library.encode("Two words", add_special_tokens=False).ids] * 2]
    assert [r.back for r in rows] == ["", "two</w> words</w>", "two</w> words</w>"]
    assert bpe.encode(df.limit(0), "text", vocabulary).count() == 0


def test_the_next_task_of_a_worker_knows_what_was_merged(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        source = type("Source", (), {"value": file.read()})
    texts = ["Unmistakably remembered words, twice.", None]
    first = [*bpe.encoder(source).encode(texts)]
    monkeypatch.setattr(bpe, "merge_words", None)
    assert [*bpe.encoder(source).encode(texts)] == first
