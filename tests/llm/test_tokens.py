import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import tokens
from tallyspark.llm.tokens import SpacedEncoder, WordEncoder, vocabulary

PATHS = {WordEncoder: vocabulary("word_bpe_49k.json"), SpacedEncoder: vocabulary("byte_bpe_50k.json")}
PLAIN = {kind: Tokenizer.from_file(path) for kind, path in PATHS.items()}
BATCHES = ["one two three's", "two three##$ four ÿ Ðe", "one two àé %% four'", "Two\n\nthree ñandú... (x) 7"]


def ids_of(encoder, texts):
    ids, start = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:z].tolist() for a, z in zip(start[:-1], start[1:], strict=True)]


@pytest.mark.parametrize("kind", list(PATHS))
@pytest.mark.parametrize("kept,size", [(0, 0), (4, 1 << 20), (1000, 60), (1000, 1 << 20)])
def test_what_is_kept_changes_no_ids(kind, kept, size, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", kept)
    monkeypatch.setattr(tokens, "KEPT_BYTES", size)
    encoder = kind(PATHS[kind])
    for text in BATCHES * 2:
        assert ids_of(encoder, [text]) == [PLAIN[kind].encode(text, add_special_tokens=False).ids]
        for known in (encoder.kept_words, encoder.kept_others):
            assert len(known.strings) <= kept and known.strings.nbytes <= max(size, known.strings[:0].nbytes) and known.begin[-1] == len(known.ids)


@pytest.mark.parametrize("kind", list(PATHS))
def test_words_of_an_earlier_batch_are_not_encoded_again(kind, monkeypatch):
    encoder, asked = kind(PATHS[kind]), []
    model_ids = encoder.model_ids
    monkeypatch.setattr(encoder, "model_ids", lambda words, *a: asked.extend(words.to_pylist()) or model_ids(words, *a))
    for text in BATCHES:
        encoder.encode(pa.array([text]))
    first = len(asked)
    for text in BATCHES:
        encoder.encode(pa.array([text]))
    assert first and len(asked) == first


@pytest.mark.parametrize("kind", list(PATHS))
def test_words_with_any_marks_behind_are_plain(kind, monkeypatch):
    encoder, asked = kind(PATHS[kind]), []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: asked.extend(texts) or whole(texts))
    text = " ".join(f"wörd{m}" for m in (*string.punctuation, "###", "'*'", "[]", "\\-^"))
    assert ids_of(encoder, [text]) == [PLAIN[kind].encode(text, add_special_tokens=False).ids]
    assert not any("w" in x for x in asked)


@pytest.mark.parametrize("kind", list(PATHS))
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abS ÀÞßåÿ­́" + string.punctuation + "\n")), max_size=25), max_size=5))
def test_marks_of_all_kinds_give_the_ids_of_the_whole_text(kind, texts):
    encoder = ENCODERS[kind]
    assert ids_of(encoder, texts) == [PLAIN[kind].encode(t, add_special_tokens=False).ids for t in texts]


ENCODERS = {kind: kind(path) for kind, path in PATHS.items()}


def test_every_letter_as_the_characters_of_the_model():
    for c in tokens._EACH_LETTER + " ":
        ids = PLAIN[SpacedEncoder].encode(c, add_special_tokens=False).ids
        assert tokens.as_characters(c.encode()) == "".join(PLAIN[SpacedEncoder].id_to_token(i) for i in ids)
    assert np.array_equal(np.frombuffer(tokens.as_characters(b"a\nb").encode(), np.uint8), np.frombuffer(b"a\nb", np.uint8))
