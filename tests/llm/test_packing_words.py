"""The word table of packing: the ids of the plain tokenizer, whatever the table has room for."""

from __future__ import annotations

import random
import string
import sys

import pytest
from tokenizers import Tokenizer

from hookflow.llm import packing, queries


@pytest.mark.parametrize(("known", "at_once"), [(1 << 18, 1 << 16), (40, 16), (5, 1)])
def test_ids_are_those_of_whole_texts(monkeypatch, known, at_once):
    monkeypatch.setattr(packing, "_WORDS_KNOWN", known)
    monkeypatch.setattr(packing, "_WORDS_AT_ONCE", at_once)
    rng = random.Random(4)
    odd = ["Word.", "word,", "word", "WORD.", "é.", "É", "İstanbul", "été", "क़", "ẖ", "H̱", "it's", "'s", "<|endoftext|>", "a<|startoftext|>b", "...", "x..", "5.", "3,000", "​", "ß", "ﬁ", "中文", "\U0001f600", "a_b", "?!", "</w>", "x</w>", *(w + m for w in ("ab", "né", "É", "中", "x1", "--", "e\u0301") for m in string.punctuation)]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.4 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["", " \n\t ", None]
    path = queries.tokenizer_path()
    words, plain = packing._WordIds(path), Tokenizer.from_file(path)
    got = [ids.tolist() for ids in words.texts([None if t is None else t.encode() for t in texts])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids + [packing.END_OF_DOCUMENT] for t in texts]
    assert len(words) <= known + at_once + max(len((t or "").split()) for t in texts)


def test_nothing_outlives_a_task():
    import sys

    list(packing._WordIds(queries.tokenizer_path()).texts([b"one two"]))
    assert not [name for name in sys.modules if name.startswith("hookflow_llm")]


def test_ascii_words_are_split_all_at_once(monkeypatch):
    words = packing._WordIds(queries.tokenizer_path())
    odd = ["Word.", "a.", ".", "..", "x", "X", "5.", "it's", "né.", "É", "中!", "H̱", "a<|b|>c", "<|endoftext|>", "<|", "ab<", "Ab|", "--", "e\u0301,"]
    rng = random.Random(5)
    for n in (1, 2, 60):
        for _ in range(20):
            some = [w.encode() for w in rng.choices(odd, k=n)]
            forms, tails = words._forms(some)
            want = [words._form(w) for w in some]
            assert forms == [form for form, _ in want] and tails.tolist() == [words.tails[mark][0] if mark else -1 for _, mark in want]
    single, form = [], words._form
    monkeypatch.setattr(words, "_form", lambda word: single.append(word) or form(word))
    list(words.texts(["Plain words, marks; and né. 中!".encode()]))
    assert single == ["né.".encode(), "中!".encode()]


def test_plain_words_go_by_the_model_alone():
    path = queries.tokenizer_path()
    words, plain, asked = packing._WordIds(path), Tokenizer.from_file(path), []

    class Asked:
        def encode(self, words, **how):
            asked.extend(words)
            return plain.encode(words, **how)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts[0].split())
            return plain.encode_batch_fast(texts, **how)

    words.tokenizer = Asked()
    rng = random.Random(6)
    some = ["".join(rng.choices("abestvrmld" if rng.random() < 0.5 else "abßéÿñstvml09'!.-_$<>|&", k=rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(w for w in some if "<|" not in w) + " Some words, été größe straße!! it's 'll-x a'b $$$ (459) a.b@c.de ÿ word.%%%"
    assert next(words.texts([text.encode()])).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]
    assert asked == []
    odd = ["\u00c9clair", "na\u00efve\u00d72", "\u4e2d\u6587", "<|x", "\u00b5", "a\x00b", "e\u0301", "\u00f7", "x\u00a0y"]
    text = " ".join([*odd, "one", "more"])
    assert next(words.texts([text.encode()])).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]
    assert sorted(asked) == sorted(odd)


def test_no_call_for_each_word():
    rng = random.Random(7)
    some = ["".join(rng.choices(string.ascii_letters, k=9)) + rng.choice(["", "", ",", "."]) for _ in range(20_000)]
    texts = [" ".join(some[i : i + 50]).encode() for i in range(0, len(some), 50)]
    words, calls = packing._WordIds(queries.tokenizer_path()), []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        found = list(words.texts(texts))
    finally:
        sys.setprofile(None)
    assert len(found) == len(texts) and len(calls) < len(some) // 10


def test_a_form_is_a_word_of_the_table():
    path = queries.tokenizer_path()
    words, plain, asked = packing._WordIds(path), Tokenizer.from_file(path), []
    model, tokenise = words.model, words._tokenise
    words._tokenise = lambda forms: asked.extend(forms) or tokenise(forms)
    for text in ("Apple, apple pear.", "APPLE pear Pear!", "R\u00e9el, r\u00e9el", "apple. plum;", "plum R\u00e9el"):
        assert next(words.texts([text.encode()])).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]
    assert asked == [w.encode() for w in ("apple", "pear", "r\u00e9el", "R\u00e9el", "plum")] and words.model is model


def test_capitals_of_ascii_need_no_normaliser():
    path = queries.tokenizer_path()
    words, plain = packing._WordIds(path), Tokenizer.from_file(path)
    words.tokenizer = None
    text = "R\u00e9r\u00e9ement StRASS\u00df\u00e9 Ch\u00e4l-Ich'S A\u00f1O%% N\u00e3O. GR\u00f6\u00dfe,"
    assert next(words.texts([text.encode()])).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]


def test_blanks_of_any_kind_and_number():
    path = queries.tokenizer_path()
    words, plain = packing._WordIds(path), Tokenizer.from_file(path)
    texts = ["", " ", " a", "a ", "\n\na \t b\r\n", None, "a\x0bb\x0c c", "a", "", "b", "\x1c", " \x85 a\u00a0b "]
    got = [ids.tolist() for ids in words.texts([None if t is None else t.encode() for t in texts])]
    assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, packing.END_OF_DOCUMENT] for t in texts]
    assert list(words.texts([])) == []
