"""The encoder's own cutting: pieces go to the model alone, odd characters to the library."""

import numpy as np
import pytest

from threadloom.llm import tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def same(library, enc, texts):
    got = [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)]
    return got == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_new_pieces_need_no_second_cutting(library):
    """The tokenizer would cut them again, which takes longer than their encoding."""
    texts = ["Plain words, of 12 kinds...  and\n\nlines", "été, über ½ cœur", "I'll don't 'tis", ""]
    enc = tokens.Encoder(tokens.default_vocabulary())
    enc.tokenizer = None
    enc._library = lambda odd: [] if not odd else pytest.fail(str(odd))
    assert same(library, enc, texts)


def test_every_character_up_to_the_latin_letters_end(library):
    texts = [f"a{a}{chr(k)}{b}b" for k in range(0x260) for a in ("", " ") for b in ("", " ")] + [f"{chr(k)}\n" for k in range(0x260)]
    assert same(library, tokens.Encoder(tokens.default_vocabulary()), texts)


def test_ages_hold_one_older_generation(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    enc = tokens.Encoder(tokens.default_vocabulary())
    assert same(library, enc, ["a b c d", "a e f g h", "i j k l m", "é a b", "n"])
    assert not enc.known.older or not enc.known.older.older
