"""Token ids by the tokenizers library, with a word cache in each Python worker.

Words repeat far more often than texts. A text of ordinary Latin characters is cut into the
pre-tokenizer's pieces and each new piece is encoded once by the library's model; any other text, and one
that holds the string of a token added to the vocabulary, is encoded whole by the library. Its
default stands: such a string is that one token. ``special_as_text`` reads it as ordinary text. Ids are two bytes each, as the vocabulary has under 65,536.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Pieces in each of the two generations that a worker keeps, beside those of its last text.
CACHE_WORDS = 350_000

#: Letters, digits and white space of the plain alphabet below, as the pre-tokenizer classes them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r "
_PLAIN_ELSE = "[^\t\n\r -~\xa1-\xac\xae-ɏ]"


def _cutter(letters: str, digits: str) -> re.Pattern[str]:
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{digits}]+| ?[^{_S}{letters}{digits}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Of short classes a text is cut faster.
_PIECE, _ASCII_PIECE = _cutter(_L, _N), _cutter("A-Za-z", "0-9")


def _byte_level() -> dict[int, str]:
    """The characters by which the model's vocabulary writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}


_BYTE_LEVEL = _byte_level()


class _Known(dict):
    """Ids by piece; the model encodes what this and the older generation lack."""

    def __init__(self, model_tokens: Callable[[str], list], older: dict[str, bytes]):
        self.model_tokens, self.older = model_tokens, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("H", [t.id for t in self.model_tokens(piece.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        self[piece] = ids
        return ids


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_PLAIN_ELSE, *map(re.escape, self.added)]))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")
        self.known = _Known(self.tokenizer.model.tokenize, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 16-bit numbers."""
        out: list[bytes | None] = []
        for x in texts:
            if x.isascii():  # the test of ``self.whole``, in less time
                whole, cutter = not x.replace("\n", "").replace("\t", "").replace("\r", "").isprintable() or any(t in x for t in self.added), _ASCII_PIECE
            else:
                whole, cutter = self.whole.search(x), _PIECE
            if whole:
                out.append(None)
                continue
            out.append(b"".join(map(self.known.__getitem__, cutter.findall(x))))
            if len(self.known) > CACHE_WORDS:
                self.known.older = {}
                self.known = _Known(self.known.model_tokens, self.known)
        rest = iter(self._library([x for x, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(rest) if ids is None else ids for ids in out]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path, special_as_text)
