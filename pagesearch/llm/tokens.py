"""Token ids and counts by public tokenizer files, word by word through bounded caches.

Both tokenizers split a text before they merge bytes, and never across the places used here, so the tokens
of a text are those of its parts in order. Distinct parts are encoded once per worker.
"""

from __future__ import annotations

import os
import sys
from array import array

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
from tokenizers import Tokenizer  # noqa: E402

CACHE_WORDS = 350_000   # per generation; two are held
_END = ".,;:!?"


def load(name: str) -> Tokenizer:
    """A tokenizer by the name of its public file, or by a path."""
    return Tokenizer.from_file(name if os.path.exists(name) else public_tokenizers.path(name))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = _byte_letters()


def _plain(word: str) -> bool:
    """Letters of Latin-1 only: one piece for both tokenizers, already composed, lower-cased letter by letter."""
    return word.isalpha() and (word.isascii() or max(word) < "Ā")


def _spelled(word: str) -> str:
    return "".join([_LETTERS[b] for b in word.encode()])


class Generations(dict):
    """A bounded cache: when it is full it becomes the old generation, from which words in use come back."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds(Generations):
    """Word (bytes, no white space) to its ids as little-endian 32-bit numbers, for a tokenizer that drops white space."""

    def __init__(self, name: str):
        super().__init__()
        self.tokenizer = load(name)
        self.model = self.tokenizer.model

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()

    def _encode(self, word: str) -> bytes:
        if _plain(word):
            spelled = word.lower()
            if not spelled.isascii():
                spelled = _spelled(spelled)
            return self._packed([t.id for t in self.model.tokenize(spelled)])
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def make(self, word: bytes) -> bytes:
        text = word.decode()
        if text[-1] in _END and _plain(text[:-1]):
            return self[text[:-1].encode()] + self[text[-1].encode()]
        return self._encode(text)


_word_ids: dict[str, WordIds] = {}


def text_ids(text: str | None, name: str) -> bytes:
    """Ids of a whole text; none for null. The words' cache lives as long as the worker."""
    if name not in _word_ids:
        _word_ids[name] = WordIds(name)
    return b"".join(map(_word_ids[name].__getitem__, (text or "").encode().split()))
