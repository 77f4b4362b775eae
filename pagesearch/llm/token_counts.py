"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

A chunk is encoded with some text of the one before it. What a tokenizer of this kind does from a piece
boundary on depends only on the text from there on, so where a boundary of the chunk before (known to be
right, and not within reach of that chunk's end) is also a boundary in the new chunk, both agree for good:
there the counts are spliced. If the overlap has no such place, it is widened until it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import texts
from pagesearch.llm.tokens import _END, _LETTERS, Generations, _plain, _spelled, load

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK, OVERLAP = 1 << 16, 256   # characters; longer texts are cut
_SPLIT = re.compile(r"(?<=\S) ")
_IRREGULAR = re.compile(r"\s ")


class Counter(Generations):
    """Tokens of a word behind one space (key: the word), for a tokenizer that keeps white space."""

    def __init__(self, name: str = TOKENIZER):
        super().__init__()
        self.tokenizer = load(name)
        self.model = self.tokenizer.model
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # no piece before this distance of a chunk's end can depend on what follows: special strings, contractions
        self.reach = max([8, *map(len, specials)])

    def _count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def make(self, word: str) -> int:
        if word and _plain(word):
            return len(self.model.tokenize(_LETTERS[32] + (word if word.isascii() else _spelled(word))))
        if len(word) > 1 and word[-1] in _END and _plain(word[:-1]):
            return self[word[:-1]] + 1
        return self._count(" " + word)

    def short(self, text: str) -> int:
        """Count by parts: a space behind anything but white space always starts a piece of its own."""
        words = text.split(" ") if not text.startswith(" ") and not _IRREGULAR.search(text) else _SPLIT.split(text)
        return self._count(words[0]) + sum(map(self.__getitem__, words[1:]))

    def _pieces(self, text: str) -> tuple[np.ndarray, int]:
        """Where pieces start, as rows (character, tokens before it), and the number of tokens."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        words, offsets = encoding.word_ids, encoding.offsets
        starts = [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1] or words[i] is None]
        return np.array(starts, dtype=np.int64).reshape(-1, 2), len(words)

    def long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Count by overlapping chunks; memory is bounded by the chunk, unless the text has no boundaries."""
        total, begin = 0, 0             # tokens before ``begin``, a boundary that is known to be right
        while True:
            end = min(len(text), begin + chunk)
            starts, count = self._pieces(text[begin:end])
            if end == len(text):
                return total + count
            safe = starts[starts[:, 0] + begin <= end - self.reach]
            width = overlap
            while True:
                again = max(begin, end - width)
                follow = min(len(text), again + chunk)
                other, _ = self._pieces(text[again:min(follow, end + overlap)])
                agreed = np.intersect1d(safe[:, 0] + begin, other[other[:, 0] > 0][:, 0] + again)
                if len(agreed):
                    break
                if again == begin:      # one piece as long as the chunk: take more text at a time
                    return total + self.long(text[begin:], chunk * 2, overlap)
                width *= 2
            total += int(safe[np.searchsorted(safe[:, 0] + begin, agreed[-1]), 1])
            begin = int(agreed[-1])


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    A null or empty text has no bytes and no tokens. Repeated rows count each; an empty table gives no
    rows; other columns are ignored. Special strings inside a text count as the library's default has it.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer)
        for batch in batches:
            numbers = [counter.short(t) if len(t) <= chunk else counter.long(t, chunk, overlap) for t in batch["text"]]
            out = batch[["doc_id", "n_bytes"]].astype({"doc_id": "Int64"})
            out["n_tokens"] = np.array(numbers, dtype=np.int64)
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    text = F.coalesce("text", F.lit(""))
    return (texts(docs).select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
            .mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


_counters: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    """One per worker, so that the words' cache outlives a task."""
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def op8_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
