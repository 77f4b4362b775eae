"""How many guesses a password takes, in bits: the cheapest way to put it together from guessable spans.

A value is cut into spans, and each span is a word, a date, a repeat, a keyboard walk or brute force. A span costs
KIND bits for its kind plus what its content takes to guess; the cost of a value is the least total over all
ways to cut it, found from left to right in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from math import log2

KIND = log2(5)
SHORTEST_WORD, LONGEST_WORD = 3, 24
LONGEST_UNIT = 8        # of a repeat
SHORTEST_WALK = 3
# Signs written for letters, and the rows of a keyboard with the offset of each row in half keys
LOOKALIKES = str.maketrans("0134579@$!", "oleastgasi")
ROWS = [("`1234567890-=", 0), ("qwertyuiop[]\\", 3), ("asdfghjkl;'", 4), ("zxcvbnm,./", 5)]
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?ABCDEFGHIJKLMNOPQRSTUVWXYZ', "`1234567890-=[]\\;',./abcdefghijklmnopqrstuvwxyz")
_KEYS = {key: (row, 2 * column + offset) for row, (keys, offset) in enumerate(ROWS) for column, key in enumerate(keys)}
YEAR = log2(150)
_DATES = [
    (re.compile(r"(?:19[0-9]{2}|20[0-4][0-9])"), YEAR),
    (re.compile(r"(?:19[0-9]{2}|20[0-4][0-9])(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"), YEAR + log2(366) + 2),
    (re.compile(r"(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])(?:19[0-9]{2}|20[0-4][0-9])"), YEAR + log2(366) + 2),
    (re.compile(r"(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{2}"), log2(100 * 366) + 2),
    (re.compile(r"(?:19[0-9]{2}|20[0-4][0-9])([-/._ ])(?:0?[1-9]|1[0-2])\1(?:[12][0-9]|3[01]|0?[1-9])"), YEAR + log2(366) + 4),
    (re.compile(r"(?:[12][0-9]|3[01]|0?[1-9])([-/._ ])(?:1[0-2]|0?[1-9])\1(?:19[0-9]{2}|20[0-4][0-9])"), YEAR + log2(366) + 4),
]


def plain_letters(value: str) -> str:
    """The value in lower-case ASCII letters, with signs read as the letters they stand for; same length."""
    lowered = "".join(c.lower() if c.isascii() else c for c in value)
    return lowered.translate(LOOKALIKES)


def word_pieces(value: str) -> set[str]:
    """Every piece of the value that may be a word."""
    letters = plain_letters(value)
    return {letters[i:j] for run in re.finditer("[a-z]{3,}", letters) for i in range(run.start(), run.end())
            for j in range(i + SHORTEST_WORD, min(i + LONGEST_WORD, run.end()) + 1)}


def character_cost(c: str) -> float:
    if not c.isascii():
        return 16.0
    return log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def spelling_cost(written: str, word: str) -> float:
    """Bits for the capitals and look-alikes of a word as it is written."""
    letters = [c for c in written if c.isalpha()]
    capitals = sum(c.isupper() for c in letters)
    if not capitals:
        cost = 0.0
    elif capitals == len(letters) or (capitals == 1 and written[0].isupper()):
        cost = 1.0
    else:
        cost = float(len(letters))
    return cost + sum(a != b for a, b in zip(written.lower(), word, strict=True))


def step_cost(value: str, i: int) -> float | None:
    """Bits of the key at place i behind the one before it; None when they are no neighbours."""
    def places(k: int) -> tuple[int, int] | None:
        return _KEYS.get(value[k].translate(SHIFTED))

    def move(k: int) -> tuple[int, int] | None:
        here, there = places(k - 1), places(k)
        if here is None or there is None:
            return None
        way = (there[0] - here[0], there[1] - here[1])
        return way if way in ((0, 2), (0, -2)) or (abs(way[0]) == 1 and abs(way[1]) <= 2 and way[1] != 0) else None

    way = move(i)
    if way is None:
        return None
    return 0.5 if i >= 2 and move(i - 1) == way else log2(6)


def dates(value: str, i: int) -> Iterator[tuple[int, float]]:
    for pattern, cost in _DATES:
        found = pattern.match(value, i)
        if found:
            yield found.end(), cost


def guess_bits(value: str, words: Mapping[str, float]) -> float:
    """The least cost of the value; ``words`` gives the bits of each word that may be in it. Empty: 0."""
    n = len(value)
    letters = plain_letters(value)
    inf = float("inf")
    best = [0.0] + [inf] * n        # of the first i characters, cut behind them
    open_brute = [inf] * (n + 1)    # the same, within a span of brute force
    walks = [[inf] * (n + 1) for _ in range(SHORTEST_WALK)]     # within a walk of 1, 2, 3 or more keys
    units: dict[str, float] = {}
    periodic = [0] * (LONGEST_UNIT + 1)     # where the run of each period that holds place i ends
    for i in range(n):
        base = best[i] + KIND
        open_brute[i + 1] = min(open_brute[i], base) + character_cost(value[i])
        walks[0][i + 1] = base + log2(len(_KEYS)) if value[i].translate(SHIFTED) in _KEYS else inf
        step = step_cost(value, i) if i else None
        if step is not None:
            # the first step of a walk has no direction before it
            walks[1][i + 1] = walks[0][i] + log2(6)
            walks[2][i + 1] = min(walks[1][i], walks[2][i]) + step
        best[i + 1] = min(best[i + 1], open_brute[i + 1], walks[2][i + 1])
        for j in range(i + SHORTEST_WORD, min(i + LONGEST_WORD, n) + 1):
            bits = words.get(letters[i:j])
            if bits is not None:
                best[j] = min(best[j], base + bits + spelling_cost(value[i:j], letters[i:j]))
        for j, bits in dates(value, i):
            best[j] = min(best[j], base + bits)
        for unit in range(1, min(LONGEST_UNIT, (n - i) // 2) + 1):
            if periodic[unit] < i + unit:   # else the run of this period is known from a start before
                end = i + unit
                while end < n and value[end] == value[end - unit]:
                    end += 1
                periodic[unit] = end
            times = (periodic[unit] - i) // unit
            end = i + times * unit
            if times > 1 and end - i >= 3:
                piece = value[i:i + unit]
                if piece not in units:
                    units[piece] = unit_bits(piece, words)
                best[end] = min(best[end], base + units[piece] + log2(times))
    return best[n]


def unit_bits(piece: str, words: Mapping[str, float]) -> float:
    """What one copy of a repeat takes: a word, else brute force."""
    letters = plain_letters(piece)
    brute = sum(map(character_cost, piece))
    return min(brute, words[letters] + spelling_cost(piece, letters)) if letters in words else brute
