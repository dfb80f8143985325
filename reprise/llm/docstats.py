"""Statistics of one text: the counts that rules use and the features that models use.

Nulls count as empty texts; an empty text has zero everywhere.
"""

from __future__ import annotations

from collections import Counter
from math import log1p
from operator import eq
from typing import NamedTuple

from reprise.llm.common import SEPARATORS, words_of

# Fixed value: the characters [#*$%&|<>] that count as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_HIGH = bytes(range(128, 256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def _base(text: str, words: list[bytes], dup_lines: int) -> Base:
    chars = len(text) - sum(map(text.count, SEPARATORS))
    return Base(len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated_words(words))


def base_stats(text: str | None) -> Base:
    text = text or ""
    return _base(text, words_of(text), duplicate_lines(text)[1])


FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_word_share", "bang_rate", "bar_rate", "stop_rate", "comma_rate",
    "upper_share", "digit_share", "high_share", "punctuation_share", "distinct_words", "distinct_bytes", "line_words", "longest_word", "upper_words", "mark_words", "echo_words",
)


def features(text: str | None) -> tuple[Base, list[float]]:
    """The base counts and the values of FEATURES, all from the whole text and nothing else."""
    text = text or ""
    words, raw = words_of(text), text.encode()
    n_lines, dup_lines = duplicate_lines(text)
    base = _base(text, words, dup_lines)
    n, size = max(1, base.n_words), max(1, len(raw))

    def of(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    upper, lower = of(_UPPER), of(_LOWER)
    distinct = set(words)
    return base, [
        log1p(base.n_words), base.word_chars / n, base.n_symbols / max(1, base.word_chars), dup_lines / max(1, n_lines), base.n_repeat_words / n,
        raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n,
        upper / max(1, upper + lower), of(_DIGITS) / size, of(_HIGH) / size, of(_PUNCTUATION) / size,
        len(distinct) / n**0.75, len(set(raw)) / 32, log1p(n / max(1, n_lines)), log1p(max(map(len, distinct), default=0)),
        sum(map(bytes.isupper, words)) / n, sum(w[-1:] in b"#*$%&!" for w in words) / n, sum(map(eq, words, words[1:])) / n,
    ]
