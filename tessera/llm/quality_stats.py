"""Statistics of a document's words and lines, as the quality rules read them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WINDOW = 5
_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PUNCTUATION = b"!?.,;:"
_SENTENCE_END = re.compile(rb"[.!?](?=[\x20\x09-\x0D]|$)")

#: What ``document_stats`` returns, in this order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = (
    "n_lines", "n_bytes", "upper", "digits", "punctuation", "end_marks", "distinct_words", "longest_word", "top_word", "short_words",
)


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a run of ``window`` words found twice or more, the first run's included."""
    if len(words) < window + 1:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    kinds, runs = len(numbers), ids[: len(ids) - window + 1].copy()
    for k in range(1, window):
        if kinds * len(numbers) >= 1 << 62:  # number the runs so far anew, before the codes overflow
            _, runs = np.unique(runs, return_inverse=True)
            kinds = int(runs.max()) + 1
        runs = runs * len(numbers) + ids[k : len(ids) - window + 1 + k]
        kinds *= len(numbers)
    _, of, count = np.unique(runs, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[of] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def document_stats(text: str | None) -> tuple[int, ...]:
    """BASE, then MORE, of one text; all 0 for a null, empty or blank one (but for lines and bytes)."""
    data = (text or "").encode()
    words = data.split()
    lines = data.split(b"\n")
    filled = [line for line in lines if line.strip(_BLANK)]
    joined = b"".join(words)
    counts = Counter(words)
    return (
        len(words), len(joined) if joined.isascii() else len(joined.decode()), _count(data, _SYMBOLS),
        len(filled) - len(set(filled)), repeated_words(words),
        len(filled), len(data), _count(data, _UPPER), _count(data, _DIGITS), _count(data, _PUNCTUATION),
        len(_SENTENCE_END.findall(data)), len(counts), max(map(len, words), default=0), max(counts.values(), default=0),
        sum(len(w) <= 2 for w in words),
    )
