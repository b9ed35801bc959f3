"""Statistics of whole texts, in numpy, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from cellgrid.llm.shingles import windows, word_hashes

#: ASCII white space that ends a word: bytes 09-0D and 20, as ``bytes.split`` cuts.
BLANK = bytes([*range(0x09, 0x0E), 0x20])
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 8
#: A mark that ends a word.
ENDED = (b"! ", b"% ", b"* ", b"# ", b"& ", b"$ ")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: np.ndarray, width: int = REPEAT_WIDTH) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    runs = windows(words, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    equal = runs[order[1:]] == runs[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(ends[:-1])))


def code_points(counts: np.ndarray) -> int:
    """Code points of a UTF-8 text, from its byte counts: all bytes but continuation bytes."""
    return int(counts.sum() - counts[0x80:0xC0].sum())


def base_stats(text: bytes) -> tuple[tuple[int, ...], list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """The five base statistics, and words, word hashes, byte counts and wordy lines for further ones."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    hashes = word_hashes(words)
    lines = [line for line in text.split(b"\n") if line.strip(BLANK)]
    base = (
        len(words),
        code_points(counts) - int(counts[list(BLANK)].sum()),
        int(counts[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated(hashes),
    )
    return base, words, hashes, counts, lines


FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "punctuation", "marks", "non_ascii",
    "distinct_words", "top_word", "words_per_line", "marked_words", "exclaims", "bars", "blank", "numeric_words",
)


def features(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """Base statistics and the ratios that models learn from, all finite, for any text."""
    base, words, hashes, counts, lines = base_stats(text)
    n_words, chars, symbols, dup_lines, repeats = base
    total, n = max(code_points(counts), 1), max(n_words, 1)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    ascii_marks = int(counts[33:127].sum()) - upper - lower - digits
    commas = int(counts[[0x2C, 0x2E]].sum())
    if n_words:
        _, per_word = np.unique(hashes, return_counts=True)
        distinct, top = len(per_word) / n, int(per_word.max()) / n
    else:
        distinct, top = 1.0, 0.0
    marked = sum(text.count(mark) for mark in ENDED)
    numeric = digits / max(chars, 1)
    return base, [
        float(np.log1p(n_words)), chars / n, symbols / n, dup_lines / max(len(lines), 1), repeats / n, upper / max(upper + lower, 1), digits / total,
        ascii_marks / total, (ascii_marks - commas) / n, int(counts[0xC0:].sum()) / total, distinct, top, n / max(len(lines), 1), marked / n,
        int(counts[0x21]) / n, int(counts[0x7C]) / n, int(counts[list(BLANK)].sum()) / total, numeric,
    ]
