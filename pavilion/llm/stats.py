"""Statistics of a whole text, the inputs of the quality operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

#: Columns of ``measure``.  Words are runs without ASCII white space, lines are split at \n.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_marks", "n_stops", "n_punct", "n_other", "n_distinct", "n_top", "n_adjacent",
)
#: Words of a window whose repetition counts.
WINDOW = 5

_CLASS = np.full(256, 7, np.uint8)  # other bytes: non-ASCII letters and the like
for _k, _members in enumerate((b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?", b".,")):
    _CLASS[list(_members)] = _k
for _b in range(33, 127):
    if _CLASS[_b] == 7:
        _CLASS[_b] = 8
_K = [np.int64(x) for x in (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x52DCE729A2D4F4A7, 0x38495AB5C0FFEE11)]


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 5-word windows that occur at least twice, the first occurrence included."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        mixed = codes[:n].copy()
        for k in range(1, WINDOW):
            mixed = (mixed ^ (mixed >> 31)) * _K[k - 1] + codes[k:k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal sums
        return 0
    exact = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    window = exact[:n]
    for k in range(1, WINDOW):
        window = np.unique(window * (len(codes) + 1) + exact[k:k + n], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text; an empty one has zeros and one line."""
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9).tolist()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    ordered = np.sort(codes)
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    top = int(np.diff(np.r_[new, len(ordered)]).max()) if len(ordered) else 0
    return (
        len(words), len(text) - kinds[0], kinds[1], len(lines) - len(set(lines)), repeated_words(codes), data.count(b"\n") + 1, kinds[2], kinds[3],
        kinds[4], kinds[5], kinds[6], kinds[8], kinds[7], len(new), top, int((codes[1:] == codes[:-1]).sum()),
    )


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every whole text; NULL counts as empty."""
    def run(batch):
        got = np.array([measure(t) for t in texts(batch)], np.int64).reshape(-1, len(COUNTS))
        return {"doc_id": batch.column("doc_id")} | {c: got[:, k] for k, c in enumerate(COUNTS)}

    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: Size-free features: numerator and denominator among ``COUNTS``.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"), "upper_share": ("n_upper", "word_chars"),
    "lower_share": ("n_lower", "word_chars"), "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"),
    "stop_share": ("n_stops", "n_words"), "punct_share": ("n_punct", "n_words"), "other_share": ("n_other", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"), "top_share": ("n_top", "n_words"), "adjacent_share": ("n_adjacent", "n_words"),
}


def ratio(name: str) -> Column:
    """A ratio as a column over ``COUNTS``; 0 where the denominator is 0."""
    over, under = RATIOS[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def ratios(counts: np.ndarray) -> np.ndarray:
    """The ratios, and the logarithm of the number of words, of a matrix of ``COUNTS``."""
    counts = counts.astype(float)
    at = {c: k for k, c in enumerate(COUNTS)}
    out = [np.divide(counts[:, at[a]], counts[:, at[b]], out=np.zeros(len(counts)), where=counts[:, at[b]] > 0) for a, b in RATIOS.values()]
    return np.column_stack([*out, np.log1p(counts[:, at["n_words"]])])
