"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts, text_slices, texts, worker_table

#: A span is the shortest run of sentences with at least so many of them and so many words.
LEAST_SENTENCES, LEAST_WORDS = 3, 20
#: A sentence is cut after about one word in so many, chosen by the word itself, so that passages that begin or end
#: inside a sentence meet at the same cuts.
CUT_WORDS = 8
#: Where the inside of so many words holds no span, closer cuts, one at least in every so many words, give further spans.
PASSAGE_WORDS, WINDOW = 50, 8

_WORD = re.compile(r"\S+")
_QUOTES = "\"'”»)"
_CLOSER = np.int64(0x2545F4914F6CDD1D)  # spans between closer cuts meet only their like
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2^64


class Words(dict):
    """A word's 64-bit hash but for case; the lowest bit says whether a sentence ends after it, by its stop or by the hash."""

    held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first powers of the base, and their inverses; kept for the longest text so far."""
        if len(self.held[0]) < n:
            with np.errstate(over="ignore"):
                self.held = tuple(np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096), b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.held

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace"))
        got = h & ~1 | (word.rstrip(_QUOTES).endswith((".", "!", "?")) or (h >> 1) % CUT_WORDS == 0)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's words, and after how many words each sentence ends, 0 first; a line break ends one, too."""
    table, words, breaks = worker_table("span words", Words), [], []
    for line in text.split("\n"):
        words += line.split()
        breaks.append(len(words))
    codes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    ends = (codes & np.uint64(1)).astype(bool)
    if len(words):
        ends[np.array(breaks)[np.array(breaks) > 0] - 1] = True
    return codes, np.r_[0, np.flatnonzero(ends) + 1]


def spans(codes: np.ndarray, ends: np.ndarray, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and sentence after the last of the span that begins at each sentence, as far as the text holds one."""
    n = len(ends) - 1
    first = np.arange(n)
    to = np.maximum(first + least_sentences, np.searchsorted(ends, ends[:-1] + least_words))
    first = first[to <= n]
    to = to[:len(first)]
    power, undo = worker_table("span words", Words).powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum((codes >> np.uint64(1)) * power[:len(codes)])]
        h = (total[ends[to]] - total[ends[first]]) * undo[ends[first]]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (ends[to] - ends[first]).astype(np.uint64)
    return (h ^ (h >> np.uint64(29))).view(np.int64), to


def closer(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends``, and one more in every window of words without one: after its word of the smallest hash, the last of these."""
    cut = np.zeros(len(codes), bool)
    cut[ends[1:] - 1] = True
    key = np.where(cut, np.uint64(0), np.maximum(codes >> np.uint64(1), np.uint64(1)))
    low = np.lib.stride_tricks.sliding_window_view(key, WINDOW)[:, ::-1].argmin(axis=1)
    cut[np.arange(len(low)) + WINDOW - 1 - low] = True
    return np.r_[0, np.flatnonzero(cut) + 1]


def every_span(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and word after the last of all spans.

    Any ``PASSAGE_WORDS`` words of a text have, whatever stands around them, a span inside: one of sentences or, if there is
    none, one between closer cuts.  A cut at the passage's own edges may come from its surroundings and does not count.
    """
    h, to = spans(codes, ends)
    a, b, n = ends[:len(h)], ends[to], len(codes)
    if n < PASSAGE_WORDS:
        return h, a, b
    start = np.arange(n - PASSAGE_WORDS + 1)
    without = np.r_[b, n + PASSAGE_WORDS][np.searchsorted(a, start, "right")] >= start + PASSAGE_WORDS
    if not without.any():
        return h, a, b
    cuts = closer(codes, ends)
    more, to = spans(codes, cuts)
    x, y = cuts[:len(more)], cuts[to]
    count = np.r_[0, np.cumsum(without)]
    last = np.minimum(x + 1, len(without))
    inside = count[last] > count[np.minimum(np.maximum(y - PASSAGE_WORDS, 0), last)]
    return np.r_[h, more[inside] ^ _CLOSER], np.r_[a, x[inside]], np.r_[b, y[inside]]


def row_id() -> Column:
    """doc_id; a row without one is a document of its own, numbered by its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def span_rows(docs: DataFrame) -> DataFrame:
    """span, row_id: every different span of every document."""
    import pyarrow as pa

    def run(batches):
        for batch in text_slices(batches):
            ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            own = [np.unique(every_span(*sentences(t))[0]) for t in texts(batch)]
            where = np.repeat(ids, [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(where)], names=["span", "row_id"])

    return docs.where("text is not null").select(row_id().alias("row_id"), "text").mapInArrow(run, "span long, row_id long")


def clean(text: str, repeated: list[int]) -> tuple[int, int, str]:
    """Number of sentences, number that lost words, and what is left of a text.

    Removed are the words of spans in ``repeated`` and of spans that came before in the same text.  What stays is
    kept as it is, white space included, but for the white space before removed words.
    """
    codes, ends = sentences(text)
    h, a, b = every_span(codes, ends)
    gone = np.ones(len(h), bool)
    gone[np.unique(h, return_index=True)[1]] = False
    if len(repeated):
        gone |= np.isin(h, np.array(repeated, np.int64))
    if not gone.any():
        return len(ends) - 1, 0, text
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, a[gone], 1)
    np.add.at(edge, b[gone], -1)
    drop = np.cumsum(edge)[:-1] > 0
    stop = [m.end() for m in _WORD.finditer(text)]
    out, at = [], 0
    for last in [*np.flatnonzero(drop[1:] != drop[:-1]).tolist(), len(drop) - 1]:
        if not drop[last]:
            out.append(text[at:stop[last]])
        at = stop[last]
    return len(ends) - 1, int(np.logical_or.reduceat(drop, ends[:-1]).sum()), "".join([*out, text[at:]])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, text: every document without the words of repeated spans; n_removed counts the sentences that lost words.

    A span's first document, that of the smallest doc_id, keeps it; rows that share a doc_id count as one document for that.  A
    NULL text stays NULL with no sentence; texts shorter than a span are left alone.  Spans are equal if their words are
    equal but for case; chance equality of 64-bit hashes is left out of account.
    """
    rows = kept(span_rows(docs))
    repeated = kept(rows.groupBy("span").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last")).where("first < last").select("span", "first"))
    later = rows.join(repeated, "span").where("row_id > first").groupBy("row_id").agg(F.collect_set("span").alias("repeated"))
    both = docs.select("doc_id", "text", row_id().alias("row_id")).join(later, "row_id", "left")

    def run(batch):
        got = [(0, 0, None) if t is None else clean(t, r or []) for t, r in zip(batch.column("text").to_pylist(), batch.column("repeated").to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "n_sentences": [g[0] for g in got], "n_removed": [g[1] for g in got], "text": [g[2] for g in got]}

    return map_texts(both, ["doc_id", "text", "repeated"], run, "doc_id long, n_sentences long, n_removed long, text string")
