"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices, texts

#: n-gram lengths in bytes of lower-cased text; positions of the filter (a power of two); hash functions.
GRAMS, POSITIONS, HASHES = (3, 4, 5), 1 << 20, 2
#: A language's filter takes an n-gram that makes up at least this share of its n-grams ...
LEAST_SHARE = 2e-6
#: ... and at least this part of the largest share it has in any language.
LEAST_PART = 0.2
#: One bit per language in an unsigned 64-bit mask.
MOST_LANGUAGES = 64

#: Bytes of text that are taken at once: each gram needs some hundred bytes of arrays.
SLICE_BYTES = 1 << 20
CODE_BITS = np.uint64(48)

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one byte array, with an end of each text in bytes; a blank byte follows every text."""
    parts = [t.lower().encode("utf-8", "replace") + b" " for t in texts(batch)]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)
    return data, ends


def _grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions, codes) per n-gram length; n-grams lie inside words: a blank stands for every other byte, and one may lead or end."""
    clean = np.where(_LETTER[data], data, 32).astype(np.uint64)
    inner = _LETTER[data]
    for n in GRAMS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        code = np.full(size, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | clean[k:k + size]
        inside = np.ones(size, bool)
        for k in range(1, n - 1):
            inside &= inner[k:k + size]
        inside &= inner[:size] | inner[n - 1:n - 1 + size]
        at = np.flatnonzero(inside)
        yield at, code[at]


def _positions(codes: np.ndarray, k: int) -> np.ndarray:
    mixed = codes * _MIX[k]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX[2]) >> np.uint64(64 - 20)).astype(np.int64) & (POSITIONS - 1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram occurs in a language's texts, over all rows with a language and a text.

    Tasks add up their own rows first, so that a frequent n-gram or language is a row per task.
    """
    def run(batches):
        for batch in text_slices(batches, limit=SLICE_BYTES):
            lang = batch.column("lang").dictionary_encode()
            names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
            data, ends = _flat(batch)
            for at, codes in _grams(data):
                whose = np.repeat(of.astype(np.uint64), np.diff(np.searchsorted(at, np.r_[0, ends])))
                both, n = np.unique(codes | whose << CODE_BITS, return_counts=True)  # a code has 43 bits at most
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in (both >> CODE_BITS).tolist()], pa.string()),
                     pa.array((both & ((np.uint64(1) << CODE_BITS) - np.uint64(1))).view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, least_share: float = LEAST_SHARE, least_part: float = LEAST_PART) -> dict:
    """Filters from all rows of ``docs`` (lang, text): langs, masks (a mask per position) and false, each language's rate of false positives.

    At most ``1 / least_share`` n-grams of a language can qualify, so what reaches the driver is bounded whatever the
    table's size.  No usable row gives a model without languages.
    """
    from .common import kept

    counts = kept(gram_counts(docs))
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(totals)
    masks = np.zeros((HASHES, POSITIONS), np.uint64)
    if langs:
        total = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(float(totals[lang])))])
        shares = counts.withColumn("share", F.col("n") / F.element_at(total, F.col("lang"))).where(F.col("share") >= least_share)
        best = shares.groupBy("gram").agg(F.max("share").alias("best"), F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("shares"))
        bits = sum((F.when(F.coalesce(F.try_element_at("shares", F.lit(lang)), F.lit(0.0)) >= F.col("best") * least_part, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
                    * F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k, lang in enumerate(langs)), F.lit(0).cast("long"))
        got = best.select("gram", bits.alias("bits")).toArrow()
        gram, mask = (got.column(c).to_numpy().view(np.uint64) for c in ("gram", "bits"))
        for k in range(HASHES):
            np.bitwise_or.at(masks[k], _positions(gram, k), mask)
    bit = [np.uint64(1 << k) for k in range(len(langs))]
    false = np.array([np.prod([(masks[h] & b != 0).mean() for h in range(HASHES)]) for b in bit])
    return {"langs": langs, "masks": masks, "false": false}


def identify(docs: DataFrame, model: dict, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out (a column of the caller's, false by default), lang_pred, score of every whole text.

    All n-grams of a text look up the languages that hold them; a language's count of hits, less the hits expected from
    false positives, decides, the first language by name on ties.  score is the winner's share of the corrected
    counts.  A NULL text, a text without a letter, or a model without languages gives ``und`` and 0.
    """
    langs, masks, false = model["langs"], docs.sparkSession.sparkContext.broadcast(model["masks"]), model["false"]

    def run(batch):
        column = batch.column("text")
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        data, ends = _flat(batch)
        hits, every = np.zeros((batch.num_rows, len(langs))), np.zeros(batch.num_rows)
        for at, codes in _grams(data):
            found = masks.value[0][_positions(codes, 0)]
            for k in range(1, HASHES):
                found &= masks.value[k][_positions(codes, k)]
            edge = np.searchsorted(at, np.r_[0, ends])
            every += np.diff(edge)
            for k in range(len(langs)):
                hits[:, k] += np.diff(np.r_[0, np.cumsum((found >> np.uint64(k)) & np.uint64(1), dtype=np.int64)][edge])
        fixed = np.maximum((hits - every[:, None] * false) / (1 - np.minimum(false, 0.999)), 0)
        best = fixed.argmax(axis=1) if langs else np.zeros(batch.num_rows, int)
        top = fixed.max(axis=1, initial=0)
        score = np.divide(top, fixed.sum(axis=1), out=np.zeros(len(top)), where=top > 0)
        known = lettered & bool(langs)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], "score": np.where(known, score, 0.0)}

    flag = F.lit(False).alias("held_out") if held_out is None else held_out
    return map_texts(docs, ["doc_id", "text", flag], run, "doc_id long, held_out boolean, lang_pred string, score double", SLICE_BYTES)
