"""Alignment of two tokenizers over a corpus: which of their tokens cover the same bytes, and how often each pair does.

Pairs are counted by external runs.  Every slice of documents sorts its (pair, document) records and leaves them as
compressed runs, one per radix of the second id; runs are merged with a heap, some dozens at a time, until each radix has
the total of its pairs in order of the second id, so that the best partner of an id is known as soon as its pairs end.  The
runs are then streamed against these totals and give every document its share back.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavilion.session import written

from .common import text_slices, worker_table

#: Second ids are dealt to so many radix parts.
RADICES = 128
#: Compressed bytes of runs that one task merges or streams.
RUN_BYTES = 16 << 20
#: Merged runs that one task merges further.
FAN_IN = 64
#: Units a worker keeps; only a slice that has more of its own may pass it.
CACHE_UNITS = 400_000
#: Bytes of text that give one set of runs.
SLICE_BYTES = 6 << 20
#: Bits of a first id in a pair, and of a document's place in its slice in a record.
ID_BITS, DOC_BITS = 20, 20

#: A space between two characters that are no white space.  Neither vocabulary has a token that crosses it: the first one's
#: words begin there, and no piece of the second one holds its space mark after another character.
_EDGE = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: How the byte-level vocabulary's pre-tokenizer cuts a text into words (a fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Units:
    """Both encodings of a text's units (words with the space before them), their groups and their links.

    A unit's number is its place in the lists: ``text`` has its groups (None where an encoding does not give the unit back),
    ``counts`` its A tokens, B tokens, groups and links, and its links stand in ``pairs`` from ``since`` on.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.quick = self.ranked(a_path)
        self.clear()

    def ranked(self, path: str):
        """The same vocabulary by ranks, which encodes faster, if the order of its merges is that of its ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in itertools.pairwise(made)):
            return None
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def clear(self) -> None:
        self.number, self.text = {}, []
        self.counts, self.since = np.zeros((1024, 4), np.int64), np.zeros(1025, np.int64)
        self.pairs = np.zeros(8192, np.int64)

    def ids_a(self, units: list[str]) -> list[int]:
        """Ids of all units, one after the other.

        Where no unit begins or ends with white space they are encoded as one text, since words begin at the spaces before
        units; characters beyond Latin go to the vocabulary's own library, whose tables of letters decide.
        """
        if self.quick and not any(u[:1].isspace() or u[-1:].isspace() for u in units):
            whole = " " + " ".join(units)
            if max(whole) < "\u0250":
                return self.quick(whole)
        if len(units) > 1:
            half = len(units) // 2
            return self.ids_a(units[:half]) + self.ids_a(units[half:])
        return self.a.encode(" " + units[0], add_special_tokens=False).ids

    def learn(self, units: list[str]) -> None:
        """Take in units that are not known yet."""
        raw = [b" " + u.encode() for u in units]
        rows_b = self.b.encode(units, num_threads=1)
        flat_a, flat_b = np.array(self.ids_a(units), np.int64), np.array([i for r in rows_b for i in r], np.int64)
        whole = b"".join(raw)
        same = len(whole) == self.a_size[flat_a].sum() and whole == b"".join(map(self.b_bytes.__getitem__, flat_b.tolist()))  # A only cuts bytes
        if not same:
            if len(units) > 1:
                half = len(units) // 2
                self.learn(units[:half])
                self.learn(units[half:])
            else:
                self.add(units, [None], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))
            return
        self.add(units, *self.align(flat_a, flat_b, np.cumsum(list(map(len, raw)))))

    def add(self, units: list[str], text: list, counts: np.ndarray, pairs: np.ndarray) -> None:
        n, m = len(self.text), len(self.text) + len(units)
        while m > len(self.counts):
            self.counts, self.since = np.concatenate([self.counts, self.counts]), np.concatenate([self.since, np.zeros(len(self.counts), np.int64)])
        self.number.update(zip(units, range(n, m), strict=True))
        self.text += text
        self.counts[n:m] = counts
        self.since[n + 1:m + 1] = self.since[n] + np.cumsum(counts[:, 3])
        while self.since[m] > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, self.pairs])
        self.pairs[self.since[n]:self.since[m]] = pairs

    def align(self, flat_a: np.ndarray, flat_b: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups as text, counts and links of units that end at the bytes ``ends``."""
        size_a = self.a_size[flat_a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(self.b_size[flat_b])
        # Tokens of B that overlap a token of A: from the first that ends behind its start to the first that reaches its end.
        first = np.searchsorted(end_b, end_a - size_a, "right")
        links = np.searchsorted(end_b, end_a, "left") - first + 1
        at_a = np.repeat(np.arange(len(flat_a)), links)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(links) - links, links) + first[at_a]
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        cut_a, cut_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        to = [np.searchsorted(x, ends) + 1 for x in (end_a, end_b, both)]
        counts = np.column_stack([np.diff(x, prepend=0) for x in (*to, np.cumsum(links)[to[0] - 1])])
        names_a, names_b = list(map(self.names.__getitem__, flat_a.tolist())), list(map(self.names.__getitem__, flat_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            if x - i == 1 == y - j:
                groups.append(names_a[i] + "|" + names_b[j])
            else:
                groups.append(",".join(names_a[i:x]) + "|" + ",".join(names_b[j:y]))
            i, j = x, y
        text, g = [], 0
        for h in to[2].tolist():
            text.append(";".join(groups[g:h]))
            g = h
        return text, counts, flat_b[at_b] << ID_BITS | flat_a[at_a]

    def numbers(self, docs: list[list[str]]) -> list[list[int]]:
        """Numbers of all units of a slice."""
        fresh = set().union(*docs).difference(self.number)
        if self.text and len(self.text) + len(fresh) > CACHE_UNITS:
            self.clear()
            fresh = set().union(*docs)
        inner, edge = [], []
        for u in fresh:
            (edge if u[:1].isspace() or u[-1:].isspace() else inner).append(u)
        for some in (inner, edge):
            for k in range(0, len(some), 4096):
                self.learn(some[k:k + 4096])
        return [list(map(self.number.__getitem__, d)) for d in docs]

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the units, one unit after the other, and how many each has."""
        n = self.counts[units, 3]
        at = np.arange(n.sum()) + np.repeat(self.since[units] - (np.cumsum(n) - n), n)
        return self.pairs[at], n


# ---------------------------------------------------------------- runs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the narrowest type that holds it, compressed together."""
    parts = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at:at + 4].decode().strip()), int.from_bytes(raw[at + 4:at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12).astype(np.int64))
        at += 12 + n * kind.itemsize
    return out


def runs_of(records: np.ndarray):
    """(radix, head, body) of a slice's records ``pair << DOC_BITS | document``, one per link.

    head: distinct pairs in order and how often the slice has each; body: documents of each pair, their records and numbers.
    """
    records = np.sort(records)
    new = np.flatnonzero(np.diff(records, prepend=-1))
    records, times = records[new], np.diff(np.append(new, len(records)))
    radix = (records >> (DOC_BITS + ID_BITS)) % RADICES
    order = np.argsort(radix, kind="stable")  # the order of pairs stays within a radix
    records, times, radix = records[order], times[order], radix[order]
    edge = np.flatnonzero(np.diff(radix, prepend=-1))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(radix)], strict=True):
        pair, doc = records[lo:hi] >> DOC_BITS, records[lo:hi] & ((1 << DOC_BITS) - 1)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        head = pack(np.diff(pair[starts], prepend=0), np.add.reduceat(times[lo:hi], starts))
        yield int(radix[lo]), head, pack(np.diff(np.append(starts, hi - lo)), doc, times[lo:hi])


def merged(heads: list[bytes]) -> bytes:
    """One head from many: a heap over the runs takes pairs in order and adds their numbers up."""
    runs = []
    for data in heads:
        step, count = unpack(data)
        runs.append(zip(np.cumsum(step).tolist(), count.tolist(), strict=True))
    pairs, counts, last = [], [], -1
    for pair, n in heapq.merge(*runs):
        if pair == last:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
            last = pair
    return pack(np.diff(np.array(pairs, np.int64), prepend=0), np.array(counts, np.int64))


def totals_of(head: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their corpus-wide numbers, and whether each number is its second id's highest; second ids follow one another."""
    step, count = unpack(head)
    pair = np.cumsum(step)
    starts = np.flatnonzero(np.diff(pair >> ID_BITS, prepend=-1))
    best = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(pair))))
    return pair, count, count == best


def shares(head: bytes, body: bytes, totals) -> bytes:
    """Documents of a run, their links that are a best one, and the sum of their links' numbers."""
    pair, count, best = totals
    step, _ = unpack(head)
    length, doc, times = unpack(body)
    at = np.repeat(np.searchsorted(pair, np.cumsum(step)), length)
    own, slot = np.unique(doc, return_inverse=True)
    n_best, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    np.add.at(n_best, slot, times * best[at])
    np.add.at(total, slot, times * count[at])
    return pack(own, n_best, total)


# ---------------------------------------------------------------- the job


def sliced(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """slice, radix, head, body: the runs of every slice, and at radix -1 what is known of its documents so far."""
    import pyspark

    schema = "slice long, radix int, head binary, body binary"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        where = paths or default_paths()
        known = worker_table("|".join(where), lambda: Units(*where))
        task = pyspark.TaskContext.get().partitionId()
        for k, batch in enumerate(text_slices(batches, limit=SLICE_BYTES)):
            docs = [_EDGE.split(t) if t else [] for t in batch.column("text").to_pylist()]
            rows = known.numbers(docs)
            digest, fit = [], []
            for row in rows:
                text = list(map(known.text.__getitem__, row))
                fit.append(bool(row) and None not in text)
                digest.append(hashlib.sha256(";".join(text).encode()).hexdigest() if fit[-1] else "")
            length = np.array([len(row) * ok for row, ok in zip(rows, fit, strict=True)])
            units = np.array([u for row, ok in zip(rows, fit, strict=True) if ok for u in row], np.int64)
            owner = np.repeat(np.arange(len(rows)), length)
            tokens = [np.bincount(owner, known.counts[units, c], len(rows)).astype(np.int64) for c in range(4)]
            table = pa.table([batch.column("doc_id"), *map(pa.array, tokens), pa.array(digest)],
                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            out = [(-1, None, _to_bytes(table))]
            if len(units):
                pairs, n = known.links(units)
                out += runs_of(pairs << DOC_BITS | np.repeat(owner, n))
            n = len(out)
            radix, head, body = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k] * n, pa.int64()), pa.array(radix, pa.int32()), pa.array(head, pa.binary()), pa.array(body, pa.binary())],
                                             ["slice", "radix", "head", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _parts(runs: DataFrame, column: str) -> DataFrame:
    """radix, parts: in how many parts a radix's runs are dealt, so that none is too large for a task; a row per radix."""
    return runs.groupBy("radix").agg(F.greatest(F.ceil(F.sum(F.length(column)) / RUN_BYTES), F.lit(1)).alias("parts"))


def _dealt(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Add ``part``; the broadcast side has at most a row per radix."""
    return runs.join(F.broadcast(parts), "radix").withColumn("part", F.pmod(F.xxhash64("slice"), "parts")).drop("parts")


def _merge(runs: DataFrame) -> DataFrame:
    def run(key, group):
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([merged(group.column("head").to_pylist())], pa.binary())],
                        ["radix", "part", "head"])

    return runs.groupBy("radix", "part").applyInArrow(run, "radix int, part long, head binary")


def pair_totals(parts: DataFrame) -> DataFrame:
    """radix, head: the total number of every pair of a radix, one row per radix."""
    runs = parts.where("radix >= 0").select("slice", "radix", "head")
    runs = _dealt(runs, _parts(runs, "head"))
    heads = written(_merge(runs), "align-heads")
    while (heads.agg(F.max("part")).first()[0] or 0) > 0:
        heads = written(_merge(heads.withColumn("part", F.floor(F.col("part") / FAN_IN))), "align-heads")
    return heads.select("radix", "head")


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``paths`` names the byte-level vocabulary (A) and the piece model (B) on the executors; by default those they have
    installed.  A text that is NULL or empty, or that either encoding does not give back byte for byte, has no tokens: zeros
    and an empty digest, and it adds nothing to the pairs.  Every row counts, also one that repeats another or has a NULL id;
    other columns are ignored.  Of pairs with the same highest number all are best.
    """
    parts = written(sliced(docs, paths), "align-runs")
    runs = parts.where("radix >= 0")
    sizes = written(_parts(runs, "body"), "align-sizes")
    runs = _dealt(runs, sizes)
    totals = pair_totals(parts).join(F.broadcast(sizes), "radix").select("radix", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "head")

    def stream(key, runs, total):
        known = totals_of(total.column("head")[0].as_py())
        got = [shares(h, b, known) for h, b in zip(runs.column("head").to_pylist(), runs.column("body").to_pylist(), strict=True)]
        return pa.table([runs.column("slice"), pa.array(got, pa.binary())], ["slice", "share"])

    back = runs.groupBy("radix", "part").cogroup(totals.groupBy("radix", "part")).applyInArrow(stream, "slice long, share binary")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(key, own, back):
        with pa.ipc.open_stream(own.column("body")[0].as_py()) as stream:
            table = stream.read_all()
        n_best, total = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        for data in back.column("share").to_pylist():
            doc, best, count = unpack(data)
            n_best[doc] += best
            total[doc] += count
        return table.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)).select(_COLUMNS)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    own = parts.where("radix = -1").select("slice", "body")
    return own.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(finish, schema)


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

