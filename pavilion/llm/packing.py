"""Best-fit packing of token pieces, improved by swaps between underfull sequences."""

from __future__ import annotations

import bisect
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts, texts, worker_table

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 4096, 1
#: Pieces packed together: the groups grow in number with the pieces, never in size.
GROUP_PIECES = 4096
#: Sequences filled below this share of the capacity are packed once more, with those of all other groups.
LOW_FILL = 0.9
#: Words whose ids a worker keeps at most, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 1_000_000, 64
#: Words of letters that are encoded in one call.
TOGETHER = 1000


class WordIds(dict):
    """Ids of words as little-endian bytes.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are those of its
    space-separated words in order; nor does it join letters and punctuation, so a word of letters and its final punctuation
    are looked up apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def single(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        return self.single(word)

    def learn(self, words: set[str]) -> None:
        """Take in the words of a batch; letters, many at once."""
        if len(self) > CACHE_WORDS:
            self.clear()
        fresh, split = set(), {}
        for w in words.difference(self):
            if len(w) > CACHE_LENGTH:
                continue
            if w.isalpha():
                fresh.add(w)
            elif (core := w.rstrip(string.punctuation)).isalpha():
                split[w] = core, w[len(core):]
            else:
                self[w] = self.single(w)
        fresh.update({c for c, _ in split.values()}.difference(self))
        fresh = list(fresh)
        for at in range(0, len(fresh), TOGETHER):
            self.together(fresh[at:at + TOGETHER])
        for w, (core, tail) in split.items():
            if tail not in self:
                self[tail] = self.single(tail)
            self[w] = self[core] + self[tail]

    def together(self, words: list[str]) -> None:
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, edge = np.array(got.ids, "<u4"), np.flatnonzero(np.diff(got.word_ids, prepend=-1))
        if len(edge) == len(words):
            ends = [*(4 * edge[1:]).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.update(zip(words, [data[a:b] for a, b in zip((4 * edge).tolist(), ends, strict=True)], strict=True))
        else:  # a letter whose normal form is no letter
            self.update((w, self.single(w)) for w in words)

    def encode(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


#: A stop or comma before a space that belongs to a longer run of punctuation.
_RUN = re.compile(r"(?:[^\w\s]|_)[.,] ")


def split_words(text: str) -> list[str]:
    """The words at spaces and line breaks, final stops and commas apart, lower-cased where that changes no id.

    Special tokens are told by case, and beyond Latin-1 the vocabulary's lower-casing may be another.
    """
    try:
        text.encode("latin-1")
        lower = "<|" not in text
    except UnicodeEncodeError:
        lower = False
    text = (text.lower() if lower else text).replace("\n", " ")
    if lower and not _RUN.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary little-endian unsigned 32 bit) of every document.

    A NULL or empty text is the end id alone; only a document above ``capacity`` is cut.  ``path`` names the
    vocabulary on the executors; by default the one the executors have installed.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batch):
        where = path or tokenizer_path()
        table = worker_table(where, lambda: WordIds(where))
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        end = np.array([END_ID], "<u4").tobytes()
        words = [split_words(t) for t in texts(batch)]
        table.learn(set().union(*words))
        for doc, own in zip(batch.column("doc_id").to_pylist(), words, strict=True):
            ids = table.encode(own) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                cut = ids[at:at + 4 * capacity]
                for name, value in zip(out, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None), strict=True):
                    out[name].append(value)
        return out

    return map_texts(docs, ["doc_id", "text"], run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: the longest first, each to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > n:
            bisect.insort(room, (left - n, b))
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by local search.

    Between two underfull bins a document is moved, or one or two are exchanged for another, whenever the sum of
    squared fills grows: the fuller bin gains, the emptier one drains.  A bin finds the partners that gain among all fuller
    ones at once and takes the fullest; the search ends when no two bins are left between which anything gains.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        order = sorted((k for k, b in enumerate(bins) if b and fill[k] < capacity), key=lambda k: fill[k])
        # What may come back from each bin in order: nothing, or one of its documents.
        back = np.array([n for k in order for n in (0, *(size[i] for i in bins[k]))], np.int64)
        count = np.array([1 + len(bins[k]) for k in order], np.int64)
        owner, first = np.repeat(np.arange(len(order)), count), np.cumsum(count)
        reach = back + np.repeat([capacity - fill[k] for k in order], count) if order else back
        for at, low in enumerate(order):
            while bins[low]:
                out = _sums([size[i] for i in bins[low]])
                k = np.searchsorted(out, reach[first[at]:], "right") - 1
                gains = np.flatnonzero((k >= 0) & (out[k] > back[first[at]:]))
                if not len(gains):
                    break
                partner = int(owner[first[at] + gains[-1]])
                high = order[partner]
                while bins[low] and (step := _step(bins[low], bins[high], size, capacity - fill[high])):
                    out, back_ = step
                    gain = sum(size[i] for i in out) - sum(size[i] for i in back_)
                    for i in out:
                        bins[low].remove(i)
                    for i in back_:
                        bins[high].remove(i)
                    bins[high] += out
                    bins[low] += back_
                    fill[high] += gain
                    fill[low] -= gain
                    changed = True
                reach[owner == partner] = -1  # has changed: asked again in the next round
    return [b for b in bins if b]


def _sums(sizes: list[int]) -> np.ndarray:
    """Ascending sizes of one document or two."""
    one = np.sort(np.array(sizes, np.int64))
    a, b = np.triu_indices(len(one), 1)
    return np.sort(np.concatenate([one, one[a] + one[b]]))


def _step(low: list[int], high: list[int], size: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """What to bring from the emptier to the fuller bin and back: the largest gain that fits."""
    if room <= 0:
        return None
    best, found = 0, None
    for i in low:
        if best < size[i] <= room:
            best, found = size[i], ([i], [])
    if found:
        return found
    mine = sorted(low, key=lambda i: size[i])
    pairs = [(size[i], [i]) for i in mine] + [(size[i] + size[j], [i, j]) for k, i in enumerate(mine) for j in mine[:k]]
    pairs.sort(key=lambda p: p[0])
    keys = [p[0] for p in pairs]
    for j in high:
        at = bisect.bisect_right(keys, size[j] + room) - 1
        if at >= 0 and keys[at] - size[j] > best:
            best, found = keys[at] - size[j], (pairs[at][1], [j])
            if best == room:
                break
    return found


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed_groups(pieces: DataFrame, capacity: int, first: int) -> tuple[DataFrame, int]:
    """``pieces`` placed group by group, with the ``fill`` of their sequence, and the number after the last group's; ``first`` numbers the first one.

    Pieces are dealt by a hash of their place in the written table, so rows that are equal in all columns part like any others.
    """
    pieces = kept(pieces)
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = F.monotonically_increasing_id()
    dealt = pieces.select(*columns, (F.pmod(F.xxhash64(number), F.lit(groups)) + first).alias("pack_group"))

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in columns]))
        lengths = group.column("length").to_numpy()
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, own in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            sequence[own] = k
            offset[own] = np.cumsum([0, *lengths[own][:-1]])
            fill[own] = lengths[own].sum()
        number = (group.column("pack_group").to_numpy() << 32) + sequence
        out = group.select(columns).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        return out.append_column("fill", pa.array(fill))

    return dealt.groupBy("pack_group").applyInArrow(run, PLACED + ", fill long"), first + groups


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt into groups of about ``GROUP_PIECES`` whose number follows the table, so no task grows; what the
    groups leave in sequences filled below ``LOW_FILL`` is dealt and packed once more.  Repeated rows are pieces of their own, of an
    empty table there is no sequence, NULL ids are carried, and ties in length go by the columns in order.
    """
    placed, after = packed_groups(pieces, capacity, 0)
    placed = kept(placed)
    low = F.col("fill") < int(LOW_FILL * capacity)
    again, _ = packed_groups(placed.where(low).drop("sequence_id", "offset", "fill"), capacity, after)
    return placed.where(~low).drop("fill").unionByName(again.drop("fill"))


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed corpus itself: sequence_id, length, ids (binary), doc_ids, offsets, one row per sequence of at most ``capacity`` ids.

    Of rows that are equal in id, piece, length and checksum one set of ids serves all.
    """
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    with_ids = kept(tokenize(docs, path, capacity, with_ids=True))
    placed = pack(with_ids.select(*key), capacity)
    once = with_ids.groupBy(*key).agg(F.first("ids").alias("ids"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key]
    joined = placed.alias("p").join(once.alias("i"), same[0] & same[1] & same[2] & same[3] & same[4])
    parts = F.sort_array(F.collect_list(F.struct("p.offset", "p.doc_id", "i.ids")))
    return joined.groupBy("p.sequence_id").agg(F.sum("p.length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(transform(parts, x -> x.ids), X'', (a, b) -> a || b)").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenize(docs, path, capacity), capacity)
