"""Jaccard join of shingle sets by a token-group matrix, and the classes that its links form.

Texts with equal sets are one node.  Where links may be at all is found without comparing texts: sets whose Jaccard
similarity is at least t differ in at most (1 - t) / (1 + t) of the sum of their sizes; so when all tokens are dealt into
more parts than that, one part at least is equal in both, and each node's parts are keys of an ordinary join.  Nodes
that share a part form regions.  Inside a region similar nodes are put into groups, a sparse token-group matrix
holds each group's token union, the overlap of a query with a union bounds its overlap with every member, and
only groups that can still qualify are opened and compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavilion.session import leaving_nothing, shuffles_released, written

from .common import kept, map_texts, text_slices, texts, worker_table

#: Words of a shingle, and the least similarity as (over, under), unless the caller gives others.
SHINGLE, LEAST = 3, (90, 100)
#: Size classes grow by this factor; smaller ones share a first class.
CLASS_RATIO = 1.5
#: Parts beyond the fewest that do, as a share of these; every text leaves out as many of its parts, those of fewest tokens.
SPARE_SHARE = 0.25
#: Tokens of a task, and members of a group of the matrix.
TASK_TOKENS, GROUP_MEMBERS = 200_000, 16

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[k]
    return x ^ (x >> np.uint64(27))


def shingles(text: str, words_in: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z lower-cased.

    Fewer words than a shingle has are one shingle; no word, no shingle.  Chance equality of two hashes is left out of account.
    """
    cache = worker_table("word hashes", WordHashes)
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    span = min(words_in, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mixed(out, 1) + h[k:k + len(out)] * _M[0]
    return np.unique(_mixed(out, 2))


def node_of(tokens: np.ndarray) -> int:
    """A set's own number; equal sets, equal numbers."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n: int | np.ndarray, least: tuple[int, int] = LEAST):
    """The smallest size that a set linked with one of size ``n`` can have, and the least overlap of the two."""
    return -(-n * least[0] // least[1])


def signatures(tokens: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Keys of which two linked, different sets share at least one.

    A class whose sets cannot differ and still link needs none.  Linked sets have more equal parts than there are spare ones,
    and all sets rank parts alike, by their number of tokens and then by their hash.  So the highest equal part of two linked sets
    has at least the spare number of parts below it in both, and each set may leave out that many of its lowest: the
    empty ones and those of a token or two, which texts that are no copies share by chance.
    """
    n, out = len(tokens), []
    k, end, classes = 0, 10, []
    while n >= end:
        k, end = k + 1, max(end + 1, int(end * CLASS_RATIO))
    classes.append((k, end))
    if n and needed(end, least) <= n:  # some set of the next class can link
        classes.append((k + 1, max(end + 1, int(end * CLASS_RATIO))))
    for k, end in classes if n else []:
        differ = 2 * (end - 1) * (least[1] - least[0]) // (least[1] + least[0])
        if not differ:
            continue
        spare = int((differ + 1) * SPARE_SHARE) + 1
        parts = differ + 1 + spare
        part = ((_mixed(tokens + np.uint64(k), 3) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        present, first = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[present] = np.add.reduceat(_mixed(tokens[order], 1), first)
        keys = _mixed(sums + np.arange(parts, dtype=np.uint64) * _M[0] + np.uint64(k * int(_M[3]) % (1 << 64)), 2)
        out.append(keys[np.lexsort((keys, np.bincount(part, minlength=parts)))[spare:]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def row_id() -> Column:
    """doc_id, and the smallest long for NULL, so that it joins by plain equality."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def once(docs: DataFrame) -> DataFrame:
    """One of the rows that agree in doc_id and text, with row_id and text_hash; repeated rows are dropped before the shuffle."""
    return docs.withColumn("row_id", row_id()).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["row_id", "text_hash"])


def described(docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, row_id, text_hash, n, node and signatures of every document; of equal sets in one slice only the first carries signatures."""
    def run(batch):
        sets = [shingles(t, words) for t in texts(batch)]
        nodes = [node_of(s) for s in sets]
        first = {node: k for k, node in reversed(list(enumerate(nodes)))}
        keys = [signatures(s, least) if first[node] == k else np.zeros(0, np.int64) for k, (s, node) in enumerate(zip(sets, nodes, strict=True))]
        return {c: batch.column(c) for c in ("doc_id", "row_id", "text_hash")} | {
            "n": [len(s) for s in sets], "node": nodes, "signatures": pa.array(keys, pa.list_(pa.int64()))}

    return map_texts(docs, ["doc_id", "text", row_id().alias("row_id"), F.xxhash64("text").alias("text_hash")], run,
                     "doc_id long, row_id long, text_hash long, n long, node long, signatures array<long>")


class Links:
    """Union-find over positions; the smallest position leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def linked(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> Links:
    """Classes of different sets under links, by the token-group matrix.

    Groups are runs of up to ``GROUP_MEMBERS`` sets with one min-hash.  Opened groups skip members that are already of
    the query's class, as a further link would change nothing.
    """
    n, out = len(sets), Links(len(sets))
    if n < 2:
        return out
    size = np.array([len(s) for s in sets])
    low = np.array([(s * _M[1] ^ _M[2]).min() for s in sets])
    order = np.lexsort((size, low))
    group = np.zeros(n, np.int64)
    starts, run = [0], 0
    for at in range(1, n):
        if low[order[at]] != low[order[at - 1]] or at - starts[-1] >= GROUP_MEMBERS:
            starts.append(at)
            run += 1
        group[order[at]] = run
    members = np.split(order, starts[1:])
    groups = len(members)
    least_size = np.array([size[m].min() for m in members])
    most_size = np.array([size[m].max() for m in members])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edges = np.r_[0, np.cumsum(size)]
    sets = [token[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # the matrix, token by token: the groups whose union holds the token
    cells = np.unique(token * groups + np.repeat(group, size))
    of_token, of_group = cells // groups, cells % groups
    where = np.searchsorted(of_token, np.arange(of_token[-1] + 2))
    width = np.diff(where)
    flag = np.zeros(len(width), bool)
    at = 0
    while at < n:  # as many queries at once as about four million cells allow
        to, cost = at, 0
        while to < n and (to == at or cost < 4_000_000):
            cost += int(width[sets[to]].sum())
            to += 1
        tokens = np.concatenate(sets[at:to])
        count = width[tokens]
        first = np.repeat(where[tokens] - np.r_[0, np.cumsum(count)[:-1]], count)
        hit = of_group[first + np.arange(len(first))]
        query = np.repeat(np.repeat(np.arange(at, to), size[at:to]), count)
        pairs, overlap = np.unique(query * groups + hit, return_counts=True)
        query, hit = pairs // groups, pairs % groups
        nq = size[query]
        may = (overlap >= needed(nq, least)) & (most_size[hit] >= needed(nq, least)) & (needed(least_size[hit], least) <= nq)
        marked = -1
        for q, g in zip(query[may].tolist(), hit[may].tolist(), strict=True):
            for s in members[g].tolist():
                if s <= q or out.find(s) == out.find(q):
                    continue
                small, large = sorted((int(size[q]), int(size[s])))
                if small < needed(large, least):
                    continue
                if marked != q:
                    if marked >= 0:
                        flag[sets[marked]] = False
                    flag[sets[q]] = True
                    marked = q
                both = int(flag[sets[s]].sum())
                if least[1] * both >= least[0] * (small + large - both):
                    out.join(q, s)
        if marked >= 0:
            flag[sets[marked]] = False
        at = to
    return out


def regions(described_: DataFrame) -> DataFrame:
    """node, region: nodes that share a signature share a region; only nodes that share one are listed.

    A signature's leader is its smallest node; a region is a leader followed two steps down to its own smallest
    leader, which brings most of what belongs together into one region at the price of two joins.
    """
    keys = described_.select("node", F.explode("signatures").alias("signature")).repartition("signature")  # moved once for both uses
    leaders = keys.groupBy("signature").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("signature", "leader")
    edges = kept(keys.join(leaders.hint("merge"), "signature").select("node", "leader").distinct())
    lowest = kept(edges.groupBy("node").agg(F.min("leader").alias("low")))
    step = lowest.select(F.col("node").alias("leader"), F.col("low").alias("region"))
    once = edges.join(step, "leader").select("node", F.col("region").alias("leader")).distinct()
    return once.join(step, "leader").select("node", "region").distinct()


def links(docs: DataFrame, rows: DataFrame, found: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """a, b: pairs of nodes of one class, b the smallest of its task, which connect all linked nodes.

    ``rows`` has the node of every document, ``found`` the regions of nodes.  Small regions are dealt into tasks by hash; a region above ``TASK_TOKENS`` is cut into blocks of half that by hash and
    every two blocks are a task, so no task grows with a region.  A text goes to all its tasks; these run in waves, each of
    which moves about as many tokens as the documents have.  Texts are read again for the nodes of regions only.
    """
    first = rows.groupBy("node").agg(F.min(F.struct("row_id", "text_hash")).alias("at"), F.max("n").alias("n"))
    nodes = kept(found.select("node").distinct().join(first, "node").select("node", "n", "at.row_id", "at.text_hash"))
    sized = kept(found.join(nodes.select("node", "n"), "node"))
    weights = kept(sized.groupBy("region").agg(F.sum("n").alias("weight")))
    with shuffles_released(docs.sparkSession):
        total = weights.agg(F.sum("weight")).first()[0] or 0
    tasks = max(1, -(-int(total) // TASK_TOKENS))
    big = F.col("weight") > TASK_TOKENS
    blocks = F.when(big, F.ceil(F.col("weight") * 2 / F.lit(float(TASK_TOKENS)))).otherwise(1).cast("int")
    placed = sized.select("node", "region").join(weights, "region").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    placed = placed.withColumn("other", F.explode(F.when(big, others).otherwise(F.array(F.lit(0)))))
    placed = placed.select(
        "node", F.when(big, F.col("region")).otherwise(F.pmod(F.xxhash64("region"), F.lit(tasks))).alias("task"),
        F.when(big, F.least("own", "other")).otherwise(-1).alias("i"), F.when(big, F.greatest("own", "other")).otherwise(-1).alias("j")).distinct()
    placed = kept(placed.join(nodes, "node"))
    with shuffles_released(docs.sparkSession):
        moved, every = placed.agg(F.sum("n")).first()[0] or 0, rows.agg(F.sum("n")).first()[0] or 0
    waves = max(1, -(-int(moved) // max(1, int(every))))

    def run(group: pa.Table) -> pa.Table:
        node, sets, seen = [], [], set()
        for batch in group.to_batches():
            for part in text_slices([batch]):
                for n, t in zip(part.column("node").to_pylist(), texts(part), strict=True):
                    if n not in seen:
                        seen.add(n)
                        node.append(n)
                        sets.append(shingles(t, words))
        rank = sorted(range(len(node)), key=lambda k: node[k])
        node, sets = [node[k] for k in rank], [sets[k] for k in rank]
        classes = linked(sets, least)
        pairs = [(node[k], node[classes.find(k)]) for k in range(len(node)) if classes.find(k) != k]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    pairs = None
    for wave in range(waves):
        own = placed.where(F.pmod(F.xxhash64("task", "i", "j"), F.lit(waves)) == wave).drop("n")
        inputs = once(docs.select("doc_id", "text").where("text is not null")).join(own, ["row_id", "text_hash"])  # a text moves once to here, then to its tasks
        got = kept(inputs.select("task", "i", "j", "node", "text").groupBy("task", "i", "j").applyInArrow(run, "a long, b long").distinct())
        pairs = got if pairs is None else pairs.union(got)
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, root for every node of ``pairs`` (a, b): each round maps a node to its smallest neighbour and contracts the graph, until no pair is left."""
    pairs, total = kept(pairs), None
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
        if total is None:
            total = step
        else:
            total = kept(total.withColumnRenamed("root", "__root").join(step.select(F.col("node").alias("__root"), F.col("root").alias("__next")), "__root", "left")
                         .select("node", F.coalesce("__next", "__root").alias("root")))
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        pairs = kept(pairs.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return total if total is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def placed_in_classes(docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, row_id, text_hash, n, ...), and those with a shingle once more with the root of their class.

    Signatures take about as much room as the documents; they are deleted when the regions are known.
    """
    with leaving_nothing(docs.sparkSession):
        signed = written(described(docs, words, least), "signatures")
        rows = kept(signed.drop("signatures"))
        found = kept(regions(signed))
    roots = components(links(docs, rows, found, words, least))
    full = rows.where("n > 0").select("doc_id", "row_id", "text_hash", "n", "node").join(roots, "node", "left")
    return rows, kept(full.withColumn("root", F.coalesce("root", "node")))


def classes(docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row.

    component_id is the smallest doc_id of the class; rows that repeat a text share a class.  A text that is NULL or
    without words has no shingle and is a class of its own row; a class without any doc_id has a NULL one.
    """
    rows, full = placed_in_classes(docs, words, least)
    least = kept(full.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = full.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs``, own columns, with one row of each class: that of the smallest doc_id, of a NULL one only if there is no other.

    Rows without words are classes of their own and all stay.
    """
    _, full = placed_in_classes(docs, words, least)
    stays = kept(full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "row_id", "text_hash")).alias("at")).select("at.row_id", "at.text_hash"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = {c: f"__{k}" for k, c in enumerate(docs.columns) if c.lower() in ("row_id", "text_hash")}  # the caller's own columns of these names
    named = docs.withColumnsRenamed(own)
    one = once(named.where(worded)).join(stays, ["row_id", "text_hash"], "left_semi").select(*named.columns)
    return one.union(named.where(~worded)).withColumnsRenamed({b: a for a, b in own.items()})
