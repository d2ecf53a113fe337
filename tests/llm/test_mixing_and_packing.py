import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pavilion.llm import mixing, packing
from pavilion.llm.common import table


def test_mix_agrees_with_sql(spark, small):
    docs = table(spark, small, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in mixing.plan(docs).collect())
    assert [(w[0], w[1], w[2], w[5], w[6]) for w in want] == [(g[0], g[1], g[2], g[5], g[6]) for g in got]
    assert [w[3] for w in want] == pytest.approx([g[3] for g in got])


def test_targets_fill_up_to_their_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 400), ("z", 0)], "source string, size long")
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    weight, size = {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}, {"a": 100, "b": 1000, "c": 10, "z": 0, None: 400}
    want, left = {}, 1.5 * 1510
    open_ = set(weight)
    while True:  # cap, reshare the excess, repeat
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(want[s] for s in over)
        open_ -= over
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    assert got["z"].rate == 0


def test_mix_of_odd_rows(odd_docs, no_docs):
    plan = mixing.plan(odd_docs).collect()
    assert len(plan) == 9 and all(r.taken <= 2 * r["size"] for r in plan)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert sorted(map(tuple, mixing.plan(odd_docs).collect()), key=str) == sorted(map(tuple, plan), key=str)


def test_mix_gives_back_columns_of_any_name(odd_docs):
    from pyspark.sql import functions as F

    named = odd_docs.drop("rate").withColumns({"draw": F.lit(42.0), "Rate": F.lit("own"), "__copy": F.lit(3), "copies": F.lit(None).cast("int")})
    mixed = mixing.mix(named)
    assert mixed.columns == named.columns and mixed.schema["draw"].dataType == named.schema["draw"].dataType
    assert {(r.draw, r.Rate, r["__copy"], r.copies) for r in mixed.collect()} == {(42.0, "own", 3, None)}
    per = {(r.doc_id, r.copies) for r in mixing.plan(odd_docs).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert len(got) == sum(r.copies for r in mixing.plan(odd_docs).collect()) and {d for d, n in per if n} == set(got)


def test_ids_are_the_tokenizers(spark, small):
    from tokenizers import Tokenizer

    docs = table(spark, small, "documents")
    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.tokenize(docs, capacity=256).collect()
    want = set()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(doc, k, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))}
    assert set(map(tuple, got)) == want


@pytest.mark.parametrize("text", ["", " ", "a  b\n\nc", "don't <|endoftext|>x", "Ünḯ   x y 12345 …!?", "ΑΣ ΣΑ Σ", "x" * 100, "\x1c a\x1fb \x85 c", "İstanbul İx ok", "it's they're we'", "A <|ENDOFTEXT|> B", "ÀÉß µ Ÿ ÿ", "a, b. c., d .. e. f, ,g x_. y 1. 2, ", "end. Of, it.", "no ... run, here. ", "ﬁne Ⅷ aͤb é. word,..!"])
def test_words_one_by_one_are_the_whole(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    table, words = packing.WordIds(path), packing.split_words(text)
    table.learn(set(words))
    assert np.frombuffer(table.encode(words), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_close_to_the_bound(spark, small):
    rows = packing.pack_documents(table(spark, small, "documents")).collect()
    assert check_packing(rows) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    check_packing(rows)
    assert len([r for r in rows if r.doc_id == 1]) == 3  # repeated rows are pieces of their own
    assert [(r.piece, r.length) for r in rows if r.doc_id in (2, 3, 4)] == [(0, 1)] * 3
    assert sum(r.length for r in rows if r.doc_id == 5) > 100_000
    assert packing.pack_documents(no_docs).count() == 0


def test_equal_pieces_part_into_even_groups(spark):
    rows = spark.range(20_000, numPartitions=3).selectExpr("7L as doc_id", "0 as piece", "0L as start", "1000L as length", "5L as ids_crc32")
    got = [r["count"] for r in packing.packed_groups(rows, 4096, 3)[0].groupBy(F.expr("sequence_id >> 32").alias("g")).count().collect()]
    assert len(got) == 5 and sum(got) == 20_000 and max(got) < 1.1 * packing.GROUP_PIECES
    placed = packing.pack(rows).groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("m"), F.max("offset").alias("o")).collect()
    assert len(placed) == 5_000 and all((r.n, r.m, r.o) == (4, 4, 3000) for r in placed)


def test_what_groups_leave_is_packed_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    rows = spark.range(200, numPartitions=4).selectExpr("id as doc_id", "0 as piece", "0L as start", "300L as length", "id as ids_crc32")
    once = packing.packed_groups(rows, 4096, 0)[0].select("sequence_id").distinct().count()
    assert packing.pack(rows).select("sequence_id").distinct().count() < once


def test_local_search_empties_a_bin():
    # best fit decreasing leaves three bins, two suffice
    lengths = np.array([6, 5, 4, 3, 2])
    bins = [[0, 3], [1, 4], [2]]
    better = packing.improve(bins, lengths, 10)
    assert len(better) == 2 and sorted(i for b in better for i in b) == [0, 1, 2, 3, 4]
    assert all(sum(lengths[i] for i in b) <= 10 for b in better)


def test_sequences_hold_the_ids(spark, small):
    docs = table(spark, small, "documents").limit(40)
    want = {r.ids_crc32: r.length for r in packing.tokenize(docs).collect()}
    for s in packing.sequences(docs).collect():
        assert len(s.ids) == 4 * s.length <= 4 * packing.CAPACITY
        for a, b in zip(s.offsets, [*s.offsets[1:], s.length]):
            assert want[zlib.crc32(bytes(s.ids[4 * a:4 * b]))] == b - a


def test_local_search_leaves_no_partner():
    """However many bins are fuller, none is left between which a move or an exchange would gain."""
    sizes = np.random.default_rng(1).integers(300, 1500, 400)
    bins = packing.improve(packing.best_fit(sizes, 4096), sizes, 4096)
    fill = [int(sizes[b].sum()) for b in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < 4096), key=lambda k: fill[k])
    assert sorted(i for b in bins for i in b) == list(range(400)) and max(fill) <= 4096 and len(order) > 1
    assert not any(packing._step(bins[a], bins[b], sizes.tolist(), 4096 - fill[b]) for k, a in enumerate(order) for b in order[k + 1:])
