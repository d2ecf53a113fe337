import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import xxhash
import pytest

from pavilion.llm import ann, jaccard, spans
from pavilion.llm.common import table
from pavilion.session import shared_folder
from pyspark.sql import functions as F


def brute_classes(rows):
    """component of every row by comparing all different sets."""
    def shingle_set(text):
        words = (text or "").encode().lower().split()
        return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])

    sets = [shingle_set(t) for _, t in rows]
    different = list({s for s in sets if s})
    links = jaccard.Links(len(different))
    for a, s in enumerate(different):
        for b in range(a):
            o = different[b]
            both = len(s & o)
            if 100 * both >= 90 * (len(s) + len(o) - both):
                links.join(a, b)
    at = {s: links.find(k) for k, s in enumerate(different)}
    least = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            least[at[s]] = min(doc, least.get(at[s], doc))
    return [(doc, len(s), least.get(at[s]) if s else doc) for (doc, _), s in zip(rows, sets)]


def check_classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.classes(docs).collect()), key=str)
    assert got == sorted(brute_classes(rows), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_of_edited_copies(spark):
    rng = random.Random(5)
    rows = []
    for size in (1, 2, 3, 5, 11, 12, 13, 14, 22, 40, 150, 700):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):
            rows.append((len(rows), edited(rng, words, min(edits, size))))
        rows += [(len(rows), " ".join(words[:-1])), (len(rows) + 1, " ".join([*words, "more"])), (len(rows) + 2, " ".join(words).upper())]
    rows += [(None, rows[100][1]), (7000, None), (7001, ""), (7002, "  \n"), (7003, rows[100][1]), (7003, rows[100][1])]
    check_classes(spark, rows)


def test_classes_of_one_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(rng, base, rng.randrange(4))) for k in range(400)]
    monkeypatch.setattr(jaccard, "TASK_TOKENS", 5_000)  # several blocks of one region
    check_classes(spark, rows)


def test_classes_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check_classes(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("least", [(90, 100), (80, 100)])
@pytest.mark.parametrize("size", [9, 10, 14, 15, 20, 33, 100, 400])
def test_linked_sets_share_a_signature(size, least):
    rng = np.random.default_rng(size)
    most = size * (least[1] - least[0]) // 90 + 2
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        gone, new = rng.integers(0, most), rng.integers(0, most)
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 62, new).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if least[1] * both >= least[0] * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard.signatures(a, least), jaccard.signatures(b, least)).size


def test_representatives(spark, odd_docs, no_docs):
    got = jaccard.representatives(odd_docs)
    assert got.columns == odd_docs.columns
    assert got.where("doc_id = 1").count() == 2 and got.count() == 8  # the repeated row goes, empty ones stay
    assert jaccard.representatives(no_docs).count() == 0 and jaccard.classes(no_docs).count() == 0
    assert jaccard.classes(odd_docs).count() == 9


def test_classes_leave_no_shuffles_and_no_signatures(spark):
    rng = random.Random(9)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(30)]
    docs = spark.createDataFrame([(3 * k + e, edited(rng, w, e)) for k, w in enumerate(words) for e in range(3)], "doc_id long, text string")
    homes = [Path(h) for h in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {p for h in homes for p in h.glob("*/shuffle_*.data")}
    folder = Path(shared_folder(spark).removeprefix("file:"), spark.sparkContext.applicationId)
    signatures = lambda: set(folder.glob("signatures-*"))
    before = shuffles(), signatures()
    rows, full = jaccard.placed_in_classes(docs)
    until = time.time() + 20
    while shuffles() - before[0] and time.time() < until:  # Spark deletes them when it finds time
        time.sleep(0.2)
    assert not shuffles() - before[0] and not signatures() - before[1]
    assert rows.count() == full.count() == 90 and full.select("root").distinct().count() < 90


def test_texts_of_many_tasks_move_in_waves(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, edited(rng, words, k % 5)) for k in range(60)]
    made, own = [], jaccard.kept
    monkeypatch.setattr(jaccard, "TASK_TOKENS", 2_000)  # a region of many blocks: each text goes to several tasks
    monkeypatch.setattr(jaccard, "kept", lambda df: (made.append(sys._getframe(1).f_code.co_name + " ".join(df.columns)), own(df))[1])
    check_classes(spark, rows)
    assert made.count("linksa b") > 1


def brute_near(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for a in np.flatnonzero(ids % 20 == 0):
        score = (x[a] * x).sum(axis=1)
        others = np.flatnonzero(ids != ids[a])
        out[ids[a]] = [(int(ids[b]), score[b]) for b in others[np.lexsort((ids[others], -score[others]))][:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute_near([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = found(ann.search(vectors, F.col("vec_id") % 20 == 0).collect())
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    true = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(true[q, i] == pytest.approx(s, abs=1e-12) for q, w in got.items() for i, s in w if (q, i) in true)


def test_neighbours_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6)).round(2)
    rows = [(k, base[k % 30].tolist()) for k in range(90)] + [(k, base[0].tolist()) for k in range(200, 260)]
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (20, base[20].tolist())]
    vectors = spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], "vec_id long, embedding array<double>, score double, list int")
    got = found(ann.search(vectors, F.col("vec_id") % 20 == 0, k=20).collect())
    want = brute_near(rows, 20)
    assert got.keys() == want.keys()
    for q in want:  # so few vectors are probed whole; ties go to the smaller id
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert ann.search(vectors.where("vec_id is null"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).collect()[0].vec_id == 1


def test_neighbours_beyond_the_sample(spark, monkeypatch):
    """Recall where the lists are fitted on a fifth of the rows, and whose tuning queries the means have not seen."""
    monkeypatch.setattr(ann, "MAX_SAMPLE", 2000)
    monkeypatch.setattr(ann, "TASK_ROWS", 700)
    monkeypatch.setattr(ann, "TASK_QUERIES", 60)
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute_near([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = found(ann.search(vectors, F.col("vec_id") % 20 == 0).collect())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall", recall)
    assert got.keys() == want.keys() and recall >= 0.9


def test_an_id_with_two_vectors_asks_once(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.9, 0.0]), (2, [-0.0, 0.8]), (3, [0.5, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 0.9), (2, 2, 0.8), (3, 3, 0.5)]


def test_scan_abandons_no_near_candidate():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(10, 64))
    square = float((x * x).sum(axis=1).max())
    index = ann.fit(x[:500], 500, square)
    lists = np.arange(2000) % 7
    a, ids, score = ann.scan(x, np.arange(2000), lists, q, [np.arange(7)] * 10, index, 20)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(ids[a == k].tolist()) & set(w.tolist())) / 20 for k, w in enumerate(want)]) > 0.97
    assert np.array_equal(score, (q[a] * x[ids]).sum(axis=1))
    floor = np.sort(q @ x.T, axis=1)[:, -20]
    b, near, _ = ann.scan(x, np.arange(2000), lists, q, [np.array([2, 5])] * 10, index, 20, floor)
    assert np.isin(lists[near], (2, 5)).all() and all(set(near[b == k].tolist()) <= set(w.tolist()) for k, w in enumerate(want))


def plain_words(text):
    """(start, end, word, whether a sentence ends after it) by walking over the words."""
    table, found = spans.Words(), list(re.finditer(r"\S+", text))
    return [(m.start(), m.end(), m.group(), bool(table[m.group()] & 1) or following is None or "\n" in text[m.end():following.start()])
            for m, following in zip(found, [*found[1:], None])]


def runs_between(words, cuts):
    """(words, first, word after the last) of the shortest run from each cut that has enough units and words."""
    edges, out = [0, *[k + 1 for k, c in enumerate(cuts) if c]], []
    for i, a in enumerate(edges[:-1]):
        for n, b in enumerate(edges[i + 1:], 1):
            if n >= spans.LEAST_SENTENCES and b - a >= spans.LEAST_WORDS:
                out.append((tuple(w[2].lower() for w in words[a:b]), a, b))
                break
    return out


def plain_all_spans(words):
    """Spans of sentences, and where 50 words hold none strictly inside, spans between closer cuts."""
    sentences = [w[3] for w in words]
    out = [(("sentences", s), a, b) for s, a, b in runs_between(words, sentences)]
    bare = [s for s in range(len(words) - spans.PASSAGE_WORDS + 1) if not any(s < a and b < s + spans.PASSAGE_WORDS for _, a, b in out)]
    if not bare:
        return out
    key = [0 if w[3] else max(xxhash.xxh3_64_intdigest(w[2].lower().encode()) >> 1, 1) for w in words]
    cuts = list(sentences)
    for s in range(len(words) - spans.WINDOW + 1):
        cuts[max(range(s, s + spans.WINDOW), key=lambda k: (-key[k], k))] = True
    return out + [(("closer", s), a, b) for s, a, b in runs_between(words, cuts) if any(p <= a and b <= p + spans.PASSAGE_WORDS for p in bare)]


def brute_dedup(rows):
    """Spans by plain dictionaries over all documents, first by doc_id; the words of repeated ones go."""
    words = {d: plain_words(t) for d, t in rows}
    own = {d: plain_all_spans(w) for d, w in words.items()}
    first = {}
    for d in sorted(own):
        for span, _, _ in own[d]:
            first.setdefault(span, d)
    out = {}
    for d, text in rows:
        drop, seen = set(), set()
        for span, a, b in own[d]:
            if span in seen or first[span] < d:
                drop |= set(range(a, b))
            seen.add(span)
        left, at, hurt, sentence = [], 0, set(), 0
        for k, (_, end, _, last) in enumerate(words[d]):
            if k in drop:
                hurt.add(sentence)
            else:
                left.append(text[at:end])
            at, sentence = end, sentence + last
        out[d] = sum(w[3] for w in words[d]), len(hurt), text if not drop else "".join([*left, text[at:]])
    return out


def test_dedup_of_the_table(spark, small):
    docs = table(spark, small, "documents")
    want = brute_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in spans.dedup(docs).collect()}
    assert got == want


def test_shared_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(8)

    def prose(n):
        return " ".join(f"{'x' * rng.randrange(1, 4)}{rng.randrange(10**6)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)) + "."

    passage = prose(60)
    rows = [(k, f"{prose(80)} {passage} {prose(50)}") for k in range(20)] + [(k, prose(120)) for k in range(20, 40)]
    got = {r.doc_id: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and all(got[k].text == rows[k][1] for k in range(20, 40))
    inner = " ".join(passage.split()[15:45])
    assert all(inner not in got[k].text and got[k].n_removed for k in range(1, 20))


def test_dedup_of_odd_rows(odd_docs, no_docs):
    got = spans.dedup(odd_docs).collect()
    assert len(got) == 9 and sum(r.text is None for r in got) == 2
    assert [r.n_removed for r in got if r.doc_id == 1] == [0, 0, 0]
    assert spans.dedup(no_docs).count() == 0


@pytest.mark.parametrize("stop", [0, 12, 25])
def test_every_passage_of_51_words_meets_itself(stop):
    rng = random.Random(stop)

    def words(n):
        return [f"w{rng.randrange(10**9)}{'.' if stop and rng.randrange(stop) == 0 else ''}" for _ in range(n)]

    for trial in range(1500):
        passage, offset = words(51), trial % 60
        one, two = ((words(k), words(rng.randrange(60))) for k in (offset, rng.randrange(60)))
        text = [" ".join([*before, *passage, *after]) for before, after in (one, two)]
        if trial % 3 == 0:
            text[0] = text[0].replace(passage[0], "\n" + passage[0])
        found = [spans.every_span(*spans.sentences(t)) for t in text]
        both = np.isin(found[0][0], found[1][0])
        assert both.any()
        assert (found[0][1][both] >= offset).all() and (found[0][2][both] <= offset + 51).all()


def test_passages_inside_lines_go_from_the_second_document(spark):
    rng = random.Random(9)

    def words(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    rows = []
    for k in range(150):
        passage = words(51)
        rows += [(k, f"{words(k % 50)} {passage} {words(20)}"), (1000 + k, f"{words(20)} {passage} {words(k % 50)}")]
    got = {r.doc_id: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d].text == t and not got[d].n_removed for d, t in rows if d < 1000)
    assert all(len(got[d].text.split()) <= len(t.split()) - 20 and got[d].n_removed for d, t in rows if d >= 1000)
