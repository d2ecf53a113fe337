import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pavilion.llm import align, queries
from pavilion.llm.common import table


def brute(rows):
    """Tokens, groups and links of each text spelled out, then the corpus-wide numbers."""
    units = align.Units(*align.default_paths())
    pairs, per = Counter(), []
    for doc, text in rows:
        a = units.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = units.b.encode(text) if text else []
        a_bytes, b_bytes = [units.a_bytes[i] for i in a], [units.b_bytes[i] for i in b]
        if not text or not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
            per.append((doc, 0, 0, 0, Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([0, *map(len, a_bytes)]).tolist(), np.cumsum([0, *map(len, b_bytes)]).tolist()
        links, j = Counter(), 0
        for i in range(len(a)):
            while ends_b[j + 1] <= ends_a[i]:
                j += 1
            k = j
            while k < len(b) and ends_b[k] < ends_a[i + 1]:
                links[a[i], b[k]] += 1
                k += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a[1:]) & set(ends_b[1:])):
            own_a, own_b = [], []
            while i < len(a) and ends_a[i + 1] <= cut:
                own_a.append(str(a[i]))
                i += 1
            while j < len(b) and ends_b[j + 1] <= cut:
                own_b.append(str(b[j]))
                j += 1
            groups.append(",".join(own_a) + "|" + ",".join(own_b))
        per.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.update(links)
    top = defaultdict(int)
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return [(doc, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if pairs[p] == top[p[1]]), sum(n * pairs[p] for p, n in links.items()), digest)
            for doc, n_a, n_b, n_groups, links, digest in per]


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(brute(rows), key=str)


def test_alignment_of_the_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    same(queries.op11_alignment(spark, small), rows[:])


def test_many_slices_parts_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(align, "SLICE_BYTES", 2000)
    monkeypatch.setattr(align, "RUN_BYTES", 600)
    monkeypatch.setattr(align, "FAN_IN", 2)
    monkeypatch.setattr(align, "CACHE_UNITS", 50)
    texts = [f"the {'same ' * (k % 7)}words, and number {k} of été {chr(0x4E00 + k % 50)}x" * 3 for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    parts = align.written(align.sliced(docs), "test-runs")
    assert parts.select("slice").distinct().count() > 10
    same(align.align(docs), list(enumerate(texts)))


@pytest.mark.parametrize("text", ["  a  b ", "a\tb\n\n c", "\x00a \x1c b", "a\xa0b　 c", "don't can't 12 345", "<s> </s> <|endoftext|> x", "ﬁ① éte \U0001f600", "▁x y", "x" * 3000 + " y", "..  ..."])
def test_units_give_the_whole_encoding(text):
    units = align.Units(*align.default_paths())
    (row,) = units.numbers([align._EDGE.split(text)])
    want = brute([(0, text)])[0]
    whole = [units.text[k] for k in row]
    assert (None in whole) == (want[-1] == "")
    if want[-1]:
        assert hashlib.sha256(";".join(whole).encode()).hexdigest() == want[-1]
        assert tuple(np.sum([units.counts[k] for k in row], axis=0)) == want[1:5]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    same(align.align(odd_docs), rows)
    got = align.align(no_docs)
    assert got.count() == 0 and got.columns == align._COLUMNS


def test_runs_come_back():
    rng = np.random.default_rng(1)
    b, a, doc = rng.integers(0, 300, 5000), rng.integers(0, 40, 5000), rng.integers(0, 90, 5000)
    times = rng.integers(1, 5, 5000)
    want = Counter()
    for key, n in zip(zip(b.tolist(), a.tolist(), doc.tolist(), strict=True), times.tolist(), strict=True):
        want[key] += n
    got = Counter()
    for radix, head, body in align.runs_of(np.repeat((b << align.ID_BITS | a) << align.DOC_BITS | doc, times)):
        step, count = align.unpack(head)
        length, docs, n = align.unpack(body)
        pair = np.cumsum(step)
        assert set((pair >> align.ID_BITS) % align.RADICES) == {radix} and (step[1:] > 0).all()
        assert count.tolist() == [x.sum() for x in np.split(n, np.cumsum(length)[:-1])]
        for p, d, k in zip(np.repeat(pair, length).tolist(), docs.tolist(), n.tolist(), strict=True):
            got[p >> align.ID_BITS, p & ((1 << align.ID_BITS) - 1), d] += k
    assert got == want
