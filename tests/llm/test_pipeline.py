import random
import re
import zlib

import numpy as np

import corpus_pipeline
from pavilion.llm import jaccard, mixing, packing, quality, secrets, stats
from pavilion.llm.common import table

SF = "/root/testdata/sf0.001"


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "secrets", "mixing", "packing"]


def test_every_stage_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]

    good = stages["quality"](spark, docs, SF)
    model = quality.train(docs, table(spark, SF, "labels"))
    score = model.scores(stats.ratios(np.array([stats.measure(r[1] or "") for r in rows])))
    want = [r for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD]
    assert sorted(map(tuple, good.collect())) == sorted(want) and good.columns == docs.columns
    assert 0 < len(want) < len(rows)

    sets = {r[0]: five_words(r[1]) for r in want}
    ids, up = sorted(sets), {}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up.setdefault(a, []).append(b)
    classes = jaccard.Links(max(ids) + 1)
    for a, others in up.items():
        for b in others:
            classes.join(a, b)
    one = stages["jaccard"](spark, good, SF)
    want = [r for r in want if classes.find(r[0]) == r[0]]
    assert sorted(map(tuple, one.collect())) == sorted(want)

    clean = stages["secrets"](spark, one, SF)
    for r in clean.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
    assert clean.count() == len(want) and clean.columns == docs.columns

    mixed = stages["mixing"](spark, clean, SF)
    copies = {r.doc_id: r.copies for r in mixing.plan(clean).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert {d: got.count(d) for d in copies} == copies and mixed.columns == docs.columns

    placed = stages["packing"](spark, mixed, SF).collect()
    text = {r.doc_id: r.text for r in clean.collect()}
    ids = packing.WordIds(packing.tokenizer_path())
    for r in placed:
        whole = ids.encode(packing.split_words(text[r.doc_id])) + np.array([1], "<u4").tobytes()
        assert zlib.crc32(whole[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32
    assert sum(r.piece == 0 for r in placed) == len(got)


def test_run_applies_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() == corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_are_of_five_words_and_four_fifths(spark):
    """Classes by comparing plain sets of five words; copies with a changed word, and with a block added."""
    rng = random.Random(11)
    rows = []
    for size, changes in ((30, 1), (49, 1), (55, 1), (94, 2), (115, 2), (139, 3), (172, 3), (300, 40)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        changed = list(words)
        for k in range(changes):
            changed[(2 * k + 1) * size // (2 * changes)] = f"e{rng.randrange(10**6)}"
        block = [f"b{rng.randrange(10**6)}" for _ in range(size // 5)]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((words, changed, words[:-size // 8], words + block, block + changed))]
    rows += [(len(rows), "one two three four"), (len(rows) + 1, "one two three four"), (len(rows) + 2, "one two three"), (len(rows) + 3, "")]

    def plain(text):
        words = text.split()
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [plain(t) for _, t in rows]
    classes = jaccard.Links(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                classes.join(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).collect())
    assert got == [a for a in range(len(rows)) if classes.find(a) == a]
    assert {0, 5, 10} <= set(got) and not {6, 11, 16, 21, 26, 31} & set(got)
