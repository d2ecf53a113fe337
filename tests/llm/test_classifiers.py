from collections import Counter

import numpy as np
import pytest

from pavilion.llm import langid, quality, rules, stats, toxicity
from pavilion.llm.common import crc_mod, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@pytest.mark.parametrize("text", ["", " \n ", "a b c d e a b c d e a b c d e", "x\nx\n\n x\n", "é #   ü|\x0b\x1c a", "a " * 30, "p q r s t u p q r s t"])
def test_counts_against_brute_force(text):
    assert list(stats.measure(text)[:5]) == brute_counts(text)


def test_counts_of_the_table(spark, small):
    docs = table(spark, small, "documents")
    text = dict(docs.select("doc_id", "text").collect())
    for r in stats.stats(docs).collect():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_counts(text[r.doc_id])


def test_flat_trees_agree_with_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.3)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for t in range(20):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.threshold[t, node] else 1)
            total += forest.value[t, node - 7]
        return 1 / (1 + np.exp(-total))

    assert forest.scores(x) == pytest.approx([walk(r) for r in x])
    assert ((forest.scores(x) > 0.5) == (y == 1)).mean() > 0.97


def held_out_accuracy(rows, labels, target):
    both = rows.where("held_out").join(labels.select("doc_id", target), "doc_id").select("predicted", target).collect()
    return np.mean([r[0] == r[1] for r in both])


def test_quality_on_held_out_rows(spark, odd_docs, no_docs, no_labels):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == docs.count()
    assert held_out_accuracy(got, labels, "quality") > 0.95
    assert quality.score(odd_docs, model).where("score between 0 and 1").count() == 9
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    assert quality.score(no_docs, model).count() == 0
    untrained = quality.train(no_docs, no_labels)
    assert {r.score for r in quality.score(odd_docs, untrained).collect()} == {0.5}


def test_rules_on_labelled_rows(spark, odd_docs, no_docs, no_labels):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learned = rules.train(docs, labels)
    assert learned
    rows = rules.judge(docs, learned).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows if not r.base_failed]) > 0.97
    assert rules.judge(odd_docs, learned).where("n_words < 10 and kept").count() == 0
    assert rules.judge(odd_docs, learned).count() == 9 and rules.judge(no_docs, learned).count() == 0
    assert rules.train(no_docs, no_labels) == []


def test_list_as_expression_agrees_with_numpy(spark, small):
    learned = [[("symbol_share", ">", 0.0)], [("distinct_share", "<=", 0.5), ("n_words", ">", 100.0)]]
    rows = rules.judge(table(spark, small, "documents"), learned).select("rule", *[rules.column(f).alias(f"f_{f}") for f in rules.FEATURES]).collect()
    x = np.array([r[1:] for r in rows])
    first = np.where(rules.holds(x, learned[0]), 0, np.where(rules.holds(x, learned[1]), 1, -1))
    assert [-1 if r.rule is None else r.rule for r in rows] == first.tolist()


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs, no_labels):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert held_out_accuracy(got, labels, "toxic") > 0.96
    assert toxicity.score(odd_docs, model).where("predicted = 1").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.train(no_docs, no_labels)
    assert empty.lexicon == {} and (empty.weights == toxicity.PRIOR).all()


def test_grammar_marks_context():
    words, machine = toxicity.Words({"moron": 3.0}), toxicity.grammar()

    def evidence(text):
        return np.flatnonzero(toxicity.clause_features(text, words, machine)[1:]).tolist()

    assert evidence("a moron") == [0]
    assert evidence("you are a moron") == [1]
    assert evidence("she said a moron came") == [3]
    assert evidence("it is not a moron") == [4]
    assert evidence("it is not. A moron") == [0]
    assert evidence("it is not what one would call a moron") == [0]  # out of reach
    assert evidence("they will kill") == [9]
    assert evidence("") == []


def test_composition_is_one_after_the_other():
    a = toxicity.Transducer(2, {(0, 1): (1, 2), (1, 1): (0, 3)})
    b = toxicity.Transducer(2, {(0, 2): (1, 4), (1, 3): (0, 5)})
    both, sa, sb, s = a.then(b, 6), 0, 0, 0
    for x in [1, 1, 0, 1, 1, 1]:
        sa, y = a.step(sa, x)
        sb, want = b.step(sb, y)
        s, got = both.step(s, x)
        assert got == want


def test_language_on_held_out_rows(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    odd = langid.identify(odd_docs, model).collect()
    assert len(odd) == 9 and sum(r.lang_pred == "und" for r in odd) == 4
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_filters_hold_every_counted_gram(spark):
    docs = spark.createDataFrame([("xx", "abcd abcd"), ("yy", "bcde bcde"), (None, "zzzz")], "lang string, text string")
    got = {(r.lang, r.gram): r.n for r in langid.gram_counts(docs).collect()}
    want = Counter()
    for lang, text in (("xx", "abcd abcd"), ("yy", "bcde bcde")):
        text += " "
        for n in langid.GRAMS:
            for k in range(len(text) - n + 1):
                gram = text[k:k + n]
                if " " not in gram[1:-1] and (gram[0] != " " or gram[-1] != " "):
                    code = n
                    for c in gram.encode():
                        code = code << 8 | c
                    want[lang, code] += 1
    assert got == dict(want)
    model = langid.train(docs)
    for lang, gram in want:
        bits = np.uint64(0xFFFFFFFFFFFFFFFF)
        for k in range(langid.HASHES):
            bits &= model["masks"][k][langid._positions(np.array([gram], np.uint64), k)][0]
        share = want[lang, gram] / sum(v for (x, _), v in want.items() if x == lang)
        best = max(want[x, gram] / sum(v for (y, _), v in want.items() if y == x) for x in ("xx", "yy"))
        assert bool(int(bits) >> model["langs"].index(lang) & 1) or share < langid.LEAST_PART * best
