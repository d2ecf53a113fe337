import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pavilion.llm import pii, queries
from pavilion.llm.common import table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(EMAIL, text)]
    out += [(1, *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(CARD, text) if 16 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab1.@- +()٣", max_size=40), st.text("0123456789 -", max_size=60), st.text("12.25+@x", max_size=30)))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_base_spans_of_long_runs():
    text = "a" * 50_000 + " " + "1" * 50_000 + " @a.b" * 20_000 + " +" + "1 " * 20_000 + "x@y.zz 4111 1111 1111 1111, +1 (743) 555-3824, 256.1.1.1 8.8.8.8"
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "x@y.zz"), ("ip", "8.8.8.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    net = pii.Network({k: v.astype(np.float64) for k, v in pii.Network.fresh(1).w.items()})
    x, y = r.integers(0, pii.CLASSES, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 4], [0] * 7, [1, 2, 2, 1, 0, 7, 8]])
    run = net.run
    net.run = lambda x, d, keep=None: run(x, d, keep).astype(np.float64)
    _, grad = net.loss(x, y)
    for name in net.w:
        for at in [tuple(r.integers(0, n) for n in net.w[name].shape) for _ in range(4)] + ([(int(x[0, 1]), 5)] if name.startswith("wx") else []):
            keep, values = net.w[name][at], []
            for step in (1e-3, -1e-3):
                net.w[name][at] = keep + step
                values.append(net.loss(x, y)[0])
            net.w[name][at] = keep
            assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-3)


def test_decoding_is_the_best_of_all_paths():
    r = np.random.default_rng(5)
    net = pii.Network.fresh(2)
    net.w["tr"], net.w["st"] = (r.normal(size=s).astype(np.float32) for s in ((pii.TAGS, pii.TAGS), pii.TAGS))
    rows = [r.normal(size=(n, pii.TAGS)).astype(np.float32) * 2 for n in (1, 4, 4, 3)]
    ok = pii.allowed()
    for e, path in zip(rows, pii.decode(net, rows), strict=True):
        def score(p, e=e):
            return net.w["st"][p[0]] + sum(e[t, k] for t, k in enumerate(p)) + sum(net.w["tr"][a, b] for a, b in itertools.pairwise(p))

        paths = [p for p in itertools.product(range(pii.TAGS), repeat=len(e)) if (p[0] == 0 or p[0] % 2) and all(ok[a, b] for a, b in itertools.pairwise(p))]
        assert score(tuple(path.tolist())) == pytest.approx(max(map(score, paths)), abs=1e-3)


def test_windows_are_joined():
    net = pii.Network.fresh(3)
    r = np.random.default_rng(1)
    rows = [r.integers(1, pii.CLASSES, n).astype(np.int16) for n in (5, pii.WINDOW, 250)]
    got = pii.joined_emissions(net, rows)
    assert [g.shape for g in got] == [(len(x), pii.TAGS) for x in rows]
    assert got[1] == pytest.approx(net.emissions(rows[1][None])[0], abs=1e-4)
    weight = np.minimum(np.arange(1, pii.WINDOW + 1), np.arange(pii.WINDOW, 0, -1))
    at = 100  # in the windows that begin at 48 and 96
    parts = [(weight[at - s], net.emissions(rows[2][None, s:s + pii.WINDOW])[0][at - s]) for s in (48, 96)]
    assert got[2][at] == pytest.approx(sum(w * e for w, e in parts) / sum(w for w, _ in parts), abs=1e-4)


@pytest.fixture(scope="module")
def net(spark):
    return pii.train(table(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 3 != 0"))


def test_held_out_windows(spark, net):
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 3 = 0").collect()
    windows = [w for r in rows if r.text for w in pii.labelled_windows(r.text, r.doc_id)]
    hit = want = extra = 0
    for (_, spans), got in zip(windows, pii.model_spans(net, [t for t, _ in windows]), strict=True):
        hit, want, extra = hit + len(set(spans) & set(got)), want + len(spans), extra + len(set(got) - set(spans))
    assert want > 30 and hit >= 0.8 * want and extra <= 0.1 * want


def test_scan_of_the_table(spark, net):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in pii.scan(docs, net).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        base, g = brute_base(r.text or ""), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        every = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in g.spans.split(",") if s)]
        assert set(base) <= set(every) and len(every) == len(base) + g.n_found and every == sorted(every)
        assert g.masked == pii.masked(r.text or "", every)
    assert not pii.base_spans(pii.masked("x@y.zz, +1 (743) 555-3824, 8.8.8.8", pii.base_spans("x@y.zz, +1 (743) 555-3824, 8.8.8.8")))


def test_odd_rows(odd_docs, no_docs, net):
    got = pii.scan(odd_docs, net)
    assert got.count() == odd_docs.count() and got.where("n_found + n_email > 0").count() == 0
    assert pii.scan(no_docs, net).count() == 0
    assert pii.train(no_docs) is None and pii.train(odd_docs) is None
    assert pii.all_spans(None, ["a@b.cc", ""]) == [([(0, 0, 6)], [(0, 0, 6)]), ([], [])]


def test_query_repeats(spark, small):
    one, two = ({r.doc_id: r.spans for r in queries.op12_personal(spark, small).collect()} for _ in range(2))
    assert one == two and len(one) == 200
