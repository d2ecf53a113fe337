"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF for what is written in other ways."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Documents and windows that the model learns from at most, and the training steps.
MAX_DOCUMENTS, MAX_WINDOWS, STEPS = 20_000, 3000, 240
#: Characters of a window, how far apart windows begin, and what is read on either side of a sign of personal data.
WINDOW, STRIDE, AROUND = 96, 48, 40
#: Units of each direction; rows trained on at once; the seed of weights and rewritings.
HIDDEN, BATCH, SEED = 16, 40, 12
#: Windows that run through the network at once, and positions that are decoded at once.
WINDOWS_AT_ONCE, POSITIONS_AT_ONCE = 4096, 1 << 18

# ---------------------------------------------------------------- fixed patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A pattern that fails at the first digit of a run fails at the others too, hence the look behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_address(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap per kind, in listing order."""
    found = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        since = max(end, text.rfind("@", 0, m.start()) + 1)
        start = since + len(text[since:m.start()].rstrip(_LOCAL))
        if start < m.start():
            end = m.end()
            found.append((0, start, end))
    found += [(1, *m.span()) for m in _IP.finditer(text) if is_address(m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return found


# ---------------------------------------------------------------- reading

#: Every span holds one of these: a digit, an at sign, or an at sign in words.
_SIGN = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]|\bat\b(?=[^\n]{1,40}\b(?:dot|punkt|punto|point)\b)", re.IGNORECASE)
_SINGLE = "abcdefghijklmnopqrstuvwxyz.@+-()[]{}<>_%:/,;=#'\"* \n"
#: Classes of characters: 0 beyond the text, 1 digits, then single ones; letters without case, other letters, the rest.
_CLASS = {c: k for k, c in enumerate(_SINGLE, 2)} | {c.upper(): k for k, c in enumerate(_SINGLE, 2)} | {str(d): 1 for d in range(10)}
OTHER_LETTER = len(_SINGLE) + 2
CLASSES = OTHER_LETTER + 2
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def classes(text: str) -> np.ndarray:
    get = _CLASS.get
    return np.array([k if (k := get(c)) is not None else OTHER_LETTER + (not c.isalpha()) for c in text], np.int16)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around signs of personal data, merged where they meet."""
    out: list[list[int]] = []
    for m in _SIGN.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def allowed() -> np.ndarray:
    """Transitions (from, to): inside a kind only behind its begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


# ---------------------------------------------------------------- network


@dataclass
class Network:
    """Weights by name: per direction ``wx`` (class -> gates), ``wh``, then ``wo``, ``bo`` (emissions), ``tr`` and ``st`` (CRF)."""

    w: dict

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"wx{d}"] = (r.standard_normal((CLASSES, 4 * HIDDEN)) * 0.3).astype(np.float32)
            w[f"wx{d}"][:, HIDDEN:2 * HIDDEN] += 1  # gates that keep start open
            w[f"wh{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN ** 0.5).astype(np.float32)
        w["wo"] = (r.standard_normal((2 * HIDDEN, TAGS)) * 0.1).astype(np.float32)
        w["bo"], w["tr"], w["st"] = np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
        return Network(w)

    def path_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Transition and start scores, with what no path may do out of reach."""
        return np.where(allowed(), self.w["tr"], -1e4), np.where((np.arange(TAGS) % 2 == 1) | (np.arange(TAGS) == 0), self.w["st"], -1e4)

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, row, unit] of one direction over classes [time, row]; ``keep`` gets what training needs."""
        wx, wh = self.w[f"wx{d}"], self.w[f"wh{d}"]
        steps, n = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]] + h @ wh
            gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, :3 * HIDDEN])  # in, keep, out
            g = np.tanh(z[:, 3 * HIDDEN:])
            before = c, h
            c = gates[:, HIDDEN:2 * HIDDEN] * c + gates[:, :HIDDEN] * g
            y = np.tanh(c)
            h = gates[:, 2 * HIDDEN:] * y
            out[t] = h
            if keep is not None:
                keep.append((t, gates, g, *before, y))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of tags [row, time, tag] for windows of classes [row, time]."""
        x = x.T
        both = np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=2)
        return (both @ self.w["wo"] + self.w["bo"]).transpose(1, 0, 2)

    def back(self, x: np.ndarray, d: str, keep: list, grad: np.ndarray, into: dict) -> None:
        """Gradients of one direction from those of its hidden states."""
        wh = self.w[f"wh{d}"]
        n = x.shape[1]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz = np.empty((n, 4 * HIDDEN), np.float32)
        for t, gates, g, c_before, h_before, y in reversed(keep):
            i, f, o = np.split(gates, 3, axis=1)
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - y * y)
            dz[:, :HIDDEN], dz[:, HIDDEN:2 * HIDDEN] = dc * g * i * (1 - i), dc * c_before * f * (1 - f)
            dz[:, 2 * HIDDEN:3 * HIDDEN], dz[:, 3 * HIDDEN:] = dh * y * o * (1 - o), dc * i * (1 - g * g)
            np.add.at(into[f"wx{d}"], x[t], dz)
            into[f"wh{d}"] += h_before.T @ dz
            dh, dc = dz @ wh.T, dc * f

    def loss(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of tags [row, time] per row, and its gradients."""
        x, tags = x.T, tags.T
        steps, n = x.shape
        keeps = {"f": [], "b": []}
        both = np.concatenate([self.run(x, d, keeps[d]) for d in "fb"], axis=2)
        e = both @ self.w["wo"] + self.w["bo"]
        tr, st = self.path_weights()
        rows = np.arange(n)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = st + e[0]
        for t in range(1, steps):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        value = float((total - st[tags[0]] - e[np.arange(steps)[:, None], rows, tags].sum(0) - tr[tags[:-1], tags[1:]].sum(0)).mean())
        into = {k: np.zeros_like(v) for k, v in self.w.items()}
        de = np.exp(alpha + beta - total[:, None])
        de[np.arange(steps)[:, None], rows, tags] -= 1
        into["st"] += de[0].sum(0) / n
        for t in range(1, steps):
            into["tr"] += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0) / n
        np.add.at(into["tr"], (tags[:-1], tags[1:]), np.float32(-1 / n))
        into["tr"] *= allowed()
        de /= n
        into["wo"] += np.einsum("tnh,tnk->hk", both, de, optimize=True)
        into["bo"] += de.sum((0, 1))
        dh = de @ self.w["wo"].T
        self.back(x, "f", keeps["f"], dh[:, :, :HIDDEN], into)
        self.back(x, "b", keeps["b"], dh[:, :, HIDDEN:], into)
        return value, into


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def learn(windows: list[tuple[str, list[tuple[int, int, int]]]], steps: int | None = None, seed: int = SEED) -> Network | None:
    """Adam on windows with labelled (kind, start, end) spans; without a labelled span there is no network."""
    if not any(spans for _, spans in windows):
        return None
    x, y = np.zeros((len(windows), WINDOW), np.int16), np.zeros((len(windows), WINDOW), np.int16)
    for row, (text, spans) in enumerate(windows):
        own = classes(text)[:WINDOW]
        x[row, :len(own)] = own
        for kind, a, b in spans:
            y[row, a:b] = 2 * kind + 2
            y[row, a:a + 1] = 2 * kind + 1
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    steps = STEPS if steps is None else steps
    for step in range(1, steps + 1):
        pick = r.integers(0, len(x), BATCH)
        _, grad = net.loss(x[pick], y[pick])
        size = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
        rate = 0.02 * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * min(1.0, 5 / max(size, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


# ---------------------------------------------------------------- labelled windows


def rewritten(text: str, kind: int, r: np.random.Generator) -> str:
    """A span as people disguise or vary it."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    if KINDS[kind] == "email":
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), ("(at)", "."))
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if KINDS[kind] == "ip":
        return text.replace(".", pick("[.]", "(.)", " . ", "[dot]"))
    d = digits_of(text)
    if KINDS[kind] == "card":
        return pick(".", "_", "/", "  ", " - ").join(d[k:k + 4] for k in range(0, len(d), 4))
    d = d[-10:] if len(d) >= 10 else d
    return pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}", "00{} {} {}", "tel: {}/{}-{}").format(d[:3], d[3:6], d[6:]).removeprefix("tel: ")


#: Numbers that are no personal data, put where a span was.
_PLAIN = ("2024-01-05", "12:30:45", "v1.2.3", "1,234,567.89", "no. 48213377", "3/4", "1999", "0x7f3a", "pp. 112-118", "10.5", "7fa94c21b0d3", "ISO 9001:2015", "20231231T2359")


def labelled_windows(text: str, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of a text: each region as it is, and for each span one with the span rewritten and one with a plain number in its place."""
    r = np.random.default_rng([SEED, seed & 0x7FFFFFFF])
    spans = base_spans(text)
    taken = np.zeros(len(text), bool)
    own = []
    for kind, a, b in spans:  # of overlapping kinds the first listed one is learned
        if not taken[a:b].any():
            taken[a:b] = True
            own.append((kind, a, b))
    out = []
    for a, b in regions(text):
        for at in range(a, b, WINDOW):
            end = min(at + WINDOW, len(text))
            inside = [(k, s - at, e - at) for k, s, e in own if at <= s and e <= end]
            if all(e <= at or s >= end or (at <= s and e <= end) for _, s, e in own):
                out.append((text[at:end], inside))
    for kind, a, b in own:
        for fake in (rewritten(text[a:b], kind, r), _PLAIN[int(r.integers(len(_PLAIN)))]):
            lead = text[max(0, a - int(r.integers(5, 40))):a]
            if len(lead) + len(fake) > WINDOW or taken[a - len(lead):a].any() or taken[b:b + WINDOW].any():
                continue
            window = (lead + fake + text[b:b + WINDOW])[:WINDOW]
            out.append((window, [] if fake in _PLAIN else [(kind, len(lead), len(lead) + len(fake))]))
    return out


def train(docs: DataFrame, max_documents: int | None = None, max_windows: int | None = None) -> Network | None:
    """A network learned from the windows of at most ``max_documents`` documents with a sign of personal data, chosen by a hash of the id.

    Labelled spans are what the fixed patterns find there, and rewritings of these.  Rows with a NULL id or text teach nothing;
    without any span there is no network.
    """
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS if max_documents is None else max_documents)

    def cut(batch):
        out = [(d, t, [f"{k}:{a}:{b}" for k, a, b in s]) for d, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)
               for t, s in labelled_windows(text, d)]
        doc, text, spans = zip(*out, strict=True) if out else ((), (), ())
        return {"doc_id": list(doc), "window": list(text), "spans": list(spans)}

    windows = map_texts(rows.join(F.broadcast(ids), "doc_id"), ["doc_id", "text"], cut, "doc_id long, window string, spans array<string>")  # as many ids as asked for
    # Windows with a span and such without, each to half of the bound.
    half = (MAX_WINDOWS if max_windows is None else max_windows) // 2
    order = [F.xxhash64("window", "doc_id"), F.col("doc_id"), F.col("window"), F.col("spans")]
    got = []
    for some in (F.size("spans") > 0, F.size("spans") == 0):
        got += windows.where(some).orderBy(*order).limit(half).select("window", "spans").collect()
    return learn([(r.window, [tuple(map(int, s.split(":"))) for s in r.spans]) for r in got])


# ---------------------------------------------------------------- decoding


def joined_emissions(net: Network, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions of whole regions: overlapping windows are averaged, the middle of a window weighing most."""
    place, cut = [], []
    for k, row in enumerate(rows):
        for at in range(0, max(1, len(row) - STRIDE), STRIDE):
            place.append((k, at))
            piece = np.zeros(WINDOW, np.int16)
            own = row[at:at + WINDOW]
            piece[:len(own)] = own
            cut.append(piece)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    total, share = [np.zeros((len(r), TAGS), np.float32) for r in rows], [np.zeros((len(r), 1), np.float32) for r in rows]
    for since in range(0, len(cut), WINDOWS_AT_ONCE):
        got = net.emissions(np.array(cut[since:since + WINDOWS_AT_ONCE]))
        for (k, at), e in zip(place[since:since + WINDOWS_AT_ONCE], got, strict=True):
            n = min(WINDOW, len(rows[k]) - at)
            total[k][at:at + n] += e[:n] * weight[:n]
            share[k][at:at + n] += weight[:n]
    return [t / s for t, s in zip(total, share, strict=True)]


def decode(net: Network, emissions: list[np.ndarray]) -> list[np.ndarray]:
    """The best path of tags through each whole region, regions of like length together."""
    tr, st = net.path_weights()
    out: list = [None] * len(emissions)
    order, at = sorted(range(len(emissions)), key=lambda k: len(emissions[k])), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(emissions[order[to]]) * (to + 1 - at) <= POSITIONS_AT_ONCE:
            to += 1
        some = order[at:to]
        longest = len(emissions[some[-1]])
        e, length = np.zeros((longest, len(some), TAGS), np.float32), np.array([len(emissions[k]) for k in some])
        for j, k in enumerate(some):
            e[:len(emissions[k]), j] = emissions[k]
        score, came = st + e[0], np.zeros((longest, len(some), TAGS), np.int8)
        for t in range(1, longest):
            step, live = score[:, :, None] + tr, (t < length)[:, None]
            came[t] = np.where(live, step.argmax(1), np.arange(TAGS))  # behind its end a region's score stands
            score = np.where(live, step.max(1) + e[t], score)
        tag = score.argmax(1)
        path = np.empty((longest, len(some)), np.int8)
        for t in range(longest - 1, -1, -1):
            path[t] = tag
            tag = came[t][np.arange(len(some)), tag]
        for j, k in enumerate(some):
            out[k] = path[:len(emissions[k]), j]
        at = to
    return out


_AT = re.compile(r"@|\bat\b", re.IGNORECASE)
_DOT = re.compile(r"\.|\b(?:dot|punkt|punto|point)\b", re.IGNORECASE)


def fits(kind: int, text: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    if "\n" in text or len(text) > WINDOW:
        return False
    if KINDS[kind] == "email":
        at = _AT.search(text)
        return bool(at and at.start() > 0 and (dot := list(_DOT.finditer(text, at.end() + 1))) and any(c.isalnum() for c in text[dot[-1].end():]) and len(text.split()) <= 12)
    d = digits_of(text)
    if KINDS[kind] == "ip":
        return is_address(re.findall("[0-9]+", text))
    if KINDS[kind] == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and not any(c.isalpha() for c in text)


def model_spans(net: Network | None, texts_: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the network finds in each text."""
    out: list[list] = [[] for _ in texts_]
    if net is None:
        return out
    where = [(k, a, b) for k, t in enumerate(texts_) for a, b in regions(t)]
    if not where:
        return out
    for (k, a, _), path in zip(where, decode(net, joined_emissions(net, [classes(texts_[k][a:b]) for k, a, b in where])), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])) != 0)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if path[s] % 2:  # a begin; its inside follows
                kind, stop = (int(path[s]) - 1) // 2, s + 1
                while stop < len(path) and path[stop] == path[s] + 1:
                    stop += 1
                own = texts_[k][a + s:a + stop]
                start, stop = a + s + len(own) - len(own.lstrip()), a + stop - (len(own) - len(own.rstrip()))
                if start < stop and fits(kind, texts_[k][start:stop]):
                    out[k].append((kind, start, stop))
    return out


def all_spans(net: Network | None, texts_: list[str]) -> list[tuple[list, list]]:
    """(base spans, base spans and those of the network that overlap none of them) of each text, in listing order."""
    out = []
    for text, found in zip(texts_, model_spans(net, texts_), strict=True):
        base = base_spans(text)
        more = [x for x in found if all(x[2] <= a or x[1] >= b for _, a, b in base)] if found else []
        out.append((base, sorted([*base, *more])))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with ``[KIND]`` in place of every span; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, net: Network | None, with_text: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans and, if asked for, ``masked``.

    The first four count the spans of the fixed patterns, ``n_found`` what the network adds; ``base_sha256`` is the digest of
    the fixed ones.  A span of the network counts if it can be of its kind and overlaps no fixed one.  Every row gives a row: a NULL text
    is empty, a NULL id stays NULL, repeated rows repeat; other columns are ignored.  Without a network the fixed spans stand alone.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_found long, base_sha256 string, spans string" + ", masked string" * with_text

    def run(batch):
        rows = texts(batch)
        found = all_spans(net, rows)
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
        return {
            "doc_id": batch.column("doc_id"), **dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts, strict=True)),
            "n_found": pa.array([len(every) - len(base) for base, every in found], pa.int64()),
            "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found],
            "spans": [listed(every) for _, every in found],
            "masked": [masked(t, every) for t, (_, every) in zip(rows, found, strict=True)] if with_text else None,
        }

    return map_texts(docs, ["doc_id", "text"], run, schema)
