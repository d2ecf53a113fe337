"""Toxicity: weighted transducers over clauses, with an insult lexicon learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept, labelled_sample, map_texts, text_slices, texts

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Candidates for the lexicon that reach the driver at most: the most frequent ones in toxic texts, then the most telling ones.
MAX_CANDIDATES, MAX_STRONG = 50_000, 5_000
THRESHOLD = 0.5

# Fixed vocabulary of the grammar, for the languages of the corpus.
THREAT = "kill murder hurt destroy shoot stab strangle töten umbringen verletzen tuer frapper matar golpear"
TARGET = "you your yours yourself they them their he him she her du dich dir dein ihr euch tu te toi vous ton votre tú usted ustedes ellos"
NEGATION = "not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás"
REPORT = "said says wrote writes called quoted reported sagte schrieb zitiert disait écrivit dijo escribió"

OTHER, END, INSULT, THREATEN, AIM, DENY, TELL = range(7)
#: Output symbols: 8 + kind * 8 + denied * 4 + told * 2 + aimed; kind is 0 for an insult and 1 for a threat.
FIRST_OUT = 8
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
#: Lengths of word beginnings that may become entries.
STEMS = range(3, 10)


class Transducer:
    """step(state, symbol) -> (state, symbol); a symbol it has no rule for passes unchanged."""

    def __init__(self, states: int, rules: dict[tuple[int, int], tuple[int, int]]):
        self.states, self.rules = states, rules

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.rules.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, symbols: int) -> Transducer:
        """Composition: what this one writes, the other reads."""
        rules = {}
        for a in range(self.states):
            for b in range(other.states):
                for x in range(symbols):
                    next_a, y = self.step(a, x)
                    next_b, z = other.step(b, y)
                    rules[a * other.states + b, x] = (next_a * other.states + next_b, z)
        return Transducer(self.states * other.states, rules)


def grammar(reach: int = 4) -> Transducer:
    """Insults and threats of a clause, marked as aimed, told and denied by what came before them in the clause."""
    symbols = range(FIRST_OUT + 16)
    kinds = Transducer(1, {(0, INSULT): (0, FIRST_OUT), (0, THREATEN): (0, FIRST_OUT + 8)})

    def mark(bit: int, trigger: int, lasts: int) -> Transducer:
        """After ``trigger``, the next ``lasts`` words carry ``bit``; 0: until the clause ends."""
        rules = {}
        for state in range(max(lasts, 1) + 1):
            for x in symbols:
                left = state if not lasts else max(state - 1, 0)
                if x == END:
                    left = 0
                elif x == trigger:
                    left = max(lasts, 1)
                rules[state, x] = (left, x | bit if state and x >= FIRST_OUT else x)
        return Transducer(max(lasts, 1) + 1, rules)

    out = kinds
    for part in (mark(1, AIM, 0), mark(2, TELL, 0), mark(4, DENY, reach)):
        out = out.then(part, len(symbols))
    return out


def fixed_words() -> dict[str, int]:
    return {w: kind for kind, words in ((THREATEN, THREAT), (AIM, TARGET), (DENY, NEGATION), (TELL, REPORT)) for w in words.split()}


def entries(word: str) -> list[str]:
    """A word and its beginnings, the latter with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class Words(dict):
    """(symbol, strength) of a word: a learned entry, or else the fixed vocabulary."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.fixed = lexicon, fixed_words()

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max((self.lexicon[e] for e in entries(word) if e in self.lexicon), default=0.0) if len(word) > 2 else 0.0
        if weight:
            got = INSULT, weight
        elif word in ".!?;:\n":
            got = END, 0.0
        else:
            kind = self.fixed.get(word, OTHER)
            got = kind, 3.0 if kind == THREATEN else 0.0
        if len(self) >= 300_000:
            self.clear()
        self[word] = got
        return got


#: Prior weights of the score: bias, then each output symbol's evidence; a fit moves them where labels speak.
PRIOR = np.array([-4.0, *(w + 0.5 * (k & 1) - 0.5 * bool(k & 2) - 0.5 * bool(k & 4) for w in (1.5, 1.5) for k in range(8))])


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)


def clause_features(text: str, words: Words, machine: Transducer) -> np.ndarray:
    """1 and, per output symbol, the logarithm of one plus the strengths of what the grammar matched."""
    out = np.zeros(17)
    out[0] = 1
    coded = list(map(words.__getitem__, _TOKENS.findall(text.lower())))
    strong = [k for k, c in enumerate(coded) if c[1]]
    done = -1
    for at in strong:
        if at < done:
            continue
        first = at
        while first and coded[first - 1][0] != END:
            first -= 1
        state, k = 0, first
        while k < len(coded) and coded[k][0] != END:
            state, symbol = machine.step(state, coded[k][0])
            if symbol >= FIRST_OUT:
                out[1 + symbol - FIRST_OUT] += coded[k][1]
            k += 1
        done = k
    out[1:] = np.log1p(out[1:])
    return out


def _features(batch, words: Words, machine: Transducer) -> np.ndarray:
    return np.array([clause_features(t, words, machine) for t in texts(batch)]).reshape(-1, 17)


def _entry_counts(rows: DataFrame, only: frozenset | None) -> DataFrame:
    """entry, n: texts in which it occurs, added up per task first."""
    def run(batches):
        n: Counter = Counter()
        for batch in text_slices(batches):
            for text in texts(batch):
                seen = {e for w in set(_TOKENS.findall(text.lower())) if len(w) > 2 for e in entries(w)}
                n.update(seen if only is None else seen & only)
            if len(n) > 500_000:
                yield pa.RecordBatch.from_pydict({"entry": list(n), "n": list(n.values())})
                n.clear()
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, least: int = 3, cover: int = 3) -> dict[str, float]:
    """Words and beginnings of words that tell toxic texts, found by greedy covering.

    An entry's worth is the number of toxic texts that fewer than ``cover`` chosen entries hold, times a lower bound of its log
    odds.  An entry whose texts are mostly those of a chosen one adds nothing, so copies of one text add few chance entries.  Rows of ``sample`` are bounded, and so is all that reaches the driver.
    """
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return {}
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    yes = {r.entry: r.n for r in _entry_counts(toxic, None).where(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(MAX_CANDIDATES).collect()}
    no = {r.entry: r.n for r in _entry_counts(clean, frozenset(yes)).collect()}

    def odds(e: str) -> float:
        a, b = yes[e] + 0.5, no.get(e, 0) + 0.5
        return math.log(a / (p + 1)) - math.log(b / (n + 1)) - math.sqrt(1 / a + 1 / b)

    strong = sorted(((odds(e), e) for e in yes), key=lambda x: (-x[0] * yes[x[1]], x[1]))
    strong = [(o, e) for o, e in strong if o > 1.0 and no.get(e, 0) * p < 0.05 * yes[e] * n][:MAX_STRONG]
    number = {e: k for k, (_, e) in enumerate(strong)}

    def run(batches):
        for batch in text_slices(batches):
            found = [sorted({number[e] for w in set(_TOKENS.findall(t.lower())) if len(w) > 2 for e in entries(w) if e in number}) for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({"found": pa.array(found, pa.list_(pa.int32()))})

    holds: list[set[int]] = [set() for _ in strong]
    for doc, r in enumerate(toxic.orderBy("doc_id").select("text").mapInArrow(run, "found array<int>").toLocalIterator()):
        for k in r.found:
            holds[k].add(doc)
    lexicon: dict[str, float] = {}
    need = dict.fromkeys(range(p), cover)
    open_ = set(range(len(strong)))
    while open_ and len(lexicon) < 500:
        worth = {k: sum(need[d] > 0 for d in holds[k]) for k in open_}
        best = max(open_, key=lambda k: (strong[k][0] * worth[k], len(strong[k][1]), strong[k][1]))
        if worth[best] < least:
            break
        lexicon[strong[best][1]] = min(strong[best][0], 6.0)
        for d in holds[best]:
            need[d] -= 1
        open_ = {k for k in open_ if worth[k] >= least and len(holds[k] & holds[best]) < 0.8 * len(holds[k])}
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.1, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``PRIOR``; no rows give the prior."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """A model for ``labels.toxic`` from labelled ids whose crc32 modulo 5 is not 0; texts are the only input."""
    sample = kept(labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, max_rows))
    model, machine = Model(learn_lexicon(sample)), grammar()
    words = Words(model.lexicon)  # fills up in each task

    def run(batch):
        x = _features(batch, words, machine)
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": list(x)}

    got = map_texts(sample, ["doc_id", "text", "label"], run, "doc_id long, label int, x array<double>").orderBy("doc_id").select("label", "x").toPandas()
    if len(got):
        model.weights = fit_weights(np.stack(got["x"].to_numpy()), got["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row per input row.

    A NULL or empty text matches nothing and has the score of the bias alone; a NULL id is not held out.
    """
    machine, words = grammar(), Words(model.lexicon)

    def run(batch):
        x = _features(batch, words, machine)
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": (p >= threshold).astype(int)}

    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return map_texts(docs, ["doc_id", "text", held_out], run, "doc_id long, held_out boolean, score double, predicted int")
