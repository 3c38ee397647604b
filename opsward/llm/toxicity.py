"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause. The insult transducer is a weighted acceptor of words and
word beginnings learnt from labelled texts; the threat transducer fires when a violent verb is followed by a
target; the target transducer raises what stands near an addressed person; the negation transducer lowers what
follows a negation closely; the reported-speech transducer lowers what follows a verb of saying or stands in
quotation marks. ``compose`` builds their product once: a table of next states and one of emission weights,
which every clause runs through. Matched clauses are scored, not words: a clause's weight is the sum of what its
run emits, and a text's score is a logistic function of its clauses' weights.

What is learnt (words and beginnings with their log-odds, the scales of the contextual transducers, the logistic
weights) comes from a bounded sample of labelled texts: ``FIT_TOXIC`` and ``FIT_CLEAN`` of each label, the first by a
hash of the id, from the folds that may be learnt from. The seed words below only name grammatical roles.

Defined cases: null and empty texts have no clause and get the score of no match; labels that are null are not
learnt from, ids labelled twice count with the higher label; without labels nothing matches; one row per input
row, repeated and null ids included; whole texts are read, a very long one as a slice of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, in_fold, lean, read, text_slices

FIT_TOXIC, FIT_CLEAN = 1500, 3000
FIT_CHARS = 20_000
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 3
COPIED = 0.2
CACHE_WORDS = 300_000
THRESHOLD = 0.3
RESULT = "doc_id long, score double, predicted int, clauses int"

# Words of grammatical roles, in the languages served.
TARGET = "you your yours u he she they them him her du dich dir ihr euch dein deine tu toi te vous votre ton ta tú usted ustedes vosotros ellos".split()
NEGATION = "not no never nor isn't aren't don't ain't nicht kein keine nie niemals ne pas jamais aucun nunca ningún ninguna tampoco".split()
REPORT = "said says saying wrote claimed quoted called sagte sagt schrieb nannte dit disait écrit disent dijo dice escribió llamó".split()
THREAT = "kill hurt destroy murder shoot stab beat töten verletzen umbringen tuer frapper détruire matar golpear destruir".split()
O, INSULT, MENACE, ADDRESS, NOT, SAY, QUOTE = range(7)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’]+")
BREAK = b".!?;:"


class Transducer:
    """states x symbols -> next state and a factor on what is emitted there; state 0 is the start."""

    def __init__(self, nxt: list[list[int]], factor: list[list[float]]):
        self.next, self.factor = np.array(nxt), np.array(factor, float)


def compose(*parts: Transducer) -> Transducer:
    """The product: states are tuples, factors multiply."""
    start = tuple(0 for _ in parts)
    index, todo, nxt, factor = {start: 0}, [start], [], []
    symbols = parts[0].next.shape[1]
    while todo:
        state = todo.pop(0)
        row_n, row_f = [], []
        for s in range(symbols):
            to = tuple(int(p.next[q, s]) for p, q in zip(parts, state))
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row_n.append(index[to])
            row_f.append(math.prod(float(p.factor[q, s]) for p, q in zip(parts, state)))
        nxt.append(row_n)
        factor.append(row_f)
    return Transducer(nxt, factor)


def _row(default, **changes):
    out = [default] * 7
    for name, v in changes.items():
        out[globals()[name]] = v
    return out


def grammar(target: float, negated: float, reported: float) -> Transducer:
    """The composed grammar for given scales."""
    insult = Transducer([_row(0)], [_row(0.0, INSULT=1.0, MENACE=1.0, ADDRESS=1.0)])
    # a menace word is armed for four words and paid out when a target follows; alone it emits nothing
    arm = [_row(max(0, i - 1), MENACE=4) for i in range(5)]
    for i in range(1, 5):
        arm[i][ADDRESS] = 0
    threat = Transducer(arm, [_row(1.0, MENACE=0.0, ADDRESS=float(i > 0)) for i in range(5)])
    near = Transducer([_row(max(0, i - 1), ADDRESS=4) for i in range(5)], [_row(target if i else 1.0, ADDRESS=1.0) for i in range(5)])
    negation = Transducer([_row(max(0, i - 1), NOT=3) for i in range(4)], [_row(negated if i else 1.0) for i in range(4)])
    speech = Transducer([_row(0, SAY=1, QUOTE=1), _row(1, QUOTE=0)], [_row(1.0), _row(reported)])
    return compose(insult, threat, near, negation, speech)


def beginnings(word: str) -> list[str]:
    """A word and its beginnings, marked, as the acceptor's entries."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class Model:
    """Lexicon (entry -> weight), grammar scales and logistic weights."""

    def __init__(self, lexicon: dict[str, float], scales: tuple[float, float, float], beta: np.ndarray):
        self.lexicon, self.scales, self.beta = lexicon, scales, beta


class Matcher:
    """Finds and weighs the matched clauses of whole texts; keeps a bounded cache of word classes."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.roles = dict.fromkeys(TARGET, ADDRESS) | dict.fromkeys(NEGATION, NOT) | dict.fromkeys(REPORT, SAY) | dict.fromkeys(THREAT, MENACE)
        self.reset()

    def reset(self):
        self.words: dict[bytes, int] = {}
        self.kinds: list[tuple[int, float, bool]] = [(O, 0.0, False), (O, 0.0, True)]
        self.kind_at = {k: i for i, k in enumerate(self.kinds)}

    def _classify(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "surrogatepass")
        stop = raw[-1] in BREAK
        kind, weight = O, 0.0
        for w in WORD.findall(text):
            w = w.replace("’", "'")
            hit = max((self.lexicon[e] for e in beginnings(w) if e in self.lexicon), default=0.0)
            if hit > weight:
                kind, weight = INSULT, hit
            elif kind == O and w in self.roles:
                kind = self.roles[w]
                weight = 4.0 if kind == MENACE else 0.0
        if kind == O and raw[:1] in (b'"', b"\xc2", b"\xe2") and text[0] in "\"«“„":
            kind = QUOTE
        key = (kind, weight, stop)
        if key not in self.kind_at:
            self.kind_at[key] = len(self.kinds)
            self.kinds.append(key)
        return self.kind_at[key]

    def clauses(self, texts: list) -> list[list[list[tuple[int, float]]]]:
        """Per text its clauses that hold an insult or menace, as (symbol, weight) runs."""
        if len(self.words) > CACHE_WORDS:
            self.reset()
        row, lens = [], []
        for t in texts:
            w = (t or "").lower().encode("utf-8", "surrogatepass").replace(b"\n", b" . ").split()
            row += w
            lens.append(len(w))
        for w in set(row).difference(self.words):
            self.words[w] = self._classify(w)
        code = np.fromiter(map(self.words.__getitem__, row), np.int64, len(row))
        symbol = np.array([k for k, _, _ in self.kinds])[code]
        weight = np.array([w for _, w, _ in self.kinds])[code]
        stop = np.array([s for _, _, s in self.kinds])[code]
        doc = np.repeat(np.arange(len(texts)), lens)
        out: list[list] = [[] for _ in texts]
        if not len(code):
            return out
        first = np.r_[True, stop[:-1] | (doc[1:] != doc[:-1])]
        clause = np.cumsum(first) - 1
        begin = np.r_[np.flatnonzero(first), len(code)]
        for c in np.unique(clause[(symbol == INSULT) | (symbol == MENACE)]).tolist():
            a, b = int(begin[c]), int(begin[c + 1])
            out[int(doc[a])].append(list(zip(symbol[a:b].tolist(), weight[a:b].tolist())))
        return out


def weigh(clause: list[tuple[int, float]], g: Transducer) -> float:
    """What the grammar emits over one clause."""
    state, total, menace = 0, 0.0, 0.0
    for symbol, weight in clause:
        if symbol == MENACE:
            menace = weight
        total += float(g.factor[state, symbol]) * (menace if symbol == ADDRESS else weight)
        state = int(g.next[state, symbol])
    return total


def _facts(weights: list[float]) -> list[float]:
    got = [w for w in weights if w > 0]
    return [1.0, float(bool(got)), math.log1p(max(got, default=0.0)), math.log1p(sum(got))]


def _logistic(x, beta):
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = _logistic(x, beta)
        grad = x.T @ (weight * (p - y)) + penalty @ beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn_lexicon(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Words and beginnings that toxic texts hold far more often (G-test), weighted by log-odds. A beginning
    is taken only if it is found in more texts than the best word it stands for."""
    with_, without = Counter(), Counter()
    n1 = n0 = 0
    seen: set[int] = set()
    for t, y in zip(texts, labels):
        row = [w.replace("’", "'") for w in WORD.findall(t.lower())]
        runs = {hash((y, *row[i: i + 5])) for i in range(max(1, len(row) - 4))}
        if len(runs & seen) > COPIED * len(runs):
            continue  # a copy of a text would make all of its words stand out
        seen |= runs
        n1, n0 = n1 + y, n0 + 1 - y
        entries = set()
        for w in set(row):
            entries.update(beginnings(w))
        (with_ if y else without).update(entries)
    # entries that chance alone would make stand out grow with the number looked at
    least = 2 * math.log(max(2, sum(a >= LEAST_TEXTS for a in with_.values()))) + 4
    found = {}
    for e, a in with_.items():
        b = without.get(e, 0)
        if a < LEAST_TEXTS or not n1 or not n0 or a * n0 <= 5 * b * n1:
            continue
        expect1, expect0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        g2 = 2 * (a * math.log(a / expect1) + (b * math.log(b / expect0) if b else 0))
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if g2 >= least and odds > 1.5:
            found[e] = min(8.0, odds)
    return found


def train(texts: list[str], labels: list[int], weights: list[float]) -> Model:
    """Fits lexicon, scales and logistic weights; the lexicon of each half of the sample scores the other half, so
    words that a text was learnt from do not flatter it."""
    if not texts or not any(labels) or all(labels):
        return Model({}, (1.0, 1.0, 1.0), np.array([-5.0, 0.0, 0.0, 0.0]))
    y, w = np.array(labels, float), np.array(weights)
    clauses: list = [None] * len(texts)
    for half in (0, 1):
        here = [i for i in range(len(texts)) if i % 2 == half]
        other = [i for i in range(len(texts)) if i % 2 != half]
        m = Matcher(learn_lexicon([texts[i] for i in other], [labels[i] for i in other]))
        for i, c in zip(here, m.clauses([texts[i] for i in here])):
            clauses[i] = c
    best = None
    for scales in [(t, n, r) for t in (1.5, 1.0) for n in (0.3, 0.6, 1.0) for r in (0.5, 0.75, 1.0)]:
        g = grammar(*scales)
        x = np.array([_facts([weigh(c, g) for c in cs]) for cs in clauses])
        beta = _fit_logistic(x, y, w)
        p = np.clip(_logistic(x, beta), 1e-9, 1 - 1e-9)
        loss = float((-w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if best is None or loss < best[0] - 1e-9:
            best = (loss, scales, beta)
    return Model(learn_lexicon(texts, labels), best[1], best[2])


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN) -> Model:
    """Fits on the bounded sample; rows weigh so that the sample stands for all labelled rows."""
    spark = docs.sparkSession
    known = (labels.where(in_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(6)).alias("h")))
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wanted = {1: n_toxic, 0: n_clean}
    most = F.when(F.col("toxic") == 1, at_most(n_toxic, counts.get(1, 0))).otherwise(at_most(n_clean, counts.get(0, 0)))
    ids, taken = [], Counter()
    for r in sorted(known.where(F.col("h") <= most).collect(), key=lambda r: (r.h, r.doc_id)):  # about 1.3 times the sample
        taken[r.toxic] += 1
        if taken[r.toxic] <= wanted[r.toxic]:
            ids.append(r)
    if not ids:
        return train([], [], [])
    chosen = spark.createDataFrame([(r.doc_id, r.toxic, r.h) for r in ids], "id long, toxic int, h long")
    # the content of a row decides: repeated rows are one, of an id with several texts the one first by hash stands; a longer
    # text gives FIT_CHARS characters at a place by hash
    rows = (docs.where("text is not null").select(F.col("doc_id").alias("id"), "text", F.xxhash64("text", F.lit(6)).alias("of"))
            .join(F.broadcast(chosen), "id"))
    start = F.pmod(F.col("of"), F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.withColumn("text", F.col("text").substr(start, F.lit(FIT_CHARS))).groupBy("id", "h", "toxic").agg(F.min_by("text", "of").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.h, r.id))
    got = Counter(r.toxic for r in rows)
    return train([r.text for r in rows], [r.toxic for r in rows], [counts[r.toxic] / got[r.toxic] * len(rows) / sum(counts.values()) for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: score, predicted and the number of matched clauses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, g = Matcher(model.lexicon), grammar(*model.scales)
        for batch in batches:
            for rows, texts in text_slices(batch):
                weights = [[weigh(c, g) for c in cs] for cs in matcher.clauses(texts)]
                p = _logistic(np.array([_facts(w) for w in weights]), model.beta)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32()),
                     pa.array([sum(x > 0 for x in w) for w in weights], pa.int32())], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")
