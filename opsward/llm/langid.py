"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams (1 to 4 characters) of lower-case words with a blank on either side. A text's TF is the
share of each n-gram among all of its n-grams, the IDF is that of the fit sample. Weights are trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, so most are exactly 0; a temperature
fitted on a part of the sample that training never saw then calibrates the probabilities.

The fit sample is bounded: ``FIT_PER_LANG`` labelled documents of at most ``FIT_CHARS`` characters per
language, the first by a hash of the id, from the folds that may be learnt from. Only text and lang are read.

Prediction is linear in the words, so each distinct word's contribution to all classes is computed once and
whole texts are sums over their words.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a language are never
learnt from; without any labelled row everything is ``und``; one row per input row, repeated and null ids included;
texts are read whole, a very long one as a slice of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, byte_slices, in_fold, lean, read, split_words

FIT_PER_LANG = 700
FIT_CHARS = 20_000
FIT_LETTERS = 32_000  # the most frequent characters; a key has 15 bits for each
KNOWN_SHARE = 0.5
LEAST_DOCS = 2
NGRAMS = (1, 2, 3, 4)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
EPOCHS = 3
SCALE = 50.0
CACHE_WORDS = 150_000
LETTER = regex.compile(r"\p{L}")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: ASCII that is no letter becomes a blank before words are split.
BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def ngrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i: i + n] for n in NGRAMS for i in range(len(w) - n + 1) if w[i: i + n] != " "]


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(BLANK).split()


def _grams_of(raw: bytes) -> list[str]:
    return [g for w in WORDS.findall(raw.decode("utf-8", "surrogatepass")) for g in ngrams(w)]


def _plain(text: str) -> str:
    """The words of a text as n-grams see them, each with a blank on either side."""
    return "".join([f" {w} " for raw in _words(text) for w in WORDS.findall(raw.decode("utf-8", "surrogatepass"))])


def _keys(padded: str, number: dict[str, int]) -> np.ndarray:
    """The n-grams of padded words as 64-bit keys, 15 bits a character (1: one without a number)."""
    flat = np.array([number.get(c, 1) for c in padded], np.int64)
    word = (np.cumsum(flat == number[" "]) - 1) // 2  # blanks open and close words in turn; both are counted to theirs
    out = []
    for n in NGRAMS:
        m = len(flat) - n + 1
        if m > 0:
            key = flat[:m].copy()
            for i in range(1, n):
                key |= flat[i: m + i] << 15 * i
            out.append(key[word[:m] == word[n - 1:]] if n > 1 else key[flat != number[" "]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _shown(key: int, letters: list[str]) -> str:
    out = ""
    while key:
        out += letters[(key & 0x7FFF) - 2]
        key >>= 15
    return out


class Model:
    """Classes, feature weights (IDF and scale folded in), bias and temperature. Texts in a learnt language have at least
    ``least_known`` of their n-grams among the features: ``KNOWN_SHARE`` of what all but a hundredth of the sample have."""

    def __init__(self, classes: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float, least_known: float = 0.0):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature
        self.least_known = least_known
        self.key = hashlib.sha256(repr((classes, [(g, w.tolist()) for g, w in sorted(weights.items())], bias.tolist(), temperature)).encode()).hexdigest()


def _softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """Fits on (lang, text) rows, given in a fixed order; every fifth row serves calibration only."""
    classes = sorted({lang for lang, _ in rows})
    if not classes:
        return Model([], {}, np.zeros(0), 1.0)
    texts = [_plain(text) for _, text in rows]
    seen = Counter(c for t in texts for c in t)
    letters = sorted({c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FIT_LETTERS]} | {" "})
    number = {c: i + 2 for i, c in enumerate(letters)}
    docs = [np.unique(_keys(t, number), return_counts=True) for t in texts]
    fit = [i for i in range(len(rows)) if i % 5 or len(rows) < 20]
    check = [i for i in range(len(rows)) if i not in set(fit)]
    names, df = np.unique(np.concatenate([docs[i][0] for i in fit]), return_counts=True)
    names, df = names[df >= min(LEAST_DOCS, len(fit))], df[df >= min(LEAST_DOCS, len(fit))]
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    label = np.array([classes.index(lang) for lang, _ in rows])
    k = len(classes)
    sparse = []
    for keys, n in docs:
        at = np.searchsorted(names, keys)
        at[at == len(names)] = 0
        known = names[at] == keys if len(names) else np.zeros(len(keys), bool)
        sparse.append((at[known], SCALE * n[known] / max(1, n.sum()) * idf[at[known]]))
    z, acc = np.zeros((len(names) + 1, k)), np.zeros((len(names) + 1, k))  # the last row is the bias

    def weights(ids):
        zz, nn = z[ids], acc[ids]
        l1 = np.where(ids == len(names), 0.0, L1)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    share = np.bincount(label[fit], minlength=k)
    cost = len(fit) / (k * np.maximum(1, share))  # languages weigh alike
    for epoch in range(epochs):
        for i in np.random.default_rng([7, epoch]).permutation(fit):
            ids, x = sparse[i]
            ids, x = np.r_[ids, len(names)], np.r_[x, 1.0]
            w = weights(ids)
            p = _softmax(x @ w)
            p[label[i]] -= 1
            g = cost[label[i]] * np.outer(x, p)
            sigma = (np.sqrt(acc[ids] + g * g) - np.sqrt(acc[ids])) / ALPHA
            z[ids] += g - sigma * w
            acc[ids] += g * g
    w = weights(np.arange(len(names) + 1))
    bias = w[-1]
    logits = np.array([sparse[i][1] @ w[sparse[i][0]] + bias for i in (check or fit)])
    truth = label[check or fit]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    # smoothed targets, or a sample without errors would send the temperature to 0
    target = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, k - 1))
    target[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    loss = [-(target * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum(1).mean() for t in grid]
    used = np.flatnonzero(np.abs(w[:-1]).sum(1))
    shares = [n[np.isin(keys, names[used])].sum() / max(1, n.sum()) for keys, n in docs if len(keys)]
    least_known = KNOWN_SHARE * float(np.quantile(shares, 0.01)) if shares else 0.0
    return Model(classes, {_shown(int(names[i]), letters): SCALE * idf[i] * w[i] for i in used}, bias, float(grid[int(np.argmin(loss))]), least_known)


def fit_sample(docs: DataFrame, per_lang: int = FIT_PER_LANG, max_chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """The bounded sample as (lang, text), in hash order; a longer text gives ``max_chars`` characters at a place by hash."""
    usable = docs.where(in_fold(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    most = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, at_most(per_lang, n))))
    # the hash of a row is that of its whole content: repeated rows are one, and no order of rows matters
    place = F.xxhash64("doc_id", "text", F.lit(7))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int") + 1
    got = (usable.select("lang", "text", place.alias("h")).where(F.col("h") <= F.element_at(most, F.col("lang")))
           .select("lang", "h", F.col("text").substr(start, F.lit(max_chars)).alias("text")).dropDuplicates(["lang", "h"]).collect())
    out, taken = [], Counter()
    for r in sorted(got, key=lambda r: (r.h, r.lang, r.text)):
        if taken[r.lang] < per_lang:
            taken[r.lang] += 1
            out.append((r.lang, r.text))
    return out


class Scorer:
    """Class scores of whole texts, summed over their words; keeps a bounded cache of words.

    An n-gram is one 64-bit key, 15 bits a character: characters of the model's features are numbered from 2,
    1 stands for any other (no feature holds it), 0 for none."""

    def __init__(self, model: Model):
        self.model = model
        letters = sorted({c for g in model.weights for c in g})
        if len(letters) > 32_000:
            raise ValueError("more characters than a key can hold")
        self.number = {c: i + 2 for i, c in enumerate(letters)}
        self.number.setdefault(" ", len(letters) + 2)
        self.blank = self.number[" "]
        names = list(model.weights)
        keys = np.array([sum(self.number[c] << 15 * i for i, c in enumerate(g)) for g in names], np.int64)
        order = np.argsort(keys)
        k = len(model.classes)
        self.keys = np.r_[keys[order], np.int64(2**62)]
        self.weights = np.array([model.weights[names[i]] for i in order] + [np.zeros(k)]).reshape(-1, k) if k else np.zeros((1, 0))
        self.by_code = np.ones(0x10000, np.int64)
        for c, i in self.number.items():
            if ord(c) < 0x10000:
                self.by_code[ord(c)] = i
        self.reset()

    def reset(self):
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.classes) + 2))

    def _numbers(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.by_code[np.minimum(code, 0xFFFF)]
        for i in np.flatnonzero(code >= 0xFFFF).tolist():
            out[i] = self.number.get(chr(code[i]), 1)
        return out

    def _learn(self, new: list[str]) -> None:
        """Scores of words: the weights of their n-grams, how many they have, and how many of them are features."""
        parts, owner = new, np.arange(len(new))
        odd = [i for i, w in enumerate(new) if not w.isalpha()]  # digits and marks may part a word
        if odd:
            split = {i: WORDS.findall(new[i]) for i in odd}
            parts = [x for i, w in enumerate(new) for x in split.get(i, (w,))]
            owner = np.repeat(owner, [len(split[i]) if i in split else 1 for i in range(len(new))])
        flat = self._numbers("".join([f" {w} " for w in parts]))
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
        segment = np.repeat(np.arange(len(parts)), lens)
        sums = np.zeros((len(new), len(self.model.classes) + 2))
        for n in NGRAMS:
            m = len(flat) - n + 1
            if m <= 0:
                continue
            key = flat[:m].copy()
            for i in range(1, n):
                key |= flat[i: m + i] << 15 * i
            ok = segment[:m] == segment[n - 1:] if n > 1 else flat != self.blank
            who, key = owner[segment[:m][ok]], key[ok]
            found = np.searchsorted(self.keys, key)
            hit = self.keys[found] == key
            for k in range(len(self.model.classes)):
                sums[:, k] += np.bincount(who[hit], self.weights[found[hit], k], len(new))
            sums[:, -2] += np.bincount(who, minlength=len(new))
            sums[:, -1] += np.bincount(who[hit], minlength=len(new))
        self.words.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, sums])

    def probabilities(self, texts: list) -> np.ndarray:
        """(texts, classes), calibrated."""
        return self.facts(texts)[0]

    def facts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities, and the share of each text's n-grams that are features."""
        if len(self.words) > CACHE_WORDS:
            self.reset()
        k = len(self.model.classes)
        lower = pa.array([(t or "").lower().encode("utf-8", "surrogatepass").translate(BLANK) for t in texts], pa.string())
        distinct, codes, lens = split_words(lower)
        known = list(map(self.words.get, distinct))
        new = [i for i, c in enumerate(known) if c is None and distinct[i]]
        if new:
            self._learn([distinct[i] for i in new])
        for i, c in enumerate(known):
            if c is None:
                known[i] = self.words.get(distinct[i], 0)
        codes = np.array(known, np.int64)[codes] if len(codes) else codes
        doc = np.repeat(np.arange(len(texts)), lens)
        sums = np.stack([np.bincount(doc, self.rows[codes, j], len(texts)) for j in range(k + 2)], 1)
        n = np.maximum(1, sums[:, k: k + 1])
        return _softmax((sums[:, :k] / n + self.model.bias) / self.model.temperature), sums[:, k + 1] / n[:, 0]

    def predict(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        """Language, score and share of known n-grams."""
        known = [bool(t) and LETTER.search(t) is not None and bool(self.model.classes) for t in texts]
        if not any(known):
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        p, share = self.facts(texts)
        best = p.argmax(1)
        return ([self.model.classes[b] if k else "und" for b, k in zip(best, known)],
                [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))], share.tolist())


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """The scorer of a model, kept by the worker with its cache of words."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def fit(docs: DataFrame) -> Model:
    return train(fit_sample(docs))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (of its columns those to ``keep``, all by default) with language and score, and for a third name the share of
    known n-grams, appended under ``names``; they take the place of columns of those names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = docs.select(*keep).limit(0).withColumns({n: F.lit(0.0) if i else F.lit("") for i, n in enumerate(names)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for rows in byte_slices(batch):
                lang, *numbers = scorer.predict(rows.column(rows.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in numbers[: len(names) - 1])],
                    names=[*keep, *names])
        scorer.reset()  # the worker lives on, the cache need not

    return docs.mapInArrow(lean(run), schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")), ["doc_id"])
    return got.select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
