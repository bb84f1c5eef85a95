"""Toxicity: a bag of subword embeddings averaged into a linear softmax.

Every word is the mean of the vectors of its character n-grams, word boundaries included; a window of words is the mean of its distinct
words; a linear softmax over that mean tells toxic from clean. Table and softmax are trained jointly with Adam in numpy on the driver,
from a bounded sample of labelled documents. A word never seen, such as a misspelling, is made of n-grams that were seen. Windows overlap
and cover the whole word sequence. A document is as toxic as its most toxic window, in training too, so that a label is not held
against the clean windows beside a toxic one, and a passage in a very long text still counts. A document of no more words than a window
is one window. Since the softmax is linear in the mean, a word adds a fixed number to the logit; workers keep these numbers per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, labelled_texts, tidied, tidy

_WORD = re.compile(r"[^\W_]+")
DIM, WINDOW, PAD, N_LOW, N_HIGH = 4, 250, 30, 3, 5
#: Words between the starts of two windows: neighbours share the rest, so no edge splits a short cluster.
STRIDE = WINDOW // 2
#: Labelled documents that training may see, whole: clean and toxic ones. A fifth of them only set the calibration.
PER_CLASS = (2000, 900)
#: An n-gram gets a vector if this many of the training documents hold it.
LEAST_DOCS = 2
#: Of training: rounds over all windows, rate, and what every round takes from a vector.
STEPS, RATE, DECAY = 120, 0.2, 4e-3


def words(text: str | None) -> list[str]:
    """The words of a whole text as they follow each other."""
    return _WORD.findall(text.lower()) if text else []


def pieces(word: str) -> list[str]:
    """The character n-grams of a word with its boundaries; a very short word is its own."""
    s = f"<{word}>"
    n = len(s)
    return [s[i : i + k] for k in range(N_LOW, min(N_HIGH, n) + 1) for i in range(n - k + 1)]


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def piece_hash(piece: str) -> int:
    """A number for an n-gram, from its characters."""
    h = np.full(1, len(piece), np.uint64)
    for c in piece:
        h = _step(h, np.uint64(ord(c)))
    return int(h[0])


def piece_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all n-grams of all words, and the word that each is of."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends, owner = np.cumsum(lengths), np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    hashes, owners = [], []
    for k in range(N_LOW, N_HIGH + 1):
        n = len(codes) - k + 1
        if n <= 0:
            break
        whole = np.flatnonzero(np.arange(n) + k <= ends[owner[:n]])
        h = np.full(len(whole), k, np.uint64)
        for i in range(k):
            h = _step(h, codes[whole + i])
        hashes.append(h)
        owners.append(owner[whole])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else none


@dataclass
class Model:
    """gram, add: the known n-grams by number, ascending, and what each adds to the logit of its word; bias, slope and shift: of the window
    softmax and of the calibration."""

    gram: np.ndarray
    add: np.ndarray
    bias: float
    slope: float
    shift: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """What n-grams add; 0 for unknown ones."""
        if not len(self.gram):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.gram, hashes), len(self.gram) - 1)
        return np.where(self.gram[at] == hashes, self.add[at], 0.0)

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds: the mean of its n-grams."""
        h, owner = piece_hashes(words)
        return np.bincount(owner, self.of(h), minlength=len(words)) / np.maximum(1, np.bincount(owner, minlength=len(words)))

    def word(self, w: str) -> float:
        return float(self.of(np.array([piece_hash(g) for g in pieces(w)], np.uint64)).mean())


class _Ids(dict):
    """Numbers words as they come; `new` lists those without a score yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        self.new.append(w)
        return i


class Scorer:
    """Logits of texts, with the scores of up to KEPT words and a block's at hand."""

    KEPT, BLOCK = 250_000, 512

    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, _Ids(), np.zeros(0)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a in range(0, len(texts), self.BLOCK):
            if len(self.ids) > self.KEPT:
                self.ids, self.scores = _Ids(), np.zeros(0)
            number = self.ids.__getitem__
            seqs = [np.array(list(map(number, words(t))), np.int64) for t in texts[a : a + self.BLOCK]]
            if self.ids.new:
                self.scores, self.ids.new = np.concatenate([self.scores, self.model.words(self.ids.new)]), []
            out[a : a + len(seqs)] = [doc_logit(s, self.scores, self.model.bias) for s in seqs]
        return out


def windows(n: int) -> list[tuple[int, int]]:
    """Where the windows of n words begin and end; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    return [(a, a + WINDOW) for a in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]


def doc_logit(ids: np.ndarray, per_word: np.ndarray, bias: float) -> float:
    """The largest window logit of a sequence of word ids, given what each id adds; an empty text has the bias alone."""
    best = -np.inf
    for a, b in windows(len(ids)):
        once = np.unique(ids[a:b])
        best = max(best, float(per_word[once].sum()) / (len(once) + PAD))
    return bias + (best if len(ids) else 0.0)


def train(samples: list[tuple[str, int]], steps: int = STEPS, seed: int = 7) -> Model | None:
    """None without samples of both classes."""
    whole = samples
    if sum(y for _, y in samples) >= 50:
        samples = [x for i, x in enumerate(whole) if i % 5]
    if len({y for _, y in samples}) < 2:
        return None
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    seq, doc_of, held_by = [], [], []
    for d, (text, _) in enumerate(samples):
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words(text)], dtype=np.int64)
        held_by.append(np.unique(ids))
        for a, b in windows(len(ids)):
            seq.append(np.unique(ids[a:b]))
            doc_of.append(d)
    if not seq:
        return None
    sizes = np.array([len(s) for s in seq])
    tok, win_of, inv_len = np.concatenate(seq).astype(np.int32), np.repeat(np.arange(len(seq), dtype=np.int32), sizes), 1.0 / (sizes + PAD)
    del seq
    flat, w_of = piece_hashes(list(vocab))
    keys, flat = np.unique(flat, return_inverse=True)
    by_word = np.argsort(w_of, kind="stable")
    flat, w_of = flat[by_word].astype(np.int32), w_of[by_word]
    n_parts = np.bincount(w_of, minlength=len(vocab))
    inv_parts, n_words = 1.0 / n_parts, len(vocab)
    # the documents that hold each n-gram, one document at a time: all pairs at once would fill the driver
    first, held = np.r_[0, np.cumsum(n_parts)], np.zeros(len(keys), np.int32)
    for ws in held_by:
        n = n_parts[ws]
        held[np.unique(flat[np.repeat(first[ws] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    del held_by, vocab, by_word
    known = held >= LEAST_DOCS
    new_id, keep, used = np.cumsum(known, dtype=np.int32) - 1, known[flat], int(known.sum())
    flat, w_of = new_id[flat[keep]], w_of[keep]
    if not used:
        return None
    # documents with words, by their first windows
    starts = np.flatnonzero(np.r_[True, np.diff(doc_of) > 0])
    per_doc = np.diff(np.r_[starts, len(doc_of)])
    y = np.array([samples[doc_of[i]][1] for i in starts], float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    params = [rng.normal(0, 0.1, (used, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    moment, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, steps + 1):
        E, W, bias = params
        turn = W[:, 1] - W[:, 0]  # of a softmax of two, only the difference counts
        add = np.bincount(w_of, (E @ turn)[flat], minlength=n_words) * inv_parts
        z = np.bincount(win_of, add[tok], minlength=len(sizes)) * inv_len + (bias[1] - bias[0])
        top = np.maximum.reduceat(z, starts)
        shown = z == np.repeat(top, per_doc)
        shown = shown / np.repeat(np.add.reduceat(shown.astype(float), starts), per_doc)
        g_doc = (1 / (1 + np.exp(-top)) - y) * weight
        g_win = np.repeat(g_doc, per_doc) * shown
        g_word = np.bincount(tok, (g_win * inv_len)[win_of], minlength=n_words) * inv_parts
        g_gram = np.bincount(flat, g_word[w_of], minlength=used)
        g_turn = E.T @ g_gram
        for i, grad in enumerate((g_gram[:, None] * turn + DECAY / len(y) * E, np.stack([-g_turn, g_turn], 1), np.array([-1, 1]) * g_doc.sum())):
            moment[i] = 0.9 * moment[i] + 0.1 * grad
            second[i] = 0.98 * second[i] + 0.02 * grad**2
            params[i] = params[i] - RATE * (moment[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.98**t)) + 1e-10)
    E, W, bias = params
    model = Model(keys[known], E @ (W[:, 1] - W[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)
    held = [x for i, x in enumerate(whole) if i % 5 == 0] if len(samples) < len(whole) else whole
    if len({y for _, y in held}) < 2:
        held = whole
    logits = Scorer(model).logits([text for text, _ in held])
    model.slope, model.shift = calibrate(logits, np.array([y for _, y in held], dtype=float))
    return model


def calibrate(logits: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Platt's two numbers by Newton's method, the clean weighing three times as much."""
    scale = max(1e-6, float(np.abs(logits - np.median(logits)).mean()))
    x = np.stack([(logits - logits.mean()) / scale, np.ones_like(logits)], 1)
    w = np.where(y == 1, 0.25 / max(1, y.sum()), 0.75 / max(1, (1 - y).sum())) * len(y)
    th = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ th, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * th
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        th = th - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(th[0] / scale), float(th[1] - th[0] * logits.mean() / scale)


def scorer(model: Model | None):
    """An Arrow-batched function of a text column; without a model every score is 0."""

    @F.pandas_udf("double")
    @tidied
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits = Scorer(model).logits if model else None
        for texts in batches:
            if logits is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * logits(texts.tolist()) + model.shift, -30.0, 30.0))))

    return score


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """Trains on at most `per_class` labelled documents, clean and toxic, among those that `learn` admits."""
    model = train(labelled_texts(docs, labels, "toxic", learn, per_class))
    tidy()
    return model


def learn_rule() -> Column:
    """Training rows: crc32 of the id as text, mod 3, is not 1."""
    return ~held_out("doc_id", 3, 1)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows and null ids included. Texts of any length are scored whole.

    A null or empty text has the score of no words at all; equal texts have equal scores, and an empty table gives an empty result. Labels of unknown ids, null labels and extra columns change nothing;
    without labels of both classes all scores are 0.
    """
    score = scorer(fit(docs, labels, learn_rule()))
    return docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, with the columns they came with."""
    name = fresh(docs, "toxicity")
    score = scorer(fit(docs, labels, learn_rule()))
    return docs.withColumn(name, score("text")).where(F.col(name) < threshold).drop(name)
