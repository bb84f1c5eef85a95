"""Quality: nearest-neighbour voting in a latent-semantic space.

A document's terms are its byte-class pairs (each letter, any capital, any digit, each mark, spaces, breaks, other bytes) and
counts of repetition (words that repeat one of the two before them, lines that came before). Log counts, scaled to the text's
length and weighted by inverse document frequency, are projected on the leading singular vectors of a bounded labelled sample.
The labelled vectors, bounded by the same parameter, go to every worker; each document's exact cosine with all of them is a
blocked matrix product, and the nearest vote with their similarity.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_texts, tidied

#: Labelled documents of each class that are fitted and vote.
PER_CLASS = 700
RANK, NEIGHBOURS, BLOCK = 48, 15, 2048


def _classes() -> np.ndarray:
    table = np.full(256, 1, np.uint8)  # bytes outside ASCII
    for i, b in enumerate(string.ascii_lowercase.encode()):
        table[b] = 2 + i
    for b in string.ascii_uppercase.encode():
        table[b] = 28
    for b in string.digits.encode():
        table[b] = 29
    for b in range(32):
        table[b] = 30
    table[ord("\n")], table[ord(" ")] = 31, 32
    for i, b in enumerate(string.punctuation.encode()):
        table[b] = 33 + i % 31
    return table


_TABLE = _classes()
PAIRS, EXTRA = 64 * 64, 3


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text before idf; a null or empty text has none."""
    out = np.zeros(PAIRS + EXTRA, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    codes = _TABLE[np.frombuffer(raw, np.uint8)]
    pairs = (codes[:-1].astype(np.int32) << 6) | codes[1:]
    out[:PAIRS] = np.bincount(pairs, minlength=PAIRS)
    words = raw.split()
    n = len(words)
    once = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[:PAIRS] = np.sqrt(out[:PAIRS] / max(1, len(raw)))
    out[PAIRS] = 2 * (once / n) ** 0.5 if n else 0
    out[PAIRS + 1] = 2 * (1 - len(set(words)) / n) if n else 0
    out[PAIRS + 2] = 2 * (1 - len(set(lines)) / len(lines)) ** 0.5 if lines else 0
    return out


@dataclass
class Model:
    weight: np.ndarray  # idf
    centre: np.ndarray
    basis: np.ndarray  # terms x rank
    voters: np.ndarray  # unit rows
    label: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight - self.centre) @ self.basis
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines against every voter, to five digits; the nearest vote by similarity, and with the last of them all that tie with it."""
        sims = np.round(self.project(x) @ self.voters.T, 5)
        k = min(NEIGHBOURS, sims.shape[1])
        last = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        w = np.where(sims >= last, np.exp(12 * (sims - sims.max(1, keepdims=True))), 0.0)
        return (w * self.label).sum(1) / w.sum(1)


def train(samples: list[tuple[str, int]]) -> Model | None:
    """None without samples of both classes."""
    if len({y for _, y in samples}) < 2:
        return None
    x = np.stack([terms(t) for t, _ in samples])
    df = (x > 0).sum(0)
    weight = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.3
    xw = x * weight
    centre = xw.mean(0)
    rank = min(RANK, len(x))
    gram = (xw - centre) @ (xw - centre).T  # samples x samples, the sample is bounded
    val, vec = np.linalg.eigh(gram)
    val, vec = np.maximum(val[::-1][:rank], 1e-9), vec[:, ::-1][:, :rank]
    basis = ((xw - centre).T @ vec / np.sqrt(val)).astype(np.float32)
    model = Model(weight, centre.astype(np.float32), basis, np.zeros((0, rank), np.float32), np.array([y for _, y in samples], np.float32))
    model.voters = model.project(x).astype(np.float32)
    return model


def scorer(model: Model | None):
    @F.pandas_udf("double")
    @tidied
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.ones(len(texts))
            for a in range(0, len(texts) if model else 0, BLOCK):
                block = texts.iloc[a : a + BLOCK]
                out[a : a + len(block)] = model.score(np.stack([terms(t) for t in block]))
            yield pd.Series(np.clip(out, 0.0, 1.0))

    return score


def learn_rule() -> Column:
    """Training rows: crc32 of the id as text, mod 5, is not 0."""
    return ~held_out("doc_id", 5, 0)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows and null ids included.

    A null or empty text is scored as a text without terms; equal texts have equal scores. Without labels of both classes every score
    is 1: nothing is known against a document. An empty table gives an empty result; other columns are ignored.
    """
    score = scorer(train(labelled_texts(docs, labels, "quality", learn_rule(), per_class)))
    return docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
