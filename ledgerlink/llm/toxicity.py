"""Toxicity: bags of subword embeddings, averaged, under a linear softmax.

A word's vector is the mean of the vectors of its character 3- to 5-grams
(with its ends marked), a passage's the mean of its words'; embeddings and
softmax are trained jointly, in numpy. A document is as toxic as its most toxic
passages are on average, in training and in scoring.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.chars import mixed, points, qgrams
from ledgerlink.llm.common import bounded_batches

#: Labelled rows that training reads at most: toxic ones, and others; the first in a hash order of doc_id.
SAMPLE = (1500, 2500)
BITS, DIM, PASSAGE, LEAST_WORDS, LEAST_TEXTS = 17, 8, 4, 4, 4
#: Passages of a text that decide.
TOP = 2
GRAMS = (3, 4, 5)
#: Weight of the toxic class in the loss, and of the embeddings' squares.
TOXIC_WEIGHT, DECAY = 0.45, 1e-5


class Bags:
    """Passages of a list of texts as bags of distinct words, and those as bags of n-grams.

    A passage has PASSAGE words; a text without words has one, empty. Its mean
    counts LEAST_WORDS words at least.
    """

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {}
        number, counts = [], []
        for t in texts:
            w = (t or "").lower().split()
            counts.append(len(w))
            number += [ids.setdefault(x, len(ids)) for x in w]
        self.word, n_words = np.array(number, np.int32), np.array(counts, np.int64)
        self.n_words = len(ids)
        a = points(" " + " ".join(ids) + " ")
        space = a == 32
        word_at = (np.cumsum(space) - 1).astype(np.int32)
        buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n in GRAMS:
            if len(a) < n:
                continue
            size = len(a) - n + 1
            ok = ~space[1 : 1 + size]
            for j in range(2, n - 1):
                ok &= ~space[j : j + size]
            at = np.flatnonzero(ok)
            buckets.append(mixed(qgrams(a, n)[at] + np.uint64(n), BITS).astype(np.int32))
            owners.append(word_at[at + 1])
        self.gram, self.owner = np.concatenate(buckets), np.concatenate(owners)
        self.grams = np.maximum(np.bincount(self.owner, minlength=self.n_words), 1)
        passages = np.maximum(-(-n_words // PASSAGE), 1)
        self.first = np.cumsum(passages) - passages
        self.text = np.repeat(np.arange(len(texts)), passages)
        start = np.cumsum(n_words) - n_words
        of = np.repeat(np.arange(len(texts)), n_words)
        self.passage = (self.first[of] + (np.arange(len(self.word)) - start[of]) // PASSAGE).astype(np.int32)
        self.n_passages = int(passages.sum())
        self.size = np.maximum(np.bincount(self.passage, minlength=self.n_passages), LEAST_WORDS)

    def passage_logits(self, value: np.ndarray, bias: float) -> np.ndarray:
        words = np.bincount(self.owner, value[self.gram], self.n_words) / self.grams
        return np.bincount(self.passage, words[self.word], self.n_passages) / self.size + bias

    def leading(self, logit: np.ndarray):
        """(passages, their texts, how many each text has) of the TOP highest passages of each text."""
        order, stop = np.lexsort((logit, self.text)), np.append(self.first[1:], self.n_passages)
        size = np.minimum(stop - self.first, TOP)
        text = np.repeat(np.arange(len(self.first)), size)
        return order[stop[text] - 1 - (np.arange(len(text)) - (np.cumsum(size) - size)[text])], text, size

    def logits(self, value: np.ndarray, bias: float) -> np.ndarray:
        """The log odds of each text, from the value of each bucket."""
        logit = self.passage_logits(value, bias)
        top, text, size = self.leading(logit)
        return np.bincount(text, logit[top], len(self.first)) / size

    def pulls(self, g: np.ndarray) -> np.ndarray:
        """What each bucket gets of the passages' gradients."""
        words = np.bincount(self.word, (g / self.size)[self.passage], self.n_words) / self.grams
        return np.bincount(self.gram, words[self.owner], 1 << BITS)

    def texts_of(self) -> np.ndarray:
        """How many texts each bucket occurs in."""
        pairs = np.unique(self.word.astype(np.int64) * len(self.first) + self.text[self.passage])
        words = np.bincount(pairs // max(len(self.first), 1), minlength=self.n_words)
        return np.bincount(self.gram, words[self.owner], 1 << BITS)


class Model:
    """value: each bucket's embedding times the difference of the two softmax rows."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), float(bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(Bags(texts).logits(self.value, self.bias), -30, 30)))


def train(texts: list[str | None], labels: list[int], epochs: int = 150, rate: float = 0.1, decay: float = DECAY, seed: int = 5) -> Model:
    """Full-batch Adam on the log loss of the texts, by their most toxic passages.

    The first third of the epochs takes every passage with its text's label, to
    find a start. n-grams that occur less than LEAST_TEXTS times over the texts
    keep the zero vector. Without labels of both kinds every score is low.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -3.0)
    bags = Bags(texts)
    used = np.flatnonzero(bags.texts_of() >= LEAST_TEXTS)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (len(used), DIM))
    w = rng.normal(0, 0.3, (2, DIM))
    b = np.array([0.0, -1.0])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    balance = np.where(y > 0, TOXIC_WEIGHT / y.sum(), (1 - TOXIC_WEIGHT) / (len(y) - y.sum()))
    value = np.zeros(1 << BITS)
    for epoch in range(1, epochs + 1):
        diff = w[1] - w[0]
        value[used] = e @ diff
        logit = bags.passage_logits(value, b[1] - b[0])
        if epoch <= epochs // 3:
            share = balance[bags.text] / np.bincount(bags.text)[bags.text]
            g = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[bags.text])
        else:
            top, text, size = bags.leading(logit)
            whole = np.bincount(text, logit[top], len(y)) / size
            g = np.zeros(bags.n_passages)
            g[top] = (balance * (1 / (1 + np.exp(-np.clip(whole, -30, 30))) - y) / size)[text]
        # The loss changes with a bucket's embedding by its pull times diff, with diff by all pulls times embeddings.
        pull = bags.pulls(g)[used]
        d_diff = pull @ e
        grads = (pull[:, None] * diff + decay * e, np.stack([-d_diff, d_diff]) + decay * w, np.array([-g.sum(), g.sum()]))
        for x, d, s in zip((e, w, b), grads, state):
            s[0] += 0.1 * (d - s[0])
            s[1] += 0.001 * (d * d - s[1])
            x -= rate * (s[0] / (1 - 0.9**epoch)) / (np.sqrt(s[1] / (1 - 0.999**epoch)) + 1e-9)
    value[used] = e @ (w[1] - w[0])
    return Model(value, b[1] - b[0])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from labelled documents that are not held out; see SAMPLE for its bound.

    Null labels and ids, and documents labelled both ways, are left out; of the
    texts of a repeated id the smallest is read.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    known = known.filter("low = high").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("low").alias("toxic"))
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, sample[0]), (0, sample[1]))]
    picked = some[0].union(some[1])
    # Of a repeated id one text: no more texts come to the driver than SAMPLE says.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def _scored(model: Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = model.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts get the score of a passage without words. Repeated rows
    are scored each; an empty table gives no rows, and without labels of both
    kinds every score is low.
    """
    bounded_batches(docs.sparkSession, "4m")
    model = fit(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
