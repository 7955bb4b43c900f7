"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's logit is the bias and the weights, none
negative, of the words and word beginnings (so inflected forms share what is learnt) it holds. A beginning that one word
alone has counts for that word only, so that "moron" doesn't speak against "more". Only evidence counts: with 1 - p = (1 + e^EVIDENCE) / (1 + e^logit), p is 0 up to the
logit ``EVIDENCE``, so a document's probability, the noisy-or 1 - prod(1 - p) of its sentences, doesn't depend on the
number of neutral ones. The log-likelihood is maximised over the weights (with a probability for toxic documents
without evidence, which scoring leaves out), so the blame settles on the sentences that set toxic documents apart, and
those can then be located. A weight is drawn to the log odds of its word's documents rather than to 0: a word that
stands in toxic documents only keeps its weight where others explain these documents already.

The model is fitted on at most ``MOST_LABELLED`` labelled documents (chosen by a hash of the id among all rows that
may be learnt from) and ``MOST_WORDS`` words and beginnings (of those more frequent in toxic documents, the ones with the largest
likelihood ratio), both parameters. Scoring
reads every whole text.

Defined results: null and empty texts have no sentence and get the score 0; a null id is in the fold of the empty
text; labels that are null are not learnt from; of several labels of one id the largest counts; without any labelled
row of both classes the model is the bias alone; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, utf8

MOST_LABELLED = 20_000
MOST_WORDS = 2_000
EVIDENCE = 0.0
SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 8)
CACHED = 200_000


def features(word: str) -> list[str]:
    """The word, and its proper beginnings with a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if k < len(word))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    blank: set[str] = field(default_factory=set, compare=False, repr=False)  # words seen that have no weight

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, score) of each sentence, in code points."""
        known, found = self.weights.keys(), []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower())) - self.blank
            hit = set()
            for word in words:
                if mine := known & set(features(word)):
                    hit |= mine
                else:
                    if len(self.blank) >= CACHED:
                        self.blank.clear()
                    self.blank.add(word)
            found.append((m.start(), m.end(), self.bias + sum(map(self.weights.__getitem__, sorted(hit))) if hit else self.bias))
        return found

    def score(self, logits: list[float]) -> float:
        """Noisy-or over the sentences whose logit is above ``EVIDENCE``."""
        none = math.log1p(math.exp(EVIDENCE))
        return max(0.0, -math.expm1(-sum(max(x, 0.0) + math.log1p(math.exp(-abs(x))) - none for x in logits if x > EVIDENCE)))


def bags(text: str) -> list[set[str]]:
    """The words of each sentence."""
    return [set(WORD.findall(s.lower())) for s in SENTENCE.findall(text)]


@dataclass(frozen=True)
class Bags:
    """Labels; sentences of each document; words of each sentence; the words' numbers, one after the other."""

    label: np.ndarray
    sentences: np.ndarray
    sizes: np.ndarray
    words: np.ndarray


def packed(rows: list[tuple[int, list[list[int]]]]) -> Bags:
    """From (label, word numbers of each sentence)."""
    flat = [s for _, bag in rows for s in bag]
    return Bags(np.array([y for y, _ in rows], float), np.array([len(bag) for _, bag in rows], np.int64), np.array([len(s) for s in flat], np.int64), np.array([w for s in flat for w in s], np.int64))


def fit_bags(bags_: Bags, n_words: int, steps: int = 1500, rate: float = 0.1, penalty: float = 1e-4, settled: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean log-likelihood, first with all logits above the bias as evidence.

    Each of the two ends when 50 steps gain less than ``settled`` of the loss, or after ``steps``.
    """
    label, sizes, flat = bags_.label, bags_.sizes, bags_.words
    doc = np.repeat(np.arange(len(label)), bags_.sentences)[sizes > 0]
    sizes = sizes[sizes > 0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = label.mean() if len(label) else 0.0
    theta = np.zeros(n_words + 2)  # weights, bias, logit of a toxic document without evidence
    theta[-2:] = -6.0, -3.0
    if not 0 < share < 1 or not len(doc):
        return theta[:-2], theta[-2]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    both = np.unique(doc[owner] * n_words + flat)  # each word once a document
    n, t = np.bincount(both % n_words, minlength=n_words), np.bincount(both % n_words, label[both // n_words], n_words)
    prior = np.maximum(np.log((t + 0.5) / (n - t + 0.5)) - math.log(share / (1 - share)), 0)
    theta[:-2] = prior
    for floor in (-math.inf, EVIDENCE):
        m, v, before = np.zeros_like(theta), np.zeros_like(theta), math.inf
        for step in range(1, steps + 1):
            logit = np.clip(theta[-2] + np.bincount(owner, theta[flat], len(sizes)), -30, 30)
            base = max(floor, theta[-2])
            above = np.maximum(np.logaddexp(0, logit) - np.logaddexp(0, base), 0)
            none = np.bincount(doc, above, len(label)) + np.logaddexp(0, theta[-1])  # -log of the probability that nothing is toxic
            odds = np.exp(-none) / np.maximum(-np.expm1(-none), 1e-12)
            if step % 50 == 0:
                loss = np.where(label == 1, -np.log(np.maximum(-np.expm1(-none), 1e-12)), none).mean() + penalty * ((theta[:-2] - prior) ** 2).sum() / 2
                if before - loss < settled * loss:
                    break
                before = loss
            outer = np.where(label == 1, -odds, 1.0) / len(label)
            inner = outer[doc] * (logit >= base)
            grad = inner * sigmoid(logit)
            g = np.append(np.bincount(flat, grad[owner], n_words) + penalty * (theta[:-2] - prior), [grad.sum() - (inner.sum() * sigmoid(base) if base > floor else 0), (outer * sigmoid(theta[-1])).sum()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            theta[:-2] = np.maximum(theta[:-2], 0)
            theta[-2] = min(theta[-2], EVIDENCE - 4)  # a neutral sentence stays far from being evidence
    return theta[:-2], float(theta[-2])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_labelled: int = MOST_LABELLED, most_words: int = MOST_WORDS) -> Model:
    marked = labels.where(learnable & F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    total = marked.count()
    if total > most_labelled:
        h = F.xxhash64(id_column)
        marked = marked.where(F.pmod(h, F.lit(1_000_000)) < math.ceil(1_050_000 * most_labelled / total)).orderBy(h, id_column).limit(most_labelled)
    texts = docs.select(id_column, text_column).join(F.broadcast(marked), id_column).select("label", F.col(text_column).alias("text"))  # at most most_labelled ids
    texts = stored(texts, "toxicity-sample")

    def counted(batches):
        for batch in pieces(batches):
            seen, toxic = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = {f for w in set(WORD.findall(text.decode().lower())) for f in features(w)}
                seen.update(words)
                if label:
                    toxic.update(words)
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())], ["word", "n", "n_toxic"])

    n_docs, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    every = stored(texts.mapInArrow(counted, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t")), "toxicity-words")
    words = every.where("n >= 4")
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    share = n_toxic / max(n_docs, 1)
    ratio = cell(t, n * share) + cell(n - t, n * (1 - share)) + cell(n_toxic - t, (n_docs - n) * share) + cell((n_docs - n_toxic) - (n - t), (n_docs - n) * (1 - share))
    chosen = [r[0] for r in words.where(t > n * share).orderBy(F.desc(ratio), "word").limit(most_words).select("word").collect()] if 0 < n_toxic < n_docs else []
    number = {w: i for i, w in enumerate(chosen)}

    def numbered(batches):
        for batch in pieces(batches):
            rows = [(y, [sorted({number[f] for w in s for f in features(w) if f in number}) for s in bags(text.decode())]) for y, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)))]
            found = packed(rows)
            narrow = (found.label.astype("u1"), found.sentences.astype("<u4"), found.sizes.astype("<u4"), found.words.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in narrow], ["label", "sentences", "sizes", "words"])

    # a few packed arrays for each batch of the bounded sample
    parts = texts.mapInArrow(numbered, "label binary, sentences binary, sizes binary, words binary").collect() if chosen else []
    joined = [np.frombuffer(b"".join(bytes(p[i]) for p in parts), kind) for i, kind in enumerate(("u1", "<u4", "<u4", "<u4"))]
    weights, bias = fit_bags(Bags(joined[0].astype(float), *(x.astype(np.int64) for x in joined[1:])), len(chosen))
    learnt = {w: float(x) for w, x in zip(chosen, weights)}
    for beginning, word in _lone(every, [w for w in chosen if w.endswith("-")]):
        learnt[word] = learnt.get(word, 0.0) + learnt.pop(beginning)
    return Model({w: x for w, x in learnt.items() if abs(x) > 1e-3}, bias)


def _lone(every: DataFrame, beginnings: list[str]) -> list[tuple[str, str]]:
    """(beginning, word) of those that a single word has; what is learnt of them is that word's alone."""
    if not beginnings:
        return []
    wanted = F.broadcast(every.sparkSession.createDataFrame([(b,) for b in beginnings], "beginning string"))  # at most most_words
    cuts = F.transform(F.sequence(F.lit(BEGINNINGS.start), F.least(F.length("word") - 1, F.lit(BEGINNINGS.stop - 1))), lambda k: F.concat(F.substring("word", 1, k), F.lit("-")))
    whole = every.where(~F.col("word").endswith("-") & (F.length("word") > BEGINNINGS.start)).select("word", F.explode(cuts).alias("beginning")).join(wanted, "beginning")
    return [tuple(r) for r in whole.groupBy("beginning").agg(F.count("*").alias("n"), F.min("word").alias("word")).where("n = 1").select("beginning", "word").collect()]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", offending: float = 0.5) -> DataFrame:
    """``id_column``, score, and sentences: (begin, end, score) of those whose own probability is ``offending`` or more."""
    kind = docs.schema[id_column].dataType.simpleString()
    limit = math.log(offending / (1 - offending))

    def run(batches):
        for batch in pieces(batches):
            scores, located = [], []
            for text in utf8(batch.column(1)):
                found = model.sentences(text.decode())
                scores.append(model.score([x[2] for x in found]))
                located.append([{"begin": a, "end": b, "score": 1 / (1 + math.exp(-x))} for a, b, x in found if x >= limit])
            place = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(located, place)], [id_column, "score", "sentences"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, sentences array<struct<begin:bigint,end:bigint,score:double>>")


def accepted(docs: DataFrame, model: Model, text_column: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``below``, with all their columns."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array([model.score([x[2] for x in model.sentences(t.decode())]) < below for t in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
