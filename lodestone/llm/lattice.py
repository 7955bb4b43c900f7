"""Language-model scores over the subword lattice.

A word's segmentations into pieces of an existing vocabulary form a lattice; under a unigram model of pieces the
word's probability is the sum over all of them, by a forward recursion in log space. A document's is the product over
its words and the end. Piece weights start from the vocabulary's own scores (log-probabilities if they sum to one;
ranks, as in a merge vocabulary, are taken as Zipf's law) and are re-estimated by expected counts over the lattices of
the training words. A character without a piece is spelt by the vocabulary's byte pieces.

Words are scored once each. The most frequent ``MOST_SHARED`` words' counts and scores go to every task; the other
words of a document are looked up by a join, so the dictionary may have any size.

Defined results: a null or empty text is the end token alone; words are split at ASCII white space and lower-cased
(A-Z); a null id is in the fold of the empty text; repeated rows are scored each and learnt from each; without
training rows N and V are 0 and the pieces keep their first weights; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces as cut
from .common import stored, utf8
from .pieces import BYTE, MARK, NORMAL, wire

MOST_SHARED = 200_000
ROUNDS = 1
SMOOTH = 0.5
END = ""


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces usable inside one marked word (byte pieces as ``<0x..>``) and their first log-probabilities."""
    names, scores = [], []
    for field, value in wire(open(path, "rb").read()):
        if field == 1:
            piece = dict(wire(value))
            name, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == BYTE or kind == NORMAL and MARK not in name[1:]:
                names.append(name)
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
    score = np.array(scores)
    if not 0.5 < np.exp(np.minimum(score, 1)).sum() < 2:
        rank = np.empty(len(score))
        rank[np.lexsort((np.arange(len(score)), -score))] = np.arange(len(score))
        score = -np.log(rank + 10.0)
    return names, score - np.logaddexp.reduce(score)


def _hash(codes: np.ndarray) -> np.ndarray:
    x = np.zeros(codes.shape[:-1], np.uint64)
    for i in range(codes.shape[-1]):
        x = _roll(x, codes[..., i])
    return x


def _roll(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    x = (x + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Lattice:
    """Forward and backward recursions over batches of words of one length."""

    def __init__(self, names: list[str], log_p: np.ndarray, bits: int = 20):
        self.names, self.log_p = names, log_p
        self.longest = max((len(n) for n in names if not n.startswith("<0x")), default=1)
        self.bytes = np.full(256, -1, np.int64)
        keys, number = [], []
        for i, name in enumerate(names):
            if name.startswith("<0x") and len(name) == 6:
                self.bytes[int(name[3:5], 16)] = i
            else:
                keys.append(int(_hash(np.array([ord(c) for c in name]))))
                number.append(i)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.number = np.array(keys, np.uint64)[order], np.array(number, np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << bits, bool)
        self.shift = np.uint64(64 - bits)
        self.maybe[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        out = np.full(hashes.shape, -1, np.int64)
        at = np.nonzero(self.maybe[hashes >> self.shift])
        if len(at[0]):
            wanted = hashes[at]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == wanted, self.number[place], -1)
        return out

    def spelt(self, code: int) -> list[int]:
        return [int(self.bytes[b]) for b in chr(code).encode("utf-8", "replace")]

    def edges(self, codes: np.ndarray):
        """For each (begin, end): piece numbers (words,), and which single characters are spelt by bytes."""
        n = codes.shape[1]
        found = {}
        for begin in range(n):
            x = np.zeros(len(codes), np.uint64)
            for end in range(begin + 1, min(n, begin + self.longest) + 1):
                x = _roll(x, codes[:, end - 1])
                piece = self.find(x)
                if (piece >= 0).any() or end == begin + 1:
                    found[begin, end] = piece
        return found

    def weights(self, codes: np.ndarray, found: dict) -> dict:
        out = {}
        for (begin, end), piece in found.items():
            w = np.where(piece >= 0, self.log_p[piece], -np.inf)
            if end == begin + 1:
                for i in np.flatnonzero(piece < 0):
                    w[i] = self.log_p[self.spelt(int(codes[i, begin]))].sum()
            out[begin, end] = w
        return out

    def forward(self, codes: np.ndarray, weight: dict) -> np.ndarray:
        """alpha[:, k]: log-probability of all ways to write the first k characters."""
        n = codes.shape[1]
        alpha = np.full((len(codes), n + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, n + 1):
            terms = [alpha[:, b] + weight[b, end] for b in range(max(0, end - self.longest), end) if (b, end) in weight]
            alpha[:, end] = np.logaddexp.reduce(terms) if len(terms) > 1 else terms[0]
        return alpha

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word (with its mark)."""
        out = np.zeros(len(words))
        for index, codes in self.batches(words):
            out[index] = self.forward(codes, self.weights(codes, self.edges(codes)))[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words' lattices, each word counted ``counts`` times."""
        total = np.zeros(len(self.names))
        for index, codes in self.batches(words):
            n, many = codes.shape[1], counts[index].astype(float)
            found = self.edges(codes)
            weight = self.weights(codes, found)
            alpha = self.forward(codes, weight)
            beta = np.full((len(codes), n + 1), -np.inf)
            beta[:, n] = 0
            for begin in range(n - 1, -1, -1):
                terms = [weight[begin, e] + beta[:, e] for e in range(begin + 1, min(n, begin + self.longest) + 1) if (begin, e) in weight]
                beta[:, begin] = np.logaddexp.reduce(terms) if len(terms) > 1 else terms[0]
            for (begin, end), piece in found.items():
                use = many * np.exp(alpha[:, begin] + weight[begin, end] + beta[:, end] - alpha[:, n])
                known = piece >= 0
                total += np.bincount(piece[known], use[known], len(total))
                if end == begin + 1:
                    for i in np.flatnonzero(~known):
                        np.add.at(total, self.spelt(int(codes[i, begin])), use[i])
        return total

    @staticmethod
    def batches(words: list[str], most_codes: int = 400_000):
        """(row numbers, code points with the mark in front) of words of one length at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            if not len(group):
                continue
            n = int(lengths[group[0]])
            step = max(1, most_codes // (n + 1))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                codes = np.empty((len(part), n + 1), np.uint32)
                codes[:, 0] = ord(MARK)
                codes[:, 1:] = np.frombuffer("".join([words[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)
                yield part, codes


@dataclass(frozen=True)
class PieceWeights:
    """Natural log-probabilities of the pieces and of the end; they sum to one."""

    log_p: np.ndarray
    log_end: float


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame, training: Column, text_column: str) -> DataFrame:
    """word, c (uses in training texts), n (uses in all texts)."""

    def run(batches):
        counted, trained = Counter(), Counter()
        for batch in cut(batches):
            for learn, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = _tokens(text)
                counted.update(words)
                if learn:
                    trained.update(words)
            if len(counted) > 500_000:
                yield emit(counted, trained)
                counted, trained = Counter(), Counter()
        if counted:
            yield emit(counted, trained)

    def emit(counted, trained):
        words = list(counted)
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([trained[w] for w in words], pa.int64()), pa.array([counted[w] for w in words], pa.int64())], ["word", "c", "n"])

    parts = docs.select(training.alias("learn"), text_column).mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, n_documents: int, path: str, rounds: int = ROUNDS) -> PieceWeights:
    """Piece weights after ``rounds`` re-estimations over ``words`` (word, c)."""
    names, first = vocabulary(path)
    held = {"log_p": first}

    def run(batches):
        lattice = Lattice(names, held["log_p"])
        total = np.zeros(len(names))
        for batch in cut(batches):
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    uses = np.zeros(len(names))
    for _ in range(rounds):
        uses = np.zeros(len(names))
        found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        for row in found.collect():  # at most one row a piece
            uses[row["piece"]] = row["uses"]
        # the vocabulary's own weights stand in for SMOOTH uses a piece
        mass = uses + SMOOTH * len(names) * np.exp(first)
        held["log_p"] = np.log(mass) - math.log(mass.sum())
    pieces, ends = uses.sum() + SMOOTH * len(names), n_documents + SMOOTH
    return PieceWeights(held["log_p"] + math.log(pieces / (pieces + ends)), math.log(ends / (pieces + ends)))


def score(docs: DataFrame, training: Column, path: str, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, most_shared: int = MOST_SHARED) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score; ``training`` marks the rows to learn from."""
    names, _ = vocabulary(path)
    counted = stored(word_counts(docs, training, text_column), "word-counts")
    n_documents = docs.where(training).count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = total + n_documents, distinct + (n_documents > 0)
    model = fit(counted, n_documents, path, rounds)
    scale = math.log10(total + 0.5 * (distinct + 1))

    def scored(batches):
        lattice = Lattice(names, model.log_p)
        for batch in cut(batches):
            marks = lattice.score(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(marks)], ["word", "c", "n", "mark"])

    words = stored(counted.mapInArrow(scored, "word string, c long, n long, mark double"), "word-scores")
    floor = 1
    if counted.count() > most_shared:
        # the least count that keeps the shared words within the bound; ties at the border are left to the join
        floor = 1 + (words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(most_shared).selectExpr("n", "sum(k) over (order by n desc) as k").where(F.col("k") > most_shared).agg(F.max("n")).first()[0] or 0)
    shared = {r[0].encode(): (math.log10(r[1] + 0.5) - scale, r[2], r[1] > 0) for r in words.where(F.col("n") >= floor).select("word", "c", "mark").toLocalIterator()}
    known = docs.sparkSession.sparkContext.broadcast(shared)  # at most most_shared words
    end_base, end_mark, end_known = math.log10(n_documents + 0.5) - scale, model.log_end / math.log(10), int(n_documents > 0)
    kind = docs.schema[id_column].dataType.simpleString()

    def summed(batches):
        table = known.value
        for batch in cut(batches):
            out = []
            for text in utf8(batch.column(2)):
                words = _tokens(text)
                base, mark, seen, rare = end_base, end_mark, end_known, []
                for w, c in Counter(words).items():
                    entry = table.get(w)
                    if entry is None:
                        rare.append({"word": w.decode(), "tf": c})
                    else:
                        base += c * entry[0]
                        mark += c * entry[1]
                        seen += c * entry[2]
                out.append((len(words) + 1, seen, base, mark, rare))
            columns = list(zip(*out))
            listed = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], listed)],
                ["row_key", id_column, "n_tokens", "n_known", "base", "mark", "rare"],
            )

    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), id_column, text_column)
    parts = stored(keyed.mapInArrow(summed, f"row_key long, `{id_column}` {kind}, n_tokens long, n_known long, base double, mark double, rare array<struct<word:string,tf:bigint>>"), "parts")
    rare = parts.select("row_key", F.explode("rare").alias("r")).select("row_key", "r.word", "r.tf")
    looked = rare.join(words.where(F.col("n") < floor).select("word", "c", "mark"), "word", "left")
    more = looked.groupBy("row_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - scale)).alias("more_base"),
        F.sum(F.col("tf") * F.col("mark")).alias("more_mark"),
    )
    return parts.drop("rare").join(more, "row_key", "left").select(
        id_column, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("mark") + F.coalesce("more_mark", F.lit(0.0))).alias("score"),
    )
