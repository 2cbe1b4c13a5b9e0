"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (lower-case words, hashed to `1 << bits` buckets).  The score is
sigmoid(b + sum of w + sum over pairs of <v_i, v_j>): the factors v let pairs of terms weigh more or
less together than apart, which additive weights cannot.  The pair sum costs one pass over the terms,
as half of (squared sum minus sum of squares) per factor.

The fit uses at most about `sample` labelled documents, by hash of their doc_id (a bound of the fit
only): their terms are hashed on the executors, and AdaGrad runs on the driver.  Terms in fewer than
`least` of these documents keep weight 0.  The model has a fixed size and is broadcast.

Defined results: null, empty and wordless texts score sigmoid(b); repeated rows repeat; of several
labels of one document the highest counts, null labels do not; of several texts under one labelled
doc_id the fit takes the one with the smallest hash; without labels every score is 0.5.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import map_texts
from weftgraph.llm._words import PUNCT, Words


class Machine:
    def __init__(self, bits: int, factors: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.b = 0.0
        self.w = np.zeros(1 << bits, np.float32)
        self.v = rng.normal(0, 0.02, (1 << bits, factors)).astype(np.float32)

    def raw(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums, of documents whose terms follow each other."""
        edge = np.concatenate([[0], np.cumsum(sizes)])
        # prefix sums restart from 64-bit accumulators: differences stay exact enough for any length
        def per(x):
            total = np.zeros((len(terms) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, dtype=np.float64, out=total[1:])
            return total[edge[1:]] - total[edge[:-1]]

        v = self.v[terms]
        sums = per(v)
        return self.b + per(self.w[terms]) + 0.5 * ((sums**2).sum(axis=1) - per((v * v).sum(axis=1))), sums

    def score(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, sizes)[0], -30, 30)))


def term_sets(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text, one text after the other, and how many each has."""
    words = Words([(t or "").lower().encode() for t in texts], PUNCT)
    bucket = (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(words.documents() << bits | bucket)
    return both & ((1 << bits) - 1), np.bincount(both >> bits, minlength=len(texts))


def telling(docs: list[np.ndarray], labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each term is, and its log-likelihood ratio (G squared) with the label."""
    n, k = np.zeros(1 << bits), np.zeros(1 << bits)
    for d, label in zip(docs, labels):
        n[d] += 1
        k[d] += label
    every, toxic = len(docs), float(labels.sum())

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.where(expected > 0, expected, 1)), 0)

    if not 0 < toxic < every:
        return n, np.zeros(1 << bits)
    clean = every - toxic
    return n, 2 * (part(k, n * toxic / every) + part(n - k, n * clean / every) + part(toxic - k, (every - n) * toxic / every) + part(clean - n + k, (every - n) * clean / every))


def train(docs: list[np.ndarray], labels: np.ndarray, bits: int, factors: int, epochs: int, rate: float, decay: float, least: int, ratio: float = 0.0) -> Machine:
    """`ratio`: the G squared that a term must reach; 6.6 is reached by one in a hundred terms that tell nothing."""
    m = Machine(bits, factors)
    seen, g = telling(docs, labels, bits)
    known = (seen >= least) & (g >= ratio)
    m.v[~known] = 0
    docs = [d[known[d]] for d in docs]
    if len(docs) and 0 < labels.mean() < 1:
        m.b = float(np.log(labels.mean() / (1 - labels.mean())))
    rng = np.random.default_rng(7)
    gw, gv, gb = np.full(1 << bits, 1e-3, np.float32), np.full(m.v.shape, 1e-3, np.float32), 1e-3
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            sizes = np.array([len(docs[i]) for i in part])
            terms = np.concatenate([docs[i] for i in part])
            z, sums = m.raw(terms, sizes)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            each = np.repeat(error, sizes).astype(np.float32)
            kinds, inverse = np.unique(terms, return_inverse=True)
            dw = np.bincount(inverse, weights=each) + decay * m.w[kinds]
            slope = each[:, None] * (np.repeat(sums, sizes, axis=0) - m.v[terms])
            dv = np.stack([np.bincount(inverse, weights=slope[:, f]) for f in range(slope.shape[1])], axis=1) + decay * m.v[kinds]
            gw[kinds] += dw**2
            gv[kinds] += dv**2
            m.w[kinds] -= rate * dw / np.sqrt(gw[kinds])
            m.v[kinds] -= 0.3 * rate * dv / np.sqrt(gv[kinds])
            gb += error.sum() ** 2
            m.b -= rate * float(error.sum()) / np.sqrt(gb)
    return m


def fit(df: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 18, factors: int = 6, sample: int = 12_000, epochs: int = 20, rate: float = 0.1, decay: float = 0.01, least: int = 3, ratio: float = 6.6) -> Machine:
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null")
    marked = marked.where(where) if where is not None else marked
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    # about `sample` rows of two numbers: the broadcast is bounded
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(marked), "doc_id")
    # one text of each labelled doc_id, so that rows that repeat it don't add to what the driver gets
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.struct("doc_id", F.col("label").cast("int").alias("label")).alias("key"), "text")

    def step(ids, part):
        terms, sizes = term_sets(part.to_pylist(), bits)
        return [ids, np.split(terms.astype(np.int32), np.cumsum(sizes)[:-1])]

    rows = map_texts(texts, "key", "text", step, "key struct<doc_id:long,label:int>, terms array<int>").select("key.doc_id", "key.label", "terms").orderBy("doc_id").toArrow()
    docs = [np.array(t, dtype=np.int64) for t in rows.column(2).to_pylist()]
    return train(docs, np.array(rows.column(1).to_pylist(), dtype=np.float64), bits, factors, epochs, rate, decay, least, ratio)


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def step(ids, texts):
        return [ids, sent.value.score(*term_sets(texts.to_pylist(), machine_bits)).tolist()]

    machine_bits = machine.bits
    return map_texts(df, id_col, text_col, step, "doc_id long, score double")
