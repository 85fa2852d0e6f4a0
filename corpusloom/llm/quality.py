"""Quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives are training rows labelled 1; unlabelled web text is a sample of training documents without a
label. With g the model, l the logistic loss and p the class prior (share of positives), the risk

    p * E_positive[l(g)] + max(0, E_unlabelled[l(-g)] - p * E_positive[l(-g)])

is minimised; where the second term falls below zero its gradient is turned around, so that the model does not
learn the unlabelled rows by heart (Kiryo et al., 2017). The prior is estimated from positives and unlabelled rows alone, as no trusted
negatives are assumed: a first model is fitted on half of the sample, and on the other half the least ratio of unlabelled to positive
rows above a score is taken, with a bound for its sampling error deciding which (best bin estimation, Garg et al., 2021).

The model is additive: each numeric feature of the text is cut into bins at quantiles of the training sample, with one
weight per bin. Features see the text alone; labels, lang, source and doc_id are never inputs of a score.

Bound of the sample: at most about `max_rows` positives and as many unlabelled rows, chosen by a hash of doc_id. Only
their features (a few numbers each) reach the driver. Counts that set the sampling rates cover all rows, and scoring covers all.

Defined results: null text counts as empty; an empty text has all features zero and gets the score that the model
gives to these; a very long text is scored whole; a score of exactly the threshold is kept; with no positives or no unlabelled rows every score is the prior (0.5 without labels); repeated rows
are scored alike; rows with null doc_id are never learnt from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import slices, table

MAX_ROWS = 20_000
BINS = 16
NAMES = ("words", "word_length", "upper", "digits", "marks", "odd_marks", "adjacent_repeats", "distinct", "top_word", "line_words", "repeated_lines", "loud_words", "lone_marks", "stops")

LOWER, UPPER, DIGIT, SPACE, MARK, ODD_MARK = range(6)


def _class_of(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isnumeric():
        return DIGIT
    return MARK if c in ".,;:'\"()?-_" else ODD_MARK


#: The class of each letter up to U+024F; all beyond counts as a lower-case letter.
_CLASSES = np.array([*map(_class_of, map(chr, range(0x250))), LOWER], dtype=np.int64)


def features(text: str) -> list[float]:
    """Numbers that say how a text is made; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_CLASSES[np.minimum(points, 0x250)], minlength=6).tolist()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(text.count(mark + space) for mark in ".!?" for space in " \n")
    return [
        np.log1p(n),
        sum(map(len, words)) / n,
        kinds[UPPER] / max(1, kinds[LOWER] + kinds[UPPER]),
        kinds[DIGIT] / len(text),
        (kinds[MARK] + kinds[ODD_MARK]) / n,
        kinds[ODD_MARK] / n,
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        np.log1p(n / max(1, len(lines))),
        1.0 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if w.isupper()) / n,
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
        ends / n,
    ]


@dataclass
class Model:
    prior: float = 0.5
    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Column numbers of the weights that each row uses, one per feature."""
        return np.stack([np.searchsorted(e, x[:, i], side="right") + i * (BINS + 1) for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.binned(x)].sum(axis=1) + self.bias, -30, 30)))


def bin_prior(positive: np.ndarray, unlabelled: np.ndarray, size: int) -> float:
    """Least ratio of unlabelled to positive mass over bins with a twentieth of the positives: an estimate from above."""
    p = np.bincount(positive.ravel(), minlength=size) / max(1, len(positive))
    u = np.bincount(unlabelled.ravel(), minlength=size) / max(1, len(unlabelled))
    full = p >= 0.05
    return float(np.clip((u[full] / p[full]).min(initial=1.0), 0.05, 0.99))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the scores of both: where the ratio of those above a score is surely smallest."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    doubt = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / len(unlabelled))
    at = np.argmin(u / p + 1.01 / p * doubt)
    return float(np.clip(u[at] / p[at], 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """By cross-fitting: each half is scored by the model of the other one. With fewer than 20 rows of either kind nothing can be told: 0.5."""
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    found = []
    for a in (0, 1):
        model = fit_nnpu(positive[a::2], unlabelled[a::2], None, steps=300)
        found.append(best_bin(model.score(positive[1 - a :: 2]), model.score(unlabelled[1 - a :: 2])))
    return float(np.mean(found))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1500, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimise the non-negative risk by Adam over the additive model; the result depends on the rows alone, not on their order."""
    both = np.concatenate((positive, unlabelled))
    edges = [np.unique(np.quantile(both[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(both.shape[1])]
    model = Model(0.5, edges)
    xp, xu, size = model.binned(positive), model.binned(unlabelled), both.shape[1] * (BINS + 1)
    model.prior = bin_prior(xp, xu, size) if prior is None else prior
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(w[x].sum(axis=1) + b, -30, 30))) for x in (xp, xu))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + model.prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        # d/dg of l(g) is s - 1, of l(-g) it is s
        if negative >= 0:
            gp, gu = model.prior * (sp - 1) - model.prior * sp, su
        else:
            gp, gu = model.prior * sp, -su
        gp, gu = gp / len(sp), gu / len(su)
        grad = np.bincount(xp.ravel(), np.repeat(gp, xp.shape[1]), size) + np.bincount(xu.ravel(), np.repeat(gu, xu.shape[1]), size) + decay * w
        grad = np.append(grad, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in slices(batch):
            yield part, np.array([features(t or "") for t in part.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit on training rows: those whose crc32(doc_id as text) modulo 4 is not 2."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~_held_out())
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & ~_held_out())
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = ids.hint("merge").join(told.withColumn("told", F.lit(True)), "doc_id", "left")
    roles = table(joined.select("doc_id", F.when(F.col("told").isNull(), 0).when(F.col("quality") == 1, 1).otherwise(2).alias("role")), "quality-roles")
    counts = {r["role"]: r["n"] for r in roles.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    positives, unlabelled = counts.get(1, 0), counts.get(0, 0)
    if not positives or not unlabelled:
        return Model(0.5 if prior is None else prior)
    scale = 1 << 30
    rate = {1: min(scale, scale * max_rows // positives), 0: min(scale, scale * max_rows // unlabelled)}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(scale))
    chosen = roles.filter((F.col("role") < 2) & (draw < F.when(F.col("role") == 1, rate[1]).otherwise(rate[0]))).select("doc_id", "role").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _features_of(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("role"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "role", "x"])

    # about 2 * max_rows rows of two numbers: the sample's bound is that of the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    drawn = texts.mapInArrow(run, "doc_id long, role int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("role", "x")).alias("one"))
    rows = drawn.select("doc_id", "one.role", "one.x").toArrow().sort_by([("doc_id", "ascending")])  # one row of a repeated id
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    role = rows.column("role").to_numpy()
    if not (role == 1).any() or not (role == 0).any():
        return Model(0.5 if prior is None else prior)
    return fit_nnpu(x[role == 1], x[role == 0], estimate_prior(x[role == 1], x[role == 0]) if prior is None else prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _features_of(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, prior: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, prior, max_rows), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, prior: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns as they are."""
    model = fit(docs, labels, prior, max_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            for part in slices(batch.rename_columns(names), f"c{at}"):
                x = np.array([features(t or "") for t in part.column(at).to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
                yield part.filter(pa.array(model.score(x) >= threshold))

    short = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return short.mapInArrow(run, short.schema).toDF(*docs.columns)
