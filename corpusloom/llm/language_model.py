"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Words are lower-cased (A-Z), each text ends with an end token. A word has a class, hashed from its last two bytes, and a slot, hashed from the whole
word, so unseen words have both. The probability of a word is

    p(class | context) * p(slot | class, context) * p(word | class, slot)

The first two are maximum-entropy models. Their features are hashed: a bias, the word before, the one before that (a skip), and the
endings of both; for the slot each is hashed with the class. A table of 2**bits rows holds the weights of each, one column per class or slot. The
third is the share of the word in its class and slot; all unseen words there count as one event, with the share that words seen once have.

1. Counts. Each task counts its words; they are added up by hash. All training tokens count.
2. Training. Each training document takes part in one of `rounds` gradient updates. In a round, tasks of `TASK_BYTES` of text start at the same
   weights and go through their tokens in small batches (AdaGrad by row); what they change is added up in a tree of sums, a row of weights by
   the tokens that used it. The weights have a fixed size (`2**bits * (classes + slots)` numbers), so they are sent to the driver and all tasks.
3. Scoring. The vocabulary grows with the corpus and is never sent whole: texts are dealt to shards of bounded size, a shard asks for its distinct
   words by range of their hashes, the ranges answer with counts, and the shard's texts are scored in batches of numpy arrays.

What is gathered grows with the input: counts of all words, an update for each TASK_BYTES of training text, and each shard's words. A word
is known by 64 bits of hash.

Defined results: null text counts as empty, so it is the end token alone; a null doc_id counts as an empty number (a training row); repeated
rows count each and score alike; a very long text is scored whole; without training rows both scores are finite; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import partitions, slices, table
from corpusloom.llm.words import text_bytes, word_hashes

#: Training text whose tokens make one update; text of a shard when scoring; text for each range of word hashes.
TASK_BYTES, SHARD_BYTES, RANGE_BYTES = 16_000_000, 4_000_000, 16_000_000
#: Distinct words that a task adds up before it sends them on.
HELD_WORDS = 1_000_000
#: Updates that one node of the tree adds up; rows of weights that travel together.
FAN, BLOCK_ROWS = 64, 1_024
#: Tokens of a small batch.
BATCH = 8_192
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Shape:
    classes: int = 16
    slots: int = 16
    bits: int = 15
    rate: float = 0.2

    @property
    def tables(self) -> tuple[tuple[int, int], ...]:
        """Rows and columns of the weights of classes and of slots."""
        return (1 << self.bits, self.classes), (1 << self.bits, self.slots)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Tokens:
    """Tokens of many texts: hashes, classes, slots, and the first one of each text."""

    hashes: np.ndarray
    endings: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], shape: Shape) -> Tokens:
        words, bounds = [], [0]
        for t in texts:
            words += t.lower().split()  # of bytes: A-Z, and ASCII white space
            words.append(b"")  # no word is empty: this is the end
            bounds.append(len(words))
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2)
        letters = np.frombuffer(b"\0\0" + b"\0\0".join(words), dtype=np.uint8)
        endings = mixed(letters[ends - 1] + letters[ends - 2].astype(np.uint64) * np.uint64(256) + np.uint64(1))
        hashes = word_hashes(words)
        return cls(hashes, endings, (endings % np.uint64(shape.classes)).astype(np.int64), (mixed(hashes) % np.uint64(shape.slots)).astype(np.int64), np.array(bounds, dtype=np.int64))

    def before(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value k tokens before each, or one that stands for the start of the text."""
        out = np.full(len(values), 0x5DEECE66D, dtype=np.uint64)
        out[k:] = values[: len(values) - k]
        for j in range(k):
            at = self.bounds[:-1] + j
            out[at[at < self.bounds[1:]]] = 0x5DEECE66D
        return out

    def features(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights, one line per feature: for the classes, and for the slots of each token's class."""
        words, skipped = self.before(self.hashes, 1), self.before(self.hashes, 2)
        endings = mixed(self.before(self.endings, 1) + mixed(self.before(self.endings, 2)))
        each = [np.full(len(words), 7, dtype=np.uint64), mixed(words + np.uint64(11)), mixed(skipped + np.uint64(23)), mixed(endings + np.uint64(41))]
        down, own = np.uint64(64 - shape.bits), (self.classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x5851F42D4C957F2D)
        kind = np.uint16 if shape.bits <= 16 else np.uint32  # short numbers are sorted faster
        return tuple(np.stack([(x >> down).astype(kind) for x in xs]) for xs in (each, [mixed(x + own) for x in each]))


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities, one line per class or slot, one column per token."""
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    z = z.T.copy()
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return np.maximum(z, np.float32(1e-20), out=z)


def learn(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, right: np.ndarray, rate: np.float32) -> None:
    """One small batch of gradient descent, in place. used: how many tokens had each row."""
    off = softmax(weights, rows)
    off[right, np.arange(len(right))] -= 1
    off = off.T.copy()
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        first = np.concatenate(([0], 1 + np.flatnonzero(ordered[1:] != ordered[:-1])))
        at, gradient = ordered[first], np.add.reduceat(np.take(off, order, axis=0), first, axis=0)
        total = squares[at] + np.einsum("ij,ij->i", gradient, gradient) / np.float32(gradient.shape[1])
        squares[at] = total
        gradient *= (rate / np.sqrt(total))[:, None]
        weights[at] -= gradient
        used[at] += np.diff(np.concatenate((first, [len(right)])))


class Weights:
    """Of both tables: the weights, and for each row its sum of squared gradients."""

    def __init__(self, shape: Shape) -> None:
        self.weights = [np.zeros(size, dtype=np.float32) for size in shape.tables]
        self.squares = [np.full(rows, 0.01, dtype=np.float32) for rows, _ in shape.tables]

    def update(self, sums: pa.Table) -> None:
        """Move each row by the mean of what was learnt, weighted by the tokens that used it."""
        for which, block, data in zip(*(sums.column(c).to_pylist() for c in ("which", "block", "data")), strict=True):
            at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            rows = self.weights[which][at]
            told = np.frombuffer(data, dtype=np.float32).reshape(len(rows), -1)
            used = np.maximum(told[:, -1], 1)
            rows += told[:, :-2] / used[:, None]
            self.squares[which][at] += told[:, -2] / used


def _learnt(docs: DataFrame, start: Weights, shape: Shape, tasks: int) -> pa.Table:
    """Sums over all tasks of what they have learnt: which table, block of rows, and for each row changes, squares and uses."""
    sent = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = sent.value
        now = [w.copy() for w in begun.weights]
        squares = [s.copy() for s in begun.squares]
        used = [np.zeros(len(s), dtype=np.float32) for s in squares]
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens.of(text_bytes(part.column("text")), shape)
                rows, rights = tokens.features(shape), (tokens.classes, tokens.slots)
                for at in range(0, len(tokens.hashes), BATCH):
                    for k in (0, 1):
                        learn(now[k], squares[k], used[k], rows[k][:, at : at + BATCH], rights[k][at : at + BATCH], np.float32(shape.rate))
        made = []
        for k in (0, 1):
            all_rows = np.column_stack(((now[k] - begun.weights[k]) * used[k][:, None], (squares[k] - begun.squares[k]) * used[k], used[k]))
            made += [(k, b, all_rows[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].tobytes()) for b in range(-(-len(all_rows) // BLOCK_ROWS)) if used[k][b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].any()]
        which, block, data = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(block, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(which), pa.int32()), pa.array(data, pa.binary())], ["which", "block", "piece", "data"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        total = np.sum([np.frombuffer(d, dtype=np.float32) for d in group.column("data").to_pylist()], axis=0, dtype=np.float32)
        return pa.table({"which": group.column("which")[:1], "block": group.column("block")[:1], "piece": pa.array([group.column("piece")[0].as_py() // FAN], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    kind = "which int, block int, piece int, data binary"
    sums, pieces = docs.select("text").coalesce(tasks).mapInArrow(run, kind), tasks
    while True:
        sums, pieces = sums.groupBy("which", "block", F.floor(F.col("piece") / FAN)).applyInArrow(add, kind), -(-pieces // FAN)
        if pieces == 1:
            break
    found = sums.select("which", "block", "data").toArrow()
    sent.destroy()
    return found


def train(docs: DataFrame, shape: Shape, rounds: int = 4) -> Weights:
    """Weights from all rows of docs (doc_id, text), each used in one of the rounds."""
    weights = Weights(shape)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, round(size / rounds / TASK_BYTES))
    for r in range(rounds):
        weights.update(_learnt(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r), weights, shape, tasks))
    return weights


def word_counts(docs: DataFrame, shape: Shape) -> DataFrame:
    """h, bucket (class and slot), n of each distinct token of docs."""

    def flushed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, bucket, n = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        each, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=n, minlength=len(each)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(bucket[first].astype(np.int32)), pa.array(total)], ["h", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens.of(text_bytes(part.column("text")), shape)
                each, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
                held.append((each, (tokens.classes * shape.slots + tokens.slots)[first], n))
                size += len(each)
                if size > HELD_WORDS:
                    yield flushed(held)
                    held, size = [], 0
        yield flushed(held)

    return docs.select("text").mapInArrow(run, "h long, bucket int, n long").groupBy("h", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Unigrams:
    """Bounded statistics of the training tokens: all, distinct, and by bucket all and those seen once."""

    total: int
    distinct: int
    held: np.ndarray
    once: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, shape: Shape) -> Unigrams:
        held, once, distinct = np.zeros(shape.classes * shape.slots), np.zeros(shape.classes * shape.slots), 0
        for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"), F.count(F.lit(1)).alias("kinds")).collect():
            held[r["bucket"]], once[r["bucket"]], distinct = r["n"], r["once"], distinct + r["kinds"]
        return cls(int(held.sum()), distinct, held, once)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, n: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Share of a word in its class and slot, as a logarithm."""
        new = np.where(self.held > 0, (self.once + 0.5) / (self.held + 1), 1.0)[bucket]
        return np.log10(np.where(n > 0, n / np.maximum(self.held[bucket], 1) * (1 - new), new))


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1, shape: Shape | None = None, rounds: int = 4, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A row is held out, that is not learnt from, if the CRC-32 of its doc_id leaves `held` when divided by `folds`.
    """
    spark = docs.sparkSession
    shape = shape or Shape()
    n = partitions(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    fold = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))
    told = table(docs.select(F.monotonically_increasing_id().alias("row_id"), doc_id.alias("doc_id"), text.alias("text"), (fold == held).alias("held_out")), "lm-texts")
    learnt = told.filter("NOT held_out").select("doc_id", "text")
    counts = table(word_counts(learnt, shape), "lm-counts")
    unigrams = Unigrams.of(counts, shape)
    sent = spark.sparkContext.broadcast((train(learnt, shape, rounds), unigrams))

    total = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(n, -(-total // RANGE_BYTES)).bit_length()
    # row_id is written, so a row keeps its shard whenever it is read, and equal rows are dealt like others
    dealt = told.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(max(1, -(-total // shard_bytes)))).cast("int")).drop("row_id").repartition(n, "shard")

    def distinct(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words in order of their hashes, and where in that order each range starts."""
        each = np.unique(tokens.hashes)
        return each, np.searchsorted(each >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))

    def ask(group: pa.Table) -> pa.Table:
        each, edges = distinct(Tokens.of(text_bytes(group.column("text").combine_chunks()), shape))
        full = np.flatnonzero(np.diff(edges)).tolist()
        shard = group.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(full), pa.int32()), "range": pa.array(full, pa.int32()), "words": pa.array([each[edges[r] : edges[r + 1]].tobytes() for r in full], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words = known.column("h").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, times = np.append(words[order], np.uint64(0)), np.append(known.column("n").to_numpy()[order], 0)
        found = []
        for data in asked.column("words").to_pylist():
            some = np.frombuffer(data, dtype=np.uint64)
            at = np.searchsorted(words[:-1], some)
            found.append(np.where(words[at] == some, times[at], 0).tobytes())
        return pa.table({"shard": asked.column("shard"), "range": asked.column("range"), "counts": pa.array(found, pa.binary())})

    def scored(group: pa.Table, answers: pa.Table) -> pa.Table:
        weights, unigrams = sent.value
        tokens = Tokens.of(text_bytes(group.column("text").combine_chunks()), shape)
        each, _ = distinct(tokens)
        counts = np.frombuffer(b"".join(answers.sort_by("range").column("counts").to_pylist()), dtype=np.int64)
        if len(counts) != len(each):
            raise RuntimeError(f"{len(each)} words were asked for, {len(counts)} answered")
        times = counts[np.searchsorted(each, tokens.hashes)]
        log, (rows, rights) = unigrams.within(times, tokens.classes * shape.slots + tokens.slots), (tokens.features(shape), (tokens.classes, tokens.slots))
        for at in range(0, len(log), BATCH):
            for k in (0, 1):
                p, right = softmax(weights.weights[k], rows[k][:, at : at + BATCH]), rights[k][at : at + BATCH]
                log[at : at + BATCH] += np.log10(p[right, np.arange(len(right))].astype(np.float64))
        first = tokens.bounds[:-1]
        per_text = [np.add.reduceat(x, first) for x in ((times > 0).astype(np.int64), unigrams.base(times), log)]
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(np.diff(tokens.bounds)), "n_known": pa.array(per_text[0]), "base_score": pa.array(per_text[1]), "score": pa.array(per_text[2])})

    ranged = counts.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("range"), "h", "n")
    asked = dealt.groupBy("shard").applyInArrow(ask, "shard int, range int, words binary")
    answers = asked.groupBy("range").cogroup(ranged.groupBy("range")).applyInArrow(answer, "shard int, range int, counts binary")
    out = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scored, RESULT)
    return out.withColumn("train_tokens", F.lit(unigrams.total).cast("long"))
