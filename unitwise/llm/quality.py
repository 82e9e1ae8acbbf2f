"""Quality classifier: random-indexing word vectors, pooled per text, and a two-layer network.

Every word stands for two tokens, the word itself (lower-cased, without marks at its ends)
and its shape (runs of upper case, lower case, digits and each mark), and a word equal to
the one before for a third. Tokens are hashed into ``TOKENS`` rows. Each row has a sparse
ternary index vector; its word vector is the sum of the index vectors met in a window
around it over the sample. A text is the mean of its tokens' vectors. The network has one
hidden layer; its logits are divided by a temperature fitted on sample rows kept out of
the training, so that scores are probabilities.

Vectors, network and temperature are learned from a bounded sample of labelled rows
(``SAMPLE_ROWS``, those whose id hashes lowest); every row is scored over its whole text. The
tasks' sums are added and scaled by blocks of tokens, and one task fits the network, so the
driver gets the finished vectors and the network only.

Defined results: a null text counts as empty and is scored as the text without tokens.
Of several labels of a document the lowest counts; null labels are ignored. Without two
classes to learn from every score is 0.5. Repeated rows give repeated rows. Other columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import bounded_sample, fold, prepare, slices, words
from unitwise.session import stage

SAMPLE_ROWS = 20_000
TOKENS = 1 << 15
SIZE = 32
NONZERO = 4
HIDDEN = 32
REACH = 2
EPOCHS = 40
_SAME = 0
_SAMPLE_TASKS = 8
#: Tokens of a block of word vectors.
_BLOCK = 512
_CACHED = 500_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


_ASCII = {k: _kind(chr(k)) for k in range(128)}
_MARKS = "".join(chr(k) for k in range(128) if not chr(k).isalnum())
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def _shape(word: str) -> str:
    """Runs of upper case, lower case, digits and each mark, one character each."""
    return _RUN.sub(r"\1", word.translate(_ASCII) if word.isascii() else "".join(map(_kind, word)))


class Tokens(dict):
    """Word to (token of the word, token of its shape); hashing is cached up to a bound."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        bare = (text.strip(_MARKS) if text.isascii() else _ENDS.sub("", text)).lower()
        first = 1 + xxhash.xxh64_intdigest("w" + bare) % (TOKENS - 1)
        second = 1 + xxhash.xxh64_intdigest("s" + _shape(text)) % (TOKENS - 1)
        packed = first << 20 | second
        if len(self) < _CACHED:
            self[word] = packed
        return packed

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = words(text)
        packed = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return packed >> 20, packed & 0xFFFFF


_KNOWN = Tokens()


def known_tokens() -> Tokens:
    """The words this process has met; later tasks of a worker find them known."""
    return _KNOWN


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same everywhere."""
    rng = np.random.default_rng(20_11)
    table = np.zeros((TOKENS, SIZE), np.float32)
    places = rng.integers(0, SIZE, (TOKENS, NONZERO))
    signs = rng.choice(np.array([-1, 1], np.float32), (TOKENS, NONZERO))
    np.add.at(table, (np.arange(TOKENS)[:, None], places), signs)
    return table


def context_sums(texts: Iterator[str | None], index: np.ndarray) -> np.ndarray:
    """For every token the index vectors around it, summed over the texts."""
    sums = np.zeros((TOKENS, SIZE), np.float64)
    tokens = Tokens()
    for text in texts:
        word, shape = tokens.of(text)
        n = len(word)
        if not n:
            continue
        own = index[word] + index[shape]
        same = np.flatnonzero(word[1:] == word[:-1]) + 1
        own[same] += index[_SAME]
        run = np.zeros((n + 1, SIZE))
        np.cumsum(own, axis=0, out=run[1:])
        at = np.arange(n)
        around = run[np.minimum(at + REACH + 1, n)] - run[np.maximum(at - REACH, 0)]
        for rows, values in ((word, around), (shape, around), (np.zeros(len(same), np.int64), around[same])):
            kinds, where = np.unique(rows, return_inverse=True)
            for k in range(SIZE):
                sums[kinds, k] += np.bincount(where, values[:, k], minlength=len(kinds))
    return sums


@dataclass
class Classifier:
    """Word vectors and the network on their means."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = self._logits((pooled - self.mean) / self.scale) / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.first + self.first_bias) @ self.second + self.second_bias


def pool(text: str | None, vectors: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Mean vector of a text's tokens and the logarithm of their number."""
    word, shape = tokens.of(text)
    out = np.zeros(SIZE + 1)
    n = len(word)
    if n:
        same = int((word[1:] == word[:-1]).sum())
        total = vectors[_SAME] * same
        for at in range(0, n, 1 << 16):
            total = total + vectors[word[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            total = total + vectors[shape[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        out[:SIZE] = total / (2 * n + same)
        out[SIZE] = np.log1p(n)
    return out


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 7) -> Classifier:
    """Fit the network by Adam; every fifth row only fits the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    held = np.arange(len(x)) % 5 == 4
    xs, ys = ((x - mean) / scale)[~held], y[~held]
    parts = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    speed, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), 256):
            rows = order[at:at + 256]
            a, t = xs[rows], ys[rows]
            h = np.tanh(a @ parts[0] + parts[1])
            off = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -60, 60))) - t) / len(rows)
            back = np.outer(off, parts[2]) * (1 - h * h)
            slopes = [a.T @ back + 1e-4 * parts[0], back.sum(axis=0), h.T @ off + 1e-4 * parts[2], off.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(slopes):
                speed[k] = 0.9 * speed[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                parts[k] = parts[k] - 3e-3 * (speed[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    model = Classifier(vectors, mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0)
    if held.sum() >= 20:
        z, t = model._logits(((x - mean) / scale)[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Classifier | None:
    """Fit on at most ``most`` labelled documents; None unless both classes occur."""
    spark = docs.sparkSession
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    # Labels are cut to the bound before they meet the texts, so this side is small by construction.
    chosen = bounded_sample(marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", most)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                   .dropDuplicates(["doc_id"]).repartition(_SAMPLE_TASKS, "doc_id"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = context_sums((t for pdf in batches for t in pdf["text"]), index_vectors()).astype(np.float32)
        yield pd.DataFrame({"block": range(TOKENS // _BLOCK), "task": TaskContext.get().partitionId(),
                            "sums": [part.tobytes() for part in np.split(total, TOKENS // _BLOCK)]})

    def scaled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((_BLOCK, SIZE))
        for part in pdf.sort_values("task")["sums"]:
            table += np.frombuffer(part, np.float32).reshape(_BLOCK, SIZE)
        norm = np.sqrt((table * table).sum(axis=1, keepdims=True))
        index = index_vectors()[key[0] * _BLOCK:(key[0] + 1) * _BLOCK]
        vectors = np.where(norm > 0, table / np.maximum(norm, 1e-9), index / NONZERO ** 0.5).astype(np.float32)
        return pd.DataFrame({"block": [key[0]], "vectors": [vectors.tobytes()]})

    vectors = np.zeros((TOKENS // _BLOCK, _BLOCK * SIZE), np.float32)
    for row in sample.coalesce(_SAMPLE_TASKS).mapInPandas(sums, "block int, task int, sums binary").groupBy(
            "block").applyInPandas(scaled, "block int, vectors binary").collect():
        vectors[row["block"]] = np.frombuffer(row["vectors"], np.float32)
    vectors = vectors.reshape(TOKENS, SIZE)
    known = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"],
                                "x": [pool(t, known.value, tokens).tolist() for t in pdf["text"]]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([pd.DataFrame({"doc_id": [], "quality": [], "x": []}), *batches])
        if found["quality"].nunique() > 1:
            found = found.sort_values("doc_id")
            # The driver has the vectors.
            model = train(np.stack(found["x"].to_list()), (found["quality"].to_numpy() > 0).astype(float), np.zeros((0, SIZE), np.float32))
            yield pd.DataFrame({"model": [pickle.dumps(vars(model))]})

    fitted = sample.mapInPandas(features, "doc_id long, quality int, x array<double>").repartition(1).mapInPandas(
        fit, "model binary").collect()
    known.destroy()
    return Classifier(**pickle.loads(fitted[0]["model"]) | {"vectors": vectors}) if fitted else None


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text, held_out)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, own = known_tokens(), shared.value
        for batch in slices(batches, "text", 16 << 20):
            if own is None:
                found = np.full(batch.num_rows, 0.5)
            else:
                found = own.scores(np.stack([pool(x.as_py(), own.vectors, tokens) for x in batch.column("text")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                 pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "held_out").mapInArrow(predict, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1) -> DataFrame:
    """Learn from labelled rows outside the fold ``left_out`` and score every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == left_out).alias("held_out"))
    return score(rows, learn(rows.filter("NOT held_out"), labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be of label 1, with all their columns.

    Learns like ``classify`` from the rows outside the left-out fold; the verdict is added next to
    every row where its text is read, so no join is needed.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    shared = spark.sparkContext.broadcast(learn(rows.filter("NOT held_out"), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, own = known_tokens(), shared.value
        for batch in slices(batches, "text", 16 << 20):
            if own is None:
                yield batch
                continue
            found = own.scores(np.stack([pool(x.as_py(), own.vectors, tokens) for x in batch.column("text")]))
            yield batch.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
