"""Mixing domains to target weights by soft membership.

A multinomial classifier learned from a labelled table gives every document a posterior over
the domains. Document rates r >= 0 are then fitted by projected-gradient least squares so that
the expected tokens of every domain, sum of rate x tokens x posterior, meet their targets. The
squared misfit of a domain is divided by its target, and a document's step by its
length, so one step is ``r = max(0, r - posterior . u)`` with one number in ``u`` per domain. A
round sums the domains' tokens over the cluster and sends those few numbers to the driver; the
rates themselves are never stored, each task replays the steps. Steps are preconditioned by the
domains' normal matrix and go on until the targets are met or the misfit is least; then a warning
names the domains that miss theirs.

Classifier: presence and share of ``FEATURES`` hashed word and shape tokens, those whose document
frequency differs most between domains (chi squared), learned from a bounded sample of labelled
rows (``SAMPLE_ROWS``, those whose id hashes lowest); one task fits it. A document's tokens are its words.

Defined results: a null or empty text has no tokens; it is classified like any text and does not
weigh in the totals. Of several domains of a document the first by name counts; null domains
and domains without a target are not learned. Without labels all domains are equally likely. A
domain without documents cannot meet its target. Repeated rows get equal rates and copies drawn
for each. Other columns are ignored or, by ``mix_rows``, kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import bounded_sample, prepare, slices
from unitwise.llm.quality import TOKENS, Tokens, known_tokens
from unitwise.session import stage

SAMPLE_ROWS = 12_000
FEATURES = 512
EPOCHS = 60
TOLERANCE = 1e-4
#: Where no step takes this part off the squared misfit, it is least.
STATIONARY = 1e-6
_SAMPLE_TASKS = 8

#: Weight of each domain among the tokens of the mix, and the mix's tokens of the first domain per
#: token it has now: 1.02 leaves room for documents that belong to it in part.
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}
GROWTH = 1.02


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the quality and toxicity marks of the labelled table."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 1, "clean").alias("domain"))


@dataclass
class DomainModel:
    """Softmax regression over the presence and the share of chosen tokens."""

    domains: list[str]
    slot: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full((len(counts), len(self.domains)), 1 / len(self.domains))
        z = inputs(counts, sizes) / self.scale @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def inputs(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty((len(counts), 2 * FEATURES), np.float32)
    out[:, :FEATURES] = counts > 0
    np.divide(counts, np.maximum(sizes, 1)[:, None], out=out[:, FEATURES:], casting="unsafe")
    return out


def token_counts(text: str | None, tokens: Tokens, slot: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each chosen token occurs, and the number of words."""
    word, shape = tokens.of(text)
    places = np.concatenate([slot[word], slot[shape]])
    return np.bincount(places[places >= 0], minlength=FEATURES), len(word)


def learn(docs: DataFrame, domains: DataFrame, names: list[str], most: int = SAMPLE_ROWS) -> DomainModel:
    """Model of ``names`` from at most ``most`` labelled documents."""
    spark = docs.sparkSession
    marks = domains.filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("domain").alias("domain"))
    chosen = bounded_sample(marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", most)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                   .dropDuplicates(["doc_id"]).repartition(_SAMPLE_TASKS, "doc_id"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, found, rows = Tokens(), np.zeros((len(names), TOKENS)), np.zeros(len(names))
        for pdf in batches:
            for text, domain in zip(pdf["text"], pdf["domain"], strict=True):
                at = names.index(domain)
                found[at, np.unique(np.concatenate(tokens.of(text)))] += 1
                rows[at] += 1
        yield pd.DataFrame({"found": [np.append(found.ravel(), rows).astype(np.float32).tobytes()]})

    total = np.zeros(len(names) * TOKENS + len(names))
    for row in sample.coalesce(_SAMPLE_TASKS).mapInPandas(frequencies, "found binary").collect():
        total += np.frombuffer(row["found"], np.float32)
    rows, found = total[-len(names):], total[:-len(names)].reshape(len(names), TOKENS)
    slot = np.full(TOKENS, -1)
    if (rows > 0).sum() < 2:
        return DomainModel(names, slot, np.zeros(0), np.zeros((0, len(names))), np.zeros(len(names)))
    expected = np.outer(rows, found.sum(axis=0)) / rows.sum()
    chi = ((found - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) * (found.sum(axis=0) >= 5)
    slot[np.argsort(-chi, kind="stable")[:FEATURES]] = np.arange(FEATURES)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            each = [token_counts(t, tokens, slot) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "domain": pdf["domain"], "n": [n for _, n in each],
                                "counts": [c.astype(np.uint32).tobytes() for c, _ in each]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(batches)).sort_values("doc_id")
        x = np.empty((len(seen), 2 * FEATURES), np.float32)
        for at in range(0, len(seen), 1000):
            part = seen.iloc[at:at + 1000]
            counts = np.stack([np.frombuffer(c, np.uint32) for c in part["counts"]])
            x[at:at + 1000] = inputs(counts, part["n"].to_numpy())
        scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)).astype(np.float32) + np.float32(1e-3)
        x /= scale
        y = np.eye(len(names), dtype=np.float32)[[names.index(d) for d in seen["domain"]]]
        yield pd.DataFrame({"model": [pickle.dumps((scale, *_softmax_fit(x, y)))]})

    # One task holds the bounded sample, two kilobytes a row; the driver gets the weights.
    row = sample.mapInPandas(features, "doc_id long, domain string, n long, counts binary").repartition(1).mapInPandas(
        fit, "model binary").first()
    return DomainModel(names, slot, *pickle.loads(row["model"]))


def _softmax_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    parts = [np.zeros((x.shape[1], y.shape[1]), np.float32), np.log(y.mean(axis=0) + 1e-6).astype(np.float32)]
    speed, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 512):
            rows = order[at:at + 512]
            z = x[rows] @ parts[0] + parts[1]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            off = (e / e.sum(axis=1, keepdims=True) - y[rows]) / len(rows)
            step += 1
            for k, g in enumerate((x[rows].T @ off + 2e-4 * parts[0], off.sum(axis=0))):
                speed[k] = 0.9 * speed[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                parts[k] = parts[k] - 5e-3 * (speed[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return parts[0], parts[1]


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(row_id, doc_id, n_tokens, posterior) per row; the posterior is in the order of the domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, own = known_tokens(), shared.value
        for batch in slices(batches, "text", 8 << 20):
            each = [token_counts(x.as_py(), tokens, own.slot) for x in batch.column("text")]
            sizes = np.array([n for _, n in each])
            found = own.posterior(np.stack([c for c, _ in each]), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(sizes), pa.array(found.tolist(), pa.list_(pa.float64()))],
                names=["row_id", "doc_id", "n_tokens", "posterior"])

    return docs.selectExpr("row_id", "CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        predict, "row_id long, doc_id long, n_tokens long, posterior array<double>")


def replay(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps, from rates of one."""
    rates = np.ones(len(posterior))
    for u in steps:
        rates = np.maximum(0.0, rates - posterior @ u)
    return rates


def _posteriors(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def domain_tokens(p: np.ndarray, n: np.ndarray, steps: list[np.ndarray], tried: list[np.ndarray]) -> np.ndarray:
    """Per tried step after ``steps``: expected tokens of every domain, cross products of rows of a positive rate."""
    start, out = replay(p, steps), []
    for u in tried:
        rates = np.maximum(0.0, start - p @ u)
        own = p[rates > 0]
        out.append(np.concatenate([(n * rates) @ p, ((own * n[rates > 0, None]).T @ own).ravel()]))
    return np.stack(out)


def _domain_tokens(members: DataFrame, steps: list[np.ndarray], tried: list[np.ndarray], k: int) -> np.ndarray:
    size = len(tried) * (k + k * k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tried), k + k * k))
        for batch in batches:
            if batch.num_rows:
                total += domain_tokens(_posteriors(batch, k), batch.column("n_tokens").to_numpy().astype(np.float64), steps, tried)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    found = np.zeros(size)
    for row in members.select("n_tokens", "posterior").mapInArrow(add, "at int, v double").groupBy("at").agg(
            F.sum("v").alias("v")).collect():
        found[row["at"]] = row["v"]
    return found.reshape(len(tried), -1)


def descend(measure: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray], share: np.ndarray,
            growth: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected tokens per domain, targets) from ``measure``, which is ``domain_tokens`` over all rows.

    A round tries the misfit times the inverse of the normal matrix of the rows of a positive rate, whole
    and damped, and the plain gradient step, single and stretched, and takes the best. Ends when all
    targets are met, or when not even the gradient step, which always lowers the misfit away from its
    minimum, takes a ``STATIONARY`` part off it.
    """
    k = len(share)
    steps: list[np.ndarray] = []
    now, cross = np.split(measure(steps, [np.zeros(k)])[0], [k])
    target = share / share[0] * growth * now[0]
    # A domain that is nearly absent would outweigh all others if its present tokens were the weight.
    weight = np.maximum(target, 1.0)
    root = np.sqrt(weight)
    scaled = cross.reshape(k, k) / np.outer(root, root)
    # Largest eigenvalue of the weighted normal matrix bounds the gradient step.
    bound = max(float(np.linalg.eigvalsh(scaled).max()), 1e-9)
    while np.any(np.abs(now - target) > TOLERANCE * np.maximum(target, 1.0)):
        off = now - target
        newton = np.linalg.lstsq(scaled, off / root, rcond=1e-9)[0] / root
        tried = [newton / 4.0 ** j for j in range(8)] + [off / weight / bound * 4.0 ** j for j in range(8)]
        found = measure(steps, tried)
        left = ((found[:, :k] - target) ** 2 / weight).sum(axis=1)
        best = int(left.argmin())
        if not left[best] < (1 - STATIONARY) * float((off * off / weight).sum()):
            break
        steps.append(tried[best])
        now, scaled = found[best, :k], found[best, k:].reshape(k, k) / np.outer(root, root)
    return steps, now, target


def fit_rates(members: DataFrame, weights: dict[str, float],
              growth: float = GROWTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected tokens per domain, targets) of the projected-gradient fit.

    The first domain's target is ``growth`` times its present tokens; the others follow from the weights.
    """
    share = np.array(list(weights.values())) / sum(weights.values())
    return descend(lambda steps, tried: _domain_tokens(members, steps, tried, len(share)), share, growth)


def _rated(docs: DataFrame, domains: DataFrame, weights: dict[str, float]) -> DataFrame:
    names = list(weights)
    model = learn(docs, domains, names)
    members = stage(memberships(docs, model))
    steps, now, target = fit_rates(members, weights)
    missed = [f"{name} {a:.6g} of {b:.6g}" for name, a, b in zip(names, now, target, strict=True)
              if abs(a - b) > TOLERANCE * max(b, 1.0)]
    if missed:
        warnings.warn(f"no rates meet the targets; expected tokens at the least misfit: {', '.join(missed)}", stacklevel=3)
    k = len(names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("rate", pa.array(replay(_posteriors(batch, k), steps)))

    drawn = F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(1 << 40)) / float(1 << 40)
    return members.mapInArrow(rate, "row_id long, doc_id long, n_tokens long, posterior array<double>, rate double").select(
        "*", F.floor(F.col("rate") + drawn).cast("int").alias("copies"))


def mixing(docs: DataFrame, domains: DataFrame, weights: dict[str, float] = TARGETS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_tokens, domain (likeliest), one posterior per domain, rate and copies."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    names = list(weights)
    rated = _rated(rows, domains, weights)
    likeliest = F.array_position("posterior", F.array_max("posterior"))
    return rated.select(
        "doc_id", "n_tokens", F.element_at(F.array(*map(F.lit, names)), likeliest.cast("int")).alias("domain"),
        *(F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(names)), "rate", "copies")


def mix_rows(docs: DataFrame, domains: DataFrame, weights: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    prepare(docs.sparkSession)
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    rated = _rated(numbered.select(F.col("_row").alias("row_id"), "doc_id", "text"), domains, weights)
    copies = rated.filter("copies > 0").select(F.col("row_id").alias("_row"), F.col("copies").alias("_copies"))
    return numbered.join(copies, "_row").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_row", "_copies", "_copy")
