"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words of the whole text (runs of letters and digits, in lower case), and besides them its
format: pairs of neighbouring character classes (lower and upper letters, digits, blanks, line ends,
each punctuation mark) and buckets of word repetition and word length. Both parts of a text have length one.
Log rates, weighted by inverse document frequency, are projected on the leading singular directions of the labelled sample. The sample's
vectors are broadcast (their number is bounded); every document gets exact cosines with all of them, in
blocks, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, text_slices, worker_store
from .minhash import word_hashes

#: Labelled texts of each class that are kept as neighbours, at most.
PER_CLASS = 2000
LATENT = 64
NEIGHBOURS = 25
#: Power of the cosine in a vote.
POWER = 8.0
#: Texts scored together, and bytes of text held at a time.
ROWS = 512
SLICE = 1 << 20

MARKS = ".,;:!?-_'\"()|#$%&*+=/\\<>@[]{}~^`"
CLASSES = 6 + len(MARKS)  # lower, upper, digit, blank, line end, other; then each mark
BUCKETS = 12
FORMAT = CLASSES * CLASSES + 3 * BUCKETS
#: Places for hashed words.
WORDS = 1 << 12
TERMS = FORMAT + WORDS
#: Rounds of the search for the leading directions, and directions beyond ``LATENT`` that it carries.
ROUNDS, SPARE = 8, 32


def _classes() -> np.ndarray:
    store = worker_store("classes")
    if not store:
        table = np.full(256, 5, dtype=np.int64)
        table[97:123], table[65:91], table[48:58] = 0, 1, 2
        table[[9, 32]], table[[10, 13]] = 3, 4
        table[128:] = 0
        for i, mark in enumerate(MARKS):
            table[ord(mark)] = 6 + i
        store["table"] = table
    return store["table"]


def _letters() -> np.ndarray:
    """Bytes with blanks in place of ASCII marks, so that a word is the same with a comma and without."""
    store = worker_store("letters")
    if not store:
        table = np.arange(256, dtype=np.uint8)
        table[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
        store["table"] = table
    return store["table"]


def _word_rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log rates of the hashed words in each whole text."""
    n = len(offsets) - 1
    words, each = word_hashes(_letters()[data], offsets)
    place = np.repeat(np.arange(n), each) * WORDS + (words >> np.uint64(32)).astype(np.int64) % WORDS
    counts = np.bincount(place, minlength=n * WORDS).reshape(n, WORDS)
    row, column = np.nonzero(counts)
    out = np.zeros((n, WORDS), dtype=np.float32)
    out[row, column] = np.log1p(1000.0 * counts[row, column] / each[row])
    return out


def _bucket(share: np.ndarray) -> np.ndarray:
    return np.minimum((share * (BUCKETS - 1)).astype(np.int64), BUCKETS - 1)


def term_rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log rates of the terms in each whole text, one row per text; empty texts have a row of zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    if not len(data):
        return out
    table, pairs = _classes(), CLASSES * CLASSES
    counts = np.zeros(n * pairs)
    for at in range(0, len(data) - 1, SLICE):
        part = table[data[at : at + SLICE + 1]]
        own = np.searchsorted(offsets, np.arange(at, at + len(part) - 1), side="right") - 1 if n > 1 else np.zeros(len(part) - 1, np.int64)
        place = own * pairs + part[:-1] * CLASSES + part[1:]
        if n > 1:
            inside = np.ones(len(place), dtype=bool)
            ends = offsets[1:-1] - 1 - at
            inside[ends[(ends >= 0) & (ends < len(place))]] = False
            place = place[inside]
        counts += np.bincount(place, minlength=n * pairs)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out[:, :pairs] = np.log1p(1000.0 * counts.reshape(n, pairs) / size)

    words, each = word_hashes(data, offsets)
    ends = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(n), each)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    many = np.maximum(each, 1)
    repeated = np.bincount(row, weights=again, minlength=n) / many
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(ends[:-1], ends[1:])]) / many
    length = np.minimum(np.diff(offsets) / many / 24.0, 1.0)
    full = each > 0
    for k, share in enumerate((repeated, 1.0 - distinct, length)):
        out[np.flatnonzero(full), pairs + k * BUCKETS + _bucket(share[full])] = 4.0
    out[:, FORMAT:] = _word_rates(data, offsets)
    for part in (out[:, :FORMAT], out[:, FORMAT:]):
        part /= np.maximum(np.sqrt((part * part).sum(axis=1, keepdims=True)), 1e-12)
    return out


class Sample:
    """Rates of the sample's texts without their zeros; dense only ``ROWS`` texts at a time."""

    def __init__(self, terms: list[np.ndarray], values: list[np.ndarray]):
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.uint16)
        self.values = np.concatenate(values) if values else np.zeros(0, np.float32)

    @classmethod
    def of(cls, rates: np.ndarray) -> Sample:
        own = [np.flatnonzero(r) for r in rates]
        return cls([t.astype(np.uint16) for t in own], [r[t] for r, t in zip(rates, own)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def blocks(self) -> Iterator[np.ndarray]:
        for low in range(0, len(self), ROWS):
            ends = self.ends[low : low + ROWS + 1]
            out = np.zeros((len(ends) - 1, TERMS), dtype=np.float32)
            own = slice(ends[0], ends[-1])
            out[np.repeat(np.arange(len(out)), np.diff(ends)), self.terms[own]] = self.values[own]
            yield out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ matrix for block in self.blocks()])


def leading(sample: Sample, rarity: np.ndarray) -> np.ndarray:
    """The leading ``LATENT`` right singular directions of the weighted rates, by subspace iteration from a fixed start."""
    columns = min(LATENT + SPARE, len(sample), TERMS)
    basis = np.random.default_rng(7).standard_normal((TERMS, columns)).astype(np.float32)
    for _ in range(ROUNDS):
        turned = np.zeros_like(basis)
        for block in sample.blocks():
            block *= rarity
            turned += block.T @ (block @ basis)
        basis, _ = np.linalg.qr(turned)
    _, _, axes = np.linalg.svd(sample.times(rarity[:, None] * basis), full_matrices=False)
    return (basis @ axes.T)[:, :LATENT]


def _rated(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, end, data, offsets in text_slices(batch, "text", SLICE):
        for low in range(0, end - first, ROWS):
            high = min(low + ROWS, end - first)
            part = data[offsets[low] : offsets[high]]
            yield first + low, first + high, term_rates(part, offsets[low : high + 1] - offsets[low])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for first, end, rates in _rated(batch):
            terms = [np.flatnonzero(r).astype("<u2") for r in rates]
            values = [r[t].tobytes() for r, t in zip(rates, terms)]
            yield pa.RecordBatch.from_arrays(
                [label.slice(first, end - first), pa.array([t.tobytes() for t in terms], pa.binary()), pa.array(values, pa.binary())],
                ["label", "terms", "rates"],
            )


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # (TERMS, LATENT)
    vectors: np.ndarray  # labelled, of length one
    labels: np.ndarray  # 0 or 1
    weights: np.ndarray  # of a vote, by class: rows that one drawn row stands for
    prior: float

    def latent(self, rates: np.ndarray) -> np.ndarray:
        out = rates @ self.projection
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

    def scores(self, rates: np.ndarray) -> np.ndarray:
        """Share of votes for label 1; texts without any term get the share of label 1 among the labelled."""
        cosine = self.latent(rates) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** POWER * self.weights[near]
        score = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.where(rates.any(axis=1), score, self.prior)


def fit(rates: Sample | np.ndarray, labels: np.ndarray, totals: tuple[float, float] | None = None) -> Model:
    """Latent vectors of the labelled ``rates``; ``totals`` are the sizes of classes 0 and 1 they were drawn from."""
    sample = Sample.of(rates) if isinstance(rates, np.ndarray) else rates
    drawn_of = np.maximum(np.bincount(labels, minlength=2), 1)
    totals = np.array(totals if totals else drawn_of, dtype=np.float64)
    rarity = np.log((1.0 + len(sample)) / (1.0 + np.bincount(sample.terms, minlength=TERMS))) + 1.0
    rarity = rarity.astype(np.float32)
    projection = rarity[:, None] * leading(sample, rarity)
    latent = sample.times(projection)
    latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1, keepdims=True)), 1e-12)
    return Model(projection, latent.astype(np.float32), labels.astype(np.float64), (totals / drawn_of)[labels], float(totals[1] / totals.sum()))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` documents of each class of ``labels`` (doc_id, label 0 or 1), those of least id hash.

    Labels that are null, neither 0 nor 1, contradict each other for one doc_id, or have no document
    with a text are left out. None if nothing is left.
    """
    clear = (
        labels.where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    totals = {r["label"]: r["count"] for r in clear.groupBy("label").count().collect()}
    chosen = F.broadcast(drawn(clear, "label", "doc_id", per_class, 2))  # at most 2 * per_class rows
    texts = documents.select("doc_id", "text").where("length(text) > 0").join(chosen, "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    sample = texts.mapInArrow(_sampled, "label int, terms binary, rates binary").toArrow()  # the terms of at most 2 * per_class texts
    labels = sample["label"].to_numpy()
    terms, rates = sample["terms"].to_pylist(), sample["rates"].to_pylist()
    order = sorted(range(len(labels)), key=lambda i: (labels[i], rates[i], terms[i]))
    kept = [i for label in (0, 1) for i in [i for i in order if labels[i] == label][:per_class]]
    if not kept:
        return None
    drawn_texts = Sample([np.frombuffer(terms[i], "<u2") for i in kept], [np.frombuffer(rates[i], np.float32) for i in kept])
    return fit(drawn_texts, labels[kept], (float(totals.get(0, 0)), float(totals.get(1, 0))))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.zeros(batch.num_rows)
            for first, end, rates in _rated(batch):
                score[first:end] = model.scores(rates)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


def score_quality(documents: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1, higher: label 1 likelier) for every row of ``documents`` (with ``text``).

    Whole texts are scored. Null and empty texts get the share of label 1 among the labelled documents;
    without a model every score is 0.5. Columns of ``keep`` named text or score are left out.
    """
    keep = [c for c in keep if c not in ("text", "score")]
    rows = documents.select(*keep, "text")
    if model is None:
        return rows.select(*keep, F.lit(0.5).alias("score"))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_score(model), f"{kept}, score double")
