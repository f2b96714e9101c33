"""Language identification by string kernels: blended n-gram presence, Nystrom landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams (1 to 4 bytes, hashed) that both hold, over the
root of the product of their numbers. With landmarks L and their kernel matrix K = U diag(s) U', a text
x has the features k(x, L) U diag(s)^-1/2; ridge regression of one-versus-rest targets on them gives
weights W. Scores of a batch are the product of its 0/1 presence matrix with L' U diag(s)^-1/2 W, which
is formed once, over the root of each row's sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, text_slices, worker_store

ORDERS = (1, 2, 3, 4)
#: Hashed n-grams.
WIDTH = 1 << 14
#: Bounds of the training sample: texts per language, landmarks per language, characters are not cut.
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 60
#: Languages with the most rows that are learned; the model has a column for each.
MOST_LANGUAGES = 200
RIDGE = 1e-3
#: Steepness of the softmax that turns one-versus-rest outputs into a score between 0 and 1.
SHARPNESS = 6.0
UNKNOWN = "und"
#: Bytes of text and rows of presence held at a time.
SLICE = 1 << 20
ROWS = 256


def has_letter(text: str | None) -> bool:
    """Whether ``text`` has a character of the letter categories; numerals like \u2167 and \u00bd are none."""
    return any(map(str.isalpha, text or ""))


def _folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and the accented Latin letters of two bytes), all other ASCII as one blank."""
    store = worker_store("folds")
    if not store:
        table = np.full(256, 0x20, dtype=np.uint8)
        low = np.arange(97, 123)
        table[low], table[low - 32] = low, low
        table[128:] = np.arange(128, 256)
        store["table"] = table
    out = store["table"][data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Mark in row i of ``out`` (zeroed bytes) the hashed n-grams of text i."""
    if not len(data):
        return
    folded = _folded(data).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * WIDTH, np.diff(offsets))
    flat = out.reshape(-1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    gram = np.zeros(len(folded), dtype=np.uint32)
    room = end - np.arange(len(folded))
    for n in range(1, max(ORDERS) + 1):
        # gram holds bytes i .. i+n-1; those that run over the text's end are left out
        if n > 1:
            if len(folded) < n:
                break
            gram = (gram[: len(folded) - n + 1] << np.uint32(8)) | folded[n - 1 :]
        else:
            gram = folded
        if n in ORDERS:
            h = (gram + np.uint32(n * 0x3C6EF35F)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            fits = room[: len(gram)] >= n
            place = row[: len(gram)] + (h >> np.uint32(32 - 14)).astype(np.int64)
            flat[place if fits.all() else place[fits]] = 1


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, presence as 0/1 floats) in bounded pieces; a long text is read in slices."""
    held = np.zeros((ROWS, WIDTH), dtype=np.uint8)
    for first, end, data, offsets in text_slices(batch, column, SLICE):
        for low in range(0, end - first, ROWS):
            high = min(low + ROWS, end - first)
            own = held[: high - low]
            own[:] = 0
            if high - low == 1:
                # one text, of any length: slices that overlap by the longest n-gram less one
                a, b = int(offsets[low]), int(offsets[high])
                for at in range(a, b, SLICE):
                    part = data[at : min(b, at + SLICE + max(ORDERS) - 1)]
                    presence(part, np.array([0, len(part)]), own)
            else:
                part = data[offsets[low] : offsets[high]]
                presence(part, offsets[low : high + 1] - offsets[low], own)
            yield first + low, first + high, own.astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (WIDTH, languages): landmarks and ridge weights in one matrix

    def scores(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1.0))
        return (rows @ self.weights) / size


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression over Nystrom features of ``rows`` (0/1), labelled ``languages``; first rows of each are landmarks."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    x = rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1.0))
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    kernel = (x[chosen] @ x[chosen].T).astype(np.float64)
    values, axes = np.linalg.eigh(kernel)
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = axes[:, good] / np.sqrt(values[good])
    features = (x @ x[chosen].T).astype(np.float64) @ root
    targets = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weight = 1.0 / np.bincount(label, minlength=len(names))[label]
    weighted = features * weight[:, None]
    solved = np.linalg.solve(
        weighted.T @ features + ridge * weight.sum() / len(names) * np.eye(features.shape[1]), weighted.T @ targets
    )
    return Model(names, (x[chosen].T.astype(np.float64) @ root @ solved).astype(np.float32))


SAMPLE = "lang string, grams binary"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang")
        for first, end, rows in _rows(batch, "text"):
            packed = np.packbits(rows.astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays(
                [langs.slice(first, end - first), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "grams"]
            )


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` rows of each language of ``labelled`` (doc_id, text, lang), those of least id hash.

    Rows without text or language are left out. The sample is bounded (at most ``MOST_LANGUAGES`` times
    ``per_language`` rows of ``WIDTH`` bits); None if there is nothing to learn from.
    """
    rows = labelled.where("text is not null and lang is not null and text rlike '[\\\\p{L}]'")
    chosen = drawn(rows, "lang", "doc_id", per_language, MOST_LANGUAGES)
    sample = chosen.select("lang", "text").mapInArrow(_sample, SAMPLE).toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "grams"], kind="stable")
    sample = sample.groupby("lang").head(per_language)
    grams = np.unpackbits(np.frombuffer(b"".join(sample["grams"]), dtype=np.uint8).reshape(len(sample), -1), axis=1)
    return fit(grams.astype(np.float32), sample["lang"].tolist())


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            best = np.zeros(batch.num_rows, dtype=np.int64)
            score, margin = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            lettered = np.zeros(batch.num_rows, dtype=bool)
            for first, end, rows in _rows(batch, "text"):
                out = model.scores(rows).astype(np.float64)
                sharp = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
                best[first:end] = out.argmax(axis=1)
                score[first:end] = 1.0 / sharp.sum(axis=1)
                ranked = np.partition(np.pad(out, ((0, 0), (1, 0)), constant_values=-1.0), -2, axis=1)
                margin[first:end] = ranked[:, -1] - ranked[:, -2]
            for first, end, data, offsets in text_slices(batch, "text"):
                ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
                ends = np.concatenate([[0], np.cumsum(ascii_letter)])
                lettered[first:end] = ends[offsets[1:]] > ends[offsets[:-1]]
            for i in np.flatnonzero(~lettered):
                lettered[i] = has_letter(texts[i].as_py())
            names = np.array([*model.languages, UNKNOWN], dtype=object)
            best[~lettered] = len(model.languages)
            score[~lettered] = margin[~lettered] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names[best], pa.string()), pa.array(score), pa.array(margin)],
                [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "margin"],
            )

    return run


def identify(documents: DataFrame, model: Model | None, keep: list[str], margin: bool = False) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` (0 to 1) and if asked for ``margin`` for every row of ``documents`` (with ``text``), whole texts.

    A text that is null or holds no letter is ``und`` with score and margin 0; so are all without a model. The score
    is a softmax over the one-versus-rest outputs, the margin the best output less the second best one (or less -1, what the
    languages are trained to answer for others): unlike the score it does not fall with the number of languages. Columns of ``keep``
    named text or like a result column are left out.
    """
    keep = [c for c in keep if c not in ("text", "lang_pred", "score", "margin")]
    rows = documents.select(*keep, "text")
    if model is None:
        found = rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"))
        return found if margin else found.drop("margin")
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    found = rows.mapInArrow(_predict(model), f"{kept}, lang_pred string, score double, margin double")
    return found if margin else found.drop("margin")
