"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what the page says: shares of character classes, repetition, and hashed words. The metadata view sees
language, source and declared length only. Each is a logistic regression on a bounded labelled sample; over some rounds
each view gives the rows of an unlabelled pool of which it is surest, with its own guess as label, to the other view.
Both views are then calibrated on rows held back, and one more regression on the two calibrated logits scores every
document. Fitting needs the bounded samples alone; features and scores cover whole texts and all documents.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.tables import packed, slices, text_of, utf8
from meterstone.llm.words import CHUNK_BYTES, hashed_words, mix

#: Bounds of the two samples that are fitted on.
LABELLED, POOL = 6000, 6000
#: Share of the labelled sample that is held back for calibration and the threshold.
HELD_BACK = 0.3
ROUNDS, PER_ROUND, SURE = 4, 500, 0.97
#: Documents are rejected only as far as this share of good held-back documents is kept.
KEEP_GOOD = 0.998
WORD_SLOTS, LABEL_SLOTS = 256, 32
#: Rows whose features are held at once.
ROWS = 512

# The byte classes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:",
    "loud": b"!?",
    "mark": b"#$%&*",
    "bar": b"|",
    "angle": b"<>{}[]()",
    "other": b"\"'`-_=+/\\@^~",
    "wide": bytes(range(128, 256)),
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _set in enumerate(CLASSES.values()):
    _CLASS[list(_set)] = _k
_N_CLASSES = len(CLASSES) + 1


def _shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each byte class in each row, read in pieces of bounded size."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * _N_CLASSES)
    for at in range(0, len(data), CHUNK_BYTES):
        piece = data[at : at + CHUNK_BYTES]
        row = np.repeat(np.arange(rows), np.diff(np.clip(offsets, at, at + len(piece))))
        counts += np.bincount(row * _N_CLASSES + _CLASS[piece], minlength=len(counts))
    return counts.reshape(rows, _N_CLASSES) / np.maximum(np.diff(offsets), 1)[:, None]


def text_features(array: pa.Array) -> np.ndarray:
    """One row of features per text; a null or empty text has zeros for all shares."""
    data, offsets = utf8(array)
    size = np.diff(offsets)
    parts = [_shares(data, offsets), np.log1p(size)[:, None]]
    words = np.zeros((len(size), 5 + WORD_SLOTS))
    for first, last, hashes, at in hashed_words(array):
        n, rows = np.diff(at), np.repeat(np.arange(last - first), np.diff(at))
        total = np.maximum(n, 1)
        order = np.lexsort((hashes, rows))
        h, r = hashes[order], rows[order]
        again = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        beside = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        out = words[first:last]
        out[:, 0] = np.log1p(n)
        out[:, 1] = np.bincount(r[1:][again], minlength=last - first) / total
        out[:, 2] = np.bincount(rows[1:][beside], minlength=last - first) / total
        out[:, 3] = size[first:last] / total / 16
        out[:, 4] = n > 0
        slots = np.bincount(rows * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=(last - first) * WORD_SLOTS)
        out[:, 5:] = np.sqrt(slots.reshape(last - first, WORD_SLOTS) / total[:, None])
    return np.hstack([*parts, words]).astype(np.float32)


def _slots(array: pa.Array, seed: int) -> np.ndarray:
    """One-hot of a label's hash; null is a label of its own."""
    coded = array.cast(pa.string()).dictionary_encode()
    names = [b"\0null" if x is None else x.encode() for x in coded.dictionary.to_pylist()]
    value = np.array([zlib.crc32(n) for n in [*names, b"\0null"]], np.uint64)
    index = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    out = np.zeros((len(array), LABEL_SLOTS), np.float32)
    out[np.arange(len(array)), (mix(value + np.uint64(seed << 32)) % np.uint64(LABEL_SLOTS)).astype(np.int64)[index]] = 1
    return out


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    size = n_chars.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    length = np.log1p(np.maximum(size, 0))[:, None]
    return np.hstack([_slots(lang, 1), _slots(source, 2), length, length**2 / 10, (size <= 0)[:, None]]).astype(np.float32)


@dataclass(frozen=True)
class Linear:
    """Logistic regression on standardised features, followed by a calibrating line on its logit."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(((x - self.centre) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)
        return self.line[0] * raw + self.line[1]

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Linear:
        fitted = fit(self.logit(x)[:, None], y, ridge=1.0)
        slope = float(fitted.weights[1] / fitted.scale[0])
        return Linear(self.centre, self.scale, self.weights, (slope, float(fitted.weights[0] - slope * fitted.centre[0])))


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 12) -> Linear:
    """Newton steps for logistic regression with a ridge; classes weigh alike."""
    x = x.astype(np.float64)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = _probability(np.clip(z @ w, -30, 30))
        slope = z.T @ (share * (p - y)) + penalty * w
        curve = (z * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(centre, scale, w)


@dataclass(frozen=True)
class CoTrained:
    """Both calibrated views, their combination and the score below which a document is rejected.

    With fewer than two classes among the labels nothing can be learnt: ``text`` is None, all score 1 and none is rejected.
    """

    text: Linear | None = None
    metadata: Linear | None = None
    both: Linear | None = None
    threshold: float = 0.0

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            one = np.ones(len(text))
            return one, one, one
        t, m = self.text.logit(text), self.metadata.logit(metadata)
        return tuple(np.round(_probability(v), 6) for v in (t, m, self.both.logit(np.column_stack([t, m]))))


def co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, held: np.ndarray, pool_text: np.ndarray, pool_metadata: np.ndarray) -> CoTrained:
    """Fit on labelled rows (``held`` of them kept back) and on the pool's rows as the views label them."""
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return CoTrained()
    views = {"text": (text, pool_text), "metadata": (metadata, pool_metadata)}
    given: dict[str, dict[int, float]] = {"text": {}, "metadata": {}}

    def fitted(name: str) -> Linear:
        own, pool = views[name]
        extra = given[name]
        x = np.vstack([own[~held], pool[list(extra)]]) if extra else own[~held]
        return fit(x, np.concatenate([y[~held], list(extra.values())])).calibrated(own[held], y[held])

    models = {name: fitted(name) for name in views}
    for _ in range(ROUNDS if len(pool_text) else 0):
        for name, other in (("text", "metadata"), ("metadata", "text")):
            p = _probability(models[name].logit(views[name][1]))
            free = np.array([k not in given[other] for k in range(len(p))])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(free & (sure >= SURE))
                best = best[np.argsort(-sure[best], kind="stable")][: PER_ROUND if label else PER_ROUND // 2]
                given[other].update((int(k), label) for k in best)
        models = {name: fitted(name) for name in views}
    joint = np.column_stack([models["text"].logit(text), models["metadata"].logit(metadata)])
    both = fit(joint[held], y[held], ridge=1.0)
    score = _probability(both.logit(joint[held]))
    return CoTrained(models["text"], models["metadata"], both, _threshold(score, y[held]))


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that separates best among those that keep ``KEEP_GOOD`` of the good documents."""
    values = np.unique(score)
    cuts = np.concatenate([[0.0], (values[1:] + values[:-1]) / 2])
    good, bad = np.sort(score[y == 1]), np.sort(score[y == 0])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    caught = np.searchsorted(bad, cuts) / len(bad)
    gain = np.where(kept >= KEEP_GOOD, caught + kept, -1)
    best = np.flatnonzero(gain == gain.max())
    return float(cuts[best[len(best) // 2]])


INPUTS = ("text", "lang", "source", "n_chars")


def _inputs() -> list[Column]:
    kinds = ("string", "string", "string", "double")
    return [text_of("text") if c == "text" else F.col(c).cast(k) for c, k in zip(INPUTS, kinds, strict=True)]


def _sampled(docs: DataFrame, ids: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the documents in ``ids(id)``, whose number the caller bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = text_features(batch.column("text")), metadata_features(*(batch.column(c) for c in INPUTS[1:]))
            packs = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (t, m)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *packs], names=["id", "t", "m"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *[c.alias(n) for n, c in zip(INPUTS, _inputs(), strict=True)])
    found = rows.join(F.broadcast(ids), "id", "left_semi").mapInArrow(run, "id long, t binary, m binary").collect()
    return {r.id: (np.frombuffer(r.t, np.float32), np.frombuffer(r.m, np.float32)) for r in sorted(found)}


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Co-train on at most ``labelled`` labelled and ``pool`` further documents, those with the smallest hashed ids.

    Labels that are null or belong to no document are left out before that; of repeated labels the lowest counts. A warning
    tells if there are labels but no model can be fitted.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y is not null")
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("y").alias("y"))
    order = F.xxhash64("id", F.lit(17))
    known = {r.id: float(r.y > 0) for r in marks.orderBy(order, "id").limit(labelled).collect()}
    others = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct().orderBy(order, "id").limit(labelled + pool)
    spark = docs.sparkSession
    ids = [*known, *[r.id for r in others.collect() if r.id not in known][:pool]]
    if not known:
        return CoTrained()
    features = _sampled(docs, spark.createDataFrame([(i,) for i in ids], "id long"))
    rows = [i for i in ids if i in known and i in features]
    if not rows:
        return CoTrained()
    free = [i for i in ids if i not in known and i in features]
    t, m = (np.array([features[i][k] for i in rows]) for k in (0, 1))
    pt, pm = (np.array([features[i][k] for i in free]).reshape(len(free), x.shape[1]) for k, x in ((0, t), (1, m)))
    y = np.array([known[i] for i in rows])
    held = mix(np.array(rows, np.int64).view(np.uint64)) % np.uint64(1000) < np.uint64(int(1000 * HELD_BACK))
    model = co_train(t, m, y, held, pt, pm)
    if model.text is None:
        warnings.warn(f"no quality model can be fitted on the {len(rows)} labelled documents; all documents are kept", stacklevel=2)
    return model


def scored(model: CoTrained) -> Column:
    """Struct (text_score, metadata_score, score) of a row, from the columns of ``INPUTS``."""

    @F.arrow_udf("text_score double, metadata_score double, score double")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        found = [
            model.scores(text_features(text.slice(a, b - a)), metadata_features(*(x.slice(a, b - a) for x in (lang, source, n_chars))))
            for first, last in slices(utf8(text)[1], CHUNK_BYTES)
            for a, b in ((k, min(k + ROWS, last)) for k in range(first, last, ROWS))
        ]
        parts = [np.concatenate(p) for p in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()) for p in parts], names=["text_score", "metadata_score", "score"])

    return run(*_inputs())


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, metadata_score, score, kept), one row per row of ``docs``.

    Scores are probabilities of good quality, rounded to six places. Null text is empty, null metadata is a label of its
    own, rows that repeat a doc_id are scored each by itself. Without labels of both classes all are kept with score 1.
    """
    model = train(docs, labels)
    rows = docs.select("doc_id", scored(model).alias("s")).select("doc_id", "s.*")
    return rows.withColumn("kept", F.col("score") >= F.lit(model.threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = train(docs, labels)
    rows = docs.select(packed(docs).alias("doc"), scored(model)["score"].alias("score"))
    return rows.filter(F.col("score") >= F.lit(model.threshold)).select("doc.*")
