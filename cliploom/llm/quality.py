"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import utf8
from cliploom.llm.labelled import held_out, sample

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~",
    "bracket": b"()[]\"'",
    "line": b"\n",
    "other": range(128, 256),
}
_MASK = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MASK[list(_c), _i] = 1

NAMES = (*_CLASSES, "words", "word_bytes", "distinct", "stutter", "lines_again", "symbol_words", "short_words", "empty")


def features(text: bytes) -> np.ndarray:
    """A text's features: shares of character classes, lengths and repetition; zeros for empty ones."""
    x = np.zeros(len(NAMES))
    words = text.split()
    if not words:
        x[-1] = 1
        return x
    k = len(_CLASSES)
    x[:k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASK / len(text)
    n = len(words)
    lines = [s for s in text.split(b"\n") if s]
    x[k] = np.log1p(n)
    x[k + 1] = np.log1p(sum(map(len, words)) / n)
    x[k + 2] = len(set(words)) / n ** 0.8
    x[k + 3] = sum(map(eq, words, words[1:])) / n
    x[k + 4] = 1 - len(set(lines)) / len(lines) if lines else 0
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    x[k + 5] = _MASK[ends, list(_CLASSES).index("symbol")].mean() + _MASK[ends, list(_CLASSES).index("shout")].mean()
    x[k + 6] = sum(len(w) < 3 for w in words) / n
    return x


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and f array<double> for each row of docs (text)."""
    kept = docs.select(*keep, utf8().alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", f array<double>"

    def run(batches):
        for batch in batches:
            f = np.array([features(t) for t in batch.column("_t").to_pylist()]).reshape(-1, len(NAMES))
            flat = pa.ListArray.from_arrays(np.arange(0, f.size + 1, len(NAMES), dtype=np.int32), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*keep, "f"])

    return kept.mapInArrow(run, schema)


def fit(rows: list[tuple[list[float], int]], pairs: int = 60_000, ridge: float = 1e-3) -> dict:
    """Bradley-Terry scores s(x) = w.x from preference pairs, and the score below which documents go.

    Each pair sets a document of label 1 before one of label 0; P(first preferred) is
    sigmoid(w.(x1 - x0)), and w minimises the mean logistic loss of the feature differences with a
    small ridge, by Newton steps. The threshold is the quantile of the sample's scores at its share of
    label 0, half way to the next score. rows are bounded by the sample's documented size.
    """
    x = np.array([r[0] for r in rows]).reshape(-1, len(NAMES))
    y = np.array([r[1] for r in rows])
    if not len(x) or y.min() == y.max():
        return {"mean": np.zeros(len(NAMES)), "scale": np.ones(len(NAMES)), "w": np.zeros(len(NAMES)), "at": -1.0, "spread": 1.0}
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(0)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    k = int((y == 0).sum())
    return {"mean": mean, "scale": scale, "w": w, "at": float(s[k - 1] + s[k]) / 2, "spread": float(s.std() / 4 + 1e-9)}


def quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Learns from at most `most` labelled rows outside the held-out fold; labels, lang, source and
    doc_id are no inputs of a score. Every row of docs is scored by its whole text; null and empty
    texts have a score like any other, null doc_ids aren't held out, repeated rows are scored alike,
    without usable labels every score is above one half, and an empty table gives no rows.
    """
    model = fit(_bounded(featured(sample(docs, labels, "quality", most), "doc_id", "label")))
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _bounded(rows: DataFrame) -> list[tuple[list[float], int]]:
    """The training sample's features on the driver; the sample is bounded by its parameter."""
    return sorted((r["f"], r["label"]) for r in rows.select("f", "label").collect())


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score` instead of `text`."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("_t").to_pylist()]).reshape(-1, len(NAMES))
            s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
            p = 1 / (1 + np.exp(-np.clip((s - model["at"]) / model["spread"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*keep, "score"])

    given = docs.select(*keep, utf8().alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]) + ", score double"
    return given.mapInArrow(run, schema)


def without_rejects(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """docs whose score is at least one half, all columns kept."""
    model = fit(_bounded(featured(sample(docs, labels, "quality", most), "doc_id", "label")))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            s = np.clip((np.array([features(t) for t in texts]).reshape(-1, len(NAMES)) - model["mean"]) / model["scale"], -8, 8)
            yield batch.filter(pa.array(s @ model["w"] >= model["at"]))

    return docs.mapInArrow(run, docs.schema)
