"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties (per-coordinate steps, weights of exactly zero
where evidence is weak), then one temperature is fitted on rows kept apart.  Document frequencies come from all
training documents; only the rows the weights are fitted on are a bounded sample per label.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type, per_document

BITS = 15
ORDERS = (1, 2, 3)
BLOCK = 1 << 19  # characters handled at once
MOST_LABELS = 1000


class Model(NamedTuple):
    labels: list[str]
    table: np.ndarray  # (2 ** BITS, labels): inverse document frequency times weight
    bias: np.ndarray
    temperature: float


def letters_only() -> np.ndarray:
    """Code point to itself where it is a letter, else to a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def grams(texts: list[str], table: np.ndarray):
    """Blocks of ``(owners, features of each order)`` over all characters of all texts.

    Each text has two spaces before and one after it, so that no n-gram holds letters of two texts.
    """
    raw = np.frombuffer(("".join(f"  {t.lower()} " for t in texts) + "  ").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 3 for t in texts])
    n = len(owner)
    for at in range(0, n, BLOCK):
        code = table[raw[at : at + BLOCK + 2]]
        own = owner[at : at + BLOCK]
        a, b, c = code[: len(own)], code[1 : len(own) + 1], code[2 : len(own) + 2]
        hashes = (a * np.uint32(2654435761), a * np.uint32(2246822519) + b * np.uint32(3266489917) + np.uint32(1), a * np.uint32(668265263) + b * np.uint32(374761393) + c * np.uint32(2869860233) + np.uint32(7))
        yield own, [((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS) for h in hashes]


def _frequencies(df: DataFrame, text: str) -> np.ndarray:
    """In how many documents each feature occurs, and their number as the last entry."""

    def run(batches):
        table, total = letters_only(), np.zeros((1 << BITS) + 1, np.int64)
        for whole in batches:
            for t in whole.column(0).to_pylist():
                seen = np.zeros(1 << BITS, bool)
                for _, features in grams([t or ""], table):
                    for f in features:
                        seen[f] = True
                total[:-1] += seen
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["feature", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out


def _counts(df: DataFrame, text: str, label: str) -> list:
    """Sparse n-gram counts of the sampled rows."""

    def make():
        table = letters_only()

        def work(texts):
            rows = [np.sum([np.bincount(f, minlength=1 << BITS) for _, fs in grams([t], table) for f in fs], axis=0) for t in texts]
            at = [np.flatnonzero(r) for r in rows]
            return {"at": (at, pa.list_(pa.int32())), "n": ([r[i] for r, i in zip(rows, at)], pa.list_(pa.int32()))}

        return work

    return per_document(df, make, f"`{label}` string, at array<int>, n array<int>", [text, label]).collect()


def follow_the_leader(rows, y, n_labels, epochs=4, alpha=5.0, beta=1.0, l1=0.002, l2=0.01, seed=7):
    """Weights (features + 1, labels) of rows ``(features, values)``; the last weight is the bias."""
    bias = 1 << BITS
    z, n = np.zeros((bias + 1, n_labels)), np.zeros((bias + 1, n_labels))

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(bias + 1))


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the least log loss, on a grid of powers."""
    if not len(y):
        return 1.0

    def loss(t):
        s = scores / t
        return np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y])

    return float(min(np.geomspace(0.2, 20, 81), key=loss))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_label: int = 300) -> Model:
    """Learn from labelled rows; rows without a label are left out.

    Of each label the ``rows_per_label`` rows with the smallest hash of their id fit the weights (one in five of them
    the temperature); the n-gram statistics cover all rows.  Without any labelled row the model knows only ``und``.
    """
    df = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).filter("label IS NOT NULL")
    df = df.withColumn("h", F.xxhash64("id"))
    first = df.select("label", "h").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h")))
    chosen = first.filter(F.col("rank") <= rows_per_label).select("label", "h").distinct().limit(MOST_LABELS * rows_per_label).collect()
    labels = sorted({r["label"] for r in chosen})
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not labels:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    seen = _frequencies(df, "text")
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    sample = df.filter(F.col("h").isin([r["h"] for r in chosen])).dropDuplicates(["h", "label"])
    counted = sorted(_counts(sample, "text", "label"), key=lambda r: (r["label"], r["at"], r["n"]))
    rows, y = [], []
    for r in counted:
        at = np.array(r["at"], np.int64)
        n = np.array(r["n"], float)
        rows.append((at, n / max(1.0, n.sum()) * idf[at]))
        y.append(labels.index(r["label"]))
    y = np.array(y)
    apart = np.arange(len(rows)) % 5 == 4
    w = follow_the_leader([r for r, a in zip(rows, apart) if not a], y[~apart], len(labels))
    scores = np.array([x @ w[at] + w[-1] for (at, x), a in zip(rows, apart) if a]).reshape(-1, len(labels))
    return Model(labels, (idf[:, None] * w[:-1]).astype(np.float32), w[-1], calibrate(scores, y[apart]))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep, lang_pred, score`` of every whole text; nothing but the text is looked at.

    A text that is NULL or has no letter is ``und`` with score 0, as is every text when the model has no labels.
    Ties go to the label that sorts first.  Repeated rows give a row each; columns not named in
    ``keep`` are left out.  No shuffle.
    """

    def make():
        table = letters_only()

        def work(texts):
            k, m = len(model.labels), len(texts)
            sums, total = np.zeros((m, max(k, 1))), np.zeros(m)
            if k:
                for own, features in grams(texts, table):
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    values = sum(model.table[f] for f in features)
                    sums[own[starts]] += np.add.reduceat(values, starts, axis=0)
                    total += np.bincount(own, minlength=m) * len(features)
                s = (sums / np.maximum(total, 1)[:, None] + model.bias) / model.temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            else:
                p = sums
            known = [bool(k) and any(map(str.isalpha, t)) for t in texts]
            best = p.argmax(1)
            return {
                "lang_pred": ([model.labels[b] if ok else "und" for b, ok in zip(best, known)], pa.string()),
                "score": ([float(min(1.0, p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known))], pa.float64()),
            }

        return work

    passed = [id_col, *keep]
    schema = ", ".join(f"`{c}` {id_type(df, c)}" for c in passed)
    return per_document(df, make, f"{schema}, lang_pred string, score double", [text_col, *passed])


def held_out(id_col: str = "doc_id"):
    """Every third document by CRC-32 of its id as text; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1
