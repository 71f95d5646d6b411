"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),
so pairs of features cost no more than the features themselves.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import bounded_labels, label_fold

WORD_BITS, RANK = 14, 8
STATS = 14
#: Feature indexes: hashed words, then one bin of each statistic, then metadata bins.
BINS, META_BINS = 12, 24
#: Labelled documents a model is fitted on, at most.
TRAIN_LIMIT = 8000
RESULT = ("score", "held_out", "predicted")
STOP_MARKS = ".,;:!?\"'()"


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text as numbers from 0 to 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    kept = Counter(lines)
    top = counts.most_common(1)[0][1] if counts else 0
    joined = "".join(counts)
    joined_n = max(1, len(joined))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    short = sum(c for w, c in counts.items() if len(w) == 1)
    marks = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    odd_end = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in STOP_MARKS)
    ends = sum(c for w, c in counts.items() if w[-1] in ".!?")
    return [
        min(1.0, math.log1p(n) / 10),
        len(counts) / n,
        top / n,
        repeats / n,
        short / n,
        marks / n,
        odd_end / n,
        ends / n,
        min(1.0, sum(len(w) * c for w, c in counts.items()) / n / 20),
        sum(map(str.isdigit, joined)) / joined_n,
        sum(1 for c in joined if not c.isalnum()) / joined_n,
        min(1.0, math.log1p(len(lines)) / 8),
        1 - len(kept) / len(lines),
        min(1.0, chars / n / 25),
    ]


def features(text: str | None, meta: Sequence = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; words have length one together."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    hashed: dict[int, float] = {}
    for w, c in counts.items():
        at = zlib.crc32(w.encode()) & ((1 << WORD_BITS) - 1)
        hashed[at] = hashed.get(at, 0) + c
    index = np.fromiter(hashed, np.int32, len(hashed))
    value = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
    value /= max(1e-6, float(np.sqrt((value * value).sum())))
    base, more = 1 << WORD_BITS, []
    for k, x in enumerate(statistics(text, words, counts)):
        more.append(base + k * BINS + min(BINS - 1, int(BINS * math.sqrt(max(0.0, x)))))
    base += STATS * BINS
    for k, m in enumerate(meta):
        level = META_BINS - 1 if m is None or m != m else min(META_BINS - 2, int(abs(float(m)) + 1).bit_length())
        more.append(base + k * META_BINS + level)
    scale = np.float32(1 / math.sqrt(STATS))
    return np.concatenate([index, np.array(more, np.int32)]), np.concatenate([value, np.full(len(more), scale, np.float32)])


class FactorisationMachine:
    def __init__(self, n: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.05, (n, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and sum_i v_if x_i; each row has at least one feature."""
        xv = self.v[index] * value[:, None]
        s = np.add.reduceat(xv, starts, axis=0)
        pairs = (s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * pairs, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, rate: float = 0.05, l2: float = 2e-5, seed: int = 7) -> None:
        """AdaGrad over mini-batches of the log loss."""
        rng, n = np.random.default_rng(seed), len(y)
        self.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        gw, gv, g0 = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(n)
            for b in range(0, n, 64):
                some = order[b : b + 64]
                index = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                lens = np.array([len(rows[i][0]) for i in some])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                z, s = self.raw(index, value, starts)
                d = (1 / (1 + np.exp(-z)) - y[some]).astype(np.float32)
                per = np.repeat(d, lens) * value
                grad_v = per[:, None] * (np.repeat(s, lens, axis=0) - self.v[index] * value[:, None])
                at, inverse = np.unique(index, return_inverse=True)
                sw, sv = np.zeros(len(at), np.float32), np.zeros((len(at), self.v.shape[1]), np.float32)
                np.add.at(sw, inverse, per)
                np.add.at(sv, inverse, grad_v)
                sw, sv = sw + l2 * n / 64 * self.w[at], sv + l2 * n / 64 * self.v[at]
                gw[at] += sw * sw
                gv[at] += sv * sv
                self.w[at] -= rate * sw / np.sqrt(gw[at])
                self.v[at] -= rate * sv / np.sqrt(gv[at])
                g0 += float(d.sum()) ** 2
                self.w0 -= rate * float(d.sum()) / math.sqrt(g0)


def _featured(batches):
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        got = [features(text, meta) for text, *meta in zip(*cols[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
            ["label", "index", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, label: str, allowed, metadata: Sequence[str] = (), limit: int = TRAIN_LIMIT) -> FactorisationMachine | None:
    """A model from at most about `limit` labelled documents for which `allowed` (over doc_id) holds; None without any."""
    chosen = bounded_labels(labels.select("doc_id", label), label, allowed, limit)
    meta = [F.col(m).cast("double").alias(f"_m{k}") for k, m in enumerate(metadata)]
    rows = docs.select("doc_id", F.struct(F.col("text").cast("string").alias("text"), *meta).alias("row"))
    rows = rows.join(F.broadcast(chosen), "doc_id")
    # one row an id, however often the id is repeated, so that the bound on labels is one on rows
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("row", F.xxhash64("row")).alias("row"))
    rows = rows.select("label", "row.text", *[f"row._m{k}" for k in range(len(metadata))])
    got = rows.mapInArrow(_featured, "label int, index binary, value binary").toArrow().to_pylist()
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], zlib.crc32(r["index"]), r["index"]))  # the order of arrival must not matter
    model = FactorisationMachine((1 << WORD_BITS) + STATS * BINS + len(metadata) * META_BINS)
    pairs = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got]
    model.fit(pairs, np.array([r["label"] for r in got], np.float32))
    return model


def score(docs: DataFrame, model: FactorisationMachine | None, metadata: Sequence[str] = ()) -> DataFrame:
    """`docs` with column `score` (0 to 1) added, in place of any of that name; without a model every score is 0.5."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            out = np.full(n, 0.5)
            if model is not None:
                for a in range(0, n, 256):
                    some = batch.slice(a, 256)
                    cols = [c.to_pylist() for c in some.columns[1:]]
                    got = [features(text, meta) for text, *meta in zip(*cols, strict=True)]
                    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])[:-1]]).astype(np.int64)
                    z, _ = model.raw(np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got]), starts)
                    out[a : a + len(got)] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["kept", "score"])

    kept = [c for c in docs.columns if c.lower() not in RESULT]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col("text").cast("string").alias("text"), *[F.col(m).cast("double").alias(f"_m{k}") for k, m in enumerate(metadata)]
    )
    schema = packed.select("kept").schema.add("score", "double")
    return packed.mapInArrow(run, schema).select("kept.*", "score")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, threshold: float = 0.7, metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """`docs` with score, held_out and predicted; the model learns from labels outside the held-out fold only.

    Defined cases: null and empty texts are scored as empty; labels that
    disagree count by majority; null labels and ids teach nothing; without
    labels every score is 0.5; repeated rows are scored each; an id with
    several texts teaches with one of them; columns called score, held_out or
    predicted are replaced and all others kept as they are; an empty table
    gives an empty result.
    """
    fold = label_fold(F.col("doc_id"), modulus) == held_out
    have = [m for m in metadata if m in docs.columns]
    model = train(docs, labels, label, ~fold, have)
    out = score(docs, model, have)
    return out.withColumn("held_out", fold).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
