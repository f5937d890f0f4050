"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text are all it learns from, besides the class prior.  With the loss l, the risk of
taking unlabelled text for negative, less the share of it that the prior says is positive,

    negative(f) = mean over unlabelled of l(-f) - prior * mean over positives of l(-f),

estimates the risk on negatives.  It can't be negative; where the estimate falls below zero, which is overfitting, the
step goes up its slope instead (Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator").
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_arrow, ship_by_value
from lacuna.llm.jaccard import sliced

ship_by_value(__name__)

#: Classes of bytes; their trigrams describe the shape of a text in any language.
CLASSES = 8
SHAPES = CLASSES**3
FEATURES = SHAPES + 4
POSITIVES = 4_000
UNLABELLED = 12_000
STEPS = 200
RATE = 0.05
DECAY = 1e-4


def byte_classes() -> np.ndarray:
    """Blank, line break, upper case, digit, full stop or comma, exclamation or question mark, other sign, letter."""
    out = np.full(256, 7)
    out[:128] = [6 if not chr(c).isalnum() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 7 for c in range(128)]
    for k, chars in enumerate((b" \t\r\x0b\x0c", b"\n")):
        out[list(chars)] = k
    out[list(b".,;:'")] = 4
    out[list(b"!?")] = 5
    return out


def features(texts: pa.Array) -> np.ndarray:
    """float32[texts, FEATURES]: square roots of the shares of shape trigrams, length, repetition and word length."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    kind = byte_classes()[raw]
    owner = np.repeat(np.arange(len(texts)), size)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(raw) > 2:
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        inside = owner[:-2] == owner[2:]
        flat = np.bincount((owner[:-2] * SHAPES + code)[inside], minlength=len(texts) * SHAPES).reshape(len(texts), SHAPES)
        out[:, :SHAPES] = np.sqrt(flat / np.maximum(1, flat.sum(axis=1, keepdims=True)))
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))[real]
    word = flat.filter(pa.array(real)).dictionary_encode().indices.to_numpy().astype(np.int64)
    n = np.bincount(of, minlength=len(texts))
    same = np.bincount(of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))
    distinct = np.bincount(np.unique(of << 32 | word) >> 32, minlength=len(texts))
    out[:, SHAPES] = np.log1p(n)
    out[:, SHAPES + 1] = same / np.maximum(1, n)
    out[:, SHAPES + 2] = distinct / np.maximum(1, n)
    out[:, SHAPES + 3] = np.log1p(size / np.maximum(1, n))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear function of least non-negative risk with the logistic loss, by Adam on all rows."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fp, fu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))  # slopes of l(-f)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope = su @ u / len(u) - prior * (sp @ p) / len(p)
        gradient = prior * ((sp - 1) @ p) / len(p) + slope if negative >= 0 else -slope
        gradient[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, bound: int) -> np.ndarray:
    """Features of about ``bound`` rows, chosen by a hash of the id and in its order."""
    total = docs.count()
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003))
    chosen = docs.select("id", "text", draw.alias("draw")).where(F.col("draw") < 1_000_003 * bound / max(1, total))

    def run(batches):
        for batch in batches:
            for at, texts in sliced(batch.column(1)):
                rows = pa.array([x.tobytes() for x in features(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, len(texts)), rows], names=["draw", "x"])

    rows = chosen.mapInArrow(run, "draw long, x binary").toArrow().sort_by([("draw", "ascending"), ("x", "ascending")])
    return np.array([np.frombuffer(x.as_py(), np.float32) for x in rows.column("x")]).reshape(-1, FEATURES)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> QualityModel:
    """Fit on a bounded sample: about ``positives`` rows labelled 1 and ``unlabelled`` rows whatever their label.

    ``labels`` has id and label.  The class prior is the share of 1 among the labels that are not null; negatives serve
    for nothing else.  Null ids and texts of null are left out of the sample.  Without positives or unlabelled rows the
    model gives the prior, one half without labels.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").distinct()
    row = known.agg(F.avg(F.col("label").cast("double")).alias("prior")).first()
    prior = 0.5 if row["prior"] is None else float(np.clip(row["prior"], 0.01, 0.99))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    p = _sample(texts.join(known.where("label = 1").select("id").distinct(), "id", "left_semi"), positives)
    u = _sample(texts, unlabelled)
    if not len(p) or not len(u):
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(prior / (1 - prior))), prior)
    mean, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-3)
    weight, bias = minimise((p - mean) / scale, (u - mean) / scale, prior)
    return QualityModel(mean, scale, weight, bias, prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Append ``score``, 0 to 1, to every row: the estimated probability that its whole text is of quality.

    Null texts score as empty ones.  Repeated rows score alike; a ``score`` column of the input is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # a plain dict, as the workers may lack the package
    position = docs.drop("score").columns.index(text)

    def make():
        model = QualityModel(**shared.value)

        def compute(batch: pa.RecordBatch) -> list:
            parts = [model.score(features(texts)) for _, texts in sliced(batch.column(position))]
            return [pa.array(np.concatenate(parts))]

        return compute

    return map_arrow(docs, [T.StructField("score", T.DoubleType())], make)
