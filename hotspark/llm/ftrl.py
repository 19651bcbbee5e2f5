"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Tokens are runs of letters and digits and runs of other visible bytes, lower case;
features are the hashes of one and two neighbouring tokens (a token that repeats the
one before it also counts as the feature "repeat"). A feature's value is its share of
the text's features, times SCALE. Training follows the regularised leader, one text
at a time, on a bounded sample of labelled rows; a score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.llm.kernels import KINDS, LOWER, buffers, byte_values, map_texts, run_hashes, span_hashes, steps, within_rows, word_spans
from hotspark.session import materialize

BITS = 18
SCALE = 30.0
#: Labelled texts that training takes at most for each label value, about.
SAMPLE_PER_LABEL = 2000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.02, 0.5
_VALUES = byte_values(4)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their rows."""
    data = LOWER[data]
    first, last, woffs = word_spans(data, offs, KINDS)
    words = span_hashes(data, first, last, _VALUES)
    starts, rows2 = within_rows(woffs, 2)
    pairs = run_hashes(words, 2, 1)[starts] if len(starts) else np.zeros(0, np.uint64)
    if len(starts):
        pairs = np.where(words[starts] == words[starts + 1], np.uint64(12345), pairs)
    rows1 = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    return (np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([rows1, rows2])


class Model:
    """Weights of the hashed features and a bias."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.bias = bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        f, rows = features(data, offs)
        n = len(offs) - 1
        counts = np.bincount(rows, minlength=n)
        z = self.bias + SCALE * np.bincount(rows, self.weights[f], minlength=n) / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """FTRL-proximal over the texts, shuffled anew in each epoch."""
    if not texts:
        return Model()
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    examples = []
    data = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in steps(offs):
        f, rows = features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        order = np.argsort(rows, kind="stable")
        for part in np.split(f[order], np.cumsum(np.bincount(rows, minlength=j - i))[:-1]):
            at, counts = np.unique(part, return_counts=True)
            examples.append((np.append(at, 1 << BITS), np.append(SCALE * counts / max(1, len(part)), 1.0)))
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, x = examples[k]
            za, na = z[at], n[at]
            wa = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wa @ x, -35, 35)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] += g - sigma * wa
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model from a bounded sample: about `per_label` labelled rows of each label, drawn by a hash of the key.

    Keys without a label, labels other than 0 and 1 and null keys are left out; null
    texts count as empty. The labels are counted over all rows, and only the drawn ones
    meet their texts. If no text has a label, every score is one half.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    part = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(parts))
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (part < max(1, round(parts * min(1.0, per_label / n)))))
    # the drawn labels are few and written, so the planner knows their size and does not shuffle the texts
    drawn = materialize(rows.where(keep), "drawn")
    texts = docs.select(F.col(key).alias("k"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    sample = sorted((r["k"], r["y"], bytes(r["t"])) for r in texts.join(drawn, "k").select("k", "y", "t").toLocalIterator())
    return fit([t for _, _, t in sample], [y for _, y, _ in sample])


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Kept columns, score (0 to 1) and predicted (1 if score >= threshold).

    A null or empty text is scored by the bias alone; equal texts get equal scores; a
    text of any length is read whole; an empty table gives an empty one; kept columns
    with the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        m = shared.value

        def run(column):
            data, offs = buffers(column)
            parts = [m.scores(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in steps(offs)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return run

    return map_texts(df, text, list(keep if keep is not None else df.columns), fields, make)
