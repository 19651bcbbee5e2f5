"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's
maximum over the window feeds a softmax. The network is trained in numpy on a bounded
sample of labelled texts and applied to all windows of every whole text; a text's
prediction is the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.llm.kernels import LOWER, buffers, map_texts

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 6
#: Labelled texts (one window each) that training takes at most per language, about.
SAMPLE_PER_LANGUAGE = 1500
EPOCHS = 12
#: Windows that one numpy step takes.
STEP_WINDOWS = 48


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each window; a row of n bytes has ceil(n / WINDOW)."""
    sizes = np.diff(offs)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    ends = np.cumsum(counts)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    starts = offs[:-1][rows] + k * WINDOW
    return starts, np.minimum(WINDOW, offs[1:][rows] - starts), rows


def cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The windows as rows of bytes, lower case, filled up with spaces."""
    at = starts[:, None] + np.arange(WINDOW)
    out = LOWER[data[np.minimum(at, len(data) - 1)]]
    out[np.arange(WINDOW) >= lengths[:, None]] = 32
    return out


class Network:
    """Embedding, filters in one matrix (narrow ones padded with zeros), dense layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n, widest = FILTERS * len(WIDTHS), max(WIDTHS)
        self.languages = list(languages)
        self.embed = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.mask = np.zeros((widest, DEPTH, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS:(k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(widest * DEPTH, n)
        self.filters = (rng.normal(0, 0.4, (widest * DEPTH, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.2, (n, len(languages))).astype(np.float32)
        self.out = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Each position's bytes under the widest filter, embedded: (rows, positions, width * depth)."""
        e = self.embed[x]
        w = max(WIDTHS)
        flat = e.reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, w * DEPTH, axis=1)[:, ::DEPTH]
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.columns(x)
        h = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(x), c.shape[1], -1)
        return h, np.maximum(h.max(axis=1) + self.bias, 0), c

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[1] @ self.dense + self.out
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross entropy; only the filters' maxima pass gradients on."""
        rng = np.random.default_rng(seed)
        names = ["embed", "filters", "bias", "dense", "out"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for part in np.array_split(order, max(1, len(order) // 32)):
                t += 1
                xb, yb = x[part], y[part]
                h, p, c = self.pooled(xb)
                z = p @ self.dense + self.out
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(yb)), yb] -= 1
                z /= len(yb)
                dp = (z @ self.dense.T) * (p > 0)
                at = h.argmax(axis=1)
                under = c[np.arange(len(xb))[:, None], at]  # rows, filters, width * depth
                df = np.einsum("nf,nfk->kf", dp, under) * self.mask
                de = np.zeros_like(self.embed)
                back = (dp[:, :, None] * self.filters.T[None]).reshape(len(xb), dp.shape[1], max(WIDTHS), DEPTH)
                for k in range(max(WIDTHS)):
                    np.add.at(de, xb[np.arange(len(xb))[:, None], at + k], back[:, :, k])
                grads = {"embed": de, "filters": df, "bias": dp.sum(0), "dense": p.T @ z, "out": z.sum(0)}
                rate = 0.01 * (1 - epoch / epochs)
                for k in names:
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.01 * (grads[k] ** 2 - v[k])
                    step = m[k] / (1 - 0.9 ** t) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-6)
                    setattr(self, k, (getattr(self, k) - rate * step).astype(np.float32))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Network:
    """A network from a bounded sample of rows with text and language.

    The languages and their frequencies are counted over all rows. From each language
    about `per_language` rows are drawn by a hash of the key and the text, and of each
    text one window at a hashed place. Without labelled rows the network knows no language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    net = Network(languages)
    if not languages:
        return net
    parts = 1 << 20
    keep = F.lit(False)
    for name in languages:
        keep = keep | ((F.col("l") == name) & (F.pmod(F.col("h"), F.lit(parts)) < max(1, round(parts * min(1.0, per_language / counts[name])))))
    start = 1 + F.pmod(F.shiftright("h", 21), F.greatest(F.length("t") - WINDOW, F.lit(1)))
    sample = rows.where(keep).select("l", "h", F.substring(F.col("t"), start.cast("int"), F.lit(WINDOW)).alias("t")).orderBy("h", "l", "t").collect()
    raw = [r["t"].encode()[:WINDOW] for r in sample]
    data, lengths = np.frombuffer(b"".join(raw) or b" ", np.uint8), np.array([len(r) for r in raw])
    x = cut(data, np.cumsum(lengths) - lengths, lengths)
    y = np.array([languages.index(r["l"]) for r in sample])
    if len(y):
        net.fit(x, y)
    return net


def identify(df: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, lang_pred and score (the probability of lang_pred).

    A null or empty text, one without a letter, and any text if no language was learned
    is `und` with score 0. Equal texts get equal results; a text of any length is read
    whole; an empty table gives an empty one; kept columns with the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    letter = "_has_letter"
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        model = shared.value

        def run(column):
            data, offs = buffers(column)
            n, k = len(offs) - 1, len(model.languages)
            if not k:
                return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))]
            starts, lengths, rows = windows(data, offs)
            total = np.zeros((n, k))
            for a in range(0, len(starts), STEP_WINDOWS):
                b = a + STEP_WINDOWS
                p = model.predict(cut(data, starts[a:b], lengths[a:b])).astype(float) * lengths[a:b, None]
                np.add.at(total, rows[a:b], p)
            total /= np.maximum(np.diff(offs), 1)[:, None]
            best = total.argmax(axis=1)
            names = np.array(model.languages, object)[best]
            return [pa.array(names, pa.string()), pa.array(np.minimum(total[np.arange(n), best], 1.0))]

        return run

    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score", letter)]
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = map_texts(df.withColumn(letter, has), text, [*columns, letter], fields, make)
    und = ~F.col(letter)
    return out.select(
        *(F.col(f"`{c}`") for c in columns),
        F.when(und, F.lit("und")).otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(und, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
    )
