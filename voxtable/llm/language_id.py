"""Language identification by a byte convolutional network: filters of several widths, max pooling, softmax.

Trained in numpy on windows of a bounded sample of labelled documents. A text is
read whole, in windows of fixed length that overlap by one filter less a byte, so
every run of bytes is seen by every filter once; the windows' chances are
averaged. For reading, embedding and filter are multiplied out into tables for
bytes and pairs of bytes, and a filter's output is a sum of table rows.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtable.llm.common import fold_column, over_batches, text_column

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that training takes, at most about, shared among the languages, and windows from each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 4000, 4
#: Documents of each language that training takes at least, about, if there are as many.
LEAST_ROWS = 20
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
EPOCHS, BATCH, RATE = 8, 128, 0.004
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Byte classes: 0 pads; white space, digits and other ASCII are one class each; letters without case; high bytes each.
CLASS_OF = bytes(1 if b in b" \t\n\x0b\x0c\r" else 2 if 48 <= b <= 57 else 4 + (b | 32) - 97 if 97 <= b | 32 <= 122 and b < 128 else 3 if b < 128 else 30 + b - 128 for b in range(256))
CLASSES = 30 + 128
STRIDE = WINDOW - max(WIDTHS) + 1
SLAB = 512


def windows(text: bytes) -> np.ndarray:
    """All windows of the text's byte classes, padded at the end."""
    codes = np.frombuffer(text.translate(CLASS_OF), np.uint8)
    n = max(1, -(-(len(codes) - WINDOW + STRIDE) // STRIDE))
    padded = np.zeros(STRIDE * (n - 1) + WINDOW, np.uint8)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class Network:
    """Weights; the training and the reading pass."""

    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBEDDING)).astype(np.float32)
        self.filters = {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy and its gradients, in the order of weights()."""
        e = self.embed[x]
        rows = np.arange(len(x))[:, None]
        pooled, spots = [], []
        for w, f in self.filters.items():
            n = WINDOW - w + 1
            z = sum(e[:, j : j + n] @ f[j] for j in range(w))
            best = z.argmax(axis=1)
            spots.append(best)
            pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        logits = h @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(y)), y] + 1e-9).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        for i, (w, f) in enumerate(self.filters.items()):
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS]
            df = np.zeros_like(f)
            for j in range(w):
                at = spots[i] + j
                df[j] = np.einsum("bf,bfd->df", dz, e[rows, at])
                np.add.at(d_embed, x[rows, at].ravel(), (dz[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
            d_filters.append(df)
        return loss, [d_embed, *d_filters, dh.sum(axis=0), h.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        step, mean = 0, 0.0
        for _ in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for k in range(0, len(x), BATCH):
                some = order[k : k + BATCH]
                loss, gradients = self.gradients(x[some], y[some])
                losses.append(loss)
                step += 1
                rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for w, g, a, b in zip(self.weights(), gradients, first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * a / (np.sqrt(b) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def tables(self) -> tuple:
        """What reading needs: a row for each byte or pair of bytes and each part of a filter."""
        one = {w: [self.embed @ f[j] for j in range(w)] for w, f in self.filters.items()}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        return pair(*one[2]), pair(*one[3][:2]), one[3][2], pair(*one[4][:2]), pair(*one[4][2:]), self.bias, self.out, self.out_bias


def chances(tables: tuple, x: np.ndarray) -> np.ndarray:
    """Chance of each language for each window."""
    two, three, third, four, fourth, bias, out, out_bias = tables
    x = x.astype(np.int32)
    pair = x[:, :-1] * CLASSES + x[:, 1:]
    pooled = [two[pair].max(axis=1)]
    z = three[pair[:, :-1]]
    z += third[x[:, 2:]]
    pooled.append(z.max(axis=1))
    z = four[pair[:, :-2]]
    z += fourth[pair[:, 2:]]
    pooled.append(z.max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1) + bias, 0) @ out + out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _sample_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Evenly spread windows of each text with letters."""
    langs, found = [], []
    for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = t.as_py()
        if has_letter(text.decode(errors="replace")):
            own = windows(text)
            for k in sorted({int(i * len(own) / SAMPLE_WINDOWS) for i in range(SAMPLE_WINDOWS)}):
                langs.append(lang)
                found.append(own[k].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang") -> tuple[list[str], tuple]:
    """(languages, tables) from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    known = docs.select("doc_id", F.col(lang).cast("string").alias("lang"), text_column(text).alias("t")).filter(F.col("lang").isNotNull() & (fold_column(FOLDS) != HELD_OUT))
    sizes = known.groupBy("lang").agg(F.count_distinct("doc_id").alias("count")).collect()
    if not sizes:
        return [], ()
    each = max(LEAST_ROWS, rows / len(sizes))
    shares = spark.createDataFrame([(r["lang"], min(1.0, each / max(1, r["count"]))) for r in sizes], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.join(F.broadcast(shares), "lang").withColumn("chance", chance).filter(F.col("chance") < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", F.xxhash64("t"), F.sha2("t", 256)))  # however many rows an id has, each language keeps its share
    chosen = drawn.withColumn("nth", nth).filter(F.col("nth") <= 2 * int(each)).select("lang", "t")
    found = sorted((r["lang"], bytes(r["window"])) for r in chosen.mapInArrow(over_batches(_sample_windows), "lang string, window binary").collect())
    langs = sorted({g for g, _ in found})
    if not langs:
        return [], ()
    x = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    y = np.array([langs.index(g) for g, _ in found])
    network = Network(len(langs))
    network.fit(x, y)
    return langs, network.tables()


def _predict(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, tables = shared.value
    texts = [t.as_py() for t in batch.column(2)]
    told = np.zeros((len(texts), max(1, len(langs))))
    open_: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        x = np.concatenate([w for _, w in open_])
        owner = np.repeat([i for i, _ in open_], [len(w) for _, w in open_])
        weight = np.count_nonzero(x, axis=1)
        np.add.at(told, owner, chances(tables, x) * weight[:, None])
        open_.clear()

    held = 0
    lettered = [bool(langs) and has_letter(t.decode(errors="replace")) for t in texts]
    for i, (text, ok) in enumerate(zip(texts, lettered)):
        if ok:
            own = windows(text)
            for k in range(0, len(own), SLAB):
                open_.append((i, own[k : k + SLAB]))
                held += len(open_[-1][1])
                if held >= SLAB:
                    flush()
                    held = 0
    if open_:
        flush()
    best = told.argmax(axis=1)
    total = told.sum(axis=1)
    score = np.where(total > 0, told.max(axis=1) / np.where(total > 0, total, 1), 0.0)
    names = [langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: tuple[list[str], tuple], text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    The text alone decides. Null, empty and letterless texts are `und` with score
    0, as are all texts if there was nothing to learn from. A null id's fold is
    that of the empty text. Repeated rows are each predicted. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), (fold_column(FOLDS) == HELD_OUT).alias("held_out"), text_column(text))
    return rows.mapInArrow(over_batches(partial(_predict, shared)), "doc_id long, held_out boolean, lang_pred string, score double")
