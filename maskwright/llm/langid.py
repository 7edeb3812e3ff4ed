"""Language identification by averaged hashed subword embeddings.

A text is the bag of its byte n-grams (1 to 4 bytes of UTF-8, ASCII letters lower-cased, anything else ASCII as one blank),
each hashed to one of `buckets` embedding rows. The mean embedding goes through a linear softmax. Embeddings and softmax
are trained together by stochastic gradient descent in numpy. As everything after the lookup is linear, prediction uses
one table of class logits for each bucket, so that a whole text is summed in one pass, whatever its length.

Confidence is calibrated on a part of the training documents that is kept out of the descent, over their whole texts, as in
prediction: a temperature of at least 1 minimises their log loss, and `rejected` marks scores below a floor, the higher of two: the lowest
score that keeps the stated precision there, and the score that all but `1 - precision` of them reach, so that texts unlike
all that was learnt are told even where no mistake was seen.

Bounds: at most `max_rows` training documents (those with the smallest hash of doc_id). Their whole texts are cut into windows
of `width` bytes, any of which may be learnt from; at most `max_windows` are (those with the smallest hash). Prediction reads
whole texts.

Defined cases. A row may be learnt from only if doc_id, text and lang are not null and crc32(doc_id as text) mod 4 is not
2; a null doc_id is not held out and not learnt from. Null texts and texts without a letter: `und`, score 0, rejected. No
training row at all: `und`, score 0, for every row. One language only: that one, score 1. Repeated rows and ties are
predicted each; equal class scores go to the smaller code.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import lowest, map_arrow, pieces, prepare, saved, strings, table, utf8

ORDERS = (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


#: Bytes as the model sees them: lower case, non-letters of ASCII all alike.
FOLD = np.array([ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)), np.uint32)


class Model(NamedTuple):
    """logits: a row of class logits for each bucket; bias: a logit for each class; langs: the classes, sorted."""

    langs: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float


def hashed(data: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each n-gram order, the bucket of the n-gram that begins at each byte (the last n - 1 have none)."""
    b = FOLD[data]
    out, h = [], np.zeros(len(b), np.uint32)
    for n in ORDERS:
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
        g = h ^ (h >> np.uint32(15))
        g = g * np.uint32(0x85EBCA6B)
        out.append(((g ^ (g >> np.uint32(13))) % np.uint32(buckets)).astype(np.int32))
    return out


def row_logits(data: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Mean class logits of each row. n-grams do not cross rows."""
    n = np.diff(off)
    total = np.zeros((len(n), len(model.langs)))
    count = np.zeros(len(n))
    full = np.flatnonzero(n > 0)
    starts = off[:-1][full]
    for k, h in enumerate(hashed(data, len(model.logits)), 1):
        values = model.logits[h]
        # what begins in the last k - 1 bytes of a row runs into the next one
        for d in range(1, k):
            at = off[1:] - d
            values[at[(at >= off[:-1]) & (at < len(values))]] = 0
        inside = starts < len(values)
        total[full[inside]] += np.add.reduceat(values, starts[inside], axis=0, dtype=np.float64)
        count += np.maximum(n - k + 1, 0)
    return total / np.maximum(count, 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def descend(grams: list[np.ndarray], y: np.ndarray, classes: int, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SGD over minibatches; grams: the buckets of each training window. Returns embeddings, softmax weights and bias."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    size, steps = 32, 0
    total = max(1, epochs * -(-len(grams) // size))
    for _ in range(epochs):
        order = rng.permutation(len(grams))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            lens = np.array([len(grams[r]) for r in rows])
            flat = np.concatenate([grams[r] for r in rows])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(e[flat], starts, axis=0) / lens[:, None]
            g = softmax(mean @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * (1 - steps / total)
            back = (g @ w.T / lens[:, None]).astype(np.float32)
            w -= lr * mean.T @ g / len(rows)
            b -= lr * g.mean(axis=0)
            # buckets of the batch, each with the sum of its gradients
            used, at = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), lens)
            hits = np.bincount(at * len(rows) + owner, minlength=len(used) * len(rows)).reshape(len(used), len(rows)).astype(np.float32)
            e[used] -= lr * dim * (hits @ back)
            steps += 1
    return e, w, b


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def calibrated(z: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """Temperature and floor from logits and classes of texts that were not learnt from."""
    loss = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(1, 10, 41)}
    temperature = float(min(loss, key=loss.get))
    p = softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    exact = score[order][good[-1]] if len(good) else 1.0
    return temperature, float(max(exact, np.sort(score)[int((1 - precision) * len(score))]))


def train(docs: DataFrame, max_rows: int = 6_000, max_windows: int = 18_000, width: int = 240, buckets: int = 1 << 14, dim: int = 16, epochs: int = 4, least_steps: int = 400, rate: float = 1.0, precision: float = 0.99, seed: int = 7) -> Model | None:
    """Fit on rows that are not held out; None if there are none."""
    prepare(docs.sparkSession)
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, parts, marks, places = [], [], [], []
        for h, lang, text in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), strings(batch.column("text")), strict=True):
            if has_letter(text):
                raw = text.encode()
                for at in range(0, len(raw), width):
                    langs.append(lang)
                    marks.append(h)
                    places.append(at)
                    parts.append(raw[at : at + width])
        return pa.RecordBatch.from_pydict({"h": pa.array(marks, pa.int64()), "at": pa.array(places, pa.int64()), "lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.binary())})

    ids = F.broadcast(lowest(known.select("doc_id").distinct(), max_rows, "doc_id"))  # at most max_rows ids
    chosen = saved(known.join(ids, "doc_id").withColumn("h", F.xxhash64("doc_id", "text")), "lang-chosen")
    fifth = F.pmod("h", F.lit(5)) == 0
    langs = tuple(sorted(r.lang for r in chosen.filter(F.col("text").rlike(r"\p{L}")).select("lang").distinct().collect()))
    if not langs:
        return None
    if len(langs) == 1:
        return Model(langs, np.zeros((buckets, 1), np.float32), np.zeros(1), 1.0, 0.0)
    windows = saved(map_arrow(chosen.select("h", "lang", "text"), cut, "h long, at long, lang string, part binary"), "lang-windows")
    apart = windows.filter(~fifth).select("lang").distinct().count() == len(langs) and not windows.filter(fifth).isEmpty()
    rows = lowest(windows.filter(~fifth) if apart else windows, max_windows, "h", "at", "lang", "part").collect()
    y = np.array([langs.index(r.lang) for r in rows])
    grams = [np.concatenate(hashed(np.frombuffer(bytes(r.part), np.uint8), buckets)) for r in rows]
    epochs = max(epochs, least_steps * 32 // len(rows))  # small training sets take more turns
    e, w, b = descend(grams, y, len(langs), buckets, dim, epochs, rate, seed)
    model = Model(langs, (e @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)

    def logits(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([z.tolist() for z in text_logits(batch.column("text"), model)], pa.list_(pa.float64()))], names=["lang", "z"])

    kept = chosen.filter(fifth) if apart else chosen
    left = lowest(map_arrow(kept.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text"), logits, "lang string, z array<double>"), max_rows, "lang", "z").collect()
    temperature, floor = calibrated(np.array([r.z for r in left]), np.array([langs.index(r.lang) for r in left]), precision)
    return model._replace(temperature=temperature, floor=floor)


def text_logits(texts: pa.Array, model: Model) -> np.ndarray:
    """Class logits of whole texts."""
    data, off = utf8(texts)
    out = [row_logits(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], model) for lo, hi in pieces(off, 1 << 20)]
    return np.vstack([np.zeros((0, len(model.langs))), *out]) + model.bias


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        spoken = np.array([has_letter(t) for t in strings(texts)])
        langs, score = np.array(["und"] * len(texts), object), np.zeros(len(texts))
        if model is not None:
            p = softmax(text_logits(texts, model) / model.temperature)
            langs, score = np.array(model.langs, object)[p.argmax(axis=1)], p.max(axis=1)
            langs[~spoken], score[~spoken] = "und", 0
        sure = score >= model.floor if model is not None else np.zeros(len(texts), bool)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.fill_null(batch.column("held_out"), False), pa.array(list(langs), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(~(sure & spoken))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
