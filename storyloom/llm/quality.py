"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over
each chunk and are max-pooled within it; a hidden layer reads the pooled filters (which say what occurs
in a chunk, and so also how little does, as in repeated words) and how full the chunk is; the hidden units'
maximum and mean over all chunks give one probability. Work and memory are in proportion to the
bytes, a bounded number of chunks at a time, whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from storyloom.llm.columns import quoted

CHUNK, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 8, 2, 6, 32, 16
STEP = CHUNK - WIDTH
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are convolved at once (25 MB), and texts that are read at once.
CHUNKS_AT_ONCE, TEXTS_AT_ONCE = 1024, 128
#: Bounds of the sample that the network is fitted on: labelled rows, and bytes of a row. Scoring has none.
TRAIN_ROWS, TRAIN_BYTES = 4000, 32768


def chunked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts as a matrix of bytes, the share of each that is text, and each text's first chunk.

    The last chunk ends where the text ends; a text shorter than a chunk is filled up with zero bytes.
    """
    raw = [(t or "").encode("utf-8") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    buffer = np.frombuffer(b"".join(r if len(r) >= CHUNK else r.ljust(CHUNK, b"\0") for r in raw), np.uint8)
    held = np.maximum(sizes, CHUNK)
    count = 1 + -(-(held - CHUNK) // STEP)
    first = np.cumsum(count) - count
    k = np.arange(count.sum()) - np.repeat(first, count)
    start = np.repeat(np.cumsum(held) - held, count) + np.minimum(k * STEP, np.repeat(held - CHUNK, count))
    full = np.repeat(np.minimum(sizes, CHUNK) / CHUNK, count).astype(np.float32)
    return np.lib.stride_tricks.sliding_window_view(buffer, CHUNK)[start], full, first


@dataclass
class ByteConvNet:
    seed: int = 7
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.w:
            r = np.random.default_rng(self.seed)
            normal = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
            self.w = {
                "embed": normal(256, EMBED, scale=0.5), "filters": normal(WIDTH * EMBED, FILTERS, scale=0.25), "filter_bias": np.zeros(FILTERS, np.float32),
                "hidden": normal(FILTERS + 1, HIDDEN, scale=0.25), "hidden_bias": np.zeros(HIDDEN, np.float32),
                "out": normal(2 * HIDDEN, scale=0.2), "out_bias": np.zeros(1, np.float32),
            }

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        e = self.w["embed"][chunks]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(e), PLACES, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))

    def _pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each chunk."""
        return (self._windows(chunks) @ self.w["filters"]).max(axis=1) + self.w["filter_bias"]

    def _hidden(self, pooled: np.ndarray, full: np.ndarray) -> np.ndarray:
        seen = np.concatenate([np.maximum(pooled, 0), full[:, None]], axis=1)
        return np.maximum(seen @ self.w["hidden"] + self.w["hidden_bias"], 0)

    def _probability(self, hidden: np.ndarray, first: np.ndarray) -> np.ndarray:
        count = np.diff(np.append(first, len(hidden)))[:, None]
        both = np.concatenate([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / count], axis=1)
        return 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["out_bias"], -40, 40).astype(np.float64)))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        chunks, full, first = chunked(texts)
        hidden = [self._hidden(self._pooled(chunks[i : i + CHUNKS_AT_ONCE]), full[i : i + CHUNKS_AT_ONCE]) for i in range(0, len(chunks), CHUNKS_AT_ONCE)]
        return self._probability(np.concatenate(hidden), first)

    def _gradients(self, chunks: np.ndarray, full: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(chunks)
        windows = self._windows(chunks)
        response = windows @ w["filters"]
        best = response.argmax(axis=1)
        pooled = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + w["filter_bias"]
        seen = np.concatenate([np.maximum(pooled, 0), full[:, None]], axis=1)
        hidden = np.maximum(seen @ w["hidden"] + w["hidden_bias"], 0)
        count = np.diff(np.append(first, n))
        doc = np.repeat(np.arange(len(first)), count)
        top = np.maximum.reduceat(hidden, first)
        both = np.concatenate([top, np.add.reduceat(hidden, first) / count[:, None]], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["out_bias"], -40, 40)))
        d_out = ((p - y) / len(y)).astype(np.float32)
        d_both = d_out[:, None] * w["out"]
        tops = (hidden == top[doc]).astype(np.float32)
        tops /= np.add.reduceat(tops, first)[doc]  # chunks that tie share the gradient
        d_hidden = d_both[doc, HIDDEN:] / count[doc, None] + d_both[doc, :HIDDEN] * tops
        d_hidden *= hidden > 0
        d_pooled = (d_hidden @ w["hidden"][:FILTERS].T) * (pooled > 0)
        chosen = windows[np.arange(n)[:, None], best]
        d_window = (d_pooled[:, :, None] * w["filters"].T).reshape(-1, EMBED)
        at = chunks[np.arange(n)[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)].ravel()
        d_embed = np.stack([np.bincount(at, d_window[:, k], 256) for k in range(EMBED)], axis=1)
        return {
            "embed": d_embed, "filters": np.einsum("nf,nfk->kf", d_pooled, chosen), "filter_bias": d_pooled.sum(0),
            "hidden": seen.T @ d_hidden, "hidden_bias": d_hidden.sum(0), "out": both.T @ d_out, "out_bias": d_out.sum(keepdims=True),
        }

    def fit(self, texts: list[str], labels: list[int], steps: int = 1200, batch: int = 48, rate: float = 0.006) -> ByteConvNet:
        """``steps`` or a little more steps of Adam with a rate that falls to zero; where there is one label only, the network says that label."""
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.w = {k: np.zeros_like(v) for k, v in self.w.items()}
            self.w["out_bias"] += 0 if not len(y) else np.float32(8 if y[0] else -8)
            return self
        share = y.mean()
        self.w["out_bias"] += np.float32(np.log(share / (1 - share)))
        r, step, each = np.random.default_rng(self.seed), 0, -(-len(y) // batch)
        epochs = -(-steps // each)
        steps = epochs * each
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                grads = self._gradients(*chunked([texts[j] for j in pick]), y[pick])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    now = rate * (1 - (step - 1) / steps)
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, seed: int = 7) -> ByteConvNet:
    """A network fitted to the labelled rows of ``docs(doc_id, text, ...)`` that aren't held out; ``labels(doc_id, quality, ...)``.

    The sample is bounded: of the documents that have a label and a text of at most ``most_bytes`` bytes the ``rows`` ones of least hashed
    doc_id, of equal doc_ids by the hash of the text. Where a doc_id is labelled more than once its largest label counts. Null labels and texts are left out,
    labels other than 0 and 1 and other columns too.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"))
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= most_bytes)
    # ids first, so that only the sample's texts are moved
    place = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_key"))
    found = short.select("doc_id", F.xxhash64("text").alias("text_key")).join(known, F.col("doc_id") == F.col("of")).distinct().orderBy(*place).limit(rows)
    picked = found.select("of", F.col("text_key").alias("of_key"), "quality")
    sample = short.join(F.broadcast(picked), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("of_key")))
    got = sorted({(r["doc_id"], r["text"], r["quality"]) for r in sample.select("doc_id", "text", "quality").distinct().collect()})  # at most ``rows``
    return ByteConvNet(seed).fit([t for _, t, _ in got], [q for _, _, q in got])


def scored(docs: DataFrame, net: ByteConvNet, out: str = "quality_score") -> DataFrame:
    """``docs`` with ``out``: the network's probability of label 1 for each whole text, in the rows' own columns and order.

    Null and empty texts get the score of an empty text. Only the text is read for a score. Repeated rows get equal
    scores; a column of the name ``out`` is replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    text = next(i for i, c in enumerate(kept) if c.lower() == "text")
    # plain names on the way through Python, which can't name every column
    rows = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            scores = [net.predict(texts.slice(i, TEXTS_AT_ONCE).to_pylist()) for i in range(0, len(texts), TEXTS_AT_ONCE)]
            columns = [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, out)
