"""Text quality by a byte-level convolutional network in numpy.

A symbol is a byte and whether the four bytes there stood within the last 24 bytes too. Filters of
16 symbols slide by 4 over chunks of 512 bytes, each of which overlaps the next by the filter's rest,
so that all windows of the whole text lie in a chunk. A chunk keeps the maximum of each filter; the mean
and the maximum over the chunks go through one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WIDTH, STEP, FILTERS, EMBEDDING = 16, 4, 16, 8
CHUNK = 128  # windows, so 512 bytes
BACK = 24  # bytes in which a repetition is looked for
SEGMENT = 1 << 18  # bytes of a text that are laid out at a time
BATCH = 1 << 19  # bytes that go through the network at a time


def _segments(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of ``(document of each segment, symbols, window starts, segment of each chunk)``."""
    owners, parts, size = [], [], 0

    def batch():
        spans = [(len(p) - BACK - WIDTH + STEP) // STEP for p in parts]
        raw = np.frombuffer(b"".join(parts) + b"\0" * 4, np.uint8)
        four = raw[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            four |= raw[k:len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        again = np.zeros(len(four), bool)
        for lag in range(3, BACK + 1):
            again[lag:] |= four[lag:] == four[:-lag]
        again &= raw[:-3] != 0
        symbols = raw[:-3].astype(np.int16) + 256 * again
        begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])) + BACK
        starts = np.concatenate([b + STEP * np.arange(n) for b, n in zip(begin, spans)])
        return owners, symbols, starts, np.repeat(np.arange(len(parts)), [n // CHUNK for n in spans])

    for doc, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        for at in range(0, max(1, len(data)), SEGMENT):
            own = data[at:at + SEGMENT + WIDTH - STEP]
            chunks = -(-max(1, min(len(data) - at, SEGMENT)) // (STEP * CHUNK))
            need = chunks * STEP * CHUNK + WIDTH - STEP
            parts.append(data[max(0, at - BACK):at].rjust(BACK, b"\0") + own.ljust(need, b"\0"))
            owners.append(doc)
            size += need
            if size >= BATCH:
                yield batch()
                owners, parts, size = [], [], 0
    if parts:
        yield batch()


class Network:
    """Weights, scoring and training."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.weights = {
            "embedding": draw.normal(0, 0.3, (512, EMBEDDING)),
            "filters": draw.normal(0, 0.2, (WIDTH, EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": draw.normal(0, 0.1, 2 * FILTERS),
            "base": np.zeros(1),
        }
        self.table = self._table()

    def _table(self) -> np.ndarray:
        """What each symbol adds at each place of the filters."""
        return np.einsum(
            "se,wef->wsf", self.weights["embedding"], self.weights["filters"]
        ).astype(np.float32)

    def _responses(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.take(self.table[0], symbols[starts], axis=0)
        for w in range(1, WIDTH):
            total += np.take(self.table[w], symbols[starts + w], axis=0)
        return total.reshape(-1, CHUNK, FILTERS)

    def score(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        sums, most, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
        bias = self.weights["bias"]
        for owners, symbols, starts, segment in _segments(texts):
            top = np.maximum(self._responses(symbols, starts).max(1) + bias, 0)
            doc = np.asarray(owners)[segment]
            edges = np.nonzero(np.diff(doc, prepend=-1))[0]
            at = doc[edges]
            sums[at] += np.add.reduceat(top, edges, axis=0)
            most[at] = np.maximum(most[at], np.maximum.reduceat(top, edges, axis=0))
            count[at] += np.diff(np.append(edges, len(doc)))
        pooled = np.concatenate([sums / np.maximum(count, 1)[:, None], most], axis=1)
        return 1 / (1 + np.exp(-(pooled @ self.weights["out"] + self.weights["base"][0])))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 24, rate: float = 0.01) -> None:
        """Adam on the cross entropy, both classes of equal weight."""
        y = np.asarray(labels, float)
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        order = np.random.default_rng(3).permutation(len(texts))
        ready = []
        for i in range(0, len(order), 64):
            docs = order[i:i + 64]
            laid = list(_segments([texts[d] for d in docs]))
            ready.append((docs, laid))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            for docs, laid in ready:
                step += 1
                grads = self._gradients(laid, y[docs], weight[docs])
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= rate * (m / (1 - 0.9**step)) / (
                        np.sqrt(v / (1 - 0.999**step)) + 1e-8
                    )
                self.weights["embedding"][0] = 0
                self.table = self._table()

    def _gradients(self, laid: list, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(y)
        tops, windows, owners = [], [], []
        for segment_docs, symbols, starts, segment in laid:
            responses = self._responses(symbols, starts)
            best = responses.argmax(1)
            top = np.take_along_axis(responses, best[:, None, :], 1)[:, 0, :] + w["bias"]
            at = starts.reshape(-1, CHUNK)
            begin = np.take_along_axis(at, best, 1)  # chunks x filters
            windows.append(symbols[begin[:, :, None] + np.arange(WIDTH)])
            tops.append(top)
            owners.append(np.asarray(segment_docs)[segment])
        raw, window, doc = np.concatenate(tops), np.concatenate(windows), np.concatenate(owners)
        top = np.maximum(raw, 0)
        count = np.bincount(doc, minlength=n)
        mean = np.zeros((n, FILTERS))
        np.add.at(mean, doc, top)
        mean /= count[:, None]
        edges = np.nonzero(np.diff(doc, prepend=-1))[0]
        most = np.maximum.reduceat(top, edges, axis=0)
        pooled = np.concatenate([mean, most], axis=1)
        score = 1 / (1 + np.exp(-(pooled @ w["out"] + w["base"][0])))
        error = weight * (score - y) / n
        d_mean = error[:, None] * w["out"][:FILTERS] / count[:, None]
        d_most = error[:, None] * w["out"][FILTERS:]
        d_top = d_mean[doc] + d_most[doc] * (top == most[doc])
        d_top *= raw > 0
        d_table = np.zeros((WIDTH, 512, FILTERS))
        place = np.arange(WIDTH)[None, None, :]
        filters = np.arange(FILTERS)[None, :, None]
        np.add.at(d_table, (place, window, filters), d_top[:, :, None])
        return {
            "embedding": np.einsum("wsf,wef->se", d_table, w["filters"]) + 1e-5 * w["embedding"],
            "filters": np.einsum("wsf,se->wef", d_table, w["embedding"]) + 1e-5 * w["filters"],
            "bias": d_top.sum(0),
            "out": pooled.T @ error + 1e-4 * w["out"],
            "base": np.array([error.sum()]),
        }


def held_out(id: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
    label: str = "quality", rows: int = 1500,
) -> Network:
    """Fit a network on at most ``rows`` labelled documents of each class.

    They are those of the least hashes of the id, held-out ids left out; of rows that repeat an id one
    counts. Without both classes the network gives 0.5 or so.
    """
    known = (
        labels.select(F.col(f"`{id}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out("key"))
        .groupBy("key").agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("key"))
    )
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("order", "key").limit(rows)
        sample = part if sample is None else sample.union(part)
    # At most 2 * rows ids, so this side has a proven bound.
    found = (
        docs.select(F.col(f"`{id}`").alias("key"), text_of(text).alias("text"))
        .join(F.broadcast(sample.select("key", "label")), "key")
        .groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .orderBy("key").collect()
    )
    network = Network()
    if found:
        network.fit([r["text"] for r in found], [r["label"] for r in found])
    return network


def score_column(network: Network, text: str = "text") -> Column:
    """The probability of label 1 of the whole text; null counts as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = list(part)
            yield pd.Series(
                np.concatenate([np.zeros(0)] + [
                    network.score(texts[i:i + 500]) for i in range(0, len(texts), 500)
                ])
            )

    return score(text_of(text))


def quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Only the text is scored; null counts as empty, and empty texts get the score of a chunk of
    nothing. Repeated rows and null ids stay. An empty table gives an empty result; other columns
    are not looked at.
    """
    network = train(docs, labels, id, text)
    return docs.select(
        F.col(f"`{id}`").alias("doc_id"), held_out(id).alias("held_out"),
        score_column(network, text).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``docs`` that score ``threshold`` or more, all columns kept."""
    network = train(docs, labels, id, text)
    return docs.where(score_column(network, text) >= threshold)
