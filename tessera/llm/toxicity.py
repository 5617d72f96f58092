"""Toxicity by a bag of subword embeddings averaged into a linear softmax.

A word (lower-cased letters and digits, and everything beyond ASCII) has as features itself and the
byte n-grams of ``<word>``; features hash into buckets. A text's vector is the mean of its features'
embeddings, its score the softmax of a linear layer on that. Embeddings and layer are trained
together with Adam in numpy, on labelled rows that an explicit bound limits; of those the driver gets
distinct words and their counts, which executors take from the texts. Unseen misspellings
share n-grams with known words, so they score like them.

As the layer is linear, a trained model scores with one number a bucket; scoring works on the
distinct words of a slice, not on each occurrence.

Defined cases: null texts and texts without words have no features and get the score of the bias
alone; with fewer than two classes among the training rows every score is the share of class 1;
labels of null doc_id or null class are skipped, of repeated ones the highest counts; rows with
equal doc_id each get a row; other columns stay out of every score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

U = np.uint64
BUCKETS = 1 << 17
#: At most so many labelled rows are fitted to.
TRAIN_ROWS = 8000
NGRAMS = (3, 4, 5)
#: Words whose features training works on at a time.
WORDS = 1 << 16


def word_features(words: kernel.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words ``which``, one word after the other, and where each word's begin."""
    s, e = words.starts[which], words.ends[which]
    size = e - s
    at = np.concatenate(([0], np.cumsum(size + 2)))
    data = np.zeros(at[-1], np.uint8)
    data[at[:-1]], data[at[1:] - 1] = ord("<"), ord(">")
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[inner + np.repeat(at[:-1] + 1, size)] = words.bytes[inner + np.repeat(s, size)]
    own = np.repeat(np.arange(len(which)), size + 2)
    word, feature = [np.arange(len(which))], [kernel.bytes_hash(data, at[:-1], at[1:])]
    for n in NGRAMS:
        start = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :]) if len(own) >= n else np.zeros(0, np.int64)
        word.append(own[start])
        feature.append(kernel.bytes_hash(data, start, start + n))
    word, feature = np.concatenate(word), (np.concatenate(feature) % U(BUCKETS)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return feature[order], np.searchsorted(word[order], np.arange(len(which) + 1))


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, on the margin between the classes
    bias: float

    def scores(self, texts: kernel.Texts) -> np.ndarray:
        words = kernel.Words(texts, kernel.ALNUM, lower=True)
        if not len(words.starts):
            return np.full(texts.n, 1 / (1 + np.exp(-self.bias)))
        _, one, where = np.unique(words.hashes(), return_index=True, return_inverse=True)
        feature, at = word_features(words, one)
        total = np.concatenate(([0.0], np.cumsum(self.weight[feature], dtype=np.float64)))
        margin, many = total[at[1:]] - total[at[:-1]], np.diff(at)
        doc = words.doc()
        top = np.bincount(doc, margin[where], texts.n) / np.maximum(1, np.bincount(doc, many[where], texts.n))
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -60, 60)))


def bag(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, kernel.Words, np.ndarray]:
    """Distinct words of each text: text number and count of each, the slice's words, and a place where each stands."""
    words = kernel.Words(texts, kernel.ALNUM, lower=True)
    _, one, where = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pair, count = np.unique(words.doc() * max(1, len(one)) + where, return_counts=True)
    d, w = np.divmod(pair, max(1, len(one)))
    return d, count, words, one[w]


@kernel.released
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its distinct words, one a line, and their counts."""
    for batch in batches:
        toxic = kernel.column(batch, "toxic")
        for texts in kernel.slices(kernel.column(batch, "text")):
            d, count, words, at = bag(texts)
            edge = np.searchsorted(d, np.arange(texts.n + 1)).tolist()
            size = (words.ends - words.starts)[at]
            flat = np.full(int((size + 1).sum()), 0x0A, np.uint8)
            to = np.cumsum(size + 1) - size - 1
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat[inner + np.repeat(to, size)] = words.bytes[inner + np.repeat(words.starts[at], size)]
            place = np.append(to, len(flat)).tolist()
            yield pa.RecordBatch.from_arrays(
                [toxic.slice(texts.first, texts.n), pa.array([flat[place[a] : place[b]].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string()), kernel.binary([count[a:b].astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])],
                names=["toxic", "words", "counts"],
            )


def adam(p: np.ndarray, slope: np.ndarray, mean: np.ndarray, square: np.ndarray, step: float, second: float) -> None:
    """One step of Adam in place."""
    mean += 0.1 * (slope - mean)
    square += 0.01 * (slope**2 - square)
    p -= step * mean / (np.sqrt(square * second) + 1e-8)


def fit(column: pa.Array, label: np.ndarray, counts: list[bytes] | None = None, size: int = 8, rounds: int = 300, rate: float = 0.5, decay: float = 5e-7) -> Model:
    """Trains embeddings of the given size and the softmax layer on the texts of column.

    counts: how often each word of a text counts, once where not given. Every bucket that two or more of
    the texts have is trained; one that a single text has, or none, keeps an embedding of zero and counts
    in the mean all the same. Memory follows the distinct words of each text, and of all, not their n-grams.
    """
    share = float(label.mean()) if len(label) else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    doc, word, amount, hashes = [], [], [], []
    for texts in kernel.slices(column):
        words = kernel.Words(texts, kernel.ALNUM, lower=True)
        distinct, where = np.unique(words.hashes(), return_inverse=True)
        times = np.ones(len(words.starts)) if counts is None else np.concatenate([np.frombuffer(c, "<u4") for c in counts[texts.first : texts.first + texts.n]] or [np.zeros(0)])
        pair, at = np.unique(words.doc() * max(1, len(distinct)) + where, return_inverse=True)
        d, w = np.divmod(pair, max(1, len(distinct)))
        doc.append((d + texts.first).astype(np.int32))
        word.append(w + sum(map(len, hashes)))
        amount.append(np.bincount(at, times, len(pair)).astype(np.float32))
        hashes.append(distinct)
    size_of_slice = list(map(len, hashes))
    _, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    hashes.clear()
    number = np.argsort(np.argsort(first)).astype(np.int32)[number]  # words by their first slice
    doc, amount, word = np.concatenate(doc), np.concatenate(amount), number[np.concatenate(word)]
    first = np.sort(first)
    feature, many, at = [], [], 0
    for texts, distinct in zip(kernel.slices(column), size_of_slice, strict=True):
        words = kernel.Words(texts, kernel.ALNUM, lower=True)
        _, one = np.unique(words.hashes(), return_index=True)
        f, edge = word_features(words, one[first[(first >= at) & (first < at + distinct)] - at])
        feature.append(f.astype(np.int32))
        many.append(np.diff(edge))
        at += distinct
    feature, many = np.concatenate(feature), np.concatenate(many)
    n = len(many)
    amount /= np.maximum(1, np.bincount(doc, amount * many[word], len(label))).astype(np.float32)[doc]
    # A bucket that two texts have: the first text of its words isn't the last one.
    low_of, high_of = np.full(n, len(label)), np.full(n, -1)
    np.minimum.at(low_of, word, doc)
    np.maximum.at(high_of, word, doc)
    low, high = np.full(BUCKETS, len(label)), np.full(BUCKETS, -1)
    edge = np.concatenate(([0], np.cumsum(many)))
    for a in range(0, n, WORDS):
        of, size_of = feature[edge[a] : edge[min(n, a + WORDS)]], many[a : a + WORDS]
        np.minimum.at(low, of, np.repeat(low_of[a : a + WORDS], size_of))
        np.maximum.at(high, of, np.repeat(high_of[a : a + WORDS], size_of))
    used = np.flatnonzero(low < high)
    column_of = np.full(BUCKETS, len(used), np.int32)  # the last place is of buckets that aren't trained
    column_of[used] = np.arange(len(used), dtype=np.int32)
    feature = column_of[feature]
    y = np.asarray(label, np.float32)
    rng = np.random.default_rng(7)
    e = rng.uniform(-1 / size, 1 / size, (len(used), size)).astype(np.float32)
    layer, bias = rng.uniform(-0.1, 0.1, (size, 2)).astype(np.float32), np.array([np.log(1 - share), np.log(share)], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, layer, bias)]
    for t in range(1, rounds + 1):
        # Of two classes only the margin counts, and slopes of theirs differ in sign only. A text's margin goes by its words, a word's by its features.
        across = layer[:, 1] - layer[:, 0]
        weight = e @ across
        weight = np.append(weight, np.float32(0))
        of = np.empty(n, np.float32)
        for a in range(0, n, WORDS):
            of[a : a + WORDS] = np.add.reduceat(weight.take(feature[edge[a] : edge[min(n, a + WORDS)]]), edge[a : min(n, a + WORDS)] - edge[a])
        margin = np.bincount(doc, amount * of[word], len(y)) + (bias[1] - bias[0])
        off = ((1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y) / len(y)).astype(np.float32)
        pull = np.bincount(word, amount * off[doc], n).astype(np.float32)
        of_bucket = np.zeros(len(used) + 1)
        for a in range(0, n, WORDS):
            of_bucket += np.bincount(feature[edge[a] : edge[min(n, a + WORDS)]], np.repeat(pull[a : a + WORDS], many[a : a + WORDS]), len(used) + 1)
        pull = of_bucket[:-1].astype(np.float32)
        step, second = rate * (1 - (t - 1) / rounds) / (1 - 0.9**t), 1 / (1 - 0.99**t)
        down = np.outer(e.T @ pull, np.float32([-1, 1]))
        for a in range(0, len(used), 1 << 13):  # by blocks that stay in the cache
            at = slice(a, a + (1 << 13))
            adam(e[at], np.outer(pull[at], across) + decay * e[at], *(m[at] for m in moments[0]), step, second)
        adam(layer, down + decay * layer, *moments[1], step, second)
        adam(bias, off.sum() * np.float32([-1, 1]), *moments[2], step, second)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = e @ (layer[:, 1] - layer[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits to at most ``rows`` labelled documents that aren't held out, chosen by a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(F.col("text").cast("string"), F.col("toxic").cast("long").alias("toxic"))
    got = got.mapInArrow(_bags, "toxic long, words string, counts binary").toArrow().sort_by([("words", "ascending"), ("counts", "ascending"), ("toxic", "ascending")])
    return fit(got["words"], got["toxic"].to_numpy() > 0, got["counts"].to_pylist())


def _score(model):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.drop_columns(["text"])
            for texts in kernel.slices(kernel.column(batch, "text")):
                part = keys.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(texts))], names=[*part.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, mark, score) for each row of (doc_id, text); mark is the text's xxhash64."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(_score(cast), f"doc_id {kind}, mark long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """docs without the rows that score threshold or more; all other rows and columns stay."""
    keep = docs.schema
    cast = docs.sparkSession.sparkContext.broadcast(model)

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [cast.value.scores(texts) for texts in kernel.slices(kernel.column(batch, "text"))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, keep)
