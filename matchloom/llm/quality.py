"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network on top.

Every word has a sparse random index vector; a word's own vector is the sum of the index vectors seen near it in
the training texts. A second channel does the same for word shapes (letter case, digits and punctuation), which
unknown words have too. A document is the mean of its words' vectors in both channels and a few shares pooled
over the same words: how many differ, repeat the one before or are unknown, and how long they are. A network of
two layers, trained by numpy, gives log odds, and a temperature fitted on rows set aside turns them into probabilities.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, small_batches, table

#: Bounds of the training sample: labelled rows, and bytes of their texts. Rows come in the order of a hash of their id.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16 << 20
DIMS, VOCABULARY, WINDOW = 48, 20_000, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-3
#: Scores from here on are predicted as good.
ACCEPT = 0.3
SEED = 7

_RUNS = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """The kinds of characters of a word in order, runs as one: ``Xx`` for a capitalised word, ``x,`` before a comma."""
    for mark, run in zip("Xx9", _RUNS):
        word = run.sub(mark, word)
    return word[:6]


def folded(word: str) -> str:
    return word.strip(".,;:!?()[]\"'").lower()


class Lookup(dict):
    """Word to (word row, shape row), filled as words come. It is emptied when it has grown to its bound."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int], bound: int = 200_000):
        super().__init__()
        self.words, self.shapes, self.bound = words, shapes, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        found = self[word] = self.words.get(folded(word), 0) * 4096 + self.shapes.get(shape(word), 0)
        return found


def index_vectors(n: int, dims: int, seed: int) -> np.ndarray:
    """Sparse random vectors: four entries of each are 1 or -1."""
    draw = np.random.default_rng(seed)
    out = np.zeros((n, dims), np.float32)
    at = np.argsort(draw.random((n, dims)), axis=1)[:, :4]
    np.put_along_axis(out, at, draw.choice(np.array([-1, 1], np.float32), (n, 4)), axis=1)
    return out


def context_vectors(ids: np.ndarray, own: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
    """Vectors of ``n`` units: sums of the index vectors of words (``ids``) near each occurrence (``own``), at length 1."""
    index, total = index_vectors(ids.max(initial=0) + 1, dims, seed), np.zeros((n, dims), np.float32)
    for step in range(1, WINDOW + 1):
        for at, near in ((own[:-step], ids[step:]), (own[step:], ids[:-step])):
            for first in range(0, len(at), 100_000):
                a, b = at[first : first + 100_000], near[first : first + 100_000]
                order = np.argsort(a, kind="stable")
                rows, starts = np.unique(a[order], return_index=True)
                total[rows] += np.add.reduceat(index[b[order]], starts, axis=0)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def pooled(self, text: str | None, lookup: Lookup) -> np.ndarray:
        """The features of a whole text; all zero if it has no words."""
        words = (text or "").split()
        out = np.zeros(2 * self.word_vectors.shape[1] + 10, np.float32)
        if not words:
            return out
        ids = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
        of_word, of_shape = np.unique(ids >> 12, return_counts=True), np.unique(ids & 4095, return_counts=True)
        d = self.word_vectors.shape[1]
        out[:d] = of_word[1] @ self.word_vectors[of_word[0]] / len(words)
        out[d : 2 * d] = of_shape[1] @ self.shape_vectors[of_shape[0]] / len(words)
        same = sum(map(str.__eq__, words[1:], words[:-1])) / len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = Counter(words)
        top = max(counts.values()) / len(words)
        out[2 * d :] = (
            1, np.log1p(len(words)), len(counts) / len(words) ** 0.9, same, top, lengths.mean(), min(lengths.max(), 100),
            np.mean(ids >> 12 == 0), np.linalg.norm(out[:d]), np.linalg.norm(out[d : 2 * d]),
        )
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh(self.scaled(x) @ w1 + b1) @ w2 + b2)[:, 0] / self.temperature

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Features by their spread in training, cut at three spreads: the vector of a text of one word lies far out in every dimension."""
        return np.clip((x - self.mean) / self.spread, -3, 3)

    def scores(self, texts: Iterable[str | None], lookup: Lookup) -> np.ndarray:
        x = [self.pooled(t, lookup) for t in texts]
        return 1 / (1 + np.exp(-np.clip(self.odds(np.array(x)), -30, 30))) if x else np.zeros(0)


def train_network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the log loss."""
    draw = np.random.default_rng(SEED)
    layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(x[rows] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-(hidden @ layers[2] + layers[3])[:, 0]))
            out = ((p - y[rows]) / len(rows))[:, None]
            back = out @ layers[2].T * (1 - hidden**2)
            grads = [x[rows].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ out + DECAY * layers[2], out.sum(0)]
            t += 1
            for w, g, m, v in zip(layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return layers


def fitted_temperature(odds: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, of a grid from a fifth to ten.

    Targets are a little inside 0 and 1, the more so the fewer rows there are, so that rows that happen to be
    told apart without error don't make all scores extreme."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    grid = np.geomspace(0.2, 10, 80)
    return float(min(grid, key=lambda t: np.mean(target * np.logaddexp(0, -odds / t) + (1 - target) * np.logaddexp(0, odds / t))))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """A model from labelled texts; every fifth is set aside for the temperature."""
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update((t or "").split())
    of_word, of_shape = Counter(), Counter()
    for w, n in counts.items():
        of_word[folded(w)] += n
        of_shape[shape(w)] += n
    known = sorted(w for w, n in sorted(of_word.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1)
    words = {w: i + 1 for i, w in enumerate(known)}
    shapes = {s: i + 1 for i, s in enumerate(sorted(sorted(of_shape, key=lambda s: (-of_shape[s], s))[:4000]))}
    del counts, of_word, of_shape
    lookup = Lookup(words, shapes)
    ids = np.concatenate([np.fromiter(map(lookup.__getitem__, (t or "").split()), np.int64) for t in texts])
    word_vectors = context_vectors(ids >> 12, ids >> 12, len(words) + 1, DIMS, SEED)
    word_vectors[0] = 0  # unknown words have their shape only
    shape_vectors = context_vectors(ids & 4095, ids & 4095, len(shapes) + 1, DIMS, SEED + 1)
    own = index_vectors(len(shapes) + 1, DIMS, SEED + 2)
    shape_vectors = shape_vectors * 0.5 + own * 0.5
    model = Model(words, shapes, word_vectors, shape_vectors, np.zeros(1), np.ones(1), [])
    x, y = np.array([model.pooled(t, lookup) for t in texts]), np.array(labels)
    aside = np.arange(len(x)) % 5 == 4
    model.mean, model.spread = x[~aside].mean(0), np.maximum(x[~aside].std(0), 1e-3)
    model.spread[: 2 * DIMS] *= 2  # many, and each weaker than a pooled share
    model.layers = train_network(model.scaled(x[~aside]), y[~aside].astype(np.float64))
    if aside.any():
        model.temperature = fitted_temperature(model.odds(x[aside]), y[aside])
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model of ``labels`` (doc_id, quality) on the texts of ``docs``, from ``rows`` labelled rows and ``size`` bytes at most.

    Only documents outside the held-out fold are seen, in the order of a hash; one that doesn't fit in what is left of
    ``size`` is passed over. Without any such row every score is one half; if there are some, but each alone is longer
    than ``size``, there is a warning besides."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(known, "doc_id").withColumn("_at", order)
    chosen, left, after, longest = {}, size, None, 0
    while len(chosen) < rows:  # what doesn't fit in what is left is passed over, so one turn nearly always does
        small = sizes.where(F.col("size") <= left)
        if after is not None:
            small = small.where(F.col("_at") > after)
        some = small.orderBy("_at", "size").limit(rows).collect()
        for r in some:
            if r["doc_id"] not in chosen and r["size"] <= left and len(chosen) < rows:
                chosen[r["doc_id"]] = r["quality"]
                left -= r["size"]
                longest = max(longest, r["size"])
        if len(some) < rows:
            break
        after = some[-1]["_at"]
    if not chosen and sizes.limit(1).count():
        warnings.warn(f"all labelled texts outside the held-out fold are longer than {size} bytes: nothing is learnt, every score is one half")
    if not chosen:
        return Model({}, {}, np.zeros((1, DIMS), np.float32), np.zeros((1, DIMS), np.float32), np.zeros(2 * DIMS + 10), np.ones(2 * DIMS + 10), [np.zeros((2 * DIMS + 10, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long"))
    found = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(ids, "doc_id")
    texts = {r["doc_id"]: r["text"] for r in found.groupBy("doc_id").agg(F.max("text").alias("text")).collect()}  # one of rows that repeat an id
    collected(spark)  # the driver's heap held the texts too
    mix = sorted(texts, key=lambda i: (hash((i, SEED)), i))
    return fit([texts[i] for i in mix], [chosen[i] for i in mix])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability that a text is good, from its whole text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "score"
    while name in docs.columns:
        name += "_"

    def run(batches):
        lookup = Lookup(shared.value.words, shared.value.shapes)
        for batch in batches:
            scores = shared.value.scores((t.as_py() for t in batch["text"]), lookup)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    A null or empty text gets the score of a text without words. A null id is in no fold (held_out false) and
    never learnt from; repeated rows get equal scores. Other columns are ignored; an empty table gives no rows."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns.

    A null or empty text gets the score of a text without words; repeated rows get equal scores and stay or go
    together; rows without id are judged but never learnt from. An empty table gives no rows."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= ACCEPT).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
