"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import free_name, small_batches

SEED = 7
BUCKETS = 1 << 14
DIM = 64
NONZERO = 6
REACH = 2
HIDDEN = 32
STEPS = 600
#: Labelled documents that the layers and the temperature are fitted on at most, those with the least hash of the id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Tokens whose neighbours are counted at once.
TOKENS_AT_ONCE = 1 << 16
#: Distinct tokens whose codes a task remembers.
REMEMBERED = 100_000
#: Kinds of a token's shape: lower case, a capital first, capitals, other; by length, from 1 to LONGEST and more.
LONGEST = 16
SHAPES = 4 * LONGEST
WIDTH = 2 * DIM + 2 + SHAPES
#: Letters of scripts without spaces, each of which is a token: Thai to Burmese, Khmer, kana, Chinese characters.
SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{SINGLE}]|[^\W\d_{SINGLE}]+|\d+|[^\w\s]+|_+|\n")


def index_columns() -> np.ndarray:
    """The NONZERO dimensions of each bucket's vector, the same wherever they are drawn: odd ones add 1, even ones -1."""
    draw = np.random.default_rng(SEED)
    return np.stack([draw.integers(0, DIM, BUCKETS) for _ in range(NONZERO)])


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, one per bucket."""
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    for column, dims in enumerate(index_columns()):
        vectors[np.arange(BUCKETS), dims] += 1.0 if column % 2 else -1.0
    return vectors


class _Codes(dict):
    """The code of each token that a task has met so far; it is emptied at the task's end, as workers live on."""

    def __missing__(self, token: str) -> int:
        kind = 3
        if token[0].isalpha():
            name = "w" + token.lower()
            if token.islower():
                kind = 0
            elif token[0].isupper():
                kind = 2 if len(token) > 1 and token.isupper() else 1
        else:
            name = "9" if token[0].isdigit() else token[0] * min(len(token), 3)
        shape = kind * LONGEST + min(len(token), LONGEST) - 1
        code = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS + BUCKETS * shape
        if len(self) < REMEMBERED:
            self[token] = code
        return code


_codes = _Codes()


def token_buckets(text: str | None) -> np.ndarray:
    """One number per token of a whole text: bucket + BUCKETS * shape.

    The bucket is that of the word in lower case, whatever its length, or of the kind of digits or marks. The shape says
    how a word is written and how long it is; it is a feature of its own and has no part in the bucket.
    """
    tokens = TOKEN.findall(text or "")
    return np.fromiter(map(_codes.__getitem__, tokens), np.int64, len(tokens))


def context_sums(texts: list[np.ndarray], columns: np.ndarray, sums: np.ndarray) -> None:
    """Adds to each token's bucket the index vectors of its neighbours in the same text; sums has BUCKETS * DIM whole numbers."""
    if not texts:
        return
    tokens = np.concatenate(texts) % BUCKETS
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for step in range(1, REACH + 1):
        near = owner[:-step] == owner[step:]
        one, other = tokens[:-step][near], tokens[step:][near]
        for words, neighbours in ((one * DIM, other), (other * DIM, one)):
            for column, dims in enumerate(columns):
                # Vectors are sparse, so only their places that are not zero are counted.
                np.add.at(sums, words + dims[neighbours], 1 if column % 2 else -1)


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Index vector next to the normed context vector of each bucket (zeros for a bucket never seen)."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.hstack([index, sums / np.maximum(norm, 1.0)]).astype(np.float32)


def pooled(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, the logarithm of the length, the share of distinct words, and the share of each shape; zeros without tokens."""
    if not len(tokens):
        return np.zeros(WIDTH)
    used, counts = np.unique(tokens % BUCKETS, return_counts=True)
    mean = counts @ vectors[used] / len(tokens)
    shapes = np.bincount(tokens // BUCKETS, minlength=SHAPES) / len(tokens)
    return np.concatenate([mean, [np.log1p(len(tokens)) / 10, len(used) / len(tokens)], shapes])


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, (features - self.mean) / self.scale) / self.temperature, -30, 30)))


def _logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray) -> tuple:
    """Full-batch Adam on the logistic loss with a small penalty, both classes with half the weight."""
    draw = np.random.default_rng(SEED)
    params = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ params[0] + params[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y) / len(y)
        back = np.outer(error, params[2]) * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(params)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss on rows that the layers have not seen."""
    if len(y) < 10:
        return 1.0
    tried = np.geomspace(0.25, 8.0, 60)
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in tried]
    return float(tried[int(np.argmin(loss))])


def id_remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learn from labelled rows with id remainder 1 to 4; labels of remainder 0 are never looked at.

    The contexts of words are summed over the texts of all documents, labelled or not. The layers come from at most
    MAX_FIT_ROWS labelled ids, chosen by a hash of the id; those with remainder 1 set the temperature only. Of documents with the same id the one with
    the least hash of its text counts, of labels the greatest. Texts stay in the tasks: context sums (BUCKETS x DIM numbers a task) and
    pooled vectors, one per chosen id, reach the driver. Null ids and labels are left out. Without rows of both classes, as in empty tables, every score
    is the share of label 1 (0.5 without rows).
    """
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    marked = marked.groupBy("id").agg(F.max("y").alias("y")).where(id_remainder(F.col("id")) != 0)
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(MAX_FIT_ROWS)
    # MAX_FIT_ROWS ids and labels at most.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marked), "id")
    index, columns = index_vectors(), index_columns()

    def sums_of(batches):
        sums = np.zeros(BUCKETS * DIM, np.int64)
        pending, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                pending.append(token_buckets(value.as_py()))
                size += len(pending[-1])
                if size >= TOKENS_AT_ONCE:
                    context_sums(pending, columns, sums)
                    pending, size = [], 0
        context_sums(pending, columns, sums)
        _codes.clear()
        sums = sums.reshape(BUCKETS, DIM)
        seen = np.flatnonzero(sums.any(1))
        entries = pa.FixedSizeListArray.from_arrays(pa.array(sums[seen].ravel()), DIM).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), entries], names=["bucket", "v"])

    summed = docs.select(F.col(text)).mapInArrow(sums_of, "bucket int, v array<bigint>")
    per_entry = summed.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]).toArrow()
    sums = np.zeros((BUCKETS, DIM))
    for i in range(DIM):
        sums[per_entry.column(0).to_numpy(), i] = per_entry.column(i + 1).to_numpy()
    vectors = word_vectors(sums, index)
    del per_entry, sums

    def features_of(batches):
        for batch in small_batches(batches):
            values = [pooled(token_buckets(v.as_py()), vectors).astype("<f4").tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.binary())], names=["id", "y", "h", "x"])
        _codes.clear()

    id_kind = rows.schema["id"].dataType.simpleString()
    table = rows.select("text", "id", "y", F.xxhash64("text").alias("h")).mapInArrow(features_of, f"id {id_kind}, y int, h bigint, x binary")
    chosen = table.groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("of")).select("id", "y", id_remainder(F.col("id")).alias("part"), "of.x").toArrow()
    found = chosen.take(pa.compute.sort_indices(chosen, sort_keys=[("id", "ascending")]))
    width = WIDTH
    y, later = found["y"].to_numpy().astype(float), found["part"].to_numpy() == 1
    # Of the lines of numbers, some 8 * WIDTH bytes each, the driver holds one copy.
    parts = [np.zeros((n, width)) for n in ((~later).sum(), later.sum())]
    places = [iter(part) for part in parts]
    for line, kind in zip(found["x"], later):
        next(places[int(kind)])[:] = np.frombuffer(line.as_buffer(), "<f4")
    del chosen, found, places
    seen, unseen = parts
    pa.default_memory_pool().release_unused()
    if len(set(y[~later])) < 2:
        share = float(np.clip(y[~later].mean(), 1e-6, 1 - 1e-6)) if (~later).any() else 0.5
        zero = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))]))
        return QualityModel(vectors, np.zeros(width), np.ones(width), zero, 1.0)
    mean, scale = seen.mean(0), seen.std(0) + 1e-3
    for part in (seen, unseen):
        part -= mean
        part /= scale
    layers = _train(seen, y[~later])
    return QualityModel(vectors, mean, scale, layers, _temperature(_logits(layers, unseen), y[later]))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the probability of label 1 of the whole text; null and empty texts get a score too.

    A column named out is replaced, others stay whatever their names; equal rows are scored each, an empty table gives no rows. Rows do not move: the
    model (a few MB, fixed by BUCKETS and DIM) goes to the tasks. A text of any length is one list of tokens in its task, some 50 bytes a token.
    """
    rows = docs.drop(out)
    whole = free_name([*docs.columns, out], "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(frames):
        for batch in small_batches(frames):
            m, at = shared.value, batch.schema.get_field_index(whole)
            values = np.array([pooled(token_buckets(v.as_py()), m.vectors) for v in batch.column(at)]).reshape(-1, WIDTH)
            yield batch.remove_column(at).append_column(out, pa.array(m.scores(values), pa.float64()))
        _codes.clear()

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.select(*rows.columns, F.col(text).alias(whole)).mapInArrow(scored, schema)
