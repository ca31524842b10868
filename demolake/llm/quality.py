"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 10).

A text's terms are its words, hashed to ``WORD_BUCKETS`` terms, the trigrams of
character classes of its whole text, and a few counts of its words: lengths, and
words that repeat the word one to four places before. Terms are weighted by their
rarity over all documents. A truncated singular value decomposition of a bounded
sample of labelled rows gives the latent space; the sample's vectors, ``per_class``
of each label at most, are broadcast. Every document's cosine with every one of
them is computed exactly, in blocks, and the nearest ``neighbours`` vote with
their similarity, each label weighted by its share of the labelled rows.

Nulls and empty texts have no terms and get the labels' share. A null label
doesn't train; labels may be of any type that casts to 0 and 1, ids of any type.
Of several labels of one doc_id the largest counts. Without labelled rows every
score is 0. Ties among neighbours go to the smaller doc_id of the sample. Repeated
rows are scored alike. An input column named score is replaced; others stay. An
empty table gives none. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.langid import held_out
from demolake.llm.scratch import materialize
from demolake.llm.text import mix, pieces, range_hashes, releasing, small_batches, text_buffer, words_of
from demolake.llm.toxicity import labelled_sample, zero_or_one

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CLASSES = 16
_CLASS = np.full(256, 15, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[0x80:0xA0] = 2
_CLASS[0xA0:0xC0] = 3
_CLASS[0xC0:] = 4
_CLASS[ord("0") : ord("9") + 1] = 5
for _c, _k in ((" ", 6), ("\n", 7), (".", 8), (",", 8), ("!", 9), ("#", 10), ("$", 10), ("%", 10), ("&", 10), ("*", 10), ("|", 11), ("@", 12), ("/", 12), (":", 12), ("<", 13), (">", 13), ("(", 14), (")", 14), ('"', 14), ("'", 14)):
    _CLASS[ord(_c)] = _k
_LENGTHS, _LAGS = 20, 4
WORD_BUCKETS = 2048
_SHAPE = _CLASSES**3 + _LENGTHS + _LAGS
N_TERMS = _SHAPE + WORD_BUCKETS
#: A repeated word says more than any one trigram.
_EMPHASIS = np.ones(N_TERMS, dtype=np.float32)
_EMPHASIS[_SHAPE - _LAGS : _SHAPE] = 4


def term_counts(column: pa.Array) -> np.ndarray:
    """The terms of every text of a column: texts by N_TERMS."""
    data, bounds = text_buffer(column)
    n = len(bounds) - 1
    out = np.zeros((n, N_TERMS), dtype=np.float32)
    if len(data) > 2:
        c = _CLASS[data]
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        for i in range(n):
            if bounds[i + 1] - bounds[i] > 2:
                out[i, : _CLASSES**3] = np.bincount(code[bounds[i] : bounds[i + 1] - 2], minlength=_CLASSES**3)
    starts, ends, first = words_of(data, bounds)
    if len(starts):
        text = np.repeat(np.arange(n), np.diff(first))
        np.add.at(out, (text, _CLASSES**3 + np.minimum(ends - starts, _LENGTHS) - 1), 1)
        words = range_hashes(_BYTES[data], starts, ends)
        for lag in range(1, _LAGS + 1):
            same = (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])
            np.add.at(out, (text[lag:][same], _CLASSES**3 + _LENGTHS + lag - 1), 1)
        np.add.at(out, (text, _SHAPE + (words % np.uint64(WORD_BUCKETS)).astype(np.int64)), 1)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * (idf * _EMPHASIS)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Space:
    """The latent space, and the labelled sample's unit vectors in it."""

    def __init__(self, idf, axes, vectors, labels, prior):
        self.idf, self.axes, self.vectors, self.labels, self.prior = idf, axes, vectors, labels, prior

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, piece_bytes: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and how many documents there are."""

    @releasing
    def run(batches):
        total = np.zeros(N_TERMS + 1, dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, 0, piece_bytes):
                total[:N_TERMS] += (term_counts(batch.column(0)) > 0).sum(axis=0)
                total[N_TERMS] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_TERMS + 1)), pa.array(total)], names=["t", "n"])

    found = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_TERMS + 1, dtype=np.int64)
    out[found.column("t").to_numpy()] = found.column("n").to_numpy()
    return out[:N_TERMS], int(out[N_TERMS])


def truncated_axes(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration."""
    q = np.linalg.qr(x.T @ np.random.default_rng(0).standard_normal((len(x), min(rank + 16, *x.shape))).astype(x.dtype))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v[:rank].T).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 1500, rank: int = 48, piece_bytes: int = 2 << 20) -> Space | None:
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, label, per_class=per_class), "labelled")
    shares = {r["label"]: r["n"] for r in zero_or_one(labels, label).groupBy("label").agg(F.count("*").alias("n")).collect()}

    @releasing
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1, piece_bytes):
                counts = term_counts(batch.column(1))
                held = [np.nonzero(r)[0] for r in counts]
                terms = [k.astype(np.int32).tobytes() for k in held], [r[k].tobytes() for r, k in zip(counts, held, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in terms)], names=["doc_id", "label", "terms", "times"])

    schema = sample.select("doc_id", "label").limit(0).selectExpr("*", "binary('') terms", "binary('') times").schema
    rows = sample.select("doc_id", "text", "label").mapInArrow(run, schema).toArrow().sort_by("doc_id")
    if not rows.num_rows or len(shares) < 1:
        return None
    frequency, n = document_frequencies(docs, piece_bytes)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + 0.1
    idf[frequency == 0] = 0
    counts = np.zeros((rows.num_rows, N_TERMS), dtype=np.float32)
    for i, (terms, times) in enumerate(zip(rows.column("terms").to_pylist(), rows.column("times").to_pylist(), strict=True)):
        counts[i, np.frombuffer(terms, np.int32)] = np.frombuffer(times, np.float32)
    x = weighted(counts, idf)
    y = rows.column("label").to_numpy().astype(np.float32)
    prior = shares.get(1, 0) / sum(shares.values())
    space = Space(idf, truncated_axes(x, min(rank, *x.shape)), None, y, prior)
    space.vectors = np.ascontiguousarray(space.project(counts))
    return space


def votes(space: Space, z: np.ndarray, neighbours: int) -> np.ndarray:
    """Each row's share of label 1 among its nearest labelled vectors, by similarity and label share."""
    k = min(neighbours, len(space.labels))
    sampled = space.labels.mean()
    weight = np.where(space.labels == 1, space.prior / max(sampled, 1e-9), (1 - space.prior) / max(1 - sampled, 1e-9))
    out = np.full(len(z), space.prior)
    for begin in range(0, len(z), 512):
        part = z[begin : begin + 512]
        cosine = part @ space.vectors.T
        kth = np.partition(cosine, -k, axis=1)[:, -k, None]
        tied = cosine == kth
        near = (cosine > kth) | (tied & (np.cumsum(tied, axis=1) <= k - (cosine > kth).sum(axis=1, keepdims=True)))  # of equals the first
        near = np.nonzero(near)[1].reshape(-1, k)
        similar = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 * weight[near]
        total = similar.sum(axis=1)
        share = (similar * space.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        known = (np.abs(part).sum(axis=1) > 0) & (total > 0)
        out[begin : begin + 512][known] = share[known]
    return np.clip(out, 0, 1)


def score(docs: DataFrame, space: Space | None, *, keep: Sequence[str] | None = None, neighbours: int = 15, piece_bytes: int = 2 << 20) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with score, the weighted vote for label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    if space is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(space)

    @releasing
    def run(batches):
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index, piece_bytes):
                found = [votes(held.value, held.value.project(term_counts(batch.column(index).slice(k, 512))), neighbours) for k in range(0, batch.num_rows, 512)]
                out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(found).astype(float))], names=[*keep, "score"])

    schema = docs.select(*keep).limit(0).selectExpr("*", "0D score").schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op10_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out("doc_id", 5, 0))
    found = score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), train(docs, labels), keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
