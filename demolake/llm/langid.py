"""Language ID by segmentation-marginalised unigrams (operator 3).

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words, as no piece crosses
a word's end. Piece probabilities come from expectation maximisation over the
counts of all words in the training texts of a language: forward and backward
sums give the expected number of uses of every piece.

The vocabulary's path is a parameter; its lower-cased pieces of letters and all
single bytes (with a small probability) are used, so that any text has a score.

Sums are kept as logarithms, so that a word may have any length: a script without
spaces makes a sentence one word, and all its segmentations count.

Nulls: a row without text, or without any letter, is ``und`` with score 0; rows
without text or lang don't train. Ties go to the language first in order.
Without training rows everything is ``und``. Repeated rows are rows like any
other; equal texts get equal scores. Input columns named lang_pred or score are
replaced; others stay. An empty table gives none. Over ``max_languages`` learned
languages are refused, as their probabilities would outgrow a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import materialize
from demolake.llm.text import LETTERS, mix, pieces, range_hashes, releasing, small_batches, word_counts

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ASCII_LETTER = re.compile("[A-Za-z]")
ADDED = ("lang_pred", "score")
#: Stands before a word, as the vocabulary's mark of a word's start does.
MARK = b"\x01"


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces to use, from a sentencepiece model file: those of letters only, lower-cased, then all bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    found = {p.lower() for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if p.lstrip("▁").isalpha() or p == "▁"}
    long = sorted(b for b in {p.replace("▁", "\x01").encode() for p in found} if len(b) > 1)
    return long + [bytes([b]) for b in range(256)]


class Lattice:
    """All places where pieces match in a batch of words."""

    def __init__(self, vocabulary: Sequence[bytes]):
        self.n = len(vocabulary)
        hashed = {}
        for size in sorted({len(p) for p in vocabulary}):
            ids = np.array([i for i, p in enumerate(vocabulary) if len(p) == size])
            data = np.frombuffer(b"".join(vocabulary[i] for i in ids), dtype=np.uint8)
            at = np.arange(len(ids)) * size
            keys = range_hashes(_BYTES[data], at, at + size)
            order = np.argsort(keys)
            hashed[size] = keys[order], ids[order]
        self.by_size = hashed

    def match(self, words: Sequence[bytes]):
        """Begins and ends of the words' nodes, and the matches by their end within the word, then by node: from node, to node, piece, end."""
        marked = [MARK + w for w in words]
        sizes = np.array([len(w) for w in marked])
        data = np.frombuffer(b"".join(marked), dtype=np.uint8)
        begin = np.cumsum(sizes) - sizes
        node = begin + np.arange(len(words))  # a word of n bytes has n + 1 nodes
        place = np.arange(len(data)) - np.repeat(begin, sizes)
        left = np.repeat(sizes, sizes) - place
        base = np.repeat(node, sizes) + place
        sources, targets, found, ends = [], [], [], []
        for size, (keys, ids) in self.by_size.items():
            at = np.nonzero(left >= size)[0]
            if not len(at):
                continue
            h = range_hashes(_BYTES[data], at, at + size)
            k = np.searchsorted(keys, h)
            k[k == len(keys)] = 0
            hit = keys[k] == h
            at = at[hit]
            sources.append(base[at])
            targets.append(base[at] + size)
            found.append(ids[k[hit]])
            ends.append(place[at] + size)
        source, target, piece, end = map(np.concatenate, (sources, targets, found, ends))
        size = target - source
        order = np.lexsort((size, target, end))
        source, target, piece, end = source[order], target[order], piece[order], end[order]
        return node, node + sizes, source, target, piece, end


def _steps(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])


def _sweep(logs: np.ndarray, into: np.ndarray, out_of: np.ndarray, q: np.ndarray, key: np.ndarray) -> None:
    """Adds up, in logarithms and in the order of key, what arrives ``into`` each node; rows of one key and node lie together."""
    cuts = _steps(key)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        runs = _steps(into[a:b])[:-1]
        logs[into[a:b][runs]] = np.logaddexp.reduceat(logs[out_of[a:b]] + q[a:b], runs, axis=0)


def forward(lattice: Lattice, words: Sequence[bytes], log_p: np.ndarray) -> np.ndarray:
    """Log probability of every word (rows) in every language (columns); log_p: pieces by languages."""
    first, last, source, target, piece, end = lattice.match(words)
    f = np.full((int(last[-1]) + 1, log_p.shape[1]), -np.inf)
    f[first] = 0
    _sweep(f, target, source, log_p[piece], end)
    return f[last]


def expected(lattice: Lattice, words: Sequence[bytes], lang: np.ndarray, n: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of pieces in n times each word under its own language: keys (piece * languages + language) and sums."""
    first, last, source, target, piece, end = lattice.match(words)
    nodes = int(last[-1]) + 1
    of = np.repeat(np.arange(len(words)), last - first + 1)
    q = log_p[piece, lang[of[source]]]
    f, b = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
    f[first] = 0
    b[last] = 0
    _sweep(f, target, source, q, end)
    begin = source - first[of[source]]
    back = np.lexsort((source, -begin))  # later begins first
    _sweep(b, source[back], target[back], q[back], begin[back])
    share = np.exp(f[source] + q + b[target] - f[last][of[source]]) * n[of[source]]
    keys, at = np.unique(piece * log_p.shape[1] + lang[of[source]], return_inverse=True)
    return keys, np.bincount(at, weights=share)


def portions(words: Sequence[bytes], rows: int = 20_000, size: int = 1 << 18):
    """Ranges of at most so many words and, but for a longer word, bytes."""
    begin = total = 0
    for k, w in enumerate(words):
        if k > begin and (k - begin >= rows or total + len(w) > size):
            yield slice(begin, k)
            begin = k
            total = 0
        total += len(w)
    if begin < len(words):
        yield slice(begin, len(words))


class Model:
    def __init__(self, languages: list[str], vocabulary: list[bytes], p: np.ndarray, prior: np.ndarray):
        self.languages, self.vocabulary, self.p, self.prior = languages, vocabulary, p, prior


def train(docs: DataFrame, *, vocabulary_path: str | None = None, iterations: int = 2, max_languages: int = 1000) -> Model:
    """Learns from the columns text and lang of docs. What reaches the driver is pieces times languages at most."""
    spark = docs.sparkSession
    pieces_ = vocabulary(vocabulary_path)
    counts = materialize(word_counts(docs.filter("text IS NOT NULL AND lang IS NOT NULL"), "text", ["lang"]), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(max_languages + 1).collect()
    if len(totals) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    languages = [r["lang"] for r in totals]
    p = np.full((len(pieces_), len(languages)), 1.0 / len(pieces_))
    p[-256:] *= 1e-2
    for _ in range(iterations if languages else 0):
        held = spark.sparkContext.broadcast((pieces_, languages, p))

        @releasing
        def uses(batches):
            pieces_, languages, p = held.value  # noqa: B023
            lattice, index, log_p = Lattice(pieces_), {x: i for i, x in enumerate(languages)}, np.log(p)
            total = np.zeros(p.size)
            for batch in batches:
                lang, words, n = (batch.column(c).to_pylist() for c in range(3))
                for part in portions(words):
                    keys, sums = expected(lattice, words[part], np.array([index[a] for a in lang[part]]), np.array(n[part], dtype=float), log_p)
                    total[keys] += sums
            keys = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], names=["k", "x"])

        found = counts.select("lang", "word", "n").mapInArrow(uses, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        c = np.zeros(p.size)
        c[found.column("k").to_numpy()] = found.column("x").to_numpy()
        c = c.reshape(p.shape)
        pooled = (c.sum(axis=1) + 1e-3) / (c.sum() + 1e-3 * len(c))
        alpha = 1e-3 * c.sum(axis=0) + 1
        p = (c + alpha * pooled[:, None]) / (c.sum(axis=0) + alpha)
        p[-256:] = np.maximum(p[-256:], 1e-8)
    n = np.array([r["n"] for r in totals], dtype=float)
    return Model(languages, pieces_, p, np.log(n / n.sum()) if len(n) else n)


def predict(docs: DataFrame, model: Model, *, keep: Sequence[str] | None = None, cache_words: int = 500_000) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with lang_pred and score (the language's posterior probability)."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    held = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches):
        m = held.value
        lattice, langs, log_p = Lattice(m.vocabulary), len(m.languages), np.log(m.p)
        room = max(1000, min(cache_words, 32_000_000 // max(1, langs)))
        known: dict[bytes, int] = {}
        table = np.zeros((langs, room + 1))
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index):
                texts = batch.column(index).to_pylist()
                lettered = [bool(t) and (_ASCII_LETTER.search(t) is not None or any(map(str.isalpha, t))) for t in texts]
                words = [t.lower().encode("utf-8", "replace").translate(LETTERS).split() if ok else [] for t, ok in zip(texts, lettered, strict=True)]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                some = sizes > 0
                begins = (np.cumsum(sizes) - sizes)[some]
                flat = [w for ws in words for w in ws]
                new = list(set(flat) - known.keys()) if langs else []
                extra = np.zeros((langs, len(new)))
                for part in portions(new):
                    extra[:, part] = forward(lattice, new[part], log_p).T
                stay = min(len(new), room - len(known))
                for w in new[:stay]:
                    known[w] = len(known)
                if stay:
                    table[:, len(known) - stay : len(known)] = extra[:, :stay]
                fresh = {w: room + 1 + k for k, w in enumerate(new[stay:])}
                rest = extra[:, stay:]
                if fresh:
                    at = np.fromiter((known.get(w, -1) if w in known else fresh[w] for w in flat), dtype=np.int64, count=len(flat))
                else:
                    at = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat)) if langs else np.zeros(0, np.int64)
                scores = np.zeros((len(texts), langs))
                for lang in range(langs if len(at) else 0):
                    scores[some, lang] = np.add.reduceat(np.concatenate([table[lang], rest[lang]])[at], begins)
                scores += m.prior
                name, score = [], []
                if langs:
                    best = scores.argmax(axis=1)
                    share = 1 / np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -700)).sum(axis=1)
                for i, ok in enumerate(lettered):
                    name.append(m.languages[best[i]] if ok and langs else "und")
                    score.append(float(share[i]) if ok and langs else 0.0)
                out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(name, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).limit(0).selectExpr("*", "'' lang_pred", "0D score").schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(doc_id: str, modulus: int, rest: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == rest


def op3_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 5, 0))
    model = train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
