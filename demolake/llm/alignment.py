"""Alignment of two tokenizers by merge-path partitioning (operator 11).

Both tokenizers cut the same bytes, a space and the text. Where tokens of A and of B
end at the same byte, a group ends; the tokens of a group, of both sides, are its
links. The ends of both sides are two sorted lists, and groups come from merging them.
The merge is cut along diagonals: a binary search on each diagonal finds how many ends of A
and of B come before it, so that every piece between two diagonals takes the same number of
steps and knows nothing of the others. All pieces of a batch step at once. A piece emits the
common ends it meets; a group that runs over the border of pieces is closed by the first
common end of a later piece.

Tokenizing goes by chunks: at a single space between two characters of which neither is white
space, both tokenizers always begin a new token, so that the chunks between such spaces are
tokenized and merged once and remembered. This is used only where the tokenizers' settings prove it;
otherwise a text is one chunk.

Counts of linked id pairs go by portions of documents. A portion holds its distinct pairs, each
with the number of its documents, and each document's pairs as positions in that list. So
a pair is at most one row a portion, however common it is, and the counts go back by portion.
Portions are written as a table before they are counted, a few to a file, as Parquet holds many such rows at once;
documents' positions are compressed there, so that JVMs carry some megabytes for a portion, whatever its pairs.

Nulls and empty texts, and texts whose joined token bytes differ from space and text, have no
tokens: zeros, and an empty hash. Texts may have any length; a group of many tokens is linked by its
distinct ids. A row with a null id, and repeated rows, are documents like any other. Ties for the
most frequent partner count all. Only the id and the text are read, so that other columns
can't clash. An empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import materialize, new_folder
from demolake.llm.text import pieces, releasing, small_batches

#: A space at which both tokenizers begin a token, whatever stands around.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: Chunks of characters whose classes no edition of Unicode has changed, without white space at either end.
_PLAIN = re.compile("[!-~À-ɏ](?:[\t\n\r -~À-ɏ]*[!-~À-ɏ])?")
#: Groups with more links than this are linked by their distinct ids.
_DENSE = 1 << 12
#: So many portions stand in a file at most: Parquet's writers and readers hold a hundred rows and more of a file at once.
_PER_FILE = 8
#: About so many bytes a remembered chunk takes beside its text and its groups.
_CHUNK = 320


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A, from a ``tokenizers`` file of byte-level pairs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges, before = spec["model"]["vocab"], spec["model"]["merges"], spec["pre_tokenizer"] or {}
        of = _byte_characters()
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token)
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.chunked = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.ranks = None
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if self.chunked and [vocabulary[t] for t in joined] == sorted(vocabulary[t] for t in joined) and min(vocabulary[t] for t in joined) > max(vocabulary[c] for c in of):
            import public_tokenizers
            import tiktoken

            self.ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})

    def encode(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each chunk, one after another, and how many each has.

        Plain chunks go by ranks, which are the order of the merges, and all in one text, as no token crosses their spaces.
        """
        plain = np.array([self.ranks is not None and _PLAIN.fullmatch(c) is not None for c in chunks], bool)
        size = np.zeros(len(chunks), np.int64)
        odd = [e.ids for e in self.whole.encode_batch([f" {c}" for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False)]
        size[~plain] = list(map(len, odd))
        by_rank = np.zeros(0, np.int64)
        if plain.any():
            text = "".join([f" {c}" for c, p in zip(chunks, plain, strict=True) if p])
            by_rank = np.array(self.ranks.encode_ordinary(text), np.int64)
            ends = np.cumsum([len(c.encode()) + 1 for c, p in zip(chunks, plain, strict=True) if p])
            size[plain] = np.diff(np.searchsorted(np.cumsum(self.lengths[by_rank]), ends) + 1, prepend=0)
        ids = np.zeros(int(size.sum()), np.int64)
        of_plain = np.repeat(plain, size)
        ids[of_plain], ids[~of_plain] = by_rank, list(itertools.chain.from_iterable(odd))
        return ids, size


class Pieces:
    """Tokenizer B, from a ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        # no piece goes on after a space, and nothing is folded or squeezed: a chunk's pieces are its own
        same = "é  Ａ½"
        self.chunked = not any(" " in b.lstrip(b" ").decode("latin-1") for b in self.bytes) and b"".join(self.bytes[i] for i in self.model.encode(same)) == f" {same}".encode()

    def encode(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, one after another, and how many each has; the model puts a space before a chunk itself."""
        rows = self.model.encode(list(chunks), num_threads=1)
        return np.array(list(itertools.chain.from_iterable(rows)), np.int64), np.fromiter(map(len, rows), np.int64, len(rows))


@functools.lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once in a Python worker."""
    return ByteLevel(a), Pieces(b)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _small(x: np.ndarray) -> np.ndarray:
    """The same counts or ids in the least unsigned kind that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _spells(side, ids: np.ndarray, size: np.ndarray, true: list[bytes]) -> np.ndarray:
    """Whose tokens' bytes, joined, are the true ones."""
    joined = b"".join(map(side.bytes.__getitem__, ids.tolist()))
    if joined == b"".join(true):
        ends = np.append(0, np.cumsum(side.lengths[ids]))[np.cumsum(size)]
        if (ends == np.cumsum([len(t) for t in true])).all():
            return np.ones(len(true), bool)
    rows = np.split(ids, np.cumsum(size)[:-1])
    return np.array([b"".join(side.bytes[i] for i in r) == t for r, t in zip(rows, true, strict=True)], bool)


class Memory:
    """The groups of the chunks seen so far; forgets all when it holds more than ``most`` chunks or about ``most_bytes``."""

    def __init__(self, a: ByteLevel, b: Pieces, most: int = 400_000, most_bytes: int = 96 << 20):
        self.sides, self.most, self.most_bytes = (a, b), most, most_bytes
        self.chunked = a.chunked and b.chunked
        self._forget()

    def _forget(self):
        self.slot: dict[str, int] = {}
        self.written: list[bytes] = []
        self.whole = np.zeros(0, bool)
        self.n = np.zeros((4, 0), np.int64)  # tokens of A and of B, groups, links
        self.first = np.zeros(1, np.int64)  # where a chunk's pairs begin
        self.pair, self.times = _small(np.zeros(0, np.int64)), _small(np.zeros(0, np.int64))
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        true = [f" {c}".encode() for c in chunks]
        found = [side.encode(chunks) for side in self.sides]
        whole = np.logical_and(*(_spells(side, *x, true) for side, x in zip(self.sides, found, strict=True)))
        g = Groups(self.sides, [ids[np.repeat(whole, size)] for ids, size in found], [np.where(whole, size, 0) for _, size in found])
        chunk, pair, times = g.pairs()
        self.n = np.concatenate([self.n, [*g.n, g.per_text(np.ones(len(g.links), np.int64)), g.per_text(g.links)]], axis=1)
        self.first = np.append(self.first, len(self.pair) + np.cumsum(np.bincount(chunk, minlength=len(chunks))))
        self.pair, self.times = np.append(self.pair, _small(pair)), np.append(self.times, _small(times))
        self.whole = np.append(self.whole, whole)
        written = g.written()
        self.written += written
        self.held += sum(map(len, true)) + sum(map(len, written)) + (self.pair.itemsize + self.times.itemsize) * len(pair) + _CHUNK * len(chunks)
        self.slot.update(zip(chunks, range(len(self.slot), len(self.slot) + len(chunks)), strict=True))

    def chunks(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of texts: each one's text and place in this memory, for the texts that have tokens."""
        if len(self.slot) > self.most or self.held > self.most_bytes:
            self._forget()
        cut = [([] if not t else _CUT.split(t) if self.chunked else [t]) for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        slots = list(map(self.slot.get, flat))
        if None in slots:
            self._learn(list(dict.fromkeys(c for c, s in zip(flat, slots, strict=True) if s is None)))
            slots = list(map(self.slot.get, flat))
        slots = np.array(slots, np.int64)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        held = np.bincount(doc[~self.whole[slots]], minlength=len(texts)) == 0
        return doc[held[doc]], slots[held[doc]]

    def groups(self, doc: np.ndarray, slots: np.ndarray, texts: int) -> list[bytes]:
        """Of each text ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        found = list(map(self.written.__getitem__, slots.tolist()))
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=texts))).tolist()
        return [b";".join(found[a:b]) for a, b in itertools.pairwise(ends)]

    def pairs(self, doc: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct linked pairs, by text and pair, and how often each is linked."""
        size = self.first[slots + 1] - self.first[slots]
        at = _ragged(self.first[slots], size)
        return _summed(np.repeat(doc, size) * self._span, self.pair[at], self.times[at], self._span)

    @property
    def _span(self) -> int:
        return self.sides[0].size * self.sides[1].size


@functools.lru_cache(maxsize=1)
def _memory(a: str, b: str) -> Memory:
    """What a Python worker remembers from task to task."""
    return Memory(*tokenizers(a, b))


def diagonals(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` are among the first ``cuts`` ends of both; of equal ends, a's comes first. By binary search on each diagonal."""
    low, high = np.maximum(0, cuts - len(b)), np.minimum(cuts, len(a))
    while (open_ := low < high).any():
        mid = (low[open_] + high[open_]) // 2
        before = a[mid] <= b[cuts[open_] - 1 - mid]
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = 1 << 11) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted lists of ends have an end in common: how many of a's and of b's lie up to it.

    The merge is cut into pieces of ``steps`` steps, which advance together but know nothing of each other.
    """
    total = len(a) + len(b)
    cuts = np.arange(0, total, steps)
    i = diagonals(a, b, cuts)
    j = cuts - i
    last, top = len(a), np.iinfo(np.int64).max
    a, b = np.append(a, top), np.append(b, top)
    met, upto = np.zeros((steps, len(cuts)), bool), np.zeros((steps, len(cuts)), np.int64)
    for s in range(min(steps, total)):
        take_a = a[i] <= b[j]
        met[s] = ~take_a & (i > 0) & (a[i - 1] == b[j])
        upto[s] = i
        j += ~take_a
        i = np.minimum(i + take_a, last)  # past both ends nothing moves
    piece, step = np.nonzero(met.T)
    ia = upto[step, piece]
    return ia, piece * steps + step + 1 - ia


class Groups:
    """The groups of texts, of which both sides have the same bytes."""

    def __init__(self, sides: Sequence, ids: Sequence[np.ndarray], n: Sequence[np.ndarray]):
        self.sides, self.ids, self.n = sides, ids, n
        self.upto = common_ends(*(np.cumsum(side.lengths[i]) for side, i in zip(sides, ids, strict=True)))
        self.size = [np.diff(u, prepend=0) for u in self.upto]
        self.text = np.repeat(np.arange(len(n[0])), n[0])[self.upto[0] - 1]
        self.links = self.size[0] * self.size[1]

    def per_text(self, of_groups: np.ndarray) -> np.ndarray:
        """Sums over each text's groups."""
        ends = np.append(0, np.cumsum(np.bincount(self.text, minlength=len(self.n[0]))))
        sums = np.append(0, np.cumsum(of_groups))[ends]
        return sums[1:] - sums[:-1]

    def written(self) -> list[bytes]:
        """Of each text ``a1,a2|b1;a3|b2,b3``."""
        (ids_a, ids_b), (upto_a, upto_b), (size_a, size_b) = self.ids, self.upto, self.size
        out = np.zeros(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + np.repeat(upto_b - size_b, size_a)] = ids_a
        out[np.arange(len(ids_b)) + np.repeat(upto_a, size_b)] = ids_b
        out *= 3
        out[upto_a + upto_b - size_b - 1] += 1
        out[upto_a + upto_b - 1] += 2
        tokens = list(map(_marked(max(s.size for s in self.sides)).__getitem__, out.tolist()))
        ends = np.append(0, np.cumsum(self.n[0] + self.n[1])).tolist()
        return [b"".join(tokens[a:b])[:-1] for a, b in itertools.pairwise(ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct linked pairs, by text and pair: text, pair (A's id times B's vocabulary plus B's id) and how often."""
        many = self.sides[1].size
        few = np.nonzero(self.links <= _DENSE)[0]
        group = np.repeat(few, self.links[few])
        k = _ragged(np.zeros(len(few), np.int64), self.links[few])
        (a0, b0), of_b = [u - s for u, s in zip(self.upto, self.size, strict=True)], self.size[1][group]
        texts, pairs = [self.text[group]], [self.ids[0][a0[group] + k // of_b].astype(np.int64) * many + self.ids[1][b0[group] + k % of_b]]
        times = [np.ones(len(group), np.int64)]
        for g in np.nonzero(self.links > _DENSE)[0]:  # their links by distinct ids
            (a, na), (b, nb) = (np.unique(i[u[g] - s[g] : u[g]], return_counts=True) for i, u, s in zip(self.ids, self.upto, self.size, strict=True))
            pairs.append((a[:, None].astype(np.int64) * many + b).ravel())
            times.append((na[:, None] * nb).ravel())
            texts.append(np.full(len(pairs[-1]), self.text[g]))
        span = self.sides[0].size * many
        return _summed(np.concatenate(texts) * span, np.concatenate(pairs), np.concatenate(times), span)


def _summed(base: np.ndarray, pair: np.ndarray, times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, pair), in order, and the sums of times; ``base`` is the text times ``span``."""
    key = base + pair
    if (times == 1).all():
        key.sort()
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    first = np.nonzero(np.append(True, key[1:] != key[:-1])[: len(key)])[0]
    sums = np.add.reduceat(times, first, dtype=np.int64) if len(first) else times
    return key[first] // span, key[first] % span, sums


@functools.lru_cache(maxsize=1)
def _marked(n: int) -> list[bytes]:
    """The numbers below n, each with a comma, a bar and a semicolon after it."""
    return [f"{i}{mark}".encode() for i in range(n) for mark in ",|;"]


_ENTRIES = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, first array<long>, place binary, times binary"
_ZSTD = pa.Codec("zstd", compression_level=3)


def _lists(values, kind: pa.DataType) -> pa.Array:
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sealed(row: pa.RecordBatch) -> pa.RecordBatch:
    """A portion's row with places and times compressed: kind, number and bytes; ``_numbers`` reads them."""
    for name in ("place", "times"):
        x = _small(row.column(name).values.to_numpy())
        sealed = x.dtype.itemsize.to_bytes(1, "little") + len(x).to_bytes(8, "little") + _ZSTD.compress(x.tobytes(), asbytes=True)
        row = row.set_column(row.schema.get_field_index(name), name, pa.array([sealed], pa.binary()))
    return row


def _numbers(sealed: bytes) -> np.ndarray:
    size, n = sealed[0], int.from_bytes(sealed[1:9], "little")
    return np.frombuffer(_ZSTD.decompress(sealed[9:], size * n, asbytes=True), f"u{size}")


class _Portion:
    """What was found in the texts of a portion so far."""

    def __init__(self):
        self.ids, self.sha, self.size = [], [], 0
        self.n: list[list[np.ndarray]] = [[], [], [], []]
        self.held: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str | None], memory: Memory) -> None:
        doc, slots = memory.chunks(texts)
        self.ids.append(ids)
        self.size += sum(len(t) for t in texts if t)
        self.sha += [hashlib.sha256(g).hexdigest() if g else "" for g in memory.groups(doc, slots, len(texts))]
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))))
        for found, x in zip(self.n, memory.n, strict=True):
            sums = np.append(0, np.cumsum(x[slots]))[ends]
            found.append(sums[1:] - sums[:-1])
        doc, pair, times = memory.pairs(doc, slots)
        self.held.append(np.bincount(doc, minlength=len(texts)))
        pair, place = np.unique(pair, return_inverse=True)
        self.pair.append(pair)
        self.place.append(place.astype(np.int32))
        self.times.append(_small(times))

    def row(self, portion: int, names: list[str]) -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate(self.pair), return_inverse=True)
        ends = np.cumsum(list(map(len, self.pair)))[:-1]
        place = np.concatenate([a.astype(np.int32)[p] for a, p in zip(np.split(at, ends), self.place, strict=True)])
        docs = np.bincount(place, minlength=len(pair))
        first = np.append(0, np.cumsum(np.concatenate(self.held)))
        ids = pa.chunked_array(self.ids).combine_chunks()
        arrays = [pa.array([portion], pa.int64()), _lists(pair, pa.int64()), _lists(docs, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        arrays += [_lists(np.concatenate(x), pa.int64()) for x in self.n]
        times = np.concatenate(self.times)
        arrays += [_lists(self.sha, pa.string()), _lists(first, pa.int64()), _lists(place, pa.int32()), _lists(times, pa.from_numpy_dtype(times.dtype))]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def portions(docs: DataFrame, *, id: str, text: str, a: str, b: str, size: int, at_once: int = 1 << 20) -> DataFrame:
    """One row for each portion of about ``size`` bytes of text: its distinct pairs with their documents, and the documents' own figures and pairs."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    schema = f"portion long, pairs array<long>, docs array<long>, ids array<{rows.schema['id'].dataType.simpleString()}>, {_ENTRIES}"
    names = [f.strip().split(" ")[0] for f in ("portion, pairs, docs, ids, " + _ENTRIES).split(", ")]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held_back, k = _memory(a, b), _Portion(), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, 1, at_once):
                held_back.add(piece.column(0), piece.column(1).to_pylist(), memory)
                if held_back.size >= size:
                    yield _sealed(held_back.row(task + k, names))
                    held_back, k = _Portion(), k + 1
        if held_back.ids:
            yield _sealed(held_back.row(task + k, names))

    return rows.mapInArrow(run, schema)


def pair_counts(table: DataFrame, pieces_b: int) -> DataFrame:
    """Of each linked pair: how many documents hold it (n), and whether that is the most that its A id reaches (best)."""
    held = table.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = materialize(held.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(pieces_b)).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # no more rows than A's vocabulary has
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@releasing
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            value = lambda name, r=r, batch=batch: batch.column(batch.schema.get_field_index(name))[r]
            field = lambda name, value=value: value(name).values
            first, place, times = field("first").to_numpy(), *(_numbers(value(x).as_py()) for x in ("place", "times"))
            most = int(place.max()) + 1 if len(place) else 0
            n, best = np.zeros(most, np.int64), np.zeros(most, bool)
            found = field("found")
            if found is not None:
                at = found.field("at").to_numpy()
                n[at], best[at] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            sums = [np.zeros(len(place) + 1, np.int64) for _ in range(2)]
            for x, total in zip((best, n), sums, strict=True):
                np.cumsum(np.multiply(x[place], times, dtype=np.int64), out=total[1:])
            yield pa.RecordBatch.from_arrays(
                [field("ids"), *(field(x) for x in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(s[first[1:]] - s[first[:-1]], pa.int64()) for s in sums), field("groups_sha256")],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def align(docs: DataFrame, *, id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, portion: int = 16 << 20) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see the module.

    ``a`` and ``b`` are paths of the tokenizers' files, which every executor must have.
    """
    spark = docs.sparkSession
    a, b = a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model")
    path = new_folder(spark, "portions")
    found = portions(docs, id=id, text=text, a=a, b=b, size=portion)
    found.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).option("maxRecordsPerFile", _PER_FILE).parquet(path)
    table = spark.read.schema(found.schema).parquet(path)
    counts = pair_counts(table, tokenizers(a, b)[1].size)
    asked = table.select("portion", F.posexplode("pairs").alias("at", "pair"))
    back = asked.join(counts, "pair").groupBy("portion").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    kind = table.schema["ids"].dataType.elementType.simpleString()
    rows = table.drop("pairs", "docs").join(back, "portion", "left").mapInArrow(_finish, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return rows.withColumnRenamed("id", id)


def token_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """The groups themselves: id, groups (string ``a1,a2|b1;a3|b2,b3``; empty where a text has no tokens)."""
    a, b = a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)

    @releasing
    def run(batches):
        memory = _memory(a, b)
        for batch in batches:
            for piece in pieces(batch, 1, 4 << 20):
                texts = piece.column(1).to_pylist()
                groups = [g.decode() for g in memory.groups(*memory.chunks(texts), len(texts))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(groups, pa.string())], names=["id", "groups"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, groups string").withColumnRenamed("id", id)


def op11_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
