"""Spelling variants of words by dense prefix-suffix tiling (operator 13).

Words are maximal runs of letters of all texts, by how often they occur. Two words are near if one
inserted, deleted or replaced code point makes one of the other; that is, if their common
prefix and common suffix together reach the longer length minus one.

Then one of the two alone reaches half of that, so that near words meet in a tile: a tile holds
words of one longer length that share a prefix or a suffix of half that length. In a tile, words stand in
padded code-point matrices, once from their beginnings and once from their ends, and blocks of rows are
compared with blocks of rows: the first differing column on either side gives both common lengths. A tile of over
``tile_rows`` words is tiled again in the same way, by half of what its words don't share yet, until
it is small enough or all its words are near each other, of which there are no more than letters. A
pair is counted in one tile only: of two tiles that share it, in the one of the longer common prefix.

A tile emits one row for each of its words with near words: how many, and the best. No pair leaves
its tile, and no word its vocabulary: all this grows with the number of distinct words, not with the texts.

A word's form is its near word with the largest n (ties: the first in code-point order), if that n is at least
``ratio`` times its own; so n grows along forms, chains are short, and roots are found by doubling.

Nulls and empty texts have no words; texts may have any length. A row with a null id counts, but alters no word; repeated
rows are rows like any other. Only the id and the text are read, so that other columns can't clash. An empty table
gives none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.llm.scratch import materialize
from demolake.llm.text import pieces, releasing, small_batches

#: Runs after A-Z have been lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
#: A run of a document loses a code point where this divides its checksum.
_EVERY = 97
_TILE = ["longer", "prefix", "suffix", "below", "shared"]


def words_of(id: str | None, text: str) -> Counter:
    """The words of one text and how often each stands there, after the alterations that its id brings about."""
    found = Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode()))
    if id is None:
        return found
    begun = zlib.crc32(f"{id}:".encode())
    altered = [(w, at, found[w]) for w in found if (at := zlib.crc32(w.encode(), begun)) % _EVERY == 0]
    for word, _, _ in altered:
        del found[word]
    for word, at, n in altered:
        k = at % len(word)
        found[word[:k] + word[k + 1 :]] += n
    return found


def word_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", most: int = 300_000) -> DataFrame:
    """Columns word and n, over all texts; counted within each task first, then summed."""
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for piece in pieces(batch, 1):
                for key, value in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for word, n in words_of(key, value or "").items():
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > most:
                    yield emit()
        if counts:
            yield emit()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _first_tiles(words: DataFrame) -> DataFrame:
    """All words, once for each longer length that a pair of theirs can have."""
    length = F.char_length("word")
    return words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"), F.lit(0).alias("prefix"), F.lit(0).alias("suffix"), F.lit(1 << 20).alias("below"))


def _tile_again(tiles: DataFrame) -> DataFrame:
    """Each word in two tiles: by half of what is not shared yet, from the beginning on or from the end."""
    half = F.floor((F.col("longer") - F.col("prefix") - F.col("suffix")) / 2).cast("int")
    both = F.array(
        F.struct((F.col("prefix") + half).alias("prefix"), F.col("suffix").alias("suffix"), F.col("below").alias("below")),
        F.struct(F.col("prefix").alias("prefix"), (F.col("suffix") + half).alias("suffix"), F.least("below", F.col("prefix") + half).alias("below")),
    )
    rows = tiles.select("word", "n", "longer", F.explode(both).alias("t")).select("word", "n", "longer", "t.*")
    # right() of no characters is empty, as is left()
    return rows.withColumn("shared", F.concat_ws(" ", F.expr("left(word, prefix)"), F.expr("right(word, suffix)")))


def tiles(words: DataFrame, tile_rows: int) -> DataFrame:
    """Words by tile (longer, prefix, suffix, below, shared): all tiles of at least two words and at most ``tile_rows``, or that can't be tiled again."""
    done, todo = [], _first_tiles(words)
    while True:
        sized = _tile_again(todo).withColumn("size", F.count("*").over(Window.partitionBy(*_TILE))).filter("size > 1")
        sized = materialize(sized, "tiles")
        last = F.col("longer") - F.col("prefix") - F.col("suffix") < 2
        done.append(sized.filter(last | (F.col("size") <= tile_rows)))
        todo = sized.filter(~last & (F.col("size") > tile_rows))
        if todo.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _matrix(words: list[str], width: int, pad: int) -> np.ndarray:
    """Code points from the left, padded; the last column is padding only."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    return np.where(flat == 0, pad, flat)


def near_in_tile(words: list[str], longer: int, prefix: int, suffix: int, below: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a tile: how many words are near, and the first of them (their number if none). Words of the longer length meet all, those shorter by one only the longer."""
    rows, width = len(words), longer + 1
    length = np.array(list(map(len, words)))
    whole = np.nonzero(length == longer)[0]
    count, first = np.zeros(rows, np.int64), np.full(rows, rows)
    if not len(whole):
        return count, first
    back = [w[::-1] for w in words]
    # in the two sides of a comparison padding differs, so that no common length runs past a word's end
    left = [_matrix(words, width, pad)[:, prefix:] for pad in (0, 1 << 21)]
    right = [_matrix(back, width, pad)[:, suffix:] for pad in (0, 1 << 21)]
    tall = max(1, block // (rows * width))
    for a in range(0, len(whole), tall):
        at = whole[a : a + tall]
        begin = prefix + (left[0][at][:, None] == left[1][None]).argmin(axis=2)
        end = suffix + (right[0][at][:, None] == right[1][None]).argmin(axis=2)
        near = (begin + end >= longer - 1) & (begin < below)
        near[np.arange(len(at)), at] = False
        count[at] += near.sum(axis=1)
        first[at] = np.minimum(first[at], np.where(near.any(axis=1), near.argmax(axis=1), rows))
        short = near & (length < longer)[None]
        count += short.sum(axis=0)
        first = np.minimum(first, np.where(short.any(axis=0), at[short.argmax(axis=0)], rows))
    return count, first


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile, and in a tile the largest n first, then by word."""
    key, held = None, []

    def emit():
        words, n = zip(*held, strict=True)
        count, first = near_in_tile(list(words), *key[:4])
        found = np.nonzero(count)[0].tolist()
        best = [int(first[i]) for i in found]
        return [words[i] for i in found], count[found].tolist(), [n[i] for i in best], [words[i] for i in best]

    def batch_of(rows):
        columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []]
        flat = [[v for part in column for v in part] for column in columns]
        return pa.RecordBatch.from_arrays([pa.array(flat[0], pa.string()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.string())], names=["word", "n_near", "near_n", "near"])

    for batch in batches:
        rows, columns = [], [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for *tile, word, n in zip(*columns, strict=True):
            if tile != key:
                if len(held) > 1:
                    rows.append(emit())
                key, held = tile, []
            held.append((word, n))
        yield batch_of(rows)
    if len(held) > 1:
        yield batch_of([emit()])


def near_words(words: DataFrame, *, tile_rows: int = 2048) -> DataFrame:
    """Of each word (columns word, n) with near words: n_near, and of the most frequent of them near and near_n."""
    rows = tiles(words, tile_rows).select(*_TILE, "word", "n")
    by_tile = rows.repartition(*_TILE).sortWithinPartitions(*_TILE, F.col("n").desc(), "word")
    found = by_tile.mapInArrow(_near, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """The last word that is reached from each word along (word, form), by doubling; ``longest`` bounds the steps."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(max(2, longest)))):
        beyond = up.select(F.col("word").alias("at"), F.col("root").alias("next"))
        up = materialize(up.join(beyond, up["root"] == beyond["at"], "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return up


def variants(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_length: int = 5, least_n: int = 3, ratio: int = 2, tile_rows: int = 2048) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n; see the module."""
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains have no end")
    counted = word_counts(docs, id=id, text=text).filter((F.col("n") >= least_n) & (F.char_length("word") >= least_length))
    words = materialize(counted, "words")
    near = near_words(words, tile_rows=tile_rows)
    held = F.col("near_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("near")).alias("form"), F.when(held, F.col("near_n")).alias("form_n"))
    rows = materialize(rows, "word-forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    up = roots(rows.filter("form IS NOT NULL"), math.ceil(math.log(most, ratio)) + 1)
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_prefix_suffix_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
