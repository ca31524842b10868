"""Toxicity by noisy-channel deobfuscation (operator 9).

Tokens that look disguised (look-alikes or separators, a letter three times in a
row, letters written apart) become a lattice of readings: a look-alike of one
character or more stands for its letters, a separator may vanish, a run of one
letter may shrink. Viterbi decoding picks the reading that a character trigram
model of the corpus likes best, less the channel's costs. A token without any
letter may also be no word at all, at a cost for each character. The restored
words are then scored.

The character model comes from the counts of all words of all texts. The
classifier learns from a bounded sample of labelled rows (``per_class`` each): a
multinomial model of words and word beginnings that are typical of toxic texts,
and a logistic curve over a text's sum, hit count and hit rate.

Nulls and empty texts have no evidence and get the score of such a text; a null
label doesn't train; labels may be of any type that casts to 0 and 1, ids of any
type. Of several labels of one doc_id the largest counts. Without training rows of
both kinds every score is 0. Repeated rows are scored alike. An input column named
score is replaced; other columns stay. An empty table gives none. Texts and tokens
are read whole, whatever their length; the model itself has ``most_features``
words and beginnings at most, the most frequent ones in toxic samples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.langid import held_out
from demolake.llm.scratch import materialize
from demolake.llm.text import pieces, releasing, small_batches, word_counts

#: Look-alikes and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Look-alikes of several characters.
DRAWN = {"|)": "d", "|<": "k", "/\\": "a", "\\/": "v", "()": "o", "|-|": "h", "|\\|": "n", "|_|": "u"}
SEPARATORS = ".-_*~'`^·"
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¿¡"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LOOKS = frozenset(LEET) | frozenset(SEPARATORS)
_SIGNS = "@$|€"  # look-alikes that are no punctuation, so that they count at a word's end as well


class CharModel:
    """A trigram model of letters with absolute discounting towards shorter contexts."""

    def __init__(self, alphabet: str, trigrams: dict[str, int]):
        self.alphabet = frozenset(alphabet)
        self.tri = Counter(trigrams)
        self.bi, self.uni = Counter(), Counter()
        self.after2, self.after1 = Counter(), Counter()
        for g, n in self.tri.items():
            self.bi[g[1:]] += n
            self.uni[g[2]] += n
            self.after2[g[:2]] += n
        for g, n in self.bi.items():
            self.after1[g[0]] += n
        self.total, self.memo = sum(self.uni.values()) or 1, {}

    def log(self, context: str, c: str) -> float:
        key = context + c
        got = self.memo.get(key)
        if got is None:
            p = (self.uni[c] + 0.1) / (self.total + 0.1 * (len(self.alphabet) + 2))
            for n, whole in ((self.bi[key[1:]], self.after1[context[1]]), (self.tri[key], self.after2[context])):
                if whole:
                    p = (max(n - 0.5, 0) + (0.5 * min(whole, 20)) * p) / (whole + 0.5 * min(whole, 20) - 0.5 * min(n, 1))
            got = self.memo[key] = math.log(p)
        return got

    def fold(self, c: str) -> str:
        return c if c in self.alphabet else "?"


def char_model(docs: DataFrame, *, letters: int = 96) -> CharModel:
    """Learns from all words of the column text; the ``letters`` most frequent letters have a symbol each, so that (letters + 2) ** 3 counts reach the driver at most."""
    words = materialize(word_counts(docs, "text", []), "words").select(F.decode("word", "UTF-8").alias("w"), "n")
    singles = words.select(F.explode(F.split("w", "")).alias("c"), "n").filter("c != ''").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = sorted(r["c"] for r in singles.orderBy(F.desc("n"), "c").limit(letters).collect())
    held = docs.sparkSession.sparkContext.broadcast(frozenset(alphabet))

    @releasing
    def trigrams(batches):
        known, total = held.value, Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = "^^" + "".join(c if c in known else "?" for c in w) + "^"
                for k in range(len(w) - 2):
                    total[w[k : k + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["g", "n"])

    found = words.mapInArrow(trigrams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return CharModel("".join(alphabet), dict(zip(found.column("g").to_pylist(), found.column("n").to_pylist(), strict=True)))


def arcs(token: str, *, swap: float = 1.0, drop: float = 0.5, shrink: float = 0.7, stay: float = 6.0) -> list[list[tuple[int, str, float]]]:
    """The lattice of a token: for each place the arcs (place it leads to, what is read, cost).

    Costs: ``swap`` for reading a look-alike as a letter, ``drop`` for leaving out
    separators, ``shrink`` for shortening a run, ``stay`` for keeping a character that is no letter.
    """
    out: list[list[tuple[int, str, float]]] = []
    size, run = len(token), [1] * (len(token) + 1)
    for i in range(size - 2, -1, -1):
        run[i] = run[i + 1] + 1 if token[i] == token[i + 1] else 1
    for i, c in enumerate(token):
        own, n = [], run[i]
        long = n > 2 or (i > 0 and run[i - 1] > 2 and token[i - 1] == c)
        letters = ([(c, 0.0)] if c.isalpha() else []) + [(x, swap) for x in LEET.get(c, "")]
        for x, cost in letters:
            own += [] if long else [(i + 1, x, cost)]
            own += [(i + n, x * m, cost * n + shrink) for m in (1, 2) if m < n]
        if c in SEPARATORS or (not c.isalnum() and (i == 0 or i + n == size)):  # punctuation, too, at either end
            own.append((i + n, "", drop))
        if not letters:
            own.append((i + 1, c, stay))
        own += [(i + len(d), x, swap) for d, x in DRAWN.items() if token.startswith(d, i)]
        out.append(own)
    return out


def decode(token: str, model: CharModel, *, blank: float = 4.2, **costs: float) -> str:
    """The likeliest reading of a disguised token (Viterbi over place and last two letters).

    A token without letters reads as nothing if every reading costs over ``blank`` a character.
    """
    lattice = arcs(token, **costs)
    paths: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(len(token) + 1)]
    paths[0]["^^"] = (0.0, None)
    for i, own in enumerate(lattice):
        for context, (score, back) in paths[i].items():
            for to, text, cost in own:
                s, at = score - cost, context
                for x in text:
                    y = model.fold(x)
                    s += model.log(at, y)
                    at = at[1] + y
                if s > paths[to].get(at, (-math.inf,))[0]:
                    paths[to][at] = (s, (back, text) if text else back)
        paths[i] = {}
    if not paths[-1]:
        return token
    score, _, back = max((s + model.log(at, "^"), -i, b) for i, (at, (s, b)) in enumerate(paths[-1].items()))
    if score < -blank * len(token) and not any(map(str.isalpha, token)):
        return ""
    out = []
    while back is not None:
        back, text = back
        out.append(text)
    return "".join(reversed(out))


def restore(token: str, model: CharModel) -> str:
    """A lower-case token without edge punctuation, decoded if it looks disguised."""
    bare = token.strip(_EDGE)
    if bare.isalpha() and not any(c in token for c in _SIGNS):
        return decode(bare, model) if _TRIPLE.search(bare) else bare
    inner = token.strip("\"'(),.:;?#%&*-_[]{}<>/\\=~`^") if not any(d in token for d in DRAWN) else token
    if any(c in _LOOKS for c in inner) or _TRIPLE.search(inner):
        return decode(inner, model)
    return bare if any(map(str.isalpha, bare)) else ""


def restored_words(text: str | None, read) -> list[str]:
    """All words of a text, disguised ones restored, and letters written apart joined. read: a token's reading."""
    tokens = (text or "").lower().split()
    words = list(map(read, tokens))
    singles = [k for k, w in enumerate(words) if len(w) == 1]
    run: list[int] = []
    for k in [*singles, -1]:
        if run and k == run[-1] + 1:
            run.append(k)
            continue
        if len(run) >= 3:
            words.append(read("".join(tokens[j].strip(_EDGE) or tokens[j] for j in run)))
        run = [k]
    return words


def zero_or_one(labels: DataFrame, label: str) -> DataFrame:
    """Columns doc_id and label (int): one row per labelled doc_id, of several labels the largest."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int) -> DataFrame:
    """Text and label of at most ``per_class`` documents of each label, chosen by a hash of doc_id; their ids, so bounded, are broadcast.

    Of rows that repeat a doc_id, the one smallest by (xxhash64(text), text) counts.
    """
    kept = zero_or_one(labels, label)
    ids = None
    for value in (0, 1):
        part = kept.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("text"), "label")


class ToxicModel:
    def __init__(self, chars: CharModel, weights: dict[str, float], other: float, shortest: int, curve: np.ndarray):
        self.chars, self.weights, self.other, self.shortest, self.curve = chars, weights, other, shortest, curve

    def weight(self, word: str) -> float:
        """The evidence of a restored word: its own, or that of its longest known beginning."""
        w = self.weights
        if (x := w.get("=" + word)) is not None:
            return x
        for k in range(min(len(word), self.shortest + 6), self.shortest - 1, -1):
            if (x := w.get(word[:k])) is not None:
                return x
        return self.other

    def features(self, weights: Sequence[float]) -> list[float]:
        x = np.asarray(weights)
        hits = int((x > self.other).sum()) if len(x) else 0
        total = float(x.sum()) if len(x) else 0.0
        return [math.copysign(math.sqrt(abs(total)), total), math.log1p(hits), math.sqrt(hits / (len(x) + 5)), 1.0]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, grad)
    return w


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 6000, evidence: float = 1.5, least: int = 5, most_features: int = 20_000, shortest: int = 4) -> ToxicModel | None:
    """Fits on labelled rows only; docs without a label serve the character model alone."""
    spark = docs.sparkSession
    chars = char_model(docs)
    held = spark.sparkContext.broadcast(chars)
    sample = materialize(labelled_sample(docs, labels, label, per_class=per_class), "labelled")

    @releasing
    def count(batches):
        memo: dict[str, str] = {}

        def read(token):
            got = memo.get(token)
            if got is None:
                got = memo[token] = restore(token, held.value)
            return got

        total, texts = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Counter(w for w in restored_words(text, read) if w)
                total[y].update(own)
                texts[y].update(own.keys())
        for y, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64()), pa.array([texts[y][w] for w in c], pa.int64())], names=["w", "y", "n", "d"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0
    words = materialize(sample.filter(half).select("text", "label").mapInArrow(count, "w string, y int, n long, d long").groupBy("w").agg(*(F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{a}{y}") for y in (0, 1) for a, c in (("c", "n"), ("d", "d")))), "evidence")
    n0, n1 = words.agg(F.sum("c0"), F.sum("c1")).first()
    if not n0 or not n1:
        return None
    counted = ["c0", "c1", "d0", "d1"]
    begins = words.select(F.explode(F.transform(F.sequence(F.lit(shortest), F.lit(shortest + 6)), lambda k: F.when(F.length("w") > k, F.substring("w", 1, k)))).alias("f"), *counted).filter("f IS NOT NULL")
    found = words.select(F.concat(F.lit("="), "w").alias("f"), *counted).union(begins).groupBy("f").agg(*(F.sum(c).alias(c) for c in counted))
    ratio = F.log((F.col("c1") + 0.5) / n1) - F.log((F.col("c0") + 0.5) / n0)
    rows = found.filter((F.col("d1") >= least) & (F.col("d1") > 2 * F.col("d0") * n1 / n0)).withColumn("r", ratio).filter(F.col("r") >= evidence).orderBy(F.desc("c1"), "f").limit(most_features).collect()
    weights = {r["f"]: r["r"] for r in rows}
    wholes = [r for r in rows if r["f"][0] == "="]
    firsts = [r for r in rows if r["f"][0] != "=" and r["f"][:-1] not in weights]
    share1 = min(0.9, (sum(r["c1"] for r in wholes) + sum(r["c1"] for r in firsts)) / n1)
    share0 = min(0.9, (sum(r["c0"] for r in wholes) + sum(r["c0"] for r in firsts)) / n0)
    model = ToxicModel(chars, weights, math.log((1 - share1) / (1 - share0)), shortest, np.zeros(4))
    carried = spark.sparkContext.broadcast(model)

    @releasing
    def featured(batches):
        m, memo = carried.value, {}

        def read(token):
            got = memo.get(token)
            if got is None:
                got = memo[token] = restore(token, m.chars)
            return got

        for b in batches:
            rows = [m.features([m.weight(w) for w in restored_words(t, read) if w]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    fit = sample.filter(~half).select("text", "label").mapInArrow(featured, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in fit]).reshape(-1, 4), np.array([r["y"] for r in fit], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    model.curve = logistic(x, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: ToxicModel | None, *, keep: Sequence[str] | None = None, cache_tokens: int = 200_000) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with score: how likely the text is toxic, toxic and other texts being equally frequent."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    small_batches(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches):
        m = held.value
        memo: dict[str, float] = {}  # a word's evidence; nan: no word
        letters: set[str] = set()  # tokens that read as one letter

        def read(token):
            got = memo.get(token)
            if got is None:
                word = restore(token, m.chars)
                got = m.weight(word) if word else math.nan
                if len(word) == 1:
                    letters.add(token)
                if len(memo) < cache_tokens or len(word) == 1:
                    memo[token] = got
            return got

        def weigh(text):
            tokens = (text or "").lower().split()
            x = np.fromiter(map(read, tokens), dtype=float, count=len(tokens))
            singles = [k for k, t in enumerate(tokens) if t in letters]
            more, run_ = [], []
            for k in [*singles, -1] if len(singles) > 2 else ():
                if run_ and k == run_[-1] + 1:
                    run_.append(k)
                    continue
                if len(run_) >= 3:
                    more.append(read("".join(tokens[j].strip(_EDGE) or tokens[j] for j in run_)))
                run_ = [k]
            x = np.concatenate([x, more]) if more else x
            return m.features(x[~np.isnan(x)])

        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index):
                x = np.array([weigh(t) for t in batch.column(index).to_pylist()]).reshape(-1, 4)
                p = 1 / (1 + np.exp(-np.clip(x @ m.curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(p)], names=[*keep, "score"])

    schema = docs.select(*keep).limit(0).selectExpr("*", "0D score").schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op9_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out("doc_id", 3, 1))
    found = score(docs.withColumn("held_out", held_out("doc_id", 3, 1)), train(docs, labels), keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
