"""Toxicity: noisy-channel restoration of disguised words, then a classifier over them."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import small_batches, written

#: Labelled rows that are fitted on at most, in the order of a hash of doc_id.
MAX_LABELLED = 20_000
#: Toxic texts that must hold a character sequence for it to become evidence.
MIN_TEXTS = 5
GRAMS, BEGINNINGS = (4, 5, 6), (7, 8, 9)
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 500_000

# What each sign can stand for in disguised writing.
LEET = {
    "4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h",
    "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z",
}

#: Log-probabilities of the channel: a sign for a letter, a sign thrown in, a
#: letter held down, a blank within a word; and of a sign that is meant.
SUBSTITUTED, INSERTED, HELD, SPACED, KEPT = math.log(0.5), math.log(0.001), math.log(0.1), math.log(0.4), -10.0
#: Tokens of up to this many letters may be parts of a word; mean log-probability of
#: a letter, and of its first letter or its end, below which one hardly is a word.
PART_LETTERS, UNLIKELY, BROKEN = 4, -2.6, -5.5

# Symbols of the language model: 0 is any gap, 1 to 26 the letters, 27 any other letter.
_SYMBOLS = 28
_ALL = 32**3


def _symbol_table() -> np.ndarray:
    import unicodedata

    table = np.zeros(0x250, np.uint16)
    for cp in range(0x250):
        c = chr(cp)
        if c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """The text's symbols: letters without accents, everything between words as gaps."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(cps, 0x24F)]
    out[cps > 0x24F] = 27
    return out


def symbol(c: str) -> int:
    return int(_TABLE[ord(c)]) if ord(c) < 0x250 else 27


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts; at most 32**3 numbers reach the driver."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALL, np.int64)
        for batch in batches:
            for t in batch.column(0):
                s = symbols(f" {t.as_py() or ''} ").astype(np.int64)
                total += np.bincount((s[:-2] << 10) | (s[1:-1] << 5) | s[2:], minlength=_ALL)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_ALL, np.int64)
    counts[rows.gram.to_numpy()] = rows.n.to_numpy()
    return counts


class CharModel:
    """Trigram language model of characters, interpolated with bigrams and a floor."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(32, 32, 32)[:_SYMBOLS, :_SYMBOLS, :_SYMBOLS].astype(float)
        two = three.sum(0)
        p2 = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * _SYMBOLS)
        n = three.sum(2, keepdims=True)
        self.logp = np.log((three + 20 * p2[None]) / (n + 20)).tolist()
        self.options: dict[tuple[str, int], list] = {}

    def whole(self, word: str) -> bool:
        """Whether the word is likely as it stands: on the mean, where it begins and where it ends."""
        x = y = 0
        steps = []
        for c in word:
            z = symbol(c)
            steps.append(self.logp[x][y][z] if z else KEPT)
            x, y = y, z
        steps.append(self.logp[x][y][0])
        return sum(steps) >= UNLIKELY * len(steps) and min(steps[0], steps[-1]) >= BROKEN

    def decode(self, token: str) -> str:
        """The most likely intended words behind ``token``, by Viterbi over its lattice.

        ``token`` is one token, or several with single blanks between them. A sign
        may stand for a letter, be thrown in, or be meant; three or more equal
        letters may be one or two; a blank may be a gap or be dropped. The path's
        last two symbols are its state; paths are read off back-pointers.
        """
        runs: list[tuple[str, int]] = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        logp = self.logp
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for c, n in runs:
            after: dict[tuple[int, int], float] = {}
            step: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            options = self.options.get((c, n)) or self._resolved(c, n)
            for state, score in best.items():
                for added, cost, seen in options:
                    (x, y), s = state, score + cost
                    for z, spoken in seen:
                        if spoken:
                            s += logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y]:
                        after[x, y], step[x, y] = s, (state, added)
            best = after
            steps.append(step)
        state = max(best, key=lambda x: best[x] + logp[x[0]][x[1]][0])
        parts = []
        for step in reversed(steps):
            state, added = step[state]
            parts.append(added)
        return "".join(reversed(parts))

    def _resolved(self, c: str, n: int) -> list[tuple[str, float, list[tuple[int, bool]]]]:
        """``_options`` with the symbols of each, and whether the model scores them; signs that are meant cost KEPT."""
        found = []
        for added, cost in self._options(c, n):
            seen = [(symbol(d), symbol(d) > 0 or d == " ") for d in added]
            found.append((added, cost + KEPT * sum(not spoken for _, spoken in seen), seen))
        if n < 9:
            self.options[c, n] = found
        return found

    @staticmethod
    def _options(c: str, n: int) -> list[tuple[str, float]]:
        """What ``n`` times the character may have been meant for, and at which cost."""
        if c == " ":
            return [(" ", 0.0), ("", SPACED)]
        if c in LEET:
            return [(x * k, SUBSTITUTED * n + (0 if k == n else HELD)) for x in LEET[c] for k in {1, min(n, 2)}] + [("", INSERTED * n), (c * n, 0.0)]
        if not c.isalnum():
            return [("", INSERTED / 2), (c * n, 0.0)]
        return [(c, HELD), (c * 2, HELD), (c * n, 0.0)] if n > 2 else [(c * n, 0.0)]


_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|([@$])\1{2,}$")
_SIGNS = re.compile(r"[0-9@$!|+(#]")
_HELD = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"[^\W_][._*~-]+[^\W_]")


def readings(token: str, model: CharModel) -> tuple[str, ...]:
    """What one lower-case token may be: without the punctuation around it, and decoded where it may be disguised."""
    core = token if token.isalpha() else _EDGE.sub("", token)
    found = [core] if core else []
    for t in (core, token) if core != token and _SIGNS.search(token) else (core,):
        if _HELD.search(t) if t.isalpha() else _SIGNS.search(t) or _HELD.search(t) or _INNER.search(t):
            found += [w for w in model.decode(t).split() if w not in found]
    return tuple(found)


def restore_word(token: str, model: CharModel) -> str:
    """One lower-case token without what disguises it: its last reading of what lies between its punctuation."""
    core = _EDGE.sub("", token)
    return model.decode(core) if _SIGNS.search(core) or _HELD.search(core) or _INNER.search(core) else core


def part_class(token: str, model: CharModel) -> int:
    """2 for a token that is likely but a part of a word, 1 for one that may be, 0 for others."""
    core = token if token.isalpha() else _EDGE.sub("", token)
    if not core or len(core) > PART_LETTERS:
        return 0
    return 1 if model.whole(core) else 2


def spaced_runs(classes: np.ndarray) -> list[tuple[int, int]]:
    """The runs of tokens that one lattice restores: likely parts of words, with what may be one beside them."""
    likely = classes == 2
    near = likely.copy()
    near[1:] |= likely[:-1]
    near[:-1] |= likely[1:]
    near &= classes > 0
    bounds = np.flatnonzero(np.diff(near, prepend=False, append=False))
    return [(a, b) for a, b in bounds.reshape(-1, 2).tolist() if b - a > 1]


def restore(text: str | None, model: CharModel) -> str:
    """The whole text restored: lower case, words at single blanks, spaced-out words joined."""
    tokens = (text or "").lower().split()
    out, at = [], 0
    classes = np.array([part_class(t, model) for t in tokens], np.int64)
    for a, b in [*spaced_runs(classes), (len(tokens), len(tokens))]:
        out += [restore_word(t, model) for t in tokens[at:a]]
        out += model.decode(" ".join(_EDGE.sub("", t) for t in tokens[a:b])).split()
        at = b
    return " ".join(w for w in out if w)


def grams(word: str) -> set[str]:
    """A word's evidence: itself between bounds, its character sequences, and its longer beginnings."""
    w = f"^{word}$"
    return {w} | {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} | {w[:n] for n in BEGINNINGS if n < len(w)}


class Reader(dict):
    """What ``value`` makes of the readings of each raw token, remembered.

    A token's entry is the place of its value in ``values``, four times over, and
    its ``part_class``.
    """

    def __init__(self, model: CharModel, value, values, limit: int = CACHE_WORDS):
        super().__init__()
        self.model, self.value, self.values, self.limit = model, value, values, limit
        self.runs: dict[str, object] = {}

    def __missing__(self, token: str) -> int:
        self[token] = found = 4 * len(self.values) + part_class(token, self.model)
        self.values.append(self.value(readings(token, self.model)))
        return found

    def read(self, text: str | None) -> tuple[np.ndarray, list]:
        """The places of the values of all tokens of a text, and the values of its spaced-out words."""
        # Between texts only, so that a text's places stay good.
        if len(self) >= self.limit:
            self.clear()
            del self.values[:]
        tokens = (text or "").lower().split()
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        spaced = []
        for a, b in spaced_runs(codes & 3):
            run = " ".join(_EDGE.sub("", t) for t in tokens[a:b])
            if run not in self.runs:
                if len(self.runs) >= self.limit // 8:
                    self.runs.clear()
                self.runs[run] = self.value(tuple(self.model.decode(run).split()))
            spaced.append(self.runs[run])
        return codes >> 2, spaced


class Evidence(Reader):
    """Of each token the largest weight of any of its sequences."""

    def __init__(self, model: CharModel, weights: dict[str, float]):
        # All sequences of a word that are evidence, in one pass over it.
        found = ahocorasick.Automaton()
        for g, w in weights.items():
            found.add_word(g, w)
        found.make_automaton()
        super().__init__(model, lambda words: max((w for x in words for _, w in found.iter(f"^{x}$")), default=0.0) if weights else 0.0, array("d"))

    def features(self, text: str | None) -> list[float]:
        """Of a text: its largest evidence, the log of all of it, and that for its length."""
        places, spaced = self.read(text)
        own = np.frombuffer(self.values, np.float64).take(places) if len(places) else np.zeros(0)
        total = float(own.sum()) + sum(spaced)
        return [max(float(own.max()) if len(own) else 0.0, max(spaced, default=0.0)), math.log1p(total), total / (1 + len(own)) ** 0.5]


@dataclass
class Model:
    counts: np.ndarray
    weights: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    logistic: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.array([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Language model of all texts; evidence and classifier of at most ``max_labelled`` labelled rows.

    Rows whose crc32(doc_id) mod 5 is 0 are never learned from. The others form
    four folds; the classifier sees each text's evidence as the other three folds
    give it, as it will see unseen texts, and scoring takes the evidence of all
    four. A doc_id counts once, by the text of the smallest hash, and equal texts
    count once. Without labels of both classes no word is evidence and all scores
    are those of a clean text. A doc_id, or text, that is labelled both ways
    counts as toxic.
    """
    counts = trigram_counts(docs)
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where(bucket != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    # Bounded by the limit.
    some = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(some, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t")).select("y", "t.k", "t.text", bucket.cast("int").alias("fold"))
    texts = written(rows.groupBy("k").agg(F.first("text").alias("text"), F.max("y").alias("y"), F.min("fold").alias("fold")))
    lm = CharModel(counts)
    n, w = texts.select("text", "y", "fold").mapInArrow(_counted(lm), "gram string, c int, n long").groupBy("gram").pivot("c", list(range(2, 10))).agg(F.sum("n")).na.fill(0), []
    totals = {2 * r.fold + r.y: r["count"] for r in texts.groupBy("fold", "y").count().collect()}
    for left_out in range(5):
        toxic, clean = ([str(2 * f + y) for f in range(1, 5) if f != left_out] for y in (1, 0))
        t, c = (sum((F.col(k) for k in some), F.lit(0)) for some in (toxic, clean))
        all_t, all_c = (sum(totals.get(int(k), 0) for k in some) for some in (toxic, clean))
        sure = F.log((t + 0.5) / (all_t + 1.0)) - F.log((c + 0.5) / (all_c + 1.0)) - 1.64 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        w.append(F.when((t >= MIN_TEXTS) & (sure > 0.5), sure).alias(f"w{left_out}"))
    # Sequences of the labelled rows, which are bounded.
    kept = n.select("gram", *w).where(F.coalesce(*[f"w{k}" for k in range(5)]).isNotNull()).collect()
    weights = [{r.gram: r[f"w{k}"] for r in kept if r[f"w{k}"] is not None} for k in range(5)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(lm, w) for w in weights]
        for batch in batches:
            x = [evidence[f].features(t.as_py()) for f, t in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["k", "y", "x"])

    held = texts.select("k", "y", "fold", "text").mapInArrow(measure, "k long, y int, x array<double>").toPandas().sort_values("k", kind="stable")
    if len(set(held.y)) < 2:
        return Model(counts, weights[0], np.zeros(3), np.ones(3), np.array([0.0, 0.0, 0.0, -3.0]))
    return Model(counts, weights[0], *_fit(np.stack(held.x.to_list()), held.y.to_numpy().astype(float)))


def _counted(lm: CharModel):
    """(gram, c, n): in how many texts of each fold and class (c is twice the fold and the class) a sequence occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        reader = Reader(lm, lambda words: frozenset(g for w in words for g in grams(w)), [], CACHE_WORDS // 25)
        for batch in batches:
            for t, y, fold in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                places, spaced = reader.read(t.as_py())
                seen.setdefault(2 * fold + y, Counter()).update(set().union(*(reader.values[k] for k in np.unique(places)), *spaced))
        for c, own in seen.items():
            keys = list(own)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([c] * len(some), pa.int32()), pa.array([own[k] for k in some], pa.int64())], ["gram", "c", "n"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and blank texts have no evidence and score as a clean text. Repeated
    rows are scored each; a null doc_id stays null and isn't held out. Only the
    text is an input. No rows in, none out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(CharModel(model.counts), model.weights)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            p = model.score(np.array([evidence.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i is not None and fold(i) == 0 for i in ids]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
