"""Document scores by masked pseudo-likelihood of a bidirectional window network."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import PARTIAL, cut_lineage, dealt_anew, partial, small_batches, total, written

#: Classes and words of a class; the last class holds buckets of rarer words.
CLASSES, MEMBERS = 64, 64
#: Width of the network, and tokens that it sees on either side.
WIDTH, SIDE = 16, 2
#: Passes over the corpus, in each of which every token of every document is a
#: target once, and the parts of a pass after which the tasks' networks are averaged.
ROUNDS, PHASES = 1, 4
BATCH, RATE = 16384, 0.1
#: Batches that are dealt out of one buffer of texts.
MIXED = 8
#: Tokens scored at once, and words a worker counts or remembers at once.
SCORED, CACHE_WORDS = 8192, 400_000

KNOWN = CLASSES * MEMBERS - MEMBERS
PAD = CLASSES * MEMBERS
#: Where a token's context lies from it.
AROUND = [i for i in range(-SIDE, SIDE + 1) if i]
#: Logarithms of counts are summed as integers, so that no order shows.
LOG_UNIT = 1e9


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def hash_of(word: str) -> int:
    """63 bits by which rarer words are known, as ``_hash`` has them; their lowest bits are the bucket."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) >> 1


def _hash(word: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 1)


def bucket_of(word: str) -> int:
    return hash_of(word) % MEMBERS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each token occurs in all texts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for t in batch.column(0):
                held.update(tokens_of(t.as_py()))
            if len(held) > CACHE_WORDS:
                yield from flush()
        yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words by rank, for the rest their counts by hash bucket, and each one's in a table."""

    words: list[str]
    counts: np.ndarray
    #: (h, n) of the rarer words that occur twice or more; stays with the driver.
    table: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def ids(self) -> _Ids:
        """The words' codes; a worker keeps what it has looked up for its next tasks."""
        key = hash(tuple(self.words))
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = _Ids({w: i for i, w in enumerate(self.words)})
        return _LAST[key]


#: The last vocabulary's codes in this worker.
_LAST: dict[int, _Ids] = {}


class _Ids(dict):
    """A frequent word's rank, or -1 less a rarer one's hash."""

    def __init__(self, words: dict[str, int]):
        super().__init__(words)
        self.known, self.limit = words, len(words) + CACHE_WORDS

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.known)
            if word in self.known:
                return self.known[word]
        self[word] = code = -1 - hash_of(word)
        return code

    def encoded(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text's tokens, and the hashes of the rarer ones."""
        words = tokens_of(text)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        late = codes < 0
        hashes = -1 - codes[late]
        codes[late] = KNOWN + hashes % MEMBERS
        return codes.astype(np.uint16), hashes


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts over all documents; the driver gets the top words and one row a bucket."""
    counts = cut_lineage(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    some = docs.sparkSession.createDataFrame([(r.word,) for r in top] or [("",)], "word string")
    # At most KNOWN rows.
    others = counts.join(F.broadcast(some), "word", "left_anti").select(_hash("word").alias("h"), "n")
    rest = others.groupBy((F.col("h") % MEMBERS).alias("b")).agg(F.sum("n").alias("n")).collect()
    found = np.zeros(CLASSES * MEMBERS)
    found[: len(top)] = [r.n for r in top]
    for r in rest:
        found[KNOWN + r.b] = r.n
    return Vocabulary([r.word for r in top], found, others.where("n > 1"))


class Network:
    """Class-factored softmax over a tanh layer on the weighted embeddings of both sides.

    P(word | sides) = P(class | sides) P(word | class, sides); a rare word has the
    share of its bucket that its count is of the bucket's. At the start the output is the
    corpus's unigram distribution.
    """

    SHAPES = {
        "embed": (CLASSES * MEMBERS + 1, WIDTH), "side": (2 * SIDE, WIDTH), "dense": (WIDTH, WIDTH), "shift": (WIDTH,),
        "to_class": (CLASSES, WIDTH), "class_bias": (CLASSES,), "to_word": (CLASSES, MEMBERS, WIDTH), "word_bias": (CLASSES, MEMBERS),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.flat = flat

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Network:
        net = cls(np.zeros(cls.SIZE, np.float32))
        rng = np.random.default_rng(7)
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.side[:] = 1.0
        net.dense[:] = np.eye(WIDTH) * 0.5 + rng.normal(0, 0.05, net.dense.shape)
        p = (vocabulary.counts + 0.5).reshape(CLASSES, MEMBERS)
        net.word_bias[:] = np.log(p / p.sum(1, keepdims=True))
        net.class_bias[:] = np.log(p.sum(1) / p.sum())
        return net

    def _bounded(self) -> bool:
        """Whether no output can overflow an exponential: the layer is below one, so weights and biases bound it."""
        return max(float((np.abs(w).sum(-1) + np.abs(b)).max()) for w, b in ((self.to_class, self.class_bias), (self.to_word, self.word_bias))) < 60

    @staticmethod
    def _exp(z: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """``z`` turned to exponentials in place, and the sum of each row."""
        if not bounded:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], z.dtype)

    def tables(self) -> list[np.ndarray]:
        """For each place beside the target what every token adds to the layer's input."""
        return [(self.embed * w) @ self.dense for w in self.side]

    def log_probability(self, context: np.ndarray, target: np.ndarray, tables: list[np.ndarray] | None = None, bounded: bool | None = None) -> np.ndarray:
        """Log-probability of each target id between its context ids, a column for each place."""
        order, cuts, target = self._by_class(target)
        h = None
        for t, column in zip(tables or self.tables(), context.T, strict=True):
            x = t.take(column[order], 0)
            h = x if h is None else np.add(h, x, out=h)
        h += self.shift
        np.tanh(h, out=h)
        bounded = self._bounded() if bounded is None else bounded
        rows, group, member = np.arange(len(target)), target // MEMBERS, target % MEMBERS
        z = h @ self.to_class.T
        z += self.class_bias
        found = np.zeros(len(target), z.dtype)
        for picked in (group, member):
            if not bounded:
                z -= z.max(1, keepdims=True)
            found += z[rows, picked]
            z, sums = self._exp(z, True)
            found -= np.log(sums)
            if picked is group:
                self._to_words(h, cuts, z)
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
        """An order by class, where each class begins in it, and the targets so ordered."""
        group = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist(), target[order]

    def _to_words(self, h: np.ndarray, cuts: list[int], out: np.ndarray) -> None:
        """Outputs of the words of each row's class."""
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                np.matmul(h[a:b], self.to_word[c].T, out=out[a:b])
                out[a:b] += self.word_bias[c]

    def gradient(self, context: np.ndarray, target: np.ndarray, out: Network | None = None) -> Network:
        """Gradient of the mean negative log-likelihood, written over ``out``, which keeps its working arrays."""
        g = out or Network(np.zeros_like(self.flat))
        n, kind = len(target), self.flat.dtype.type
        work: dict[str, np.ndarray] = g.__dict__.setdefault("work", {})

        def room(name: str, width: int) -> np.ndarray:
            if name not in work or len(work[name]) < n:
                work[name] = np.empty((n, width), kind)
            return work[name][:n]

        order, cuts, target = self._by_class(target)
        columns = [c[order].astype(np.int64) for c in context.T]
        pooled, h, back, x, d = (room(*r) for r in (("pooled", WIDTH), ("h", WIDTH), ("back", WIDTH), ("x", WIDTH), ("d", MEMBERS)))
        for k, (w, c) in enumerate(zip(self.side, columns, strict=True)):
            self.embed.take(c, 0, out=x, mode="clip")
            x *= w
            np.add(pooled, x, out=pooled) if k else np.copyto(pooled, x)
        np.matmul(pooled, self.dense, out=h)
        h += self.shift
        np.tanh(h, out=h)
        bounded, rows = self._bounded(), np.arange(n)

        def to_error(at: np.ndarray) -> None:
            """Turns outputs into what the loss changes by with each."""
            _, sums = self._exp(d, bounded)
            np.multiply(d, (kind(1 / n) / sums)[:, None], out=d)
            d[rows, at] -= kind(1 / n)

        np.matmul(h, self.to_class.T, out=d)
        np.add(d, self.class_bias, out=d)
        to_error(target // MEMBERS)
        np.matmul(d.T, h, out=g.to_class)
        np.matmul(np.ones(n, kind), d, out=g.class_bias)
        np.matmul(d, self.to_class, out=back)
        self._to_words(h, cuts, d)
        to_error(target % MEMBERS)
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            np.matmul(d[a:b].T, h[a:b], out=g.to_word[c])
            d[a:b].sum(0, out=g.word_bias[c])
            if b > a:
                np.matmul(d[a:b], self.to_word[c], out=x[a:b])
        back += x
        h *= h
        back *= np.subtract(1, h, out=h)
        np.matmul(pooled.T, back, out=g.dense)
        np.matmul(np.ones(n, kind), back, out=g.shift)
        arriving = self.dense @ back.T
        g.embed[:] = 0
        seen = work.setdefault("seen", np.empty(self.embed.shape, kind))
        for k, c in enumerate(columns):
            # By width: what arrives at each token from this place.
            for j in range(WIDTH):
                seen[:, j] = np.bincount(c, arriving[j], len(seen))
            np.einsum("ij,ij->j", self.embed, seen, out=g.side[k])
            seen *= self.side[k]
            g.embed += seen
        return g


class Adagrad:
    def __init__(self, flat: np.ndarray):
        self.net, self.squares = Network(flat), np.full_like(flat, 1e-3)
        self.gradient, self.held = Network(np.zeros_like(flat)), np.empty_like(flat)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        g, x = self.net.gradient(context, target, self.gradient).flat, self.held
        np.multiply(g, g, out=x)
        self.squares += x
        np.sqrt(self.squares, out=x)
        np.divide(g, x, out=x)
        x *= x.dtype.type(RATE)
        self.net.flat -= x


def in_line(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts in one array, padded before, between and after them, and where the tokens lie."""
    pad = np.full(SIDE, PAD, np.uint16)
    line = np.concatenate([x for t in texts for x in (pad, t)] + [pad])
    return line, np.flatnonzero(line != PAD)


def windows(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in a line the ids of SIDE tokens before and after it."""
    return np.stack([line[at + k] for k in AROUND]).T


#: Rows of ``encode`` as tasks make them.
CODED = "doc_id long, n_tokens long, ids binary, late array<long>"


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, phase, doc_id, n_tokens, ids, late) of every row, written: token ids as little-endian uint16, hashes of rarer words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocab.ids()
        for batch in batches:
            found = [ids.encoded(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *(len(h) for _, h in found)])
            late = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([h for _, h in found]) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i, _ in found], pa.int64()), pa.array([i.astype("<u2").tobytes() for i, _ in found], pa.binary()), late], ["doc_id", "n_tokens", "ids", "late"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CODED)
    phase = F.pmod(F.xxhash64("ids"), F.lit(PHASES)).cast("int")
    return written(rows.withColumns({"row": F.monotonically_increasing_id(), "phase": phase}))


def _ids_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def _train(flat: np.ndarray):
    """Adagrad over a task's own documents, from the common parameters; their sum weighted by targets, and the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trained = Adagrad(flat.copy()), 0
        held: list[np.ndarray] = []
        size = 0

        def step() -> None:
            nonlocal held, size, trained
            line, at = in_line(held)
            # Batches take turns over the line, so that each mixes many texts.
            turns = max(1, -(-len(at) // BATCH))
            for k in range(turns):
                own = at[k::turns]
                model.step(windows(line, own), line[own])
            trained += len(at)
            held, size = [], 0

        for batch in batches:
            for ids in _ids_of(batch.column(0)):
                for k in range(0, len(ids), MIXED * BATCH):
                    some = ids[k : k + MIXED * BATCH]
                    held.append(some)
                    size += len(some)
                    if size >= MIXED * BATCH:
                        step()
        if size:
            step()
        yield partial(np.append(model.net.flat.astype(np.float64) * trained, trained))

    return run


def train_on(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network of all rows of ``encode``.

    In every phase each task goes over its own documents of that phase, from the
    common parameters; the results are averaged by their targets over a tree of
    tasks, so that neither a task nor the driver holds more than a few of them.
    """
    net = Network.start(vocab)
    for k in range(rounds * PHASES):
        sums = total(coded.where(F.col("phase") == k % PHASES).select("ids").mapInArrow(_train(net.flat), PARTIAL))
        if sums is not None and sums[-1]:
            net = Network((sums[:-1] / sums[-1]).astype(np.float32))
    return net


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all documents."""
    vocab = vocabulary(docs)
    return vocab, train_on(encode(docs, vocab), vocab, rounds)


def score_ids(texts: list[np.ndarray], vocab: Vocabulary, net: Network) -> list[float]:
    """Summed log-probability of each text's ids; each rarer word as one occurrence of all in its bucket and one more."""
    rare, tables, bounded = np.log(vocab.counts[KNOWN:] + 1), net.tables(), net._bounded()
    out: list[float] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        line, at = in_line(held)
        logp = np.zeros(len(at))
        for k in range(0, len(at), SCORED):
            own = at[k : k + SCORED]
            logp[k : k + SCORED] = net.log_probability(windows(line, own), line[own], tables, bounded)
        target = line[at].astype(np.int64)
        late = target >= KNOWN
        logp[late] -= rare[target[late] - KNOWN]
        sums = np.concatenate([[0.0], np.cumsum(logp)])
        ends = np.cumsum([len(x) for x in held])
        out.extend((sums[ends] - sums[ends - [len(x) for x in held]]).tolist())
        held.clear()

    size = 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= 8 * SCORED:
            flush()
            size = 0
    if held:
        flush()
    return out


def score_on(coded: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """``score`` of the rows of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_ids(_ids_of(batch.column(3)), vocab, net)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["row", "doc_id", "n_tokens", "sum"])

    rows = coded.select("row", "doc_id", "n_tokens", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, sum double")
    late = coded.select("row", F.explode("late").alias("h"))
    log = vocab.table.select("h", F.round(F.log("n") * LOG_UNIT).cast("long").alias("log"))
    # The counts' partitions are far smaller than the tokens', which needn't be sorted.
    more = late.join(dealt_anew(log, "log", "h").hint("shuffle_hash"), "h").groupBy("row").agg((F.sum("log") / LOG_UNIT).alias("more"))
    found = rows.join(more, "row", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    per = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return found.select("doc_id", "n_tokens", "log_likelihood", per.alias("per_token"))


def score(docs: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of every row.

    log_likelihood sums the log-probability of each token given SIDE tokens on
    both sides. A rarer word's is its bucket's, times its count in the corpus over
    the bucket's count and one; a word never seen counts as one. Null and blank
    texts have no tokens, log_likelihood 0 and a null per_token. Repeated rows are
    scored each; null doc_ids stay null; other columns are ignored. No rows in,
    none out.
    """
    return score_on(encode(docs, vocab), vocab, net)


def model_and_score(docs: DataFrame) -> DataFrame:
    """``score`` of ``docs`` by the network of the same documents, whose texts are read twice only: to count and to encode."""
    vocab = vocabulary(docs)
    coded = encode(docs, vocab)
    return score_on(coded, vocab, train_on(coded, vocab))
