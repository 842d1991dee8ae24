"""Quality classifier by co-training a text view and a page-metadata view."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import PARTIAL, dealt_anew, keep_rows, partial, small_batches, total, written

ROUNDS = 5
#: Pseudo-labels that a view hands over in a round: a share of the rows that are
#: still free, of each class, and how sure the view must be.
SHARE, SURE = 0.05, 0.95
L2 = 1e-3
#: Newton steps of a view's first fit, and of each later one, which starts from the last.
FIRST_STEPS, STEPS = 10, 3
SOURCE_BUCKETS, LANG_BUCKETS = 32, 16
#: Cells of a logit: thresholds and calibration are read off counts by cell.
CELLS, CALIBRATION_CELLS, FAR = 4096, 256, 30.0

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = b"0123456789"
_STOP = b".,;:'\"()-?"
_SIGN = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP)


def text_view(text: str | None) -> list[float]:
    """Content features that don't depend on a text's length."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), max(1, len(raw))
    count = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    if not n:
        return [0.0] * 11 + [1.0]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / n
    again = sum(map(eq, words, words[1:])) / n
    mean = sum(map(len, words)) / n
    once = len(counts) / n
    upper, sign = count(_UPPER), count(_SIGN)
    return [math.sqrt(upper), upper, math.sqrt(count(_DIGIT)), math.sqrt(count(_STOP)), math.sqrt(sign), sign, math.sqrt(again), top, math.sqrt(top), once, mean / 10, 0.0]


def page_view(lang: str | None, source: str | None, text: str | None) -> list[float]:
    """Metadata of a page: its size, its line structure, where it comes from and its language.

    The last two are buckets, which ``_dense`` spreads to columns. Nothing here
    says which characters or words a text has.
    """
    lines = (text or "").split("\n")
    sizes = list(map(len, lines))
    n, chars = len(lines), sum(sizes)
    filled = sum(not x.isspace() for x in filter(None, lines))
    bucket = lambda s, n: float(zlib.crc32((s or "").encode("utf-8", "surrogatepass")) % n)
    return [math.log1p(chars), math.log1p(n), math.log1p(chars / n), math.log1p(max(sizes)), 1 - filled / n, bucket(source, SOURCE_BUCKETS), bucket(lang, LANG_BUCKETS)]


def _dense(page: np.ndarray) -> np.ndarray:
    source, lang = (np.eye(n)[page[:, k].astype(int)] for k, n in ((-2, SOURCE_BUCKETS), (-1, LANG_BUCKETS)))
    return np.column_stack([page[:, :-2], source, lang])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -FAR, FAR)))


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def moved(self, gradient: np.ndarray, hessian: np.ndarray, n: float) -> Logistic:
        """After one Newton step from the sums over ``n`` rows' worth of weight, with a ridge."""
        ridge = np.full(len(self.weights), L2 * n)
        ridge[-1] = 1e-9
        step = np.linalg.solve(hessian + np.diag(ridge + 1e-9), gradient - ridge * self.weights)
        return Logistic(self.mean, self.scale, self.weights + np.clip(step, -5, 5))


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn logits, each ``n`` times, into calibrated ones, with Platt's smoothed targets."""
    pos, neg = n[y > 0.5].sum(), n[y <= 0.5].sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([z, np.ones(len(z))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(2) * 1e-6
        step = np.clip(np.linalg.solve(h, x.T @ (n * (t - p))), -1, 1)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _combine(logits: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Weights of both calibrated logits by logistic regression, held near one half each by a ridge."""
    prior = np.full(2, 0.5)
    w = prior.copy()
    z = np.clip(logits, -8, 8)
    for _ in range(50):
        p = _sigmoid(z @ w)
        h = (z * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.eye(2) * ridge * n.sum()
        step = np.clip(np.linalg.solve(h, z.T @ (n * (y - p)) - ridge * n.sum() * (w - prior)), -0.5, 0.5)
        w = np.maximum(w + step, 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@dataclass
class CoTrained:
    """Both views' classifiers, their calibration, and the pseudo-labels exchanged by round."""

    views: tuple[Logistic, Logistic]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    weights: tuple[float, float]
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the page view and both together."""
        a, b = (s * v.logit(x) + c for v, x, (s, c) in zip(self.views, (text, page), self.calibration, strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.weights[0] * a + self.weights[1] * b)


@dataclass
class Round:
    """Both views as they stood, and the logits from which each gave a row to the other: (good from, junk up to)."""

    views: tuple[Logistic, Logistic]
    limits: tuple[tuple[float, float], tuple[float, float]]


def _targets(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, rounds: list[Round]) -> tuple[list[np.ndarray], np.ndarray]:
    """What each view is fitted to (1, 0, or -1 for rows it isn't), and which rows are still free.

    A row's pseudo-labels follow from the rounds so far, so no state is kept
    between passes and a lost task is simply run again.
    """
    own = [np.where(fold, y, -1.0), np.where(fold, y, -1.0)]
    free = y < 0
    for r in rounds:
        taken = np.zeros(len(y), bool)
        for v in (0, 1):
            z = r.views[v].logit(x[v])
            for label, chosen in ((1.0, free & (z >= r.limits[v][0])), (0.0, free & (z <= r.limits[v][1]))):
                own[1 - v][chosen] = label
                taken |= chosen
        free &= ~taken
    return own, free


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Labels, training fold and both views of a batch of ``features``."""
    wide = lambda c: c.flatten().to_numpy().reshape(len(c), -1).astype(np.float64)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), (wide(batch.column(2)), _dense(wide(batch.column(3))))


def _sums(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of what ``add(out, y, fold, x)`` adds to a vector of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(out, *_read(batch))
        yield partial(out)

    held = total(rows.mapInArrow(run, PARTIAL))
    return np.zeros(size) if held is None else held


def _moments(rows: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Mean and scale of each view's features over all rows, and counts of labels by fold and class."""
    d = [len(text_view(None)), _dense(np.array([page_view(None, None, None)])).shape[1]]

    def add(out: np.ndarray, y: np.ndarray, fold: np.ndarray, x: tuple) -> None:
        for f in (0, 1):
            for c in (0, 1):
                out[2 * f + c] += ((fold == f) & (y == c)).sum()
        out[4] += len(y)
        at = 5
        for v in x:
            out[at : at + v.shape[1]] += v.sum(0)
            out[at + v.shape[1] : at + 2 * v.shape[1]] += (v * v).sum(0)
            at += 2 * v.shape[1]

    out = _sums(rows, 5 + 2 * sum(d), add)
    found, at, n = [], 5, max(1.0, out[4])
    for k in d:
        mean = out[at : at + k] / n
        spread = np.sqrt(np.maximum(out[at + k : at + 2 * k] / n - mean * mean, 0))
        found.append((mean, np.where(spread < 1e-6, 1.0, spread)))
        at += 2 * k
    return found, out[:4].reshape(2, 2)


def _step(rows: DataFrame, views: tuple[Logistic, Logistic], rounds: list[Round], counts: np.ndarray) -> tuple[Logistic, Logistic]:
    """Both views after one Newton step; ``counts`` has each view's rows by class, which weigh the same in all."""
    d = [len(v.weights) for v in views]
    each = [np.where(counts[v] > 0, 0.5 / np.maximum(counts[v], 1), 0.0) * counts[v].sum() for v in (0, 1)]

    def add(out: np.ndarray, y: np.ndarray, fold: np.ndarray, x: tuple) -> None:
        own, _ = _targets(x, y, fold, rounds)
        at = 0
        for v, (view, k) in enumerate(zip(views, d, strict=True)):
            fitted = own[v] >= 0
            z, t = view.design(x[v][fitted]), own[v][fitted]
            p, w = _sigmoid(z @ view.weights), each[v][t.astype(int)]
            out[at : at + k] += z.T @ (w * (t - p))
            out[at + k : at + k + k * k] += ((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z).ravel()
            at += k + k * k

    out = _sums(rows, sum(k + k * k for k in d), add)
    moved, at = [], 0
    for v, (view, k) in enumerate(zip(views, d, strict=True)):
        moved.append(view.moved(out[at : at + k], out[at + k : at + k + k * k].reshape(k, k), counts[v].sum()))
        at += k + k * k
    return tuple(moved)


def _cell(z: np.ndarray, cells: int) -> np.ndarray:
    """Cells are narrow near zero, where most of a calibration is decided."""
    return np.clip(np.floor((np.arcsinh(z) / math.asinh(FAR) + 1) / 2 * cells), 0, cells - 1).astype(np.int64)


def _edge(cell: np.ndarray | float, cells: int) -> np.ndarray | float:
    return np.sinh((np.asarray(cell) / cells * 2 - 1) * math.asinh(FAR))


def _exchange(rows: DataFrame, views: tuple[Logistic, Logistic], rounds: list[Round]) -> tuple[Round, np.ndarray]:
    """The limits by which both views give their surest free rows, and how many: by view, (junk, good)."""

    def add(out: np.ndarray, y: np.ndarray, fold: np.ndarray, x: tuple) -> None:
        _, free = _targets(x, y, fold, rounds)
        for v in (0, 1):
            out[v * CELLS : (v + 1) * CELLS] += np.bincount(_cell(views[v].logit(x[v][free]), CELLS), minlength=CELLS)

    found = _sums(rows, 2 * CELLS, add).reshape(2, CELLS)
    most = found[0].sum() * SHARE
    sure = math.log(SURE / (1 - SURE))
    first = int(_cell(np.array([sure]), CELLS)[0]) + 1
    limits, given = [], np.zeros((2, 2))
    for v in (0, 1):
        ends = []
        for c, counts in ((1, found[v][::-1]), (0, found[v])):
            # Whole cells from the surest on, until they hold the share.
            sums = np.cumsum(counts[: CELLS - first])
            k = min(int(np.searchsorted(sums, most)) + 1, len(sums)) if most else 0
            given[v, c] = sums[k - 1] if k else 0
            ends.append(k)
        # The outermost cells hold all that is farther out. Limits lie between cells.
        limits.append((float(_edge(CELLS - ends[0], CELLS)) if ends[0] else math.inf, float(np.nextafter(_edge(ends[1], CELLS), -math.inf)) if ends[1] else -math.inf))
    return Round(views, tuple(limits)), given


def _calibrated(rows: DataFrame, views: tuple[Logistic, Logistic]) -> tuple[tuple, tuple[float, float]]:
    """Calibration of both views and their weights, from counts by cell of the labelled rows not fitted on."""
    n = CALIBRATION_CELLS

    def add(out: np.ndarray, y: np.ndarray, fold: np.ndarray, x: tuple) -> None:
        held = ~fold & (y >= 0)
        a, b = (_cell(views[v].logit(x[v][held]), n) for v in (0, 1))
        out += np.bincount((y[held].astype(int) * n + a) * n + b, minlength=2 * n * n)

    found = _sums(rows, 2 * n * n, add).reshape(2, n, n)
    label, a, b = np.nonzero(found)
    y, often = label.astype(float), found[label, a, b]
    z = [_edge(k + 0.5, n) for k in (a, b)]
    calibration = tuple(_platt(z[v], y, often) for v in (0, 1))
    logits = np.column_stack([c[0] * z[v] + c[1] for v, c in enumerate(calibration)])
    return calibration, _combine(logits, y, often)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-trains on ``features`` with fold true, calibrates on the others; None without both classes in both.

    All rows take part: the labelled ones in every step, the others as soon as a
    view is sure of them. Tasks add up gradients, curvatures and counts; only
    such sums reach the driver.
    """
    scales, labelled = _moments(rows)
    if (labelled == 0).any():
        return None
    views = tuple(Logistic(m, s, np.zeros(len(m) + 1)) for m, s in scales)
    counts, done, exchanged = np.stack([labelled[1], labelled[1]]), [], []
    for _ in range(FIRST_STEPS):
        views = _step(rows, views, done, counts)
    for _ in range(rounds):
        now, given = _exchange(rows, views, done)
        exchanged.append(tuple(int(g) for g in given.sum(1)))
        if not given.any():
            break
        done.append(now)
        counts = counts + given[::-1]
        for _ in range(STEPS):
            views = _step(rows, views, done, counts)
    calibration, weights = _calibrated(rows, views)
    return CoTrained(views, calibration, weights, exchanged)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, sources, texts = (batch.column(i) for i in range(4))
        text, page = [], []
        for lang, source, t in zip(langs.to_pylist(), sources.to_pylist(), texts, strict=True):
            t = t.as_py()
            text.append(text_view(t))
            page.append(page_view(lang, source, t))
        yield pa.RecordBatch.from_arrays([ids, pa.array(text, pa.list_(pa.float32())), pa.array(page, pa.list_(pa.float32()))], ["doc_id", "text_view", "page_view"])


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, fold, text_view, page_view) of every row; y is -1 without a label, fold false for a fifth of all doc_ids.

    A doc_id whose labels contradict each other has none.
    """
    small_batches(docs.sparkSession)
    known = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    marked = labels.where(known).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    marked = dealt_anew(marked.select("id", F.col("a").cast("double").alias("y")), "y", "id")
    rows = _inputs(docs).mapInArrow(_features, "doc_id long, text_view array<float>, page_view array<float>")
    # Rows without a doc_id are dealt out by their features and match nothing.
    rows = rows.withColumn("near", F.when(F.col("doc_id").isNull(), F.hash("text_view")).otherwise(0))
    rows = rows.join(marked, (F.col("doc_id") == F.col("id")) & (F.col("near") == 0), "left")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(True))
    return rows.select(F.coalesce("y", F.lit(-1.0)).alias("y"), fold.alias("fold"), "text_view", "page_view")


def _inputs(docs: DataFrame) -> DataFrame:
    column = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    return docs.select(F.col("doc_id").cast("long"), column("lang"), column("source"), column("text"))


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Fits on all labelled and all other rows of ``docs``; see ``fit`` and ``features``.

    Null texts, languages and sources count as empty; rows that repeat count
    each; a null doc_id has no label. None where nothing can be learnt.
    """
    return fit(written(features(docs, labels)))


def _scored(model: CoTrained | None, langs: list, sources: list, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None or not texts:
        return (np.full(len(texts), 0.5),) * 3
    page = np.array([page_view(*x) for x in zip(langs, sources, texts, strict=True)], np.float32)
    return model.scores(np.array([text_view(t) for t in texts], np.float32).astype(np.float64), _dense(page.astype(np.float64)))


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """doc_id, text_score, page_score, score and predicted (1 from a score of one half) of every row.

    Null texts, languages and sources count as empty; a missing lang or source
    column as null. Repeated rows are scored each; null doc_ids stay null; other
    columns, labels among them, are never inputs. Without a model (no labels of
    both classes) all scores are one half. No rows in, none out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = _scored(model, *(batch.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array((c >= 0.5).astype(np.int32))], ["doc_id", "text_score", "page_score", "score", "predicted"])

    return _inputs(docs).mapInArrow(run, "doc_id long, text_score double, page_score double, score double, predicted int")


def keep_good(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with a score from ``threshold``."""

    def keep(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> np.ndarray:
        lists = ([None if x is None else str(x) for x in a.to_pylist()] for a in (langs, sources, texts))
        return _scored(model, *lists)[2] >= threshold

    return keep_rows(docs, ["lang", "source", "text"], keep)
