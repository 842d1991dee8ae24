"""Benchmark decontamination: a BM25 index of test items searched by block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import keep_rows, small_batches

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.7
#: Word shingles and the share of them that must be in the passage.
SHINGLE, OVERLAP = 5, 0.8
#: Words of a passage at least; passages overlap by half.
PASSAGE = 128
#: Items of one block of the index.
BLOCK = 4
#: Postings held by a task at once; more items are searched shard by shard.
SHARD_POSTINGS = 2_000_000

HIT_SCHEMA = "doc_id long, item_id long, score double, start long, end long, question_overlap double, answer_overlap double"
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.?!\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and those of it; all words twice if it has one."""
    parts = [w for w in map(words_of, _END.split(text)) if w]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Inverted index of items; the impact of a term is its share of the item's own score.

    Items stand in order of their length, so that a block holds items whose
    impacts are alike and its maxima are close.
    """

    def __init__(self, items: list[tuple[int, str, dict[str, float]]]):
        items = sorted(items, key=lambda x: (len(x[2]), x[0], x[1]))
        self.ids = [i for i, _, _ in items]
        self.parts = [question_and_answer(t) for _, t, _ in items]
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for n, (_, _, impacts) in enumerate(items):
            for term, w in impacts.items():
                at, ws = lists.setdefault(term, ([], []))
                at.append(n)
                ws.append(w)
        self.terms = {t: k for k, t in enumerate(lists)}
        self.postings = list(lists.values())
        self.top = [max(ws) for _, ws in self.postings]
        self.blocks: list[tuple[list[int], list[float]]] = []
        for at, ws in self.postings:
            most: dict[int, float] = {}
            for n, w in zip(at, ws, strict=True):
                most[n // BLOCK] = max(most.get(n // BLOCK, 0.0), w)
            self.blocks.append((list(most), list(most.values())))
        self.bounds = np.array([*self.top, 0.0])
        self.block_at = np.cumsum([0, *(len(b) for b, _ in self.blocks)])
        self.block_ids = np.array([b for bs, _ in self.blocks for b in bs], np.int64)
        self.block_max = np.array([w for _, ws in self.blocks for w in ws])

    def _spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all blocks of these terms: the place of the term, and the place of the block's entry."""
        lo, n = self.block_at[terms], self.block_at[terms + 1] - self.block_at[terms]
        return np.repeat(np.arange(len(terms)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)

    def may_match(self, terms: np.ndarray, threshold: float) -> bool:
        """Whether any block's maxima over these distinct terms reach the threshold."""
        _, at = self._spread(terms)
        return bool((np.bincount(self.block_ids[at], self.block_max[at]) >= threshold - 1e-9).any())

    def live_passages(self, ids: np.ndarray, half: int, count: int, threshold: float) -> np.ndarray:
        """The passages of a text for which ``may_match`` holds, all tested together.

        Passage k is the words from ``k * half`` on, twice ``half`` of them; a word
        counts where it is the first of its kind in the passage.
        """
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        before = np.full(n, -1)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        at = np.flatnonzero(ids < len(self.terms))
        own = at // half
        place = np.concatenate([at, at])
        passage = np.concatenate([own, own - 1])
        keep = (passage >= 0) & (passage < count) & (before[place] < passage * half)
        place, passage = place[keep], passage[keep]
        blocks = -(-len(self.ids) // BLOCK)
        live = []
        step = max(1, 2_000_000 // max(1, blocks))
        for k in range(0, count, step):
            mine = (passage >= k) & (passage < k + step) if count > step else slice(None)
            which, entry = self._spread(ids[place[mine]])
            key = (passage[mine][which] - k) * blocks + self.block_ids[entry]
            live.append((np.bincount(key, self.block_max[entry], min(step, count - k) * blocks).reshape(-1, blocks) >= threshold - 1e-9).any(1))
        return np.flatnonzero(np.concatenate(live))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND (Ding and Suel, 2011)."""
        threshold -= 1e-9
        end = len(self.ids)
        # A cursor: current item, place, items, weights, bound, blocks, their maxima.
        cursors = [[self.postings[t][0][0], 0, *self.postings[t], self.top[t], *self.blocks[t]] for t in terms]
        found = []

        def seek(c: list, item: int) -> None:
            c[1] = bisect_left(c[2], item, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else end

        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, reach = item // BLOCK, 0.0
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[5], block)
                if k < len(c[5]) and c[5][k] == block:
                    reach += c[6][k]
            if reach >= threshold:
                if cursors[0][0] == item:
                    score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    for c in cursors[: pivot + 1]:
                        seek(c, item + 1)
                else:
                    for c in cursors[: pivot + 1]:
                        if c[0] < item:
                            seek(c, item)
            else:
                # No item of this block can do; nor one before the next cursor.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    if c[0] < to:
                        seek(c, max(to, item + 1) if to <= item else to)


def impacts(items: DataFrame) -> DataFrame:
    """(item_id, text, term, impact): BM25 weights as shares of each item's sum."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, w, n) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, n in Counter(words_of(t)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["item_id", "text", "term", "tf"])

    tf = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().mapInArrow(tokens, "item_id long, text string, term string, tf long")
    sizes = tf.groupBy("item_id", "text").agg(F.sum("tf").alias("dl"))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    same = (F.col("a.item_id").eqNullSafe(F.col("b.item_id"))) & (F.col("a.text") == F.col("b.text"))
    w = tf.alias("a").join(sizes.alias("b"), same).select("a.*", "b.dl").join(df, "term").join(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    own = w.groupBy("item_id", "text").agg(F.sum("w").alias("own"))
    return w.alias("a").join(own.alias("b"), same).select("a.item_id", "a.text", "a.term", (F.col("a.w") / F.col("b.own")).alias("impact"))


def search_text(index: Index, text: str | None, passage: int, threshold: float) -> list[tuple[int, float, int, int, float, float]]:
    """Verified hits (item, score, first word, end word, question and answer overlap), the best of each item."""
    words = words_of(text)
    if not words:
        return []
    none = len(index.terms)
    ids = np.fromiter(map(index.terms.get, words, repeat(none)), np.int64, len(words))
    total = np.concatenate([[0.0], np.cumsum(index.bounds[ids])])
    starts = np.arange(0, max(1, len(words) - passage // 2), passage // 2)
    ends = np.minimum(starts + passage, len(words))
    best: dict[int, tuple[int, float, int, int, float, float]] = {}
    if not none:
        return []
    # The sums of bounds are WAND's first tests: below the threshold there is no pivot.
    if not (total[ends] - total[starts] >= threshold - 1e-9).any():
        return []
    for k in index.live_passages(ids, passage // 2, len(starts), threshold).tolist():
        s, e = int(starts[k]), int(ends[k])
        terms = np.unique(ids[s:e])
        terms = terms[terms < none]
        own: dict[int, set] = {}
        for item, score in index.search(terms.tolist(), threshold):
            shared = []
            for part in index.parts[item]:
                size = min(SHINGLE, len(part))
                if size not in own:
                    own[size] = shingles(words[s:e], size)
                wanted = shingles(part, size)
                shared.append(len(wanted & own[size]) / len(wanted) if wanted else 1.0)
            if min(shared) >= OVERLAP and (item not in best or score > best[item][1] + 1e-12):
                best[item] = (item, score, s, e, *shared)
    return list(best.values())


def _search(index: Index, passage: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(i, index.ids[h[0]], *h[1:]) for h in search_text(index, text.as_py(), passage, threshold)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "start", "end", "question_overlap", "answer_overlap"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Hits of benchmark items in documents: one row per document row and item.

    Every document is cut into passages of at least twice the longest item's
    words, overlapping by half, so each item lies whole in a passage. Each
    passage is a query; all items with at least ``threshold`` of their own BM25
    score are retrieved, then verified: four fifths of the 5-word shingles of
    the item's question (all sentences but its last) and of its answer (the
    last) must be in the passage. Columns: doc_id, item_id, score of the best
    passage (the first on ties), its first and end word, both overlaps.

    Null and blank texts have no hits, null or wordless items match nothing,
    repeated items count once, repeated documents are reported each, null
    doc_ids stay null, other columns are ignored. The index goes to the workers
    in shards of ``shard_postings`` postings at most plus one item's, so any
    number of items can be searched; the statistics are those of all items.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [read.mapInArrow(_search(index, passage, threshold), HIT_SCHEMA) for index, passage in indexes(items, shard_postings)]
    return reduce(DataFrame.unionByName, parts)


def indexes(items: DataFrame, shard_postings: int = SHARD_POSTINGS) -> list[tuple[Index, int]]:
    """The index of each shard of ``items``, with the passages' length for all."""
    weights = impacts(items).cache()
    size = weights.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    postings, longest = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.size(F.split("text", r"[^\p{L}\p{N}]+"))), F.lit(0))).first()
    passage = max(PASSAGE, 2 * longest)
    passage += passage % 2
    shards = max(1, -(-postings // shard_postings))
    found = []
    for k in range(shards):
        mine: dict[tuple[int, str], dict[str, float]] = {}
        for r in weights.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).toLocalIterator():
            mine.setdefault((r.item_id, r.text), {})[r.term] = r.impact
        found.append((Index([(i, t, w) for (i, t), w in mine.items()]), passage))
    weights.unpersist()
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no hit; nothing is shuffled."""

    def keep(index: Index, passage: int):
        return lambda texts: [not search_text(index, t.as_py(), passage, threshold) for t in texts]

    for index, passage in indexes(items):
        docs = keep_rows(docs, ["text"], keep(index, passage))
    return docs
