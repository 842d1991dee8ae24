"""SpotSigs document fingerprints (Theobald, Siddharth and Paepcke, 2008)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import dealt_anew, small_batches, written

#: Content words of a chain.
CHAIN = 2
#: After this many words without an anchor the next one is an anchor.
GAP = 8
#: Ranges of doc_id for each shuffle partition, so that their sizes even out.
RANGES = 4
#: Likeness from which two documents are near-duplicates.
ALIKE = 0.8
#: Bits of a signature that choose the counter of how often it occurs.
COUNTER_BITS = 18
#: Bits of the maps by which rows that can't matter are left out before a shuffle.
MAP_BITS = 26
#: Signatures before a shared one that tell whether two sets have met already.
BACK = 4
#: Members of a group above which it is joined part by part, and cells of a matrix.
SPLIT, MATRIX_CELLS = 1024, 1 << 22
#: Groups up to this size are looked through many at once.
SMALL = 32
_WORDS = re.compile(r"[^\W_]+")

# Common words of the languages at hand, the anchors.
ANCHORS = frozenset(
    """
    a an and are as at be by for from has have he her his i in is it not of on or that the their they this to was were will with you
    au aux avec ce cette dans de des du elle en est et il la le les leur mais ne ou par pas pour qu que qui se ses son sur un une
    als am auch auf aus bei das dem den der des die dies ein eine einen er es für im in ist mit nicht nach sich sie und von vor zu zum zur
    al como con de del el en es esta este la las lo los más no o para pero por que se sin su sus un una y
    """.split()
)


def _anchors(common: np.ndarray) -> np.ndarray:
    """Places of the common words, of the first word, and of every GAP-th one where no common word comes between."""
    n = len(common)
    at = np.flatnonzero(common)
    ends = np.concatenate([[-GAP], at, [n]])
    more = np.maximum((np.diff(ends) - 1) // GAP, 0)
    k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([at, np.repeat(ends[:-1], more) + k * GAP]))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The text's spot signatures, as sorted distinct 32-bit hashes.

    Anchors are the common words and, where those are far between, every GAP-th
    word. Each starts a chain with the ``chain`` content words after it (fewer at
    the end of the text). A text without words has no signature; any other has one.
    """
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint32)
    common = np.fromiter(map(ANCHORS.__contains__, words), bool, len(words))
    content = list(compress(words, (~common).tolist()))
    at = _anchors(common)
    after = np.searchsorted(np.flatnonzero(~common), at, side="right")
    digest = xxhash.xxh32_intdigest
    found = [digest(f"{words[i]} {' '.join(content[j : j + chain])}") for i, j in zip(at.tolist(), after.tolist(), strict=True)]
    return np.unique(np.array(found, np.uint32))


def fingerprint(sigs: np.ndarray) -> str:
    """The signature set as text: eight hexadecimal digits each, ascending."""
    return sigs.astype(">u4").tobytes().hex()


def length_class(size: int, threshold: float) -> int:
    """Partition of a set by its length: sets two or more classes apart can't be that alike."""
    return 0 if size < 1 else int(math.log(size) / -math.log(threshold)) + 1


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, pruned: 0 where it can't reach ``threshold``.

    Lengths alone bound it, and so do the parts that are still to come of a
    merge by ranges of values. Two empty sets are alike.
    """
    if not len(a) and not len(b):
        return 1.0
    few, many = sorted((len(a), len(b)))
    if few == 0 or few < threshold * many:
        return 0.0
    need = threshold / (1 + threshold) * (few + many)
    common, la, lb = 0, 0, 0
    steps = 1 if threshold <= 0 else min(16, 1 + few // 256)
    for k in range(1, steps + 1):
        top = (1 << 32) * k // steps
        ha, hb = (len(a), len(b)) if k == steps else (int(np.searchsorted(a, top)), int(np.searchsorted(b, top)))
        common += len(np.intersect1d(a[la:ha], b[lb:hb], assume_unique=True))
        la, lb = ha, hb
        if common + min(len(a) - la, len(b) - lb) < need - 1e-9:
            return 0.0
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the key, found in two steps of square-root size."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    coarse = below(longs(bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.slice(longs(bounds), (coarse - 1) * step + 1, F.lit(step))))


class Parts:
    """Ranges of (doc_id, version) with about as many rows each; null doc_ids come last.

    A doc_id that fills several ranges has as many of its own, by version.
    """

    def __init__(self, ids: DataFrame, n: int):
        key = F.col("doc_id")
        nulls, rows, quantiles = ids.agg(F.count(F.when(key.isNull(), 1)), F.count(F.lit(1)), F.percentile_approx(key, [k / n for k in range(1, n)], 10_000)).first()
        quantiles = quantiles or []
        often = {q: quantiles.count(q) for q in set(quantiles) if quantiles.count(q) > 1}
        self.bounds = sorted(set(quantiles) | {q + 1 for q in often if q < (1 << 63) - 1})
        # By range: its number of shares, and those of all ranges before it.
        self.shares = [1] + [often.get(q, 1) for q in self.bounds]
        self.before = [sum(self.shares[:k]) for k in range(len(self.shares))]
        self.first_null = sum(self.shares)
        self.null_shares = max(1, math.ceil(n * nulls / rows)) if rows else 1

    def of(self, doc_id: Column, version: Column) -> Column:
        r = _range_of(doc_id, self.bounds)
        share = lambda m: F.least(F.floor((version.cast("double") / float(1 << 64) + 0.5) * m), m - 1)
        ints = lambda xs: F.array(*map(F.lit, xs))
        m = F.element_at(ints(self.shares), r + 1)
        own = F.element_at(ints(self.before), r + 1) + share(m)
        return F.when(doc_id.isNull(), F.lit(self.first_null) + share(F.lit(self.null_shares))).otherwise(own).cast("int")


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, version and text of every row; the version is a hash of the text, and null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, as they are about to be shuffled."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([squeeze(t.as_buffer()) for t in batch.column(batch.num_columns - 1)], pa.binary())], [*batch.schema.names[:-1], "squeezed"])


def _in_order(docs: DataFrame, ids: DataFrame, near: DataFrame) -> DataFrame:
    """Texts in the order of (doc_id, version) within parts, each part followed by the first row of the next one.

    Before a text comes its row of ``near``, if it has one.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = Parts(ids, tasks * RANGES)
    part = parts.of(F.col("doc_id"), F.col("version"))
    firsts = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")).alias("f"))
    firsts = sorted((r.part, r.f.doc_id, r.f.version) for r in firsts.collect())
    # At most as many rows as there are ranges. The first row of all follows the last part.
    to = [(i, v, firsts[k - 1][0], 1 if k else 2) for k, (_, i, v) in enumerate(firsts)]
    copies = F.broadcast(spark.createDataFrame(to, "id long, v long, to int, after int"))
    own = F.struct(F.col("part"), F.lit(0).alias("after"))
    also = F.struct(F.col("to").alias("part"), F.col("after"))
    rows = _plain(docs).withColumn("part", part)
    rows = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left").withColumn("x", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))))
    rows = rows.select("doc_id", "version", "x.part", "x.after", "text").mapInArrow(_squeeze, "doc_id long, version long, part int, after int, squeezed binary")
    null = F.lit(None).cast("long")
    rows = rows.select("*", null.alias("n_near"), null.alias("first_near"))
    near = near.select("doc_id", "version", part.alias("part"), F.lit(0).alias("after"), F.lit(None).cast("binary").alias("squeezed"), "n_near", "first_near")
    both = rows.unionByName(near).repartition(tasks, "part")
    return both.sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_last(), "version", F.col("n_near").asc_nulls_last())


_RESULT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "n_near": pa.int64(), "first_near": pa.int64(),
}
_RESULT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_near long, first_near long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, near = None, None
    spread = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        ids, versions, parts, after, counts, firsts = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6))
        for k, (i, version, part, copy) in enumerate(zip(ids, versions, parts, after, strict=True)):
            if counts[k] is not None:
                near = (i, version, counts[k], firsts[k])
                continue
            text = spread(batch.column(4)[k].as_buffer()).decode("utf-8", "surrogatepass")
            sigs = signatures(text)
            if before is not None and before[1] == part and not before[2]:
                j, _, _, old, old_sigs, found = before
                half = edited(old, text)
                own = signatures(half)
                out.append((j, len(old), hashlib.sha256(half.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(old_sigs), fingerprint(own), jaccard(old_sigs, own), jaccard(old_sigs, sigs), *found))
            before = (i, part, copy, text, sigs, near[2:] if near and near[:2] == (i, version) else (0, i))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(_RESULT.values())], list(_RESULT))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, each text by itself."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(signatures(t)) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_SETS = "doc_id long, version long, id long, sigs binary"


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, version, id and sigs of every row, written: the set as bytes and its hash; equal sets share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t.as_py()).tobytes() for t in batch.column(2)]
            hashes = [xxhash.xxh64_intdigest(s) >> 1 for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "version", "id", "sigs"])

    return written(_plain(docs).mapInArrow(run, _SETS))


def _decoded(sigs: pa.Scalar) -> np.ndarray:
    return np.frombuffer(sigs.as_buffer(), np.uint32)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often signatures occur in all sets, summed by their first COUNTER_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.concatenate([_decoded(s) for s in batch.column(0)])
                total += np.bincount(own >> (32 - COUNTER_BITS), minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["counter", "n"])

    found = sets.select("sigs").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def _map_of(values: DataFrame, column: str) -> np.ndarray:
    """A map of MAP_BITS bits, those set that a long of ``column`` falls on; at most a row for 64 of them reaches the driver."""
    at = F.col(column).bitwiseAND((1 << MAP_BITS) - 1)
    one = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    found = values.select(F.shiftright(at, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out


def _on_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & ((1 << MAP_BITS) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def rarest(own: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """The set's rarest signatures, rare ones first.

    In one common order, sets that are alike enough share one of the
    n - ceil(threshold n) + 1 first signatures of each.
    """
    k = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
    return own[np.lexsort((own, often[own >> (32 - COUNTER_BITS)]))[:k]] if len(own) else own


def _shared(sets: DataFrame, often: np.ndarray, threshold: float) -> DataFrame:
    """The signatures by which two different sets may meet for the first time.

    For each of a set's rarest signatures, ``prev`` is the one before it. Sets
    that agree in that one too have met there, so a signature that always follows
    the same one is left out. So is one that a single set has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, prevs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = rarest(_decoded(s), often, threshold).astype(np.int64)
                if len(own):
                    sigs.append(own)
                    prevs += [np.array([-1 - i]), own[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(prevs))], ["sig", "prev"])

    rows = sets.select("id", "sigs").mapInArrow(run, "sig long, prev long")
    return rows.groupBy("sig").agg(F.min("prev").alias("lo"), F.max("prev").alias("hi")).where("lo <> hi").select("sig")


_INDEX = "sig long, id long, n int, at int, back binary"


def _index(sets: DataFrame, often: np.ndarray, bits: np.ndarray, threshold: float) -> DataFrame:
    """sig, id, n (of the set), at (place of the signature) and back (the BACK ones before it), once for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = rarest(_decoded(s), often, threshold)
                if len(own):
                    n = len(s.as_buffer()) // 4
                    padded = np.concatenate([np.zeros(BACK, np.uint32), own])
                    rows += [(int(own[k]), i, n, k, padded[k : k + BACK].tobytes()) for k in np.flatnonzero(_on_map(bits, own)).tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["sig", "id", "n", "at", "back"])

    return sets.select("id", "sigs").mapInArrow(run, _INDEX).distinct()


def _lengths_and_places(n: np.ndarray, at: np.ndarray, back: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows x and y of a group may be alike: lengths bound that, as does what follows the shared signature."""
    n1, n2 = n[x], n[y]
    ok = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    return ok & (np.minimum(n1 - at[x], n2 - at[y]) >= threshold / (1 + threshold) * (n1 + n2) - 1e-9)


def _first_here(n: np.ndarray, at: np.ndarray, back: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows x and y meet here first, for all that ``back`` tells; false where a signature before is in both."""
    ok = np.ones(np.broadcast(x, y).shape, bool)
    for a in range(BACK):
        for b in range(BACK):
            # Places before a set's first signature are none.
            ok &= ~((back[x, a] == back[y, b]) & (at[x] >= BACK - a) & (at[y] >= BACK - b))
    return ok


def _may_meet(n: np.ndarray, at: np.ndarray, back: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which members of ``left`` and of ``right`` of one group may be alike and meet here first."""
    x, y = left[:, None], right[None]
    return _lengths_and_places(n, at, back, x, y, threshold) & _first_here(n, at, back, x, y, threshold)


def _blocks(n: np.ndarray, i: int, j: int, sub: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The members of a group by length class: each class with itself and with the next one."""
    classes = np.array([length_class(int(x), threshold) for x in n])
    parts = {}
    for c in np.unique(classes).tolist():
        parts[c] = [np.flatnonzero((classes == c) & (sub == p)) for p in (i, j)]
    for c, (a, b) in parts.items():
        yield (a, a) if i == j else (a, b)
        if c + 1 in parts:
            yield a, parts[c + 1][0 if i == j else 1]
            if i != j:
                yield b, parts[c + 1][0]


def _groups(batches: Iterator[pa.RecordBatch], work, small=None) -> Iterator[pa.RecordBatch]:
    """``work`` of each group of rows with one (sig, i, j), which come one after the other.

    With ``small``, groups of at most SMALL rows of one signature are handed to it
    many at once, with their bounds.
    """
    held: list[pa.RecordBatch] = []

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "i", "j")], 1)

    def whole(batch: pa.RecordBatch, k: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        few = (np.diff(starts) <= SMALL) & (k[starts[:-1], 1] == k[starts[:-1], 2]) if small else np.zeros(len(starts) - 1, bool)
        if few.any():
            yield from small(batch, starts[:-1][few], starts[1:][few])
        for a, b in zip(starts[:-1][~few].tolist(), starts[1:][~few].tolist(), strict=True):
            yield from work(pa.Table.from_batches([batch.slice(a, b - a)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        k = keys(batch)
        starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
        if held and (keys(held[-1].slice(held[-1].num_rows - 1))[0] == k[0]).all():
            held.append(batch.slice(0, starts[1]))
            starts = starts[1:]
        if len(starts) > 1 and held:
            yield from work(pa.Table.from_batches(held))
            held = []
        if len(starts) > 2:
            yield from whole(batch, k, starts[:-1])
        if len(starts) > 1:
            held = [batch.slice(starts[-2])]
    if held:
        yield from work(pa.Table.from_batches(held))


def _bounds_of(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, at = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
    return n, at, np.frombuffer(b"".join(group.column("back").to_pylist()), np.uint32).reshape(-1, BACK)


def _group_columns(group: pa.Table) -> tuple:
    n, at, back = _bounds_of(group)
    sub = group.column("sub").to_numpy()
    return n, at, sub, back, group.column("i")[0].as_py(), group.column("j")[0].as_py()


def _dealt(index: DataFrame, split: int) -> DataFrame:
    """The index in groups: those of a signature, or of two parts of them where they are many."""
    hot = index.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("sig", F.ceil(F.col("c") / split).cast("int").alias("m"))
    rows = index.join(dealt_anew(hot, "m", "sig"), "sig")
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("sig", F.least("sub", "t").alias("i"), F.greatest("sub", "t").alias("j"), "sub", "id", "n", "at", "back")
    return _together(rows)


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")


_GROUPED = "sig long, i int, j int, sub int, id long, n int, at int, back binary"


def _candidates(dealt: DataFrame, threshold: float) -> DataFrame:
    """The members of each group that may be alike with another one of it."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(group) < 2:
            return
        n, at, sub, back, i, j = _group_columns(group)
        wanted = np.zeros(len(n), bool)
        for a, b in _blocks(n, i, j, sub, threshold):
            ok = _may_meet(n, at, back, a, b, threshold)
            if a is b:
                np.fill_diagonal(ok, False)
            wanted[a] |= ok.any(1)
            wanted[b] |= ok.any(0)
        if wanted.any():
            yield from group.filter(pa.array(wanted)).to_batches()

    def small(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, at, back = _bounds_of(batch)
        # Each row with those before it in its group.
        sizes = ends - starts
        rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(starts, sizes) + rank
        x = np.repeat(row, rank)
        y = x - 1 - (np.arange(len(x)) - np.repeat(np.cumsum(rank) - rank, rank))
        for step in (_lengths_and_places, _first_here):
            ok = step(n, at, back, x, y, threshold)
            x, y = x[ok], y[ok]
        wanted = np.zeros(len(n), bool)
        wanted[x] = wanted[y] = True
        if wanted.any():
            yield batch.filter(pa.array(wanted))

    return dealt.mapInArrow(lambda batches: _groups(batches, work, small), _GROUPED)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, ok: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets of ``left`` with sets of ``right``, where ``ok``.

    They are added up over ranges of signatures, and given up as soon as no pair
    can still have as many in common as it needs.
    """
    both = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[k] for k in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[k]) for k in both])
    kinds, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    a, b = np.searchsorted(both, left), np.searchsorted(both, right)
    rest = np.bincount(owner, minlength=len(both))
    found = np.zeros((len(left), len(right)), np.float32)
    step = max(64, MATRIX_CELLS // len(both))
    order = np.argsort(at, kind="stable")
    at, owner, alone = at[order], owner[order], (often < 2)
    cuts = np.searchsorted(at, [*range(0, len(kinds), step), len(kinds)]).tolist()
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        seen = ~alone[at[lo:hi]]
        columns, where = np.unique(at[lo:hi][seen], return_inverse=True)
        if len(columns):
            m = np.zeros((len(both), len(columns)), np.float32)
            m[owner[lo:hi][seen], where] = 1
            found += m[a] @ m[b].T
        rest = rest - np.bincount(owner[lo:hi], minlength=len(both))
        if k + 2 < len(cuts) and not (ok & (found + np.minimum(rest[a][:, None], rest[b][None]) >= need)).any():
            break
    return found


def _links(rows: DataFrame, often: np.ndarray, threshold: float) -> DataFrame:
    """(id, more, before): rows of the sets that a set is alike with, and their smallest doc_id; a pair shows in one group only."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(group) < 2:
            return
        n, at, sub, back, i, j = _group_columns(group)
        sets = [_decoded(s) for s in group.column("sigs").combine_chunks()]
        copies = group.column("copies").to_numpy()
        firsts = group.column("first")
        known = np.array([x.is_valid for x in firsts])
        first = np.array([x.as_py() if x.is_valid else (1 << 63) - 1 for x in firsts], np.int64)
        more, before, found = np.zeros(len(n), np.int64), np.full(len(n), (1 << 63) - 1), np.zeros(len(n), bool)
        for a, b in _blocks(n, i, j, sub, threshold):
            if not len(a) or not len(b):
                continue
            ok = _may_meet(n, at, back, a, b, threshold)
            if a is b:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            sums = n[a][:, None] + n[b][None]
            common = _common(sets, a, b, ok, threshold / (1 + threshold) * sums - 1e-6)
            ok &= common >= threshold * (sums - common) - 1e-6
            if not ok.any():
                continue
            # Of all signatures that both have among their rarest, this must be the first.
            earlier = [rarest(s, often, threshold)[:k] for s, k in zip(sets, at.tolist(), strict=True)]
            if sum(map(len, earlier)):
                ok &= _common(earlier, a, b, ok, np.zeros(ok.shape)) == 0
            for x, y, link in ((a, b, ok), (b, a, ok.T))[: 1 if a is b else 2]:
                more[x] += link @ copies[y]
                before[x] = np.minimum(before[x], np.where(link & known[y][None], first[y][None], (1 << 63) - 1).min(1))
                found[x] |= (link & known[y][None]).any(1)
        kept = np.flatnonzero(more)
        if len(kept):
            yield pa.RecordBatch.from_arrays([group.column("id").combine_chunks().take(pa.array(kept)), pa.array(more[kept]), pa.array(before[kept], pa.int64(), mask=~found[kept])], ["id", "more", "before"])

    return rows.mapInArrow(lambda batches: _groups(batches, work), "id long, more long, before long")


def near_sets(sets: DataFrame, threshold: float = ALIKE, split: int = SPLIT) -> DataFrame:
    """id, n_near, first_near of the signature sets with near-duplicates anywhere in the corpus.

    n_near counts the other rows whose set's Jaccard likeness reaches
    ``threshold``; first_near is the smallest doc_id of those and of the set's
    own rows. Sets meet at the first of their rarest signatures that they share;
    there they are partitioned by length class, and within a class and with the
    next one compared by pruned Jaccard. The whole sets travel only where lengths
    and places leave a chance. A signature of many sets is joined part by part.
    Equal sets, empty ones too, are counted and not paired.
    """
    often = _frequencies(sets)
    bits = _map_of(_shared(sets, often, threshold), "sig")
    index = written(_index(sets, often, bits, threshold))
    candidates = written(_candidates(_dealt(index, split), threshold))
    bits = _map_of(candidates.select("id"), "id")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_on_map(bits, batch.column(1).to_numpy())))

    own = sets.select("doc_id", "id", "sigs").mapInArrow(some, "doc_id long, id long, sigs binary")
    own = own.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.first("sigs").alias("sigs"))
    rows = _together(candidates.join(dealt_anew(own, "copies", "id"), "id").select("sig", "i", "j", "sub", "id", "n", "at", "back", "copies", "first", "sigs"))
    others = _links(rows, often, threshold).groupBy("id").agg(F.sum("more").alias("more"), F.min("before").alias("before"))
    groups = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    found = groups.join(others, "id", "left").select("id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), F.least("first", "before").alias("first_near"))
    return found.where("n_near > 0")


def near_duplicates(docs: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """How each document's fingerprint stands to its edited text's, to the next document's, and to all others.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_near, first_near. The next
    document is that of the next doc_id; the first follows the last. A null text
    is empty; empty texts have empty fingerprints, which are alike among
    themselves and unlike any other. Rows that share a doc_id follow each other by
    a hash of their text; null doc_ids come last; other columns are ignored. A
    single row is its own next one. No rows in, none out. n_near and first_near
    are those of ``near_sets``; a row without near-duplicates has 0 and its own
    doc_id.

    Texts are shuffled once, compressed, to ranges of doc_id; only the first rows
    of each range are copied, to the range before it.
    """
    small_batches(docs.sparkSession)
    sets = _sets(docs)
    near = written(near_sets(sets, threshold))
    ids = sets.select("doc_id", "version", "id")
    rows = ids.join(dealt_anew(near, "n_near", "id"), "id").select("doc_id", "version", "n_near", "first_near").distinct()
    return _in_order(docs, ids, rows).mapInArrow(_compare, _RESULT_SCHEMA)
