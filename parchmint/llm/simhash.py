"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import boxed, connected_components, cut_lineage, dealt_anew, files_for, small_batches, unboxed

BUDGET = 3
SEED = 42
#: Node pairs with at most this many leaf pairs below are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs expanded at once.
FRONTIER = 1 << 17
#: A block value with more fingerprints than this (or than 8 times the mean) is split.
SPLIT = 512


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over the 3-word shingles of ``text``, repeats included.

    Letters A-Z are lower-cased, words are runs of anything but the ASCII
    white space, shingles are joined by one space and hashed by XXH64 (seed 42).
    Fewer than three words: one shingle of them all; none, or null: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    n = len(words) - 2
    if n < 1:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashed = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[2:].tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = np.frombuffer(hashed, np.uint8, min(n - at, 1 << 16) * 8, at * 8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "version", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp): the fingerprint of every row as a signed long, and a hash of its text."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, version long, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(left: np.ndarray, right: np.ndarray | None, roots: np.ndarray, budget: int = BUDGET, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys that differ in at most ``budget`` bits.

    ``left`` and ``right`` are uint64 keys sorted within each root; a row of
    ``roots`` is (lo, hi, lo, hi): the ranges of the two tries to join. With
    ``right`` None, both ranges are of ``left`` and equal: a self-join. A trie
    node is a range of the sorted keys, its children the two parts split by the
    next bit; ``depth`` bits are known to agree from the start. Pairs of nodes go down together with the bits that differ so far,
    and are given up when those exceed the budget.
    """
    own = right is None
    other = left if own else right
    stack = [(depth, roots.astype(np.int64), np.zeros(len(roots), np.int8))]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while stack:
        depth, pairs, diff = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:], diff[half:]), (depth, pairs[:half], diff[:half])]
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        few = na * nb <= LEAF_PAIRS if depth < 64 else np.ones(len(pairs), bool)
        if few.any():
            p, a, b = pairs[few], na[few], nb[few]
            each = a * b
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            width = np.repeat(b, each)
            i, j = np.repeat(p[:, 0], each) + at // width, np.repeat(p[:, 2], each) + at % width
            if own:
                keep = (i < j) | (np.repeat(p[:, 0] != p[:, 2], each))
                i, j = i[keep], j[keep]
            near = _popcount(left[i] ^ other[j]) <= budget
            if near.any():
                yield i[near], j[near]
        pairs, diff = pairs[~few], diff[~few]
        if not len(pairs):
            continue
        if depth not in ones:
            bit = np.uint64(63 - depth)
            counted = [np.concatenate([[0], np.cumsum((k >> bit) & np.uint64(1), dtype=np.int64)]) for k in ((left,) if own else (left, other))]
            ones[depth] = (counted[0], counted[-1])
        ca, cb = ones[depth]
        mid_a = pairs[:, 1] - (ca[pairs[:, 1]] - ca[pairs[:, 0]])
        mid_b = pairs[:, 3] - (cb[pairs[:, 3]] - cb[pairs[:, 2]])
        a0, a1 = (pairs[:, 0], mid_a), (mid_a, pairs[:, 1])
        b0, b1 = (pairs[:, 2], mid_b), (mid_b, pairs[:, 3])
        same = own & (pairs[:, 0] == pairs[:, 2])
        parts = []
        for x, y, more, ok in ((a0, b0, 0, None), (a1, b1, 0, None), (a0, b1, 1, None), (a1, b0, 1, ~same)):
            live = (x[1] > x[0]) & (y[1] > y[0]) & (diff + more <= budget)
            if ok is not None:
                live &= ok
            parts.append((np.stack([x[0][live], x[1][live], y[0][live], y[1][live]], 1), diff[live] + np.int8(more)))
        pairs, diff = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(pairs):
            stack.append((depth + 1, pairs, diff))


def _turned(fp: np.ndarray, block: int) -> np.ndarray:
    """Rotate so that 16-bit block ``block`` (0 is the highest) comes first."""
    s = np.uint64(16 * block)
    return fp if block == 0 else (fp << s) | (fp >> (np.uint64(64) - s))


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each (block, key, i, j) group of one partition; spanning links and link counts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    block, i, j, sub = (table.column(c).to_numpy() for c in ("block", "i", "j", "sub"))
    fp = table.column("fp").to_numpy().view(np.uint64)
    key = np.empty_like(fp)
    for b in range(4):
        key[block == b] = _turned(fp[block == b], b)
    for b in range(4):
        for cross in (False, True):
            mine = (block == b) & ((i != j) == cross)
            if not mine.any():
                continue
            k, ii, jj, ss = key[mine], i[mine], j[mine], sub[mine]
            top = (k >> np.uint64(48)).astype(np.int64)
            order = np.lexsort((k, ss, jj, ii, top))
            k, ii, jj, ss, top = k[order], ii[order], jj[order], ss[order], top[order]
            task = np.concatenate([[True], (top[1:] != top[:-1]) | (ii[1:] != ii[:-1]) | (jj[1:] != jj[:-1])])
            start = np.flatnonzero(task)
            end = np.append(start[1:], len(k))
            if cross:
                low = np.concatenate([[0], np.cumsum(ss == ii)])
                mid = start + low[end] - low[start]
                roots = np.stack([start, mid, mid, end], 1)
                roots = roots[(mid > start) & (end > mid)]
            else:
                roots = np.stack([start, end, start, end], 1)
                roots = roots[end - start > 1]
            if not len(roots):
                continue
            degree = np.zeros(len(k), np.int64)
            label = np.arange(len(k))
            for u, v in trie_links(k, k if cross else None, roots, depth=16):
                # A pair that also agrees on an earlier block is counted there.
                x = k[u] ^ k[v]
                first = np.ones(len(u), bool)
                for e in range(b):
                    shift = np.uint64(16 * (b - 1 - e))
                    first &= ((x >> shift) & np.uint64(0xFFFF)) != 0
                u, v = u[first], v[first]
                np.add.at(degree, u, 1)
                np.add.at(degree, v, 1)
                _union(label, u, v)
            linked = np.flatnonzero(degree)
            if len(linked):
                back = _turned(k, (4 - b) % 4)
                yield pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[label[linked]].view(np.int64)), pa.array(degree[linked])], ["fp", "root", "links"])


def _union(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u and v in ``label``, kept flat (label[label] == label)."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat


def link_distinct(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """(fp, root, links) for the distinct fingerprints in ``fp`` that have a partner.

    Three differing bits leave one of four 16-bit blocks equal, so the rows are
    dealt by (block, its value) and each group is a trie self-join. A group that
    is much larger than the mean is cut into parts by hash, and every pair of
    parts becomes a group of its own: exact, whatever the group's size. Every
    link is counted in one group only. Within a group, links are merged to a
    spanning forest, so at most one row a fingerprint leaves it.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", 48 - 16 * b).bitwiseAND(0xFFFF).alias("key")) for b in range(4)])
    rows = distinct.select("fp", F.explode(blocks).alias("x")).select("fp", "x.block", "x.key")
    limit = max(split, 8 * -(-distinct.count() // (1 << 16)))
    hot = rows.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("block", "key", F.ceil(F.col("n") / limit).cast("int").alias("m"))
    rows = rows.join(dealt_anew(hot, "m", "key"), ["block", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("fp", "block", "key", "sub", F.least("sub", "t").alias("i"), F.greatest("sub", "t").alias("j"))
    dealt = rows.repartition(parts, "block", "key", "i", "j").select("fp", "block", "sub", "i", "j")
    return dealt.mapInArrow(_join_parts, "fp long, root long, links long")


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, n_links.

    Rows whose fingerprints differ in three bits at most are linked;
    component_id is the smallest doc_id that can be reached, n_links the number
    of other distinct fingerprints linked to this one. Null and blank texts have
    fingerprint zero and are linked like any other; repeated rows are each
    returned; rows with a null doc_id take part, but give no component_id of
    their own. Other columns are ignored. No rows in, none out.
    """
    return _classes(docs, split).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


def _classes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    fps = cut_lineage(fingerprints(docs))
    # What follows has a few rows a fingerprint at most, whatever the number of shuffle partitions.
    files = files_for(docs.sparkSession, fps.count())
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).coalesce(files))
    links = cut_lineage(link_distinct(classes.select("fp"), split).repartition(files))
    edges = links.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    comp = connected_components(edges, files=files)
    degree = links.groupBy("fp").agg(F.sum("links").alias("n_links"))
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut_lineage(named.repartition(files))
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(dealt_anew(first, "component_id", "component"), "component").join(degree, "fp", "left").select("fp", "component", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return fps.join(dealt_anew(named, "component_id", "fp"), "fp")


def keep_one(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row, all columns, of each group of near-duplicates: that of the smallest doc_id.

    Where rows share that doc_id, the one whose text has the smallest hash stays,
    and one of those that repeat it. A group without any doc_id keeps one row.
    """
    own = _classes(docs, split).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("component").agg(F.min("component_id").alias("id"), F.min("version").alias("version"))
    first = first.select(_id(F.col("id")).alias("id"), "version")
    rows = boxed(docs).withColumns({"id": _id(F.col("row.doc_id").cast("long")), "version": F.xxhash64(F.col("row.text").cast("string"))})
    kept = rows.join(dealt_anew(first, "version"), ["id", "version"])
    nth = F.row_number().over(Window.partitionBy("id", "version").orderBy("id", "version"))
    return kept.withColumn("nth", nth).where("nth = 1").select(*unboxed(docs.columns))


def _id(c: Column) -> Column:
    return F.coalesce(c, F.lit(-(1 << 63)))
