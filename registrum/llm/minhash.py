"""MinHash near-duplicate links by a multi-index Hamming join.

A document's set is its distinct shingles of five words. Its signature is CHUNKS * SYMBOLS minimum hashes cut to 16 bits each. By the pigeonhole
principle, signatures that differ in fewer than 2 * CHUNKS symbols have a chunk with at most one differing symbol; so for each chunk every
single error is enumerated: a key is made of the chunk without one of its symbols, and all pairs under that signature distance share a
key. At a similarity of 0.85 a pair differs in 9 of 60 symbols on average, at 0.8 in 12; that no chunk at all has fewer than two errors, the
only way to lose it, has the chance 0.22 ** 10 < 1e-6, or 0.34 ** 10 < 3e-5.

Work follows the number of documents, not of pairs:
1. equal sets collapse to one node (a 128-bit fingerprint of the whole set), so copies are never compared;
2. keys held by several nodes gather their signatures; a traversal compares each node with the nodes not reached yet and returns a
   spanning forest of the pairs within LOOSE differing symbols, never the pairs themselves;
3. the forests' components are gathered with their full shingle sets, and the same traversal on exact Jaccard similarity returns a spanning
   forest of the links; their components are the result.
Keys and components of any size are cut into blocks, so no group has to fit a task and none is cut off: a block of pivots meets all others, and
only what then still lies in different components of a group is compared further (`_connected`).

Null texts and texts without a word have an empty set and are linked with nothing. Texts of fewer than five words are one shingle.
Repeated rows are copies; texts are read whole. Extra columns are ignored. Rows without an id link nothing and are always kept; their
component is that of rows with the same set, null if there are none. Different texts of one id are judged apart, each by its own links, and
are not linked to each other for having one id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, mixed, releasing, staged, utf8, words
from .graph import component_table

SHINGLE, CHUNKS, SYMBOLS = 5, 10, 6
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Signatures are candidates up to so many differing symbols more than the mean at the threshold, in standard deviations: 1e-5 of pairs have more.
DEVIATIONS = 4.7
#: Nodes of a block, of signatures and of full sets; nodes with candidates that are few enough to broadcast.
BLOCK_SIGNATURES, BLOCK_SETS, BROADCAST = 2048, 512, 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = (mixed(np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64) * _STEP + np.uint64(s)) for s in (11, 29))
_A |= np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text data[at[i]:at[i + 1]], rising, and each text's first one and end."""
    hashes, edge = words(data, at)
    n = np.diff(edge)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(many)])
    of = np.repeat(np.arange(len(n)), many)
    first = np.arange(start[-1]) - start[of] + edge[of]
    out = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = k < n[of]
        word = hashes[np.minimum(first + k, max(0, len(hashes) - 1))] if len(hashes) else out
        out = mixed(out * _STEP + np.where(inside, word, np.uint64(0)))
    order = np.lexsort((out, of))
    out = out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[keep], np.searchsorted(of[keep], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """16-bit minimum hashes, a row for each set; of empty sets zeros."""
    out = np.zeros((len(edge) - 1, CHUNKS * SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        for k in range(CHUNKS * SYMBOLS):
            out[full, k] = np.minimum.reduceat(sets * _A[k] + _B[k], edge[full]) >> np.uint64(48)
    return out


def fingerprints(sets: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set that depend on all of it; of empty sets zeros."""
    out = np.zeros((len(edge) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        for k, salt in enumerate((_STEP, ~_STEP)):
            out[full, k] = mixed(np.add.reduceat(mixed(sets ^ salt), edge[full]) + np.diff(edge)[full].astype(np.uint64))
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """For each row a key for each chunk and each symbol left out of it."""
    out = np.zeros((len(signature), CHUNKS * SYMBOLS), np.uint64)
    for c in range(CHUNKS):
        for x in range(SYMBOLS):
            key = np.full(len(signature), c * SYMBOLS + x + 1, np.uint64)
            for s in range(SYMBOLS):
                if s != x:
                    key = mixed(key * _STEP + signature[:, c * SYMBOLS + s])
            out[:, c * SYMBOLS + x] = key
    return out.view(np.int64)


def loose(percent: int) -> int:
    """Differing symbols up to which signatures are candidates for links of `percent`."""
    n, p = CHUNKS * SYMBOLS, 1 - percent / 100
    return math.ceil(n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, node and check (the set's fingerprint) and sig of every row (doc_id, text, mark)."""
    rows = docs.select("doc_id", "text", "mark")
    names = ["doc_id", "mark", "n_shingles", "node", "check", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in groups(at):
                sets, edge = shingles(data, at[lo : hi + 1])
                print_ = fingerprints(sets, edge).view(np.int64)
                sig = pa.array([x.tobytes() for x in signatures(sets, edge)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(edge)), pa.array(print_[:, 0].copy()), pa.array(print_[:, 1].copy()), sig], names)

    return rows.mapInArrow(releasing(run), "doc_id long, mark long, n_shingles long, node long, check long, sig binary")


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which near(i, others) are i's neighbours: each node meets only those not reached before it."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            out += [(i, int(j)) for j in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def _connected(rows: DataFrame, group: str, block: int, compare: Callable[[pa.Table], pa.Table], large: bool) -> tuple[DataFrame, str]:
    """node and root of every node that is linked with another one of its group, roots but for themselves, as a table and its path.

    rows: the group, node, size (the group's number of rows) and what `compare` needs to return a spanning forest (a, b) of its rows. A group of at most
    `block` rows is one task. Of a larger one, a first block of pivots, dealt by hash, meets every other block; most rows of a group that hangs
    together are then in one component. Rows that are not meet all rows of their group, in blocks, so that all pairs of different components are
    compared and none else: copies grow with the rows left over, not with the square of the group. `large`: whether any group is."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in (group, "node", "size")]
    rows = rows.withColumnRenamed(group, "grp")
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = rows.select("grp", "node", *others, F.explode(F.when(F.col("own") == 0, everywhere).otherwise(F.array("own"))).alias("j"))
    tied, path = component_table(first.groupBy("grp", "j").applyInArrow(compare, "a long, b long"))
    if not large:
        return tied, path
    crowded = rows.where("blocks > 1").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = crowded.groupBy("grp", "root").agg(F.count("*").alias("n"))
    main = counted.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).withColumn("left", F.ceil((F.col("all") - F.col("most")) / block).cast("int")).where(F.col("left") > 0)
    met = crowded.join(main.select("grp", "main", "left"), "grp")
    strays = met.where("root <> main").withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("left")).cast("int"))
    asked = strays.select("grp", "node", *others, "part", F.explode(everywhere).alias("j"))
    offered = met.select("grp", "node", *others, F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("part"), F.col("own").alias("j"))
    late = asked.unionByName(offered).groupBy("grp", "part", "j").applyInArrow(compare, "a long, b long")
    whole, new = component_table(tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    discard(spark, path)
    return whole, new


def _edges(nodes: np.ndarray, forest: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})


def _similar_signatures(table: pa.Table, most: int) -> pa.Table:
    nodes = table.column("node").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(nodes), -1)
    return _edges(nodes, _forest(len(nodes), lambda i, left: (sig[left] != sig[i]).sum(1) <= most))


def _similar_sets(table: pa.Table, percent: int) -> pa.Table:
    nodes = table.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(names), bool)

    def near(i: int, left: np.ndarray) -> np.ndarray:
        mine = flat[start[i] : start[i + 1]]
        mark[mine] = True
        fits = (100 * np.minimum(sizes[left], sizes[i]) >= percent * np.maximum(sizes[left], sizes[i])).nonzero()[0]
        out = np.zeros(len(left), bool)
        if len(fits):
            own = left[fits]
            at = np.concatenate([[0], np.cumsum(sizes[own])])
            where = np.arange(at[-1]) - np.repeat(at[:-1] - start[own], sizes[own])
            both = np.add.reduceat(mark[flat[where]].astype(np.int64), at[:-1])
            out[fits] = 100 * both >= percent * (sizes[own] + sizes[i] - both)
        mark[mine] = False
        return out

    return _edges(nodes, _forest(len(nodes), near))


def mark_of(text: Column) -> Column:
    """The mark by which linked() tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def linked(docs: DataFrame, text: str = "text", percent: int = PERCENT, broadcast: int = BROADCAST, block_signatures: int = BLOCK_SIGNATURES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, mark (mark_of the text), n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id) of every row; links have at least `percent` of their shingles in common (80 or more: the keys are made for that)."""
    if percent < 80:
        raise ValueError(f"percent = {percent}: the keys find links of 80 or more")
    spark, most = docs.sparkSession, loose(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), mark_of(F.col(text)).alias("mark"))
    base, base_path = staged(_described(docs), "sets")
    used = [base_path]
    full = base.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"))
    sigs, path = staged(full.join(nodes, ["node", "check", "doc_id"]).select("node", "doc_id", "mark", "sig").dropDuplicates(["node"]), "nodes")
    used.append(path)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                made = keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), made.shape[1]))], ["key", "node"])

    made = sigs.select("node", "sig").mapInArrow(releasing(keyed), "key long, node long")
    # Counted with a combining aggregate and joined, so that a key of very many nodes is a skewed join, which may be split, and no window of one task.
    busy = made.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared, path = staged(made.join(busy, "key"), "shared")
    used.append(path)
    large = (shared.agg(F.max("size")).first()[0] or 0) > block_signatures
    tied, path = _connected(shared.join(sigs.select("node", "sig"), "node"), "key", block_signatures, lambda table: _similar_signatures(table, most), large)
    roots, roots_path = staged(_members(tied), "candidates")
    discard(spark, path)
    used.append(roots_path)

    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    large = (sizes.agg(F.max("size")).first()[0] or 0) > block_sets
    sized = roots.join(sizes, "root")
    wanted = sized.join(sigs.select("node", "doc_id", "mark"), "node")
    if roots.count() <= broadcast:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, ["doc_id", "mark"]).select("root", "size", "node", "text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(3))
            for lo, hi in groups(at):
                sets, edge = shingles(data, at[lo : hi + 1])
                part = batch.slice(lo, hi - lo)
                mine = fingerprints(sets, edge).view(np.int64)[:, 0] == part.column(2).to_numpy()  # a text of the same mark may be another one
                packed = pa.array([sets[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], ["root", "size", "node", "shingles"]).filter(pa.array(mine))

    sets = texts.mapInArrow(releasing(with_sets), "root long, size long, node long, shingles binary")
    tied, path = _connected(sets, "root", block_sets, lambda table: _similar_sets(table, percent), large)
    linked_nodes, linked_path = staged(_members(tied), "linked")
    discard(spark, path)
    used.append(linked_path)
    named = linked_nodes.join(sigs.select("node", "doc_id"), "node")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = nodes.select("node", "check", "doc_id").join(linked_nodes, "node", "left").join(lowest, "root", "left").select("node", "check", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = base.select("doc_id", "mark", "n_shingles", "node", "check").join(of, ["node", "check"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out, _ = staged(out.select("doc_id", "mark", "n_shingles", alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept")), "near-duplicates")
    for path in used:
        discard(spark, path)
    return out


def _members(tied: DataFrame) -> DataFrame:
    """node and root of every node, roots too."""
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
