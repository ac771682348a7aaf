"""Operator 10, exact top-k search by distributed histogram selection.

Vectors are quantised to integers, floor(1024 x) of every component, and packed
into chunks; the queries are packed into blocks. Every block meets every chunk,
and one matrix product scores them. The first pass sends, for each query, a
histogram of its scores over coarse bins; summed over all chunks it locates the
bin of the kth value. The next pass splits that bin into finer ones, until the
kth value is known exactly. The last pass keeps scores above it and as many of
the least vec_ids that tie with it as the query still lacks. A chunk sends of a
histogram only its highest bins that hold k scores: lower ones cannot matter.

Blocks are sent to all executors, as many at a time as take ``max_broadcast``
bytes; more queries are searched batch after batch, so that the chunks are read
again but never shuffled. Nothing of a query's candidates is gathered but its k
best and k bins from each chunk.

Defined results: vectors that are null or hold null or non-finite components,
and rows without vec_id, take no part; a query repeated with several vectors is
answered by the least of them; rows with the query's vec_id are its own; repeated
candidate rows count each; components that a shorter vector lacks count as 0;
scores stop at 2**61 either way; an empty table, or one without a query, gives no
row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyflow.llm.common import settle

BINS = 14  # bits of a histogram
MOST = 1 << 61  # of a score


def pack(ids: np.ndarray, vectors: list[np.ndarray]) -> bytes:
    """Ids and quantised components of some vectors; two bytes a component where they fit."""
    d = max((len(v) for v in vectors), default=0)
    m = np.zeros((len(ids), d))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    small = np.abs(m).max(initial=0) < 1 << 15
    return np.array([len(ids), d, small], np.int64).tobytes() + ids.astype(np.int64).tobytes() + m.astype(np.int16 if small else np.float64).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d, small = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    return np.frombuffer(blob, np.int64, n, 24), np.frombuffer(blob, np.int16 if small else np.float64, n * d, 24 + 8 * n).reshape(n, d).astype(np.float64)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; plain floating point while every partial sum is below 2**53."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if d * max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in c]
    return np.array([[min(max(sum(int(a) * b for a, b in zip(row, x, strict=True)), -MOST), MOST) for x in whole] for row in q], np.int64).reshape(len(q), len(c))


def quantised(v: list) -> np.ndarray:
    return np.clip(np.floor(np.asarray(v, np.float64) * 1024), -1e18, 1e18)


def packs(rows: DataFrame, per: int) -> DataFrame:
    """Chunks (blob, top) of at most ``per`` vectors of (id, v); top bounds their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, per):
                part = batch.slice(a, per)
                vectors = [quantised(v) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([pack(np.array(part.column(0)), vectors)], pa.binary()), pa.array([max(float(np.sqrt((v * v).sum())) for v in vectors)])], names=["blob", "top"])

    return rows.mapInArrow(run, "blob binary, top double")


def query_blocks(asked: DataFrame, per: int) -> DataFrame:
    """Blocks (block, queries, top) of about ``per`` queries of (id, v), dealt by hash of the id."""
    n = max(1, -(-asked.count() // per))
    groups = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vectors = [quantised(r["v"]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(np.array([r["id"] for r in rows], np.int64), vectors)], pa.binary()), pa.array([max(float(np.sqrt((v * v).sum())) for v in vectors)])], names=["block", "queries", "top"])

    return groups.mapInArrow(run, "block long, queries binary, top double")


def met(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every block of a batch beside every chunk: (chunk, block, queries, state)."""
    least, past = blocks.agg(F.coalesce(F.min("block"), F.lit(0)), F.coalesce(F.max("block"), F.lit(-1)) + 1).first()
    side = blocks.select("block", "queries", "state")
    wide = chunks.select(F.col("blob").alias("chunk"), F.explode(F.expr(f"CASE WHEN {past} > {least} THEN sequence({least}L, {max(past, 1)}L - 1) END")).alias("block"))
    return wide.join(F.broadcast(side), "block").select("chunk", "block", "queries", "state")


def batches_of(blocks: DataFrame, max_broadcast: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of block numbers that take ``max_broadcast`` bytes at most (one block at least)."""
    n, size = blocks.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1, F.coalesce(F.max(F.length("queries")), F.lit(1))).first()
    per = max(1, max_broadcast // (2 * size))
    return [(k, min(k + per, n)) for k in range(0, n, per)] or [(0, 0)]


def known(ids: np.ndarray, blob: bytes | None, low: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query: the least score of the bin that holds its kth value, and how many scores it lacks there."""
    base, lack = np.full(len(ids), low, np.int64), np.full(len(ids), k, np.int64)
    if blob:
        got = np.frombuffer(blob, np.int64).reshape(-1, 3)
        at = np.minimum(np.searchsorted(got[:, 0], ids), len(got) - 1)
        there = got[at, 0] == ids
        base, lack = np.where(there, got[at, 1], base), np.where(there, got[at, 2], lack)
    return base, lack


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of a block's queries as one binary: id, low, lack of each, by id."""
    for batch in batches:
        rows = [np.array([[x["id"], x["low"], x["lack"]] for x in s], np.int64).tobytes() for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["block", "state"])


def top_k(vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 1024, chunk: int = 4096, max_broadcast: int = 64 << 20) -> DataFrame:
    """Rows (query_id, rank, key, score): the k best candidates of each query row (where ``is_query`` holds)."""
    whole = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    whole = whole.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    chunks = settle(packs(whole.select("id", "v"), chunk), "chunks")
    blocks = settle(query_blocks(whole.filter("q").groupBy("id").agg(F.min("v").alias("v")), block), "blocks")
    parts = batches_of(blocks, max_broadcast)
    if len(parts) == 1:
        return search(blocks, chunks, key, k)
    found = [settle(search(blocks.filter(F.col("block").between(lo, hi - 1)), chunks, key, k), "found") for lo, hi in parts]
    return reduce(DataFrame.unionAll, found)


def search(blocks: DataFrame, chunks: DataFrame, key: str, k: int) -> DataFrame:
    """The k best candidates of the queries of one batch of blocks."""
    (top,), (most,) = (x.agg(F.coalesce(F.max("top"), F.lit(0.0))).first() for x in (chunks, blocks))
    reach = min(int(most * top * (1 + 1e-9)) + 1, MOST)
    low = -reach
    state = blocks.withColumn("state", F.lit(None).cast("binary"))
    width = (2 * reach).bit_length()  # bits of the span that is still open
    while width > 0:
        step = max(0, width - BINS)

        def histogram(batches: Iterator[pa.RecordBatch], span: int = 1 << width, step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, b, queries, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    (ids, q), (cid, cv) = unpack(queries), unpack(c)
                    base, lack = known(ids, blob, low, k)
                    rows = [[np.zeros(0, np.int64)] * 3]
                    for a in range(0, len(ids), 128):
                        for i, s in enumerate(scores(q[a : a + 128], cv), a):
                            x = s - base[i]
                            x = x[(cid != ids[i]) & (x >= 0) & (x < span)] >> step
                            if lack[i] and len(x):
                                if len(x) > lack[i]:
                                    x = x[x >= np.partition(x, -lack[i])[-lack[i]]]
                                bins, times = np.unique(x, return_counts=True)
                                rows.append([np.full(len(bins), ids[i]), base[i] + (bins << step), times])
                    ids, bins, times = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b, np.int64)), pa.array(ids), pa.array(bins), pa.array(times)], names=["block", "id", "bin", "times"])

        hist = met(state, chunks).mapInArrow(histogram, "block long, id long, bin long, times long").groupBy("block", "id", "bin").agg(F.sum("times").alias("times"))
        hist = hist.withColumn("whole", F.lit(k).cast("long")) if width == (2 * reach).bit_length() else hist.join(needs.select("block", "id", F.col("lack").alias("whole")), ["block", "id"])  # noqa: F821
        w = Window.partitionBy("block", "id").orderBy(F.desc("bin"))
        held = hist.withColumn("above", F.sum("times").over(w) - F.col("times")).filter("above < whole").groupBy("block", "id").agg(F.min("bin").alias("bin"), F.max("above").alias("above"), F.max("whole").alias("whole"), F.sum("times").alias("seen"))
        few = F.col("seen") < F.col("whole")  # fewer candidates than k: all are kept, nothing is left to find
        found = held.select("block", "id", F.when(few, F.lit(low - 1)).otherwise(F.col("bin")).alias("low"), F.when(few, F.lit(0)).otherwise(F.col("whole") - F.col("above")).cast("long").alias("lack"))
        if width != (2 * reach).bit_length():
            found = found.unionAll(needs.filter("lack = 0"))  # noqa: F821
        needs = settle(found, "needs")
        packed = needs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "low", "lack"))).alias("s")).mapInArrow(blobs, "block long, state binary")
        state = settle(blocks.join(packed, "block", "left"), "state")
        width = step

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, queries, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                (ids, q), (cid, cv) = unpack(queries), unpack(c)
                base, lack = known(ids, blob, low - 1, 0)
                rows = [[np.zeros(0, np.int64)] * 3]
                for a in range(0, len(ids), 128):
                    for i, s in enumerate(scores(q[a : a + 128], cv), a):
                        other = cid != ids[i]
                        tie = np.flatnonzero(other & (s == base[i]))
                        at = np.concatenate([np.flatnonzero(other & (s > base[i])), tie[np.argsort(cid[tie], kind="stable")[: lack[i]]]])
                        rows.append([np.full(len(at), ids[i]), cid[at], s[at]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["query_id", "id", "score"])

    best = met(state, chunks).select("chunk", "queries", "state").mapInArrow(select, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
