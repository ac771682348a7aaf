"""Operator 5, near duplicates: ProbMinHash over shingles, banding, verification.

A document is the set of its five-word shingles (words in lower case; a text of
one to four words is a single shingle).
Every shingle is a Poisson process whose rate is its weight; each arrival falls
on one register, and a register keeps the shingle that arrived first. A shingle
stops when its next arrival is later than the slowest register, so that long
documents cost about one arrival a shingle. Two documents agree in a register
with the probability Jaccard similarity of their weighted shingles. All distinct
shingles weigh the same here, however often they occur, so that this is the
similarity that links are verified by. Registers are cut into bands; equal bands
make candidates, and candidates are verified by
the exact Jaccard similarity of their shingle sets (``threshold``, 0.8).

Copies (equal word sequences) are linked to the least doc_id first. In each
band bucket all members are compared with the least member, so that large
groups cost a row per member. Buckets that then still hold several components
are compared across components, block by block of about ``BLOCK`` members, so that
no candidate link is lost and only links leave the comparison. Shingle sets
travel as 32-bit hashes, and only those of documents in buckets. Classes are the connected components; their id is the
least doc_id.

Defined results: null texts and texts without words are alone in their class;
rows that share a doc_id are one document and get the same class; a null doc_id
has a null class; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from eddyflow.llm.common import MIX1, MIX2, components, mix, quoted, settle, shingles, slices, text_chunks, word_table, words

BANDS, ROWS, SIZE, THRESHOLD = 32, 6, 5, 0.8
BLOCK = 256


def distinct_weighted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and their weight."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return h[at], of[at], 1 + np.log(times)


def prob_minhash(h: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m) of the weighted elements h of n texts; zeros for texts without elements.

    Arrivals of all elements are drawn in rounds; an element leaves once it is
    later than the slowest register of its text. Late rounds draw many arrivals
    of the few elements that are left at once.
    """
    first, owner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    slowest = np.full(n, np.inf)
    live, time, k = np.arange(len(h)), np.zeros(len(h)), 0
    while len(live):
        many = int(min(512, max(1, 16_384 // len(live))))
        draw = mix(h[live][:, None] + (np.arange(k, k + many, dtype=np.uint64) + np.uint64(1)) * MIX2)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at = time[live][:, None] + np.cumsum(gap, axis=1) / weight[live][:, None]
        ok = at < slowest[of[live]][:, None]
        slot = of[live][:, None] * m + (mix(draw + MIX1) % np.uint64(m)).astype(np.int64)
        who = np.broadcast_to(h[live][:, None], ok.shape)[ok]
        slot, when = slot[ok], at[ok]
        before = first[slot]
        better = when < before
        slot, when, who = slot[better], when[better], who[better]
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        owner[slot[won]] = who[won]
        slowest = first.reshape(n, m).max(axis=1)
        time[live] = at[:, -1]
        k += many
        live = live[at[:, -1] < slowest[of[live]]]
    return owner.reshape(n, m)


def sketch(texts: Sequence[str | None], kinds: np.ndarray, bands: int, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: two hashes of its word sequence, its bands, its number of shingles; all texts' shingles in a row."""
    n = len(texts)
    exact, count, out = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64), np.zeros((n, bands), np.uint64)
    sets = [np.zeros(0, np.uint32)]
    full = [t or "" for t in texts]
    for a, b in text_chunks([len(t) for t in full]):
        w, doc = words(full[a:b], kinds)
        h, of = shingles(w, doc, b - a, size)
        if not len(h):
            continue
        counts = np.bincount(doc, minlength=b - a)
        some = np.flatnonzero(counts)
        heads = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        place = np.arange(len(w)) - np.repeat(heads, counts[some])
        for j, step in enumerate((MIX1, MIX2)):
            exact[a + some, j] = mix(np.add.reduceat(mix(w + (place.astype(np.uint64) + np.uint64(1)) * step), heads))
        h, of, _ = distinct_weighted(h, of)
        count[a:b] = np.bincount(of, minlength=b - a)
        sets.append((h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        sig = prob_minhash(h, of, np.ones(len(h)), b - a, bands * rows)
        key = np.zeros((b - a, bands), np.uint64)
        for r in range(rows):
            key = mix(key * MIX2 + sig.reshape(b - a, bands, rows)[:, :, r])
        out[a:b] = mix(key + np.arange(bands, dtype=np.uint64) * MIX1)
    return exact, out, count, np.concatenate(sets)


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """id, h1, h2 (the word sequence), bands and s (the distinct shingles) of every document with a word."""
    kinds = word_table()
    schema = StructType().add("id", docs.schema["id"].dataType).add("h1", LongType()).add("h2", LongType()).add("bands", ArrayType(LongType())).add("s", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            exact, keys, count, sets = sketch(batch.column(1).to_pylist(), kinds, bands, rows, size)
            exact, ends = exact.view(np.int64), np.concatenate([[0], np.cumsum(count)])
            lists = [(np.arange(0, keys.size + 1, bands), keys.view(np.int64).ravel()), (ends, sets.view(np.int32))]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact[:, 0]), pa.array(exact[:, 1]), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for at, x in lists)], names=schema.names)
            yield out.filter(pa.array(count > 0))

    return docs.mapInArrow(run, schema)


def similar(a: Column, x: Column, threshold: float) -> Column:
    """Whether two sets are as similar as the threshold by Jaccard."""
    both = F.size(F.array_intersect(a, x))
    return both >= threshold * (F.size(a) + F.size(x) - both)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, class_id) of every document that has a near duplicate, the class's own id included."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    # joins with what grows with the documents are sorted merges at every size, which spill and split
    sig = settle(signatures(docs, bands, rows, size), "signatures")
    # from here on a text stands for all its copies, under the least id
    texts = settle(sig.groupBy("h1", "h2").agg(F.min("id").alias("x"), F.count(F.lit(1)).alias("times"), F.first("bands").alias("bands")), "texts")
    copies = settle(sig.select("id", "h1", "h2").join(texts.filter("times > 1").select("h1", "h2", "x").hint("merge"), ["h1", "h2"]).filter("id <> x").select(F.col("x").alias("a"), F.col("id").alias("x")), "links")
    keys = texts.select("x", F.explode("bands").alias("band"))
    buckets = settle(keys.groupBy("band").agg(F.min("x").alias("a"), F.max("x").alias("z")).filter("a <> z").select("band", "a"), "buckets")
    members = settle(keys.join(buckets, "band"), "members")
    pairs = settle(members.filter("a <> x").select("a", "x").distinct(), "pairs")
    tried = texts.select("h1", "h2", F.col("x").alias("id")).join(members.select(F.col("x").alias("id")), "id", "left_semi")
    sets = settle(sig.join(tried.hint("merge"), ["h1", "h2", "id"], "left_semi").select("id", "s"), "sets")
    links = pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    links = settle(copies.unionAll(links.filter(similar(F.col("sa"), F.col("sx"), threshold)).select("a", "x")), "links")
    comp = components(links.select("a", F.col("x").alias("b")))
    more = settle(crossing(members, sets, comp, threshold), "crossing")
    if not more.isEmpty():
        # the graph of components is small beside that of documents
        merged = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        alone = merged.select(F.col("comp").alias("node"), "to").join(comp, "node", "left_anti")
        comp = comp.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).unionAll(alone)
    return comp.select(F.col("node").alias(key), F.col("comp").alias("class_id"))


def crossing(members: DataFrame, sets: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components that have members in one bucket which are similar.

    Members are dealt into blocks by hash, those of the least member's component
    apart from the rest, and the blocks of the rest meet all blocks of the bucket: a
    row holds two blocks, never a bucket.
    """
    own = settle(members.join(comp.select(F.col("node").alias("x"), "comp"), "x", "left").select("band", "x", F.coalesce("comp", "x").alias("comp")), "own")
    open_ = own.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("many"), F.min_by("comp", "x").alias("first")).filter("lo <> hi").select("band", "first", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    open_ = settle(open_, "open")
    rows = own.join(open_, "band").join(sets.withColumnRenamed("id", "x"), "x").withColumn("own", F.col("comp") == F.col("first")).withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    packs = settle(rows.groupBy("band", "own", "block").agg(F.collect_list(F.struct("x", "comp", "s")).alias("docs")), "packs")
    both = packs.alias("l").join(packs.alias("r"), (F.col("l.band") == F.col("r.band")) & ~F.col("l.own") & (F.col("r.own") | (F.col("l.block") <= F.col("r.block")))).select(F.col("l.docs").alias("l"), F.col("r.docs").alias("r"))
    kind = members.schema["x"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                l, r = (batch.column(k).slice(i, 1).flatten() for k in (0, 1))
                a, x = links_between(*(np.asarray(v) for y in (l, r) for v in (y.field("comp"), y.field("s").flatten(), y.field("s").value_lengths())), threshold)
                yield pa.RecordBatch.from_arrays([l.field("comp").take(pa.array(a)), r.field("comp").take(pa.array(x))], names=["a", "b"])

    return both.mapInArrow(run, StructType().add("a", kind).add("b", kind)).distinct()


def links_between(comp_l: np.ndarray, set_l: np.ndarray, size_l: np.ndarray, comp_r: np.ndarray, set_r: np.ndarray, size_r: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (left, right) of similar documents of two blocks that are in different components."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    terms, at = np.unique(set_r, return_inverse=True)
    ends_l, ends_r = np.cumsum(size_l), np.cumsum(size_r)
    mark = np.zeros(len(terms) + 1, bool)
    place = np.minimum(np.searchsorted(terms, set_l), max(len(terms) - 1, 0))
    place = np.where(terms[place] == set_l, place, len(terms)) if len(terms) else np.zeros(len(set_l), np.int64)
    for i in range(len(comp_l)):
        maybe = (comp_r > comp_l[i]) | (comp_r < comp_l[i])
        maybe &= np.minimum(size_r, size_l[i]) >= threshold * np.maximum(size_r, size_l[i])
        if not maybe.any():
            continue
        own = place[ends_l[i] - size_l[i] : ends_l[i]]
        mark[own] = True
        mark[-1] = False
        found = np.concatenate([[0], np.cumsum(mark[at])])
        both = found[ends_r] - found[ends_r - size_r]
        mark[own] = False
        j = np.flatnonzero(maybe & (both >= threshold * (size_l[i] + size_r - both)))
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """Every row of ``docs``: key, class_id, and whether the row's document stays for its class."""
    found = classes(docs, key=key, **options)
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("class_id", key).alias("class_id")).withColumn("stays", F.col("class_id") == F.col(key))


def without_near_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class; all columns are kept, rows without a key too."""
    lost = classes(docs, key=key, **options).filter(F.col("class_id") != F.col(key)).select(key)
    return docs.join(lost.hint("merge"), key, "left_anti").select(*map(quoted, docs.columns))
