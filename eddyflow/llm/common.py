"""Shared helpers: shared-folder tables, bounded samples, vectorised words, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import eddyflow

# Functions of this package travel to the executors by value, so a cluster
# needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(eddyflow)


# ---------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; tests get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if (folder := spark.sparkContext.getCheckpointDir()) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eddyflow-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_written: list[tuple[SparkSession, str]] = []
#: Rows of narrow tables that one task writes, where their number is known.
ROWS_A_TASK = 200_000


def settle(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The files outlive lost executors; they are removed when the driver exits. With
    ``rows``, a bound on the rows of ``df``, small tables are written by few tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/eddyflow-{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_settled() -> None:
    """Remove every table that ``settle`` has written so far."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is scratch space
            return


atexit.register(drop_settled)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder, for small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, led by as many _ as keep them apart from those taken."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
        used.add(name.lower())
    return out


def fold(key: str, n: int):
    """crc32 of the key as text, modulo n; null where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, text: str, max_rows: int, max_chars: int, salt: int = 17) -> DataFrame:
    """A repeatable sample by hash of the key, bounded in rows and characters.

    One counting pass over all of ``df`` sets the kept share of the hash range,
    so the expected sample size is within both bounds at every input size; rows over
    ``max_rows`` go from the end of the hash's order.
    """
    n, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    share = min(1.0, max_rows / max(n, 1), max_chars / max(chars, 1))
    if share >= 1.0:
        return df
    u = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30))
    return df.filter(u < int(share * 0.97 * (1 << 30))).orderBy(u, key, text).limit(max_rows)


# ---------------------------------------------------------------- batches
def text_chunks(lengths: Sequence[int], max_chars: int = 400_000, max_rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``max_chars`` characters each (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > max_chars or i - start >= max_rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into small ones, so that few texts at a time are Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def word_table() -> np.ndarray:
    """For every code point of the basic plane: 1 for letters, 2 for other word characters, else 0."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        s = chr(c)
        if s.isalpha():
            out[c] = 1
        elif s.isalnum() or s == "_":
            out[c] = 2
    return out


def code_points(texts: Sequence[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as one array, each led by a line feed, and one at the end.

    Returns code points, their kinds, and where each text's line feed stands.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[np.minimum(cp, 65535)]
    if (far := cp > 65535).any():
        kind[far] = [1 if chr(c).isalpha() else 2 if chr(c).isalnum() else 0 for c in cp[far]]
    starts = np.zeros(len(low), np.int64)
    np.cumsum([len(t) + 1 for t in low[:-1]], out=starts[1:])
    return cp, kind, starts


MIX1, MIX2, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads close values over the whole range."""
    x = (x ^ (x >> np.uint64(32))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def words(texts: Sequence[str], kinds: np.ndarray, heads_of: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words (runs of letters, digits and _; lower case) and their text's index.

    For each length in ``heads_of`` one more array has the hashes of the words' first letters.
    """
    cp, kind, starts = code_points(texts, kinds)
    inside = kind > 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in heads_of)
    at = np.flatnonzero(inside)
    run = np.cumsum(inside[at] & ~inside[at - 1]) - 1
    pos = at - first[run]
    powers = np.ones(int(pos.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, STEP, np.uint64), out=powers[1:])
    terms = (cp[at].astype(np.uint64) + np.uint64(1)) * MIX1 * powers[pos]
    heads = np.flatnonzero(pos == 0)
    more = []
    for k in heads_of:
        near = pos < k
        more.append(mix(np.add.reduceat(terms[near], np.flatnonzero(pos[near] == 0))))
    return mix(np.add.reduceat(terms, heads)), np.searchsorted(starts, first, "right") - 1, *more


def shingles(w: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words inside each text, with the text's index.

    A text of fewer words, but one at least, has a single shingle: all of them.
    """
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= size:
        h = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            h = h * MIX2 + w[k : k + len(h)]
        same = doc[: len(h)] == doc[size - 1 :]
        out, of = mix(h[same]), doc[: len(h)][same]
    counts = np.bincount(doc, minlength=n_docs)
    if len(short := np.flatnonzero((counts > 0) & (counts < size))):
        ends = np.cumsum(counts)
        extra = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for x in w[ends[d] - counts[d] : ends[d]]:
                h = h * MIX2 + x
            extra.append(h[0] + np.uint64(counts[d]))
        out, of = np.concatenate([out, mix(np.array(extra, np.uint64))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


# ---------------------------------------------------------------- components
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, comp), comp the least node.

    Alternating large and small stars: each round is three aggregations and two
    joins over the edges, never a group gathered in one place. Rounds end when
    the edges are stars around the least nodes; what rounds make is settled in
    the shared folder, where its size lets Spark choose the joins.
    """
    rows = max(edges.count(), 1)
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    e = settle(e.distinct(), "edges", rows)
    for _ in range(max_rounds):
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = settle(both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")), "least", 2 * rows)
        if least.filter("m < x AND n > 1").isEmpty():
            kind = edges.schema["a"].dataType
            return least.select(F.col("x").cast(kind).alias("node"), F.least("x", "m").cast(kind).alias("comp"))
        # large star: every larger neighbour of x moves to the least of x and its neighbours
        to = least.select(F.col("x").alias("u"), F.least("x", "m").alias("m"))
        large = settle(e.join(to, "u").select("v", F.col("m").alias("u")).filter("v <> u").distinct(), "large", 2 * rows)
        # small star: every smaller neighbour of v, and v, move to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("s"))
        e = settle(small.select("s.v", "s.u").filter("v <> u").distinct(), "edges", 2 * rows)
    raise RuntimeError(f"components are unsettled after {max_rounds} rounds")
