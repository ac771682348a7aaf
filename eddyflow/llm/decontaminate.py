"""Operator 4, benchmark decontamination: a BM25 index of test items, block-max WAND, verification.

Test items are cut into parts of at most ``part_words`` words and indexed as
an inverted index of BM25 impacts, each part's impacts divided by the score it
gives itself. Parts stand in blocks, ordered by length, and the index keeps for
every term its largest impact in each block. Every training passage (windows
of twice ``part_words`` words, half overlapping, over the whole text) is a
query. The bound of a block is the sum of its maxima over the passage's rarer
terms plus what its frequent terms can add at most; only blocks whose bound
reaches ``retrieve`` are opened and scored exactly, and all parts above it are
candidates. An item whose words stand far apart in a document scores low in each
passage, so items of which the whole document holds ``overlap`` of the shingles
are candidates too, with the score of their best part over the whole document. A candidate item leaks if the document holds at least ``overlap`` of
its five-word shingles, and at least half of its question's (all sentences but
the last) and of its answer's (the last sentence).

The index is built of at most ``max_index_words`` words of items at a time and
sent to the executors; a larger benchmark is taken shard after shard, each
against all documents and settled before the next is built, so that the driver
holds one shard.

Defined results: null and wordless texts leak nothing; items without words are
never found; repeated items each count; an item of fewer than five words is one
shingle; rows that share a doc_id are judged alone and give their union; empty
tables leak nothing; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructType

from eddyflow.llm.common import MIX2, mix, settle, shingles, slices, text_chunks, word_table, words

K1, B = 1.2, 0.75


@dataclass
class Index:
    """Items and their parts; postings by term in rows of part and impact, and by block."""

    items: list
    shingle: list[np.ndarray]  # distinct shingles of each item
    question: list[np.ndarray]
    answer: list[np.ndarray]
    part_item: np.ndarray
    terms: np.ndarray  # sorted hashes
    rare: np.ndarray  # whether the term is essential
    part_ptr: np.ndarray
    part_of: np.ndarray
    impact: np.ndarray
    block_ptr: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    slack: np.ndarray  # of each block: most that its frequent terms can add
    block: int
    part_words: int
    grams: np.ndarray  # sorted shingles of all items
    gram_ptr: np.ndarray
    gram_item: np.ndarray


def spread(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the given rows of a compressed table, and each one's row position."""
    n = ptr[rows + 1] - ptr[rows]
    own = np.repeat(np.arange(len(rows)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[rows], n)
    return at, own


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line is the answer if there are two at least."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n", text) if re.search(r"\w", x)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def build(ids: Sequence, texts: Sequence[str | None], kinds: np.ndarray, *, part_words: int = 64, block: int = 8, frequent: float = 0.1, size: int = 5) -> Index:
    full = [t or "" for t in texts]

    def sets(of: Sequence[str]) -> list[np.ndarray]:
        h, at = shingles(*words(of, kinds), len(of), size)
        return [np.unique(x) for x in np.split(h, np.searchsorted(at, np.arange(1, len(of))))] if len(of) else []

    qa = [split_answer(t) for t in full]
    w, doc = words(full, kinds)
    first = np.searchsorted(doc, np.arange(len(full)))
    local = np.arange(len(w)) - first[doc]
    key = doc * (len(w) + 1) + local // part_words
    starts = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(w)))
    order = np.argsort(lengths, kind="stable")  # blocks hold parts of like length
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n, part = len(starts), rank[np.repeat(np.arange(len(starts)), lengths)]
    terms, term = np.unique(w, return_inverse=True)
    pair, tf = np.unique(term * max(n, 1) + part, return_counts=True)
    p_term, p_part = pair // max(n, 1), pair % max(n, 1)
    df = np.bincount(p_term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    size_of = lengths[order].astype(float) if n else np.zeros(0)
    norm = K1 * (1 - B + B * size_of / max(size_of.mean() if n else 1, 1e-9))
    impact = idf[p_term] * tf * (K1 + 1) / (tf + norm[p_part])
    impact = impact / np.maximum(np.bincount(p_part, impact, minlength=n), 1e-12)[p_part]
    rare = df <= max(1, frequent * n)
    part_ptr = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
    n_blocks = -(-n // block) if n else 0
    b_key, b_at = np.unique(p_term * max(n_blocks, 1) + p_part // block, return_inverse=True)
    block_max = np.zeros(len(b_key))
    np.maximum.at(block_max, b_at, impact)
    b_term = b_key // max(n_blocks, 1)
    easy = np.bincount(p_part[~rare[p_term]], impact[~rare[p_term]], minlength=n)
    slack = np.zeros(n_blocks)
    np.maximum.at(slack, np.arange(n) // block, easy)
    whole = sets(full)
    every = np.concatenate([*whole, np.zeros(0, np.uint64)])
    grams, times = np.unique(every, return_counts=True)
    gram_item = np.repeat(np.arange(len(whole)), [len(s) for s in whole])[np.argsort(every, kind="stable")]
    return Index(
        list(ids), whole, sets([q for q, _ in qa]), sets([a for _, a in qa]), doc[starts][order] if n else np.zeros(0, np.int64), terms, rare, part_ptr, p_part, impact,
        np.concatenate([[0], np.cumsum(np.bincount(b_term, minlength=len(terms)))]).astype(np.int64), b_key % max(n_blocks, 1), block_max, slack, block, part_words,
        grams, np.concatenate([[0], np.cumsum(times)]).astype(np.int64), gram_item,
    )


def retrieve(texts: Sequence[str], index: Index, kinds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (text, item, best score), and all words with their text, for later verification."""
    w, doc = words(texts, kinds)
    none = np.zeros(0, np.int64)
    if not len(w) or not len(index.terms):
        return none, none, np.zeros(0), w, doc
    first = np.searchsorted(doc, np.arange(len(texts)))
    chunk = (np.arange(len(w)) - first[doc]) // index.part_words
    per = np.bincount(doc, minlength=len(texts))
    n_chunks = -(-per // index.part_words)
    base = np.cumsum(n_chunks) - n_chunks
    at = np.minimum(np.searchsorted(index.terms, w), len(index.terms) - 1)
    known = index.terms[at] == w
    chunk, term = (base[doc] + chunk)[known], at[known]
    # the passage of a chunk is the chunk and the one before it in the same text
    ends = np.zeros(int(n_chunks.sum()), bool)
    ends[(base + n_chunks - 1)[n_chunks > 0]] = True
    after = ~ends[chunk]
    n_terms = len(index.terms)
    entry = np.unique(np.concatenate([chunk, chunk[after] + 1]) * n_terms + np.concatenate([term, term[after]]))
    passage, term = entry // n_terms, entry % n_terms
    n_blocks = len(index.slack)
    hard = index.rare[term]
    e, own = spread(index.block_ptr, term[hard])
    key, inverse = np.unique(passage[hard][own] * n_blocks + index.block_of[e], return_inverse=True)
    bound = np.bincount(inverse, index.block_max[e], minlength=len(key)) + index.slack[key % n_blocks]
    opened = key[bound >= least - 1e-9]
    if (index.slack >= least).any():  # blocks that frequent terms alone can open
        easy = np.flatnonzero(index.slack >= least)
        opened = np.unique(np.concatenate([opened, (np.unique(passage)[:, None] * n_blocks + easy).ravel()]))
    if not len(opened):
        return none, none, np.zeros(0), w, doc
    keep = np.isin(passage, np.unique(opened // n_blocks))
    passage, term = passage[keep], term[keep]
    e, own = spread(index.part_ptr, term)
    part = index.part_of[e]
    spot = passage[own] * n_blocks + part // index.block
    inside = opened[np.minimum(np.searchsorted(opened, spot), len(opened) - 1)] == spot
    n_parts = len(index.part_item)
    key, inverse = np.unique(passage[own][inside] * n_parts + part[inside], return_inverse=True)
    score = np.bincount(inverse, index.impact[e][inside], minlength=len(key))
    hit = score >= least - 1e-9
    text = np.searchsorted(base, key[hit] // n_parts, "right") - 1
    item = index.part_item[key[hit] % n_parts]
    pair, inverse = np.unique(text * len(index.items) + item, return_inverse=True)
    best = np.zeros(len(pair))
    np.maximum.at(best, inverse, score[hit])
    return pair // len(index.items), pair % len(index.items), best, w, doc


def held_items(w: np.ndarray, doc: np.ndarray, n: int, index: Index, overlap: float, size: int) -> np.ndarray:
    """Sorted text * items + item of all items of which a whole text holds ``overlap`` of the shingles."""
    if not len(index.grams) or not len(w):
        return np.zeros(0, np.int64)
    h, of = shingles(w, doc, n, size)
    at = np.minimum(np.searchsorted(index.grams, h), len(index.grams) - 1)
    known = index.grams[at] == h
    entry = np.unique(of[known] * len(index.grams) + at[known])  # a shingle counts once in a text
    e, own = spread(index.gram_ptr, entry % len(index.grams))
    pair, hits = np.unique(entry[own] // len(index.grams) * len(index.items) + index.gram_item[e], return_counts=True)
    sizes = np.array([len(s) for s in index.shingle])
    return pair[hits >= overlap * sizes[pair % len(index.items)] - 1e-9]


def whole_score(mine: np.ndarray, item: int, index: Index) -> float:
    """The best score of an item's parts by all words of a text."""
    at = np.minimum(np.searchsorted(index.terms, mine), len(index.terms) - 1)
    e, _ = spread(index.part_ptr, np.unique(at[index.terms[at] == mine]))
    return float(np.bincount(index.part_of[e], index.impact[e], minlength=len(index.part_item))[index.part_item == item].max())


def leaks_in(texts: Sequence[str | None], index: Index, kinds: np.ndarray, least: float, overlap: float, size: int = 5) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item, score, share of the item, of its question, of its answer) for every leak."""
    out = []
    full = [t or "" for t in texts]
    for a, b in text_chunks([len(t) for t in full]):
        text, item, score, w, doc = retrieve(full[a:b], index, kinds, least)
        apart = np.setdiff1d(held_items(w, doc, b - a, index, overlap, size), text * len(index.items) + item)
        text, item = np.append(text, apart // max(len(index.items), 1)), np.append(item, apart % max(len(index.items), 1))
        score = np.append(score, np.full(len(apart), np.nan))  # of the whole text, where the item is a leak
        for t in np.unique(text):
            mine = w[np.searchsorted(doc, t) : np.searchsorted(doc, t, "right")]
            held = np.unique(shingles(mine, np.zeros(len(mine), np.int64), 1, size)[0])
            short = {}
            for i in np.flatnonzero(text == t):
                k = item[i]
                shares = []
                for s, n_words in ((index.shingle[k], None), (index.question[k], None), (index.answer[k], None)):
                    found = np.isin(s, held, assume_unique=True).mean() if len(s) else 1.0
                    if len(s) == 1 and found < 1:  # fewer words than a shingle has: look for the run of them
                        for n in range(1, size):
                            if n not in short:
                                short[n] = np.unique(runs(mine, n))
                            if s[0] in short[n]:
                                found = 1.0
                                break
                    shares.append(float(found))
                if len(index.shingle[k]) and shares[0] >= overlap and min(shares[1:]) >= 0.5:
                    out.append((a + int(t), int(k), whole_score(mine, k, index) if np.isnan(score[i]) else float(score[i]), *shares))
    return out


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, as ``shingles`` gives a text of n words."""
    h = np.zeros(max(len(w) - n + 1, 0), np.uint64)
    for k in range(n):
        h = h * MIX2 + w[k : k + len(h)]
    return mix(h + np.uint64(n))


def shards(items: DataFrame, text: str, item: str, options: Mapping) -> list[Callable[[], Index]]:
    """What builds the index of all items, or of one shard each where they exceed ``max_index_words``."""
    options = dict(options)
    most = options.pop("max_index_words", 2_000_000)
    kinds = word_table()
    items = items.select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    n = -(-2 * total // most) if total > most else 1

    def index_of(k: int) -> Index:
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = sorted(((r.i, r.t) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        return build([r[0] for r in rows], [r[1] for r in rows], kinds, **options)

    return [partial(index_of, k) for k in range(n)]


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", least: float = 0.6, overlap: float = 0.8, **options) -> DataFrame:
    """Rows (key, item, score, overlap, question_overlap, answer_overlap), one for each leaked item of a document."""
    kinds, docs = word_table(), docs.select(key, text)
    schema = StructType([docs.schema[key]]).add(item, items.schema[item].dataType)
    for name in ("score", "overlap", "question_overlap", "answer_overlap"):
        schema.add(name, DoubleType())
    item_type = to_arrow_type(items.schema[item].dataType)

    def against(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = leaks_in(batch.column(1).to_pylist(), index, kinds, least, overlap)
                ids = batch.column(0).take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[r[1]] for r in found], item_type), *(pa.array([r[j] for r in found], pa.float64()) for j in range(2, 6))], names=schema.names)

        return docs.mapInArrow(run, schema)

    found = shards(items, text, item, options)
    if len(found) == 1:
        return against(found[0]())
    return reduce(DataFrame.unionAll, [settle(against(shard()), "leaks") for shard in found])


def without_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", least: float = 0.6, overlap: float = 0.8, **options) -> DataFrame:
    """``docs`` without the rows that hold a test item, dropped where they are read: nothing is shuffled."""
    kinds = word_table()

    def clean(docs: DataFrame, index: Index) -> DataFrame:
        where = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in leaks_in(batch.column(where).to_pylist(), index, kinds, least, overlap)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    found = shards(items, text, item, options)
    if len(found) == 1:
        return clean(docs, found[0]())
    return reduce(lambda rest, shard: settle(clean(rest, shard()), "clean"), found, docs)
