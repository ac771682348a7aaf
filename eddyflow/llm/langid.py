"""Operator 6, language ID: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of one to four code points inside a word, where the blank on
either side of a word counts as a code point of it. Each subword is hashed to a
row of an embedding table; a text is the mean of its rows, and a linear softmax
over that mean gives the languages. Both layers are trained together by
stochastic gradient descent in numpy on windows of words from a bounded sample
of labelled documents. On sample documents that training did not see, a
temperature is calibrated on windows of few words, and a rejection limit on how
familiar a text's subwords are (the mean of how strongly each speaks for some
language): the limit is what all but ``reject_error`` of known texts reach, whole
ones, short windows and mixtures of two languages; how many foreign texts (known
ones under a cipher of their letters) stay under it is measured with it.

Defined results: a null text, or one without any letter, is ``und`` with score
0 and rejected; very long texts are read whole, in pieces that end at white space
(or after ``PIECE`` code points without any); repeated rows get equal results; with
no labelled row at all every text is ``und``; an empty table gives no row; columns
of any name pass through, but those of the results' names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyflow.llm.common import MIX1, MIX2, bounded_sample, code_points, fold, slices, text_chunks, word_table

UND = "und"
PIECE = 200_000


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding table times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float  # of the mean familiarity
    bits: int
    foreign_caught: float = 0.0  # share of enciphered texts under it

    def __post_init__(self) -> None:
        self.familiar = np.abs(self.table - self.table.mean(axis=1, keepdims=True)).max(axis=1)


def subwords(texts: Sequence[str], kinds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every subword, its text's index, and for each text whether it has a letter."""
    cp, kind, starts = code_points(texts, kinds)
    letter = kind == 1
    code = np.where(letter, cp, 32).astype(np.uint64) + np.uint64(1)
    has = np.add.reduceat(letter, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    buckets, of = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 5):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * MIX2 + code[n - 1 : n - 1 + m]
        # inner code points are letters, and at least one letter is inside
        ok = letter[:m] | letter[n - 1 :]
        for k in range(1, n - 1):
            ok &= letter[k : k + m]
        if n == 1:
            ok = letter
        at = np.flatnonzero(ok)
        x = (h[at] + np.uint64(n)) * MIX1
        buckets.append((x >> np.uint64(64 - bits)).astype(np.int32))
        of.append(at)
    at = np.concatenate(of)
    order = np.argsort(at, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(starts, at[order], "right") - 1, has


def means(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Mean of the rows of each text; zeros where a text has none."""
    counts = np.bincount(of, minlength=n)
    out = np.zeros((n, values.shape[1]), np.float64)
    if len(of):
        full = np.flatnonzero(counts)
        heads = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        out[full] = np.add.reduceat(values, heads, axis=0) / counts[full, None]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: Sequence[str], labels: Sequence[str], *, bits: int = 15, dim: int = 12, window: int = 24,
    max_windows: int = 16_000, epochs: int = 4, rate: float = 4.0, batch: int = 64, seed: int = 5, reject_error: float = 0.001, margin: float = 0.9,
) -> LanguageModel | None:
    """Fit on labelled texts; every fifth document is kept for calibration.

    ``max_windows`` bounds the training windows (drawn evenly over documents).
    """
    kinds, rng = word_table(), np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return None
    y_doc = np.array([languages.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 25 else np.zeros(len(texts), bool)
    pieces, y = [], []
    for i in np.flatnonzero(~held):
        w = texts[i].split()
        for k in range(0, max(len(w), 1), window):
            if piece := " ".join(w[k : k + window]):
                pieces.append(piece)
                y.append(y_doc[i])
    keep = rng.permutation(len(pieces))[:max_windows]
    pieces, y = [pieces[i] for i in keep], np.array(y, np.int64)[keep]
    n_lang = len(languages)
    emb = rng.normal(0, 0.1, (1 << bits, dim))
    out, bias = np.zeros((dim, n_lang)), np.zeros(n_lang)
    weight = 1 / np.maximum(np.bincount(y, minlength=n_lang), 1)
    weight *= n_lang / max((weight > 0).sum(), 1) * len(y) / n_lang
    for epoch in range(epochs):
        order = rng.permutation(len(pieces))
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            b, of, _ = subwords([pieces[i] for i in at], kinds, bits)
            mean = means(emb[b], of, len(at))
            g = softmax(mean @ out + bias)
            g[np.arange(len(at)), y[at]] -= 1
            g *= np.minimum(weight[y[at]], 4)[:, None] / len(at)
            back = (g @ out.T) / np.maximum(np.bincount(of, minlength=len(at)), 1)[:, None]
            out -= step * mean.T @ g
            bias -= step * g.sum(axis=0)
            grad = np.stack([np.bincount(b, back[of, d], 1 << bits) for d in range(dim)], axis=1)
            emb -= step * 20 * grad
    model = LanguageModel(languages, (emb @ out).astype(np.float32), bias, 1.0, 0.0, bits)
    check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    calibrate(model, [texts[i] for i in check], y_doc[check], kinds, rng, reject_error, margin)
    return model


def calibrate(model: LanguageModel, texts: Sequence[str], y: np.ndarray, kinds: np.ndarray, rng: np.random.Generator, reject_error: float, margin: float) -> None:
    """Set the temperature on windows of five words, and the rejection limit on known texts; measure it on foreign ones."""
    parts = [t.split() for t in texts]
    short = [" ".join(w[len(w) // 2 : len(w) // 2 + 5]) for w in parts]
    z, _, has = judged(short, model, kinds)
    z, truth = z[has], y[has]
    if not len(z):
        return
    grid = np.geomspace(0.1, 4, 24)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    other = rng.permutation(len(parts))
    mixed = [" ".join(a[: min(len(a), len(b))] + b[: min(len(a), len(b))]) for a, b in ((parts[i], parts[j]) for i, j in enumerate(other) if y[i] != y[j])]
    known = np.concatenate([familiar[has] for _, familiar, has in (judged(part, model, kinds) for part in (texts, short, mixed))])
    letters = [chr(c) for c in range(97, 123)]
    foreign = [t.lower().translate(dict(zip(range(97, 123), rng.permutation(letters), strict=True))) for t in texts]
    _, strange, has = judged(foreign, model, kinds)
    model.reject_below = margin * float(np.quantile(known, reject_error))
    model.foreign_caught = float((strange[has] < model.reject_below).mean()) if has.any() else 0.0


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most PIECE code points that end at white space, where there is any."""
    a = 0
    while len(text) - a > PIECE:
        cut = max(text.rfind(" ", a, a + PIECE), text.rfind("\n", a, a + PIECE))
        b = cut + 1 if cut >= a else a + PIECE
        yield text[a:b]
        a = b
    yield text[a:]


def judged(texts: Sequence[str | None], model: LanguageModel, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits and familiarity of each text, and whether it has a letter; whole texts, a chunk of pieces at a time."""
    n, k = len(texts), len(model.languages)
    total, count, has = np.zeros((n, k + 1)), np.zeros(n), np.zeros(n, bool)
    own = [(i, x) for i, t in enumerate(texts) for x in pieces(t or "")]
    values = np.column_stack([model.table, model.familiar]).astype(np.float64)
    for a, b in text_chunks([len(x) for _, x in own]):
        buckets, of, some = subwords([x for _, x in own[a:b]], kinds, model.bits)
        at, m = np.array([i for i, _ in own[a:b]]), np.bincount(of, minlength=b - a)
        np.add.at(total, at, means(values[buckets], of, b - a) * m[:, None])
        np.add.at(count, at, m)
        np.logical_or.at(has, at, some)
    mean = total / np.maximum(count, 1)[:, None]
    return mean[:, :k] + model.bias, mean[:, k], has


def predict(texts: Sequence[str | None], model: LanguageModel | None, kinds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether it is rejected."""
    if model is None:
        return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    z, familiar, has = judged(texts, model, kinds)
    p = softmax(z / model.temperature)
    lang = [model.languages[k] if some else UND for k, some in zip(p.argmax(axis=1), has, strict=True)]
    return lang, np.where(has, p.max(axis=1), 0.0), ~has | (familiar < model.reject_below)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", held_fold: int = 0, folds: int = 5, max_docs: int = 2500, max_chars: int = 8_000_000, **options) -> LanguageModel | None:
    """Train on at most ``max_docs`` labelled documents (and ``max_chars``) outside the held fold."""
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (fold(key, folds) != held_fold)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))
    rows = sorted(((r.k, r.l, r.t) for r in bounded_sample(known, "k", "t", max_docs, max_chars).toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return train([r[2] for r in rows], [r[1] for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is rejected.

    Result columns replace columns of the same names.
    """
    docs = docs.drop(lang, score, rejected)
    kinds, where = word_table(), docs.columns.index(text)
    schema = StructType(list(docs.schema.fields)).add(lang, "string").add(score, "double").add(rejected, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores, low = predict(batch.column(where).to_pylist(), model, kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Fit on ``docs`` and label them all: key, held_out, lang_pred, score, rejected."""
    model = fit(docs, key=key, **options)
    return identify(docs.select(key, "text"), model).select(key, (fold(key, 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
