"""Operator 2, toxicity: weak supervision by many voters, and a linear classifier.

Lexicon voters look for abusive words by category, and for words and word heads
that labelled rows show to be abusive (mined lexicons, each length a voter of its
own); pattern voters look at density, spread over categories, shouting, marks,
address, masked and stretched words. Each votes toxic, clean or abstains. A
generative label model with one latent label estimates by expectation-maximisation
how often each voter votes what under either label, and how voters hang together:
the votes form a tree of dependence (the spanning tree of most mutual information
beyond the label), and a voter's table is given its label and its parent's vote, so
that one who repeats another adds no evidence. The posterior labels train a linear
classifier (logistic regression on word counts by hash and on the voters'
measures) that scores every text. Known labels set the prior and the mined
lexicons, nothing else; no row's own label has a say in its votes.

Only a bounded sample of labelled rows (``max_rows``, ``max_chars``) is read
for fitting, the same at every run; every text is scored as a whole. Defined
results: null and empty texts are scored like a text without words; repeated rows
score alike; without any label of both kinds the model uses the fixed lexicons
with an even prior; an empty table gives no row; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyflow.llm.common import bounded_sample, fold, slices, text_chunks, word_table, words

# Fixed lexicons, by category.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile clown loser losers fool fools stupid dumb dunce jerk jerks coward pig swine dimwit halfwit nitwit brainless clueless dummkopf trottel vollidiot depp blödmann imbécile crétin débile abruti idiota imbécil estúpido idiote tonto bobo",
    "contempt": "worthless pathetic disgusting trash scum garbage vermin filth filthy despicable subhuman parasite parasites useless revolting repulsive wertlos erbärmlich abschaum widerlich minable ordure pitoyable dégoûtant basura escoria patético despreciable asqueroso",
    "hate": "hateful hate nazi inferior exterminate deport lynch savages degenerate degenerates untermensch",
    "threat": "murder murdered strangle strangled slaughter kill umbringen töten abschlachten égorger massacrer asesinar matar",
    "profanity": "fuck fucking fucked shit shitty bitch bastard asshole crap damn bullshit arschloch scheiße scheisse fotze merde connard salope putain mierda puta cabrón gilipollas",
}
# Fixed words that speak to somebody.
ADDRESS = "you your yours du dich dir dein deine euch tu te ton ta tes vous votre ti tú usted vosotros"
#: Letters hidden by marks, and letters stretched.
MASKED = re.compile(r"(?<![\w*@#$])[A-Za-z]{1,3}[*@#$]{1,4}[A-Za-z]{0,4}(?![\w*@#$])")
STRETCHED = re.compile(r"([A-Za-z])\1{3}")
BITS, HEADS = 15, (4, 5)
FIXED, MINED = len(LEXICONS), 1 + len(HEADS)


@cache
def capitals() -> np.ndarray:
    """For every code point of the basic plane: 2 for upper case letters, 1 for other letters, else 0."""
    kinds = map(unicodedata.category, map(chr, range(65536)))
    return np.array([2 if k == "Lu" else 1 if k[0] == "L" else 0 for k in kinds], np.uint8)


def shouting(texts: Sequence[str]) -> np.ndarray:
    """Share of upper case among the letters of each text."""
    cp = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = capitals()[np.minimum(cp, 65535)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]])]).astype(np.int64)
    return np.add.reduceat(kind == 2, starts, dtype=np.int64) / np.maximum(np.add.reduceat(kind > 0, starts, dtype=np.int64), 1)


def hashes(text: str, kinds: np.ndarray) -> np.ndarray:
    return np.unique(words([text], kinds)[0])


@dataclass
class ToxicityModel:
    lexicons: list[np.ndarray]  # sorted hashes: words of the fixed ones, of address, mined words and mined heads by length
    weights: np.ndarray
    dense: np.ndarray
    bias: float
    scale: float
    shift: float
    accuracies: np.ndarray
    shares: np.ndarray


def measures(texts: Sequence[str | None], lexicons: Sequence[np.ndarray], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: hits by lexicon, hits by any mined one, shares of shouted letters and of marks, masked and stretched words, word count.

    Also the word counts alone, and hashed words and word heads with their text.
    """
    full = [t or "" for t in texts]
    w, doc, *heads = words(full, kinds, HEADS)
    n = np.bincount(doc, minlength=len(full)).astype(float)
    within = [np.isin(w, x) for x in lexicons[: FIXED + 2]] + [np.isin(h, x) for h, x in zip(heads, lexicons[FIXED + 2 :], strict=True)]
    within.append(np.any(within[FIXED + 1 :], axis=0))
    hits = np.stack([np.bincount(doc[x], minlength=len(full)) for x in within], axis=1).astype(float)
    signs = np.array([(t.count("!") / max(len(t), 1), sum(1 for _ in MASKED.finditer(t)) if "*" in t or "@" in t or "#" in t or "$" in t else 0, STRETCHED.search(t) is not None) for t in full], float).reshape(-1, 3)
    return np.column_stack([hits, shouting(full), signs, n]), n, np.concatenate([w, heads[0]]), np.concatenate([doc, doc])


def columns(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """The measures by name: hits of fixed lexicons, address, mined ones, any mined one; upper, marks, masked, stretched, n."""
    k = FIXED + 1 + MINED
    return m[:, :FIXED], m[:, FIXED], m[:, FIXED + 1 : k], m[:, k], *(m[:, k + 1 + j] for j in range(5))


def said_often(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a text has mined terms twice, or one among few words: one in a long text is likely chance."""
    return (hits >= 2) | (hits >= 0.01 * np.maximum(n, 1)[:, None]) & (hits > 0)


def votes(m: np.ndarray) -> np.ndarray:
    """1 toxic, 0 clean, -1 abstains; one column for each voter."""
    fixed, address, mined, any_mined, upper, marks, masked, stretched, n = columns(m)
    words_ = np.maximum(n, 1)
    told, learned = fixed.sum(axis=1), any_mined
    either = np.maximum(told, learned)
    often = said_often(mined, n)
    yes = lambda c: np.where(c, 1, -1)
    cols = [yes(fixed[:, j] > 0) for j in range(FIXED)] + [yes(often[:, j]) for j in range(MINED)]
    cols += [
        np.where(told / words_ >= 0.005, 1, np.where(told == 0, -1, 0)), np.where(learned / words_ >= 0.005, 1, np.where(learned == 0, -1, 0)), np.where(either / words_ >= 0.02, 1, np.where(either == 0, 0, -1)),
        np.where(told >= 2, 1, -1), np.where(learned >= 2, 1, np.where(learned == 0, 0, -1)), np.where(either == 0, 0, -1), np.where((told == 0) & (n >= 200), 0, -1), np.where(often.sum(axis=1) >= 2, 1, np.where(learned == 0, 0, -1)), np.where((learned == 1) & (told == 0) & (n >= 60), 0, -1),
        yes((fixed > 0).sum(axis=1) >= 2), yes((fixed > 0).sum(axis=1) >= 3), yes((either > 0) & (address > 0)), np.where((address == 0) & (either == 0), 0, -1),
        yes((upper > 0.7) & (marks > 0.01) & (either > 0)), yes((marks > 0.02) & (either > 0)), yes((masked > 0) & (either > 0)), yes((stretched > 0) & (either > 0)), np.where((marks == 0) & (upper < 0.2) & (either == 0), 0, -1),
    ]
    return np.stack(cols, axis=1)


def dependence(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters beyond the label, as a share of their entropies beyond it."""
    k = v.shape[1]
    one = np.concatenate([v == c for c in (-1, 0, 1)], axis=1).astype(float)  # columns by vote, then voter
    info, entropy = np.zeros((k, k)), np.zeros(k)
    for q in (1 - p, p):
        joint = ((one * q[:, None]).T @ one / max(len(v), 1)).reshape(3, k, 3, k) + 1e-12
        single = (q @ one / max(len(v), 1)).reshape(3, k) + 1e-12
        mass = q.sum() / max(len(v), 1) + 1e-12
        info += (joint * np.log(joint * mass / (single[:, :, None, None] * single[None, None]))).sum(axis=(0, 2))
        entropy -= (single * np.log(single / mass)).sum(axis=0)
    out = np.clip(info / np.sqrt(np.maximum(np.outer(entropy, entropy), 1e-9)), 0, 1)
    out[entropy < 1e-6] = out[:, entropy < 1e-6] = 0
    np.fill_diagonal(out, 0)
    return out


def tree(weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(voter, parent or -1) in an order that has parents first: the heaviest spanning forest of edges over ``least``."""
    k, out, done = len(weight), [], set()
    while len(done) < k:
        best = max(((weight[i, j], -j, -i) for i in done for j in range(k) if j not in done), default=(0, 0, 0))
        j, parent = (-best[1], -best[2]) if best[0] >= least else (min(set(range(k)) - done), -1)
        out.append((j, parent))
        done.add(j)
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 40, least: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the latent label for each row of votes; accuracy and share of each voter.

    The start is the balance of votes. Each round estimates which voters hang together
    beyond the label, then each one's table of votes given the label and its
    parent's vote, then the labels. A voter's share is what it says that its
    neighbours in the tree do not.
    """
    n, k = v.shape
    # voters that say the same start with one voice
    voices = 1 / (1 + (dependence(v, np.full(n, prior)) >= 0.999).sum(axis=1))
    balance = (v == 1) @ voices - (v == 0) @ voices
    p = np.where(balance > 0, 0.9, np.where(balance < 0, 0.05, prior))
    share, code = np.ones(k), v + 1
    for _ in range(rounds):
        weight = dependence(v, p)
        order = tree(weight, least)
        near = np.zeros(k)
        z = np.full(n, np.log(prior / (1 - prior)))
        for j, parent in order:
            given = code[:, parent] if parent >= 0 else np.zeros(n, np.int64)
            if parent >= 0:
                near[[j, parent]] += weight[j, parent]
            cell = given * 3 + code[:, j]
            logs = []
            for q in (1 - p, p):
                own = np.bincount(code[:, j], q, 3) + 0.5
                # where a parent's vote is rare the table leans on the voter's own
                table = (np.bincount(cell, q, 9).reshape(3, 3) + own / own.sum()) if parent >= 0 else np.tile(own, (3, 1))
                logs.append(np.log(table / table.sum(axis=1, keepdims=True)).ravel()[cell])
            z += logs[1] - logs[0]
        share = 1 / (1 + near)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-5:
            p = new
            break
        p = new
    said = v >= 0
    accuracy = ((v == 1) * p[:, None] + (v == 0) * (1 - p)[:, None]).sum(axis=0) / np.maximum(said.sum(axis=0), 1)
    return p, accuracy, share


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # terms, texts of label 1 and of label 0 that have them


def merged(parts: Sequence[Counts]) -> Counts:
    """Counts by term, summed."""
    terms, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return terms, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(terms)).astype(np.int64) for k in (1, 2))


def counted(texts: Sequence[str], y: np.ndarray, kinds: np.ndarray) -> list[Counts]:
    """Counts of words, and of word heads of each length."""
    parts: list[list[Counts]] = [[(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in range(MINED)]
    for a, b in text_chunks([len(t) for t in texts]):
        w, doc, *heads = words(texts[a:b], kinds, HEADS)
        for j, x in enumerate([w, *heads]):
            terms, term = np.unique(x, return_inverse=True)
            seen = np.unique(term * (b - a) + doc)
            toxic = y[a + seen % (b - a)] == 1
            parts[j].append((terms, np.bincount(seen[toxic] // (b - a), minlength=len(terms)), np.bincount(seen[~toxic] // (b - a), minlength=len(terms))))
            if len(parts[j]) > 8:
                parts[j] = [merged(parts[j])]
    return [merged(x) for x in parts]


def mined_lexicons(parts: Sequence[list[Counts]], y: np.ndarray, ratio: float = 40.0) -> list[np.ndarray]:
    """Words, and word heads of each length, in several toxic texts whose odds there exceed ``ratio`` times those in clean texts."""
    if not 0 < y.sum() < len(y):
        return [np.zeros(0, np.uint64)] * MINED
    out = []
    for j in range(MINED):
        terms, pos, neg = merged([x[j] for x in parts])
        odds = ((pos + 0.5) / (y.sum() + 1)) / ((neg + 0.5) / ((1 - y).sum() + 1))
        out.append(terms[(pos >= np.clip(0.01 * y.sum(), 4, 8)) & (odds >= ratio)])
    return out


def inputs(m: np.ndarray) -> np.ndarray:
    """The dense inputs of the classifier."""
    fixed, address, mined, any_mined, upper, marks, masked, stretched, n = columns(m)
    hits, n = np.column_stack([fixed, any_mined]), np.maximum(n, 1)
    some = np.column_stack([np.log1p(hits), 20 * hits / n[:, None], hits > 0, said_often(mined, n), hits.max(axis=1) > 1, upper, np.minimum(10 * marks, 1), (address > 0) & (hits.max(axis=1) > 0)])
    return some.astype(float)


def train(texts: Sequence[str], labels: Sequence[int], *, epochs: int = 30, rate: float = 0.5, seed: int = 3, folds: int = 5) -> ToxicityModel:
    """Fit on labelled texts. What mined lexicons say of a text is learned from the other folds, so that its own label has no say in its votes."""
    kinds, y = word_table(), np.array(labels, np.int64)
    fixed = [hashes(x, kinds) for x in (*LEXICONS.values(), ADDRESS)]
    if not len(texts):
        return ToxicityModel([*fixed, *mined_lexicons([], y)], np.zeros(1 << BITS), np.concatenate([np.ones(FIXED + 1), np.zeros(2 * FIXED + 2 + MINED + 4)]), -1.0, 4.0, 0.0, np.zeros(0), np.zeros(0))
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    # rows by fold, one fold after another
    order = np.argsort(np.arange(len(texts)) % folds, kind="stable")
    texts, y = [texts[i] for i in order], y[order]
    ends = np.cumsum(np.bincount(np.arange(len(texts)) % folds, minlength=folds))
    spans = [slice(e - n, e) for e, n in zip(ends, np.diff(ends, prepend=0), strict=True)]
    parts = [counted(texts[x], y[x], kinds) for x in spans]
    lexicons = [*fixed, *mined_lexicons(parts, y)]
    # features of a chunk of texts at a time: the slots of a text's words, each once, with its weight
    m, slots, values, first = [], [], [], [0]
    for f, span in enumerate(spans):
        others = [*fixed, *mined_lexicons(parts[:f] + parts[f + 1 :], np.delete(y, np.arange(span.start, span.stop)))]
        own_texts = texts[span]
        for a, b in text_chunks([len(t) for t in own_texts]):
            own, n, w, doc = measures(own_texts[a:b], others, kinds)
            m.append(own)
            key, times = np.unique(doc << BITS | (w >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
            slots.append((key & ((1 << BITS) - 1)).astype(np.int32))
            values.append((times / np.sqrt(np.maximum(n, 1))[key >> BITS]).astype(np.float32))
            first += (first[-1] + np.searchsorted(key >> BITS, np.arange(1, b - a + 1))).tolist()
    m, slot, value, first = np.concatenate(m), np.concatenate(slots), np.concatenate(values), np.array(first)
    v = votes(m)
    p, accuracy, share = label_model(v, prior)
    dense = inputs(m)
    rng, weights, dw, bias = np.random.default_rng(seed), np.zeros(1 << BITS), np.zeros(dense.shape[1]), float(np.log(prior / (1 - prior)))
    for epoch in range(epochs):
        step = rate / (1 + 0.2 * epoch)
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in rows])
            own = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            z = np.bincount(own, weights[slot[at]] * value[at], len(rows)) + dense[rows] @ dw + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p[rows]) / len(rows)
            np.add.at(weights, slot[at], -step * g[own] * value[at])
            weights *= 1 - step * 2e-3
            dw -= step * (dense[rows].T @ g)
            bias -= step * g.sum()
    return ToxicityModel(lexicons, weights, dw, bias, 1.0, 0.0, accuracy, share)


def logits(texts: Sequence[str | None], model: ToxicityModel, kinds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    full = [t or "" for t in texts]
    for a, b in text_chunks([len(t) for t in full]):
        m, n, w, doc = measures(full[a:b], model.lexicons, kinds)
        slot = (w >> np.uint64(64 - BITS)).astype(np.int64)
        out[a:b] = np.bincount(doc, model.weights[slot], b - a) / np.sqrt(np.maximum(n, 1)) + inputs(m) @ model.dense + model.bias
    return out


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", held_fold: int = 2, folds: int = 4, max_rows: int = 6000, max_chars: int = 16_000_000, **options) -> ToxicityModel:
    """Train on at most ``max_rows`` labelled documents (and ``max_chars``) outside the held fold.

    Labels are sampled first, so that a bounded set of keys goes to the documents.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold(key, folds) != held_fold)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y")).filter("k IS NOT NULL")
    share = min(1.0, max_rows / max(known.count(), 1))
    if share < 1.0:
        known = known.filter(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) < int(share * 0.97 * (1 << 30)))
    known = known.orderBy(F.xxhash64("k", F.lit(17)), "k").limit(max_rows)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = bounded_sample(rows.join(F.broadcast(known), "k"), "k", "t", max_rows, max_chars, salt=18)
    got = sorted(((r.k, r.t, int(r.y > 0)) for r in sample.toLocalIterator()))
    return train([r[1] for r in got], [r[2] for r in got], **options)


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", limit: float = 0.3) -> DataFrame:
    """Rows (key, score, predicted) for every document."""
    kinds = word_table()
    schema = StructType([docs.schema[key]]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = logits(batch.column(1).to_pylist(), model, kinds)
            p = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= limit).astype(np.int32))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """Fit on the labelled rows and score every document: key, held_out, score, predicted."""
    model = fit(docs, labels, key=key, **options)
    return score(docs, model, key=key).select(key, (fold(key, 4) == 2).alias("held_out"), "score", "predicted")
