"""Toxicity: a linear classifier with a counterfactual penalty.

Words that separate the labels best are its features, and all identity terms, seen or
not. Of each labelled sentence with an identity term others are made, in which the term
is swapped for each other one of its kind and for none; the squared change of the score
(before the logistic function) is penalised, with the sentence's own weight. So a
group's mere mention has next to no weight, however the labels fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _powers, portions, text_bytes
from .common import bucket_of, cut, map_arrow, text_of
from .langid import folded

#: Identity terms by the kind within which they are swapped.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "americans", "mexicans", "chinese"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "schwule", "lesben"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "noirs", "blancs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "negros", "blancos"),
)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text) of each word: a run of letters, capitals lowered."""
    x = folded(data)
    letter = (x >= 0x61) & (x <= 0x7A) | (x >= 0x80)
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    edges = offsets[(offsets > 0) & (offsets < len(x))]
    begins[edges] = letter[edges]
    ends[edges - 1] = letter[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverses = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x.astype(np.uint64) * powers[1 : len(x) + 1], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * inverses[starts] ^ ((stops - starts).astype(np.uint64) << np.uint64(52))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        logit = np.full(n, self.bias)
        if len(self.words) and len(data):
            hashes, doc = word_hashes(data, offsets)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            pairs = np.unique(doc[hit] * len(self.words) + at[hit])  # a word counts once in a text
            logit += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def counterfactuals(words: np.ndarray, doc: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences that come of swapping: (text, feature that goes, feature that comes or
    -1, share of this sentence among those of one text and term). ``doc`` and ``col`` are the
    features of the texts. A term that the text has already, or none, adds nothing. The
    sentence with none has half of the share: it alone holds a whole kind of terms down."""
    place = {int(h): i for i, h in enumerate(words)}
    has = set(zip(doc.tolist(), col.tolist()))
    made = []
    for group in IDENTITY_TERMS:
        own = [place[hash_of(t)] for t in group]
        for text, out in zip(*(x[np.isin(col, own)].tolist() for x in (doc, col))):
            come = [-1 if (text, t) in has else t for t in own if t != out] + [-1]
            made += [(text, out, t, 0.5 / (len(come) - 1) if i < len(come) - 1 else 0.5) for i, t in enumerate(come)]
    text, out, come, share = zip(*made) if made else ((),) * 4
    return np.array(text, int), np.array(out, int), np.array(come, int), np.array(share, float)


def train(texts: list[np.ndarray], labels: np.ndarray, features: int = 2048, ridge: float = 2e-3, fairness: float = 5.0, rounds: int = 300) -> ToxicityModel:
    """``texts``: each text's distinct word hashes. Features are the words with the largest
    chi-square against the labels among those of at least four texts, and every identity
    term. ``fairness`` weighs the squared score change of the counterfactual sentences."""
    n, toxic = len(labels), labels.astype(bool)
    base = float(np.clip(toxic.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    if not n or toxic.all() or not toxic.any():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), bias)
    terms = np.unique(np.array([hash_of(t) for g in IDENTITY_TERMS for t in g], np.uint64))
    flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(n), [len(t) for t in texts])
    words, at = np.unique(np.concatenate([flat, terms]), return_inverse=True)
    at = at[: len(flat)]
    df = np.bincount(at, minlength=len(words)).astype(np.float64)
    hits = np.bincount(at, toxic[doc].astype(np.float64), minlength=len(words))
    n1 = toxic.sum()
    a, b, c, d = hits, df - hits, n1 - hits, n - n1 - (df - hits)
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)
    identity = np.isin(words, terms)
    chosen = np.flatnonzero((df >= 4) & (chi >= 15) | identity)
    chosen = np.sort(chosen[np.argsort(-np.where(identity[chosen], np.inf, chi[chosen]), kind="stable")[: max(features, len(terms))]])
    words, slot = words[chosen], np.full(len(words), -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[at] >= 0
    doc, col = doc[keep], slot[at][keep]
    y = toxic.astype(np.float64)
    weight = np.where(toxic, 0.5 / n1, 0.5 / (n - n1))
    text, out, come, share = counterfactuals(words, doc, col)
    kinds, same = np.unique(out * (len(words) + 1) + come + 1, return_inverse=True)  # sentences with the same change
    out, come, pull = kinds // (len(words) + 1), kinds % (len(words) + 1) - 1, 2 * fairness * np.bincount(same, weight[text] * share, minlength=len(kinds))
    real = come >= 0
    w, b0, m, v = np.zeros(len(words)), bias, np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for i in range(1, rounds + 1):
        logit = b0 + np.bincount(doc, w[col], minlength=n)
        slope = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        g = np.bincount(col, slope[doc], minlength=len(words)) + ridge * w / max(1.0, len(words) ** 0.5)
        change = pull * (w[out] - np.where(real, w[come], 0.0))
        g += np.bincount(out, change, minlength=len(words)) - np.bincount(come[real], change[real], minlength=len(words))
        g = np.r_[g, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, b0 = w - move[:-1], b0 - move[-1]
    return ToxicityModel(words, w, float(b0))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in portions(offsets):
            hashes, doc = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8000) -> ToxicityModel:
    """A model of the labelled rows: of the different ids and labels (0 or 1), those with the
    least hashes, ``most_rows`` at most; of their different texts again as many by a hash of
    the text, however often ids or texts are repeated. They come to the driver as their
    distinct words. Null text is empty; without rows of both labels the score is the same
    for all texts."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()

    def thinned(rows: DataFrame, number: int, key: Column) -> DataFrame:  # about most_rows of them, so that few are ordered
        return rows.where(F.pmod(key, F.lit(1 << 30)) < 1.2 * most_rows / max(1, number) * float(1 << 30))

    order = F.xxhash64("doc_id", "toxic", F.lit(7))
    drawn = cut(thinned(known, known.count(), order).orderBy(order, "doc_id", "toxic").limit(most_rows))
    rows = F.broadcast(drawn).join(docs.select("doc_id", "text"), "doc_id")  # most_rows ids are sent
    by_text = F.xxhash64("text", "toxic")
    rows = thinned(rows, docs.select("doc_id").join(F.broadcast(drawn), "doc_id").count(), by_text)
    found = map_arrow(text_of(rows, "toxic"), _words_of, "toxic int, words binary").distinct()
    taken = found.orderBy(F.xxhash64("words"), "toxic", "words").limit(most_rows).collect()
    return train([np.frombuffer(bytes(r["words"]), np.uint64) for r in taken], np.array([r["toxic"] for r in taken], int))


def _scored(model: ToxicityModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        for i, j in portions(offsets):
            scores = model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            kept = [c.slice(i, j - i) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score and predicted of every row; null text is empty text, and
    empty text has the score of the bias. Repeated rows stay; an empty table gives none."""
    kinds = dict(docs.dtypes)
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(text_of(docs, *keep), partial(_scored, model), f"{columns}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5, most_rows: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model that learnt no label
    of the held-out bucket. A null doc_id is in no bucket."""
    model = fit(docs, labels.where(bucket_of(F.col("doc_id"), modulus) != held_out), most_rows)
    bucket = bucket_of(F.col("doc_id"), modulus)
    return score(docs, model).select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
