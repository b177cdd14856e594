"""Language-model scores by a log-bilinear neural model.

Words are in classes: each of the most frequent words is one (four times the cube root of
the vocabulary's size of them, so more in larger corpora), and every other word, seen or
not, belongs to one by its form (letters of a language, case, marks around it, length).
A log-bilinear model predicts a token's class from the classes of the two before it: the
context's vectors are combined linearly, and a class's score is the inner product with
its own vector plus a bias. It is trained in numpy by noise-contrastive estimation on the
counts of all class triples of the training texts, in tasks that each hold a part of
them; the weights are averaged after each round. Batched matrix products give normalised
log-probabilities for the contexts that occur. Within a class a word has its discounted
share of the class's count; what is discounted goes to unseen words, each by a bigram
model of bytes, learnt from the spelling of all different words. So a token's
probabilities over all words, known or not, sum to one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _powers, portions, ragged, text_bytes
from .common import bucket_of, cut, map_arrow, text_of

FORMS = 96  # classes of other words: alphabet (4) x case (2) x mark (6) x length (2)


def own_classes(types: int) -> int:
    """How many words have a class of their own, of so many different ones."""
    return min(types, math.ceil(4 * types ** (1 / 3)))


def classes_of(own: int) -> int:
    """With the forms and, last, the end of a text, which also stands before its start."""
    return own + FORMS + 1


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, starts, lengths, number for each text) of the words."""
    x = data + ((data >= 0x41) & (data <= 0x5A)).view(np.uint8) * np.uint8(32)
    dark = (x != 0x20) & ((x < 0x09) | (x > 0x0D))
    begins, ends = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1]
    ends[:-1] &= ~dark[1:]
    edges = offsets[(offsets > 0) & (offsets < len(x))]
    begins[edges] = dark[edges]
    ends[edges - 1] = dark[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return x, starts, lengths, np.diff(np.searchsorted(starts, offsets))


def hashes_of(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x.astype(np.uint64) * powers[1 : len(x) + 1], out=sums[1:])
    return (sums[starts + lengths] - sums[starts]) * inverses[starts] ^ (lengths.astype(np.uint64) << np.uint64(48))


def forms_of(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The form of each word, 0 to FORMS - 1."""
    if not len(starts):
        return np.zeros(0, np.int64)
    flat = x[ragged(starts, lengths)]
    heads = np.r_[0, np.cumsum(lengths)][:-1]
    has = lambda mask: np.add.reduceat(mask, heads, dtype=np.int64) > 0
    tail = np.r_[flat[1:], np.uint8(0)]
    c3 = flat == 0xC3
    german = has(c3 & np.isin(tail, np.array([0x84, 0x96, 0x9C, 0x9F, 0xA4, 0xB6, 0xBC], np.uint8)))
    spanish = has(c3 & np.isin(tail, np.array([0x81, 0x8D, 0x91, 0x93, 0x9A, 0xA1, 0xAD, 0xB1, 0xB3, 0xBA], np.uint8)))
    other = has(flat >= 0x80)
    alphabet = np.where(german, 1, np.where(spanish, 2, np.where(other, 3, 0)))
    capital = has(c3 & (tail >= 0x80) & (tail <= 0x9E))
    last = x[starts + lengths - 1]
    digit = has((flat >= 0x30) & (flat <= 0x39))
    letter = (last >= 0x61) & (last <= 0x7A) | (last >= 0x80)
    mark = np.where(digit, 5, np.where(letter, 0, np.where(last == 0x2E, 1, np.where(last == 0x2C, 2, np.where(np.isin(last, np.frombuffer(b"#$%&*", np.uint8)), 3, 4)))))
    return ((alphabet * 2 + capital) * 6 + mark) * 2 + (lengths > 7)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class by form, count) of each portion."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j in portions(offsets):
            x, starts, lengths, _ = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            _, one, counts = np.unique(hashes_of(x, starts, lengths), return_index=True, return_counts=True)
            own, size = starts[one], lengths[one]
            yield pa.RecordBatch.from_arrays([words_array(x, own, size), pa.array(forms_of(x, own, size), pa.int32()), pa.array(counts, pa.int64())], names=["word", "form", "n"])


def words_array(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    flat = x[ragged(starts, lengths)]
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())


@dataclass
class Vocabulary:
    """The most frequent words by sorted hash, with counts and classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    own: int  # words with a class of their own

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def classed(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a portion and the class sequence of its texts, each with its end."""
    x, starts, lengths, counts = tokens_of(data, offsets)
    hashes, one, kind = np.unique(hashes_of(x, starts, lengths), return_index=True, return_inverse=True)
    own, size = starts[one], lengths[one]
    at, known = vocabulary.find(hashes)
    form = forms_of(x, own, size)
    classes = np.where(known, vocabulary.classes[at] if len(vocabulary.classes) else 0, vocabulary.own + form)
    end, base = vocabulary.own + FORMS, classes_of(vocabulary.own)
    n = counts + 1
    ends = np.cumsum(n)
    sequence = np.full(int(ends[-1]) if len(ends) else 0, end, np.int64)
    inner = np.ones(len(sequence), bool)
    inner[ends - 1] = False
    sequence[inner] = classes[kind]
    doc = np.repeat(np.arange(len(n)), n)
    first = np.repeat(ends - n, n)
    place = np.arange(len(sequence))
    back = lambda k: np.where(place - k >= first, sequence[np.maximum(place - k, 0)], end)
    context = back(2) * base + back(1)
    return x, own, size, kind, at, known, form, doc, doc[inner], sequence, context


def _triples(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j in portions(offsets):
            *_, sequence, context = classed(vocabulary, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            triples, counts = np.unique(context * classes_of(vocabulary.own) + sequence, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(triples), pa.array(counts)], names=["triple", "n"])


SIZE = 32  # of a vector
#: Rounds of training, triples of a task's part, and of a step; a round takes each part's triples twice, or so many steps.
ROUNDS, PART, BATCH, STEPS = 3, 500_000, 1024, 800


def split(weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors by position, as combined by their matrices; class vectors; biases."""
    r, q, b = np.split(weights, [2 * classes * SIZE, 3 * classes * SIZE])
    return r.reshape(2, classes, SIZE), q.reshape(classes, SIZE), b


def first_weights(unigram: np.ndarray, seed: int = 7) -> np.ndarray:
    start = np.random.default_rng(seed).normal(0, 0.1, 3 * len(unigram) * SIZE)
    return np.concatenate([start, np.log(unigram)]).astype(np.float32)


def train(weights: np.ndarray, triples: np.ndarray, counts: np.ndarray, unigram: np.ndarray, steps: int, rate: float = 0.15, noise: int = 12, seed: int = 7) -> np.ndarray:
    """Noise-contrastive estimation of the log-bilinear model from ``weights`` on; ``unigram``
    is the noise, a probability of each class. Returns new weights."""
    classes = len(unigram)

    def sums_by(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.argsort(rows, kind="stable")
        kinds, starts = np.unique(rows[order], return_index=True)
        out = np.zeros((classes, values.shape[1]), np.float32)
        out[kinds] = np.add.reduceat(values[order], starts, 0)
        return out

    rng = np.random.default_rng(seed)
    two, one, target = triples // classes**2, triples // classes % classes, triples % classes
    log_noise = np.log(noise * unigram).astype(np.float32)
    params = [p.copy() for p in split(weights.astype(np.float32), classes)]
    r, q, b = params
    sums = [np.full_like(p, 1e-6) for p in params]
    table, share = np.cumsum(counts) / counts.sum(), np.cumsum(unigram)
    for step in range(steps):
        pace = rate * (1 - step / steps) + 0.002
        pick = np.minimum(np.searchsorted(table, rng.random(BATCH)), len(triples) - 1)
        c2, c1, w = two[pick], one[pick], target[pick]
        z = np.minimum(np.searchsorted(share, rng.random(noise * 8)), classes - 1)  # shared by the batch
        context = r[0, c2] + r[1, c1]
        true = (context * q[w]).sum(1) + b[w] - log_noise[w]
        false = context @ q[z].T + b[z] - log_noise[z]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # gradient towards the true class
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30))) / 8
        g_context = up[:, None] * q[w] + down @ q[z]
        g_q = sums_by(w, up[:, None] * context) + sums_by(z, down.T @ context)
        g_b = np.bincount(w, up, minlength=classes) + np.bincount(z, down.sum(0), minlength=classes)
        g_r = np.stack([sums_by(c2, g_context), sums_by(c1, g_context)])
        for p, s, g in zip(params, sums, (g_r, g_q, g_b)):
            g /= BATCH
            s *= 0.999
            s += g * g
            p += pace * g / np.sqrt(s + 1e-10) * 0.1
    return np.concatenate([p.ravel() for p in params]).astype(np.float32)


def log_probabilities(weights: np.ndarray, classes: int, context: np.ndarray, target: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Normalised log10 probability of each target in its context (c2 * classes + c1): matrix
    products over the different contexts, ``batch`` at a time."""
    r, q, b = split(weights, classes)
    kinds, which = np.unique(context, return_inverse=True)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(0, len(kinds) + batch, batch))
    out = np.empty(len(context), np.float64)
    for at, (i, j) in zip(range(0, len(kinds), batch), zip(edges[:-1], edges[1:])):
        some = kinds[at : at + batch]
        logits = (r[0, some // classes] + r[1, some % classes]) @ q.T + b
        top = logits.max(1)
        norm = top + np.log(np.exp(logits - top[:, None]).sum(1))
        rows = order[i:j]
        out[rows] = (logits[which[rows] - at, target[rows]] - norm[which[rows] - at]) / np.log(10)
    return out


def _round(weights: np.ndarray, unigram: np.ndarray, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A round over a part: new weights, and the number of tokens that they are of."""
    rows = [np.stack([np.asarray(batch.column(i)) for i in (0, 1)]) for batch in batches if batch.num_rows]
    if rows:
        triples, counts = np.concatenate(rows, 1)
        order = np.argsort(triples)
        steps = max(STEPS, 2 * len(triples) // BATCH)
        made = train(weights, triples[order], counts[order], unigram, steps, 0.15 / (1 + turn), seed=7 + turn)
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary()), pa.array([int(counts.sum())])], names=["weights", "n"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = 0, None
    for batch in batches:
        for raw, n in zip(batch.column(0), batch.column(1).to_pylist()):
            w = np.frombuffer(raw.as_py(), np.float32).astype(np.float64)
            total += n
            mean = w if mean is None else mean + (w - mean) * (n / total)
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def trained(triples: DataFrame, classes: int) -> np.ndarray:
    """Weights of a model of all triples (triple, n), which tasks hold in parts."""
    target = triples.groupBy((F.col("triple") % classes).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row for each class
    unigram = np.full(classes, 0.5)
    for row in target:
        unigram[row["c"]] += row["n"]
    unigram /= unigram.sum()
    weights = first_weights(unigram)
    if not target:
        return weights
    parts = math.ceil(sum(row["rows"] for row in target) / PART)
    dealt = cut(triples.repartition(parts))  # evenly, so that no part is too small to learn from
    for turn in range(ROUNDS):
        made = map_arrow(dealt, partial(_round, weights, unigram, turn), "weights binary, n long")
        weights = np.frombuffer(bytes(map_arrow(made.repartition(1), _averaged, "weights binary").first()["weights"]), np.float32)
    return weights


EDGE = 256  # before a word's first byte and after its last


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair of bytes, number) over the words of a task."""
    counts = np.zeros(257 * 257, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        counts += np.bincount(byte_pairs(data, offsets[:-1], np.diff(offsets))[0], minlength=len(counts))
    pairs = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts[pairs])], names=["pair", "n"])


def byte_pairs(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte and the one before it, edges included; the word of each)."""
    n = lengths + 1
    word = np.repeat(np.arange(len(n)), n)
    flat = np.full(len(word), EDGE, np.int64)
    last = np.cumsum(n) - 1
    inner = np.ones(len(flat), bool)
    inner[last] = False
    flat[inner] = x[ragged(starts, lengths)]
    before = np.r_[EDGE, flat[:-1]] if len(flat) else flat
    return before * 257 + flat, word


def spelling_of(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each byte (or the edge) after each."""
    table = np.full(257 * 257, 0.05)
    table[pairs] += counts
    table = table.reshape(257, 257)
    return np.log10(table / table.sum(1, keepdims=True)).ravel()


def _scored(vocabulary: Vocabulary, weights: np.ndarray, within: np.ndarray, spelling: np.ndarray, n: int, v: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with what its frequent words give, and one for each text and
    other word. ``within``: for each vocabulary word, log10 of its share of its class."""
    base_of = np.log10((vocabulary.counts + 1) / (n + v + 1))
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        for i, j in portions(offsets):
            x, own, size, kind, at, known, form, doc, word_doc, sequence, context = classed(vocabulary, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            m = j - i
            score = np.bincount(doc, log_probabilities(weights, classes_of(vocabulary.own), context, sequence), minlength=m)
            tokens = np.bincount(doc, minlength=m)
            hit = known[kind]
            rows, places = word_doc[hit], at[kind[hit]]
            score += np.bincount(rows, within[places], minlength=m) if len(rows) else 0.0
            base = np.bincount(rows, base_of[places], minlength=m) if len(rows) else np.zeros(m)
            n_known = np.bincount(rows, minlength=m)
            pairs, times = np.unique(word_doc[~hit] * len(own) + kind[~hit], return_counts=True)
            rest_doc, rest = pairs // max(1, len(own)), pairs % max(1, len(own))
            codes, word = byte_pairs(x, own[rest], size[rest])
            spelt = np.bincount(word, spelling[codes], minlength=len(rest))
            keys = batch.column(0).slice(i, j - i)
            ids = batch.column(1).slice(i, j - i)
            marks = pa.array([f"\n{k}" for k in keys.to_pylist()], pa.string())  # no word has a newline
            none, zero = pa.nulls(len(rest), pa.int64()), np.zeros(len(rest))
            words = pa.concat_arrays([marks, words_array(x, own[rest], size[rest])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([keys, keys.take(pa.array(rest_doc))]), words,
                    pa.array(np.r_[np.zeros(m, np.int64), times]), pa.array(np.r_[np.zeros(m, np.int32), form[rest].astype(np.int32)], pa.int32()),
                    pa.concat_arrays([ids, pa.nulls(len(rest), ids.type)]), pa.concat_arrays([pa.array(tokens, pa.int64()), none]),
                    pa.array(np.r_[n_known, np.zeros(len(rest), np.int64)], pa.int64()), pa.array(np.r_[base, zero]), pa.array(np.r_[score, zero]), pa.array(np.r_[np.zeros(m), spelt]),
                ],
                names=["key", "word", "times", "form", "doc_id", "n_tokens", "n_known", "base", "score", "spelt"],
            )


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Of (word, n, ...) the words of at least some count: as many as can be, ``most`` at most."""
    level = F.floor(F.log2("n") * 4)
    steps = sorted(((r["level"], r["rows"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = math.inf, 0
    for at, rows in steps:
        if (total := total + rows) > most:
            break
        least = at
    return counts.where(level >= least) if least < math.inf else counts.where("false")


def score_texts(docs: DataFrame, training: DataFrame, frequent: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs,
    by counts and a model of all rows of ``training``.

    Null text is empty: one token, the end. Without training rows no word is known and
    all probability is the model's bias. Repeated rows and null ids stay; other columns
    are ignored. The most frequent words, ``frequent`` at most, are known to every task;
    counts of all others are joined.
    """
    texts = text_of(training)
    partial_counts = map_arrow(texts, _counted, "word string, form int, n long")
    counts = cut(partial_counts.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n")))
    n_docs = training.count()
    facts = counts.groupBy("form").agg(
        F.count("*").alias("types"), F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")
    ).collect()  # one row for each form
    kinds = sum(r["types"] for r in facts)
    n, v = sum(r["n"] for r in facts) + n_docs, kinds + (1 if n_docs else 0)
    pairs = map_arrow(counts.select("word"), _spelt, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most 257 * 257 rows
    spelling = spelling_of(pairs["pair"].to_numpy(), pairs["n"].to_numpy())
    top = sorted(zip(*(c.to_pylist() for c in frequent_words(counts, frequent).select("n", "word", "form").toArrow().columns)), key=lambda r: (-r[0], r[1].encode("utf-8", "surrogatepass")))
    own = min(own_classes(kinds), len(top))
    raw, top_n, top_form = [w.encode("utf-8", "surrogatepass") for _, w, _ in top], np.array([r[0] for r in top], np.int64), np.array([r[2] for r in top], np.int64)
    flat, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw], np.int64)
    starts = np.r_[0, np.cumsum(lengths)][:-1].astype(np.int64)
    hashes = hashes_of(flat, starts, lengths) if raw else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    place = np.arange(len(raw))
    vocabulary = Vocabulary(hashes[order], top_n[order], np.where(place < own, place, own + top_form)[order], own)
    # what a form's words, without those of their own class, have in all
    types, total, once, twice = (np.zeros(FORMS) for _ in range(4))
    for r in facts:
        types[r["form"]], total[r["form"]], once[r["form"]], twice[r["form"]] = r["types"], r["n"], r["once"], r["twice"]
    for form, k in zip(top_form[:own].tolist(), top_n[:own].tolist()):
        types[form] -= 1
        total[form] -= k
        once[form] -= k == 1
        twice[form] -= k == 2
    discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95)
    unseen = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
    alone, form = place[order] < own, top_form[order]
    within = np.where(alone, 0.0, np.log10(np.maximum(vocabulary.counts - discount[form], 1e-9) / np.maximum(total[form], 1)))
    triples = cut(map_arrow(texts, partial(_triples, vocabulary), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")))
    weights = trained(triples, classes_of(own))
    keyed = text_of(docs, "doc_id").select(F.monotonically_increasing_id().alias("key"), "doc_id", "_text")
    rows = map_arrow(
        keyed, partial(_scored, vocabulary, weights, within, spelling, n, v),
        f"key long, word string, times long, form int, doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base double, score double, spelt double",
    )
    per_form = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("form"))
    met = rows.join(counts.select("word", F.col("n").alias("c")), "word", "left").where(F.lit(True))
    c = F.coalesce(F.col("c"), F.lit(0))
    share = F.when(c > 0, F.log10((c - per_form(discount)) / per_form(np.maximum(total, 1)))).otherwise(F.log10(per_form(unseen)) + F.col("spelt"))
    is_word = F.col("times") > 0
    met = met.select(
        "key", "doc_id", "n_tokens", (F.col("n_known") + F.when(is_word & (c > 0), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(is_word, F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(is_word, F.col("times") * share).otherwise(0.0)).alias("score"),
    )
    sums = met.groupBy("key").agg(*[F.max(x).alias(x) for x in ("doc_id", "n_tokens")], *[F.sum(x).alias(x) for x in ("n_known", "base", "score")])
    end = np.log10((n_docs + 1) / (n + v + 1))
    return sums.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.lit(1 if n_docs else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(end))).alias("base_score"), "score",
    )


def score_documents(docs: DataFrame, held_out: int = 2, modulus: int = 7) -> DataFrame:
    """score_texts of all rows, learning from those outside the held-out bucket, with the
    column held_out. A null doc_id is in no bucket: not held out, not learnt from."""
    bucket = bucket_of(F.col("doc_id"), modulus)
    scored = score_texts(docs, docs.where(bucket != held_out))
    return scored.select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), *scored.columns[1:])
