"""Language identification: family first, then one-versus-one linear SVMs within it.

Texts are counted as hashed byte 1- to 3-grams of whole texts. Training takes a bounded,
documented sample of rows for each language; prediction runs over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import portions, text_bytes
from .common import bucket_of, cut, map_arrow, text_of

UNKNOWN = "und"
SIZE = 4096

#: Families of languages by ISO 639-1 code; any other is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "sc", "rm"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur", "sa", "si"),
    "semitic": ("ar", "he", "mt", "am"),
    "malayic": ("id", "ms"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes of texts with ASCII and two-byte Latin capitals lowered."""
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + (upper.view(np.uint8) << 5)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by SIZE: square roots of n-gram counts, each text of length 1. Bytes that are
    no letters (below 0x80) count as one separator, so layout and digits have no say."""
    x = folded(data)
    letter = (x >= 0x61) & (x <= 0x7A) | (x >= 0x80)
    x = np.where(letter, x, 0x20).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    x = x[keep]
    out = np.zeros((len(offsets) - 1) * SIZE, np.float64)
    code = np.zeros(len(x), np.uint32)
    for n in (1, 2, 3):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)).astype(np.uint32)
        mixed = (code * np.uint32(2654435761)) >> np.uint32(20)
        inside = doc[: len(code)] == doc[n - 1 :]
        out += np.bincount((doc[: len(code)] * SIZE + mixed)[inside], minlength=len(out))
    rows = np.sqrt(out).reshape(-1, SIZE)
    norms = np.sqrt((rows**2).sum(1, keepdims=True))
    return (rows / np.maximum(norms, 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """A linear SVM (squared hinge, classes of equal weight) by accelerated gradient steps;
    the last weight is the bias. y is of -1 and 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (1.0 / c + 2.0 * 2.0)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look)).astype(np.float32)
        new = look - step * (look / c - 2 * x.T @ (weight * slack * y))
        look, w = new + i / (i + 3) * (new - w), new
    return w


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # one row for each family, against the rest
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(languages, scores from 0 to 1) for rows of features."""
        n = len(x)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        sure = lambda m: 1 / (1 + np.exp(-4 * m.astype(np.float64)))
        if len(self.families) == 1:
            family, score = np.zeros(n, int), np.ones(n)
        else:
            margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
            family = margins.argmax(1)
            score = sure(margins.max(1))
        out = np.empty(n, object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            own = self.members[name]
            votes = np.zeros((len(rows), len(own)))
            total = np.zeros((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                w = self.pair_weights[own[a], own[b]]
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                total[:, a] += np.tanh(m)
                total[:, b] -= np.tanh(m)
            best = (votes + total / (4 * max(1, len(own)))).argmax(1)
            out[rows] = np.array(own, object)[best]
            if len(own) > 1:
                score[rows] *= sure(total[np.arange(len(rows)), best] / (len(own) - 1))
        return out.tolist(), score


def train(x: np.ndarray, languages: list[str]) -> LanguageModel:
    names = sorted(set(languages))
    family_of = {n: FAMILY_OF.get(n, n) for n in names}
    families = sorted(set(family_of.values()))
    lang = np.array(languages, object)
    fam = np.array([family_of[n] for n in languages], object)
    sign = lambda mask: np.where(mask, 1, -1).astype(np.float32)
    model = LanguageModel(families, {f: [n for n in names if family_of[n] == f] for f in families})
    if len(families) > 1:
        model.family_weights = np.array([svm(x, sign(fam == f)) for f in families])
    for own in model.members.values():
        for a, b in combinations(own, 2):
            two = (lang == a) | (lang == b)
            model.pair_weights[a, b] = svm(x[two], sign(lang[two] == a))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in portions(offsets, 2_000_000):
            rows = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed], names=["lang", "x"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of a task, pickled; no row for none."""
    rows = [(k, v) for batch in batches for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    if rows:
        rows.sort()
        x = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(len(rows), SIZE)
        m = train(x, [k for k, _ in rows])
        made = pickle.dumps((m.families, m.members, m.family_weights, m.pair_weights))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])


def fit(docs: DataFrame, per_language: int = 400, most_rows: int = 12_800) -> LanguageModel:
    """A model of rows with text and lang, of every value of lang. For training, the
    ``per_language`` different texts of each language with the least hashes are taken, with
    many languages fewer of each, so that they are ``most_rows`` in all (but 20 of each are
    taken). Copies of a text count once. A task trains on them; only the weights come to the
    driver. Rows with null text or lang are left out; without any row the model knows no
    language."""
    known = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    counts = cut(known.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("_texts")))
    languages = counts.count()
    if not languages:
        return LanguageModel()
    each = max(min(per_language, 20), min(per_language, most_rows // languages))
    few = F.broadcast(counts) if languages <= 10_000 else counts
    drawn = known.join(few, "lang").where(F.pmod("_h", F.lit(1 << 30)) < 1.2 * each / F.greatest("_texts", F.lit(1)) * float(1 << 30))
    once = drawn.groupBy("lang", "_h").agg(F.first("text").alias("text"))  # copies meet before they are sent
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))
    taken = once.withColumn("_place", place).where(F.col("_place") <= each).select("lang", "text")
    rows = map_arrow(taken, _features, "lang string, x binary").repartition(1)
    made = map_arrow(rows, _trained, "model binary").first()
    return LanguageModel(*pickle.loads(bytes(made["model"]))) if made else LanguageModel()


def _predicted(model: LanguageModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    lettered = regex.compile(r"\p{L}").search
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        for i, j in portions(offsets, 2_000_000):
            names, scores = model.predict(grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            for k, text in enumerate(batch.column(batch.num_columns - 1).slice(i, j - i)):
                if not lettered(text.as_py()):
                    names[k], scores[k] = UNKNOWN, 0.0
            kept = [c.slice(i, j - i) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row. Null text, or text without
    a letter: und with score 0. Repeated rows stay; an empty table gives no rows."""
    kinds = dict(docs.dtypes)
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(text_of(docs, *keep), partial(_predicted, model), f"{columns}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: int = 2, modulus: int = 4, per_language: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model that learnt from rows
    outside the held-out bucket. A null doc_id is in no bucket: not held out, not learnt from."""
    bucket = bucket_of(F.col("doc_id"), modulus)
    model = fit(docs.where(bucket != held_out), per_language)
    return predict(docs, model).select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
