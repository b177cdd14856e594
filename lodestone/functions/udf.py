"""Arrow-batched UDFs for what built-in expressions can't say well."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, swap neighbours; each once."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def jaro_winkler_similarity(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    matched = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (y for y, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro)


def _vectorised(fn, kind: T.DataType):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in memo:
                memo[x, y] = fn(x, y)
            out.append(memo[x, y])
        return pd.Series(out)

    return F.pandas_udf(run, kind)


osa = _vectorised(osa_distance, T.LongType())
jaro_winkler = _vectorised(jaro_winkler_similarity, T.DoubleType())
ratio = _vectorised(lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), T.DoubleType())


def word_occurrences(text: str, part: str) -> list[tuple[int, int]]:
    """Whole-word, non-overlapping occurrences whatever the case; a plural s may follow."""
    if not part:
        return []
    left = r"(?<!\w)" if re.match(r"\w", part) else ""
    right = r"(?=s?(?!\w))" if re.search(r"\w$", part) else ""
    return [m.span() for m in re.finditer(left + re.escape(part) + right, text, re.I)]


ARTICLES = ("the", "a", "an")
DOUBLED = re.compile(r"\b(\w+)\s+\1\b", re.I)


def spliced(text: str, part: str, new: str) -> str | None:
    """``text`` with the first whole-word ``part`` replaced. After an article the new text's own
    is left out; a or an follows the new word's sound; a word that would stand twice at
    either seam is left once. None where there is no place, nothing is left, or a word or
    an article would still be doubled that wasn't before."""
    spots = word_occurrences(text, part)
    if not spots:
        return None
    before, after, words = text[: spots[0][0]], text[spots[0][1] :], new.split()
    last = re.search(r"(\S+)\s*$", before)
    said = last[1].lower() if last else ""
    if said in ARTICLES and words and words[0].lower() in ARTICLES:
        del words[0]
    if said in ("a", "an") and words:
        said = "an" if words[0].lstrip("\"'([")[:1].lower() in tuple("aeiou") else "a"
        before = before[: last.start(1)] + (said.capitalize() if last[1][0].isupper() else said) + before[last.end(1) :]
    if words and words[0].lower() == said:
        del words[0]
    if not words:
        return None
    following = re.match(r"\s*(\S+)", after)
    if following and following[1].lower() == words[-1].lower():
        after = after[: following.start(1)] + after[following.end(1) :]
    out = before + " ".join(words) + after
    if any(m[1].lower() in ARTICLES for m in DOUBLED.finditer(out)) or (DOUBLED.search(out) and not DOUBLED.search(text)):
        return None
    return out


def _splice(text: pd.Series, part: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if None in (t, p, n) else spliced(t, p, n) for t, p, n in zip(text, part, new)])


splice = F.pandas_udf(_splice, T.StringType())
