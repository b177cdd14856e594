"""Packing of token sequences into windows by Karmarkar-Karp differencing.

Texts are tokenised once; only lengths and checksums of pieces travel on. Pieces of a
full window stand alone. The others are dealt by a hash into groups of a bounded
expected size, and each group is packed by multiway differencing: every piece starts as
a partition of k windows of which one is filled; the two partitions of the largest
spread are merged, the fullest windows of one with the emptiest of the other, until one
is left. Where a window then exceeds its capacity, k rises and the group is packed anew.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONGEST, NEVER, Transducer, distinct_chunks, gathered, latin_letters, portions, ragged, text_bytes
from .common import cut, map_arrow, process_cache, text_of


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 bytes
    stand for themselves, the others for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_CLASS = np.full(256, 3, np.uint8)  # others
_CLASS[0x61:0x7B] = 1  # letters, once lowered
_CLASS[0x30:0x3A] = 2  # digits, each a piece
_CLASS[[*range(0x21), 0x27, 0x3C, 0x7C, *range(0x7F, 0x100)]] = 0  # apostrophes and what may be special need the library


class WordBpe:
    """Ids of texts by a tokenizer file whose pipeline lowers case, drops white space, and
    takes runs of letters, single digits, and runs of others as words with an end mark.

    Chunks between ASCII white space are encoded once for each kind: those of ASCII and
    of two-byte Latin letters by the transducer (the end mark is the last byte's other
    symbol), any others by the library itself.
    """

    END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, letter = model["vocab"], byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            ended = token.endswith(self.END)
            body = [letter[c] for c in token.removesuffix(self.END)]
            return (*body[:-1], body[-1] | 256 if ended else body[-1])

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(pairs)}
        made = {(vocabulary[a], vocabulary[b]): vocabulary[a + b] for a, b in pairs}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.transducer = Transducer(
            {i: symbols(t) for t, i in vocabulary.items() if t not in special and t != self.END},
            lambda a, b: ranks.get((a, b), NEVER),
            lambda a, b: made[a, b],
        )

    def encode_column(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number for each text)."""
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + (upper.view(np.uint8) << 5)
        dark = np.r_[(data != 0x20) & (data != 0x0A) & (data != 0x0D) & (data != 0x09)]
        begins, ends = dark.copy(), dark.copy()
        begins[1:] &= ~dark[:-1]
        ends[:-1] &= ~dark[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = dark[edges]
        ends[edges - 1] = dark[edges - 1]
        starts = np.flatnonzero(begins)
        lengths = np.flatnonzero(ends) + 1 - starts
        one, kind = distinct_chunks(data, starts, lengths)
        own, size = starts[one], lengths[one]
        flat = data[ragged(own, size)]
        heads = np.r_[0, np.cumsum(size)][:-1]
        classes = _CLASS[flat]
        classes[latin_letters(flat)] = 1
        plain = (np.minimum.reduceat(classes, heads) > 0 if len(heads) else np.zeros(0, bool)) & (size <= LONGEST)
        regular = np.flatnonzero(plain)
        taken = ragged(heads[regular], size[regular])
        flat_r, class_r = flat[taken].astype(np.int64), classes[taken]
        edge = np.r_[0, np.cumsum(size[regular])]
        first = np.zeros(len(flat_r), bool)
        first[edge[:-1]] = True
        if len(flat_r):
            first[1:] |= (class_r[1:] != class_r[:-1]) | (class_r[1:] == 2)
        piece_at = np.flatnonzero(first)
        stops = np.r_[piece_at[1:], len(flat_r)][: len(piece_at)]
        flat_r[stops - 1] |= 256
        ids, counts = self.transducer.encode_many(flat_r, piece_at, stops - piece_at)
        totals = np.r_[0, np.cumsum(counts)][np.searchsorted(piece_at, edge)]
        count, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        count[regular], at[regular] = np.diff(totals), totals[:-1]
        others = np.flatnonzero(~plain)
        texts = [bytes(flat[h : h + n]).decode("utf-8", "replace") for h, n in zip(heads[others].tolist(), size[others].tolist())]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        count[others] = [len(x) for x in found]
        at[others] = len(ids) + np.r_[0, np.cumsum(count[others])][:-1]
        ids = np.r_[ids, np.array([i for x in found for i in x], np.int32)]
        return gathered(kind, ids, at, count, np.searchsorted(starts, offsets))


def shared_words(path: str) -> WordBpe:
    cache = process_cache()
    if ("words", path) not in cache:
        cache["words", path] = WordBpe(path)
    return cache["words", path]


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then what is left, in
    equal parts of ``piece`` at most."""
    full = n // window * window
    left = n - full
    parts = max(1, math.ceil(left / piece)) if left else 0
    edges = [full + left * i // parts for i in range(parts + 1)] if parts else []
    return [(s, window) for s in range(0, full, window)] + [(a, b - a) for a, b in zip(edges, edges[1:])]


def _pieces(path: str, window: int, piece: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = shared_words(path)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in portions(offsets, 1_000_000):
            ids, counts = words.encode_column(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
            rows, out, at = [], [], 0
            for row, n in enumerate((counts + 1).tolist(), i):
                for start, length in cuts(n, window, piece):
                    rows.append(row)
                    out.append((start, length, zlib.crc32(ids[at + start : at + start + length]), n))
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in zip(*out)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each length, by multiway largest differencing."""
    n = len(lengths)
    parent = list(range(n))  # of windows that were merged

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # a partition: sums of its filled windows, fullest first, and a member of each
    heap = [(-int(x), i, np.array([x]), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    at = n
    while len(heap) > 1:
        _, _, sums_a, who_a = heapq.heappop(heap)
        _, _, sums_b, who_b = heapq.heappop(heap)
        if len(sums_a) < len(sums_b):
            sums_a, who_a, sums_b, who_b = sums_b, who_b, sums_a, who_a
        empty = k - len(sums_b)  # windows of b: these get the fullest of a
        if empty < len(sums_a):
            met = len(sums_a) - empty
            sums_a = sums_a.copy()
            sums_a[empty:] += sums_b[::-1][:met]
            for i, j in zip(who_a[empty:].tolist(), who_b[::-1][:met].tolist()):
                parent[top(j)] = top(i)
            sums_b, who_b = sums_b[: len(sums_b) - met], who_b[: len(who_b) - met]
        sums, who = np.concatenate([sums_a, sums_b]), np.concatenate([who_a, who_b])
        order = np.argsort(-sums, kind="stable")
        sums, who = sums[order], who[order]
        if len(sums) == k:  # what all windows have in common makes no difference
            spread = int(sums[0] - sums[-1])
        else:
            spread = int(sums[0])
        heapq.heappush(heap, (-spread, at, sums, who))
        at += 1
    names: dict[int, int] = {}
    return np.array([names.setdefault(top(i), len(names)) for i in range(n)], np.int64)


def windows(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of lengths that each fit the capacity, none of them above it."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    k = max(1, math.ceil(int(lengths.sum()) / capacity))
    while True:
        at = differencing(lengths, k)
        over = np.maximum(np.bincount(at, lengths) - capacity, 0).sum()
        if not over:
            return at
        k += max(1, int(over // capacity))


def _packed(group: pd.DataFrame, window: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    whole = (group["length"] == window).to_numpy()
    at = np.zeros(len(group), np.int64)
    at[~whole] = windows(group["length"].to_numpy()[~whole], window)
    at[whole] = np.arange(whole.sum()) + (at[~whole].max() + 1 if (~whole).any() else 0)
    group["sequence_id"] = group.pop("part").to_numpy() * (1 << 32) + at
    group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
    return group


def pack(docs: DataFrame, path: str, window: int = 2048, piece: int = 512, end: int = 1, group_size: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's ids (by the tokenizer file ``path``, then ``end``) are cut into full windows
    and a rest in parts of up to ``piece`` ids. sequence_id is group * 2^32 + window;
    offsets are gapless from 0. Null and empty texts have the one id ``end``. Repeated
    rows and null doc_ids are packed like others; other columns are ignored; an empty
    table gives no rows. A group holds about ``group_size`` pieces at any input size.
    """
    kind = dict(docs.dtypes)["doc_id"]
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut(map_arrow(text_of(docs, "doc_id"), partial(_pieces, path, window, piece, end), columns))
    parts = max(1, math.ceil(pieces.count() / group_size))
    # by their places in what was written, so that repeated rows don't meet in one group
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(partial(_packed, window=window), f"{columns}, sequence_id long, offset long")
