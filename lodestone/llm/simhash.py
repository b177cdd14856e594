"""SimHash near-duplicate detection.

Fingerprints are embedded by the bit counts of their 32 two-bit segments. A count c of
a segment is written as c ones in its two places, so that the Manhattan distance of two
embeddings is the number of ones in the XOR of their codes: a lower bound of the
Hamming distance. The grid is over groups of four segments. Two fingerprints within
``d`` bits differ by at most d in Manhattan distance, so at most d of the groups differ;
they share the cell of at least one choice of G - d groups. Within a cell, pairs are
held against the Manhattan bound, then verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, text_of
from .components import connected_components

GROUPS = 8
LOW_BITS = 0x5555555555555555


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and the six ASCII spaces


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle, repeats included; fewer words: of the whole sequence."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half the hashes (none: 0)."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):  # counts of up to 255 rows fit a byte
        some = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(some) // 255 * 255
        counts += some[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += some[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``, repeats included."""
    return majority(shingle_hashes(_words(text), words))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long. Null text: empty;
    no word: 0."""
    return map_arrow(text_of(docs, "doc_id"), partial(_fingerprints, words=words), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def count_code(fp: Column) -> Column:
    """The embedding: per two-bit segment, its bit count as that many ones."""
    low, high = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _np_code(x: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    return ((x | (x >> one)) & low) | ((x & (x >> one) & low) << one)


def cell_masks(distance: int) -> list[int]:
    """For each choice of groups that may agree, the mask of its code bits."""
    if not 0 <= distance < GROUPS:
        raise ValueError(f"max_distance must be from 0 to {GROUPS - 1}")
    width = 64 // GROUPS
    return [sum(((1 << width) - 1) << (width * g) for g in groups) for groups in combinations(range(GROUPS), GROUPS - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _verified(masks: np.ndarray, distance: int, dense: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within cells; rows come sorted by cell. Of a cell with over ``dense`` members
    each member is returned as (x, x) instead: those are linked by midpoints."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def within(choice: np.ndarray, cell: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, (choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(x)])
        size = np.repeat(sizes, sizes)
        crowded = size > dense
        left, right = [x[crowded]], [x[crowded]]
        keep = (size > 1) & ~crowded
        x, choice, group = x[keep], choice[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
        code = _np_code(x)
        for k in range(1, dense):
            same = np.flatnonzero(group[k:] == group[:-k])
            if not len(same):
                break
            gap = code[same] ^ code[same + k]
            same, gap = same[(near := np.bitwise_count(gap) <= distance)], gap[near]
            close = np.bitwise_count(x[same] ^ x[same + k]) <= distance
            same, gap = same[close], gap[close]
            if len(same):  # once for a pair: in the first cell that it shares
                shared = (gap[:, None] & masks[None, :]) == 0
                same = same[shared.argmax(1) == choice[same]]
                left.append(x[same])
                right.append(x[same + k])
        return out(np.concatenate(left), np.concatenate(right))

    held: list[np.ndarray] | None = None  # the last cell so far, of dense + 1 members at most
    for batch in batches:
        rows = [np.asarray(c).astype(np.int64).view(np.uint64) for c in batch.columns]
        if not len(rows[0]):
            continue
        if held is not None:
            if len(held[0]) > dense and held[0][-1] == rows[0][-1] and held[1][-1] == rows[1][-1]:
                yield out(rows[2], rows[2])  # the crowded cell goes on
                continue
            rows = [np.concatenate(p) for p in zip(held, rows)]
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
        tail = [r[last:] for r in rows]
        if len(tail[0]) > dense + 1:
            yield out(tail[2], tail[2])
            tail = [r[: dense + 1] for r in tail]
        held = tail
        if last:
            yield within(*[r[:last] for r in rows])
    if held is not None:
        yield within(*held)


def _balls(masks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.asarray(batch.column(0)).view(np.uint64)
        for at in range(0, len(x), 64):
            some = x[at : at + 64]
            z = (some[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], names=["z", "x"])


def _near_masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def fingerprint_links(prints: DataFrame, max_distance: int = 4, dense: int = 256) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within
    ``max_distance`` bits do. ``prints`` holds each fingerprint (fp) once.

    Cells hold some fingerprints each. In a cell of over ``dense``, all pairs would be
    too many: its members meet instead at the points halfway, of which each has a fixed
    number. Two meet at some point exactly if they are within max_distance, and each is
    linked to the least that it meets there, so no connection is lost.
    """
    masks = cell_masks(max_distance)
    choices = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(choices).alias("c")).select(F.col("c.i").alias("choice"), "fp")
    mask_of = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("choice") + 1)
    cell = count_code(F.col("fp")).bitwiseAND(mask_of)
    celled = rows.repartition("choice", cell).select("choice", cell.alias("cell"), "fp").sortWithinPartitions("choice", "cell", "fp")
    found = cut(map_arrow(celled, partial(_verified, np.array(masks, np.uint64), max_distance, dense), "a long, b long"))
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    points = map_arrow(crowded, partial(_balls, _near_masks((max_distance + 1) // 2)), "z long, x long")
    if max_distance % 2:  # an odd distance: of two neighbours, one reaches the lesser ball of the other
        inner = map_arrow(crowded, partial(_balls, _near_masks(max_distance // 2)), "z long, x long")
        hub = inner.select("z", F.col("x").alias("m"))  # exact, with one row for each pair that meets
    else:
        hub = points.groupBy("z").agg(F.min("x").alias("m"), F.max("x").alias("n")).where("m < n").select("z", "m")
    meet = points.join(hub, "z").where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b"))
    return found.where("a <> b").union(meet.where("a <> b")).distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 4, max_distance: int = 4, dense: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents are linked if their fingerprints differ in ``max_distance`` bits or fewer;
    component_id is the smallest doc_id that can be reached. Equal fingerprints are one
    node, whatever their number. Null text is empty text (fingerprint 0); repeated rows
    are kept; rows with a null doc_id are linked too, but give no component_id unless a
    neighbour has one. An empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, words))
    return _grouped(prints, lambda firsts: fingerprint_links(firsts, max_distance, dense))


def _grouped(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id) by links between the fingerprints of ``prints``."""
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut(connected_components(links(firsts.select("fp"))))
    heads = roots.join(firsts, roots.node == firsts.fp).groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(heads, "root").select(F.col("node").alias("fp"), "component_id")
    ids = firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
