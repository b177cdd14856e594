"""Near duplicates by the Jaccard similarity of their word shingles.

SimHash alone meets copies within a few bits. At a similarity of 0.8 two fingerprints
differ in about 10 of 64 bits, which no selective grid holds together. Here the SimHash
links stand beside a second search: minwise hashes in bands give cells, and pairs within
cells are verified by their whole sets of shingles. Both kinds of links make one set of
components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import cut, map_arrow, release, text_of
from .components import connected_components
from .simhash import _grouped, _words, fingerprint_links, majority, shingle_hashes

#: A pair of similarity 0.8 shares none of 24 bands of five with a probability of 7e-5.
BANDS, DEPTH = 24, 5


def band_keys(hashes: np.ndarray, bands: int = BANDS, depth: int = DEPTH) -> list[int]:
    """Signed keys of the minwise hashes of a set, ``depth`` to a band; an empty set has none."""
    if not len(hashes):
        return []
    mixers = np.random.default_rng(2).integers(0, 1 << 63, (2, bands * depth), np.uint64)
    turns, flips = mixers[0] << np.uint64(1) | np.uint64(1), mixers[1]
    least = np.full(bands * depth, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048, None] ^ flips) * turns).min(0), out=least)
    rows = least.reshape(bands, depth)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _text_key(found: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(found), 7)


def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys, cells = [], [], []
        for value in batch.column(batch.num_columns - 1):
            found = _words(value.as_py())
            hashes = shingle_hashes(found, words)
            prints.append(majority(hashes))
            keys.append(_text_key(found))
            cells.append(band_keys(np.unique(hashes)))
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, keys)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *signed, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "fp", "node", "cells"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):  # a text at a time: sets are as large as texts
            found = _words(value.as_py())
            hashes = pa.array(np.unique(shingle_hashes(found, words)).view(np.int64))
            node = pa.array(np.array([_text_key(found)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), hashes)], names=["node", "hashes"])


def _cell_pairs(batches: Iterator[pa.RecordBatch], dense: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a cell; rows come sorted by cell. Of a cell with over ``dense``
    members each is returned as (x, x) instead. Holds one batch and dense + 1 rows."""

    def out(a, b, cell) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, cell)], names=["a", "b", "cell"])

    def within(cell: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        size = np.repeat(sizes, sizes)
        crowded, keep = size > dense, (size > 1) & (size <= dense)
        yield out(node[crowded], node[crowded], cell[crowded])
        cell, node = cell[keep], node[keep]
        for k in range(1, dense):
            same = np.flatnonzero(cell[k:] == cell[:-k])
            if not len(same):
                break
            yield out(node[same], node[same + k], cell[same])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [np.asarray(c).astype(np.int64) for c in batch.columns]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(p) for p in zip(held, rows)]
        last = int(np.flatnonzero(rows[0] != rows[0][-1]).max(initial=-1)) + 1
        tail = [r[last:] for r in rows]
        if len(tail[0]) > dense + 1:
            yield out(tail[1], tail[1], tail[0])
            tail = [r[: dense + 1] for r in tail]
        held = tail
        if last:
            yield from within(*[r[:last] for r in rows])
    if held is not None:
        yield from within(*held)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def text_key() -> Column:
    """A key of the row's text; null is read as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def node_classes(prints: DataFrame) -> DataFrame:
    """(node, rep, fp, cells) of each different text; rep is the row that gives it, by doc_id
    and key, as ids may be null or shared."""
    return cut(prints.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("fp").alias("fp"), F.first("cells").alias("cells")))


#: Up to so many pairs are sent to all tasks (16 bytes each), so that sets of shingles stay where they are.
SMALL_PAIRS = 100_000


def shingle_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the set of shingles of each of ``nodes``, by one of its documents."""
    ids = classes.join(nodes.distinct(), "node", "left_semi").select("rep.doc_id", "rep.key").toDF("rep_id", "rep_key")
    keyed = docs.select("doc_id", "text", text_key().alias("key"))
    texts = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key")), "left_semi")
    made = map_arrow(text_of(texts), partial(_sets, words=words), "node long, hashes array<long>")
    return cut(made.groupBy("node").agg(F.first("hashes").alias("hashes")))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have this Jaccard similarity or more."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    if pairs.count() <= SMALL_PAIRS:
        met = left.join(F.broadcast(pairs), "a").join(right.join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        met = pairs.join(left, "a").join(right, "b")
    x, y, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    alike = met.where(F.least(x, y) >= F.lit(similarity) * F.greatest(x, y))
    return cut(alike.where(both >= F.lit(similarity) * (x + y - both)).select("a", "b"))


def _met(rows: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (node, cell): the pairs (a, b) within cells of up to ``dense`` members, and
    the rows of the others."""
    dealt = rows.select("cell", "node").repartition("cell").sortWithinPartitions("cell", "node")
    found = cut(map_arrow(dealt, partial(_cell_pairs, dense=dense), "a long, b long, cell long"))
    return cut(_ordered(found.where("a <> b"), "a", "b")), found.where("a = b").select(F.col("a").alias("node"), "cell").distinct()


#: The cells of members of crowded cells: a pair of similarity 0.8 shares none with a probability of 1.2e-5, one of 0.5 shares one with 0.09.
DEEP_BANDS, DEEP_DEPTH = 100, 10
#: Rows, and shingles of their sets, of a block of a crowd (in expectation).
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000


def _deep_cells(batches: Iterator[pa.RecordBatch], bands: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, value in zip(batch.column(0), batch.column(1)):
            cells = pa.array(band_keys(np.asarray(value.values).view(np.uint64), bands, depth), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(cells), pa.int64()), cells], names=["node", "cell"])


def _starred(crowded: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``links`` with those between members of crowded cells and a head, the one in most crowded
    cells: of many copies of a text, the text itself."""
    seen = crowded.groupBy("node").count()
    heads = crowded.join(seen, "node").groupBy("cell").agg(F.max(F.struct("count", "node")).alias("m")).select("cell", F.col("m.node").alias("head"))
    star = crowded.join(heads, "cell").where("node <> head")
    return links.union(verified(cut(_ordered(star, "node", "head")), sets, similarity))


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of rows (node, cell), with their root, those of cells that hold more than one component."""
    rooted = cut(rows.join(roots, "node", "left").select("node", "cell", F.coalesce("root", "node").alias("root")))
    several = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
    return cut(rooted.join(several, "cell").select("node", "cell", "root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different components."""
    met = pairs.join(roots.toDF("a", "p"), "a", "left").join(roots.toDF("b", "q"), "b", "left")
    return cut(met.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b"))


def _crossing(left: pd.DataFrame, right: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between rows of two blocks, by an index from shingles to the rows of the right one:
    only such as join components that were apart, so no more than there are rows."""
    links, parent = [], {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    if len(left) and len(right):
        sizes = right["hashes"].map(len).to_numpy()
        flat = np.concatenate(right["hashes"].to_list())
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(right)), sizes)[order]
        kinds, starts = np.unique(flat[order], return_index=True)
        ends = np.r_[starts[1:], len(flat)]
        nodes, roots = right["node"].to_numpy(), right["root"].to_numpy()
        for node, root, own in zip(left["node"], left["root"], left["hashes"]):
            at = np.minimum(np.searchsorted(kinds, own), max(0, len(kinds) - 1))
            at = at[kinds[at] == own] if len(kinds) else at[:0]
            both = np.bincount(owner[ragged(starts[at], ends[at] - starts[at])], minlength=len(right)) if len(at) else np.zeros(len(right), int)
            alike = np.flatnonzero((both >= similarity * (sizes + len(own) - both)) & (roots != root) & (both > 0))
            for i in alike.tolist():
                if (x := top(root)) != (y := top(roots[i])):
                    parent[x] = y
                    links.append((min(node, nodes[i]), max(node, nodes[i])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def crowds_of(mixed: DataFrame) -> DataFrame:
    """(node, crowd) of rows (node, cell): cells that share members make a crowd."""
    least = mixed.groupBy("cell").agg(F.min("node").alias("m"))
    return cut(connected_components(mixed.join(least, "cell"), "node", "m").withColumnRenamed("root", "crowd"))


def crowd_links(mixed: DataFrame, crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the components of rows (node, cell, root) as all pairs of the
    similarity within crowds do. Every pair of a crowd that is not in one component has an end
    outside the crowd's largest one; such rows are held against all of the crowd, in blocks,
    and each two blocks give only links that join components. The work grows with the number
    of such rows times the crowd; no rows do.
    """
    rows = cut(mixed.select("node", "root").distinct().join(crowds, "node").join(sets, "node"))
    facts = rows.groupBy("crowd", "root").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("size"))
    facts = facts.groupBy("crowd").agg(F.max(F.struct("n", "root", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    n, size, most = F.col("n"), F.col("size"), F.col("most")
    facts = facts.select("crowd", most["root"].alias("most"), blocks(n, size).alias("right"), blocks(n - most["n"], size - most["size"]).alias("left"))
    rows = rows.join(facts, "crowd")
    spread = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    names, key = ["crowd", "x", "y", "node", "root", "hashes"], ["crowd", "x", "y"]
    one = rows.where("root <> most").select("crowd", spread("left").alias("x"), each("right").alias("y"), *names[3:]).toDF(*names)
    two = rows.select("crowd", each("left").alias("x"), spread("right").alias("y"), *names[3:]).toDF(*names)
    return cut(one.groupBy(*key).cogroup(two.groupBy(*key)).applyInPandas(partial(_crossing, similarity=similarity), "a long, b long"))


def similar_links(docs: DataFrame, classes: DataFrame, words: int, similarity: float, dense: int = 32, crowd: int = 16_384) -> DataFrame:
    """(a, b): links that connect the same nodes as all pairs do that are in one cell and of
    the similarity asked for.

    Of a crowded cell all pairs would be too many. Its members are held against a head, which
    connects copies at little cost and rules out nothing. Crowds whose cells still have
    members of several components are compared whole (``crowd_links``). Crowds of over
    ``crowd`` members get deeper cells before that, which texts that only share a passage
    seldom have in common: of these again all pairs, a head, and the rest whole. So nothing
    is left over.
    """
    cells = classes.select("node", F.explode("cells").alias("cell"))
    pairs, crowded = _met(cells, dense)
    crowded = cut(crowded)
    inside = crowded.select("node").distinct()
    sets = shingle_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).union(inside), words)
    links = verified(pairs, sets, similarity)
    release(sets)
    if crowded.isEmpty():
        return links
    links = _starred(crowded, sets, links, similarity)
    mixed = _mixed(crowded, cut(connected_components(links)))
    if mixed.isEmpty():
        return links
    crowds = crowds_of(mixed)
    release(sets)
    sizes = crowds.groupBy("crowd").count()
    small = mixed.join(crowds.join(sizes.where(F.col("count") <= crowd), "crowd").select("node"), "node", "left_semi")
    links = links.union(crowd_links(small, crowds, sets, similarity))
    large = cut(mixed.join(crowds.join(sizes.where(F.col("count") > crowd), "crowd").select("node"), "node", "left_semi"))
    return links if large.isEmpty() else _deep_links(large, sets, links, similarity, dense)


def _deep_links(large: DataFrame, sets: DataFrame, links: DataFrame, similarity: float, dense: int) -> DataFrame:
    """``links`` with those of the members of large crowds, by deeper cells."""
    open_sets = cut(sets.join(large.select("node").distinct(), "node", "left_semi"))
    dealt = open_sets.repartition(open_sets.sparkSession.sparkContext.defaultParallelism, "node")
    pairs, crowded = _met(cut(map_arrow(dealt, partial(_deep_cells, bands=DEEP_BANDS, depth=DEEP_DEPTH), "node long, cell long")), dense)
    links = links.union(verified(_apart(pairs, cut(connected_components(links))), open_sets, similarity))
    mixed = _mixed(crowded, cut(connected_components(links)))
    links = _starred(mixed.select("node", "cell"), open_sets, links, similarity)
    release(sets)
    mixed = _mixed(mixed.select("node", "cell"), cut(connected_components(links)))
    return links if mixed.isEmpty() else links.union(crowd_links(mixed, crowds_of(mixed), open_sets, similarity))


def _linked(docs: DataFrame, words: int, similarity: float, max_distance: int, dense: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, key, fp) of every row, and what gives the links between fingerprints. Rows
    with the same doc_id and key hold the same text."""
    id_type = dict(docs.dtypes)["doc_id"]
    keyed = text_of(docs.withColumn("key", text_key()), "doc_id", "key")
    prints = cut(map_arrow(keyed, partial(_sketched, words=words), f"doc_id {id_type}, key long, fp long, node long, cells array<long>"))
    classes = node_classes(prints)
    near = similar_links(docs, classes, words, similarity, dense)
    release(docs)
    of = classes.select("node", "fp")
    by_print = near.join(of.toDF("a", "p"), "a").join(of.toDF("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return prints.select("doc_id", "key", "fp"), lambda firsts: fingerprint_links(firsts, max_distance).union(by_print.where("a <> b")).distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_distance: int = 4, dense: int = 32) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents are linked if their fingerprints differ in ``max_distance`` bits or fewer, or
    if their sets of shingles have a Jaccard similarity of ``similarity`` or more;
    component_id is the smallest doc_id that can be reached. Null text is empty text; texts
    without a word are linked to each other; repeated rows are kept; rows with a null
    doc_id are linked too. An empty table gives no rows; other columns are ignored.
    """
    return _grouped(*_linked(docs, words, similarity, max_distance, dense))


def first_of_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_distance: int = 4, dense: int = 32) -> DataFrame:
    """(doc_id, key, rows): of each group of ``similar_groups`` the row that comes first by
    doc_id, nulls last, then by the key of its text; and how many rows have both. Groups are
    told apart by their links alone, whatever ids are null or shared."""
    prints, links = _linked(docs, words, similarity, max_distance, dense)
    rows = prints.groupBy("fp", "doc_id", "key").count()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    firsts = cut(rows.groupBy("fp").agg(F.min(F.struct(order.alias("at"), "count")).alias("m")).select("fp", "m"))
    roots = connected_components(links(firsts.select("fp")))
    best = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("m").alias("m"))
    return best.select("m.at.doc_id", "m.at.key", F.col("m.count").alias("rows"))
