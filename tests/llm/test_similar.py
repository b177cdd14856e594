"""Near duplicates by similarity against all pairs."""

import random

import numpy as np
import pytest

from lodestone.llm import similar, simhash

from .helpers import SCHEMA, WORDS, awkward, empty


def _shingles(text):
    return set(simhash.shingle_hashes(simhash._words(text or ""), 5).tolist())


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _families(rng, sizes):
    texts = []
    for size in sizes:
        base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 140))]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([20, 45, 60, 90]))):
                copy[at] = f"changed{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts


def _components(texts):
    sets, prints = [_shingles(t) for t in texts], [simhash.fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if _similarity(sets[a], sets[b]) >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 4:
                root = [root[a] if r == root[b] else r for r in root] if root[a] < root[b] else [root[b] if r == root[a] else r for r in root]
    return root


@pytest.mark.parametrize("dense", [32, 4])
def test_groups_as_of_all_pairs(spark, dense):
    rng = random.Random(5)
    texts = _families(rng, [0] * 15 + [1] * 10 + [3, 5, 8, 12, 20])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs, dense=dense).collect()}
    want = _components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 30 < len(set(want)) < len(texts) - 20


def test_cells_over_batches():
    """Whatever the batches, small cells give each pair once and crowded ones each member."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    cells = np.sort(np.repeat(np.arange(40), rng.integers(1, 12, 40)))
    nodes = np.arange(len(cells))
    for step in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(cells[i : i + step]), pa.array(nodes[i : i + step])], names=["cell", "node"]) for i in range(0, len(cells), step)]
        rows = [tuple(r.values()) for b in similar._cell_pairs(iter(batches), 5) for r in b.to_pylist()]
        pairs, crowded = [r for r in rows if r[0] != r[1]], {r for r in rows if r[0] == r[1]}
        size = {c: int((cells == c).sum()) for c in range(40)}
        assert sorted(pairs) == sorted((int(a), int(b), int(cells[a])) for a in nodes for b in nodes if a < b and cells[a] == cells[b] and size[int(cells[a])] <= 5)
        assert crowded == {(int(n), int(n), int(cells[n])) for n in nodes if size[int(cells[n])] > 5}


def test_awkward_tables(spark):
    docs = awkward(spark)
    rows = similar.similar_groups(docs).collect()
    assert len(rows) == docs.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[4] == 3 and of[1] == of[2] == of[11] == 0 and of[6] == 6
    assert similar.similar_groups(empty(spark)).count() == 0


def _edges(spark, texts, **more):
    """Links of similar_links by row, and the sets of shingles."""
    from functools import partial

    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    keyed = similar.text_of(docs.withColumn("key", similar.text_key()), "doc_id", "key")
    prints = similar.map_arrow(keyed, partial(similar._sketched, words=5), "doc_id long, key long, fp long, node long, cells array<long>")
    classes = similar.node_classes(prints)
    of = {r.node: r.rep.doc_id for r in classes.collect()}
    return [(of[r.a], of[r.b]) for r in similar.similar_links(docs, classes, 5, 0.8, **more).collect()], [_shingles(t) for t in texts]


def _parts(n, edges):
    root = list(range(n))
    for a, b in edges:
        root = [root[a] if r == root[b] else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == x) for x in set(root)}


def _all_pairs(sets):
    return [(a, b) for b in range(len(sets)) for a in range(b) if _similarity(sets[a], sets[b]) >= 0.8]


@pytest.mark.parametrize("crowd", [16_384, 10])
def test_pairs_among_texts_that_share_a_passage(spark, crowd):
    """Texts of one long passage crowd each other's cells; only the two of a family are similar.
    Whole crowds, and crowds by deeper cells first."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = words(108)
    texts = []
    for _ in range(250):
        shared = words(5)
        texts += [" ".join(passage + shared + words(13)) for _ in range(2)]
    got, sets = _edges(spark, texts, crowd=crowd)
    want = _all_pairs(sets)
    assert len(want) == 250
    assert _parts(len(texts), got) == _parts(len(texts), want)


def test_text_that_only_a_linked_copy_is_similar_to(spark):
    """A head, variants of it, and texts within 0.8 of a variant but not of the head."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**9)}"

    def changed(base, places):
        return [word() if i in places else w for i, w in enumerate(base)]

    head = [word() for _ in range(504)]
    variants = [changed(head, rng.sample(range(504), 2)) for _ in range(60)]
    far = [changed(v, range(at, at + 49)) for v, at in zip(variants[:45], range(0, 450, 10))]
    texts = [" ".join(x) for x in [head, *variants, *far]]
    got, sets = _edges(spark, texts)
    want = _all_pairs(sets)
    only = [i for i in range(61, len(texts)) if _similarity(sets[0], sets[i]) < 0.8 and any(i in w for w in want)]
    assert len(only) > 5
    assert _parts(len(texts), got) == _parts(len(texts), want)


def test_crowd_in_blocks(spark, monkeypatch):
    """Whatever the blocks, a crowd's components are those of all pairs, and links are few."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    texts = _families(rng, [0, 3, 9, 14, 2])
    sets = [_shingles(t) for t in texts]
    signed = lambda s: sorted(x - (1 << 64) if x >> 63 else x for x in s)
    frame = spark.createDataFrame([(i, signed(s)) for i, s in enumerate(sets)], "node long, hashes array<long>")
    mixed = spark.createDataFrame([(i, c, i if i > 2 else 0) for i in range(len(texts)) for c in (i // 3, i // 3 + 1)], "node long, cell long, root long")
    got = [(r.a, r.b) for r in similar.crowd_links(mixed, similar.crowds_of(mixed), frame, 0.8).collect()]
    known = [(0, 1), (0, 2)]
    assert _parts(len(texts), got + known) == _parts(len(texts), _all_pairs(sets) + known)
