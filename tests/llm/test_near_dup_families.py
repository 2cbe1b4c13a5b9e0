"""Groups of copies that were edited apart, alike to just under the threshold: the same classes as all pairs give, from a few comparisons a member."""

import random

import numpy as np
import pytest

from weftgraph.llm import near_dup


def family(n, length, seed, edits=1):
    """n texts, each the same one with words of its own somewhere inside."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in range(edits):
            words[rng.randrange(6, length - 6)] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def classes_brute(spark, rows, similarity=0.8):
    idf = near_dup._document_frequencies(spark.createDataFrame(rows, "doc_id long, text string"), "text", 5)
    sets = [near_dup._weights(s, idf) for s in near_dup._shingles([near_dup._lower(t) for _, t in rows], 5)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near_dup.weighted_jaccard(sets[a], sets[b]) >= similarity:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("n,length,edits", [(120, 220, 1), (150, 270, 1), (90, 520, 2)])
def test_families_just_under_the_threshold(spark, monkeypatch, n, length, edits):
    rows = family(n, length, n, edits)
    compared, plain = [], near_dup.compare

    def counted(pairs, *more):
        compared.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(near_dup, "compare", counted)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_brute(spark, rows)
    assert sum(compared) < 6 * n


def test_centre_and_costs():
    """Two texts are similar if and only if their common differences from any centre weigh as much as their costs."""
    rng = np.random.default_rng(8)
    idf = np.ones(near_dup.BUCKETS, np.float32)
    kinds = np.sort(rng.choice(1 << 62, 60, replace=False).astype(np.uint64))
    sets = []
    for _ in range(12):
        held = rng.random(60) < 0.9
        sets.append((kinds[held], rng.integers(1, 4, held.sum()).astype(np.float32)))
    for picked in (sets[:1], sets[:6]):
        group = near_dup._Group(picked, idf, 0.8)
        for a in sets:
            for b in sets:
                ka, ca, cost_a = group._changes(a)
                kb, cb, cost_b = group._changes(b)
                _, i, j = np.intersect1d(ka, kb, return_indices=True)
                same = np.sign(ca[i]) == np.sign(cb[j])
                shared = np.minimum(np.abs(ca[i]), np.abs(cb[j]))[same].sum()
                margin = shared - cost_a - cost_b
                if abs(margin) > 1e-6:
                    assert (margin > 0) == (near_dup.weighted_jaccard(a, b) >= 0.8)


def test_keep_passes_any_column_on(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words are here now then", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumn("key", near_dup.F.lit(1)).withColumn("n", near_dup.F.lit(2))
    got = near_dup.keep(df)
    assert got.columns == df.columns and sorted((r.doc_id, r._key) for r in got.collect()) == [(1, "x"), (3, "z")]
