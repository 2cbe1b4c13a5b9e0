"""SimHash, exponion clustering and whitening against brute force, with awkward rows."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from weftgraph.llm import exponion, queries, simhash, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- SimHash


def bits_brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(rows, bits=4):
    """doc_id (by row) of each row's component, by all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def test_every_pair_within_reach_shares_a_key():
    rng = np.random.default_rng(5)
    code = simhash.Golay()
    near = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    far = near.copy()
    for i in range(len(far)):  # four flips in each way that they can fall on the segments
        first = rng.integers(0, 64)
        for bit in {first, *((first + rng.choice([1, 2, 3, 20, 21, 40], 3)) % 64)}:
            far[i] ^= np.array(1 << int(bit), np.uint64).view(np.int64)
    sets = []
    for fps in (near, far):
        own = [set() for _ in fps]
        for row, key in zip(*simhash.meeting_keys(fps, code)):
            own[row].add(int(key))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets))


@pytest.mark.parametrize("bucket", [512, 3])
def test_components_as_all_pairs_give_them(spark, bucket):
    """Groups of fingerprints a few flips apart, by keys alone and by midpoints."""
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b for b in base]
    for _ in range(250):
        f = rng.choice(fps)
        for _ in range(rng.randrange(1, 8)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)).collect()
    label = {r.node: r.label for r in got}
    want = components_brute(list(enumerate(fps)))
    groups = {}
    for i, _, c in want:
        groups.setdefault(c, set()).add(signed[i])
    mine = {}
    for f in signed:
        mine.setdefault(label.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_keys_are_shuffled_once_and_large_ones_pass_on(spark):
    """A key of more fingerprints than a task keeps is passed on whole, over many batches; the others give forests."""
    rows = [(1, f) for f in (0, 1, 255 << 40)] + [(2, f) for f in range(70_000)] + [(3, 7), (4, 8), (4, 9)]
    keyed = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "key long, fp long")
    met = simhash._within_keys(keyed, 512)
    got = met.collect()
    assert sorted(r.a for r in got if r.b is None) == list(range(70_000))
    assert sorted({r.a, r.b} for r in got if r.b is not None) == [{0, 1}, {8, 9}]
    assert met._jdf.queryExecution().sparkPlan().toString().count("Exchange") + met._jdf.queryExecution().optimizedPlan().toString().count("Repartition") <= 2


def test_simhash_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == components_brute([(i, bits_brute(t)) for i, t in rows])


def test_simhash_of_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "One"), (8, "oNE "), (None, "one"), (7, long), (6, long + " more"), (7, long), (None, "a b c d e f g"), (1, "É x y z")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, label string")
    got = sorted((tuple(r) for r in simhash.classes(df).collect()), key=str)
    assert got == components_brute([(i, bits_brute(t)) for i, t in rows])
    assert simhash.classes(df.limit(0)).count() == 0


# ---- exponion


def lloyd(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by plain loops over integers."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), a in zip(kept, at) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(x) for _, x in kept]
    sums = [sum(d for d, j in last if j == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums), digests[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def clustered(df):
    return sorted((tuple(r) for r in exponion.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, x int, upper double")


def awkward_vectors():
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) / 64 for _ in range(64)]) for i in range(150)]  # small grid: many ties
    same = [0.5] * 64
    return [*rows, *[(200 + i, same) for i in range(40)], (200, same), (200, same), (None, same), (7, None), (8, []), (9, [1.0] * 63), (10, [NAN, *[1.0] * 63]), (11, [INF, *[1.0] * 63]), (12, [None, *[1.0] * 63]), (13, [-0.001] * 64)]


def test_exponion_of_awkward_rows(spark):
    rows = awkward_vectors()
    assert clustered(vectors_frame(spark, rows)) == lloyd(rows)
    few = rows[:5]
    assert clustered(vectors_frame(spark, few)) == lloyd(few)
    assert clustered(vectors_frame(spark, [])) == []
    huge = exponion.cluster(vectors_frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)])).collect()
    assert {r.distance for r in huge} == {0}


def test_exponion_of_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert clustered(spark.read.parquet(f"{SF}/embeddings.parquet")) == lloyd(rows)


def test_search_finds_what_a_scan_finds_and_looks_at_less():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-30, 30, (400, 8)) + 400 * g for g in range(5)])
    now = x[rng.choice(len(x), 20, replace=False)]
    first = exponion.Centroids(now)
    state = first.scan(x)
    for _ in range(4):
        before, now = now, now + rng.integers(-3, 4, now.shape)
        moved = exponion.Centroids(now, before)
        *state, looked = moved.search(x, *state)
        every = np.stack([exponion.squares(x, c) for c in now])
        assert (state[0] == every.argmin(axis=0)).all()
        assert looked < 0.5 * every.size
        d = np.sqrt(np.sort(every, axis=0))
        assert (state[1] >= d[0]).all() and (state[2] <= d[1]).all()


# ---- whitening


def whitened_brute(vectors, components=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1], found[:, ::-1]
    return n, deviation, centred @ found[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def test_whitening_of_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, white, explained = whitened_brute([v for _, v in rows])
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, SF).collect()}
    assert len(got) == 8 * len(rows) and {r.n for r in got.values()} == {n}
    assert len({r.identity_error for r in got.values()}) == 1 and got[rows[0][0], 1].identity_error < 1e-9
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine * sign, white[:, k], atol=1e-7)
        assert abs(got[rows[0][0], k + 1].explained / explained[k] - 1) < 1e-9
    assert all(got[i, 1].deviation == d for (i, _), d in zip(rows, deviation))


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1), rng.gauss(0, 2), 5.0]) for i in range(50)]
    odd = [(60, None), (61, []), (62, [1.0, None, 2.0]), (63, [1.0, NAN, 2.0]), (64, [1.0, -INF, 2.0]), (65, [1.0, 2.0])]
    rows = [*good, (None, good[0][1]), (3, good[3][1]), *odd]
    got = whitening.whiten(vectors_frame(spark, rows)).collect()
    assert len(got) == 3 * 52 and {r.component for r in got} == {1, 2, 3}
    assert {r.whitened for r in got if r.component == 3} == {None}  # the third entry never varies
    assert all(r.identity_error < 1e-9 for r in got)
    n, deviation, _, _ = whitened_brute([v for _, v in rows[:52]])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, odd[:5])).count() == 0
    one = whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, None)] * 2
    huge = whitening.whiten(vectors_frame(spark, [(1, [3e38]), (2, [-3e38])])).collect()
    assert {r.deviation for r in huge} == {None} and sorted(r.whitened for r in huge) == [-1, 1]


def test_deviations_are_exact_beyond_64_bits_on_the_way():
    n, away, part = 3_000_000, np.array([[1 << 20, -(1 << 21)], [5, -7]]), np.array([2_999_999, 17])
    want = [sum((n * int(a) - int(p)) ** 2 for a, p in zip(row, part)) for row in away]
    assert whitening.deviations(away, part, n) == [w if w < 1 << 63 else None for w in want]
