"""Line dedup, substring dedup, near-dedup and decontamination against brute force, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import decontam, line_dedup, near_dup, substring
from weftgraph.llm._words import PUNCT, Words

SCHEMA = "doc_id long, text string, kept string, d string, _id int"  # the last three clash with names used inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], SCHEMA)


def lines_brute(rows, size=3):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for at in range(len(lines) - size + 1):
            w = tuple(lines[at : at + size])
            if w in seen:
                gone |= set(range(at, at + size))
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def words_brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            if w in seen:
                gone |= set(range(at, at + window))
            seen.add(w)
        out[i] = (len(words), len(gone), b" ".join(x for k, x in enumerate(words) if k not in gone).decode())
    return out


def some_texts(seed, sep):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(60):
        words = [rng.choice("abc") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(30)
            words[rng.randrange(len(words) + 1) : 0] = passage[a : a + rng.randrange(3, 30)]
        rows.append((i, sep.join(words)))
    return [*rows, (60, rows[3][1]), (61, ""), (62, None), (63, sep.join(["same"] * 50)), (64, "é" + sep + "ß"), (65, sep.join(passage * 200))]


@pytest.mark.parametrize("seed", range(2))
def test_lines(spark, seed):
    rows = some_texts(seed, "\n")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == {i: v for i, v in lines_brute(rows).items()}


def test_lines_repeated_rows_and_null_id(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (2, "other")]
    got = sorted((str(r.doc_id), r.n_removed) for r in line_dedup.dedup(frame(spark, rows)).collect())
    assert got == [("1", 3), ("1", 3), ("2", 0), ("2", 3), ("None", 0)]


@pytest.mark.parametrize("seed,common", [(0, 2000), (1, 2000), (2, 2)])
def test_substrings(spark, seed, common):
    rows = some_texts(seed, " ")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(frame(spark, rows), window=8, phrase=3, common=common).collect()}
    assert got == words_brute(rows, 8)


def test_substrings_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, [(None, text), (4, text), (4, text), (5, text + " end"), (6, None)])).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [("4", 25, sha("")), ("4", 25, sha("")), ("5", 25, sha("end")), ("6", 0, sha("")), ("None", 0, sha(text))]


def near_brute(rows, words=5, similarity=0.8):
    shingles = [near_dup._shingles([near_dup._lower(t)], words)[0] for _, t in rows]
    df = np.zeros(near_dup.BUCKETS)
    for s in shingles:
        df[np.unique(near_dup._bucket(s))] += 1
    idf = (1 + np.log((1 + len(rows)) / (1 + df))).astype(np.float32)
    weights = [near_dup._weights(s, idf) for s in shingles]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(weights[i][0]) and near_dup.weighted_jaccard(weights[i], weights[j]) >= similarity):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, []).append(rows[k][0])
    return {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 200))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(90, ""), (91, None), (92, "two words"), (93, "Two words"), (94, "x" * 20000), (95, rows[0][1])]
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.classes(frame(spark, [])).count() == 0
    assert [(r.class_id, r.class_size) for r in near_dup.classes(frame(spark, [(7, None), (7, None), (None, "")])).collect()] == [(7, 3)] * 3


def held_brute(rows, items, ratio=0.2):
    out = set()
    hashes = lambda t: Words([(t or "").lower().encode()], PUNCT).hashes().tolist()
    for i, t in rows:
        words = hashes(t)
        for k, item in items:
            want = hashes(item)
            most = int(len(want) * ratio + 1e-9)
            if want and any(decontam.edits(words[s : s + len(want)], want, most) <= most for s in range(len(words))):
                out.add((i, k))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randrange(12, 45)))) for k in range(12)] + [(90, None), (91, "..."), (92, "lone")]
    rows = []
    for i in range(60):
        words = [f"z{rng.randrange(500)}" for _ in range(rng.randrange(5, 80))]
        if i % 2:
            inside = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(inside))
                inside[at : at + rng.randrange(2)] = [f"e{rng.randrange(99)}"][: rng.randrange(2)]
            words[len(words) // 2 : 0] = inside
        rows.append((i, ", ".join(words).upper()))
    rows += [(60, ""), (61, None), (62, "a LONE word"), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = held_brute(rows, items)
    for block in (5000, 4):
        got = {(r.doc_id, x.item_id) for r in decontam.matches(frame(spark, rows), benchmark, block=block).collect() for x in r["items"]}
        assert got <= want and len(got) >= 0.97 * len(want)
    kept = {r.doc_id for r in decontam.keep(frame(spark, rows), benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.matches(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_more_tables_for_more_recall():
    few, many = decontam.tables_for(20, 4, 0.9, 2), decontam.tables_for(20, 4, 0.999, 2)
    assert 1 == decontam.tables_for(4, 0, 0.99, 2) < few < many < decontam.tables_for(200, 40, 0.999, 2)


@pytest.mark.parametrize("a,b,most,want", [([1, 2, 3], [1, 3], 2, 1), ([], [1], 1, 1), ([1], [2], 0, 1), ([1, 2, 3, 4], [4, 3, 2, 1], 1, 2)])
def test_edits(a, b, most, want):
    assert decontam.edits(a, b, most) == want
