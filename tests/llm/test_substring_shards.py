"""A shard's passages and automata, without Spark, against windows looked up one by one."""

import random

import numpy as np
import pytest

from weftgraph.llm import substring
from weftgraph.llm._words import Words, runs

WINDOW, PHRASE = 8, 3


def told_of(documents, single=lambda k: False, block=1):
    """What a shard is told: a row for every window that occurs twice, at one of its places, with its anchor or none."""
    places = {}
    for (d, h), words in documents.items():
        grams = runs(Words([b" ".join(words)]).hashes(), PHRASE)
        for at in range(len(words) - WINDOW + 1):
            places.setdefault(tuple(words[at : at + WINDOW]), []).append((d, h, at, int(grams[at : at + WINDOW - PHRASE + 1].argmin())))
    rows = []
    for k, found in enumerate(places.values()):
        if len(found) > 1:
            d, h, at, off = found[k // block % 2]
            rows.append((d, h, at, WINDOW, -1 if single(k) else off, *min(found)[:3]))
    return rows


def brute(documents, told):
    earliest = {tuple(documents[d, h][at : at + WINDOW]): place for d, h, at, _, _, *place in told}
    out = {}
    for (d, h), words in documents.items():
        gone = np.zeros(len(words), dtype=bool)
        for at in range(len(words) - WINDOW + 1):
            place = earliest.get(tuple(words[at : at + WINDOW]))
            if place is not None and place != [d, h, at]:
                gone[at : at + WINDOW] = True
        out[d, h] = gone.tolist()
    return out


def texts(seed):
    rng = random.Random(seed)
    long = [b"l%d" % rng.randrange(400) for _ in range(300)]
    documents = {(0, 5): long, (1, 5): list(long), (2, 5): [b"a"] * 30, (3, 5): long[:40] * 3, (4, 5): []}
    for d in range(5, 40):
        words = [b"w%d" % rng.randrange(30) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(280)
            words[rng.randrange(len(words) + 1) : 0] = long[a : a + rng.randrange(5, 120)]
        if words and d % 3 == 0:
            words[rng.randrange(len(words))] = b"edit"
        documents[d, -d] = words
    return documents


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("phrases", [4, 40_000])
def test_located(monkeypatch, seed, phrases):
    monkeypatch.setattr(substring, "PHRASES", phrases)
    documents = texts(seed)
    told = told_of(documents, single=lambda k: seed % 2 == 1 and k % 7 < 3)
    located = substring.Located(documents, told, WINDOW, PHRASE)
    got = {key: located.gone(*key) for key in documents}
    assert {k: [False] * len(documents[k]) if g is None else g.tolist() for k, g in got.items()} == brute(documents, told)


@pytest.mark.parametrize("seed", range(4))
def test_every_window_has_a_phrase_and_runs_are_joined(seed):
    documents = texts(seed)
    told = told_of(documents, single=lambda k: seed == 3 and k % 5 == 0, block=100)
    whole = list(substring._whole_passages(told, WINDOW, PHRASE))
    compiled, seen = 0, set()
    for d, h, at, size, *place, phrases in whole:
        compiled += len(phrases)
        for j in range(at, at + size - WINDOW + 1):
            seen.add((d, h, j, place[0], place[1], place[2] + j - at))
            assert any(j <= begin and end <= j + WINDOW for begin, end in phrases)
    assert seen == {(d, h, at, *place) for d, h, at, _, _, *place in told}
    assert len(whole) < len(told) / 4 and (seed == 3 or compiled < len(told) / 3)


def test_a_copy_is_one_passage_with_few_phrases():
    words = [b"w%d" % k for k in range(2000)]
    documents = {(0, 1): words, (1, 1): list(words)}
    told = told_of(documents, block=len(words))
    anchors = len({row[2] + row[4] for row in told})
    located = substring.Located(documents, told, WINDOW, PHRASE)
    assert len(located.passages) == 1 and sum(len(a) for a in located.automata) < 0.85 * anchors
    assert located.gone(0, 1) is None and located.gone(1, 1).all()
