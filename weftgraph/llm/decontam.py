"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

A document holds an item of n words if some window of n words (fewer at its end) is within
floor(ratio * n) word edits of the item.  Words are lower-case runs of letters, digits and non-ASCII
characters.

1. Windows worth embedding: n words within k edits of an item share at least n - q + 1 - k*q of its
   q-word runs (the q-gram lemma), on diagonals at most k apart.  Runs are looked up by hash, so
   windows that cannot match are never embedded and none that can is lost.
2. CGK: a random walk copies a word to the output and moves on or stays by a random bit of (step,
   word); close windows walk together again soon after an edit, so edit distance becomes Hamming
   distance.  Each repetition has its own walk.
3. Bit sampling: a table has a walk of its own and samples `bits` output places.  How many tables reach
   the target recall depends on an item's length, as long walks part for longer; it is measured for each
   class of lengths on random items with as many edits as are allowed (`tables_for`).
4. A window that shares a table's key with its item is verified by the exact edit distance.

Items of so few words that no edit is allowed are looked up whole.  Items with the same words are one.

The benchmark is read in blocks of `block` items, each a bounded broadcast, so its size is no limit.
Defined results: null and empty texts hold nothing, items without words match nothing; repeated rows
repeat; a null doc_id stays null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import filter_texts, map_texts
from weftgraph.llm._words import PUNCT, Words, mix, run_starts, runs

#: Numbers that an embedding holds at once.
CELLS = 4_000_000


def edits(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance of two word sequences; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        old, row = row, [big] * (len(b) + 1)
        if lo == 1:
            row[0] = i
        for j in range(lo, hi + 1):
            row[j] = old[j - 1] if x == b[j - 1] else 1 + min(old[j - 1], old[j], row[j - 1])
        if min(row[lo - 1 : hi + 1]) > most:
            return big
    return min(row[len(b)], big)


def length_class(n: int) -> int:
    """The length that stands for n: the next of 8, 11, 15, 20, 27, ... (a third more each)."""
    c = 8
    while c < n:
        c = c * 4 // 3 + 1
    return c


def keys(windows: np.ndarray, lengths: np.ndarray, nominal: np.ndarray, tables: int, bits: int, seed: int = 5) -> np.ndarray:
    """(windows, tables): the key of each window in each table, by that table's walk and places.

    windows: word hashes (rows, n), 0 after the end; nominal: length of the item, which fixes the sampled places.
    """
    rng = np.random.default_rng(seed)
    steps = int(2 * nominal.max())
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
    # drawn table by table, so that more tables or longer items change no earlier draw
    salts, where = rng.integers(1, 1 << 63, tables, dtype=np.uint64), np.random.default_rng(seed + 1).random((tables, bits))
    out = np.empty((len(windows), tables), np.uint64)
    rows = max(1, CELLS // (tables * steps))
    for begin in range(0, len(windows), rows):
        part, ends = padded[begin : begin + rows], lengths[begin : begin + rows, None]
        row = np.arange(len(part))[:, None]
        at = np.zeros((len(part), tables), np.int64)
        path = np.empty((steps, len(part), tables), np.uint64)
        for j in range(steps):
            word = part[row, np.minimum(at, ends)]
            path[j] = word
            at += (mix(word ^ mix(salts + np.uint64(j))) & np.uint64(1)).astype(np.int64)
        key = np.broadcast_to(np.arange(tables, dtype=np.uint64), (len(part), tables))
        for b in range(bits):
            # the walk moves every second step: sample where both are still inside their words
            place = (where[None, :, b] * 1.8 * nominal[begin : begin + rows, None]).astype(np.int64)
            key = mix(key * np.uint64(31) + path[place, row, np.arange(tables)[None, :]])
        out[begin : begin + rows] = key
    return out


def edited(words: np.ndarray, k: int, rng) -> np.ndarray:
    """Words after k random edits: replaced, left out or put in."""
    out = words.tolist()
    for _ in range(k):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        new = [int(rng.integers(1, 1 << 63))] if kind != 1 else []
        out[at : at + (kind != 2)] = new
    return np.array(out, dtype=np.uint64)


def tables_for(n: int, k: int, recall: float, bits: int, trials: int = 40, probe: int = 192) -> int:
    """Tables with which a window of n words at k random edits shares a key with its item as often as `recall` asks, by simulation."""
    if not k:
        return 1
    rng = np.random.default_rng(n)
    items = rng.integers(1, 1 << 63, (trials, n), dtype=np.uint64)
    near = [edited(x, k, rng)[:n] for x in items]
    square = np.zeros((trials, n), np.uint64)
    for i, w in enumerate(near):
        square[i, : len(w)] = w
    nominal = np.full(trials, n)
    same = keys(items, nominal, nominal, probe, bits) == keys(square, np.array([len(w) for w in near]), nominal, probe, bits)
    p = (same.sum(axis=1) + 0.5) / (probe + 1)
    tables = 1
    while (1 - (1 - p) ** tables).mean() < recall:
        tables += 1 + tables // 16
    return tables


def plan_tables(lengths, ratio: float, recall: float, bits: int) -> dict[int, int]:
    """Number of tables of each class of lengths that occurs."""
    return {c: tables_for(c, math.floor(c * ratio + 1e-9), recall, bits) for c in sorted({length_class(n) for n in lengths if math.floor(n * ratio + 1e-9)})}


def lengths_of(texts: list[str | None]) -> np.ndarray:
    return Words([(t or "").lower().encode() for t in texts], PUNCT).counts


class Items:
    """Index of one block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], tables: dict[int, int], ratio: float, bits: int):
        words = Words([(t or "").lower().encode() for _, t in rows], PUNCT)
        hashes = words.hashes()
        self.bits = bits
        # items with the same words are one, with all their ids
        own: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.words: list[np.ndarray] = []
        for i, (item_id, _) in enumerate(rows):
            w = hashes[words.first[i] : words.first[i + 1]]
            if len(w):
                at = own.setdefault(w.tobytes(), len(own))
                if at == len(self.ids):
                    self.ids.append([])
                    self.words.append(w)
                self.ids[at].append(item_id)
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.k = np.floor(self.n * ratio + 1e-9).astype(np.int64)
        self.q = np.clip((self.n - self.k) // (self.k + 1), 1, 4)
        self.least = np.maximum(1, self.n - self.q + 1 - self.k * self.q)
        self.whole = {n: {int(runs(self.words[i], n)[0]): i for i in np.flatnonzero((self.k == 0) & (self.n == n))} for n in sorted(set(self.n[self.k == 0].tolist()))}
        self.seeds = {}
        for q in sorted(set(self.q[self.k > 0].tolist())):
            found = [(h, i, o) for i in np.flatnonzero((self.q == q) & (self.k > 0)) for o, h in enumerate(runs(self.words[i], q).tolist())]
            found.sort()
            h, item, offset = (np.array(c, t) for c, t in zip(zip(*found), (np.uint64, np.int64, np.int64)))
            bits_of = np.zeros(1 << 20, dtype=bool)
            bits_of[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[q] = (h, item, offset, bits_of)
        self.tables = np.array([tables[length_class(n)] if k else 0 for n, k in zip(self.n, self.k)], dtype=np.int64)
        self.keys: list = [None] * len(self.words)
        for t in sorted(set(self.tables.tolist()) - {0}):
            mine = np.flatnonzero(self.tables == t)
            for i, key in zip(mine, self.embed([self.words[i] for i in mine], self.n[mine], t)):
                self.keys[i] = key

    def embed(self, windows: list[np.ndarray], nominal: np.ndarray, tables: int) -> np.ndarray:
        lengths = np.array([len(w) for w in windows])
        square = np.zeros((len(windows), int(lengths.max())), np.uint64)
        for i, w in enumerate(windows):
            square[i, : len(w)] = w
        return keys(square, lengths, nominal, tables, self.bits)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, item and offset in the item of every run of words that an item has too."""
        out = []
        for q, (h, item, offset, bits_of) in self.seeds.items():
            grams = runs(hashes, q)
            maybe = np.flatnonzero(bits_of[(grams >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(h, grams[maybe], "left"), np.searchsorted(h, grams[maybe], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out.append((np.repeat(maybe, n), item[at], offset[at]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def exact(self, words: Words, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each item that must be found whole."""
        out = []
        for n, index in self.whole.items():
            grams = runs(hashes, n)
            known = np.array(sorted(index), dtype=np.uint64)
            at = np.flatnonzero(np.isin(grams, known) & run_starts(words.counts, n)[: len(grams)])
            doc = np.searchsorted(words.first, at, "right") - 1
            which = np.searchsorted(known, grams[at])
            _, first = np.unique(doc * len(known) + which, return_index=True)
            out += [(int(doc[j]), index[int(grams[at[j]])], int(at[j] - words.first[doc[j]]), 0) for j in first]
        return out

    def enough(self, at: np.ndarray, diagonals: np.ndarray, starts: np.ndarray, i: int, end: int) -> np.ndarray:
        """Starts at which enough runs of the item stand near their places; `at` is sorted."""
        n, k, q = int(self.n[i]), int(self.k[i]), int(self.q[i])
        _, begin = np.unique(at, return_index=True)
        need = np.minimum(self.least[i], np.maximum(1, end - starts - q + 1 - k * q))
        ok = np.zeros(len(starts), dtype=bool)
        for a in range(0, len(starts), max(1, CELLS // len(at))):
            s = starts[a : a + max(1, CELLS // len(at)), None]
            near = (np.abs(diagonals - s) <= k) & (at >= s) & (at + q <= s + n)
            ok[a : a + len(s)] = np.add.reduceat(near, begin, axis=1).astype(bool).sum(axis=1) >= need[a : a + len(s)]
        return ok

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits) of each item that a text holds."""
        words = Words(texts, PUNCT)
        hashes = words.hashes()
        out = self.exact(words, hashes)
        pos, item, offset = self.hits(hashes)
        if not len(pos):
            return out
        doc = np.searchsorted(words.first, pos, "right") - 1
        inside = pos + self.q[item] <= words.first[doc + 1]
        pos, item, offset, doc = pos[inside], item[inside], offset[inside], doc[inside]
        order = np.lexsort((pos, item, doc))
        pos, item, offset, doc = pos[order], item[order], offset[order], doc[order]
        last = np.arange(len(pos)) + self.least[item] - 1
        ok = last < len(pos)
        ok[ok] = (doc[last[ok]] == doc[ok]) & (item[last[ok]] == item[ok]) & (pos[last[ok]] - pos[ok] <= self.n[item[ok]])
        if not ok.any():
            return out
        pairs = np.unique(np.stack([doc[ok], item[ok]], axis=1), axis=0)
        group = doc * len(self.n) + item
        todo = []
        for d, i in pairs.tolist():
            a, b = np.searchsorted(group, [d * len(self.n) + i, d * len(self.n) + i + 1])
            first, end, k = int(words.first[d]), int(words.first[d + 1]), int(self.k[i])
            diagonals, at = (pos - offset)[a:b], pos[a:b]
            kinds, votes = np.unique(diagonals, return_counts=True)
            starts = np.unique(np.clip((kinds[:, None] + np.arange(-k, k + 1)).reshape(-1), first, end - 1))
            starts = starts[self.enough(at, diagonals, starts, i, end)]
            place = np.minimum(np.searchsorted(kinds, starts), len(kinds) - 1)
            likely = np.where(kinds[place] == starts, votes[place], 0)
            todo.append((d, i, starts[np.lexsort((starts, -likely))].tolist()))
        for likely in (True, False):
            left = []
            ask = [(d, i, s) for d, i, starts in todo for s in (starts[:1] if likely else starts[1:])]
            ask.sort(key=lambda x: self.tables[x[1]])
            for begin in range(0, len(ask), 20_000):
                some = ask[begin : begin + 20_000]
                for t in sorted({int(self.tables[i]) for _, i, _ in some}):
                    part = [x for x in some if self.tables[x[1]] == t]
                    cut = [hashes[s : min(s + int(self.n[i]), int(words.first[d + 1]))] for d, i, s in part]
                    which = np.array([i for _, i, _ in part])
                    same = (self.embed(cut, self.n[which], t) == np.stack([self.keys[i] for i in which])).any(axis=1)
                    for (d, i, s), w, hit in zip(part, cut, same):
                        if hit and (e := edits(w.tolist(), self.words[i].tolist(), int(self.k[i]))) <= self.k[i]:
                            left.append((d, i, s - int(words.first[d]), e))
            best: dict = {}
            for d, i, s, e in left:
                best[d, i] = min(best.get((d, i), (e, s)), (e, s))
            out += [(d, i, s, e) for (d, i), (e, s) in best.items()]
            todo = [t for t in todo if (t[0], t[1]) not in best]
        return out


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, block: int, ratio: float, recall: float, bits: int):
    """The benchmark in broadcasts of about `block` items, each with the tables that its lengths need.

    Rows that repeat are one; items with equal texts differ in their ids and so are dealt out.
    """
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).distinct()
    blocks = max(1, math.ceil(items.count() / block))
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [tuple(r) for r in mine.collect()]
        yield benchmark.sparkSession.sparkContext.broadcast((rows, plan_tables(lengths_of([t for _, t in rows]).tolist(), ratio, recall, bits)))


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.2, recall: float = 0.99, bits: int = 2, block: int = 5000) -> DataFrame:
    """doc_id, items: array of (item_id, start_word, edits), for every row that holds an item (per block of the benchmark)."""
    parts = []
    for rows in _blocks(benchmark, item_id_col, item_text_col, block, ratio, recall, bits):

        def step(ids, texts, index):
            found: dict[int, list] = {}
            for d, i, s, e in index.find([(t or "").lower().encode() for t in texts.to_pylist()]):
                found.setdefault(d, []).extend({"item_id": item, "start_word": s, "edits": e} for item in index.ids[i])
            return [ids, [found.get(d, []) for d in range(len(ids))]]

        parts.append(map_texts(df, id_col, text_col, step, "doc_id long, items array<struct<item_id:long,start_word:long,edits:int>>", lambda rows=rows: Items(*rows.value, ratio, bits)))
    return reduce(DataFrame.union, parts).where(F.size("items") > 0)


def keep(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.2, recall: float = 0.99, bits: int = 2, block: int = 5000) -> DataFrame:
    """Rows of df that hold no benchmark item."""
    for rows in _blocks(benchmark, item_id_col, item_text_col, block, ratio, recall, bits):

        def decide(texts, index):
            held = {d for d, *_ in index.find([(t or "").lower().encode() for t in texts.to_pylist()])}
            return [d not in held for d in range(len(texts))]

        df = filter_texts(df, text_col, decide, lambda rows=rows: Items(*rows.value, ratio, bits))
    return df
