"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words of one document.  A word goes if a window that covers it has a
word sequence that also starts earlier: in a smaller doc_id, or earlier in the same document.

1. Anchors.  Of the `phrase`-word runs in a window, the one with the smallest hash anchors it.  Equal
   windows have equal anchors, and neighbouring windows mostly share one, so an anchor stands for a
   segment: the words of the consecutive windows it governs.  About a ninth as many anchors as words
   leave the scan; those that occur twice are kept (a count with map-side combine, then a join that
   adaptive execution can split).
2. Confirmed passages.  Segments of recurring anchors (combined in each document shard) meet by anchor,
   or, where an anchor has more than `common` occurrences, window by window.  Runs of windows whose words
   occur twice are passages, each with its earliest place; the document shards that hold its segment are
   told where in their own documents it stands, so no words are sent back.
3. Automata.  A document shard holds about `shard_bytes` of text.  Passages that continue each other are
   joined, and of their phrases as few are kept as leave no window without one.  The shard compiles
   these with pyahocorasick into automata of bounded size and streams all its documents, whole, through
   them; wherever a phrase is found, the passage is followed to both sides as far as the words agree,
   once for all its phrases in that run.  So every document is streamed once for each automaton, of which
   most shards have one, and a shard's automata are bounded by its own text.
4. The words of located windows go, except at a passage's earliest place.

Defined results: a null text has no words; a null doc_id is the smallest; rows that repeat a doc_id
and its text are one document (all of them get its result), and different texts under one doc_id are
different documents, ordered by a hash of the text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from itertools import accumulate, chain, compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import STEP_BYTES, bounded_batches, checkpointed, slices
from weftgraph.llm._words import Words, ranges, run_starts, runs

#: Phrases that an automaton holds at most.
PHRASES = 40_000
#: Rows that a batch of results holds at most.
ROWS = 2000
NO_ID = -(1 << 63)
#: Characters that spell a word's number.
_DIGITS = 3


def _anchors(words: Words, hashes: np.ndarray, window: int, phrase: int):
    """Per governed run of windows: document, anchor hash (48 bits; a chance match only adds a candidate), first window (word index), number of windows, anchor (word index)."""
    if len(hashes) < window:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    grams = runs(hashes, phrase)
    span = window - phrase + 1
    at = np.arange(len(hashes) - window + 1)
    where = at + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    ok = run_starts(words.counts, window)[: len(at)]
    at, where, doc = at[ok], where[ok], words.documents()[: len(ok)][ok]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    return doc[begin], grams[where[begin]] >> np.uint64(16), at[begin], n, where[begin]


def _signed(h) -> np.ndarray:
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def _values(column) -> list:
    """A column without nulls as Python values; `to_pylist` makes an Arrow scalar of each first, which takes several times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(fields), fields.values())], list(fields))


SEGMENT = {"s": pa.int64(), "p": pa.int32(), "seg": pa.binary(), "off": pa.int32(), "d": pa.int64(), "h": pa.int64(), "at": pa.int32(), "n": pa.int64()}
PASSAGE = {"p": pa.int32(), "d": pa.int64(), "h": pa.int64(), "at": pa.int32(), "size": pa.int32(), "off": pa.int32(), "fd": pa.int64(), "fh": pa.int64(), "fat": pa.int32()}


def _fours(flat: array):
    return zip(*[iter(flat)] * 4)


def _confirmed(found: dict, window: int):
    """found: (segment, offset of the phrase, -1 for a single window) -> [earliest place, count, place in each shard].

    Yields (shard, place there, number of words, offset, earliest place) of the runs of windows that occur
    twice, with one earliest place.
    """
    if len(found) == 1:
        (seg, off), (place, n, shards) = next(iter(found.items()))
        if n > 1:
            size = seg.count(b" ") + 1
            yield from ((*own, size, off, *place) for own in _fours(shards))
        return
    split = {key: key[0].split(b" ") for key in found}
    #: Of each window its number, how often it occurs and its earliest place.
    known: dict[tuple, list] = {}
    of: dict[tuple, list] = {}
    for key, (place, n, _) in found.items():
        words, mine = split[key], []
        for j in range(len(words) - window + 1):
            here = (place[0], place[1], place[2] + j)
            w = known.setdefault(tuple(words[j : j + window]), [len(known), 0, here])
            w[1] += n
            if here < w[2]:
                w[2] = here
            mine.append(w)
        of[key] = mine
    # a shard gets each window once, whichever of its segments holds it
    sent: dict[int, set] = {}
    for key, (_, _, shards) in found.items():
        off, mine = key[1], of[key]
        if all(w[1] < 2 for w in mine):
            continue
        for p, d, h, at in _fours(shards):
            done = sent.setdefault(p, set())
            run = None
            for j in range(len(mine) + 1):
                w = mine[j] if j < len(mine) else None
                fresh = w is not None and w[1] > 1 and w[0] not in done
                if run is not None and not (fresh and w[2] == (run[1][0], run[1][1], run[1][2] + j - run[0])):
                    yield (p, d, h, at + run[0], j - 1 + window - run[0], off - run[0] if off >= 0 else -1, *run[1])
                    run = None
                if fresh:
                    done.add(w[0])
                    if run is None:
                        run = (j, w[2])


def _whole_passages(told, window: int, phrase: int):
    """told: (d, h, at, size, off, earliest place).  Yields (d, h, at, size, earliest place, phrases).

    Runs whose windows follow each other, in the document and at the earliest place, are one passage.  Its
    phrases are (begin, end) in the document: of the runs' own as few as leave no window without one.
    """
    now, phrases, end, free, held = None, [], 0, 0, -1  # free: first window without a phrase; held: the last anchor that it reaches
    for d, h, at, size, off, fd, fh, fat in sorted(told):
        key = (d, h, fd, fh, fat - at)
        if key != now or at != end - window + 1:
            if now is not None:
                if held >= 0:
                    phrases.append((held, held + phrase))
                yield *now[:2], begin, end - begin, *now[2:4], now[4] + begin, phrases
            now, begin, phrases, free, held = key, at, [], at, -1
        end = at + size
        if held >= 0 and (off < 0 or at + off > free + window - phrase):
            phrases.append((held, held + phrase))
            free, held = held + 1, -1
        if off >= 0:
            held = at + off
        elif at >= free:
            phrases.append((at, end))
            free = at + 1
    if now is not None:
        if held >= 0:
            phrases.append((held, held + phrase))
        yield *now[:2], begin, end - begin, *now[2:4], now[4] + begin, phrases


def _agreed(same, most: int) -> int:
    """The largest number of words up to `most` of which the first agree; same(lo, hi): do words lo to hi - 1?"""
    lo, step = 0, 4
    while lo < most:
        hi = min(lo + step, most) if step else (lo + most + 1) // 2
        if same(lo, hi):
            lo, step = hi, 2 * step
        else:
            most, step = hi - 1, 0
    return lo


class Located:
    """The automata of the passages of one shard, whose documents (d, h) -> words they are parts of.

    A word is three characters: the digits of its number, each place with an alphabet of its own.  So a
    node of an automaton has few children, which are searched one by one, and no match starts inside a word.
    """

    def __init__(self, documents: dict[tuple, list[bytes]], told, window: int, phrase: int):
        import ahocorasick

        self.window = window
        words = pa.array(list(chain.from_iterable(documents.values())), pa.large_binary()).dictionary_encode()
        numbers, bits, d = words.indices.to_numpy(), -(-len(words.dictionary).bit_length() // _DIGITS), _DIGITS
        digits = np.empty((len(numbers), d), dtype="<u2")
        for k in range(d):
            digits[:, k] = 0x100 + (k << bits) + (numbers >> bits * (d - 1 - k) & (1 << bits) - 1)
        text = digits.tobytes().decode("utf-16-le")
        ends = [0, *accumulate(d * len(of) for of in documents.values())]
        self.texts = {key: text[begin:end] for key, begin, end in zip(documents, ends, ends[1:])}
        self.passages, by_phrase = [], {}
        for pd, ph, at, size, *place, phrases in _whole_passages(told, window, phrase):
            text = self.texts[pd, ph]
            for begin, end in phrases:
                by_phrase.setdefault(text[begin * d : end * d], []).append((len(self.passages), begin - at))
            self.passages.append((text[at * d : (at + size) * d], size, *place))
        self.automata = []
        found = list(by_phrase.items())
        for at in range(0, len(found), PHRASES):
            automaton = ahocorasick.Automaton()
            for key, entries in found[at : at + PHRASES]:
                automaton.add_word(key, (len(key) // d, entries))
            automaton.make_automaton()
            self.automata.append(automaton)

    def gone(self, d: int, h: int) -> np.ndarray | None:
        """Which words of a document go; None if none does."""
        text, w = self.texts[d, h], _DIGITS
        total = len(text) // w
        edges: list[tuple[int, int]] = []
        for automaton in self.automata:
            #: Up to where a passage that would start at a word agrees.  Matches come by their ends, so a phrase that ends before is in that run.
            seen: dict[tuple, int] = {}
            for last, (n, entries) in automaton.iter(text):
                end = (last + 1) // w
                for number, off in entries:
                    start = end - n - off
                    if seen.get((number, start), -1) >= end:
                        continue
                    passage, size, fd, fh, fat = self.passages[number]
                    if fat == start and fd == d and fh == h:
                        continue
                    lo, hi = 0, size
                    if start < 0 or not text.startswith(passage, start * w):
                        x, y = end - n, off
                        lo = off - _agreed(lambda a, b: text[(x - b) * w : (x - a) * w] == passage[(y - b) * w : (y - a) * w], min(x, y))  # noqa: B023
                        x, y = end, off + n
                        hi = y + _agreed(lambda a, b: text[(x + a) * w : (x + b) * w] == passage[(y + a) * w : (y + b) * w], min(total - x, size - y))  # noqa: B023
                    seen[number, start] = start + hi
                    if hi - lo >= self.window:
                        edges.append((start + lo, start + hi))
        if not edges:
            return None
        edge = np.zeros(total + 1, dtype=np.int64)
        begin, end = np.array(edges).T
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge)[:-1] > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, phrase: int = 4, common: int = 2000, shard_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and kept_sha256 of every row."""
    spark = df.sparkSession
    bounded_batches(spark)
    text, d = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), F.col(f"`{id_col}`").cast("long")
    # 32 bits tell the texts of one doc_id apart; rows without one need all 64
    rows = df.select(F.coalesce(d, F.lit(NO_ID)).alias("d"), F.when(d.isNull(), F.xxhash64(text)).otherwise(F.shiftright(F.xxhash64(text), 32)).alias("h"), text.alias("t"))
    repeated = checkpointed(rows.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    again = not repeated.isEmpty()
    if again:
        rows = rows.join(repeated, ["d", "h"], "left_anti").unionByName(rows.join(repeated, ["d", "h"], "left_semi").dropDuplicates(["d", "h"]))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(math.ceil(size / shard_bytes), 4 * spark.sparkContext.defaultParallelism)
    shard = F.pmod(F.hash("d", "h"), F.lit(shards)).alias("p")
    docs = rows.select(shard, "d", "h", "t")

    def anchors(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                words = Words(_values(part.column("t")))
                doc, a, at, _, _ = _anchors(words, words.hashes(), window, phrase)
                of = pa.array(doc)
                keys = {c: part.column(c).take(of) for c in part.schema.names if c != "t"}
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), **keys, **({"at": pa.array((at - words.first[doc]).astype(np.int32))} if keys else {})})

    places = rows.select("d", "h", "t").mapInArrow(anchors, "a long, d long, h long, at int")
    # a table of its own, so that both sides of the join are plain exchanges, which AQE can split where an anchor is hot
    often = checkpointed(rows.select("t").mapInArrow(anchors, "a long").groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a", (F.col("n") > common).alias("big")), "anchors")
    chosen = places.join(often, "a").select(shard, "d", "h", "at", "big")

    def segments(mine: pa.Table, picked: pa.Table) -> pa.Table:
        """The segments of a document shard that a recurring anchor governs: each with its earliest place and its count."""
        held: dict = {}
        if picked.num_rows:
            ds, hs, texts = (_values(mine[c]) for c in ("d", "h", "t"))
            p = mine["p"][0].as_py()
            index = {key: i for i, key in enumerate(zip(ds, hs))}
            marks: dict[int, list] = {}
            for key, at, big in zip(zip(_values(picked["d"]), _values(picked["h"])), _values(picked["at"]), _values(picked["big"])):
                marks.setdefault(index[key], []).append((at, big))
            todo, step, size = sorted(marks), [], 0
            for i in [*todo, None]:
                if i is None or size >= STEP_BYTES:
                    add_segments(held, p, [texts[j] for j in step], [marks[j] for j in step], [(ds[j], hs[j]) for j in step])
                    step, size = [], 0
                if i is not None:
                    step.append(i)
                    size += len(texts[i])
        return pa.Table.from_batches([_batch([(s, p, seg, off, *place, n) for (s, seg, off), (p, place, n) in held.items()], SEGMENT)])

    def add_segments(held, p, texts, marks, ids):
        words = Words(texts)
        hashes = words.hashes()
        doc, a, at, n, where = _anchors(words, hashes, window, phrase)
        state = np.zeros(len(words.starts) + 1, dtype=np.int8)
        for i, of in enumerate(marks):
            first = int(words.first[i])
            for x, big in of:
                state[first + x] = 2 if big else 1
        chosen_as = state[at]
        few, many = np.flatnonzero(chosen_as == 1), np.flatnonzero(chosen_as == 2)
        some = zip(doc[few].tolist(), a[few].view(np.int64).tolist(), at[few].tolist(), n[few].tolist(), (where[few] - at[few]).tolist())
        singles = np.repeat(at[many] - np.cumsum(n[many]) + n[many], n[many]) + np.arange(int(n[many].sum()))
        whole = ranges(hashes, singles, singles + window) if len(singles) else singles
        more = ((i, s, lo, 1, -1) for i, s, lo in zip(np.repeat(doc[many], n[many]).tolist(), whole.view(np.int64).tolist(), singles.tolist()))
        for found in (some, more):
            for i, s, lo, length, off in found:
                place = (*ids[i], lo - int(words.first[i]))
                key = (s, words.joined(lo, lo + length + window - 1), off)
                old = held.get(key)
                held[key] = (p, place, 1) if old is None else (p, min(old[1], place), old[2] + 1)

    def confirm(batches):
        """Rows come sorted by anchor (or window) hash and segment; whole anchors are settled together."""

        def sorted_rows():
            for b in batches:
                yield from zip(*map(_values, b.columns))

        out: list[tuple] = []
        for _, group in groupby(sorted_rows(), key=lambda r: r[0]):
            found: dict = {}
            for _, p, seg, off, d, h, at, n in group:
                old = found.get((seg, off))
                if old is None:
                    found[seg, off] = [(d, h, at), n, array("q", (p, d, h, at))]
                else:
                    old[0], old[1] = min(old[0], (d, h, at)), old[1] + n
                    old[2].extend((p, d, h, at))
            for row in _confirmed(found, window):
                out.append(row)
                if len(out) >= ROWS:
                    yield _batch(out, PASSAGE)
                    out = []
        yield _batch(out, PASSAGE)

    ddl = lambda fields: ", ".join(f"{n} { {pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'}[t]}" for n, t in fields.items())
    by_shard = docs.groupBy("p")  # both uses read the same exchange of the texts
    found = by_shard.cogroup(chosen.groupBy("p")).applyInArrow(segments, ddl(SEGMENT))
    passages = found.repartition("s").sortWithinPartitions("s", "seg").mapInArrow(confirm, ddl(PASSAGE))

    def remove(mine: pa.Table, known: pa.Table) -> pa.Table:
        words_of = dict(zip(zip(_values(mine["d"]), _values(mine["h"])), map(bytes.split, _values(mine["t"]))))
        located = Located(words_of if known.num_rows else {}, zip(*(_values(known[c]) for c in PASSAGE if c != "p")), window, phrase)
        out = []
        for (d, h), words in words_of.items():
            gone = located.gone(d, h) if located.automata and len(words) >= window else None
            kept = b" ".join(words if gone is None else compress(words, (~gone).tolist()))
            out.append((d, h, len(words), 0 if gone is None else int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        kinds = {"d": pa.int64(), "h": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string()}
        return pa.Table.from_batches([_batch(out, kinds)])

    done = by_shard.cogroup(passages.groupBy("p")).applyInArrow(remove, "d long, h long, n_words long, n_removed long, kept string, kept_sha256 string")
    if again:
        done = done.join(repeated, ["d", "h"], "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))))
    return done.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")
