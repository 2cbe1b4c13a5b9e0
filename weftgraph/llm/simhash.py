"""SimHash near-dedup with Golay-code fuzzy hashing.

1. A fingerprint has a bit for each bit of the 64-bit hashes of a text's shingles, set if more than half of
   them have it.  Texts with equal fingerprints are one from here on.
2. The perfect Golay code [23, 12, 7] puts every 23-bit word within 3 bits of one codeword.  The keys of a
   word are the indices of all codewords within 4 bits: one if the word is nearer than 3 to a codeword, else
   six.  Two words at most 2 bits apart have a word between them that is at most 1 bit from each; its codeword
   is within 4 of both.  So they share a key.
3. A fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ in 4 bits at most,
   either no segment has more than 2 of them, and the segments' keys agree at once (36 bits); or one has 3 or
   more, the other two share 1 at most, so one of these is equal and the other agrees by a key (33 or 34 bits).
   Thus every link is met under some key, with up to 6 * 6 * 6 + 6 * 6 keys a fingerprint.
4. Fingerprints that meet under a key are verified by counting bits.  All keys are shuffled once and read in
   order.  A key of up to BUCKET fingerprints is handled whole and gives a spanning forest of its links, not its pairs.  The fingerprints of larger keys
   are joined by midpoints instead: all words within 2 bits of a fingerprint (2081 of them).  Two fingerprints
   share a midpoint if and only if they differ in 4 bits at most, and none can have more than 2081
   fingerprints around it, so each links those around it to the smallest.  Both ways find every link's
   component, and both cost in proportion to the fingerprints.
5. Connected components are named by their smallest doc_id.

Defined results: null, empty and blank texts have fingerprint zero.  Repeated rows are rows each.
component_id is null only where all rows of a component have null identifiers.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import bounded_batches, checkpointed, map_texts
from weftgraph.llm.near_dup import components

#: Bits that may differ; the pigeonhole below is made for this number.
BITS = 4
#: Generator polynomial of the [23, 12, 7] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Lowest bit and length of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of a key that are compared with each other.
BUCKET = 512
#: Fingerprints whose keys one task makes, about 180 for each.
DEALT = 20_000
_SOME = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text whose A-Z are lowered."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    last = max(len(parts) - words + 1, 1)
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    starts = [0, *(ends[: last - 1] + 1).tolist()]
    counts = np.zeros(64, np.int64)
    for at in range(0, last, _SOME):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + _SOME], stops[at : at + _SOME])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def step(ids, texts):
        got = [fingerprint(t or b"", words, seed) for t in texts.to_pylist()]
        return [ids, pa.array(np.array(got, dtype=np.uint64).view(np.int64))]

    return map_texts(df, id_col, text_col, step, "doc_id long, fp long", as_binary=True)


class Golay:
    """Tables of the code: for each remainder the error, and the codewords near a word with that error."""

    def __init__(self):
        high = np.arange(1 << 12, dtype=np.int64) << 11
        rest = high.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
        self.parity = rest  # remainder of a word whose low 11 bits are zero
        words = high | rest
        ones = 1 << np.arange(23, dtype=np.int64)
        pairs = [a | b for i, a in enumerate(ones) for b in ones[:i]]
        triples = [a | b for i, a in enumerate(pairs) for b in ones if b > a and not a & b and b > (a & -a)]
        errors = np.unique(np.array([0, *ones, *pairs, *triples], dtype=np.int64))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.remainder(errors)] = errors
        sevens = words[np.bitwise_count(words) == 7]
        self.near = np.zeros((1 << 11, 6), np.int64)  # to be added to the nearest codeword
        self.count = np.ones(1 << 11, np.int64)
        for s in np.flatnonzero(np.bitwise_count(self.error) == 3):
            self.near[s, 1:] = sevens[(sevens & self.error[s]) == self.error[s]]
            self.count[s] = 6

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.parity[words >> 11] ^ (words & 0x7FF)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within 4 bits of each word (a row of six), and how many there are."""
        s = self.remainder(words)
        return ((words ^ self.error[s])[:, None] ^ self.near[s]) >> 11, self.count[s]


def meeting_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row of a fingerprint and key, for all keys of all fingerprints; a key's three upper bits tell its kind."""
    fps = fps.view(np.uint64)
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near, counts = zip(*(code.keys(p) for p in parts))
    rows, keys = [], []

    def add(held: np.ndarray, key: np.ndarray) -> None:
        at = np.flatnonzero(held)
        rows.append(at)
        keys.append(key[at])

    for i in range(6):
        for j in range(6):
            for k in range(6):
                add((counts[0] > i) & (counts[1] > j) & (counts[2] > k), near[0][:, i] << 24 | near[1][:, j] << 12 | near[2][:, k])
    kind = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                kind += 1
                for j in range(6):
                    add(counts[b] > j, kind << 60 | parts[a] << 12 | near[b][:, j])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches):
        code = Golay()
        for b in batches:
            if b.num_rows:
                fp = b.column(0).to_numpy()
                rows, keys = meeting_keys(fp, code)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links among some fingerprints join, one fewer than there are in each component."""
    fps = fps.view(np.uint64)  # of signed numbers, the bits of the absolute value would be counted
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BITS
    left, out = np.ones(len(fps), bool), []
    while left.any():
        front = [int(left.argmax())]
        left[front[0]] = False
        while front:
            a = front.pop()
            new = np.flatnonzero(near[a] & left)
            left[new] = False
            out.extend((a, int(b)) for b in new)
            front.extend(new.tolist())
    return out


def _within_keys(keyed: DataFrame, bucket: int) -> DataFrame:
    """a, b: a spanning forest of the links of each key; of a key with more than `bucket` fingerprints, these with b null.  keyed: key, fp.

    All keys are dealt out once and read in order, so that their rows are shuffled once; a task holds no more
    of a key than `bucket` fingerprints and a batch.
    """

    def run(batches):
        seen: set[bytes] = set()
        late = (np.empty(0, np.int64), np.empty(0, np.int64))
        large = None  # the key whose fingerprints are passed on as they come

        def links(keys, fps):
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= BITS
            a, b = [x[near]], [y[near]]
            for i in np.flatnonzero(sizes > 2):
                group = fps[cuts[i] : cuts[i + 1]]
                mark = group.tobytes() if len(group) < 16 else hash(group.tobytes()).to_bytes(8, "little", signed=True) + group[:8].tobytes()
                if mark in seen:  # near copies meet under many keys
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(mark)
                if len(group) > bucket:
                    yield group, None
                    continue
                found = np.array(forest(group), np.int64).reshape(-1, 2)
                a.append(group[found[:, 0]])
                b.append(group[found[:, 1]])
            yield np.concatenate(a), np.concatenate(b)

        def gathered(batches):
            some = []
            for batch in batches:
                if batch.num_rows:
                    some.append(batch)
                if len(some) == 64:
                    yield some
                    some = []
            yield some

        def rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

        for some in gathered(batches):
            if some:
                keys, fps = (np.concatenate([x, *(b.column(i).to_numpy() for b in some)]) for i, x in enumerate(late))
                if large is not None:
                    same = int(np.searchsorted(keys, large, "right"))
                    if same:
                        yield rows(fps[:same], None)
                    keys, fps = keys[same:], fps[same:]
                    if not len(keys):
                        late = keys, fps
                        continue
                    large = None
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                late = keys[whole:], fps[whole:]
                if len(late[0]) > bucket:
                    large = late[0][0]
                    yield rows(late[1], None)
                    late = late[0][:0], late[1][:0]
                if whole:
                    for a, b in links(keys[:whole], fps[:whole]):
                        yield rows(a, b)
        if len(late[0]):
            for a, b in links(*late):
                yield rows(a, b)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _by_midpoints(fps: DataFrame) -> DataFrame:
    """a, b: each fingerprint with the smallest around each of its midpoints."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.concatenate([[np.uint64(0)], bits, (bits[:, None] | bits[None, :])[np.triu_indices(64, 1)]])

    def run(batches):
        for b in batches:
            if b.num_rows:
                fp = b.column(0).to_numpy()
                at = (fp.view(np.uint64)[:, None] ^ masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.repeat(fp, len(masks)))], ["mid", "fp"])

    around = fps.select("fp").mapInArrow(run, "mid long, fp long").groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints whose components are those of all links.  fps: a column fp."""
    keyed = _keyed(fps.repartition(max(1, -(-fps.count() // DEALT))))
    met = checkpointed(_within_keys(keyed, bucket), "met")
    many = _by_midpoints(met.where("b is null").select(F.col("a").alias("fp")).distinct())
    return checkpointed(met.where("b is not null").union(many).distinct(), "links")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    bounded_batches(df.sparkSession)
    docs = checkpointed(fingerprints(df, id_col, text_col, words, seed), "fingerprints")
    fps = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(fps, bucket))
    labelled = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "label").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
