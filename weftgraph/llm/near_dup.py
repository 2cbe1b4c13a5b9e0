"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Shingles are `words` consecutive lower-case words (a shorter text is one shingle).  Their document
   frequencies are counted over all documents in a fixed number of hash buckets, so the table that is
   broadcast has a size known beforehand and the share of documents per bucket, and with it the
   weights, do not drift with the corpus.  A shingle weighs tf * (1 + ln((1 + N) / (1 + df))).
2. Each text gives bands * rows consistent samples (Ioffe's improved CWS): the share of equal samples
   of two texts is their weighted Jaccard similarity.  `rows` samples make a band key.
3. Texts that are equal are one node.  In every bucket of a band the members are compared with its most
   central member, by the exact weighted Jaccard similarity, and with the group's centre: the shingles that
   most of a few members hold.  Two members that are not linked by this can only be similar if both are near
   the centre, or if their differences from it have enough in common (`_Group`).  Those near it are linked
   through the nearest.  Members that share a difference are compared with one of them first (`_stars`),
   and only where that leaves them in different classes the pairs among them are verified (`_rest`).  So
   every similar pair of a bucket ends in one class, and copies that were edited apart, each in its own
   way, cost a few comparisons a member and not one a pair.
4. Connected components of the verified pairs are the classes.

Defined results: null and empty texts are equal to each other and to nothing else; repeated rows share
a class; a class is named by its smallest doc_id (null only if all are null).  Other columns are ignored
by `classes`; `keep` passes them on, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import bounded_batches, checkpointed, map_texts, slices
from weftgraph.llm._words import Words, mix, run_starts, runs

BUCKETS = 1 << 18
#: Members that are compared with one copy of their leader.
SHARE = 500
#: Members, about, that tell the centre of a group.  Any centre gives the same classes; a good one saves comparisons.
SAMPLE = 12
#: Rounds in which members that share a difference are compared with one of them.
STARS = 2
_T = 1 << 16


def _shingles(raws: list[bytes], words: int) -> list[np.ndarray]:
    """Hashes of the shingles of each text, with repeats."""
    w = Words([r.lower() for r in raws])
    hashes = w.hashes()
    grams, ok = runs(hashes, words), run_starts(w.counts, words)
    out = []
    for i, n in enumerate(w.counts):
        a = w.first[i]
        if n >= words:
            out.append(grams[a : a + n - words + 1])
        else:
            out.append(runs(hashes[a : a + n], int(n)) if n else np.empty(0, np.uint64))
    assert len(ok) == len(hashes)
    return out


def _lower(t: str | None) -> bytes:
    return (t or "").lower().encode()


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _document_frequencies(df: DataFrame, text_col: str, words: int):
    """Inverse document frequency of each hash bucket, as float32."""

    def count(batches):
        df_of, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                for s in _shingles([_lower(t) for t in part.column(0).to_pylist()], words):
                    df_of[np.unique(_bucket(s))] += 1
                    n += 1
        at = np.flatnonzero(df_of)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df_of[at], n))], ["bucket", "n"])

    rows = df.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    total = counts.pop(-1, 0) or 0
    idf = np.full(BUCKETS, 1 + np.log(1 + total))
    if counts:
        idf[np.fromiter(counts, np.int64)] = 1 + np.log((1 + total) / (1 + np.fromiter(counts.values(), np.float64)))
    return idf.astype(np.float32)


def _weights(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, tf = np.unique(shingles, return_counts=True)
    return kinds, tf.astype(np.float32) * idf[_bucket(kinds)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; two empty sets are equal."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return 1.0 if total == 0 else shared / (total - shared)


class Sampler:
    """Consistent weighted samples; the variates of an element come from tables by double hashing, one place per sample."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, _T).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, _T)).astype(np.float32)
        self.beta = rng.random(_T).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.slots = np.arange(samples, dtype=np.uint64)[:, None]

    def __call__(self, kinds: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best, pick, step = np.full(len(self.slots), np.inf, np.float32), np.zeros(len(self.slots), np.uint64), np.zeros(len(self.slots), np.int64)
        for at in range(0, len(kinds), 2048):
            h, ln_s = kinds[at : at + 2048], np.log(weights[at : at + 2048])
            place = ((h & np.uint64(_T - 1)) + self.slots * ((h >> np.uint64(16)) | np.uint64(1))) & np.uint64(_T - 1)
            place = place.astype(np.int64)
            r, beta = self.r[place], self.beta[place]
            t = np.floor(ln_s * self.inverse[place] + beta)
            ln_a = self.ln_c[place] - r * (t - beta + 1)
            i = ln_a.argmin(axis=1)
            rows = np.arange(len(i))
            better = ln_a[rows, i] < best
            best[better], pick[better], step[better] = ln_a[rows, i][better], h[i][better], t[rows, i][better].astype(np.int64)
        return mix(pick ^ mix(step.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.slots[:, 0]))


def signatures(df: DataFrame, idf, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (digest of the text), total weight and band keys of every row."""

    def setup():
        return Sampler(bands * rows)

    def step(ids, texts, sample):
        import hashlib

        texts = texts.to_pylist()
        nodes, totals, keys = [], [], []
        for t, s in zip(texts, _shingles([_lower(t) for t in texts], words)):
            kinds, weights = _weights(s, idf.value)
            nodes.append(hashlib.md5((t or "").encode()).digest())
            totals.append(float(weights.sum(dtype=np.float64)))
            if not len(kinds):
                keys.append([])
                continue
            got = sample(kinds, weights).reshape(bands, rows)
            key = np.arange(1, bands + 1, dtype=np.uint64)
            for c in got.T:
                key = mix(key * np.uint64(31) + c)
            keys.append(key.view(np.int64).tolist())
        return [ids, nodes, totals, keys]

    return map_texts(df, id_col, text_col, step, "doc_id long, node binary, total double, keys array<long>", setup)


def _centre(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than half of the sets hold, each with the median of its weights."""
    kinds, weights = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets])
    order = np.lexsort((weights, kinds))
    kinds, weights = kinds[order], weights[order]
    found, first, n = np.unique(kinds, return_index=True, return_counts=True)
    most = n * 2 > len(sets)
    return found[most], weights[(first + n // 2)[most]]


class _Group:
    """The members of one leader, by their differences from a centre.

    Against a centre C, a text x lacks weight M and adds weight E.  With c = s / (1 + s) for the similarity s,
    let cost(x) = (1 - c) M + c E - (1/2 - c) |C|.  Two texts are similar if and only if what their
    differences from C have in common weighs cost(x) + cost(y) at least.  So two texts whose costs add up to
    0 or less are similar; each of them is then similar to the member of the smallest cost as well.  Any
    others share a difference, and at the first one they share both have slack for the other's cost.
    No cost is below -(1/2 - c) |C|, called -radius here.
    """

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, similarity: float):
        self.idf, self.similarity = idf, similarity
        self.centre = _centre(sets) if len(sets) > 3 else sets[0]
        self.c = similarity / (1 + similarity)
        self.whole = float(self.centre[1].sum(dtype=np.float64))
        self.radius = (0.5 - self.c) * self.whole
        self.nearest = min(self._changes(s)[2] for s in sets)

    def _changes(self, other: tuple) -> tuple[np.ndarray, np.ndarray, float]:
        """Shingles that weigh more or less than in the centre, by how much, and the cost."""
        kinds = np.union1d(self.centre[0], other[0])
        change = np.zeros(len(kinds))
        change[np.searchsorted(kinds, other[0])] = other[1]
        change[np.searchsorted(kinds, self.centre[0])] -= self.centre[1]
        kinds, change = kinds[change != 0], change[change != 0]
        missing, added = -change[change < 0].sum(), change[change > 0].sum()
        return kinds, change, float((1 - self.c) * missing + self.c * added - self.radius)

    def differences(self, other: tuple) -> tuple[float, np.ndarray, np.ndarray]:
        """cost, features and slack of a text.

        A feature is a shingle that weighs more than in the centre, or one that weighs less.  Features are in
        one global order (added ones first, rare ones first); the slack of a feature is what it and the later
        ones weigh, less the text's cost.  Features too late in the order for any partner are left out: a
        text near enough for the nearest member is linked to that one, so its partners are those that aren't.
        """
        kinds, change, cost = self._changes(other)
        order = np.lexsort((kinds, -self.idf[_bucket(kinds)], change < 0))
        sizes = np.abs(change[order])
        near = 1e-6 * self.whole
        rest = sizes.sum() - np.cumsum(sizes) + sizes + near
        if cost <= -self.nearest - near:
            least = cost - self.nearest
        else:
            least = (1 + self.similarity) * (cost - self.radius) if cost > self.radius else cost - self.radius
        n = int(np.searchsorted(-rest, -max(least, 0), "right"))
        feature = (kinds[order[:n]] & ~np.uint64(1)) | (change[order[:n]] < 0).astype(np.uint64)
        return cost, feature.view(np.int64), rest[:n] - cost


_COMPARED = "lead binary, node binary, similarity double, cost double, features array<long>, slack array<double>"


def compare(pairs: DataFrame, texts: DataFrame, idf, words: int, similarity: float) -> DataFrame:
    """pairs: lead, node, alone.  Result: lead, node, similarity, and cost, features, slack where not alone.

    Each text comes once to each of its leaders.  A leader of many is salted: its text and those of about
    SAMPLE members, which tell the centre, go to every share of its members, the members to one share each.
    A task holds one leader's sample at a time.  A leader that isn't alone is a row of its own group.
    """
    counts = pairs.groupBy("lead").agg(F.count("*").alias("n"), F.min("alone").alias("alone_all"))
    shares = checkpointed(counts.select("lead", "alone_all", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE)).alias("each")), "shares")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    leaders = shares.select("lead", every, F.col("lead").alias("node"), F.col("alone_all").alias("alone"), F.lit(0).alias("role")).withColumn("own", F.col("share") == 0)
    members = pairs.join(shares.drop("alone_all"), "lead").withColumn("at", F.pmod(F.xxhash64("node"), "shares").cast("int")).withColumn("tells", ~F.col("alone") & (F.pmod(F.xxhash64("node", "lead"), "each") == 0))
    telling = members.where("tells").select("lead", every, "node", "alone", F.lit(1).alias("role"), "at").select("lead", "share", "node", "alone", "role", (F.col("share") == F.col("at")).alias("own"))
    others = members.where("not tells").select("lead", F.col("at").alias("share"), "node", "alone", F.lit(2).alias("role"), F.lit(True).alias("own"))
    rows = leaders.unionByName(telling).unionByName(others).join(texts, "node").select("lead", "share", "role", "own", "node", "alone", "text")
    rows = rows.repartition("lead", "share").sortWithinPartitions("lead", "share", "role")

    def run(batches):
        table, out = idf.value, []
        leader, sample, waiting, group = None, [], [], None

        def told(lead, node, alone, weights):
            nonlocal group
            if not alone and group is None:
                group = _Group([leader, *sample], table, similarity)
            extra = (None, None, None) if alone else group.differences(weights)
            out.append((lead, node, weighted_jaccard(leader, weights), *extra))

        def settle():
            for w in waiting:
                told(*w)
            waiting.clear()

        def batch_of():
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], ["lead", "node", "similarity", "cost", "features", "slack"])
            out.clear()
            return made

        for batch in batches:
            for part in slices(batch, 6):
                lead, _, role, own, node, alone, text = (c.to_pylist() for c in part.columns)
                for i, s in enumerate(_shingles([_lower(t) for t in text], words)):
                    weights = _weights(s, table)
                    if role[i] == 0:
                        settle()
                        leader, sample, group = weights, [], None
                    elif role[i] == 1:
                        sample.append(weights)
                    if role[i] == 2:
                        settle()
                        told(lead[i], node[i], alone[i], weights)
                    elif own[i] and (role[i] == 1 or not alone[i]):
                        waiting.append((lead[i], node[i], alone[i], weights))
                yield batch_of()
        settle()
        yield batch_of()

    return rows.mapInArrow(run, _COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, by minima over neighbours and pointer jumping."""
    edges = edges.toDF("a", "b")
    both = checkpointed(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        old, new = labels.select("node", F.col("label").alias("old")), labels
        for _ in range(2):  # two steps for each table that is written
            near = both.join(new.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("near"))
            lower = new.join(near, "node").select("node", F.least("label", "near").alias("next"))
            jump = new.select(F.col("node").alias("next"), F.col("label").alias("far"))
            new = lower.join(jump, "next").select("node", F.least("next", "far").alias("label"))
        new = checkpointed(new.join(old, "node"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _open(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups whose members are in more than one class, with their labels."""
    found = compared.where("features is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = found.groupBy("lead").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("lead")
    return found.join(mixed, "lead", "left_semi")


def _near(found: DataFrame) -> DataFrame:
    """lead, node: the member nearest to a group's centre with each one that is near enough for it and in another class."""
    best = found.groupBy("lead").agg(F.min_by(F.struct(F.col("node").alias("star"), F.col("label").alias("its")), F.struct("cost", "node")).alias("b"), F.min("cost").alias("least"))
    return found.join(best.select("lead", "least", "b.*"), "lead").where("label <> its and cost + least <= 0").select(F.col("star").alias("lead"), "node")


def _shared(found: DataFrame) -> DataFrame:
    """lead, feature, node, label, cost, slack: the differences that members of several classes share, with slack for each other."""
    rows = found.select("lead", "node", "label", "cost", F.explode(F.arrays_zip("features", "slack")).alias("f")).select("lead", "node", "label", "cost", F.col("f.features").alias("feature"), F.col("f.slack").alias("slack"))
    for _ in range(2):
        met = rows.groupBy("lead", "feature").agg(F.min("cost").alias("cheapest"), F.max("slack").alias("loosest"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        rows = checkpointed(rows.join(met, ["lead", "feature"]).where("slack >= cheapest and cost <= loosest").select("lead", "feature", "node", "label", "cost", "slack"), "features")
    return rows


def _stars(shared: DataFrame, salt: int) -> DataFrame:
    """lead, node: of each shared difference one member, the cheapest first and then others, with those it can be similar to."""
    order = F.struct("cost", "node") if salt == 0 else F.struct(F.xxhash64("node", F.lit(salt)), "node")
    best = shared.groupBy("lead", "feature").agg(F.min_by(F.struct(*(F.col(c).alias(f"{c}_a") for c in ("node", "label", "cost", "slack"))), order).alias("b")).select("lead", "feature", "b.*")
    both = shared.join(best, ["lead", "feature"]).where("label_a <> label and slack_a >= cost and slack >= cost_a")
    return both.select(F.col("node_a").alias("lead"), "node").distinct()


def _rest(shared: DataFrame) -> DataFrame:
    """lead, node: all pairs of members in different classes that share a difference and can be similar."""
    mine = [F.col(c).alias(f"{c}_a") for c in ("node", "label", "cost", "slack")]
    both = shared.select("lead", "feature", *mine).join(shared, ["lead", "feature"])
    both = both.where("node_a < node and label_a <> label and slack_a >= cost and slack >= cost_a")
    return both.select(F.col("node_a").alias("lead"), "node").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after some more links: the old classes are contracted to their labels first."""
    ends = links.select("lead", "node").unionByName(links.select(F.col("node").alias("lead"), F.col("lead").alias("node"))).select(F.col("lead").alias("node")).distinct()
    known = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    known = checkpointed(known, "known")
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    roots = components(links.join(of("lead"), "lead").join(of("node"), "node").where("lead_label <> node_label").select("lead_label", "node_label").distinct())
    return checkpointed(known.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _linked(compared: DataFrame, verify, similar: DataFrame) -> DataFrame:
    """node, label of the classes of a first comparison's groups; `verify` keeps the similar ones of some pairs."""
    labels, tried = components(similar), None
    for step in range(STARS + 2):
        found = checkpointed(_open(compared, labels), "open")
        if found.isEmpty():
            break
        if step == 0:
            pairs = _near(found)
        else:
            shared = _shared(found)
            pairs = _stars(shared, step - 1) if step <= STARS else _rest(shared)
        pairs = pairs.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["lead", "node"], "left_anti")
        pairs = checkpointed(pairs, "further")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = checkpointed(verify(pairs), "verified")
        if not more.isEmpty():
            labels = _merged(labels, more)
    return labels


def _labelled(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id, node (digest of the text) and label (the same for the rows of a class) of every row."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    idf = spark.sparkContext.broadcast(_document_frequencies(docs, "text", words))
    signed = checkpointed(signatures(docs, idf, "doc_id", "text", words, bands, rows), "signatures")
    keyed = signed.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(keyed.join(shared, "key"), "members")
    # a text that shares buckets with many is near the middle of its group: copies edited apart still are close to it
    central = members.groupBy("node").agg(F.sum("n").alias("c"))
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text").join(central.select("node"), "node", "left_semi")
    texts = checkpointed(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node")).getField("node").alias("lead"))
    pairs = members.join(leaders, "key").where("node <> lead").groupBy("lead", "node").agg((F.max("n") <= 2).alias("alone"))
    compared = checkpointed(compare(checkpointed(pairs, "pairs"), texts, idf, words, similarity), "compared")
    similar = lambda found: found.where((F.col("similarity") >= similarity) & (F.col("lead") != F.col("node"))).select("lead", "node")
    verify = lambda pairs: similar(compare(pairs.withColumn("alone", F.lit(True)), texts, idf, words, similarity))
    labels = _linked(compared, verify, similar(compared))
    return checkpointed(signed.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label")), "labelled")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """doc_id, class_id and class_size of every row."""
    named = _labelled(df, id_col, text_col, words, similarity, bands, rows)
    sizes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(sizes, "label").select("doc_id", "class_id", "class_size")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """One row of each class, with all columns of df: the smallest doc_id (null last), then the smallest digest of the text."""
    named = _labelled(df, id_col, text_col, words, similarity, bands, rows)
    each = named.groupBy("label", "doc_id", "node").agg(F.count("*").alias("n"))
    best = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "n")).alias("best")).select("best.*")
    name = "key"
    while name in df.columns:
        name += "_"
    key = lambda i, node: F.unhex(F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), F.hex(node)))).alias(name)
    best = checkpointed(best.select(key(F.col("doc_id"), F.col("node")), "n"), "best")
    rows_of = df.select("*", key(F.col(f"`{id_col}`").cast("long"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))))
    single = rows_of.join(best.where("n = 1"), name, "left_semi")
    repeated = rows_of.join(best.where("n > 1"), name, "left_semi").dropDuplicates([name])
    return single.unionByName(repeated).drop(name)
