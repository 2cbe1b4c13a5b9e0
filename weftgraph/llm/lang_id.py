"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores labels spans.

Training counts character n-grams (n = 1 to 3, inside words with their borders) of labelled texts in
hash buckets, one column per language, and gives smoothed log-probabilities; it also notes which
scripts each language is written in.  A word's score for a language is the sum over its n-grams;
languages that are not written in the word's script are ruled out.  Viterbi then finds the best path
through the words of a text, with a penalty for each switch of language, and its runs are the spans.
The text's language is the one whose spans hold most letters and its score their share.

Everything is vectorized: n-grams over a step's characters at once, Viterbi over all texts of a step
side by side, word by word.

Defined results: null, empty and letterless texts are `und` with score 0 and no spans; repeated rows
repeat; other columns are ignored.  The fit uses about `sample` labelled rows (those with the smallest
hashes); rows without a label are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import filter_texts, map_texts

_BUCKETS = 1 << 16
#: Starts of script ranges in code points and the script's number (fixed values of the character set, coarse).
SCRIPTS = [
    (0x0000, 1),  # Latin, and what is shared
    (0x0370, 2),  # Greek
    (0x0400, 3),  # Cyrillic
    (0x0530, 4),  # Armenian
    (0x0590, 5),  # Hebrew
    (0x0600, 6),  # Arabic
    (0x0900, 7),  # Indic
    (0x0E00, 8),  # Thai and Lao
    (0x0F00, 9),  # other
    (0x10A0, 10),  # Georgian
    (0x1100, 11),  # Hangul
    (0x1200, 9),
    (0x1E00, 1),
    (0x1F00, 2),
    (0x2000, 1),
    (0x2C00, 9),
    (0x3040, 12),  # Kana
    (0x3100, 9),
    (0x3400, 13),  # Han
    (0xA000, 9),
    (0xAC00, 11),
    (0xD800, 9),
    (0x20000, 13),
    (0x32000, 9),
]
_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
_NUMBERS = np.array([n for _, n in SCRIPTS], dtype=np.uint8)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000 + 1, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


class Characters:
    """Lower-case characters of many texts, their words (runs of letters) and hashed n-grams."""

    letters = None

    def __init__(self, texts: list[str]):
        if Characters.letters is None:
            Characters.letters = _letters()
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alpha = Characters.letters[codes]
        edge = np.flatnonzero(alpha[1:] != alpha[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.array([0, *map(len, lowered)], dtype=np.int64) + 1
        offsets = np.cumsum(sizes)
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        self.counts = np.diff(self.first)
        self.codes, self.alpha = codes, alpha
        # where lower-casing made a text longer: place of each character of the original in the lower-cased text
        self.moved = {i: np.cumsum([0, *(len(c.lower()) for c in t)]) for i, (t, low) in enumerate(zip(texts, lowered)) if t and len(t) != len(low)}

    def place(self, text: int, at: int, end: bool = False) -> int:
        """Character of the original text that a place in all texts falls on, or the one after it."""
        at = int(at - self.offsets[text])
        if text not in self.moved:
            return at
        return int(np.searchsorted(self.moved[text], at, "left" if end else "right")) - (0 if end else 1)

    def scripts(self) -> np.ndarray:
        """Script of each word, by its first letter."""
        return _NUMBERS[np.searchsorted(_STARTS, self.codes[self.starts], "right") - 1]

    def grams(self) -> list[np.ndarray]:
        """For each n, the bucket of the n-gram that ends at each character (borders count as one character)."""
        c = np.where(self.alpha, self.codes, 0).astype(np.uint32)
        prev = np.concatenate([[0], c[:-1]]).astype(np.uint32)
        prev2 = np.concatenate([[0, 0], c[:-2]]).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one ^ (prev * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two ^ (prev2 * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        return [((h >> np.uint32(16)) ^ (h & np.uint32(0xFFFF))).astype(np.int32) & (_BUCKETS - 1) for h in (one, two, three)]


class Model:
    def __init__(self, languages: list[str], log_probability: np.ndarray, allowed: np.ndarray):
        self.languages, self.log_probability, self.allowed = languages, log_probability, allowed


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((3, _BUCKETS, 0), np.float32), np.zeros((16, 0), bool))
    counts = np.zeros((3, len(languages), _BUCKETS))
    scripts = np.zeros((16, len(languages)))
    for i, lang in enumerate(languages):
        mine = [t for t, x in rows if x == lang]
        for at in range(0, len(mine), 200):
            chars = Characters(mine[at : at + 200])
            inside = chars.alpha.copy()
            inside[1:] |= chars.alpha[:-1]
            for n, g in enumerate(chars.grams()):
                counts[n, i] += np.bincount(g[inside], minlength=_BUCKETS)
            scripts[:, i] += np.bincount(chars.scripts(), minlength=16)[:16]
    smooth = counts + 0.5
    table = np.log(smooth / smooth.sum(axis=2, keepdims=True)).transpose(0, 2, 1).astype(np.float32)
    # per n-gram only the differences between languages matter, and keep the sums small
    table -= table.mean(axis=2, keepdims=True)
    allowed = scripts >= 0.002 * np.maximum(1, scripts.sum(axis=0, keepdims=True))
    return Model(languages, np.ascontiguousarray(table), allowed)


def word_scores(chars: Characters, model: Model) -> np.ndarray:
    """(words, languages): mean of the n-gram orders; languages not written in the word's script get a large minus."""
    total = np.zeros((len(chars.codes) + 1, len(model.languages)))
    step = sum(model.log_probability[n][g] for n, g in enumerate(chars.grams()))
    np.cumsum(step, axis=0, dtype=np.float64, out=total[1:])
    scores = (total[np.minimum(chars.ends + 1, len(chars.codes))] - total[chars.starts]) / 3
    allowed = model.allowed[chars.scripts()]
    return np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, -1e4)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; `first` bounds the words of each text.  All texts advance together."""
    words, k = scores.shape
    best = np.zeros(words, dtype=np.int8)
    if not words:
        return best
    came = np.zeros((words, k), dtype=np.int8)
    order = np.argsort(-np.diff(first), kind="stable")
    begin, count = first[:-1][order], np.diff(first)[order]
    live = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than i words
    state = np.full((len(order), k), 0.0)
    own = np.arange(k, dtype=np.int8)
    for i in range(int(count[0])):
        n = live[i]
        at = begin[:n] + i
        now = state[:n]
        if i:
            top = now.argmax(axis=1)
            switch = now[np.arange(n), top] - penalty
            stay = now >= switch[:, None]
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, switch[:, None])
        state[:n] = now + scores[at]
    last = np.zeros(len(order), dtype=np.int64)
    for i in range(int(count[0]) - 1, -1, -1):
        n = live[i]
        at = begin[:n] + i
        ends = count[:n] == i + 1
        last[:n][ends] = state[:n][ends].argmax(axis=1)
        best[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return best


def identify(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; a span has start, end (characters) and language."""
    if not model.languages:
        return [("und", 0.0, []) for _ in texts]
    chars = Characters(texts)
    best = viterbi(word_scores(chars, model), chars.first, penalty)
    sizes = chars.ends - chars.starts
    k = len(model.languages)
    doc = np.repeat(np.arange(len(texts)), chars.counts)
    mass = np.bincount(doc * k + best, weights=sizes, minlength=len(texts) * k).reshape(-1, k)
    new = np.ones(len(best), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(best)) - 1
    of = np.searchsorted(begin, chars.first)
    out = []
    for d in range(len(texts)):
        total = mass[d].sum()
        if not total:
            out.append(("und", 0.0, []))
            continue
        top = int(mass[d].argmax())
        spans = [{"start": chars.place(d, chars.starts[begin[s]]), "end": chars.place(d, chars.ends[end[s]], end=True), "lang": model.languages[best[begin[s]]]} for s in range(of[d], of[d + 1])]
        out.append((model.languages[top], float(mass[d, top] / total), spans))
    return out


def fit(df: DataFrame, text_col: str, lang_col: str, where: Column | None = None, sample: int = 6000, max_chars: int = 40_000_000) -> Model:
    """Train on about `sample` labelled rows (a bound of the classifier's fit only), taken by a hash of the row.

    Rows past `max_chars` of text, in hash order, are left out.
    """
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, sample / max(1, rows.count()))
    place = F.pmod(F.xxhash64(text_col, lang_col), F.lit(1 << 30))
    rows = rows.where(place < int(share * (1 << 30)) + 1).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), place.alias("h"))
    kept, size = [], 0
    for r in rows.sort("h", "t", "l").toLocalIterator():
        size += len(r.t)
        if size > max_chars:
            break
        kept.append((r.t, r.l))
    return train(kept)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # three tables of fixed size per language

    def step(ids, texts):
        rows = identify(texts.to_pylist(), sent.value, penalty)
        return [ids, *map(list, zip(*rows))] if rows else [ids, [], [], []]

    return map_texts(df, id_col, text_col, step, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = 0.4, penalty: float = 8.0) -> DataFrame:
    """Rows of df whose main language holds at least `least` of the letters, with lang_col set to it; letterless texts go."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def decide(texts):
        found = identify(texts.to_pylist(), sent.value, penalty)
        return [lang != "und" and share >= least for lang, share, _ in found], [lang for lang, _, _ in found]

    return filter_texts(df, text_col, decide, replace=lang_col)
