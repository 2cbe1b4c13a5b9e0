"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token and rank per line) becomes a `tokenizers` BPE model: every byte is mapped
to a printable character, a merge is every split of a token into two tokens, ordered by the token's
rank, and a piece that is a token itself is not merged (`ignore_merges`).  This gives the ids of a
rank-by-rank merge of each piece.  A text is cut into pieces by the pattern; pieces repeat a lot, so
each worker keeps a bounded table from piece to packed ids and asks the model only for new ones.
Decoding reverses the byte table: ids give bytes, and characters whose bytes are split between
tokens are joined again before UTF-8 is read.

Defined results: null and empty texts have no tokens; ids are per row, so repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftgraph.llm._rows import map_texts

#: Entries of a worker's piece table; it is emptied when full, which changes no result.
TABLE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte; bytes that print stand for themselves (fixed by the byte-level format)."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _differing() -> dict[int, str]:
    """Characters that tiktoken's tables and regex's class differently, each with a stand-in that regex classes as tiktoken does."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    one_byte = {bytes([i]): i for i in range(256)}

    def known(cls: str) -> tuple[set, set]:
        theirs = bytes(tiktoken.Encoding("probe", pat_str=cls, mergeable_ranks=one_byte, special_tokens={}).encode_ordinary(every)).decode()
        return set(theirs), set(regex.findall(cls, every))

    stand_in: dict[int, str] = {}
    classes = [(*known(cls), like) for cls, like in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\x0b"))]
    for c in set().union(*(theirs ^ ours for theirs, ours, _ in classes)):
        stand_in[ord(c)] = next((like for theirs, _, like in classes if c in theirs), "\ue000")
    return stand_in


class Codec:
    """Encoder and decoder for one rank file; build one per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Tokenizer, models

        letters = byte_alphabet()
        self.to_letters = dict(enumerate(letters))
        self.to_byte = {letter: b for b, letter in enumerate(letters)}
        spell = lambda token: "".join(map(letters.__getitem__, token))
        by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
        merges = [(spell(t[:i]), spell(t[i:])) for t, _ in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE({spell(t): r for t, r in by_rank}, merges, ignore_merges=True)).model
        self.pieces = regex.compile(pattern).findall
        self.stand_in = _differing()
        self.rare_only = min(self.stand_in, default=1 << 16) >= 1 << 16
        self.table: dict[str, bytes] = {}
        top = by_rank[-1][1] + 1
        self.unit = np.uint16 if top <= 1 << 16 else np.uint32
        # a token is decoded from its letters, by the byte table in reverse
        tokens = [b""] * top
        for t, r in by_rank:
            tokens[r] = bytes(map(self.to_byte.__getitem__, spell(t)))
        self.bytes_of = _Ragged(tokens)
        self.decimal_of = _Ragged([b",%d" % r for r in range(top)])

    def split(self, text: str) -> list[str]:
        if not self.rare_only or len(text.encode("utf-16-le")) != 2 * len(text):
            ends = [0]
            for piece in self.pieces(text.translate(self.stand_in)):
                ends.append(ends[-1] + len(piece))
            return [text[a:b] for a, b in zip(ends, ends[1:])]
        return self.pieces(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        table, out = self.table, []
        for text in texts:
            pieces = self.split(text)
            try:
                packed = b"".join(map(table.__getitem__, pieces))
            except KeyError:
                if len(table) > TABLE_ENTRIES:
                    table.clear()
                for p in pieces:
                    if p not in table:
                        spelled = p.encode().decode("latin-1").translate(self.to_letters)
                        table[p] = np.array([t.id for t in self.model.tokenize(spelled)], dtype=self.unit).tobytes()
                packed = b"".join(map(table.__getitem__, pieces))
            out.append(np.frombuffer(packed, dtype=self.unit))
        return out

    def decode(self, ids) -> bytes:
        return self.bytes_of.join(np.asarray(ids, dtype=np.int64))

    def decimals(self, ids) -> bytes:
        return self.decimal_of.join(np.asarray(ids, dtype=np.int64))[1:]

    def offsets(self, ids, raw: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start of each token in bytes, and the character that holds that byte."""
        lengths = self.bytes_of.lengths[np.asarray(ids, dtype=np.int64)]
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(self.decode(ids) if raw is None else raw, dtype=np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80) - 1
        return starts, chars[starts] if len(starts) else starts


class _Ragged:
    """Byte strings of different lengths, joined by index without a loop."""

    def __init__(self, items: list[bytes]):
        self.lengths = np.array([len(x) for x in items], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


def text_of(raw: bytes) -> str:
    """Bytes as text: characters split between tokens are whole again, stray bytes become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return decoder.decode(raw, final=True)


_codecs: dict = {}


def _codec(ranks_path_key, payload, pattern) -> Codec:
    """One codec for all tasks of a worker process."""
    if ranks_path_key not in _codecs:
        _codecs.clear()
        _codecs[ranks_path_key] = Codec(payload.value, pattern)
    return _codecs[ranks_path_key]


def _setup(df: DataFrame, ranks_path: str, pattern: str):
    """The rank file is read once, on the driver, and sent to the executors (a vocabulary: under a few MB)."""
    payload = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return lambda: _codec((ranks_path, pattern), payload, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, byte_starts, char_starts of every text."""

    def step(ids, texts, codec):
        rows = codec.encode([t or "" for t in texts.to_pylist()])
        where = [codec.offsets(r) for r in rows]
        return [ids, [r.tolist() for r in rows], [b.tolist() for b, _ in where], [c.tolist() for _, c in where]]

    return map_texts(df, id_col, text_col, step, "doc_id long, ids array<int>, byte_starts array<long>, char_starts array<long>", _setup(df, ranks_path, pattern))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, raw (bytes) and text of every list of ids; null is an empty list."""
    from pyspark.sql import functions as F

    setup = _setup(df, ranks_path, pattern)

    def run(batches):
        codec = setup()
        for b in batches:
            raw = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array([text_of(x) for x in raw], pa.string())], ["doc_id", "raw", "text"])

    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids")).mapInArrow(run, "doc_id long, raw binary, text string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256: encode each text, decode its ids to text, and digest both.

    The offsets are the characters that the tokens start in, as decimals joined by commas.
    """

    def step(ids, texts, codec):
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        out = []
        for r in codec.encode([t or "" for t in texts.to_pylist()]):
            raw = codec.decode(r)
            starts = codec.offsets(r, raw)[1]
            out.append((len(r), sha(codec.decimals(r)), sha(text_of(raw).encode()), sha(",".join(map(str, starts.tolist())).encode())))
        return [ids, *(list(c) for c in zip(*out))]

    return map_texts(df, id_col, text_col, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string", _setup(df, ranks_path, pattern))
