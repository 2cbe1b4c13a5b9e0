"""The pipeline against brute-force versions of its stages."""

import hashlib
import zlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_text_operators import held_brute, lines_brute, near_brute
from weftgraph.llm import bpe, lang_id

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    learn = sorted((t, x) for i, t, x in docs if zlib.crc32(str(i).encode()) % 3 != 1)
    model = lang_id.train(learn)
    rows = [(i, t) for i, t, _ in docs]
    rows = [row for row, (lang, share, _) in zip(rows, lang_id.identify([t for _, t in rows], model, 8.0)) if lang != "und" and share >= 0.4]
    left = lines_brute(rows)
    rows = [(i, k) for i, (n, gone, k) in left.items() if n > gone or not gone]
    first = near_brute(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, _ in held_brute(rows, items)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, sha(",".join(map(str, theirs.encode_ordinary(t))).encode()), sha(t.encode())) for i, t in rows if i not in held}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs.limit(20), SF).columns) == set(docs.columns), name
