"""RGB tensors of stored media."""

import numpy as np

from weftgraph.llm import media_jpeg


def pixels(r):
    return np.frombuffer(bytes(r.rgb), "<u1" if r.depth == 8 else "<u2").reshape(r.height, r.width, 3)


def test_tensors_are_those_of_the_features(spark):
    docs = spark.createDataFrame([(1, "plain text " * 50, 5), (2, "", 5), (3, None, 5), (None, "é" * 3000, 5)], "doc_id long, text string, depth int")
    stored = media_jpeg.store(docs)
    feature = {r.doc_id: r.feature for r in media_jpeg.load(stored).collect()}
    got = media_jpeg.tensors(stored).collect()
    assert len(got) == 4
    for r in got:
        assert media_jpeg.feature_of(pixels(r)) == feature[r.doc_id]
    assert media_jpeg.tensors(media_jpeg.store(docs.limit(0))).count() == 0


def test_samples_stay_in_range(spark):
    """Next to no sample of real documents is at an end of its range, so that tensors tell what was stored."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = ended = 0
    for r in media_jpeg.tensors(media_jpeg.store(docs)).collect():
        rgb = pixels(r)
        every += rgb.size
        ended += int(((rgb == 0) | (rgb == (1 << media_jpeg.PRECISION) - 1)).sum())
    assert ended < 0.02 * every


def test_coefficients_of_both_signs():
    payload = np.random.default_rng(4).integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    picture = media_jpeg.read(media_jpeg.encode(payload))
    signs = np.sign(picture.components[0].coef)
    assert picture.precision == 12 and (signs[:, 1:] == media_jpeg.SIGNS[1:]).all() and media_jpeg.payload_of(picture) == payload


def test_scans_of_a_picture_share_tables_and_blocks():
    """What depends on the size alone is made once for a picture and not for each scan."""
    payload = np.random.default_rng(5).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    media_jpeg._grid.cache_clear(), media_jpeg._mcu_grid.cache_clear(), media_jpeg._table.cache_clear()
    for _ in range(3):
        picture = media_jpeg.read(media_jpeg.encode(payload))
        assert media_jpeg.payload_of(picture) == payload
    assert media_jpeg._grid.cache_info().misses == media_jpeg._mcu_grid.cache_info().misses == 2
    assert media_jpeg._table.cache_info().misses == 4


def test_corrections_with_unknown_coefficients_and_gaps():
    """Blocks of a picture that is no whole number of MCUs wide, and coefficients that are still zero, are corrected one by one."""
    coef = np.array([[5, -5, 0], [7, 7, 7], [0, 2, -2], [-4, 4, 4]], dtype=np.int32)
    for blocks, want in (([0, 1, 2], [[6, -5, 0], [8, 8, 7], [0, 3, -3], [-4, 4, 4]]), ([1, 3], [[5, -5, 0], [8, 7, 8], [0, 2, -2], [-5, 4, 4]])):
        now = coef.copy()
        bits = [1, 0, 1, 1, 0, 1, 1] if len(blocks) == 3 else [1, 0, 1, 1, 0, 0]
        media_jpeg._correct(now, np.array(blocks), 0, 2, media_jpeg._Bits(np.array(bits, dtype=np.uint8)), 1)
        assert now.tolist() == want
