import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import queries, webp

RNG = np.random.default_rng(5)


def image(height, width, colours=0):
    if colours:
        table = RNG.integers(0, 2**32, colours, dtype=np.uint32)
        return table[RNG.integers(0, colours, (height, width))]
    y, x = np.indices((height, width))
    noise = RNG.integers(0, 9, (height, width))
    return (np.uint32(255) << 24 | ((x * 3 + noise) % 256).astype(np.uint32) << 16 | ((y * 2 + noise) % 256).astype(np.uint32) << 8 | ((x + y) % 256).astype(np.uint32)).astype(np.uint32)


def tiles(height, width, bits, most):
    return RNG.integers(0, most, (-(-height >> bits), -(-width >> bits)))


def test_a_published_file():
    pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixels.shape == (1, 1)


def test_near_codes():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert webp.NEAR[34:40] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0)]
    assert webp.NEAR[-2:] == [(8, 6), (8, 7)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (17, 23), (40, 64)])
def test_transforms(shape):
    pixels = image(*shape)
    assert (webp.decode(webp.encode(pixels)) == pixels).all()
    assert (webp.decode(webp.encode(pixels, green=True)) == pixels).all()
    for mode in range(14):
        assert (webp.decode(webp.encode(pixels, predictor=(np.full((-(-shape[0] // 4), -(-shape[1] // 4)), mode), 2))) == pixels).all(), mode
    cross = RNG.integers(0, 2**24, (-(-shape[0] // 4), -(-shape[1] // 4)))
    assert (webp.decode(webp.encode(pixels, predictor=(tiles(*shape, 2, 14), 2), cross=(cross, 2), green=True)) == pixels).all()


def test_predictors_one_by_one():
    """Each mode against the rule said plainly, pixel by pixel."""
    left, top, right, corner = (RNG.integers(0, 256, (50, 4)) for _ in range(4))

    def plain(m, a, t, r, c):
        avg = lambda p, q: (p + q) // 2
        clip = lambda v: min(255, max(0, v))
        half = avg(a, t)
        d = half - c
        return [None, a, t, r, c, avg(avg(a, r), t), avg(a, c), half, avg(c, t), avg(t, r), avg(avg(a, c), avg(t, r)), None, clip(a + t - c), clip(half + int(d / 2))][m]

    for m in [*range(1, 11), 12, 13]:
        got = webp.predicted(np.full(50, m), left, top, right, corner)
        assert got.tolist() == [[plain(m, *map(int, q)) for q in zip(*rows)] for rows in zip(left, top, right, corner)]
    got = webp.predicted(np.full(50, 11), left, top, right, corner)
    for g, a, t, c in zip(got, left, top, corner):
        estimate = a + t - c
        assert (g == (a if np.abs(estimate - a).sum() < np.abs(estimate - t).sum() else t)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    pixels = image(13, 21, colours)
    assert (webp.decode(webp.encode(pixels, palette=np.unique(pixels))) == pixels).all()


@pytest.mark.parametrize("cache_bits", [1, 4, 11])
def test_cache_and_meta_codes(cache_bits):
    pixels = image(30, 37, 40)
    assert (webp.decode(webp.encode(pixels, cache_bits=cache_bits)) == pixels).all()
    assert (webp.decode(webp.encode(pixels, cache_bits=cache_bits, meta=(tiles(30, 37, 3, 5), 3))) == pixels).all()
    flat = pixels.ravel().copy()
    flat[200:260] = flat[100:160]
    flat[300:400] = flat[299]
    copies = [(200, 60, 100), (300, 100, 1)]
    assert (webp.decode(webp.encode(flat.reshape(30, 37), cache_bits=cache_bits, copies=copies)).ravel() == flat).all()
    assert (webp.decode(webp.encode(flat.reshape(30, 37), copies=copies)).ravel() == flat).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"\n", b"a longer line of words that comes again\n", b"xyz", bytes(range(40, 90)), b"\0" * 70, "é日".encode()]), max_size=40))
def test_store_and_load(parts):
    text = b"".join(parts)
    samples = webp.load(webp.store(text))
    assert samples.shape[1] == 64 and samples.tobytes() == webp.payload(text)


def test_long_payloads_go_to_several_files():
    text = RNG.integers(32, 127, 64 * webp.MOST_ROWS + 1000, dtype=np.uint8).tobytes()
    media = webp.store(text)
    assert len(webp.files(media)) == 2
    assert webp.load(media).tobytes() == webp.payload(text)


def test_damage_is_noticed():
    media = webp.store(b"some words that make a file, over and over " * 40)
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + media[4:])
    cut = media[: len(media) // 2]
    with pytest.raises(ValueError):
        webp.decode(cut[:16] + (len(cut) - 20).to_bytes(4, "little") + cut[20:])


def test_query(spark, tmp_path):
    texts = [None, "", "a", "a" * 64, "bär\n" * 500, "line of text that is long enough\n" * 3, "x" * 70_000]
    rows = [(i, t, "clash") for i, t in enumerate([*texts, *texts])]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_webp(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        raw = (text or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_sha256, r.feature) == (got[i % len(texts)].media_sha256, got[i % len(texts)].feature)
    pixels = webp.pixel_arrays(webp.store_column(spark.createDataFrame([(7, "pixels")], "doc_id long, text string"))).collect()
    assert (pixels[0].height, pixels[0].width, pixels[0].pixels[:4]) == (1, 64, b"pppP"[:3] + b"\xff")
    assert queries.op1_webp(spark, _empty(spark, tmp_path)).collect() == []


def _empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    return f"{tmp_path}/none"
