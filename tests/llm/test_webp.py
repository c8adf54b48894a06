import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from against import differences
from pyspark.sql import functions as F

from velumra.llm import queries, webp

SF = "/root/testdata/sf0.001"
WAYS = [dict(transforms=t, references=r, cache_bits=c, tile=k) for t in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)) for r in (False, True) for c in (0, 4) for k in (0, 2)]


def picture(kind: int, width: int, height: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    if kind == 0:
        p = rng.integers(0, 2**32, width * height)
    elif kind == 1:
        p = rng.choice(rng.integers(0, 2**32, 1 + seed % 40), width * height)
    else:
        y, x = np.divmod(np.arange(width * height), width)
        p = 0xFF000000 + (x * 5 % 256 << 16) + (y * 3 % 256 << 8) + (x + y) % 256
    return p.tolist()


def plain(raw, **options):
    width, height, p = webp.decode(raw, **options)
    return width, height, p.tolist()


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(WAYS), st.integers(0, 2), st.integers(1, 23), st.integers(1, 23), st.integers(0, 999))
def test_round_trip(way, kind, width, height, seed):
    p = picture(kind, width, height, seed)
    if 3 in way["transforms"] and len(set(p)) > 256:
        return
    assert plain(webp.encode(width, height, p, **way)) == (width, height, p)


@pytest.mark.parametrize("raw", ["UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="])
def test_images_that_others_wrote(raw):
    """One-pixel images by which browsers are tested."""
    width, height, p = webp.decode(base64.b64decode(raw))
    assert (width, height, len(p)) == (1, 1, 1)


def test_every_cut_is_refused_or_whole():
    p = picture(1, 9, 7, 3)
    raw = webp.encode(9, 7, p, transforms=(0, 2), references=True, cache_bits=4)
    for n in range(len(raw)):
        try:
            assert plain(raw[:n]) == (9, 7, p)
        except webp.Broken:
            pass
    rng = np.random.default_rng(1)
    for _ in range(300):
        bad = bytearray(raw)
        bad[rng.integers(20, len(raw))] ^= 1 << rng.integers(0, 8)
        try:
            webp.decode(bytes(bad))
        except webp.Broken:
            pass


def claims(width, height):
    """A few bytes that stand for a large image of one colour."""
    sink = webp.Sink()
    for value, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        sink.write(value, n)
    for s in (9, 8, 7, 255, 0):  # one symbol in each code
        sink.write(1, 1)
        sink.write(0, 1)
        sink.write(1, 1)
        sink.write(s, 8)
    raw = b"\x2f" + sink.bytes()
    raw += b"\0" * (len(raw) & 1)
    return b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw


def test_images_over_the_limit_are_refused(spark):
    assert plain(claims(300, 200)) == (300, 200, [0xFF080907] * 60_000)
    with pytest.raises(webp.Broken, match="over the limit"):
        webp.decode(claims(16384, 16384))
    images = spark.createDataFrame([(1, claims(16384, 16384)), (2, claims(20, 10)), (3, claims(21, 10))], "id int, image binary")
    found = {r.id: r for r in webp.decoded(images, max_pixels=200).collect()}
    assert found[1].pixels is found[3].pixels is None and "limit" in found[1].error and len(found[2].pixels) == 200
    assert "limit" in webp.decoded(images).where("id = 1").first().error


def test_query_equals_sql(spark):
    assert differences(queries.op2_webp(spark, SF), webp.SQL, SF) == ""


def test_odd_rows(spark):
    good = webp.encode(2, 1, [0xFF010203, 0xFF040506])
    rows = [(1, None, "a"), (2, b"", "b"), (3, b"RIFFxxxxWEBP", None), (4, good, "c"), (4, good, "c"), (None, good[:-3], "d")]
    images = spark.createDataFrame(rows, "id int, image binary, width string")
    found = webp.decoded(images)
    assert found.columns == ["id", "width", "height", "pixels", "error"] and dict(found.dtypes)["width"] == "int"
    got = [(r.id, r.width, r.height, r.pixels, r.error is not None) for r in found.collect()]
    assert got == [(1, None, None, None, False), (2, None, None, None, True), (3, None, None, None, True)] + [(4, 2, 1, [0xFF010203, 0xFF040506], False)] * 2 + [(None, None, None, None, True)]
    assert webp.decoded(images.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [0.5, None]), (None, [0.1] * 3), (4, [float("nan"), float("inf")])], "vec_id bigint, embedding array<float>")
    found = {r.vec_id: r for r in webp.decoded(webp.tiles(vectors.withColumn("pixels", F.lit("x")))).collect()}
    assert found[1].pixels is found[2].pixels is found[3].pixels is None and len(found[None].pixels) == 3 and len(found[4].pixels) == 2
