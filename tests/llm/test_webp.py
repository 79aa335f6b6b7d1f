import base64
import random

import pytest

from vecframe.llm import webp

STYLES = [*webp.STYLES, {"predictor": list(range(14)), "bits": 3}, {"palette": True, "copies": False, "cache_bits": 3}, {"cross": [0x7F80FF, 0x010203], "cache_bits": 11}, {"palette": True, "predictor": [2, 7], "green": True}]


def image(rng, w, h, colours, alpha):
    pool = [rng.randrange(1 << 24) | (rng.randrange(256) if alpha else 255) << 24 for _ in range(colours)]
    return [rng.choice(pool) for _ in range(w * h)] if rng.random() < 0.7 else (pool * (w * h))[: w * h]


@pytest.mark.parametrize("style", range(len(STYLES)))
def test_round_trip(style):
    rng = random.Random(style)
    for w, h in [(1, 1), (1, 17), (33, 1), (7, 5), (16, 16), (41, 23)]:
        for colours in (1, 2, 3, 4, 15, 16, 200):
            p = image(rng, w, h, colours, rng.random() < 0.5)
            assert webp.decode(webp.encode(w, h, p, **STYLES[style])) == (w, h, p)


def test_a_public_image():
    """The one-pixel lossless image that browsers are probed with."""
    w, h, p = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (w, h, len(p)) == (1, 1, 1)


def test_broken_bytes_never_crash():
    rng = random.Random(1)
    good = webp.encode(9, 9, image(rng, 9, 9, 20, True), **webp.STYLES[3])
    for n in range(len(good)):
        with pytest.raises(webp.BadImage):
            webp.decode(good[: n // 2])
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(20, len(bad))] = rng.randrange(256)
        try:
            w, h, p = webp.decode(bytes(bad))
            assert len(p) == w * h
        except webp.BadImage:
            pass


def test_odd_rows(spark):
    p = [0xFF000000 | i * 65793 for i in range(12)]
    good = bytearray(webp.encode(4, 3, p))
    rows = [(1, good), (1, good), (2, None), (None, bytearray()), (3, bytearray(b"RIFF1234WEBPVP8 ")), (4, bytearray(b"x" * 300_000)), (5, bytearray(webp.encode(200, 300, p * 5000)))]
    df = spark.createDataFrame(rows, "vec_id long, image binary").selectExpr("*", "1 AS width", "2 AS `a.b`", "'e' AS media_error")
    got = webp.decode_media(df)
    assert got.columns == ["vec_id", "width", "a.b", "media_error", "_width", "height", "pixels", "_media_error"]
    by = {r.vec_id: r for r in got.collect()}
    assert got.count() == 7 and (by[1]._width, by[1].height, by[1].pixels, by[1]._media_error) == (4, 3, p, None)
    assert by[2].pixels is None and by[2]._media_error is None
    assert all(by[k].pixels is None and by[k]._media_error for k in (None, 3, 4)) and by[5].pixels == p * 5000
    assert webp.decode_media(df.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [0.5] * 7), (None, None), (2, []), (3, [None, 1.0])], "vec_id long, embedding array<float>")
    sizes = {r.vec_id: (r.width, r.height) for r in webp.decode_media(webp.thumbnails(vectors)).collect()}
    assert sizes == {1: (3, 3), None: (None, None), 2: (None, None), 3: (2, 1)}


class Bits:
    """Bits by hand, least significant first: (value, how many)."""

    def __init__(self, *fields):
        self.bits = "".join(f"{v:0{n}b}"[::-1] for v, n in fields if n)

    def code(self, *words):
        """Words of prefix codes, first bit first."""
        self.bits += "".join(words)
        return self

    def file(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def head(w, h, alpha=0):
    return [(0x2F, 8), (w - 1, 14), (h - 1, 14), (alpha, 1), (0, 3)]


def one(symbol):
    """A code of one symbol, which takes no bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    """A code of two symbols of one bit each."""
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def test_bits_written_by_hand():
    none = [(0, 1)]
    # 2 x 1, no transforms, no cache, one group: green 10 or 200, red 1, blue 2, alpha 255
    plain = Bits(*head(2, 1), *none, *none, *none, *two(10, 200), *one(1), *one(2), *one(255), *one(0)).code("0", "1")
    assert webp.decode(plain.file()) == (2, 1, [0xFF010A02, 0xFF01C802])
    # subtract green: red 1 + 10, blue 250 + 10 = 4
    green = Bits(*head(1, 1), (1, 1), (2, 2), *none, *none, *none, *one(10), *one(1), *one(250), *one(255), *one(0))
    assert webp.decode(green.file()) == (1, 1, [0xFF0B0A04])
    # predictor 2 (top) in blocks of 4: the first pixel adds to black, the next of its row to the left one, the second row to the top one
    modes = [*none, *one(2), *one(0), *one(0), *one(255), *one(0)]
    top = Bits(*head(2, 2), (1, 1), (0, 2), (0, 3), *modes, *none, *none, *none, *one(3), *one(5), *one(7), *one(0), *one(0))
    assert webp.decode(top.file()) == (2, 2, [0xFF050307, 0xFF0A060E, 0xFF0A060E, 0xFF0F0915])
    # a palette of 2 colours, 8 pixels to a byte: 0b0110 is colours 0, 1, 1, 0
    colours = [*none, *two(0, 50), *one(9), *one(0), *one(255), *one(0)]
    palette = Bits(*head(4, 1, 1), (1, 1), (3, 2), (1, 8), *colours).code("0", "1")
    rest = Bits(*none, *none, *none, *one(6), *one(0), *one(0), *one(255), *one(0))
    palette.bits += rest.bits
    assert webp.decode(palette.file()) == (4, 1, [0xFF090000, 0xFE123200, 0xFE123200, 0xFF090000])
    # green's code by code lengths: symbols 0 and 256 + 2 (a copy of 3) have one bit; distance code 1 is 2 (the pixel to the left)
    order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11]
    of = {18: 1, 0: 2, 1: 2}
    code = [(0, 1), (11, 4), *[(of.get(k, 0), 3) for k in order], (0, 1)]
    # words by length, then symbol: 18 is 0, 0 is 10, 1 is 11; an 18 repeats zeros 11 to 138 times
    copy = Bits(*head(4, 1), *none, *none, *none, *code).code("11", "0", f"{127:07b}"[::-1], "0", f"{118 - 11:07b}"[::-1], "10", "11", "0", f"{10:07b}"[::-1])
    copy.bits += Bits(*one(4), *one(8), *one(255), *one(1)).code("0", "1").bits
    assert webp.decode(copy.file()) == (4, 1, [0xFF040008] * 4)


def test_sizes_are_bounded(spark):
    huge = Bits(*head(16384, 16384), (0, 1), (0, 1), (0, 1), *one(1), *one(1), *one(1), *one(255), *one(0)).file()
    assert len(huge) < 60
    small = Bits(*head(700, 700), (0, 1), (0, 1), (0, 1), *one(1), *one(1), *one(1), *one(255), *one(0)).file()
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(small)), (3, bytearray(small)), (4, bytearray(small)), (5, None), (6, bytearray(small))], "vec_id long, image binary").coalesce(1)
    by = {r.vec_id: r for r in webp.decode_media(df).selectExpr("vec_id", "size(pixels) AS n", "media_error").collect()}
    assert "pixels" in by[1].media_error and [by[k].n for k in (2, 3, 4, 6)] == [490_000] * 4 and by[5].media_error is None
    assert {r.media_error is None for r in webp.decode_media(df, most_pixels=489_999).filter("vec_id <> 5").collect()} == {False}
