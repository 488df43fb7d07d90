from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lattica.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NO_COMPRESSION, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, tile, predictor, order):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 4, (37, 50)).astype(np.uint8), rng.integers(0, 256, (20, 33, 3)).astype(np.uint8), rng.integers(0, 65536, (5, 70)).astype(np.uint16), np.zeros((1, 1), np.uint8)]
    found = list(tiff.decode_pages(tiff.encode(images, compression, predictor, rows_per_strip=8, tile=tile, order=order)))
    assert [p.number for p in found] == [0, 1, 2, 3]
    for p, image in zip(found, images, strict=True):
        assert p.data == image.tobytes()
        assert (p.height, p.width) == image.shape[:2]


@pytest.mark.parametrize("seed", range(12))
def test_codecs(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"ab\0") if r.random() < 0.7 else r.randrange(256) for _ in range(r.choice([0, 1, 2, 127, 128, 129, 9000, 40000])))
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_pages_of_a_column_and_damaged_files(spark):
    good = tiff.encode([np.arange(12, dtype=np.uint8).reshape(3, 4)] * 2)
    loop = bytearray(tiff.encode([np.zeros((2, 2), np.uint8)]))
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", loop, 4)[0])
    files = [(1, good), (2, None), (3, b"no image"), (4, good[: len(good) // 2]), (5, bytes(loop)), (6, b"")]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d), "x") for k, d in files], "id int, media binary, page string")
    got: dict = {}
    for r in tiff.pages(df).collect():
        got.setdefault(r["id"], []).append((r["page"], r["error"] is None, r["pixels"]))
    assert [x[:2] for x in got[1]] == [(0, True), (1, True)] and bytes(got[1][0][2]) == bytes(range(12))
    assert 2 not in got and all(not got[k][-1][1] for k in (3, 4, 5, 6))


def patched(data, page, **tags):
    """The little-endian file with short or long values of a page's directory replaced."""
    out = bytearray(data)
    at = struct.unpack_from("<I", out, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", out, at + 2 + 12 * struct.unpack_from("<H", out, at)[0])[0]
    for k in range(struct.unpack_from("<H", out, at)[0]):
        tag, kind = struct.unpack_from("<HH", out, at + 2 + 12 * k)
        for name, value in tags.items():
            if tag == getattr(tiff, name):
                struct.pack_into("<H" if kind == 3 else "<I", out, at + 10 + 12 * k, value)
    return bytes(out)


def test_a_page_that_is_not_read_leaves_the_others(spark):
    three = tiff.encode([np.full((2, 3), k, np.uint8) for k in range(3)])
    unread = patched(three, 1, COMPRESSION=7)
    df = spark.createDataFrame([(1, bytearray(unread))], "id int, media binary")
    got = [(r["page"], r["error"] is None, r["pixels"] and bytes(r["pixels"])) for r in tiff.pages(df).orderBy("page").collect()]
    assert got == [(0, True, bytes(6)), (1, False, None), (2, True, bytes([2] * 6))]


@pytest.mark.parametrize("compression", [tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.NO_COMPRESSION])
@pytest.mark.parametrize("bits", [1, 4])
def test_samples_of_less_than_a_byte(compression, bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 11), np.uint8)
    cells = np.unpackbits(image[:, :, None], axis=2)[:, :, 8 - bits :].reshape(5, -1)
    packed = np.packbits(cells, axis=1)
    (page,) = tiff.decode_pages(patched(tiff.encode([packed], compression), 0, WIDTH=11, BITS=bits))
    assert (page.width, page.height, page.bits, page.data) == (11, 5, bits, image.tobytes())


@pytest.mark.parametrize("compression", [tiff.NO_COMPRESSION, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("planes", [False, True])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_planes_and_predictors(compression, planes, predictor, order):
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 2**32, (21, 18, 3), np.uint32), rng.random((9, 40), np.float32).view(np.uint32), rng.integers(0, 2**16, (7, 5, 2)).astype(np.uint16)]
    for tile in (None, (16, 16)):
        found = list(tiff.decode_pages(tiff.encode(images, compression, predictor, 5, tile, order, planes=planes)))
        assert [p.data for p in found] == [i.tobytes() for i in images]


def test_bits_in_the_other_order():
    image = np.random.default_rng(1).integers(0, 2, (6, 16), np.uint8)
    file = bytearray(patched(tiff.encode([np.packbits(image, axis=1)], tiff.NO_COMPRESSION), 0, WIDTH=16, BITS=1))
    at = struct.unpack_from("<I", file, 4)[0]
    place = at + 2 + 12 * [struct.unpack_from("<H", file, at + 2 + 12 * k)[0] for k in range(struct.unpack_from("<H", file, at)[0])].index(tiff.PREDICTOR)
    struct.pack_into("<HHIH", file, place, tiff.FILL_ORDER, 3, 1, 2)
    (page,) = tiff.decode_pages(bytes(file))
    assert page.data == image.reshape(6, 2, 8)[:, :, ::-1].tobytes()


@pytest.mark.parametrize("tags", [{"WIDTH": 0}, {"WIDTH": 4_000_000, "HEIGHT": 4_000_000}, {"HEIGHT": 0}, {"ROWS": 0}, {"BITS": 7}, {"COMPRESSION": 7}, {"PREDICTOR": 9}, {"SAMPLES": 0}, {"SAMPLES": 60_000}, {"STRIP_AT": 2**31}, {"STRIP_BYTES": 0}])
def test_damaged_headers_give_an_error_row(tags):
    for compression in (tiff.DEFLATE, tiff.LZW, tiff.PACKBITS, tiff.NO_COMPRESSION):
        file = patched(tiff.encode([np.arange(30, dtype=np.uint8).reshape(5, 6)], compression), 0, **tags)
        (row,) = tiff._rows(file)
        assert row[0] == 0 and row[-1] and row[1] is None


def test_a_field_without_values_gives_an_error_row():
    file = bytearray(tiff.encode([np.zeros((2, 2), np.uint8)]))
    at = struct.unpack_from("<I", file, 4)[0]
    for k in range(struct.unpack_from("<H", file, at)[0]):
        struct.pack_into("<I", file, at + 2 + 12 * k + 4, 0)
    assert [r[-1] is None for r in tiff._rows(bytes(file))] == [False]


@pytest.mark.parametrize("seed", range(6))
def test_random_damage_never_ends_a_job(seed):
    r = random.Random(seed)
    good = tiff.text_image(bytes(r.randrange(256) for _ in range(40_000)))
    for _ in range(40):
        file = bytearray(good)
        for _ in range(r.randint(1, 6)):
            file[r.choice([r.randrange(len(file)), r.randrange(len(file) - 600, len(file))])] = r.randrange(256)
        assert all(len(row) == len(tiff.PAGE) for row in tiff._rows(bytes(file[: r.choice([len(file), r.randrange(len(file))])])))


def test_texts_take_every_kind_and_come_back(spark):
    r = random.Random(5)
    texts = ["a\0", "\0", "", "\0" * 64, "é" * 30_000, "ab" * 60_000] + ["".join(r.choice("abc é\n") for _ in range(r.choice([10, 17_000, 50_000]))) for _ in range(20)]
    assert all(tiff.image_text(tiff.text_image(t.encode())) == t.encode() for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    found = tiff.text_pages(docs).collect()
    assert {(p["compression"], p["predictor"]) for p in found} == {k[:2] for k in tiff.KINDS}
    by_doc: dict = {}
    for p in sorted(found, key=lambda p: p["page"]):
        by_doc.setdefault(p["doc_id"], []).append(p)
    for k, t in enumerate(texts):
        payload = tiff.text_payload(t.encode())
        size = tiff.ROW * tiff.PAGE_ROWS
        assert [p["pixels_sha256"] for p in by_doc[k]] == [hashlib.sha256(payload[y : y + size]).hexdigest() for y in range(0, len(payload), size)]
        assert [p["page"] for p in by_doc[k]] == list(range(len(by_doc[k]))) and not any(p["error"] for p in by_doc[k])


def test_texts_as_media(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    found = tiff.texts_as_media(docs).collect()
    assert len(found) == len(texts)
    by_text: dict = {}
    for r in found:
        data = texts[r["doc_id"]]
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = tiff.text_image(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(data, r["feature"]) == r["feature"]
    back = tiff.media_text(tiff.text_media(docs.select("doc_id", "text")).drop("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t.decode() for k, t in texts.items()}
    assert tiff.texts_as_media(docs.limit(0)).collect() == []
