import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skirmish.llm import media

from .helpers import SCHEMA, awkward, clashing, frame


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_round_trip(data):
    payload = media.pad(data)
    image = media.decode(media.encode(payload))
    assert media.payload_of(image) == payload


def test_large_payload_crosses_coding_groups():
    payload = media.pad(np.random.default_rng(1).integers(0, 256, 64 * 20_001, dtype=np.uint8).tobytes())
    assert media.payload_of(media.decode(media.encode(payload))) == payload


def test_symbols_and_arrays_agree(monkeypatch):
    payload = media.pad(bytes(range(256)) * 3)
    jpeg = media.encode(payload)
    fast = media.decode(jpeg)
    monkeypatch.setattr(media, "_by_array", lambda scan, n: None)
    slow = media.decode(jpeg)
    assert (fast.coefficients == slow.coefficients).all() and (fast.luma == slow.luma).all()


def _bits(values):
    text = "".join(values)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_colour_file_with_sampling_restarts_and_runs():
    """A file written by hand: 16 x 16, luminance 2 x 2, two chroma components."""
    dc = ([0, 2, 0] + [0] * 13, [0, 5])  # 00: size 0, 01: size 5
    ac = ([0, 3] + [0] * 14, [0x00, 0xF0, 0x21])  # 00: end, 01: sixteen zeros, 10: two zeros, then size 1
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([4]) + b"\1" * 63) + seg(0xC0, b"\x08\0\x10\0\x10\x03" + b"\1\x22\0\2\x11\0\3\x11\0")
    head += seg(0xC4, b"\0" + bytes(dc[0]) + bytes(dc[1])) + seg(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1])) + seg(0xDD, b"\0\1") + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
    blocks = ["01" + "10100" + "00", "00" + "01" + "10" + "1" + "00", "01" + "01011" + "00", "00" + "00", "00" + "00", "00" + "00"]
    image = media.decode(head + _bits(blocks) + b"\xff\xd9")
    assert (image.width, image.height) == (16, 16)
    dcs = [20, 20, 0, 0]
    assert image.coefficients[:, 0].tolist() == dcs
    assert image.coefficients[1].nonzero()[0].tolist() == [0, 19]
    assert image.luma.tolist() == [[138, 138], [128, 128]]


def test_broken_files_give_nulls(spark):
    good = media.encode(media.pad(b"hello"))
    df = spark.createDataFrame([(1, good), (2, None), (3, b"no"), (4, good[:40])], "doc_id long, media binary")
    got = {r["doc_id"]: (r["width"], r["height"]) for r in media.jpeg_features(df).collect()}
    assert got == {1: (8, 8), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_digests_of_awkward_rows(spark):
    rows = awkward() + [(None, "no id", None, None, None)]
    got = media.digest_stored(media.store_text(clashing(frame(spark, rows)))).collect()
    assert len(got) == len(rows)
    by_id, by_text = {r["doc_id"]: r for r in got}, {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by_id[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        rest = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(text or "", rest) == rest
    assert media.digest_stored(media.store_text(spark.createDataFrame([], SCHEMA))).count() == 0
