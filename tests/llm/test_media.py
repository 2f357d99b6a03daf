import hashlib
import random
import zlib

import numpy as np
import pytest

from talus.llm import avi, op6
from talus.llm.media import clip_rows, read_media, store_texts


def padded(text):
    b = (text or "").encode()
    return b + b"\0" * (max(1, -(-len(b) // 64)) * 64 - len(b))


def test_round_trip_of_all_bytes():
    r = np.random.default_rng(1)
    payload = np.concatenate([np.full(1024, 255, np.uint8), np.zeros(1024, np.uint8), r.integers(0, 256, 4096).astype(np.uint8)])
    frames = avi.encode_frames(payload)
    assert avi.decode_frames(frames).tobytes() == payload.tobytes()
    assert avi.read_avi(avi.write_avi(frames, 5000)) == (frames, 5000)
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFX")


def test_samples_follow_the_cosine_transform():
    c = np.full((1, 1, 64), 128, np.uint8)
    values = np.where(c[0, 0] < 128, c[0, 0].astype(int) - 255, c[0, 0].astype(int))
    natural = np.zeros((8, 8))
    natural.ravel()[avi.zigzag()] = values
    a = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    want = np.clip(a.T @ natural @ a + 128, 0, 255)
    assert np.abs(avi.luma(c).reshape(8, 8) - want).max() <= 8


def test_shots_split_where_histograms_jump():
    frames = np.concatenate([np.full((6, 1024), 20), np.full((6, 1024), 200)]).astype(np.uint8)
    first = np.zeros(12, bool)
    first[0] = True
    assert np.flatnonzero(avi.shots(frames, first)[0]).tolist() == [0, 6]


def test_query_reads_back_what_it_stores(spark, tmp_path):
    r = random.Random(2)
    rows = [(1, None, "m"), (2, "", "m"), (3, "x" * 64, "m"), (4, "é" * 700, "m"), (4, "é" * 700, "n"), (None, "y" * 9000, "m")]
    rows += [(10 + i, "".join(chr(r.choice([65, 233, 8364, 128512])) for _ in range(r.randint(0, 3000))), "z") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6.op6_avi_mjpeg(spark, str(tmp_path)).collect()}
    for d, t, _ in rows:
        p = padded(t)
        assert got[d].n_bytes == len((t or "").encode()) and got[d].payload_bytes == len(p)
        assert got[d].payload_sha256 == hashlib.sha256(p).hexdigest() and got[d].tail_crc32 == zlib.crc32(p[-64:])
    frame = spark.createDataFrame(rows, "doc_id long, text string, media string")
    clips = clip_rows(read_media(store_texts(frame))).where("doc_id is null").orderBy("clip").collect()
    assert clips[0].start_ms == 0 and clips[-1].end_ms == 900
    assert read_media(store_texts(frame.limit(0))).collect() == []


def test_damaged_files_give_nulls_and_spare_their_neighbours(spark):
    good = bytes(store_texts(spark.createDataFrame([(1, "some text of one document")], "doc_id long, text string")).first().media)
    rows = [(1, good, 25), (2, good[:40], 25), (3, b"no file", 25), (4, good[:-700] if len(good) > 1400 else good[: len(good) // 2], 25), (5, None, 25), (6, good.replace(b"\xff\xdb", b"\xff\xdc"), 25)]
    frame = store_texts(spark.createDataFrame([(0, "x")], "doc_id long, text string"))
    media = spark.createDataFrame(rows, "doc_id long, media binary, n_bytes long").select(*frame.columns)
    got = {r.doc_id: r.payload for r in read_media(media).collect()}
    assert bytes(got[1]).rstrip(b"\0") == b"some text of one document" and len(got) == 6
    assert got[2] is None and got[3] is None and got[5] is None and got[6] is None
