"""Media columns: texts stored as AVI motion-JPEG, and AVI columns read into payloads and timed clips.

Defined cases: a null text is empty and stored as 64 zero bytes; a null media value gives nulls and
no clips; bytes that are not such a file raise in ``read_media``; repeated rows are separate; other
columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import avi
from talus.llm.buffers import slices, text_view

_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
CLIP = pa.struct([("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("luma", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("clips", pa.list_(CLIP))])
READ = (
    "doc_id long, n_bytes long, media binary, payload binary, "
    "clips array<struct<clip:int,start_frame:int,end_frame:int,start_ms:long,end_ms:long,luma:long>>"
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        data, offsets = text_view(part.column("text"))
        sizes = np.diff(offsets)
        padded = np.maximum(-(-sizes // avi.BLOCK), 1) * avi.BLOCK
        frames = -(-padded // avi.FRAME_BYTES)
        starts = np.concatenate([[0], np.cumsum(frames * avi.FRAME_BYTES)])
        payload = np.zeros(int(starts[-1]), np.uint8)
        row = np.repeat(np.arange(len(sizes)), sizes)
        payload[np.arange(len(data)) - offsets[row] + starts[row]] = data
        every = avi.encode_frames(payload)
        ends = np.cumsum(frames)
        media = [avi.write_avi(every[b - n : b], int(p)) for b, n, p in zip(ends.tolist(), frames.tolist(), padded)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(media, pa.binary())], schema=_STORED)


def _opened(media: bytes | None) -> tuple | None:
    """What ``read_avi`` finds; None for null and for what isn't a whole file."""
    try:
        return None if media is None else avi.read_avi(media)
    except (KeyError, ValueError, struct.error):
        return None


def _decoded(files: list) -> tuple[list, np.ndarray | None]:
    """(files, coefficients of all their frames); a file whose frames can't be decoded becomes None alone."""
    every = [f for x in files if x for f in x[0]]
    try:
        return files, avi.decode_frames(every) if every else None
    except ValueError:
        if len(files) == 1:
            return [None], None
        parts = [_decoded([x]) for x in files]
        held = [c for _, c in parts if c is not None]
        return [x for (x,), _ in parts], np.concatenate(held) if held else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "media"):
        files, coefficients = _decoded([_opened(m) for m in part.column("media").to_pylist()])
        every = [f for x in files if x for f in x[0]]
        counts = np.array([len(x[0]) if x else 0 for x in files])
        ends = np.cumsum(counts)
        payloads, clips = [], []
        if every:
            first = np.zeros(len(every), bool)
            first[(ends - counts)[counts > 0]] = True
            begins, mean = avi.shots(avi.luma(coefficients), first)
            cuts = np.flatnonzero(begins)
        for x, n, end in zip(files, counts.tolist(), ends.tolist()):
            if x is None:
                payloads.append(None)
                clips.append(None)
                continue
            if not n:
                payloads.append(b"")
                clips.append([])
                continue
            body = coefficients[end - n : end].tobytes()
            payloads.append(body if x[1] is None else body[: x[1]])
            a = cuts[np.searchsorted(cuts, end - n) : np.searchsorted(cuts, end)]
            b = np.append(a[1:], end)
            sums = np.add.reduceat(mean[end - n : end], a - (end - n)) // (b - a)
            step = 1000 // avi.FRAMES_A_SECOND
            clips.append(
                [
                    {"clip": i, "start_frame": s, "end_frame": e, "start_ms": s * step, "end_ms": e * step, "luma": m}
                    for i, (s, e, m) in enumerate(zip((a - (end - n)).tolist(), (b - (end - n)).tolist(), sums.tolist()))
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("n_bytes"), part.column("media"), pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(CLIP))],
            schema=_READ,
        )


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an AVI file."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the stored payload and the file's clips."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """A row for each timed clip."""
    return read.select("doc_id", F.inline("clips"))
