"""Motion-JPEG in AVI as numpy codes: a lossless store for bytes, and a reader with shots.

The format's unit is the quantised coefficient. A byte b is the coefficient whose magnitude bits are
b: all of them fall into size category 8 (128..255 and -255..-128). With one Huffman code for that
category, quantisers of 1 and a restart after every block, 64 bytes make one 8x8 block of baseline
JPEG, coefficients and nothing else are stored, and reading them back is exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: A frame is 4 x 4 blocks: 32 x 32 samples, 1024 payload bytes.
SIDE, BLOCK = 4, 64
FRAME_BLOCKS = SIDE * SIDE
FRAME_BYTES = FRAME_BLOCKS * BLOCK
FRAMES_A_SECOND = 10
BINS = 16


def zigzag() -> np.ndarray:
    """The natural place of each coefficient in diagonal order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def inverse_dct() -> np.ndarray:
    """64 x 64: samples of each coefficient in diagonal order, in units of 1/1024, whole numbers.

    Sums of products with coefficients stay below 2**24, so float32 products are exact in any order.
    """
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.sqrt(np.where(u == 0, 1, 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16)
    full = np.einsum("ay,bx->abyx", one, one).reshape(64, 64)
    return np.rint(full[zigzag()] * 1024).astype(np.float32)


_SAMPLES = inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int) -> bytes:
    """A Huffman table with one code, the single bit 0, for size category 8 without a run."""
    return bytes([kind, 1, *[0] * 15, 8])


HEADER = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0)),
        _segment(0xC4, _table(0x00)),
        _segment(0xC4, _table(0x10)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)
END = b"\xff\xd9"


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """A JPEG for every FRAME_BYTES of ``payload``, whose length is a multiple of that."""
    blocks = payload.reshape(-1, BLOCK)
    bits = np.zeros((len(blocks), BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, BLOCK, 8)
    out = np.empty((len(blocks), 74), np.uint8)
    out[:, :72] = np.packbits(bits.reshape(len(blocks), -1), axis=1)
    out[:, 72] = 0xFF
    out[:, 73] = 0xD0 + np.arange(len(blocks)) % FRAME_BLOCKS % 8
    stuffed = np.zeros(out.shape, np.int64)
    stuffed[:, :72] = out[:, :72] == 0xFF
    flat, more = out.ravel(), stuffed.ravel()
    place = np.cumsum(more) - more + np.arange(len(flat))
    body = np.zeros(len(flat) + int(more.sum()), np.uint8)
    body[place] = flat
    ends = (place[73::74] + 1)[FRAME_BLOCKS - 1 :: FRAME_BLOCKS]
    whole = body.tobytes()
    starts = np.concatenate([[0], ends[:-1]])
    # the last block's restart marker makes way for the end marker
    return [HEADER + whole[a : b - 2] + END for a, b in zip(starts.tolist(), ends.tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], payload_bytes: int) -> bytes:
    """One video stream; the chunk ``plen`` holds the number of payload bytes."""
    side = 8 * SIDE
    top = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, top * FRAMES_A_SECOND, 0, 0x10, len(frames), 0, 1, top, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, len(frames), top, 0, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi = b"".join(_chunk(b"00dc", f) for f in frames)
    sizes = np.array([len(f) for f in frames], np.uint32)
    index = np.empty((len(frames), 4), np.uint32)
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(sizes + sizes % 2 + 8) - (sizes + sizes % 2 + 8)
    index[:, 3] = sizes
    body = head + _chunk(b"plen", struct.pack("<Q", payload_bytes)) + _list(b"movi", movi) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", b"AVI " + body)


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two offsets; a list is named by its type."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        lo, hi = start + 8, min(end, start + 8 + size)
        if name in (b"RIFF", b"LIST"):
            yield data[lo : lo + 4], lo + 4, hi
        else:
            yield name, lo, hi
        start = lo + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], int | None]:
    """(frames in the order of the index, payload bytes if told)."""
    top = next(chunks(data, 0, len(data)), None)
    if top is None or top[0] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {name: (lo, hi) for name, lo, hi in chunks(data, top[1], top[2])}
    told = struct.unpack_from("<Q", data, found[b"plen"][0])[0] if b"plen" in found else None
    base = found[b"movi"][0] - 4
    if b"idx1" not in found:
        return [data[lo:hi] for name, lo, hi in chunks(data, *found[b"movi"]) if name[2:] in (b"dc", b"db")], told
    lo, hi = found[b"idx1"]
    entries = np.frombuffer(data, np.uint32, (hi - lo) // 16 * 4, lo).reshape(-1, 4)
    return [data[base + o + 8 : base + o + 8 + n] for o, n in zip(entries[:, 2].tolist(), entries[:, 3].tolist())], told


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, blocks, 64) coefficient bytes in diagonal order."""
    for f in frames:
        if f[: len(HEADER)] != HEADER or f[-2:] != END:
            raise ValueError("a frame with other tables or another size")
    data = np.frombuffer(b"".join(f[len(HEADER) : -2] + b"\xff\xd0" for f in frames), np.uint8)
    after = data[:-1] == 0xFF
    keep = np.ones(len(data), bool)
    keep[1:] &= ~after  # stuffed zeros and the second byte of markers
    marker = np.flatnonzero(after & (data[1:] != 0))
    keep[marker] = False
    bits = np.unpackbits(data[keep].reshape(-1, 72), axis=1).reshape(-1, BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("a coefficient of another size category")
    return np.packbits(bits[:, :, 1:].reshape(len(bits), -1), axis=1).reshape(len(frames), -1, BLOCK)


def luma(coefficients: np.ndarray) -> np.ndarray:
    """(frames, samples) 8-bit samples of decoded frames, block by block."""
    values = coefficients.reshape(-1, BLOCK).astype(np.float32)
    values[values < 128] -= 255
    samples = np.floor((values @ _SAMPLES + 512) / 1024) + 128
    return np.clip(samples, 0, 255).astype(np.uint8).reshape(len(coefficients), -1)


@dataclass(frozen=True)
class Shots:
    starts: np.ndarray
    ends: np.ndarray
    mean: np.ndarray


def shots(samples: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a shot begins at each frame, mean luma). ``first`` marks each file's first frame.

    A shot begins where the histogram difference to the frame before exceeds the mean of the file's
    earlier differences by two deviations and a tenth of the samples.
    """
    n, size = samples.shape
    bins = (samples // (256 // BINS)).astype(np.int64) + (np.arange(n) * BINS)[:, None]
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    gap = np.zeros(n)
    gap[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1)
    gap[first] = 0
    file = np.cumsum(first) - 1
    begin = np.flatnonzero(first)[file]
    total, square = np.concatenate([[0], np.cumsum(gap)]), np.concatenate([[0], np.cumsum(gap * gap)])
    at = np.arange(n)
    count = np.maximum(at - begin - 1, 1)  # earlier differences of this file
    mean = (total[at] - total[begin]) / count
    deviation = np.sqrt(np.maximum((square[at] - square[begin]) / count - mean * mean, 0))
    cut = (at - begin >= 2) & (gap > mean + 2 * deviation + 0.1 * size)
    return first | cut, samples.sum(axis=1) // size
