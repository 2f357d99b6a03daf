import struct
import zlib

import pytest

from talus.sources.beam import Atom, compact, dispatches, external, literals, pairs, profile, read_modules


def c(tag, v):
    """A compact term by the widths of its value."""
    if 0 <= v < 16:
        return bytes([v << 4 | tag])
    if 0 <= v < 2048:
        return bytes([v >> 8 << 5 | 8 | tag, v & 255])
    n = max(2, (v.bit_length() + 8) // 8)
    body = v.to_bytes(n, "big", signed=True)
    return bytes([n - 2 << 5 | 24 | tag]) + body if n < 9 else bytes([7 << 5 | 24 | tag]) + c(0, n - 9) + body


def code(*instructions):
    return struct.pack(">IIIII", 16, 0, 184, 1, 1) + b"".join(bytes([op]) + b"".join(terms) for op, *terms in instructions) + b"\x03"


def chunk(name, body):
    return name + struct.pack(">I", len(body)) + body + bytes(-len(body) % 4)


def file(*chunks):
    body = b"BEAM" + b"".join(chunks)
    return b"FOR1" + struct.pack(">I", len(body)) + body


NAMES = chunk(b"AtU8", struct.pack(">i", 2) + b"\x04Evil\x03run")


@pytest.mark.parametrize("v", [0, 15, 16, 2047, 2048, 40_000, -1, -40_000, 1 << 40, 1 << 90, -(1 << 90)])
def test_compact_terms_of_any_width(v):
    assert compact(c(1, v) + b"x", 0) == (1, v, len(c(1, v)))


def test_dispatch_counts_four_instructions_among_nested_terms():
    listed = b"\x17" + c(0, 4) + c(3, 1) + c(5, 300) + c(2, 5) + c(5, 2)
    typed, literal, alloc = b"\x57" + c(3, 2) + c(0, 9), b"\x47" + c(0, 5000), b"\x37" + c(0, 2) + c(0, 0) + c(0, 3) + c(0, 1) + c(0, 4)
    held = code((1, c(0, 1)), (59, c(3, 0), c(5, 1), listed), (75, c(0, 2)), (64, literal, c(3, 112)), (112, c(0, 3)), (13, alloc, c(0, 1), c(0, 2)), (113, c(0, 1), c(0, 70_000)), (178, typed, c(0, 1), c(4, 75)), (19,))
    assert dispatches(held) == 4
    with pytest.raises(ValueError):
        dispatches(held[:-1])
    with pytest.raises(ValueError):
        dispatches(code((200,)))


def test_external_terms():
    body = b"\x83l\0\0\0\3" + b"h\2w\3vsn" + b"l\0\0\0\1n\x09\0" + (1 << 70).to_bytes(9, "little") + b"j" + b"h\2d\0\1ak\0\2hi" + b"h\2a\1a\2" + b"j"
    assert pairs(body) == {"vsn": f"[{1 << 70}]", "a": "[104,105]"}
    packed = b"\x83P" + struct.pack(">I", len(body) - 1) + zlib.compress(body[1:])
    assert pairs(packed) == pairs(body) and isinstance(external(b"\x83w\1x"), Atom)
    assert pairs(b"\x83t\0\0\0\1a\1m\0\0\0\1z") == {} and external(b"\x83t\0\0\0\1a\1m\0\0\0\1z") == {"1": b"z"}


def test_literal_tables_compressed_and_plain():
    held = struct.pack(">I", 2) + b"".join(struct.pack(">I", len(t)) + t for t in (b"\x83a\5", b"\x83m\0\0\0\2ab"))
    assert literals(struct.pack(">I", len(held)) + zlib.compress(held)) == literals(bytes(4) + held) == 2
    with pytest.raises(ValueError):
        literals(struct.pack(">I", 99) + zlib.compress(held))


def test_damaged_files_give_a_reason_and_spare_their_neighbours(spark):
    sound = file(NAMES, chunk(b"Code", code((75, c(0, 1)))), chunk(b"Attr", b"\x83l\0\0\0\1h\2w\3vsna\7j"))
    long_names = file(chunk(b"AtU8", struct.pack(">i", -1) + c(0, 300) + b"n" * 300))
    assert profile(long_names)[0] == "n" * 300
    rows = [("a", sound), ("b", sound[:40]), ("c", b""), ("d", None), ("e", file(NAMES, chunk(b"Code", code((75,))[:-1]))), ("f", sound), ("g", file(chunk(b"Attr", b"\x83j")))]
    got = {r.path: r for r in read_modules(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p for p, r in got.items() if r.reason is None} == {"a", "f"} and len(got) == 7
    assert all(r.module is None and r.reason for p, r in got.items() if p not in "af")
    assert (got["a"].module, got["a"].dispatch, got["a"].attributes) == ("Evil", 1, {"vsn": "7"})
