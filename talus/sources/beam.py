"""Compiled modules as profiles: imports, exports, atoms, attributes and dispatch instructions from their chunk files.

A chunk file that isn't one, or whose tables are cut short, gives a row with the reason and no profile.
The code chunk is a run of instructions, each an opcode and as many compact terms as the opcode takes;
compact terms have one to many bytes, so it is read from its start. Attributes are external terms.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

PROFILE = (
    "module string, imports array<struct<m:string,f:string,a:int>>, exports array<struct<f:string,a:int>>, atoms array<string>, "
    "attributes map<string,string>, compile_info map<string,string>, n_literals int, dispatch int, reason string"
)
# How many terms each opcode takes, from opcode 1 on, ten to a line.
ARITIES = bytes(
    int(x)
    for line in (
        "1 3 0 2 3 2 2 3 2 4",
        "5 2 3 2 3 2 1 1 0 0",
        "0 0 2 1 1 2 4 4 4 4",
        "4 4 4 4 4 4 4 3 3 3",
        "3 3 3 3 2 2 2 2 2 2",
        "2 2 2 2 2 2 2 3 3 3",
        "1 2 1 2 3 3 3 3 3 2",
        "1 1 0 1 1 3 2 2 2 5",
        "5 5 4 2 1 1 2 2 5 5",
        "5 2 1 0 1 2 2 4 4 4",
        "4 3 1 2 1 1 1 2 6 3",
        "5 1 2 2 3 5 7 7 7 5",
        "3 2 2 5 6 2 2 2 2 1",
        "3 4 0 8 6 2 6 5 4 5",
        "4 5 4 3 3 3 3 3 0 1",
        "1 7 1 5 5 2 3 3 4 0",
        "0 2 2 2 3 4 3 2 2 4",
        "3 1 2 1 1 1 6 3 0 1",
        "5 3 2 4",
    )
    for x in line.split()
)
# call_fun, apply, apply_last, call_fun2.
DISPATCH = (75, 112, 113, 178)
END_OF_CODE = 3


class Atom(str):
    """An atom of an external term."""


def chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:4] != b"FOR1" or data[8:12] != b"BEAM":
        raise ValueError("not a compiled module")
    if struct.unpack_from(">I", data, 4)[0] + 8 > len(data):
        raise ValueError("the file is cut short")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError(f"chunk {name.decode('latin-1')} is cut short")
        out[name] = data[at + 8 : at + 8 + size]
        at += 8 + (size + 3) // 4 * 4
    return out


def compact(body: bytes, at: int) -> tuple[int, int, int]:
    """(tag, value, next place) of a compact term; the value of a nested one is what its parts leave aside."""
    first = body[at]
    tag, at = first & 7, at + 1
    if not first & 8:
        value = first >> 4
    elif not first & 16:
        value, at = (first >> 5) << 8 | body[at], at + 1
    else:
        size = (first >> 5) + 2
        if first >> 5 == 7:
            _, more, at = compact(body, at)
            size = more + 9
        if at + size > len(body):
            raise ValueError("a compact term is cut short")
        value, at = int.from_bytes(body[at : at + size], "big", signed=True), at + size
    if tag < 7:
        return tag, value, at
    # extended terms: 1 a list, 2 a float register, 3 an allocation list, 4 a literal, 5 a typed register
    if value in (2, 4):
        _, number, at = compact(body, at)
        return tag, number, at
    if value in (1, 3, 5):
        number = 1
        if value != 5:
            _, number, at = compact(body, at)
        for _ in range(number * (1 if value == 1 else 2)):
            _, _, at = compact(body, at)
        return tag, number, at
    raise ValueError(f"unknown extended term {value}")


def dispatches(code: bytes) -> int:
    """The number of instructions of a code chunk that call what only the run knows."""
    head = struct.unpack_from(">I", code)[0]
    highest = struct.unpack_from(">I", code, 8)[0]
    if highest > len(ARITIES):
        raise ValueError(f"opcode {highest} isn't known")
    at, count = 4 + head, 0
    while at < len(code):
        op = code[at]
        if op == END_OF_CODE:
            return count
        if not 0 < op <= len(ARITIES):
            raise ValueError(f"opcode {op} isn't known")
        at, count = at + 1, count + (op in DISPATCH)
        for _ in range(ARITIES[op - 1]):
            _, _, at = compact(code, at)
    raise ValueError("the code has no end")


def atoms(body: bytes) -> list[str]:
    """Names by number from 1; a negative count tells of lengths as compact terms."""
    count, at, out = struct.unpack_from(">i", body)[0], 4, []
    for _ in range(abs(count)):
        size, at = (body[at], at + 1) if count >= 0 else compact(body, at)[1:]
        if at + size > len(body):
            raise ValueError("the atoms are cut short")
        out.append(body[at : at + size].decode())
        at += size
    return out


def _several(body: bytes, at: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        value, at = term(body, at)
        out.append(value)
    return out, at


def term(body: bytes, at: int) -> tuple[object, int]:
    """An external term behind its version byte, and the next place."""
    tag, at = body[at], at + 1
    size = {100: ">H", 118: ">H", 107: ">H", 115: ">B", 119: ">B", 104: ">B", 110: ">B", 105: ">I", 108: ">I", 109: ">I", 111: ">I", 116: ">I"}.get(tag)
    n = 0
    if size:
        n, at = struct.unpack_from(size, body, at)[0], at + struct.calcsize(size)
    if tag == 97:
        return body[at], at + 1
    if tag == 98:
        return struct.unpack_from(">i", body, at)[0], at + 4
    if tag == 70:
        return struct.unpack_from(">d", body, at)[0], at + 8
    if tag == 106:
        return [], at
    if tag in (104, 105, 108, 116):
        out, at = _several(body, at, n * 2 if tag == 116 else n)
        if tag == 116:
            return dict(zip(map(as_text, out[::2]), out[1::2])), at
        if tag != 108:
            return tuple(out), at
        tail, at = term(body, at)
        return (out if tail == [] else [*out, tail]), at
    if tag in (110, 111):
        value = int.from_bytes(body[at + 1 : at + 1 + n], "little")
        return -value if body[at] else value, at + 1 + n
    if tag in (100, 115, 118, 119, 107, 109):
        held = body[at : at + n]
        if len(held) < n:
            raise ValueError("a term is cut short")
        return (list(held) if tag == 107 else held if tag == 109 else Atom(held.decode("utf-8" if tag > 115 else "latin-1"))), at + n
    raise ValueError(f"unknown term {tag}")


def external(body: bytes) -> object:
    if body[:1] != b"\x83":
        raise ValueError("not an external term")
    if body[1:2] == b"P":
        return term(zlib.decompress(body[6:]), 0)[0]
    return term(body, 1)[0]


def as_text(value: object) -> str:
    """A term as its language writes it."""
    if isinstance(value, list):
        return "[" + ",".join(map(as_text, value)) + "]"
    if isinstance(value, tuple):
        return "{" + ",".join(map(as_text, value)) + "}"
    if isinstance(value, dict):
        return "#{" + ",".join(f"{k}=>{as_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, bytes):
        return "<<" + ",".join(map(str, value)) + ">>"
    return str(value)


def pairs(body: bytes | None) -> dict[str, str]:
    """The pairs of a list whose first parts are atoms; of equal ones the last counts."""
    found = external(body) if body else []
    return {str(x[0]): as_text(x[1]) for x in found if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], Atom)} if isinstance(found, list) else {}


def literals(body: bytes | None) -> int:
    """How many terms a literal table holds; it is compressed unless its size is given as 0."""
    if not body:
        return 0
    size = struct.unpack_from(">I", body)[0]
    held = zlib.decompress(body[4:]) if size else body[4:]
    if size and len(held) != size:
        raise ValueError("the literals are cut short")
    count, at = struct.unpack_from(">I", held)[0], 4
    for _ in range(count):
        length = struct.unpack_from(">I", held, at)[0]
        external(held[at + 4 : at + 4 + length])
        at += 4 + length
    return count


def profile(data: bytes) -> tuple:
    found = chunks(data)
    names = [""] + atoms(found.get(b"AtU8", found.get(b"Atom", b"")))
    triples = lambda b: list(struct.iter_unpack(">III", b[4 : 4 + 12 * struct.unpack_from(">I", b)[0]]))
    imports = [(names[m], names[f], a) for m, f, a in triples(found.get(b"ImpT", b"\0" * 4))]
    exports = [(names[f], a) for f, a, _ in triples(found.get(b"ExpT", b"\0" * 4))]
    dispatch = dispatches(found[b"Code"]) if b"Code" in found else 0
    return names[1], imports, exports, names[1:], pairs(found.get(b"Attr")), pairs(found.get(b"CInf")), literals(found.get(b"LitT")), dispatch, None


@udtf(returnType=PROFILE)
class Profiles:
    def eval(self, content: bytes):
        try:
            yield profile(bytes(content))
        except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error, RecursionError) as e:
            yield None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def read_modules(found: DataFrame) -> DataFrame:
    """``found`` (path and other columns, content binary) with each file's profile, or the reason why it has none."""
    return found.lateralJoin(Profiles(F.col("content").outer())).drop("content")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """path and profile of each compiled module below ``path``; a file of several builds counts for each of them."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.beam").load(path)
    return read_modules(read.select("path", "content")).where("reason is null").drop("reason")
