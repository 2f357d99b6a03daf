"""Small text expressions around paths, names and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(path: Column) -> Column:
    """``deps/...`` of a path that holds ``/deps/`` once, else the path."""
    return F.when(F.size(F.split(path, "/deps/")) == 2, F.concat(F.lit("deps/"), F.substring_index(path, "/deps/", -1))).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slug(name: Column) -> Column:
    """A module name as a file name."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_")


def summary(text: Column, most: int = 80) -> Column:
    return F.left(text, F.lit(most))


def valid_name(name: Column) -> Column:
    """Whether a package name has the registry's form."""
    return F.coalesce(name.rlike(r"^[a-z][a-z0-9_]{0,63}$"), F.lit(False))


def line_of(text: Column, literal: Column, needle: int = 40) -> Column:
    """The first line that holds the beginning of a literal; 1 where none does."""
    hit = F.array_position(F.transform(F.split(text, "\n"), lambda x: F.contains(x, F.left(literal, F.lit(needle)))), True)
    return F.greatest(F.lit(1), hit.cast("int"))


def outside(path: Column, folder: Column) -> Column:
    """Whether a path lies outside a working folder."""
    return ~F.startswith(path, folder)


def encoded_key(kind: str, raw: Column) -> Column:
    """A 32-byte key as its kind and unpadded URL-safe base64; null for other sizes."""
    text = F.translate(F.base64(raw), "+/=", "-_")
    return F.when(F.octet_length(raw) == 32, F.concat(F.lit(f"ed25519-{kind}:"), text))


def decoded_key(kind: str, text: Column) -> Column:
    """The 32 bytes of ``encoded_key``; null for anything else."""
    head = f"ed25519-{kind}:"
    body = F.translate(F.substr(text, F.lit(len(head) + 1)), "-_", "+/")
    raw = F.when(F.startswith(text, F.lit(head)) & body.rlike("^[A-Za-z0-9+/]{43}$"), F.unbase64(F.concat(body, F.lit("="))))
    return F.when(F.octet_length(raw) == 32, raw)


# Stages that stand in a finding's path, which concern the lock file.
STAGES = ("version_diff", "version_diff_lookback", "temporal_reputation")


def report_uri(path: Column) -> Column:
    """Where a report points: the lock file for findings of a stage, else what follows the first ``/deps/``, else the path."""
    at = F.instr(path, "/deps/")
    rest = F.concat(F.lit("deps/"), F.substring(path, at + F.lit(6), F.char_length(path)))
    return F.when(path.isin(*STAGES), "mix.lock").when(at > 0, rest).otherwise(path)
