"""JSON documents in one spelling: as variants, whose objects hold their keys in order, whatever order they came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = "array<struct<module:string,content_hash:string>>"


def canonical(text: Column) -> Column:
    """A document with the keys of all its objects in order and no white space; null for what isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _listed(doc: Column, name: str, kind: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", kind), F.array().cast(kind))


def _manifest(doc: Column, text: Column, hashes: Column) -> Column:
    part = lambda name: F.try_variant_get(doc, f"$.{name}", "string").alias(name)
    # of a sound document the first character tells; the schema of a variant goes through all of it
    is_object = doc.isNotNull() & F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    whole = F.forall(hashes, lambda h: h.isNotNull() & h["module"].isNotNull() & h["content_hash"].isNotNull())
    names = F.array_compact(_listed(doc, "capabilities", "array<string>"))
    held = F.struct(part("package"), part("version"), hashes.alias("module_hashes"), names.alias("capabilities"), part("signer"), part("signed_at"), part("notes"))
    return F.when(is_object & whole, held)


def manifest(text: Column) -> Column:
    """A package manifest as a struct; null where the document is no object or an entry of module_hashes lacks its two texts.

    Missing parts are null, missing lists empty; unknown keys are left out; capabilities keep texts only.
    """
    doc = F.try_parse_json(text)
    return _manifest(doc, text, _listed(doc, "module_hashes", HASHES))


def manifests(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the documents of column ``text`` as variants ``{to}_doc`` and as manifests ``to``; each text is parsed once.

    What several parts are read from is a column of its own, as an expression would be repeated for each of them.
    """
    doc, hashes = f"{to}_doc", f"{to}_hashes"
    held = df.withColumn(doc, F.try_parse_json(text)).withColumn(hashes, _listed(F.col(doc), "module_hashes", HASHES))
    return held.withColumn(to, _manifest(F.col(doc), F.col(text), F.col(hashes))).drop(hashes)


def written(manifest: Column) -> Column:
    """A manifest struct as its canonical document, capabilities sorted; null parts are written as null."""
    parts = ["capabilities", "module_hashes", "notes", "package", "signed_at", "signer", "version"]
    value = {
        "capabilities": F.array_sort(manifest["capabilities"]),
        "module_hashes": F.transform(manifest["module_hashes"], lambda h: F.struct(h["content_hash"].alias("content_hash"), h["module"].alias("module"))),
    }
    held = F.struct(*[value.get(p, manifest[p]).alias(p) for p in parts])
    return F.when(manifest.isNotNull(), F.to_json(held, {"ignoreNullFields": "false"}))
