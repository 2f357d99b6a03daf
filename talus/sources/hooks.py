"""Compile-time hooks of source files: what a module hands to the compiler, and the callbacks it defines.

Strings and comments are masked first. The enclosing module and the extent of a callback follow from
indentation. A null or empty content gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from talus.sources.calls import masked

MODULE = re.compile(r"^\s*defmodule\s+([A-Z][\w.]*)")
HOOK = re.compile(r"^\s*@(before_compile|after_compile)\b[\s(]*(?:unquote\(\s*)?(?:\{\s*)?(__MODULE__|[A-Z][\w.]*|:[a-z_]\w*)?")
CALLBACK = re.compile(r"^\s*def(?:p|macro|macrop)?\s+__(before_compile|after_compile)__\b")
RESOURCE = re.compile(r"^\s*@external_resource\b")
COMPILERS = re.compile(r"(?<![\w.:@])(Mix\.compilers\b|compilers:\s*\[?\s*[^\s\]])")
HOOKS = "kind string, event string, module string, line int, last int"


def _target(named: str | None, module: str | None) -> str | None:
    if named == "__MODULE__":
        return module
    return None if named in (None, ":nil", ":true", ":false") else named.lstrip(":")


@udtf(returnType=HOOKS)
class Hooks:
    def eval(self, content: str, plain: str | None = None):
        """``plain``: the masked content, where a caller has it."""
        # every row has one of these in its line
        if not content or not any(x in content for x in ("_compile", "@external_resource", "compilers")):
            return
        lines = (masked(content) if plain is None else plain).split("\n")
        depths = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
        open_ = []  # indentation and name of the modules around a line
        for at, (text, depth) in enumerate(zip(lines, depths)):
            if depth is None:
                continue
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            module = open_[-1][1] if open_ else None
            if m := MODULE.match(text):
                open_.append((depth, m[1]))
            elif m := HOOK.match(text):
                yield "hook", m[1], _target(m[2], module), at + 1, at + 1
            elif m := CALLBACK.match(text):
                after = (k for k in range(at + 1, len(lines)) if depths[k] is not None and depths[k] <= depth)
                yield "callback", m[1], module, at + 1, next(after, len(lines))
            elif RESOURCE.match(text):
                yield "resource", None, module, at + 1, at + 1
            if COMPILERS.search(text):
                yield "compilers", None, module, at + 1, at + 1


def hooks(found: DataFrame) -> DataFrame:
    """dep, path and the hooks, callbacks, resources and compiler lists of (dep, path, content) rows."""
    return found.select("dep", "path", "content").lateralJoin(Hooks(F.col("content").outer())).drop("content")
