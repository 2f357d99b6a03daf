"""Call facts of source files: one row for each remote call, from a small tokenizer.

Strings and comments are masked first, so nothing inside them counts. Aliases and variables that are bound to a module
(``m = System``, ``m = :os``) hold for the rest of the file from where they stand, whatever block that is; the
latest one counts. The enclosing definition follows from the blocks, however they are laid out: macro
bodies and module bodies run at compile time, function bodies don't. An unqualified call counts where
an earlier import names a module that is listed with that function. A file that is no text gives no rows.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MASKED = re.compile(r'"""(?:\\.|(?!""").)*"""|"(?:\\.|[^"\\])*"|#(?!\{)[^\n]*', re.S)
ALIAS = re.compile(r"^\s*alias\s+([A-Z][\w.]*)(?:\s*,\s*as:\s*([A-Z]\w*))?", re.M)
CALL = re.compile(r"(?<![\w.:@])(:[a-z]\w*|[A-Z]\w*(?:\.[A-Z]\w*)*)\.([a-z_]\w*[?!]?)(\(?)")
LITERAL = re.compile(r'"((?:\\.|[^"\\])*)"|~c"((?:\\.|[^"\\])*)"')
APPLY = re.compile(r"(?<![\w.:@])apply\(")
IMPORT = re.compile(r"^\s*import\s+(:?[A-Za-z][\w.]*)", re.M)
BARE = re.compile(r"(?<![\w.:@&%])([a-z_]\w*[!?]?)(\(| +(?=[\"':\[%~]))")
# Functions that an unqualified call may mean where their module is imported.
IMPORTABLE = (
    ("System", "cmd shell find_executable get_env fetch_env fetch_env!"),
    ("Code", "eval_string eval_quoted eval_file compile_string compile_quoted"),
    ("File", "read! write! rm rm_rf cp cp_r ln_s stream! open mkdir mkdir_p"),
    ("Port", "open"),
    ("Module", "create"),
    ("EEx", "eval_string eval_file compile_string compile_file"),
    ("Base", "decode64 decode64!"),
    ("String", "to_atom to_existing_atom"),
    ("List", "to_atom to_existing_atom"),
    ("IO", "puts write binwrite inspect"),
    ("Req", "get get! post post! put put! delete delete! request request!"),
    ("HTTPoison", "get get! post post! put put! delete delete! request request!"),
    ("Finch", "request build"),
    ("Mint.HTTP", "connect"),
    ("Kernel", "apply"),
    ("os", "cmd"),
    ("httpc", "request"),
    ("gen_tcp", "connect"),
    ("ssl", "connect"),
    ("erlang", "binary_to_term binary_to_atom list_to_atom"),
)
IMPORTED = {(module, name) for module, names in IMPORTABLE for name in names.split()}
FACTS = "line int, body int, module string, func string, empty_call boolean, literals array<string>, compile_time boolean"
BOUND = re.compile(r"(?<![\w.:@&%])([a-z_]\w*[?!]?)\s*=(?![=~>])\s*(:[a-z]\w*[?!]?|[A-Z]\w*(?:\.[A-Z]\w*)*)(?![\w(:?!]|\.[a-z_{(])")
BOUND_CALL = re.compile(r"(?<![\w.:@&%])([a-z_]\w*)\.([a-z_]\w*[?!]?)(\(?)")
BLOCKS = re.compile(r"(?<![\w.:@&])(?:(defmacrop?|defp?)(?=[\s(])|(do|fn|end)\b(?!:)|(do:))")
WORD = re.compile(r"(?:do|fn|end)\b(?!:)")
STOPS = re.compile(r"[()\[\]{}\n]|(?<![\w.:@])(?:do|fn|end)\b(?!:)")
NEXT, GOING_ON, OPENING = re.compile(r"\s*"), ("|>", "++", "<>", "&&", "||", "and ", "or "), frozenset(("(", "[", "{", "do", "fn"))
GOES_ON = re.compile(r"(?:[,=(\[{+\-*/|<>&]|\b(?:do|fn|when|and|or|not|in))\s*$")


def _blank(m: re.Match) -> str:
    text = m[0]
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def masked(content: str) -> str:
    return MASKED.sub(_blank, content)


def arguments(plain: str, start: int) -> tuple[int, int]:
    """The extent of a bracketed argument list that opens just before ``start``, up to its closing bracket."""
    depth = 1
    for m in BRACKET.finditer(plain, start):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return start, m.start()
    return start, len(plain)


BRACKET = re.compile(r"[()\[\]{}]")


def top_level(plain: str) -> list[str]:
    """The arguments of a bracketed list, split at its own commas."""
    out, depth = [""], 0
    for c in plain:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _one_liner(plain: str, at: int) -> int:
    """Where an expression that begins at a place ends: at a line's end outside brackets and blocks that doesn't go on."""
    depth, start = 0, at
    # a word right at the place, which the pattern would take for a part of what stands before
    if m := WORD.match(plain, at):
        depth, start = (-1 if m[0] == "end" else 1), m.end()
        if depth < 0:
            return at
    for m in STOPS.finditer(plain, start):
        found = m[0]
        if found == "\n":
            if depth > 0:
                continue
            line = plain[max(at, plain.rfind("\n", at, m.start()) + 1) : m.start()]
            if line.strip() and not GOES_ON.search(line):
                after = NEXT.match(plain, m.end()).end()
                if not plain.startswith(GOING_ON, after):
                    return m.start()
        else:
            depth += 1 if found in OPENING else -1
            if depth < 0:
                return m.start()
    return len(plain)


class Definitions:
    """The definitions of a text by its blocks: each one's extent, kind and first line, and the one around it."""

    def __init__(self, plain: str):
        found: list[list] = []  # start, end, kind
        open_: list[list | None] = []
        pending: list | None = None
        for m in BLOCKS.finditer(plain):
            if m[1]:
                pending = [m.start(), len(plain), m[1]]
            elif m[2] == "end":
                if open_ and (held := open_.pop()):
                    held[1] = m.end()
            elif m[3]:
                if pending:
                    pending[1] = _one_liner(plain, m.end())
                    found.append(pending)
                    pending = None
            else:
                taken = pending if m[2] == "do" else None
                open_.append(taken)
                if taken:
                    found.append(taken)
                    pending = None
        self.spans = sorted(found)
        self.starts = [x[0] for x in self.spans]
        self.around, stack = [], []
        for i, span in enumerate(self.spans):
            while stack and self.spans[stack[-1]][1] <= span[0]:
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(i)

    def at(self, place: int) -> tuple[int, bool]:
        """(start of the innermost definition around a place or -1, whether its code runs at compile time)."""
        i = bisect.bisect_right(self.starts, place) - 1
        while i >= 0 and self.spans[i][1] <= place:
            i = self.around[i]
        if i < 0:
            return -1, True
        inner, macro = self.starts[i], False
        while i >= 0:
            macro |= self.spans[i][2].startswith("defmacro")
            i = self.around[i]
        return inner, macro


class Names:
    """What short names mean, in the order of the text and for the rest of it: aliases, and variables bound to modules."""

    def __init__(self, plain: str):
        self.aliases = self._by_name((m[2] or m[1].rsplit(".", 1)[-1], m.start(), m[1]) for m in (ALIAS.finditer(plain) if "alias" in plain else ()))
        bound = ((m[1], m.start(), m[2]) for m in (BOUND.finditer(plain) if "=" in plain else ()))
        self.bound = self._by_name((v, at, x.lstrip(":")) for v, at, x in bound if x not in (":nil", ":true", ":false"))

    @staticmethod
    def _by_name(found) -> dict[str, tuple[list[int], list[str]]]:
        out: dict[str, tuple[list[int], list[str]]] = {}
        for name, at, module in found:
            places, modules = out.setdefault(name, ([], []))
            places.append(at)
            modules.append(module)
        return out

    @staticmethod
    def _last(held: dict, name: str, place: int) -> str | None:
        places, modules = held.get(name, ((), ()))
        i = bisect.bisect_left(places, place) - 1
        return modules[i] if i >= 0 else None

    def module(self, named: str, place: int) -> str:
        """The module of a remote call: an alias stands for the head of a name, not for an Erlang module."""
        if named[0] == ":":
            return named[1:]
        head, _, tail = named.partition(".")
        whole = self._last(self.aliases, head, place) or head
        return whole + ("." + tail if tail else "")

    def variable(self, name: str, place: int) -> str | None:
        return self._last(self.bound, name, place)


@udtf(returnType=FACTS)
class CallFacts:
    def eval(self, content: str, plain: str | None = None):
        """``plain``: the masked content, where a caller has it."""
        if not content:
            return
        plain = masked(content) if plain is None else plain
        names, defined = Names(plain), Definitions(plain)
        lines = [0, *[m.end() for m in re.finditer("\n", plain)]]

        def fact(place: int, module: str, func: str, lo: int, hi: int, bare: bool = False) -> tuple:
            start, compile_time = defined.at(place)
            body = bisect.bisect_right(lines, start) if start >= 0 else 0
            given = [a or b for a, b in LITERAL.findall(content, lo, hi)]
            return bisect.bisect_right(lines, place), body, module, func, not bare and not content[lo:hi].strip(), given, compile_time

        for m in CALL.finditer(plain):
            lo, hi = arguments(plain, m.end()) if m[3] else (m.end(), m.end())
            yield fact(m.start(), names.module(m[1], m.start()), m[2], lo, hi, not m[3])
        for m in BOUND_CALL.finditer(plain) if names.bound else ():
            if module := names.variable(m[1], m.start()):
                lo, hi = arguments(plain, m.end()) if m[3] else (m.end(), m.end())
                yield fact(m.start(), module, m[2], lo, hi, not m[3])
        imports = [(m.start(), m[1].lstrip(":")) for m in (IMPORT.finditer(plain) if "import" in plain else ())]
        # a string after the name is blank in ``plain``, so names are sought in the text and kept where code stands
        for m in BARE.finditer(content) if imports else ():
            if plain[m.start() : m.end(1)] != m[1] or re.search(r"\bdef\w*\s+$", plain[max(0, m.start() - 20) : m.start()]):
                continue
            module = next((x for at, x in imports if at < m.start() and (x, m[1]) in IMPORTED), None)
            if module:
                end = lines[bisect.bisect_right(lines, m.start())] - 1 if bisect.bisect_right(lines, m.start()) < len(lines) else len(plain)
                lo, hi = arguments(plain, m.end()) if m[2] == "(" else (m.end(), end)
                yield fact(m.start(), module, m[1], lo, hi)
        for m in APPLY.finditer(plain) if "apply(" in plain else ():
            lo, hi = arguments(plain, m.end())
            given = top_level(plain[lo:hi])
            if len(given) == 3 and not all(re.fullmatch(r":[a-z_]\w*[?!]?", x) for x in given[:2]):
                yield fact(m.start(), "Kernel", "apply_dynamic", lo, lo, True)


@udtf(returnType="line int, text string")
class Literals:
    """String literals outside comments, by the line they start in."""

    def eval(self, content: str):
        for m in MASKED.finditer(content or "") if content and '"' in content else ():
            if m[0][0] == '"':
                yield content.count("\n", 0, m.start()) + 1, m[0].strip('"')


def literals(found: DataFrame) -> DataFrame:
    """dep (where ``found`` has it), path, line and text of each string literal in (path, content) rows."""
    return found.select(*[c for c in ("dep", "path") if c in found.columns], "content").lateralJoin(Literals(F.col("content").outer())).drop("content")


def call_facts(found: DataFrame) -> DataFrame:
    """dep (where ``found`` has it), path and the facts of each call in (path, content) rows."""
    return found.select(*[c for c in ("dep", "path") if c in found.columns], "content").lateralJoin(CallFacts(F.col("content").outer())).drop("content")
