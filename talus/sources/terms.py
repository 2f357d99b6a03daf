"""Reading literal terms: maps, tuples, lists, strings, atoms and numbers, from lock files, manifests and settings.

Nothing is evaluated. A text is cut into tokens; a recursive reader makes values of those that spell a
literal. What can't be read raises ``Unread`` with the line and the reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r'(?P<space>\s+|\#[^\n]*)|(?P<heredoc>"""(?:\\.|(?!""").)*"""|\'\'\'(?:\\.|(?!\'\'\').)*\'\'\')|(?P<key>"(?:\\.|[^"\\])*":(?=[\s\[{"%:])|[A-Za-z_]\w*[?!]?:(?=[\s\[{"%]|$))'
    r'|(?P<text>"(?:\\.|[^"\\])*")|(?P<chars>\'(?:\\.|[^\'\\])*\'|~[a-zA-Z](?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|"[^"]*"|/(?:\\.|[^/])*/|\|[^|]*\|))'
    r'|(?P<atom>:"(?:\\.|[^"\\])*"|:[A-Za-z_]\w*[?!]?)|(?P<number>\d[\d_]*(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.[A-Z]\w*)*[?!]?)'
    r"|(?P<mark>%\{|=>|->|<-|\+\+|\|>|<<|>>|[\[\]{}(),]|[^\s\w\"']+?)|(?P<cut>[\"'])",
    re.S,
)
CLOSES = {"[": "]", "{": "}", "(": ")", "%{": "}", "<<": ">>"}


class Unread(ValueError):
    """A text that holds no such term."""


class Atom(str):
    """An atom, told from a string."""


class Interpolated(str):
    """A string with code in it, whose value isn't known."""


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in TOKEN.finditer(text):
        if m.lastgroup == "cut":
            raise Unread(f"line {line}: a string has no end")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


def balanced(found: list[Token]) -> None:
    """Raises where brackets or blocks don't close."""
    open_: list[tuple[str, int]] = []
    for t in found:
        if t.kind == "mark" and t.text in CLOSES:
            open_.append((CLOSES[t.text], t.line))
        elif t.kind == "name" and t.text in ("do", "fn"):
            open_.append(("end", t.line))
        elif t.kind == "mark" and t.text in CLOSES.values() or t.kind == "name" and t.text == "end":
            if not open_ or open_.pop()[0] != t.text:
                raise Unread(f"line {t.line}: {t.text} closes nothing")
    if open_:
        raise Unread(f"line {open_[-1][1]}: {open_[-1][0]} is missing")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "s": " ", "0": "\0", "e": "\x1b"}


def _string(quoted: str) -> str:
    body = quoted[1:-1]
    if re.search(r"(?<!\\)(?:\\\\)*#\{", body):
        return Interpolated(body)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def read(found: list[Token], at: int = 0) -> tuple[object, int]:
    """(value, next place) of the term at a token: dict as list of pairs in a tuple ("map", pairs)."""
    if at >= len(found):
        raise Unread("the text ends inside a term")
    t = found[at]
    if t.kind == "text":
        return _string(t.text), at + 1
    if t.kind == "atom":
        return Atom(_string(t.text[1:]) if t.text[1] == '"' else t.text[1:]), at + 1
    if t.kind == "number":
        digits = t.text.replace("_", "")
        return float(digits) if "." in digits else int(digits), at + 1
    if t.kind == "name" and t.text in ("nil", "true", "false"):
        return Atom(t.text), at + 1
    if t.kind == "name" and t.text[0].isupper():
        return Atom("Elixir." + t.text), at + 1
    if t.kind == "mark" and t.text in ("[", "{", "%{"):
        items, at = _items(found, at + 1, CLOSES[t.text], t.text == "{")
        return (items if t.text == "[" else tuple(items) if t.text == "{" else ("map", items)), at
    raise Unread(f"line {t.line}: {t.text[:20]} is no literal")


def _items(found: list[Token], at: int, close: str, gather: bool) -> tuple[list, int]:
    """Items up to the closing bracket; pairs (``key: value``, ``a => b``) as tuples, with ``gather`` in one list at the end."""
    out: list = []
    keyed: list = []
    while True:
        if at >= len(found):
            raise Unread(f"{close} is missing")
        t = found[at]
        if t.kind == "mark" and t.text == close:
            break
        if t.kind == "key":
            name = Atom(_string(t.text[:-1]) if t.text[0] == '"' else t.text[:-1])
            value, at = read(found, at + 1)
            keyed.append((name, value))
        else:
            value, at = read(found, at)
            if at < len(found) and found[at].text == "=>":
                other, at = read(found, at + 1)
                value = (value, other)
            out.append(value)
        if at < len(found) and found[at].text == ",":
            at += 1
        elif at >= len(found) or found[at].text != close:
            raise Unread(f"line {found[min(at, len(found) - 1)].line}: {close} or a comma is missing")
    return (out + [keyed] if gather and keyed else out + keyed), at + 1


def literal(text: str) -> object:
    """The one term that a text holds."""
    found = tokens(text)
    value, at = read(found)
    if at < len(found):
        raise Unread(f"line {found[at].line}: more than one term")
    return value


def is_keyword(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], Atom) for x in value)


def definition(found: list[Token], name: str) -> list[Token] | None:
    """The tokens of the body of the first ``def`` or ``defp`` of a name."""
    for at in range(len(found) - 1):
        if found[at].text in ("def", "defp") and found[at + 1].text == name:
            depth, i = 0, at + 2
            while i < len(found):
                t = found[i]
                if t.text in ("(", "[", "{", "%{"):
                    depth += 1
                elif t.text in (")", "]", "}"):
                    depth -= 1
                elif not depth and t.kind == "name" and t.text == "do":
                    return _block(found, i + 1)
                elif not depth and t.kind == "key" and t.text == "do:":
                    return _expression(found, i + 1)
                i += 1
    return None


def _block(found: list[Token], at: int) -> list[Token]:
    depth = 1
    for i in range(at, len(found)):
        if found[i].kind == "name":
            depth += (found[i].text in ("do", "fn")) - (found[i].text == "end")
            if not depth:
                return found[at:i]
    raise Unread("end is missing")


def _expression(found: list[Token], at: int) -> list[Token]:
    """The tokens up to the next definition or the end of the block around."""
    depth = 0
    for i in range(at, len(found)):
        t = found[i]
        if t.kind == "name" and not depth and t.text in ("def", "defp", "defmacro", "defmacrop", "end"):
            return found[at:i]
        depth += (t.kind == "name" and t.text in ("do", "fn")) - (t.kind == "name" and t.text == "end" and depth > 0)
    return found[at:]


# Options of a dependency, which are no dependency names.
OPTIONS = frozenset(
    """only runtime optional override manager in_umbrella path git github organization repo hex env compile_env app
    sparse system_env targets branch tag ref submodules subdir""".split()
)


def dependency_names(found: list[Token]) -> list[str]:
    """Names of the dependency tuples anywhere in the body of ``deps``: beside a string or a keyword list, no option's name."""
    body = definition(found, "deps") or []
    out: dict[str, None] = {}

    def counts(value: object) -> bool:
        return isinstance(value, str) and not isinstance(value, (Atom, Interpolated)) or is_keyword(value)

    for at, t in enumerate(body):
        name = value = None
        if t.kind == "key" and at + 1 < len(body):
            name, at = (t.text[1:-2] if t.text[0] == '"' else t.text[:-1]), at + 1
        elif t.text == "{" and at + 2 < len(body) and body[at + 1].kind == "atom" and body[at + 2].text == ",":
            name, at = body[at + 1].text[1:].strip('"'), at + 3
            if at < len(body) and body[at].kind == "key":
                out |= {name: None} if name not in OPTIONS else {}
                continue
        if name is None or name in OPTIONS:
            continue
        try:
            value, _ = read(body, at)
        except Unread:
            continue
        if counts(value):
            out[name] = None
    return list(out)


def declared_capabilities(found: list[Token], key: str) -> list[str] | None:
    """The atoms of the last list given to ``key`` (as a key, an attribute or a call); None without one."""
    declared: list[str] | None = None
    for at, t in enumerate(found):
        if t.text not in (key, key + ":"):
            continue
        start = at + 1 + (t.kind == "name" and at + 1 < len(found) and found[at + 1].text == "(")
        if start < len(found) and found[start].text == "[":
            depth, atoms = 0, []
            for i in range(start, len(found)):
                depth += (found[i].text in ("[", "{", "(", "%{")) - (found[i].text in ("]", "}", ")"))
                if depth == 1 and found[i].kind == "atom":
                    atoms.append(found[i].text[1:].strip('"'))
                if not depth:
                    break
            declared = atoms
        elif t.kind == "name":
            declared = None
    return declared
