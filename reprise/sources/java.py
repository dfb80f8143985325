"""Java sources as units: a small lexer and block splitter, file by file in mapInPandas.

It knows comments, strings, brackets and statements, which is what windows, normalisation and tokens need; it resolves no types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\")|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\.|[^'\\\n])+')"
    r"|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<mark>->|::|\+\+|--|&&|\|\||[-+*/%&|^=<>!]=?|[(){}\[\];,.?:@~])",
    re.S,
)
# Words of the language that begin or belong to statements and never name a variable.
KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float
    for goto if implements import instanceof int interface long native new package private protected public record return short static strictfp super
    switch synchronized this throw throws transient try void volatile while var yield""".split()
)
# Placeholders of normal forms, which stay as they are.
PLACEHOLDERS = ("VAR", "FIELD", "METHOD", "STRING_LIT", "INT_LIT", "LONG_LIT", "DOUBLE_LIT", "BOOL_LIT", "NULL_LIT", "CHAR_LIT")
_BLOCK_WORDS = {"if", "for", "while", "do", "try", "switch", "synchronized", "else", "catch", "finally"}
COLUMNS = "file string, container_id string, container_kind string, class_name string, is_static boolean, block_id string, unit_idx int, text string, start_line int, end_line int, start_col int, end_col int"


class Token:
    __slots__ = ("kind", "text", "line", "col", "at", "end")

    def __init__(self, kind, text, line, col, at):
        self.kind, self.text, self.line, self.col, self.at, self.end = kind, text, line, col, at, at + len(text)


def lex(source: str, comments: bool = False) -> list[Token]:
    out, line, start = [], 1, 0
    pos = 0
    while pos < len(source):
        m = _TOKEN.match(source, pos)
        kind, text = (m.lastgroup, m[0]) if m else ("mark", source[pos])
        if kind != "space" and (comments or kind != "comment"):
            out.append(Token("string" if kind == "text" else kind, text, line, pos - start + 1, pos))
        if "\n" in text:
            line += text.count("\n")
            start = pos + text.rindex("\n") + 1
        pos += len(text)
    return out


def _literal(t: Token) -> str | None:
    if t.kind == "string":
        return "STRING_LIT"
    if t.kind == "char":
        return "CHAR_LIT"
    if t.kind == "number":
        if t.text[-1] in "lL":
            return "LONG_LIT"
        hexa = t.text[:2].lower() == "0x"
        return "DOUBLE_LIT" if "." in t.text or (not hexa and t.text[-1] in "fFdD") or (not hexa and "e" in t.text.lower()) else "INT_LIT"
    return {"true": "BOOL_LIT", "false": "BOOL_LIT", "null": "NULL_LIT"}.get(t.text) if t.kind == "name" else None


def strict(source: str) -> str:
    """Comments go and literals become placeholders; the layout of what stays is kept."""
    out, at = [], 0
    for t in lex(source, comments=True):
        to = "" if t.kind == "comment" else _literal(t)
        if to is not None:
            out += [source[at : t.at], to]
            at = t.end
    return "".join([*out, source[at:]]).strip()


def _roles(tokens: list[Token]) -> list[str]:
    """By token: literal, keyword, method, field, type, name or mark."""
    out = []
    for i, t in enumerate(tokens):
        after, before = tokens[i + 1].text if i + 1 < len(tokens) else "", tokens[i - 1].text if i else ""
        if _literal(t):
            out.append("literal")
        elif t.kind != "name":
            out.append("mark")
        elif t.text in KEYWORDS:
            out.append("keyword")
        elif after == "(" and before != "new":
            out.append("method")
        elif before == ".":
            out.append("field")
        elif before == "new" or (i + 1 < len(tokens) and (tokens[i + 1].kind == "name" and tokens[i + 1].text not in KEYWORDS)) or (after in ("<", "[") and t.text[0].isupper()):
            out.append("type")
        elif before in ("<", ",") and after in (">", ",") and t.text[0].isupper():
            out.append("type")
        else:
            out.append("name")
    return out


def fuzzy(source: str) -> str:
    """As strict, and names become VAR, fields FIELD; methods, types and keywords stay."""
    tokens = lex(source)
    out, at = [], 0
    for t, role in zip(tokens, _roles(tokens), strict=True):
        to = _literal(t) or {"name": "VAR", "field": "FIELD"}.get(role)
        if t.text in PLACEHOLDERS:
            to = t.text
        gap = re.sub(r"//[^\n]*|/\*.*?\*/", "", source[at : t.at], flags=re.S)
        out += [gap, to or t.text]
        at = t.end
    return "".join(out).strip()


def fuzzy_tokens(source: str) -> list[str]:
    """Leaf tokens: literal classes, VAR, FIELD, methods, and the marks and words that shape a statement."""
    tokens, out = lex(source), []
    for t, role in zip(tokens, _roles(tokens), strict=True):
        if t.text in PLACEHOLDERS or role == "literal":
            out.append(_literal(t) or t.text)
        elif role in ("name", "field"):
            out.append("VAR" if role == "name" else "FIELD")
        elif role == "method" or t.text in ("=", ".", "(", ")", ",", "if", "else", "for", "while", "return", "{", "}"):
            out.append(t.text)
    return out


def _close(tokens: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i (or the end)."""
    pair = {"(": ")", "{": "}", "[": "]"}[tokens[i].text]
    depth = 0
    for k in range(i, len(tokens)):
        depth += (tokens[k].text == tokens[i].text) - (tokens[k].text == pair)
        if not depth:
            return k
    return len(tokens) - 1


def statements(tokens: list[Token], i: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(statements, nested blocks) of tokens[i:end], as ranges; blocks are without their braces."""
    units, blocks = [], []
    while i < end:
        start = i
        i = _statement(tokens, i, end, blocks)
        units.append((start, i))
    return units, blocks


def _statement(tokens: list[Token], i: int, end: int, blocks: list) -> int:
    text = tokens[i].text
    if text == "{":
        close = _close(tokens, i)
        blocks.append((i + 1, close))
        return close + 1
    if text in ("if", "for", "while", "switch", "synchronized", "catch"):
        i += 1
        if i < end and tokens[i].text == "(":
            i = _close(tokens, i) + 1
        i = _statement(tokens, i, end, blocks) if i < end else end
        return _statement(tokens, i, end, blocks) if text == "if" and i < end and tokens[i].text == "else" else i
    if text in ("else", "do", "finally", "try"):
        i += 1
        if text == "try" and i < end and tokens[i].text == "(":
            i = _close(tokens, i) + 1
        i = _statement(tokens, i, end, blocks) if i < end else end
        while text == "try" and i < end and tokens[i].text in ("catch", "finally"):
            i = _statement(tokens, i, end, blocks)
        if text == "do" and i < end and tokens[i].text == "while":
            while i < end and tokens[i].text != ";":
                i += 1
            i += 1
        return i
    if text in ("case", "default"):
        while i < end and tokens[i].text not in (":", "->"):
            i += 1
        return min(end, i + 1)
    while i < end:
        if tokens[i].text in "({[" and tokens[i].kind == "mark":
            i = _close(tokens, i)
        elif tokens[i].text == ";":
            return i + 1
        i += 1
    return end


def callables(tokens: list[Token]) -> Iterator[tuple[str, str, str, bool, int, int]]:
    """(class, name, kind, static, first, end) of methods and constructors with a body; bodies as token ranges. Nested classes' come too."""
    stack: list[tuple[str, int]] = []
    i, mark = 0, 0
    while i < len(tokens):
        t = tokens[i]
        while stack and i > stack[-1][1]:
            stack.pop()
        if t.text in ("class", "interface", "enum", "record") and (i == 0 or tokens[i - 1].text != ".") and i + 1 < len(tokens) and tokens[i + 1].kind == "name":
            k = i + 2
            while k < len(tokens) and tokens[k].text not in ("{", ";"):
                k += 1
            if k < len(tokens) and tokens[k].text == "{":
                stack.append((tokens[i + 1].text, _close(tokens, k)))
                i = mark = k + 1
                continue
        if t.text in (";", "}"):
            mark = i + 1
        if t.text == "(" and i and tokens[i - 1].kind == "name" and tokens[i - 1].text not in KEYWORDS and stack:
            close = _close(tokens, i)
            k = close + 1
            if k < len(tokens) and tokens[k].text == "throws":
                while k < len(tokens) and tokens[k].text not in ("{", ";"):
                    k += 1
            head = [x.text for x in tokens[mark : i - 1]]
            if k < len(tokens) and tokens[k].text == "{" and "=" not in head and "new" not in head:
                end = _close(tokens, k)
                name = tokens[i - 1].text
                yield ".".join(c for c, _ in stack), name, "constructor" if name == stack[-1][0] else "method", "static" in head, k + 1, end
                inner = [x.text for x in tokens[k:end]]
                i = mark = k + 1 if "class" in inner else end + 1
                continue
            i = close
        i += 1


def units_of(file: str, source: str) -> list[tuple]:
    tokens, out = lex(source), []
    for n, (owner, name, kind, static, first, end) in enumerate(callables(tokens)):
        box = f"{file}#{owner}.{name}@{n}"
        todo = [(first, end)]
        b = 0
        while todo:
            start, stop = todo.pop(0)
            units, blocks = statements(tokens, start, stop)
            for idx, (i, j) in enumerate(units):
                if i < j:
                    a, z = tokens[i], tokens[j - 1]
                    lines = z.line + z.text.count("\n")
                    out.append((file, box, kind, owner, static, f"{box}/{b}", idx, source[a.at : z.end], a.line, lines, a.col, z.col + len(z.text) - 1))
            todo += blocks
            b += 1
    return out


def java_units(sources: DataFrame) -> DataFrame:
    """Units of all bodies and their nested blocks. sources: file, text; null texts have none; a file that can't be read as Java gives what can be found."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [u for f, t in zip(part["file"], part["text"], strict=True) if isinstance(t, str) for u in units_of(f, t)]
            yield pd.DataFrame(rows, columns=names)

    return sources.select("file", "text").mapInPandas(run, COLUMNS)


# --- bodies and the variables of their units ---------------------------------------------------------------------------------

_PRIMITIVE = {"boolean", "byte", "char", "short", "int", "long", "float", "double", "var"}
_NOT_EXPRESSION = KEYWORDS - _PRIMITIVE - {"final", "new", "this", "super"}
_ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
EVENT = "struct<declared:array<string>,types:array<string>,literal_init:array<string>,internal:array<string>,used:array<string>,assigned:array<string>,unary:array<string>,returned:array<string>,is_expression:boolean,nested_return:boolean>"
BODY = (
    "file string, container_id string, block_no int, kind string, class_name string, name string, is_static boolean, is_private boolean, is_test boolean, params array<string>, param_types array<string>, "
    f"units array<string>, norm array<string>, fuzzy array<string>, tokens array<string>, parts array<array<string>>, starts array<int>, ends array<int>, events array<{EVENT}>, calls array<string>"
)


def _type_end(tokens: list[Token], i: int, end: int) -> int:
    """Behind the type that begins at i: names with dots, type arguments, brackets."""
    i += 1
    while i + 1 < end and tokens[i].text == "." and tokens[i + 1].kind == "name":
        i += 2
    if i < end and tokens[i].text == "<":
        depth = 0
        while i < end:
            depth += {"<": 1, ">": -1}.get(tokens[i].text, 0)
            i += 1
            if not depth:
                break
    while i + 1 < end and tokens[i].text == "[" and tokens[i + 1].text == "]":
        i += 2
    return i


def events_of(tokens: list[Token]) -> dict:
    """What one statement does to variables, whatever is nested in it included.

    internal: declared inside it, as by loops, blocks, catch clauses and lambdas; what its own declaration makes isn't.
    """
    roles = _roles(tokens)
    out: dict[str, list] = {k: [] for k in ("declared", "types", "literal_init", "internal", "used", "assigned", "unary", "returned")}
    first = tokens[0].text if tokens else ""
    out["is_expression"] = bool(tokens) and first not in _NOT_EXPRESSION and first != "{"
    out["nested_return"] = first != "return" and any(t.text == "return" for t in tokens)
    names: set[int] = set()
    depth, returning, i = 0, False, 0

    def declare(k: int, kind: str, inside: bool) -> None:
        names.add(k)
        out["declared"].append(tokens[k].text)
        out["types"].append(kind)
        if inside:
            out["internal"].append(tokens[k].text)

    while i < len(tokens):
        t = tokens[i]
        after, before = tokens[i + 1].text if i + 1 < len(tokens) else "", tokens[i - 1].text if i else ""
        depth += (t.text in ("(", "{")) - (t.text in (")", "}"))
        returning = t.text == "return" or (returning and t.text != ";")
        if (roles[i] == "type" or t.text in _PRIMITIVE) and before not in ("new", "."):
            k = _type_end(tokens, i, len(tokens))
            kind = "".join(x.text for x in tokens[i:k])
            if k + 1 <= len(tokens) - 1 and tokens[k].kind == "name" and tokens[k].text not in KEYWORDS and tokens[k + 1].text in ("=", ";", ",", ":", ")"):
                inside = depth > 0 or not out["is_expression"]
                while True:
                    declare(k, kind, inside)
                    if tokens[k + 1].text == "=" and k + 3 < len(tokens) and _literal(tokens[k + 2]) and tokens[k + 3].text in (";", ","):
                        out["literal_init"].append(tokens[k].text)
                    if tokens[k + 1].text == "," and k + 3 < len(tokens) and tokens[k + 2].kind == "name" and tokens[k + 3].text in ("=", ";", ",") and depth == 0:
                        k += 2
                        continue
                    break
        if after == "->" and roles[i] == "name":
            declare(i, "Object", True)
        if t.text == "(" and (close := _close(tokens, i)) + 1 < len(tokens) and tokens[close + 1].text == "->":
            for k in range(i + 1, close):
                if roles[k] == "name" and k not in names and tokens[k + 1].text in (",", ")"):
                    declare(k, "Object", True)
        if roles[i] == "name" and i not in names:
            if after in _ASSIGNS and before != ".":
                out["assigned"].append(t.text)
            if "++" in (after, before) or "--" in (after, before):
                out["unary"].append(t.text)
            out["used"].append(t.text)
            if returning:
                out["returned"].append(t.text)
        i += 1
    return out


def _parameters(tokens: list[Token], close: int) -> tuple[list[str], list[str]]:
    """Names and types of the parameters whose closing bracket is at ``close``."""
    depth, i = 0, close
    while i >= 0:
        depth += (tokens[i].text == ")") - (tokens[i].text == "(")
        if not depth:
            break
        i -= 1
    names, types, k = [], [], i + 1
    while k < close:
        end, level = k, 0
        while end < close and (tokens[end].text != "," or level):
            level += {"<": 1, ">": -1, "(": 1, ")": -1}.get(tokens[end].text, 0)
            end += 1
        part = [x.text for x in tokens[k:end] if x.text != "final"]
        if len(part) >= 2:
            names.append(part[-1])
            types.append("".join(part[:-1]))
        k = end + 1
    return names, types


def bodies_of(file: str, source: str) -> list[tuple]:
    """A row for each block of each method and constructor; block 0 is its body."""
    tokens, out = lex(source), []
    is_test = bool(re.search(r"(Test|Tests|IT)\.java$", file)) or any(a.text == "@" and b.text in ("Test", "ParameterizedTest") for a, b in zip(tokens, tokens[1:], strict=False))
    for n, (owner, name, kind, static, first, end) in enumerate(callables(tokens)):
        box = f"{file}#{owner}.{name}@{n}"
        close = first - 2
        while close > 0 and tokens[close].text != ")":  # a throws clause may lie between
            close -= 1
        params, types = _parameters(tokens, close)
        at = close
        while at > 0 and tokens[at].text not in (";", "}", "{"):
            at -= 1
        private = any(x.text == "private" for x in tokens[at:close])
        todo, block = [(first, end)], 0
        while todo:
            start, stop = todo.pop(0)
            units, blocks = statements(tokens, start, stop)
            rows = [(tokens[i:j], source[tokens[i].at : tokens[j - 1].end]) for i, j in units if i < j]
            calls = [x.text for own, _ in rows for x, r in zip(own, _roles(own), strict=True) if r == "method"]
            out.append((
                file, box, block, kind, owner, name, static, private, is_test, params, types, [t for _, t in rows], [strict(t) for _, t in rows], [fuzzy(t) for _, t in rows],
                [" ".join(fuzzy_tokens(t)) for _, t in rows], [[x.text for x in own] for own, _ in rows], [own[0].line for own, _ in rows], [own[-1].line + own[-1].text.count("\n") for own, _ in rows],
                [events_of(own) for own, _ in rows], sorted(set(calls)),
            ))
            todo += blocks
            block += 1
    return out


def java_bodies(sources: DataFrame) -> DataFrame:
    """Bodies for the analysis: units with both normal forms, tokens, lines and variable events. sources: file, text; null texts have none."""
    names = [re.sub(r"^.*\s", "", c.strip().rsplit(" ", 1)[0]) for c in re.split(r", (?=[a-z_]+ )", BODY)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [u for f, t in zip(part["file"], part["text"], strict=True) if isinstance(t, str) for u in bodies_of(f, t)]
            yield pd.DataFrame(rows, columns=names)

    return sources.select("file", "text").mapInPandas(run, BODY)
