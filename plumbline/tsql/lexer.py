"""T-SQL tokens and batches."""

from __future__ import annotations

import re
from itertools import accumulate, chain, compress
from typing import NamedTuple

# No part is tried twice: each alternative tells by its first characters whether it holds.
_KINDS = {
    "word": r"(?![nN]')[^\W\d][\w@#$]*+|\$\w++",
    "comment": r"--[^\r\n]*+|/\*",
    "string": r"[nN]?'[^']*+(?:''[^']*+)*+(?:'|\Z)",
    "quoted": r"\[[^\]]*+(?:\]\][^\]]*+)*+(?:\]|\Z)|\"[^\"]*+(?:\"\"[^\"]*+)*+(?:\"|\Z)",
    "number": r"0[xX][0-9A-Fa-f]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?",
    "global": r"@@\w+",
    "var": r"@[\w@#$]*",
    "temp": r"#{1,2}\w[\w@#$]*",
    "op": r"<>|!=|!<|!>|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%=<>(),.;:&|^~!?\\{}]",
    "other": r".",
    "end": r"\Z",
}
_TOKEN = re.compile(r"\s*+(?:" + "|".join(f"(?P<{k}>{x})" for k, x in _KINDS.items()) + ")", re.S)
#: Blanks and the token after them, the usual ones first. Only a comment that holds another, or isn't closed, is left at its mark.
_PARTS = re.compile(r"(\s*+)(" + _KINDS["word"] + r"|[(),;=]|\.(?!\d)|" + _KINDS["quoted"] + r"|/\*[^*/]*+(?:(?!/\*|\*/).[^*/]*+)*+\*/|" + "|".join(_KINDS.values()) + ")", re.S)
_NEWLINE = re.compile(r"\r\n|\n|\r")
_BLOCK = re.compile(r"/\*|\*/")


class Token(NamedTuple):
    kind: str
    text: str
    low: str
    pos: int
    line: int
    col: int


#: Tokens without a place by their text: modules use few.
_SEEN: dict[str, Token] = {}


def _classify(text: str) -> Token:
    kind, low = _TOKEN.match(text).lastgroup, text.lower()
    if kind == "quoted":
        low = low[1:-1].replace("]]", "]") if text[0] == "[" else low[1:-1].replace('""', '"')
    t = Token(kind, text, low, 0, 0, 0)
    if len(text) <= 40:
        if len(_SEEN) >= 50_000:
            _SEEN.clear()
        _SEEN[text] = t
    return t


def placeless(sql: str) -> tuple[list[Token], list[Token], list[int]]:
    """As ``tokens``, but equal texts may share a token whose place is not set; last, where each code token starts."""
    parts = _PARTS.findall(sql)
    while parts and not parts[-1][1]:
        parts.pop()
    if "/*" in sql and any(x == "/*" for _, x in parts):
        code, comments = tokens(sql)
        return code, comments, [t.pos for t in code]
    seen = _SEEN.get
    code = [seen(x) or _classify(x) for _, x in parts]
    at = list(accumulate(map(len, chain.from_iterable(parts))))[::2]
    comments = [t for t in code if t[0] == "comment"]
    if comments:
        keep = [t[0] != "comment" for t in code]
        code, at = list(compress(code, keep)), list(compress(at, keep))
    return code, comments, at


def line_starts(sql: str) -> list[int]:
    return [0, *[m.end() for m in _NEWLINE.finditer(sql)]]


def tokens(sql: str) -> tuple[list[Token], list[Token]]:
    """Code tokens and comments; ``low`` is the lower-cased text, without quotes for names."""
    starts = [*line_starts(sql), len(sql) + 1]
    code: list[Token] = []
    comments: list[Token] = []
    new, seen, add = tuple.__new__, _SEEN.get, code.append
    line, first, after, at = 1, 0, starts[1], 0  # the line, where it starts, and where the next one does
    parts = iter(_PARTS.findall(sql))
    while True:
        for blank, text in parts:
            pos = at + len(blank)
            at = pos + len(text)
            if text == "/*" or not text:
                break
            kind, text, low, _, _, _ = seen(text) or _classify(text)
            while pos >= after:
                line, first, after = line + 1, after, starts[line + 1]
            if kind == "comment":
                comments.append(Token(kind, text, low, pos, line, pos - first + 1))
            else:
                add(new(Token, (kind, text, low, pos, line, pos - first + 1)))
        if pos >= len(sql):
            return code, comments
        depth = 1
        while depth and (b := _BLOCK.search(sql, at)):
            depth += 1 if b.group() == "/*" else -1
            at = b.end()
        at = len(sql) if depth else at
        text = sql[pos:at]
        while pos >= after:
            line, first, after = line + 1, after, starts[line + 1]
        comments.append(Token("comment", text, text.lower(), pos, line, pos - first + 1))
        parts = (m.groups() for m in _PARTS.finditer(sql, at))  # not listed ahead: there may be many such comments


def batches(sql: str) -> list[tuple[str, int, int]]:
    """``(text, first line, repeats)`` of the batches between GO lines; GO within strings, comments and quotes is text."""
    code, comments = tokens(sql)
    by_line: dict[int, list[Token]] = {}
    for t in [*code, *comments]:
        by_line.setdefault(t.line, []).append(t)
    cuts = []
    for i, t in enumerate(code):
        if t.low == "go" and t.kind == "word":
            others = [x for x in by_line[t.line] if x.pos != t.pos and x.kind != "comment"]
            count = others[0].text if len(others) == 1 and others[0].kind == "number" else None
            spans = any(x.pos < t.pos and x.pos + len(x.text) > t.pos for x in code[max(0, i - 1) : i])
            if not spans and (not others or count is not None and others[0].pos > t.pos):
                cuts.append((t.line, int(count) if count else 1))
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", sql)
    out, first = [], 1
    for line, repeat in cuts:
        text = "".join(lines[first - 1 : line - 1])
        if text.strip():
            out.append((text, first, repeat))
        first = line + 1
    text = "".join(lines[first - 1 :])
    if text.strip():
        out.append((text, first, 1))
    return out
