"""One form for all formattings of a SQL module, and the records that share it.

The form drops letter case, white space, underscores, identifier quotes, semicolons, comment marks and punctuation within
comments, and sorts the items of each select list and the lines of the comment before the first statement. All else stays.
Equal forms are found by a 128-bit hash with map-side combining; a second, independent hash and the length detect collisions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship, spread

_STOP = "select from into where union except intersect group order having option for insert update delete merge exec execute set declare if begin while return print throw raiserror create drop alter truncate commit rollback with else go end".split()
_WORDS = "|".join([*_STOP, "case"])
# White space, underscores, quotes of names and semicolons.
_BLANKS = [*range(9, 14), *range(0x1C, 0x21), 0x5F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_DROP_BLANKS = dict.fromkeys(_BLANKS)
_DROP = dict.fromkeys([*_BLANKS, *map(ord, '[]";')])
_LEX = re.compile(
    rf"""((?:[^'"\[/\-]++|"(?!(?:{_WORDS})")\w++"|\[(?!(?:{_WORDS})\])\w++\]|-(?!-)|/(?!\*))++)"""
    r"""|('[^']*+(?:''[^']*+)*+'?)|(--[^\r\n]*+)|(/\*)|("[^"]*+(?:""[^"]*+)*+"?|\[[^\]]*+(?:\]\][^\]]*+)*+\]?)"""
)
_BLOCK = re.compile(r"/\*|\*/")
_NOT_WORD = re.compile(r"[\W_]+")
_END = re.compile(r";|(?<![\w@#$])(?:" + "|".join(_STOP) + r")(?![\w@#$])")
_STRUCT = re.compile(rf"[(),;]|(?<![\w@#$])(?:{_WORDS})(?![\w@#$])")
_PREFIX = re.compile(r"\s*(?:(?:distinct|all)(?![\w@#$]))?\s*(?:top\s*(?:\([^()]*\)|[\w@.]+)(?:\s*percent(?![\w@#$]))?(?:\s*with\s+ties(?![\w@#$]))?)?")
_ITEM = re.compile(r"(?:[^(),]++|\((?:[^()]++|\([^()]*+\))*+\))++")


def _comment_lines(body: str) -> list[str]:
    return [x for x in (_NOT_WORD.sub("", x) for x in body.splitlines()) if x]


def _mask(text: str) -> tuple[list[str], str, list[str]]:
    """Lines of the leading comment; the code, in which \x01n\x01 stands for the n-th literal, comment or odd quoted name; these."""
    out: list[str] = []
    head: list[str] = []
    kept: list[str] = []
    leading, open_comment, at = True, False, 0
    while at < len(text):
        m = _LEX.match(text, at)
        tok, kind, at = m.group(), m.lastindex, m.end()
        if kind == 1:
            if not tok.isspace():
                open_comment = False
                leading = leading and not tok.strip("; \t\r\n\f\v\xa0﻿")
            out.append(tok)
        elif kind in (3, 4):
            if kind == 4:
                depth = 1
                while depth and (b := _BLOCK.search(text, at)):
                    depth += 1 if b.group() == "/*" else -1
                    at = b.end()
                at = len(text) if depth else at
                tok = text[m.start() : at]
            lines = _comment_lines(tok)
            if leading:
                head += lines
            elif lines and open_comment:  # comments with nothing between them are one
                kept[-1] += "".join(lines)
            elif lines:
                out.append(f" \x01{len(kept)}\x01 ")
                kept.append("\x02" + "".join(lines))
                open_comment = True
            else:
                out.append(" ")
        else:
            leading = open_comment = False
            if kind == 5:
                tok = tok[1:-1] if len(tok) > 1 and tok[-1] in '"]' else tok[1:]
            out.append(f" \x01{len(kept)}\x01 ")
            kept.append(tok.translate(_DROP_BLANKS))
    return head, "".join(out), kept


def _restore(code: str, kept: list[str]) -> str:
    code = code.translate(_DROP)
    if "\x01" not in code:
        return code
    parts = code.split("\x01")
    parts[1::2] = [kept[int(i)] for i in parts[1::2]]
    return "".join(parts)


def _word(c: str) -> bool:
    return c.isalnum() or c in "_@#$"


def _plain_lists(code: str, kept: list[str]) -> str | None:
    """The body with sorted select lists, or None if a list holds more than names, calls and operators."""
    out, at, pos = [], 0, code.find("select")
    while pos >= 0:
        lo = pos + 6
        if pos and _word(code[pos - 1]) or lo < len(code) and _word(code[lo]):
            pos = code.find("select", lo)
            continue
        lo = _PREFIX.match(code, lo).end()
        m = _END.search(code, lo)
        hi = m.start() if m else len(code)
        region = code[lo:hi]
        if "case" in region or region.count("(") != region.count(")"):
            return None
        if "," in region:
            items = _ITEM.findall(region) if "(" in region else region.split(",")
            if ",".join(items) != region:
                return None
            out.append(_restore(code[at:lo], kept))
            out.append(",".join(sorted(_restore(x, kept) for x in items)))
            at = hi
        pos = code.find("select", hi)
    out.append(_restore(code[at:], kept))
    return "".join(out)


def _nested_lists(code: str, kept: list[str]) -> str:
    """As ``_plain_lists``, for lists with subqueries, CASE and deep brackets."""
    out: list[str] = []
    frames: list[list] = []  # [bracket depth, open CASEs, start of the list in out, ends of its items in out]
    depth = at = 0

    def put(upto: int) -> None:
        nonlocal at
        if upto > at:
            out.append(_restore(code[at:upto], kept))
            at = upto

    def close(upto: int) -> None:
        put(upto)
        _, _, start, cuts = frames.pop()
        items, lo = [], start
        for hi in [*cuts, len(out)]:
            items.append("".join(out[lo:hi]))
            lo = hi
        del out[start:]
        out.append(",".join(sorted(items)))

    for m in _STRUCT.finditer(code):
        t, pos = m.group(), m.start()
        if t == "(":
            depth += 1
            continue
        if t == ")":
            depth -= 1
            while frames and frames[-1][0] > depth:
                close(pos)
            continue
        top = frames[-1] if frames and frames[-1][0] == depth else None
        if t == ",":
            if top and not top[1]:
                put(pos)
                top[3].append(len(out))
                at = pos + 1
            continue
        if top:
            if t == "case":
                top[1] += 1
                continue
            if top[1]:
                top[1] -= t == "end"
                continue
            close(pos)
        if t == "select":
            put(_PREFIX.match(code, m.end()).end())
            frames.append([depth, 0, len(out), []])
    while frames:
        close(len(code))
    put(len(code))
    return "".join(out)


def canonical(text: str) -> str:
    """The form that all formattings of one definition share."""
    text = text.casefold()
    if "\x01" in text or "\x02" in text:
        text = text.replace("\x01", "\x05").replace("\x02", "\x06")
    head, code, kept = _mask(text)
    body = _plain_lists(code, kept)
    return "\x03".join(sorted(head)) + "\x00" + (_nested_lists(code, kept) if body is None else body)


def canonical_name(name: str | None) -> str:
    return "\x01" if name is None else name.casefold().translate(_DROP)


def record_key(name: str | None, text: str) -> tuple[int, int, int]:
    """128 bits of the canonical record as two signed longs, and an independent check value."""
    form = f"{canonical_name(name)}\x00{canonical(text)}".encode("utf-8", "surrogatepass")
    d = xxhash.xxh3_128_digest(form)
    check = (xxhash.xxh64_intdigest(form, seed=0x5EED) ^ len(form)) & (2**63 - 1)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), check


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [(None, None, None) if t is None else record_key(n, t) for n, t in zip(b["name"].to_pylist(), b["text"].to_pylist(), strict=True)]
        hi, lo, check = zip(*keys, strict=True) if keys else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(check, pa.int64())], ["id", "hi", "lo", "chk"])


def record_keys(df: DataFrame, ident: str, name: str, text: str) -> DataFrame:
    """``(id, hi, lo, chk)`` of each row with a non-null text."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{text}`").cast("string").alias("text"))
    return spread(rows.where(F.col("text").isNotNull())).mapInArrow(_keys, "id long, hi long, lo long, chk long")


#: A form that stands for more than one in so many rows is hot; at most so many forms can be.
HOT_SHARE = 1000


def copies(df: DataFrame, ident: str, name: str, text: str) -> DataFrame:
    """``(id, keep_id, n_copies)`` of each row with a non-null text: the least id of its canonical form and the rows sharing it.

    Null names equal null names only; an empty text is a text. Rows repeated with one id are each a row. Forms are counted
    with map-side combining, so a form that a third of all rows share costs no more than another; rows find their form by
    a join in which the few hot forms (at most ``HOT_SHARE``) are broadcast and all others shuffled. A hash collision
    cannot join two forms: the key of a form is its hash and the check value of an independent one.
    """
    from plumbline.session import cut

    key = ["hi", "lo", "chk"]
    rows = cut(record_keys(df, ident, name, text))
    forms = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("keep_id"))
    many = cut(forms.where(F.col("n_copies") > 1))
    limit = max(1, rows.count() // HOT_SHARE)
    hot, rest = many.where(F.col("n_copies") > limit), many.where(F.col("n_copies") <= limit)
    met = rows.join(F.broadcast(hot), key, "left")
    out = met.where(F.col("keep_id").isNotNull()).select("id", "keep_id", "n_copies")
    light = met.where(F.col("keep_id").isNull()).select("id", *key)
    light = light.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, "left")
    return out.unionByName(light.select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")))


def collisions(keys: DataFrame) -> DataFrame:
    """Hashes that stand for more than one canonical form: a report that should be empty."""
    return keys.groupBy("hi", "lo").agg(F.count_distinct("chk").alias("forms")).where(F.col("forms") > 1)
