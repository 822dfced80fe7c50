"""What DDL declares, as ``ddl`` facts: columns, indexes, keys, constraints, and the events of ALTER and DROP.

A fact's ``a`` is the table, ``b`` the column, index or constraint, ``c`` a type, definition or detail; its first flag says what it is.
Lists of names stand in flags as ``key:``, ``inc:``, ``desc:``, ``ref:`` and the like, in their order.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from plumbline.tsql.facts import Walk

_COLUMN_END = {"not", "null", "primary", "unique", "check", "default", "references", "identity", "constraint", "collate", "masked", "encrypted", "sparse", "generated", "persisted", "index", "foreign", "rowguidcol", "hidden"}


def _names(w: Walk, i: int, e: int) -> tuple[list[str], list[bool]]:
    names, down = [], []
    for a, b in w.split(i + 1, w.match.get(i, e)):
        names.append(w.t[a].low)
        down.append(w.low(b - 1) == "desc")
    return names, down


def _keyed(w: Walk, table: str, name: str, kind: str, at: int, i: int, e: int, flags: list[str]) -> int:
    """An index or key whose column list begins at or after ``i``; returns where it ends."""
    i = w.find(i, e, {"("}) if not (i < e and w.t[i].text == "(") else i
    p = next((k for k in range(i, e) if w.t[k].text == "("), e)
    names, down = _names(w, p, e) if p < e else ([], [])
    k = w.skip(p) if p < e else e
    inc: list[str] = []
    while k < e:
        x = w.low(k)
        if x == "include" and k + 1 < e:
            inc = _names(w, k + 1, e)[0]
            k = w.skip(k + 1)
        elif x == "where":
            stop = min(w.find(k, e, {"with", "on"}), e)
            flags = [*flags, "filtered", f"filter:{w.text(k + 1, stop)}", *(f"fcol:{c}" for c in w.columns(k + 1, stop))]
            k = stop
        elif x == "with" and k + 1 < e and w.t[k + 1].text == "(":
            flags = [*flags, *(f"opt:{w.text(a, b)}" for a, b in w.split(k + 2, w.match.get(k + 1, e)))]
            k = w.skip(k + 1)
        elif x == "on" and k + 1 < e:
            flags = [*flags, f"on:{w.low(k + 1)}"]
            k += 2
        elif w.t[k].text == ",":
            break
        else:
            k = w.skip(k)
    w.add("ddl", at, table, name, kind, f=["index", *flags, *(f"key:{n}" for n in names), *(f"desc:{int(d)}" for d in down), *(f"inc:{n}" for n in inc)])
    return k


def table_body(w: Walk, table: str, i: int, e: int, flags: list[str]) -> None:
    """The columns and constraints between the brackets of a table."""
    from plumbline.tsql.facts import _TYPES  # noqa: F401 - one list of type names

    ordinal = 0
    for a, b in w.split(i, e):
        if a >= b:
            continue
        name, k = "", a
        if w.low(k) == "constraint" and w.t[k].kind == "word":
            name, k = w.t[k + 1].low, k + 2
        x = w.low(k) if w.t[k].kind == "word" else ""
        if x in ("primary", "unique", "index"):
            if x == "index":
                name = w.t[k + 1].low
            _constraint(w, table, "", name, k, b)
        elif x in ("foreign", "check"):
            _constraint(w, table, "", name, k, b)
        elif x == "period":
            continue
        else:
            ordinal += 1
            _column(w, table, a, b, ordinal, flags)


def _constraint(w: Walk, table: str, column: str, name: str, k: int, e: int) -> int:
    """A constraint that begins at ``k``, of a table or of a column."""
    x = w.low(k)
    if x in ("primary", "unique", "index"):
        head = {w.low(y) for y in range(k, min(e, k + 5))}
        kind = "PrimaryKey" if x == "primary" else "UniqueConstraint" if x == "unique" and "index" not in head else "Index"
        flags = [*(["unique"] if x in ("primary", "unique") else []), *(["clustered"] if "clustered" in head or x == "primary" and "nonclustered" not in head else []), *(["columnstore"] if "columnstore" in head else [])]
        p = next((y for y in range(k, min(e, k + 6)) if w.t[y].text == "("), None)
        if p is None or column and w.low(p - 1) in ("with",):
            w.add("ddl", k, table, name or f"{'pk' if x == 'primary' else 'uq'}_{table}_{column}", kind, f=["index", *flags, f"key:{column}", "desc:0"])
            return min(e, k + 2)
        return _keyed(w, table, name or f"{'pk' if x == 'primary' else 'uq'}_{table}", kind, k, p, e, flags)
    if x == "check":
        p = k + 1 if w.t[min(k + 1, e - 1)].text == "(" else next((y for y in range(k, e) if w.t[y].text == "("), e)
        q = w.match.get(p, e)
        tested = [w.text(y - 1, y) for y in range(p + 1, q) if w.low(y) == "is" and w.low(y + 1) == "null"]
        w.add("ddl", k, table, name or f"ck_{table}_{column}", w.text(p + 1, q), f=["check", *(f"key:{c}" for c in w.columns(p + 1, q)), *(f"null:{c}" for c in tested)])
        return q + 1
    if x in ("foreign", "references"):
        mine = [column]
        if x == "foreign":
            p = next((y for y in range(k, e) if w.t[y].text == "("), e)
            mine, k = _names(w, p, e)[0], w.skip(p)
        target, q = w.name(k + 1, e)
        theirs, q = (_names(w, q, e)[0], w.skip(q)) if q < e and w.t[q].text == "(" else ([], q)
        actions = {"delete": "NoAction", "update": "NoAction"}
        while q + 2 < e + 1 and q + 2 < len(w.t) and w.low(q) == "on" and w.low(q + 1) in actions:
            verb = w.low(q + 1)
            two = w.low(q + 2) in ("set", "no")
            actions[verb] = {"cascade": "Cascade", "set": "SetNull" if w.low(q + 3) == "null" else "SetDefault"}.get(w.low(q + 2), "NoAction")
            q += 4 if two else 3
        w.add("ddl", k, table, name or f"fk_{table}_{'_'.join(mine)}", ".".join(target), f=["fk", *(f"key:{c}" for c in mine), *(f"ref:{c}" for c in theirs), f"delete:{actions['delete']}", f"update:{actions['update']}"])
        return q
    return k + 1


def _column(w: Walk, table: str, a: int, b: int, ordinal: int, flags: list[str]) -> None:
    column, k, f = w.t[a].low, a + 1, ["column", *flags]
    if w.low(k) == "as" and w.t[k].kind == "word":  # a computed column
        end = w.find(k, b, {"persisted"})
        w.add("ddl", a, table, column, "", ordinal, [*f, "computed", f"def:{w.text(k + 1, end)}", *(["persisted"] if end < b else [])])
        w.expression(k + 1, end, "computed")
        return
    end = next((y for y in range(k, b) if w.t[y].kind == "word" and w.low(y) in _COLUMN_END), b)
    kind = w.text(k, end).replace(" ", "")
    if kind in ("timestamp", "rowversion"):
        f.append("not_null")
    k = end
    name = ""
    while k < b:
        x = w.low(k)
        if x == "not" and w.low(k + 1) == "null":
            f.append("not_null")
            k += 2
        elif x == "constraint":
            name, k = w.t[k + 1].low, k + 2
        elif x == "collate":
            f.append(f"collate:{w.t[k + 1].text}")
            k += 2
        elif x == "identity":
            f.append("identity")
            k += 1
            if k < b and w.t[k].text == "(":
                f.append("seed:" + w.text(k + 1, w.match.get(k, b)).replace(" ", ""))
                k = w.skip(k)
        elif x == "default":
            stop = next((y for y in range(k + 1, b) if w.t[y].kind == "word" and w.low(y) in _COLUMN_END - {"null"}), b)
            f.append(f"default:{w.text(k + 1, stop)}")
            w.expression(k + 1, stop, "default")
            k = stop
        elif x == "masked":
            f.append("masked")
            k += 1
        elif x == "sparse":
            f.append("sparse")
            k += 1
        elif x == "encrypted":
            words = w.text(k, b)
            f.append("encrypted:" + ("DETERMINISTIC" if "deterministic" in words else "RANDOMIZED"))
            m = next((w.t[y + 2].low for y in range(k, b - 2) if w.low(y) == "column_encryption_key"), "")
            f.append(f"cek:{m}")
            k = next((w.skip(y) for y in range(k, b) if w.t[y].text == "("), b)
        elif x == "generated":
            f.append("generated:" + w.text(k + 2, min(b, k + 5)))
            k += 4
        elif x in ("primary", "unique", "check", "references", "foreign"):
            if x == "primary":
                f.append("not_null")
            k, name = max(k + 1, _constraint(w, table, column, name, k, b)), ""
        else:
            k = w.skip(k)
    w.add("ddl", a, table, column, kind, ordinal, f)


def ddl(w: Walk, i: int, j: int) -> None:
    """The facts of one CREATE or ALTER statement."""
    verb, what = w.low(i), w.low(i + 1)
    if verb == "create" and what in ("table", "external", "type"):
        k = i + 2 + (what == "external")
        parts, m = w.name(k, j)
        table = ".".join(parts)
        if what == "type":
            if w.low(m) == "from":
                w.add("ddl", i, table, "", w.text(m + 1, min(j, m + 5)).replace(" ", ""), f=["type", "alias"])
            elif w.low(m) == "external":
                w.add("ddl", i, table, "", "", f=["type", "clr"])
            elif w.low(m + 1) == "table":
                w.add("ddl", i, table, "", "", f=["type", "table"])
                table_body(w, table, m + 3, w.match.get(m + 2, j), ["table_type"])
            return
        if m < j and w.t[m].text == "(":
            rest = w.text(w.skip(m), j)
            flags = [x for x, y in (("memory", "memory_optimized = on"), ("schema_only", "durability = schema_only"), ("ledger", "ledger = on"), ("temporal", "system_versioning = on")) if y in rest]
            w.add("ddl", i, table, "", rest, f=["external" if what == "external" else "table", *flags])
            table_body(w, table, m + 1, w.match.get(m, j), ["external"] if what == "external" else [])
        return
    at = next((k for k in range(i, min(j, i + 7)) if w.low(k) == "index" and w.t[k].kind == "word"), None)
    if verb == "create" and at is not None and what in ("index", "unique", "clustered", "nonclustered", "columnstore", "primary", "xml", "spatial", "json", "fulltext"):
        head = [w.low(k) for k in range(i, at)]
        on = w.find(at, j, {"on"})
        table, m = w.name(on + 1, j)
        flags = [x for x in ("unique", "clustered", "columnstore", "xml", "spatial", "json") if x in head]
        if "fulltext" in head:
            w.add("ddl", i, ".".join(table) or w.low(at + 2), "", w.text(at, j), f=["fulltext", *(f"key:{c}" for c in _names(w, m, j)[0] if m < j and w.t[m].text == "("), *(["semantic"] if "statistical_semantics" in w.text(m, j) else [])])
            return
        _keyed(w, ".".join(table), w.t[at + 1].low, "Json" if "json" in head else "Xml" if "xml" in head else "Spatial" if "spatial" in head else "Index", i, m, j, flags)
        return
    if verb == "create" and what == "statistics":
        on = w.find(i, j, {"on"})
        table, m = w.name(on + 1, j)
        w.add("ddl", i, ".".join(table), w.t[i + 2].low, "", f=["stats", *(f"key:{c}" for c in _names(w, m, j)[0]), *(["norecompute"] if "norecompute" in w.text(m, j) else [])])
        return
    if what == "xml" and w.low(i + 2) == "schema":
        w.add("ddl", i, ".".join(w.name(i + 4, j)[0]), "", w.text(i + 4, j), f=["xml_schema"])
        return
    if verb == "alter" and what == "schema":
        k = w.find(i, j, {"transfer"})
        w.add("ddl", i, w.low(i + 2), "", ".".join(w.name(k + 1, j)[0]), f=["transfer"])
        return
    if verb == "alter" and what == "table":
        _alter(w, i, j)
    elif verb == "alter" and what == "index":
        on = w.find(i, j, {"on"})
        table, m = w.name(on + 1, j)
        act = w.low(m)
        if act in ("disable", "rebuild"):
            rest = w.text(m, j)
            w.add("ddl", i, ".".join(table), w.t[i + 2].low, rest, f=["disable_index" if act == "disable" else "rebuild", f"target:index{' all' if w.low(i + 2) == 'all' else ''}", *(["online"] if "online = on" in rest else [])], n=_partition(w, m, j))


def _partition(w: Walk, k: int, j: int) -> int:
    p = w.find(k, j, {"partition"})
    return w._int(p + 2) if p < j else 0


def _alter(w: Walk, i: int, j: int) -> None:
    parts, k = w.name(i + 2, j)
    table = ".".join(parts)
    check = ""
    if w.low(k) == "with" and w.low(k + 1) in ("check", "nocheck"):
        check, k = w.low(k + 1), k + 2
    x, rest = w.low(k), w.text(k, j)
    if x == "add":
        before = len(w.out)
        for a, b in w.split(k + 1, j):
            name = ""
            if w.low(a) == "constraint":
                name, a = w.t[a + 1].low, a + 2
            if w.low(a) == "default":
                on = w.find(a, b, {"for"})
                w.add("ddl", i, table, w.low(on + 1), w.text(a + 1, on), f=["default"])
            elif w.low(a) in ("primary", "unique", "foreign", "check", "index"):
                _constraint(w, table, "", name, a, b)
            elif a < b:
                _column(w, table, a, b, 1000 + a, [])
        if check == "nocheck":
            for r in w.out[before:]:
                if r[0] == "ddl" and r[10][0] in ("fk", "check"):
                    r[10].append("untrusted")
    elif x == "alter" and w.low(k + 1) == "column":
        end = next((y for y in range(k + 3, j) if w.low(y) in _COLUMN_END | {"with"}), j)
        w.add("ddl", i, table, w.t[k + 2].low, w.text(k + 3, end).replace(" ", ""), f=["alter_column", *(["online"] if "online = on" in rest else []), *(["not_null"] if " not null" in rest else [])])
    elif x in ("check", "nocheck") and w.low(k + 1) == "constraint":
        w.add("ddl", i, table, w.t[k + 2].low, "", f=["disable_constraint" if x == "nocheck" else "enable_constraint", *(["trusted"] if check == "check" else [])])
    elif x == "drop":
        kind = "drop_column" if w.low(k + 1) == "column" else "drop_constraint"
        w.add("ddl", i, table, w.t[k + 2].low if w.low(k + 1) in ("column", "constraint") else w.low(k + 1), rest, f=[kind])
    elif x == "switch":
        to = w.find(k, j, {"to"})
        w.add("ddl", i, table, ".".join(w.name(to + 1, j)[0]), rest, _partition(w, k, to), ["switch", f"to_partition:{_partition(w, to, j)}"])
    elif x == "rebuild":
        w.add("ddl", i, table, "", rest, _partition(w, k, j), ["rebuild", "target:table", *(["online"] if "online = on" in rest else [])])
    elif x == "enable" and w.low(k + 1) == "change_tracking":
        w.add("ddl", i, table, "", rest, f=["change_tracking"])
