"""Facts about a T-SQL module: one walk over its tokens, one flat row for each thing that rules ask about.

A fact is ``(rel, line, col, stmt, q, pq, a, b, c, n, f)``: the relation's name, the place, the numbers, within the module, of
the statement, of the query it stands in and of the query around that one (0: none), up to three texts, a number and flags. ``RELATIONS`` lists the relations. What can't be read becomes a ``skipped`` fact.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from operator import itemgetter

from plumbline.tsql.lexer import Token, line_starts, placeless, tokens

RELATIONS = {
    "module": "one row: kind, name, schema; flags of the header; number of lines",
    "param": "formal parameter: name, type",
    "comment": "comment: text",
    "line": "line that is long or holds a tab: length",
    "stmt": "statement: kind, target, detail",
    "mark": "where a statement starts on the line of another or can not be reached",
    "from_ref": "table reference: name, alias, kind; number of name parts",
    "join": "join: kind, text of its condition",
    "select_item": "item of a select list: text, alias, kind",
    "order_item": "item of ORDER BY: text",
    "group_item": "item of GROUP BY: text",
    "query": "query: clauses present as flags",
    "pred": "comparison: left, operator, right; region and kinds of both sides as flags",
    "cond": "condition of IF, WHILE or CASE: number of AND and OR",
    "call": "function call: name, arguments, region",
    "cast": "CAST or CONVERT: type, argument, style",
    "window": "windowed call: name, frame",
    "hint": "table or query hint: name, table",
    "literal": "literal: text, region",
    "var": "declared variable: name, type; uses",
    "assign": "assignment: target, source, kind",
    "exec": "procedure call: name, arguments",
    "cursor": "cursor: name, options",
    "cte": "common table expression: name; references",
    "set_opt": "SET option: name, value",
    "case": "CASE: input, number of WHEN",
    "op": "operator token",
    "global": "@@ value",
    "col": "mention of a column: name as written, region",
    "scope": "query within a query: n is the outer one, c how many levels out",
    "assign_col": "column that INSERT names or fills: name, literal or source kind; place",
    "fetch": "FETCH: cursor, number of variables",
    "state": "what holds at a statement: SET options on, transaction open before TRY, open cursors",
    "ddl": "what a CREATE or ALTER of a table, index, type or the like declares: see ddl.py",
    "concat": "chain of + : its operands",
    "skipped": "what could not be read: reason",
}

_STARTS = set("select insert update delete merge exec execute set declare if while begin return print throw raiserror goto waitfor commit rollback save create alter drop truncate open fetch close deallocate restore backup grant deny revoke use break continue revert readtext writetext updatetext kill checkpoint dbcc enable disable with".split())
_JOIN_PARTS = {"inner", "left", "right", "full", "cross", "outer", "join", "apply", "loop", "hash", "merge", "remote"}
_JOIN_WORDS = {"inner", "left", "right", "full", "cross", "outer", "join", "apply", "on"}
_CLAUSES = {"from", "where", "group", "having", "order", "union", "except", "intersect", "option", "for", "into", "offset", "window"}
_CONDITION = {"case", "end", "between", "and", "or"}
_COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">=", "!<", "!>", "like", "in", "between", "is"}
_HINTS = set("nolock readuncommitted readcommitted readcommittedlock repeatableread serializable holdlock updlock xlock tablock tablockx paglock rowlock readpast nowait snapshot forceseek forcescan noexpand index keepidentity keepdefaults ignore_triggers ignore_constraints".split())
_AGGREGATES = {"sum", "count", "count_big", "avg", "min", "max", "stdev", "stdevp", "var", "varp", "grouping", "grouping_id", "string_agg", "checksum_agg", "approx_count_distinct"}
_NOT_ALIASES = _JOIN_WORDS | _CLAUSES | {"with", "set", "when", "using", "tablesample", "option", "loop", "hash", "merge", "remote", "pivot", "unpivot", "values", "output", "for"}
_NUMBER = re.compile(r"-?\s?\d+(?:\.\d+)?")
_ARITHMETIC = {"+", "-", "*", "/", "%", "&", "|", "^"}
_NOT_CALLS = _STARTS | _CLAUSES | _JOIN_WORDS | {"and", "or", "not", "in", "exists", "values", "as", "over", "by", "when", "then", "else", "end", "case", "table", "top", "any", "all", "some", "is", "null", "like", "between", "returns", "output", "using", "percent", "distinct", "default", "key", "references", "check", "unique", "primary", "clustered", "nonclustered", "include", "within"}
_TYPES = set("bit tinyint smallint int bigint decimal numeric money smallmoney float real date datetime datetime2 smalldatetime datetimeoffset time char varchar nchar nvarchar binary varbinary text ntext image uniqueidentifier xml json sql_variant timestamp rowversion hierarchyid geometry geography vector sysname cursor table".split())
_NOT_NAMES = _NOT_CALLS | _TYPES


class _Lows(dict):
    """Lower-cased texts by place; "" where there is none."""

    def __missing__(self, at: int) -> str:
        return ""


class Walk:
    """Walks one module and gathers its facts."""

    def __init__(self, sql: str):
        self.sql = sql
        self.t, self.comments = self._lex()
        self.out: list[tuple] = []
        self.n_stmt = 0
        self.q = self.pq = self.n_q = 0
        self.outer: list[int] = []
        self.sub_q: dict[int, int] = {}
        self.on: dict[str, int] = {}
        self.cursors: dict[str, int] = {}
        self.open_cursors: set[str] = set()
        self._columns()
        self.match = self._brackets()
        self.loop = self.tries = self.catches = self.trans = self.trans_at_try = self.try_id = 0
        self.implicit, self.kind, self.inline = False, "", False
        self.uses: Counter[str] = Counter()
        self.writes: Counter[str] = Counter()
        self.declared: dict[str, Token] = {}

    def _lex(self) -> tuple[list[Token], list[Token]]:
        return tokens(self.sql)

    def line(self, i: int) -> int:
        return self.t[i].line

    def _brackets(self) -> dict[int, int]:
        stack, match, size = [], {}, len(self.t)
        self.nexts = list(range(1, size + 1))
        for i, x in enumerate(self.texts):
            if x not in "()":
                continue
            if x == "(":
                stack.append(i)
            elif stack:
                j = stack.pop()
                match[i], match[j] = j, i
                self.nexts[j] = i + 1
        for i in stack:
            match[i] = size
            self.nexts[i] = size + 1
        return match

    def _columns(self) -> None:
        """The tokens' parts as lists of their own, which loops read faster than tokens."""
        self.kinds, self.texts, low = map(list, [*zip(*self.t, strict=True)][:3]) if self.t else ([], [], [])
        self.lows = self.words = low
        if "string" in self.kinds:
            self.lows, self.words = low.copy(), low.copy()
            for i in [i for i, k in enumerate(self.kinds) if k == "string"]:
                self.lows[i], self.words[i] = "", self.texts[i]
        self.low = _Lows(enumerate(self.lows)).__getitem__
        self.bare = ["" if k == "quoted" else w for k, w in zip(self.kinds, self.lows, strict=True)] if "quoted" in self.kinds else self.lows
        self.plain = [w if k == "word" else "" for k, w in zip(self.kinds, low, strict=True)]

    def add(self, rel: str, at: int, a: str = "", b: str = "", c: str = "", n: int = 0, f=()) -> None:
        t = self.t[at] if at < len(self.t) else self.t[-1] if self.t else Token("", "", "", 0, 1, 1)
        self.out.append((rel, t.line, t.col, self.n_stmt, self.q, self.pq, a, b, c, n, list(f)))

    def enter(self) -> tuple[int, int]:
        """Begin a query within the present one; returns what ``leave`` goes back to."""
        back = (self.q, self.pq)
        if self.q:
            self.outer.append(self.q)
        self.n_q += 1
        self.q, self.pq = self.n_q, self.outer[-1] if self.outer else 0
        t = self.t[0]
        for level, x in enumerate([self.q, *reversed(self.outer)]):
            self.out.append(("scope", t.line, t.col, self.n_stmt, self.q, self.pq, "", "", str(level), x, []))
        return back

    def leave(self, back: tuple[int, int]) -> None:
        if back[0]:
            self.outer.pop()
        self.q, self.pq = back

    def text(self, s: int, e: int) -> str:
        return " ".join(self.words[s:e])

    def skip(self, i: int) -> int:
        """The index after the token, or after the bracket it opens."""
        return self.nexts[i]

    def split(self, s: int, e: int, sep: str = ",") -> list[tuple[int, int]]:
        out, lo, i, texts, nexts = [], s, s, self.texts, self.nexts
        while i < e:
            if texts[i] == sep:
                out.append((lo, i))
                lo = i + 1
            i = nexts[i]
        return [*out, (lo, e)] if lo < e or out else []

    def find(self, s: int, e: int, words: set[str]) -> int:
        i, case, bare, nexts = s, 0, self.bare, self.nexts
        while i < e:
            w = bare[i]
            if w == "case":
                case += 1
            elif w == "end" and case:
                case -= 1
            elif w in words and not case:
                return i
            i = nexts[i]
        return e

    # -- names and operands

    def name(self, i: int, e: int) -> tuple[list[str], int]:
        parts: list[str] = []
        kinds, texts = self.kinds, self.texts
        while i < e and kinds[i] in ("word", "quoted", "temp", "var"):
            parts.append(self.lows[i])
            if i + 1 < e and texts[i + 1] == ".":
                i += 2
                while i < e and texts[i] == ".":
                    parts.append("")
                    i += 1
            else:
                return parts, i + 1
        return parts, i

    def operand(self, s: int, e: int) -> str:
        """column, var, literal, null, call:name, cast, arith, query, case or expr."""
        while e - s > 1 and self.texts[s] == "(" and self.match.get(s) == e - 1:
            s, e = s + 1, e - 1
        if s >= e:
            return "expr"
        kind = self.kinds[s]
        if self.low(s) == "select":
            return "query"
        if e - s == 1:
            if kind in ("string", "number"):
                return "literal"
            if kind in ("var", "global"):
                return "var"
            if self.plain[s] in ("null", "case"):
                return self.plain[s]
            return "column" if kind in ("word", "quoted", "temp") else "expr"
        if e - s == 2 and self.texts[s] in "+-" and self.kinds[s + 1] == "number":
            return "literal"
        i, seen, texts, nexts = self.nexts[s], False, self.texts, self.nexts
        while i < e:
            seen = seen or texts[i] in _ARITHMETIC
            i = nexts[i]
        if seen:
            return "arith"
        if self.plain[s] == "case":
            return "case"
        _, i = self.name(s, e)
        if i == e:
            return "column"
        if i < e and self.texts[i] == "(" and self.match.get(i) == e - 1:
            fn = self.low(i - 1)
            return "cast" if fn in ("cast", "convert", "try_cast", "try_convert") else f"call:{fn}"
        return "expr"

    def columns(self, s: int, e: int) -> list[str]:
        """Names in a range that may be columns, without functions, variables and keywords."""
        out, i, kinds, texts = [], s, self.kinds, self.texts
        while i < e:
            if kinds[i] in ("word", "quoted"):
                parts, j = self.name(i, e)
                called = j < e and texts[j] == "("
                if parts and not called and (kinds[i] == "quoted" or parts[0] not in _NOT_NAMES):
                    out.append(".".join(parts))
                i = max(j, i + 1)
            else:
                i += 1
        return out

    # -- expressions

    def expression(self, s: int, e: int, region: str) -> None:
        """Calls, casts, literals, windows, cases and subqueries of a range."""
        i, kinds, texts, lows = s, self.kinds, self.texts, self.lows
        while i < e:
            kind, w = kinds[i], lows[i]
            if kind == "word" or kind == "quoted":
                if kind == "word" and w == "case":
                    self.case(i, e, region)
                elif kind == "quoted" or w not in _NOT_NAMES or i + 1 < e and texts[i + 1] == ".":
                    parts, j = self.name(i, e) if i + 1 < e and texts[i + 1] == "." else ([w], i + 1)
                    if not (j < e and texts[j] in ("(", "::")) and self.low(i - 1) not in ("as", "collate") and texts[i - 1] != "::":
                        self.add("col", i, ".".join(parts), region)
                    i = max(i, j - 1)
                elif w == "not" and i + 1 < e:
                    if lows[i + 1] == w:
                        self.add("op", i, f"{w} {w}", f=["repeated"])
                    elif texts[i + 1] == "(" and self.low(i + 2) != "select":
                        j = self.match.get(i + 1, e)
                        k = self.find(i + 2, j, {"=", "<>", "!=", "<", "<=", ">", ">="})
                        if k < j and self.find(i + 2, j, {"and", "or"}) >= j:
                            self.add("op", i, "not", self.low(k), f=["negated"])
            elif kind == "string" or kind == "number":
                self.add("literal", i, texts[i], region, kind)
            elif kind == "global":
                self.add("global", i, w)
            elif kind == "var":
                self.uses[w] += 1
            elif w in ("!=", "!<", "!>"):
                self.add("op", i, w)
            elif w in ("-", "~") and i + 1 < e and self.low(i + 1) == w:
                self.add("op", i, f"{w} {w}", f=["repeated"])
            elif w == "(" and i + 1 < e:
                if self.low(i + 1) in ("select", "with") and kinds[i + 1] == "word":
                    self.sub_q[i] = self.n_q + 1
                    self.query(i + 1, min(self.match.get(i, e), e), "subquery")
                    i = min(self.match.get(i, e), e)
                elif i > s and kinds[i - 1] in ("word", "quoted") and (kinds[i - 1] == "quoted" or lows[i - 1] not in _NOT_CALLS or lows[i - 1] == "update" and region == "if"):
                    self.call(i, min(self.match.get(i, e), e), region)
                elif self.match.get(i, 0) - i == 2:
                    self.add("op", i, "( )", f=["redundant_parens"])
            i += 1

    def call(self, i: int, e: int, region: str) -> None:
        s = i - 1
        while s >= 2 and self.texts[s - 1] == "." and self.kinds[s - 2] in ("word", "quoted"):
            s -= 2
        fn = ".".join(x.low for x in self.t[s:i:2])
        args = self.split(i + 1, e)
        kinds = [self.operand(a, b) for a, b in args]
        texts = [self.text(a, b) for a, b in args]
        flags = [region, *(f"arg{k}:{x}" for k, x in enumerate(kinds))]
        if len(texts) != len({x for x, k in zip(texts, kinds, strict=True) if k != "literal"} | {f"{k}:{x}" for k, (x, y) in enumerate(zip(texts, kinds, strict=True)) if y == "literal"}):
            flags.append("same_args")
        if self.catches:
            flags.append("in_catch")
        if "." in fn:
            flags.append("qualified")
        over = self.low(e + 1) == "over"
        self.add("call", s, fn, " , ".join(texts), texts[0] if texts else "", len(args), [*flags, *(["windowed"] if over else [])])
        if fn in ("cast", "try_cast", "convert", "try_convert") and args:
            as_at = self.find(i + 1, e, {"as"}) if "cast" in fn else None
            kind = (as_at + 1, e) if as_at is not None else args[0]
            value = (i + 1, as_at) if as_at is not None else (args[1] if len(args) > 1 else args[0])
            self.add("cast", s, self.text(*kind).replace(" ", ""), self.text(*value), texts[2] if len(args) > 2 else "", len(args), [region, fn, self.operand(*value)])
        if over and e + 2 < len(self.t) and self.texts[e + 2] == "(":
            j = self.match.get(e + 2, e + 2)
            words = {self.low(k) for k in range(e + 2, j)}
            self.add("window", s, fn, "range" if "range" in words else "rows" if "rows" in words else "", self.text(e + 3, j), len(args), ["ordered"] if "order" in words else [])
        if fn == "iif" and "iif" in {self.low(k) for k in range(args[1][0] if len(args) > 1 else e, e)}:
            self.add("op", s, "iif", f=["nested_iif"])

    def case(self, i: int, e: int, region: str) -> None:
        depth, j, whens, has_else, first, results, conds = 0, i + 1, 0, False, None, [], []
        mark, plain, nexts = None, self.plain, self.nexts
        while j < e:
            w = plain[j]
            if w == "case":
                depth += 1
            elif w == "end":
                if not depth:
                    break
                depth -= 1
            elif not depth and w in ("when", "then", "else"):
                first = j if first is None else first
                if mark:
                    (conds if mark[0] == "when" else results).append(self.text(mark[1], j))
                    if mark[0] != "when" and self.line(j - 1) - self.line(mark[1]) >= 5:
                        self.add("op", mark[1], "case branch", f=["long_branch"])
                mark = (w, j + 1)
                whens += w == "when"
                has_else |= w == "else"
            j = nexts[j]
        if mark and j <= e:
            results.append(self.text(mark[1], min(j, e)))
        simple = first is not None and first > i + 1
        flags = [*(["simple"] if simple else []), *(["else"] if has_else else [])]
        if len(conds) != len(set(conds)):
            flags.append("same_conditions")
        if len(results) > 1 and len(set(results)) == 1 and has_else:
            flags.append("all_same")
        elif len(results) > len(set(results)):
            flags.append("some_same")
        self.add("case", i, self.text(i + 1, first) if simple else "", region, n=whens, f=flags)

    def truth(self, s: int, e: int) -> bool | None:
        """Whether a comparison of two literals holds; None if it is anything else."""
        while e - s > 1 and self.texts[s] == "(" and self.match.get(s) == e - 1:
            s, e = s + 1, e - 1
        if e - s != 3 or self.kinds[s] != self.kinds[s + 2] or self.kinds[s] not in ("number", "string"):
            return None
        x, y = self.texts[s], self.texts[s + 2]
        if self.kinds[s] == "number":
            try:
                x, y = float(x), float(y)
            except ValueError:
                return None
        elif self.texts[s + 1] not in ("=", "<>", "!="):
            return None
        else:
            x, y = x.lstrip("nN").lower(), y.lstrip("nN").lower()
        return {"=": x == y, "<>": x != y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}.get(self.texts[s + 1])

    def condition(self, s: int, e: int, region: str, top: bool = True, leaf: bool = False) -> None:
        """Comparisons of a condition; top-level conjuncts are flagged, and leaves that can't decide anything are dead.

        A ``leaf`` is known to hold no AND or OR outside of brackets.
        """
        if top:
            self.expression(s, e, region)
        if leaf and self.texts[s] != "(":
            self.comparison(s, e, region)
            return
        while e - s > 1 and self.texts[s] == "(" and self.match.get(s) == e - 1 and self.low(s + 1) != "select":
            s, e = s + 1, e - 1
        leaves, ops, lo, i, between, case, plain, nexts, whole = [], [], s, s, False, 0, self.plain, self.nexts, True
        while i < e:
            w = plain[i]
            if w in _CONDITION:
                if w == "case":
                    case += 1
                elif w == "end":
                    case -= case > 0
                elif w == "between":
                    between = True
                elif not case:
                    if w == "and" and between:
                        between = False
                    else:
                        leaves.append((lo, i))
                        ops.append(w)
                        lo = i + 1
                        whole = whole and not between  # else the AND of a BETWEEN may stand in the next leaf
            i = nexts[i]
        leaves.append((lo, e))
        if len(leaves) > 1:
            texts = [self.text(*x) for x in leaves]
            if len(texts) > len(set(texts)):
                self.add("op", s, ops[0], f=["identical_operands"])
            shapes = [self._shape(*x) for x in leaves] if "and" not in ops or "or" not in ops else []
            if "and" not in ops:
                for x in shapes:
                    for y in shapes:
                        if x and y and x[1] == "=" and x[2].startswith("@") and y[1] == "is" and y[0] == x[2] and y[2] == "null":
                            self.add("pred", s, x[0], "catch_all", x[2], f=[region, "catch_all"])
            elif "or" not in ops:
                self.bounds(s, [x for x in shapes if x], region)
            known = [(*x, self.truth(*x)) for x in leaves]
            groups = [known[:1]]  # AND binds tighter than OR
            for leaf, o in zip(known[1:], ops, strict=True):
                if o == "or":
                    groups.append([])
                groups[-1].append(leaf)
            held = any(all(x[2] is True for x in g) for g in groups)
            mark = region if "or" not in ops else f"{region}|or"
            for g in groups:
                dead = held or any(x[2] is False for x in g)
                for a, b, holds in g:
                    self.condition(a, b, f"{mark}|dead" if dead and holds is None and "dead" not in mark else mark, False, whole and a < b)
            return
        self.comparison(s, e, region)

    def comparison(self, s: int, e: int, region: str) -> None:
        """The comparison of a condition without AND and OR."""
        while self.low(s) == "not" and s < e and self.low(s + 1) != "exists":
            s, region = s + 1, f"{region}|not"
        if s < e and self.texts[s] == "(" and self.match.get(s) == e - 1 and self.low(s + 1) != "select":
            self.condition(s + 1, e - 1, region, False)
            return
        k = self.find(s, e, _COMPARE)
        if k < e:
            self.predicate(s, k, e, region)

    def predicate(self, s: int, k: int, e: int, region: str) -> None:
        """The comparison whose operator stands at ``k``."""
        op, right = self.low(k), k + 1
        left_end = k - 1 if self.low(k - 1) == "not" else k
        neg = ["negated"] if left_end < k else []
        if op == "is" and self.low(right) == "not":
            right, neg = right + 1, ["negated"]
        lk, rk = self.operand(s, left_end), self.operand(right, e)
        where, *marks = region.split("|")
        flags = [where, f"l:{lk}", f"r:{rk}", *neg, *marks]
        lc, rc = self.columns(s, left_end), self.columns(right, e) if rk != "query" else []
        flags += [f"lcol:{x}" for x in lc[:4]] + [f"rcol:{x}" for x in rc[:4]]
        lt, rt = self.text(s, left_end), self.text(right, e)
        if lt == rt and lk not in ("literal", "null"):
            flags.append("identical_operands")
        if op == "like" and self.kinds[right] == "string":
            lit = self.texts[right].lstrip("nN")[1:-1]
            flags += ["leading_wildcard"] if lit[:1] in ("%", "_", "[") and lit != "%" else []
            flags += [] if re.search(r"[%_\[]", lit) else ["no_wildcard"]
            flags += ["trailing_space"] if lit.endswith(" ") else []
        if rk == "query" and self.texts[right] == "(":
            flags.append(f"sub:{self.sub_q.get(right, 0)}")
        if lk == rk == "literal" and op in ("=", "<>", "<", ">", "<=", ">="):
            flags.append("literals")
        self.add("pred", s, lt, op, rt, n=left_end - s, f=flags)

    def _shape(self, s: int, e: int) -> tuple[str, str, str] | None:
        while e - s > 1 and self.texts[s] == "(" and self.match.get(s) == e - 1:
            s, e = s + 1, e - 1
        k = self.find(s, e, _COMPARE)
        return (self.text(s, k), self.low(k), self.text(k + 1, e)) if k < e else None

    def bounds(self, at: int, shapes: list[tuple[str, str, str]], region: str) -> None:
        """Numeric ranges of one operand in one conjunction: contradictions and bounds that another makes idle."""
        by: dict[str, list[tuple[float, bool, float, bool]]] = {}
        inf = float("inf")
        for left, op, right in shapes:
            if _NUMBER.fullmatch(right):
                v = float(right.replace(" ", ""))
                span = {"=": (v, True, v, True), "<": (-inf, False, v, False), "<=": (-inf, False, v, True), ">": (v, False, inf, False), ">=": (v, True, inf, False)}.get(op)
                if span:
                    by.setdefault(left, []).append(span)
        for left, spans in by.items():
            lo, hi = max((s[0], not s[1]) for s in spans), min((s[2], s[3]) for s in spans)
            if lo[0] > hi[0] or lo[0] == hi[0] and (lo[1] or not hi[1]):
                self.add("pred", at, left, "and", "", f=[region, "contradiction"])
            elif len(spans) > 1 and (sum(s[0] > -inf for s in spans) > 1 or sum(s[2] < inf for s in spans) > 1):
                self.add("pred", at, left, "and", "", f=[region, "idle_bound"])

    # -- queries

    def query(self, s: int, e: int, role: str) -> None:
        """A query expression: CTEs, set operations, and each SELECT with its clauses."""
        i, branch = s, 0
        if self.low(i) == "with":
            i = self.ctes(i + 1, e)
        while i < e and self.low(i) in ("select", "(", ""):
            if self.texts[i] == "(":
                self.query(i + 1, min(self.match.get(i, e), e), role)
                i = self.skip(i)
            elif self.low(i) == "select":
                j = self.find(i + 1, e, {"union", "except", "intersect"})
                self.select(i, j, role, branch)
                branch += 1
                i = j
            else:
                return
            if i < e and self.low(i) in ("union", "except", "intersect"):
                all_ = self.low(i + 1) == "all"
                self.add("query", i, self.low(i), f=["set_op", *(["all"] if all_ else [])])
                i += 2 if all_ else 1
            else:
                return

    def ctes(self, i: int, e: int) -> int:
        found = []
        while i < e and self.kinds[i] in ("word", "quoted"):
            name, at = self.low(i) if self.kinds[i] == "word" else self.t[i].low, i
            i += 1
            if i < e and self.texts[i] == "(":
                i = self.skip(i)
            if self.low(i) != "as" or i + 1 >= e or self.texts[i + 1] != "(":
                return i
            lo, hi = i + 2, min(self.match.get(i + 1, e), e)
            found.append((name, at, lo, hi))
            self.add("cte_body", at, name, n=self.n_q + 1)
            self.query(lo, hi, "cte")
            i = hi + 1
            if i >= e or self.texts[i] != ",":
                break
            i += 1
        for name, at, lo, hi in found:
            inside = sum(self.t[k].low == name and self.low(k - 1) in ("from", "join", ",", "apply") for k in range(lo, hi))
            refs = sum(self.t[k].low == name and self.low(k - 1) in ("from", "join", ",", "apply", "using") for k in range(hi, e))
            self.add("cte", at, name, n=refs, f=["recursive"] if inside else [])
        return i

    def select(self, s: int, e: int, role: str, branch: int = 0) -> None:
        back = self.enter()
        self._select(s, e, role, branch)
        self.leave(back)

    def _select(self, s: int, e: int, role: str, branch: int) -> None:
        i, flags = s + 1, [role, f"branch:{branch}"]
        if self.low(i) in ("distinct", "all"):
            flags += ["distinct"] if self.low(i) == "distinct" else []
            i += 1
        if self.low(i) == "top":
            j = self.skip(i + 1)
            top = self.text(i + 1, j).strip("( )")
            self.expression(i + 1, j, "top")
            flags.append("top")
            if self.low(j) == "percent":
                flags.append("top_percent")
                flags += ["top_100_percent"] if top == "100" else []
                j += 1
            if self.low(j) == "with":
                j += 2
            i = j
        marks, k = [], i
        while k < e:
            k = self.find(k, e, _CLAUSES)
            if k < e:
                if not (self.low(k) == "for" and self.low(k - 1) == "apply"):
                    marks.append(k)
                k += 1
        ends = dict(zip(marks, [*marks[1:], e], strict=False))
        items = self.split(i, marks[0] if marks else e)
        star = False
        for k_item, (a, b) in enumerate(items):
            if a >= b:
                continue
            lo, hi, is_star, assigns = self.item(a, b, k_item, role, branch, star)
            star |= is_star
            flags += ["assigns"] if assigns else []
            self.chain(lo, hi, "select")
            self.expression(a, b, "select")
        for m, end in ends.items():
            w = self.low(m)
            flags.append(w)
            if w == "from":
                self.sources(m + 1, end)
            elif w == "where":
                self.condition(m + 1, end, "where")
            elif w == "having":
                self.condition(m + 1, end, "having")
            elif w == "group":
                self.grouping(m + 2, end)
            elif w == "order":
                for a, b in self.split(m + 2, end):
                    b2 = b - 1 if b > a and self.low(b - 1) in ("asc", "desc") else b
                    self.add("order_item", a, self.text(a, b2), n=len(items), f=["ordinal"] if b2 - a == 1 and self.kinds[a] == "number" else [])
                    self.expression(a, b2, "order" if b2 - a > 1 else "order_plain")
            elif w == "option":
                for a, b in self.split(m + 2, self.match.get(m + 1, end)):
                    self.add("hint", a, self.text(a, b), "option")
            elif w == "offset":
                self.expression(m + 1, end, "paging")
            elif w == "for":
                self.add("query", m, self.text(m, end), f=["for"])
        self.add("query", s, f=[*flags, *(["star"] if star else []), *(["in_view"] if self.kind == "view" or self.inline else [])], n=len(items))

    def item(self, a: int, b: int, k_item: int, role: str, branch: int, star: bool) -> tuple[int, int, bool, bool]:
        """An item of a select list; ``star``: one before it is a star. The range of its expression, and whether it is a star and sets a variable."""
        txt = self.text(a, b)
        is_star = self.texts[b - 1] == "*" and (b - a == 1 or self.texts[b - 2] == ".")
        assigns = False
        star |= is_star
        kind = "star" if is_star and b - a == 1 else "qualified_star" if is_star else self.operand(a, b)
        alias = "string" if b - a > 1 and self.kinds[b - 1] == "string" and (self.low(b - 2) == "as" or self.kinds[b - 2] in ("word", "quoted") or self.texts[b - 2] == ")") else ""
        if b - a > 2 and self.kinds[a] == "string" and self.texts[a + 1] == "=":
            alias = "string"
        if b - a > 2 and self.kinds[a] == "var" and self.texts[a + 1] in ("=", "+="):
            self.writes[self.low(a)] += 1
            self.add("assign", a, self.low(a), self.text(a + 2, b), "select", f=["var"])
            assigns = True
        lo, hi, name = self._named(a, b)
        if lo != a or hi != b:
            kind = self.operand(lo, hi) if not star else kind
        self.add("select_item", a, txt, alias, kind, n=k_item, f=[role, f"branch:{branch}", *([f"name:{name}"] if name else [])])
        return lo, hi, is_star, assigns

    def _named(self, a: int, b: int) -> tuple[int, int, str]:
        """The range of an item's expression and the name of its column."""
        if b - a > 2 and self.texts[a + 1] == "=" and self.kinds[a] in ("word", "quoted"):
            return a + 2, b, self.t[a].low
        if b - a > 2 and self.low(b - 2) == "as" and self.kinds[b - 2] == "word":
            return a, b - 2, self.t[b - 1].low if self.kinds[b - 1] != "string" else self.texts[b - 1].lower().strip("n'")
        if b - a > 1 and self.kinds[b - 1] in ("word", "quoted") and self.low(b - 1) != "end" and (self.kinds[b - 2] in ("word", "quoted", "number", "string", "var") and self.low(b - 2) not in _NOT_CALLS or self.texts[b - 2] == ")" or self.low(b - 2) == "end"):
            return a, b - 1, self.t[b - 1].low
        parts, j = self.name(a, b)
        return a, b, parts[-1] if parts and j == b else ""

    def chain(self, s: int, e: int, region: str) -> None:
        """A chain of + as one fact, its operands with their kinds."""
        parts, lo, i, texts, nexts = [], s, s, self.texts, self.nexts
        while i < e:
            x = texts[i]
            if x == "+" and i > lo:
                parts.append((lo, i))
                lo = i + 1
            elif x in ("-", "*", "/", "%", ","):
                return
            i = nexts[i]
        if parts:
            parts.append((lo, e))
            self.add("concat", s, region, n=len(parts), f=[f"{self.operand(a, b)}:{self.text(a, b)}" for a, b in parts])

    def grouping(self, s: int, e: int) -> None:
        n, kind = 1, ""
        for a, b in self.split(s, e):
            w = self.low(a)
            inner = self.match.get(a + 1, b) if a + 1 < b and self.texts[a + 1] == "(" else None
            if w in ("cube", "rollup") and inner:
                size = len(self.split(a + 2, inner))
                kind, n = w, n * (2**size if w == "cube" else size + 1)
                self.add("group_item", a, w, "width", n=size)
            elif w == "grouping" and self.low(a + 1) == "sets":
                kind, n = "sets", n * max(1, len(self.split(a + 3, self.match.get(a + 2, b))))
            else:
                self.add("group_item", a, self.text(a, b), "item")
                self.expression(a, b, "group" if b - a > 1 and self.operand(a, b) != "column" else "group_plain")
        self.add("group_item", s, kind, "sets", n=n)

    def sources(self, s: int, e: int) -> None:
        i, kind, comma = s, "first", 0
        while i < e:
            w = self.plain[i]
            if self.texts[i] == ",":
                kind, comma, i = "comma", comma + 1, i + 1
                continue
            if w in _JOIN_PARTS:
                j = i
                words = []
                while j < e and self.low(j) in _JOIN_PARTS:
                    words.append(self.low(j))
                    j += 1
                kind, i = " ".join(words), j
                continue
            if w == "on":
                j = self.find(i + 1, e, {"inner", "left", "right", "full", "cross", "join", "outer", ","})
                self.add("join", i, kind, self.text(i + 1, j))
                self.condition(i + 1, j, "on")
                i = j
                continue
            if self.texts[i] == "(":
                j = min(self.match.get(i, e), e)
                if self.low(i + 1) in ("select", "with", "values"):
                    sub = self.n_q + 1
                    if self.low(i + 1) != "values":
                        self.query(i + 1, j, "derived")
                    k = j + 1 + (self.low(j + 1) == "as")
                    named = k < e and self.kinds[k] in ("word", "quoted") and (self.kinds[k] == "quoted" or self.low(k) not in _JOIN_WORDS | _CLAUSES | {"on"})
                    self.add("from_ref", i, "", self.t[k].low if named else "", "derived", f=[kind, f"sub:{sub}"])
                    i = k + 1 if named else j + 1
                    i = self.skip(i) if named and i < e and self.texts[i] == "(" else i
                    continue
                self.sources(i + 1, j)
                i = self.skip(i)
            elif self.kinds[i] in ("word", "quoted", "temp", "var"):
                parts, j = self.name(i, e)
                what = "table_variable" if self.kinds[i] == "var" else "temp" if self.kinds[i] == "temp" else "table"
                flags = [kind]
                if j < e and self.texts[j] == "(" and what == "table" and not (self.low(j + 1) in _HINTS):
                    what = "function"
                    if "apply" in kind and any("." in x for x in self.columns(j + 1, self.match.get(j, e))):
                        flags.append("correlated")
                    flags.append("args:" + " , ".join(self.text(a, b) for a, b in self.split(j + 1, self.match.get(j, e))))
                    self.expression(j - 1, self.skip(j), "from")
                    j = self.skip(j)
                    if self.low(j) == "with" and j + 1 < e and self.texts[j + 1] == "(" and self.low(j - 1) != "nolock" and parts[-1] in ("openxml", "openrowset", "openjson"):
                        for a, b in self.split(j + 2, self.match.get(j + 1, e)):
                            self.add("ddl", a, parts[-1], self.low(a), self.text(a + 1, b), f=["with_schema"])
                        j = self.skip(j + 1)
                if self.low(j) == "tablesample":
                    k = self.find(j, e, {"("})
                    self.add("hint", j, "tablesample", ".".join(parts), f=["sample"], n=self._int(k + 1))
                    self.expression(k + 1, self.match.get(k, e), "tablesample")
                    j = self.skip(k) if k < e else e
                if self.low(j) == "as":
                    j += 1
                alias = ""
                if j < e and self.kinds[j] in ("word", "quoted") and (self.kinds[j] == "quoted" or self.low(j) not in _NOT_ALIASES):
                    alias, j = self.t[j].low, j + 1
                if j < e and (self.low(j) == "with" and j + 1 < e and self.texts[j + 1] == "(" or self.texts[j] == "(" and self.low(j + 1) in _HINTS):
                    k = j + 1 if self.low(j) == "with" else j
                    for a, b in self.split(k + 1, self.match.get(k, e)):
                        if self.low(a) == "index":
                            inner = range(a + 2, min(self.match.get(a + 1, b), b)) if a + 1 < b and self.texts[a + 1] == "(" else range(a + 2, b)
                            for x in inner:
                                if self.kinds[x] in ("word", "quoted"):
                                    self.add("hint", a, "index", ".".join(parts), self.t[x].low, f=["index_name"])
                        for h in (x for x in (self.low(y) for y in range(a, b)) if x in _HINTS):
                            self.add("hint", a, h, ".".join(parts), self.text(a, b), f=["table", *([] if k > j else ["no_with"])])
                    flags.append("hinted")
                    j = self.skip(k)
                self.add("from_ref", i, ".".join(parts), alias, what, len(parts), flags)
                if self.low(j) in ("pivot", "unpivot"):
                    self.add("from_ref", j, "", "", self.low(j), f=[kind, "args:" + self.text(j + 2, min(self.match.get(j + 1, e), e))])
                    j = self.skip(j + 1)
                    j += 1 if self.low(j) == "as" else 0
                    j += 1
                i = max(j, i + 1)
            else:
                i += 1

    def _int(self, i: int) -> int:
        try:
            sign = -1 if self.low(i) == "-" else 1
            return sign * int(float(self.texts[i + (sign < 0)]))
        except (ValueError, IndexError):
            return 0

    # -- statements

    def end_of(self, s: int, e: int) -> int:
        """Where the statement at ``s`` ends: a semicolon, END, ELSE or the start of another statement."""
        kind, i, case, sub, assigned, valued = self.low(s), self.skip(s), 0, False, False, False
        lead = kind
        if kind == "with":
            i = self._after_ctes(s + 1, e)
            lead = self.low(i)
            i = self.skip(i) if i < e else e
        plain, texts, nexts = self.plain, self.texts, self.nexts
        while i < e:
            w = plain[i]
            if not w:
                if texts[i] == ";":
                    if kind in ("exec", "execute") and i + 1 < e and self.kinds[i + 1] == "number" and self.kinds[i - 1] in ("word", "quoted"):
                        i += 1  # the number of a procedure
                        continue
                    return i
                i = nexts[i]
                continue
            if w == "case":
                case += 1
            elif w == "end":
                if not case:
                    return i
                case -= 1
            elif w == "else" and not case:
                return i
            elif w == "values" and lead == "insert":
                valued = True
            elif w in _STARTS and not case and w != "with" and not (i + 1 < e and texts[i + 1] == "(" and w in ("update", "open", "close")):
                prev = self.low(i - 1)
                ok = (
                    (w in ("select",) and prev in ("union", "all", "except", "intersect", "for", "as", ")") and (prev != ")" or lead == "insert" and not sub and not valued))
                    or (lead == "insert" and w in ("select", "exec", "execute") and not sub and not valued)
                    or (lead == "update" and w == "set" and not assigned)
                    or (lead == "merge" and w == "set" and prev == "update")
                    or (lead == "merge" and (prev in ("then", "matched") or w in ("update", "insert", "delete") and prev == "then"))
                    or (lead == "select" and w == "fetch" and prev in ("row", "rows"))
                    or (lead in ("alter", "create", "grant", "deny", "revoke", "enable", "disable", "drop", "restore", "backup") and (w in ("set", "select", "insert", "update", "delete", "alter", "drop", "execute", "exec", "with", "enable", "disable", "create") and (prev in ("on", "for", "after", "of", ",", "grant", "deny", "revoke", "database", "table", "schema", "cascade") or lead == "alter" and w in ("set", "alter", "drop", "with") and sub is False and self.low(s + 1) in ("table", "database", "index") and self.line(i) <= self.line(s) + 2)))
                    or (w in ("update", "open") and prev in ("for", "of"))
                    or (w == "begin" and prev in ("atomic",))
                    or (lead == "declare" and w == "select" and prev == "for")
                )
                if not ok:
                    return i
                sub = sub or w in ("select", "exec", "execute")
                assigned = assigned or w == "set"
            elif i + 1 < e and texts[i + 1] == ":" and self.low(i - 1) != "case" and self.line(i) != self.line(i - 1):
                return i
            i = nexts[i]
        return e

    def _after_ctes(self, i: int, e: int) -> int:
        while i < e and self.kinds[i] in ("word", "quoted"):
            i += 1
            if i < e and self.texts[i] == "(":
                i = self.skip(i)
            if self.low(i) != "as":
                return i
            i = self.skip(i + 1) if i + 1 < e else e
            if i < e and self.texts[i] == ",":
                i += 1
            else:
                return i
        return i

    def block(self, i: int, e: int, depth: int) -> tuple[int, list[tuple[str, int]]]:
        """Statements up to END or ELSE; returns where it stopped and the kinds and places of the statements."""
        kinds: list[tuple[str, int]] = []
        ended = False
        while i < e:
            w = self.low(i) if self.kinds[i] == "word" else self.texts[i]
            if w in (";", "go"):
                i += 1
                continue
            if w in ("end", "else"):
                break
            before = i
            if ended and w not in ("begin",) and not (i + 1 < e and self.texts[i + 1] == ":"):
                self.add("mark", i, w, f=["unreachable"])
                ended = False
            if kinds and w == "if" and self.low(i - 1) == "end" and self.line(i - 1) == self.line(i) and kinds[-1][0] == "if":
                self.add("mark", i, w, f=["if_after_end"])
            if kinds and self.line(kinds[-1][1]) == self.line(i):
                self.add("mark", i, w, f=["same_line"])
            kinds.append((w, i))
            i = self.statement(i, e, depth)
            ended = w in ("return", "throw", "break", "continue", "goto")
            if i <= before:
                self.add("skipped", before, "no progress", w)
                i = before + 1
        return i, kinds

    def statement(self, i: int, e: int, depth: int) -> int:
        self.n_stmt += 1
        self.n_q += 1
        self.q, self.pq, self.outer = self.n_q, 0, []
        w, t = self.low(i), self.t[i]
        where = [flag for flag, holds in (("in_loop", self.loop), ("in_try", self.tries), ("in_catch", self.catches), ("in_tran", self.trans)) if holds]
        if t.kind == "word" and i + 1 < e and self.texts[i + 1] == ":" and w not in _STARTS:
            self.add("stmt", i, "label", w)
            return i + 2
        if w == "begin" and self.low(i + 1) in ("tran", "transaction", "distributed"):
            self.trans += 1
            self.add("stmt", i, "begin tran", n=self.trans, f=where)
            self.implicit = False
            return self.end_of(i + 1, e)
        if w == "begin" and self.low(i + 1) in ("try", "catch"):
            part = self.low(i + 1)
            self.add("stmt", i, f"begin {part}", n=depth, f=where)
            attr = "tries" if part == "try" else "catches"
            if part == "try":
                self.try_id = self.n_stmt
                self.trans_at_try = self.trans
            setattr(self, attr, getattr(self, attr) + 1)
            j, kinds = self.block(i + 2, e, depth + 1)
            setattr(self, attr, getattr(self, attr) - 1)
            if part == "catch":
                names = {k for k, _ in kinds}
                self.add("stmt", i, "catch", n=len(kinds), f=[f"try:{self.try_id}", *(["rethrows"] if names & {"throw", "raiserror"} or any(self.low(k) in ("throw", "raiserror") for k in range(i, j)) else []), *where])
            return min(e, j + 2)
        if w == "begin":
            k = i + 1
            if self.low(k) == "atomic":
                k = self.skip(k + 2) if self.low(k + 1) == "with" else k + 1
            j, kinds = self.block(k, e, depth + 1)
            self.add("stmt", i, "block", n=len(kinds), f=where)
            return min(e, j + 1)
        if w in ("if", "while"):
            return self.branch(i, e, depth, w, where)
        if w == "else":
            return i + 1
        j = self.end_of(i, e)
        if self.on.get("implicit_transactions") and not self.trans and (w in ("insert", "update", "delete", "merge", "truncate", "open", "fetch", "create", "alter", "drop", "grant", "revoke") or w == "select" and self.find(i, j, {"from"}) < j):
            self.implicit = True
        getattr(self, f"s_{w}", self.s_other)(i, j, where)
        return j

    def branch(self, i: int, e: int, depth: int, w: str, where: list[str]) -> int:
        j, case, plain, texts, nexts = i + 1, 0, self.plain, self.texts, self.nexts
        while j < e:
            x = plain[j] or texts[j]
            if x == "case":
                case += 1
            elif x == "end":
                case -= case > 0
            if (x in _STARTS or x == ";") and not case and not (x == "update" and texts[min(j + 1, e - 1)] == "("):
                break
            j = nexts[j]
        words = self.lows[i + 1 : j]
        self.add("cond", i, w, n=sum(x in ("and", "or") for x in words) - words.count("between"), c=self.text(i + 1, j))
        self.condition(i + 1, j, w)
        flags = list(where)
        braced = self.low(j) == "begin" and self.low(j + 1) not in ("tran", "transaction", "try")
        if not braced:
            flags.append("unbraced")
            if j < e and self.t[j].line == self.t[i].line:
                flags.append("same_line_body")
        if depth >= 10:
            flags.append("deep")
        self.loop += w == "while"
        k = self.statement(j, e, depth + 1) if j < e else e
        self.loop -= w == "while"
        body = self.text(j, k).strip(" ;")
        inner = j + 1 if braced else j
        only_if = self.low(inner) == "if"
        while k < e and self.texts[k] == ";" and self.low(k + 1) == "else":
            k += 1
        has_else = w == "if" and k < e and self.low(k) == "else"
        if w == "while":
            last = [x for x in body.split() if x in ("break", "return", "throw", "continue")]
            if last and re.search(r"(?:break|return|throw)[^;]*?(?: end)?$", body) and "continue" not in body and " if " not in f" {body} ":
                flags.append("single_iteration")
        if has_else:
            m = self.statement(k + 1, e, depth + 1) if k + 1 < e else e
            if self.text(k + 1, m).strip(" ;") == body:
                flags.append("same_bodies")
            if self.low(k + 1) == "if" and self.text(k + 2, k + 2 + j - i - 1) == self.text(i + 1, j):
                flags.append("same_conditions")
            k = m
        elif w == "if" and only_if:
            m = self._if_end(inner, e)
            if m is not None and (m >= k - 1 if braced else m >= k):
                flags.append("collapsible")
        if not has_else and not braced and k < e and self.low(k) in _STARTS and self.t[k].col > self.t[i].col:
            flags.append("dangling")
        self.add("stmt", i, w, n=depth, f=flags)
        return k

    def _if_end(self, i: int, e: int) -> int | None:
        probe = Walk.__new__(Walk)
        probe.__dict__ |= self.__dict__ | {"out": [], "uses": Counter(), "writes": Counter(), "declared": {}}
        j = i + 1
        while j < e and self.plain[j] not in _STARTS:
            j = self.skip(j)
        if j >= e:
            return None
        k = probe.statement(j, e, 0)
        while k < e and self.texts[k] == ";":
            k += 1
        return None if k < e and self.low(k) == "else" else k

    def s_other(self, i: int, j: int, where: list[str]) -> None:
        w = self.low(i)
        self.add("stmt", i, w, self.low(i + 1), self.text(i, min(j, i + 12)), f=where)
        self.expression(i + 1, j, w)

    def s_select(self, i: int, j: int, where: list[str]) -> None:
        self.query(i, j, "statement")
        into = self.find(i, j, {"into"})
        target = ".".join(self.name(into + 1, j)[0]) if into < j else ""
        self.add("stmt", i, "select", target, f=where)

    def s_with(self, i: int, j: int, where: list[str]) -> None:
        k = self.ctes(i + 1, j)
        if k < j:
            if self.low(k) == "select":
                self.query(k, j, "statement")
                self.add("stmt", k, "select", f=where)
            else:
                getattr(self, f"s_{self.low(k)}", self.s_other)(k, j, where)

    def s_insert(self, i: int, j: int, where: list[str]) -> None:
        k = i + 1
        if self.low(k) == "top":
            k = self.skip(k + 1)
        k += self.low(k) == "into"
        parts, m = self.name(k, j)
        flags, cols = list(where), []
        if m < j and self.texts[m] == "(" and self.low(m + 1) not in ("select",):
            cols = [self.text(a, b) for a, b in self.split(m + 1, self.match.get(m, j))]
            m = self.skip(m)
        flags += ["column_list"] if cols else []
        src = self.find(m, j, {"select", "values", "exec", "execute", "default", "with"})
        source = self.low(src) if src < j else ""
        if source == "default":
            flags.append("column_list")
        rows = 0
        out = self.find(m, src, {"output"})
        if out < src:
            self.expression(out + 1, src, "output")
        if source == "values":
            tuples = self.split(src + 1, j)
            rows = len(tuples)
            self.expression(src + 1, j, "values")
            for a, b in tuples:
                for k_col, (x, y) in enumerate(self.split(a + 1, self.match.get(a, b))):
                    self.add("assign_col", x, cols[k_col].strip("[]") if k_col < len(cols) else "", self.text(x, y), self.operand(x, y), k_col + 1, ["insert", ".".join(parts)])
        elif source == "select":
            self.query(src, j, "insert")
            for k_col, c in enumerate(cols):
                self.add("assign_col", i, c, "", "query", k_col + 1, ["insert", ".".join(parts)])
        elif source in ("exec", "execute"):
            self.s_exec(src, j, where)
        self.target(i, "insert", parts, k, where)
        self.add("stmt", i, "insert", ".".join(parts), source, rows, [*flags, f"cols:{len(cols)}"])
        for c in cols:
            if c in ("$node_id", "$edge_id"):
                self.add("assign", i, c, "", "insert", f=["pseudo"])

    def target(self, i: int, verb: str, parts: list[str], at: int, where: list[str]) -> None:
        kind = self.kinds[at] if at < len(self.t) else ""
        self.add("stmt", i, "dml", ".".join(parts), verb, len(parts), [*where, "table_variable" if kind == "var" else "temp" if kind == "temp" else "table"])

    def s_update(self, i: int, j: int, where: list[str]) -> None:
        k = i + 1
        flags = list(where)
        if self.low(k) == "top":
            k, flags = self.skip(k + 1), [*flags, "top"]
        parts, m = self.name(k, j)
        st = self.find(m, j, {"set"})
        fr, wh = self.find(st, j, {"from"}), self.find(st, j, {"where"})
        out = self.find(st, j, {"output"})
        for a, b in self.split(st + 1, min(fr, wh, out, self.find(st, j, {"option"}))):
            eq = self.find(a, b, {"=", "+=", "-=", "*=", "/="})
            if eq < b:
                tgt = self.text(a, eq)
                fl = ["column"]
                if self.texts[eq] == "=" and tgt == self.text(eq + 1, b):
                    fl.append("self")
                if self.kinds[a] == "var":
                    self.writes[self.low(a)] += 1
                    fl = ["var"]
                if self.kinds[a] != "var":
                    self.add("assign_col", a, tgt.split(".")[-1].strip(" []"), self.text(eq + 1, b), self.operand(eq + 1, b), 0, ["update", ".".join(parts)])
                    self.chain(eq + 1, b, "set")
                self.add("assign", a, tgt, self.text(eq + 1, b), "update", f=[*fl, f"src:{self.operand(eq + 1, b)}", *(["pseudo"] if tgt in ("$node_id", "$edge_id") else [])])
                self.expression(eq + 1, b, "set")
        if fr < j:
            self.sources(fr + 1, min(j, wh) if wh > fr else j)
            flags.append("from")
        if wh < j:
            self.condition(wh + 1, min(j, self.find(wh, j, {"option"})), "where")
            flags.append("where")
        if out < j:
            self.expression(out + 1, min(x for x in (fr, wh, j) if x > out), "output")
            flags.append("output")
        self.target(i, "update", parts, k, where)
        self.add("stmt", i, "update", ".".join(parts), f=flags)

    def s_delete(self, i: int, j: int, where: list[str]) -> None:
        k = i + 1
        flags = list(where)
        if self.low(k) == "top":
            k, flags = self.skip(k + 1), [*flags, "top"]
        k += self.low(k) == "from"
        parts, m = self.name(k, j)
        fr, wh = self.find(m, j, {"from"}), self.find(m, j, {"where"})
        out = self.find(m, j, {"output"})
        if out < j:
            self.expression(out + 1, min(x for x in (fr, wh, j) if x > out), "output")
        if fr < j:
            self.sources(fr + 1, min(j, wh) if wh > fr else j)
            flags.append("from")
        if wh < j:
            self.condition(wh + 1, min(j, self.find(wh, j, {"option"})), "where")
            flags.append("where")
        self.target(i, "delete", parts, k, where)
        self.add("stmt", i, "delete", ".".join(parts), f=flags)

    def s_merge(self, i: int, j: int, where: list[str]) -> None:
        k = i + 1
        k += self.low(k) == "into"
        parts, m = self.name(k, j)
        us, on = self.find(m, j, {"using"}), self.find(m, j, {"on"})
        hints = {self.low(x) for x in range(m, us)}
        alias = self.low(m + (self.low(m) == "as")) if m < us and self.low(m) != "with" else ""
        self.add("from_ref", k, ".".join(parts), "" if alias in ("using", "with") else alias, "table", len(parts), ["merge_target"])
        self.sources(us + 1, on)
        wh = self.find(on, j, {"when"})
        self.condition(on + 1, wh, "merge_on")
        self.add("stmt", i, "merge", ".".join(parts), f=[*where, *(["holdlock"] if hints & {"holdlock", "serializable"} else [])])
        self.target(i, "merge", parts, k, where)
        while wh < j:
            nxt = self.find(wh + 1, j, {"when"})
            th = self.find(wh, nxt, {"then"})
            an = self.find(wh, th, {"and"})
            self.add("stmt", wh, "merge action", self.low(th + 1), f=["conditional"] if an < th else [])
            if self.low(th + 1) == "insert" and th + 2 < nxt and self.texts[th + 2] == "(":
                for k_col, (a, b) in enumerate(self.split(th + 3, self.match.get(th + 2, nxt))):
                    self.add("assign_col", a, self.text(a, b), "", "", k_col + 1, ["insert", ".".join(parts)])
            elif self.low(th + 1) == "update":
                for a, b in self.split(th + 3, nxt):
                    eq = self.find(a, b, {"="})
                    if eq < b:
                        self.add("assign_col", a, self.low(eq - 1), self.text(eq + 1, b), self.operand(eq + 1, b), 0, ["update", ".".join(parts)])
            self.expression(th + 1, nxt, "set")
            wh = nxt

    def s_exec(self, i: int, j: int, where: list[str]) -> None:
        k = i + 1
        flags = list(where)
        if k < j and self.texts[k] == "(":
            inside = (k + 1, self.match.get(k, j))
            kinds = {self.kinds[x] for x in range(*inside)}
            flags += ["dynamic", "constant" if kinds <= {"string", "op"} and "string" in kinds else "variable"]
            if "+" in {self.texts[x] for x in range(*inside)}:
                flags.append("concatenated")
            self.expression(*inside, "exec")
            after = self.match.get(k, j) + 1
            if self.low(after) == "at":
                flags.append("at")
            self.add("exec", i, "(dynamic)", self.text(*inside), n=len(self.split(*inside)), f=flags)
            self.add("stmt", i, "exec", "(dynamic)", f=flags)
            return
        if k + 1 < j and self.kinds[k] == "var" and self.texts[k + 1] == "=":
            self.writes[self.low(k)] += 1
            k += 2
        parts, m = self.name(k, j)
        name = ".".join(parts)
        if m + 1 < j and self.texts[m] == ";" and self.kinds[m + 1] == "number":
            flags.append("numbered")
        args = self.split(m, j)
        if name.rpartition(".")[2] == "sp_executesql" and args:
            kind = self.operand(*args[0])
            flags += ["dynamic", "constant" if kind == "literal" else "variable"]
        rs = self.find(m, j, {"with"})
        if rs < j and self.low(rs + 1) == "result" and self.low(rs + 2) == "sets":
            outer = self.split(rs + 4, self.match.get(rs + 3, j))
            if outer and self.texts[outer[0][0]] == "(":
                shape = self.split(outer[0][0] + 1, self.match.get(outer[0][0], j))
                for k_col, (a, b) in enumerate(shape):
                    self.add("result_col", a, name, self.text(a + 1, b).replace(" ", ""), self.low(a), k_col + 1)
            args = self.split(m, rs)
        for a, b in args:
            if b - a >= 2 and self.low(b - 1) in ("output", "out") and self.kinds[b - 2] == "var":
                self.writes[self.low(b - 2)] += 1
            self.expression(a, b, "exec")
        self.add("exec", i, name, self.text(m, min(rs, j)), n=len(args), f=[*flags, *(["variable_name"] if k < j and self.kinds[k] == "var" else [])])
        self.add("stmt", i, "exec", name, f=flags)

    s_execute = s_exec

    def s_declare(self, i: int, j: int, where: list[str]) -> None:
        if i + 1 < j and self.kinds[i + 1] != "var":
            cur = self.find(i, j, {"cursor"})
            self.cursors[self.low(i + 1)] = self.n_q + 1
            fo = self.find(cur, j, {"for"})
            opts = [self.low(x) for x in [*range(i + 2, cur), *range(cur + 1, fo)]]
            self.add("cursor", i, self.low(i + 1), " ".join(opts), n=0, f=opts)
            if fo < j:
                self.add("cursor_body", i, self.low(i + 1), n=self.n_q + 1)
                self.query(fo + 1, j, "cursor")
            self.add("stmt", i, "declare cursor", self.low(i + 1), f=where)
            return
        lines = Counter()
        for a, b in self.split(i + 1, j):
            if a >= b or self.kinds[a] != "var":
                continue
            v = self.low(a)
            k = a + 1 + (self.low(a + 1) == "as")
            eq = self.find(k, b, {"="})
            kind = self.text(k, eq).replace(" ", "")
            if self.low(k) == "table" and k + 1 < b and self.texts[k + 1] == "(":
                from plumbline.tsql.ddl import table_body

                table_body(self, v, k + 2, self.match.get(k + 1, b), ["variable"])
                kind = "table"
            self.declared.setdefault(v, self.t[a])
            lines[self.t[a].line] += 1
            self.add("var", a, v, kind, self.text(eq + 1, b) if eq < b else "", f=[*(["initial"] if eq < b else []), *(["same_line"] if lines[self.t[a].line] > 1 else [])])
            if eq < b:
                self.add("assign", a, v, self.text(eq + 1, b), "declare", f=["var", f"src:{self.operand(eq + 1, b)}"])
                self.expression(eq + 1, b, "declare")
        self.add("stmt", i, "declare", f=where)

    def s_set(self, i: int, j: int, where: list[str]) -> None:
        if i + 1 < j and self.kinds[i + 1] == "var":
            v = self.low(i + 1)
            eq = self.find(i + 1, j, {"=", "+=", "-=", "*=", "/="})
            self.writes[v] += 1
            fl = ["var", f"src:{self.operand(eq + 1, j)}"]
            if eq < j and self.texts[eq] == "=" and self.text(eq + 1, j) == v:
                fl.append("self")
            self.add("assign", i + 1, v, self.text(eq + 1, j), "set", f=fl)
            self.expression(eq + 1, j, "set")
            self.add("stmt", i, "set", v, f=where)
            return
        names = [x for x in self.text(i + 1, j).split(",")]
        words = self.text(i + 1, j).split()
        value = words[-1] if words else ""
        for n in names:
            opt = n.strip().removesuffix(f" {value}").strip()
            self.add("set_opt", i, opt, value, f=where)
            self.on[opt] = self.n_stmt if value == "on" else 0
        self.add("stmt", i, "set option", " ".join(words[:1]), value, f=where)

    def state(self) -> list[str]:
        """What holds here: SET options that are on, open cursors, a transaction that was open before the TRY block."""
        return [f"on:{k}" for k, v in self.on.items() if v] + [f"open:{c}" for c in sorted(self.open_cursors)] + (["before_try"] if self.trans_at_try else [])

    def s_commit(self, i: int, j: int, where: list[str]) -> None:
        self.trans = max(0, self.trans - 1)
        self.add("stmt", i, "commit", f=[*where, *self.state()])
        self.implicit = False

    def s_rollback(self, i: int, j: int, where: list[str]) -> None:
        named = j - i > 2 and self.kinds[j - 1] in ("word", "quoted", "var") and self.low(j - 1) not in ("tran", "transaction", "work")
        if not named:  # a rollback to a savepoint keeps the transaction
            self.trans, self.implicit = 0, False
        self.add("stmt", i, "rollback", f=[*where, *([] if named else self.state()), *(["savepoint"] if named else [])])

    def s_open(self, i: int, j: int, where: list[str]) -> None:
        self.open_cursors.add(self.low(i + 1))
        self.s_other(i, j, where)

    def s_close(self, i: int, j: int, where: list[str]) -> None:
        self.open_cursors.discard(self.low(i + 1))
        self.s_other(i, j, where)

    def s_fetch(self, i: int, j: int, where: list[str]) -> None:
        into = self.find(i, j, {"into"})
        fr = self.find(i, j, {"from"})
        name = self.low(fr + 1) if fr < j else self.low(into - 1) if into < j else ""
        if into < j:
            names = self.split(into + 1, j)
            self.add("fetch", i, name, n=len(names))
            for a, _ in names:
                self.writes[self.low(a)] += 1
        self.s_other(i, j, where)

    def s_truncate(self, i: int, j: int, where: list[str]) -> None:
        self.add("stmt", i, "truncate", ".".join(self.name(i + 2, j)[0]), f=[*where, *([f"try:{self.try_id}"] if self.tries else [])])

    def s_revert(self, i: int, j: int, where: list[str]) -> None:
        eq = self.find(i, j, {"="})
        self.add("stmt", i, "revert", self.low(eq + 1) if eq < j else "", f=where)

    def s_goto(self, i: int, j: int, where: list[str]) -> None:
        target = self.low(i + 1)
        k = j
        while k < len(self.t) and self.texts[k] == ";":
            k += 1
        nxt = k + 1 < len(self.t) and self.t[k].low == target and self.texts[k + 1] == ":"
        self.add("stmt", i, "goto", target, self.text(i, j), f=[*where, *(["to_next"] if nxt else [])])

    def s_create(self, i: int, j: int, where: list[str]) -> None:
        from plumbline.tsql.ddl import ddl

        ddl(self, i, j)
        self.add("stmt", i, f"create {self.low(i + 1)}", ".".join(self.name(i + 2, j)[0]), self.text(i, min(j, i + 60)), f=where)

    def s_alter(self, i: int, j: int, where: list[str]) -> None:
        from plumbline.tsql.ddl import ddl

        ddl(self, i, j)
        self.add("stmt", i, f"alter {self.low(i + 1)}", ".".join(self.name(i + 2, j)[0]), self.text(i, min(j, i + 60)), f=where)

    def s_return(self, i: int, j: int, where: list[str]) -> None:
        self.add("stmt", i, "return", f=[*where, *(["open_tran"] if self.trans and not self.catches else [])])
        k = i + 1
        if k < j and self.texts[k] == "(" and self.low(k + 1) in ("select", "with"):
            self.query(k + 1, self.match.get(k, j), "return")
        elif self.low(k) in ("select", "with"):
            self.query(k, j, "return")
        else:
            self.expression(k, j, "return")

    # -- the module

    def header(self) -> int:
        """Reads CREATE or ALTER of a routine and returns where its body begins; 0 if there is none."""
        self.inline = False
        i = next((k for k, w in enumerate(self.plain) if w in ("create", "alter") and self.low(k + 1 + 2 * (self.low(k + 1) == "or")) in ("procedure", "proc", "function", "view", "trigger")), None)
        if i is None:
            return 0
        k = i + 1 + 2 * (self.low(i + 1) == "or")
        kind = {"proc": "procedure"}.get(self.low(k), self.low(k))
        self.kind = kind
        parts, m = self.name(k + 1, len(self.t))
        flags = [*(["quoted_reserved"] if self.kinds[m - 1] == "quoted" and parts[-1:] and parts[-1] in _STARTS | _CLAUSES else [])]
        if m + 1 < len(self.t) and self.texts[m] == ";" and self.kinds[m + 1] == "number":
            flags.append("numbered")
            m += 2
        as_at, j = len(self.t), m
        while j < len(self.t):
            w = self.plain[j]
            if w == "as" and not (self.kinds[j - 1] == "var") and self.low(j + 1) not in _TYPES:
                as_at = j
                break
            if w == "execute" and self.low(j + 1) == "as":
                j += 2
            j = self.skip(j) if kind != "procedure" or self.texts[j] == "(" else j + 1
        if kind == "view" and [x.low for x in self.t if x.text != ";"][-3:] == ["with", "check", "option"]:
            flags.append("check_option")
            while self.t[-1].low != "with":
                self.t.pop()
            self.t.pop()
            self._columns()
            del self.nexts[len(self.t) :]
        words = {"", *self.lows[m:as_at]}
        flags += [x for x in ("recompile", "native_compilation", "schemabinding", "encryption", "after", "instead", "insert", "update", "delete", "logon") if x in words]
        lo, hi = (m, as_at)
        if m < len(self.t) and self.texts[m] == "(" and kind != "view":
            lo, hi = m + 1, self.match.get(m, as_at)
        n_params = 0
        if kind in ("procedure", "function"):
            stop = self.find(lo, hi, {"with", "returns", "for"})
            for a, b in self.split(lo, min(hi, stop)):
                if a < b and self.kinds[a] == "var":
                    n_params += 1
                    outp = self.low(b - 1) in ("output", "out") or self.low(b - 1) == "readonly" and self.low(b - 2) in ("output", "out")
                    eq = self.find(a, b, {"="})
                    end = min(eq, b - outp)
                    readonly = self.low(b - 1) == "readonly"
                    self.add("param", a, self.low(a), self.text(a + 1 + (self.low(a + 1) == "as"), end - readonly).replace(" ", ""), n=n_params, f=[*(["output"] if outp else []), *(["readonly"] if readonly else [])])
        returns = self.find(m, as_at, {"returns"}) if kind == "function" else as_at
        if returns < as_at:
            k = returns + 1
            what = "table" if self.low(k) == "table" else "table_variable" if self.kinds[k] == "var" else "scalar"
            flags.append(f"returns:{what}")
            self.inline = what == "table"
            if what == "scalar":
                stop = min(self.find(k, as_at, {"with", "as"}), as_at)
                self.add("returns", k, self.text(k, stop).replace(" ", ""), f=["schemabinding"] if "schemabinding" in words else [])
            elif what == "table_variable":
                from plumbline.tsql.ddl import table_body

                lo_r = self.find(k, as_at, {"("}) if self.low(k + 1) != "table" else k + 2
                if lo_r < as_at:
                    table_body(self, ".".join(parts), lo_r + 1, self.match.get(lo_r, as_at), ["returns", *(["schemabinding"] if "schemabinding" in words else [])])
        on = ".".join(self.name(m + 1, as_at)[0]) if kind == "trigger" else ""
        self.add("module", i, kind, ".".join(parts), on, n=n_params, f=[*flags, *(["unqualified"] if len(parts) == 1 else []), *([f"events:{len(words & {'insert', 'update', 'delete'})}"] if kind == "trigger" else [])])
        return as_at + 1

    def run(self) -> list[tuple]:
        lines = self.sql.splitlines()
        for k, x in enumerate(lines if "\t" in self.sql or max(map(len, lines), default=0) > 200 else []):
            if len(x) > 200:
                self.out.append(("line", k + 1, 201, 0, 0, 0, "long", "", "", len(x), []))
            if "\t" in x:
                self.out.append(("line", k + 1, x.index("\t") + 1, 0, 0, 0, "tab", "", "", len(x), []))
        first = self.t[0].pos if self.t else 0
        for c in self.comments:
            self.out.append(("comment", c.line, c.col, 0, 0, 0, c.text, "", "", c.text.count("\n") + 1, ["header"] if c.pos < first else []))
        if not self.t:
            return self.out
        try:
            body = self.header()
            i = body
            while i < len(self.t):
                i, _ = self.block(i, len(self.t), 0)
                i += 1
        except (RecursionError, IndexError, KeyError) as ex:
            self.add("skipped", 0, type(ex).__name__)
        for v, t in self.declared.items():
            self.out.append(("var_use", t.line, t.col, 0, 0, 0, v, "", "", self.uses[v], ["written"] if self.writes[v] else []))
        params = [r for r in self.out if r[0] == "param"]
        everywhere = Counter(t.low for t in self.t if t.kind == "var") if params else {}
        for r in params:
            self.out.append(("param_use", r[1], r[2], 0, 0, 0, r[6], "", "", everywhere[r[6]] - 1, [*r[10], *(["written"] if self.writes[r[6]] else [])]))
        if self.implicit:
            self.out.append(("stmt", self.t[-1].line, self.t[-1].col, self.n_stmt, 0, 0, "end", "", "", 0, ["implicit_tran"]))
        if self.trans:
            self.out.append(("stmt", self.t[-1].line, self.t[-1].col, self.n_stmt, 0, 0, "end", "", "", self.trans, ["open_tran"]))
        self.out.append(("size", 1, 1, 0, 0, 0, "", "", "", len(lines), ["header_comment"] if self.comments and self.comments[0].pos < first else []))
        return self.out


def facts(sql: str) -> list[tuple]:
    """All facts of one module or script."""
    return Walk(sql).run()


class Tally(Walk):
    """A walk for the number of facts: leaves out what only their texts and flags tell. Broken ranges are read as ever, so that they break alike."""

    def _lex(self) -> tuple[list[Token], list[Token]]:
        code, comments, self.at = placeless(self.sql)
        self.starts = line_starts(self.sql)
        return code, comments

    def _columns(self) -> None:
        super()._columns()
        del self.at[len(self.t) :]

    def line(self, i: int) -> int:
        return bisect_right(self.starts, self.at[i])

    def add(self, rel: str, at: int, a: str = "", b: str = "", c: str = "", n: int = 0, f=()) -> None:
        if rel in ("param", "ddl"):  # read again by the walk
            super().add(rel, at, a, b, c, n, f)
        else:
            self.out.append((rel,))

    def truth(self, s: int, e: int) -> None:
        """Tells flags alone."""

    def operand(self, s: int, e: int) -> str:
        return "expr" if e <= len(self.t) else super().operand(s, e)

    def columns(self, s: int, e: int) -> list[str]:
        return [] if e <= len(self.t) else super().columns(s, e)

    def item(self, a: int, b: int, k_item: int, role: str, branch: int, star: bool) -> tuple[int, int, bool, bool]:
        if b > len(self.t) or self.kinds[a] == "var":
            return super().item(a, b, k_item, role, branch, star)
        self.out.append(("select_item",))
        return *self._named(a, b)[:2], False, False

    def predicate(self, s: int, k: int, e: int, region: str) -> None:
        if k + 1 < e <= len(self.t):
            self.out.append(("pred",))
        else:
            super().predicate(s, k, e, region)


def counts(sql: str) -> Counter[str]:
    """How many facts of each relation ``facts`` gives."""
    return Counter(map(itemgetter(0), Tally(sql).run()))
