"""Personal information in free text, by bootstrapped contextual extraction.

Candidates are text spans of the right shape: runs of capitalised words, digit groups, street-like phrases. A candidate's
lexical pattern is the words around it. Seeds (listed names, international phone numbers, labelled document numbers) make
patterns good in which they are frequent; good patterns make the instances known that they hold; known instances make
further patterns good. Spark scores this graph of patterns and instances over all documents until a round adds nothing; the patterns
that remain then find the identifiers, listed or not, in every document. E-mail addresses are found by their form.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import ChainMap
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, cut_with, ship, spread

#: Least distinct instances and share of known ones of a good pattern; the share of a sure one.
SUPPORT, GOOD, SURE = 3, 0.65, 0.75
#: Share of a word's frames that must be good for it to become a known part of names; each occurrence has three frames.
KEPT = 0.2
#: Share of known shapes that makes a pattern of phone-like numbers one of phone numbers, which have many shapes.
PHONES = 0.25
#: Most patterns of a kind that are sent to the executors, the best supported ones; documents are joined with the others.
MOST_PATTERNS = 20_000
#: Bits of the map of those others. It is of a fixed size; a pattern wrongly held to be on it costs a row and no result.
MAP_BITS = 1 << 24
KINDS = ["name", "number", "shape", "place"]
#: Words and initials of one person's name at most.
MOST_PARTS = 6

_S = "[   ]"
_CAP = r"[A-ZÀ-ÖØ-Þ]\w*(?:['’\-]\w+)*"
# Parts of addresses in four languages.
_EN = "Street|St|Road|Rd|Row|Lane|Ln|Drive|Dr|Close|Court|Ct|Avenue|Ave|Way|Place|Square|Terrace|Boulevard|Blvd|Crescent|Gardens"
_TOWN_EN = rf"(?:(?:Port|East|West|North|South|New|Old|St\.|Great|Little|Upper|Lower){_S})?{_CAP}"
_TOWN_DE = rf"{_CAP}(?:{_S}(?:a\.{_S}?d\.|am|an{_S}der|bei|im|ob{_S}der){_S}{_CAP})?"
_TOWN = rf"{_CAP}(?:{_S}(?:de{_S}la|del|de|los|las){_S}{_CAP}|{_S}{_CAP})?"
_SEP = rf"(?:,{_S}?\r?\n?{_S}*|{_S}?\r?\n{_S}*)"
_LEAD = r"(?:--\s?|\*\s?)?"
ADDRESS = re.compile(
    "|".join(
        [
            rf"(?<![\w.\-])\d{{1,5}}[A-Z]?{_S}(?:St\.{_S})?{_CAP}(?:{_S}{_CAP}){{0,2}}?{_S}(?:{_EN})\b(?:\.(?=,))?(?:,{_S}?(?:Apt|Unit|Flat|Suite|Apartment|Room)\.?{_S}\w{{1,5}})?(?:,{_S}?{_TOWN_EN}(?:{_S}\d{{5}}(?!\d))?|{_SEP}{_TOWN_EN}{_S}\d{{5}}(?!\d))?",
            rf"(?<!\w)(?:P\.?{_S}?O\.?{_S}?Box|PO{_S}Box|Postfach|Apartado|BP){_S}\d+(?:,{_S}?{_TOWN_EN}(?:{_S}\d{{5}}(?!\d))?|{_SEP}(?:\d{{5}}{_S}{_TOWN}|{_TOWN_EN}{_S}\d{{5}}(?!\d)))?",
            rf"(?<!\w)\d{{1,4}}(?:{_S}?(?:bis|ter))?,?{_S}(?:rue|avenue|av\.|bd|boulevard|chemin|allée|place|quai|impasse|route|cours){_S}(?:de{_S}la{_S}|de{_S}l['’]|des{_S}|du{_S}|de{_S}|d['’])?{_CAP}(?:{_S}{_CAP})*(?:{_SEP}\d{{5}}{_S}{_CAP})?",
            rf"(?<!\w)(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Carrera){_S}?(?:de{_S}los{_S}|de{_S}las{_S}|de{_S}la{_S}|del{_S}|de{_S})?{_CAP}(?:{_S}{_CAP})*,?{_S}(?:n[º°.o]{_S}?)?\d{{1,4}}(?:,{_S}?(?:bajo|ático|\d{{1,2}}[º°ª](?:{_S}?[A-Z](?!\w))?))?(?:{_SEP}\d{{5}}{_S}{_CAP})?",
            rf"(?<!\w)(?:(?:Am|Im|Zum|Zur|An{_S}der|An{_S}den|Auf{_S}dem|In{_S}der|Unter{_S}den){_S}{_CAP}|(?:(?:Alte[rsn]?|Neue[rsn]?|Große[rsn]?|Kleine[rsn]?|Obere[rsn]?|Untere[rsn]?|Hintere[rsn]?|Vordere[rsn]?|Lange[rsn]?|Hohe[rsn]?){_S})?[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|fährte|grund|steig|markt|hof)){_S}\d{{1,4}}{_S}?[a-z]?(?!\w)(?:{_SEP}\d{{5}}{_S}{_TOWN_DE})?",
            rf"(?<!\w){_CAP}{_S}\d{{1,4}}[a-z]?,{_S}\d{{5}}{_S}{_TOWN_DE}",
        ]
    )
)
_POSTCODE = re.compile(r"(?<!\d)\d{5}(?!\d)")
_LOCAL = r"[\w%+'’\-]+(?:\.[\w%+'’\-]+)*"
_LABEL = r"[A-Za-z0-9À-ÿ](?:[\wÀ-ÿ\-]*[A-Za-z0-9À-ÿ])?"
EMAIL = re.compile(
    rf"(?<![\w.+@%\-]){_LOCAL}(?:{_S}?@{_S}?|{_S}?[\[({{]{_S}?(?:at|@|arroba|chez){_S}?[\])}}]{_S}?)"
    rf"{_LABEL}(?:(?:\.|{_S}?[\[({{]{_S}?(?:dot|\.|punto|point|punkt){_S}?[\])}}]{_S}?){_LABEL})*(?:\.|{_S}?[\[({{]{_S}?(?:dot|\.|punto|point|punkt){_S}?[\])}}]{_S}?)[A-Za-z]{{2,}}(?![\w@])",
    re.I,
)
NUMBER = re.compile(
    rf"(?<![\w.:/#@$&\-+])(?<!\d{_S})(?:[A-Z]{{1,2}}{_S}?)?(?:\+{_S}?|\()?\d(?:[   ().\-/]{{0,3}}\d)*"
    rf"(?:{_S}?(?:ext|x|extension|extensión|Durchwahl|poste|Apparat)\.?{_S}?\d{{1,5}})?(?:[  \-]?[A-Z](?![\w'’]))?(?![\w]|[.:/\-]\d)"
)
_OBJECT = re.compile(r"[^\W\d_]\w*[._]\w[\w.]*|[@#]\w+|0x[0-9A-Fa-f]+")
_PARTICLE = r"(?:de la|de los|de las|de|del|da|dos|du|des|van der|van den|van de|van|von der|von|zu|ten|ter|la|le|bin|ibn|al|el|y|e|di|della)"
_PART = r"(?:[^\W\d_]['’])?[^\W\d_][^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_TITLE_PART = r"(?:(?:al|el|ibn|bin|ben)-)?(?:[A-ZÀ-ÖØ-Þ]['’])?[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?:[’'\-](?:[A-ZÀ-ÖØ-Þ]['’])?[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+))*"
_WORD_OR_INITIAL = rf"(?:{_TITLE_PART}(?![\w])|[A-ZÀ-ÖØ-Þ]\.(?:-?[A-ZÀ-ÖØ-Þ]\.)*)"
RUN = re.compile(rf"(?<![\w@#.\-'’/]){_WORD_OR_INITIAL}(?:(?:,?{_S}|{_S}{_PARTICLE}{_S}){_WORD_OR_INITIAL}){{0,{MOST_PARTS - 1}}}(?![\w@_])")
# Titles before names.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "mme", "mlle", "m", "sr", "sra", "srta", "don", "doña", "señor", "señora", "madame", "monsieur", "sir"}
_TITLE = re.compile(rf"(?:(?:Mrs?|Ms|Miss|Dr|Prof|Frau|Herr|Mme|Mlle|Sra?|Srta|Do[nñ]a?|Señora?|Madame|Monsieur)\.?{_S})+(?=\S)", re.I)
_SKIPPED = TITLES - {"m"}
# Labels of personal numbers, the seeds of their patterns.
ID_LABELS = ["ssn", "social security", "soc . sec", "passport", "travel document", "nino", "ni number", "national insurance", "steuer - id", "steuer-id", "idnr", "steuernummer", "nir", "insee", "sécurité sociale", "dni", "nie", "documento de identidad", "pasaporte", "passeport", "reisepass", "ausweis"]
ADDRESS_LABELS = ["addr", "address", "living at", "form to", "wohnhaft", "formular an", "formulaire au", "formulaire à", "domicilié", "domiciliée", "domicilio en", "formulario a", "adresse", "anschrift", "dirección"]
# Words of those labels that may stand where a name may.
_LABEL_WORDS = {"ssn", "nino", "ni", "nie", "nir", "dni", "insee", "idnr", "steuer-id", "steuernummer", "passport", "pasaporte", "passeport", "reisepass"}
# Within the words around a span, an e-mail address, a number and an address are one word each.
_MAIL, _DIGITS, _PLACE = "\ue000", "\ue001", "\ue002"
_TOKEN = re.compile(r"\n|[^\W\d_]+|\d+|[\ue000-\ue002]+|[^\w\s]")


_MASKS = {_MAIL, _DIGITS, _PLACE}


def _tokens(s: str) -> list[str]:
    return ["9" if t[0].isdigit() else t[0] if t[0] in _MASKS else t.lower() for t in _TOKEN.findall(s)]


def _left(text: str, s: int, n: int) -> list[str]:
    """The ``n`` words before ``s``; the part that is read grows until it holds them, whatever their length."""
    size = 24 * n
    while True:
        lo = max(0, s - size)
        t = _tokens(text[lo:s])
        if not lo:
            return (["^"] * n + t)[-n:]
        if len(t) > n:  # the first word may be cut
            return t[-n:]
        size *= 2


def _right(text: str, e: int, n: int) -> list[str]:
    """The ``n`` words after ``e``, read alike."""
    size = 24 * n
    while True:
        t = _tokens(text[e : e + size])
        if e + size >= len(text):
            return (t + ["$"] * n)[:n]
        if len(t) > n:  # the last word may be cut
            return t[:n]
        size *= 2


class _Words:
    """The words of a text with their places, so that the words around a span are looked up and not read again."""

    def __init__(self, text: str):
        found = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
        self.at = [x[0] for x in found]
        self.words = ["^", "^", *(w[0] if w[0] in _MASKS else "9" if w[0].isdigit() else w.lower() for _, w in found), "$", "$"]

    def left(self, k: int) -> tuple[str, str]:
        """The two words before word ``k``. A title before it is skipped."""
        w, i = self.words, k + 2
        if w[i - 1] in _SKIPPED:
            i -= 1
        elif w[i - 1] == "." and w[i - 2] in _SKIPPED:
            i -= 2
        return w[i - 2], w[i - 1]

    def frames(self, s: int, e: int) -> tuple[str, str, str]:
        """The patterns of a span: two words on both sides, and two on one side with one on the other."""
        j = bisect_left(self.at, e) + 2
        (a, b), c, d = self.left(bisect_left(self.at, s)), self.words[j], self.words[j + 1]
        return f"{a} {b}|{c} {d}", f"{b}|{c} {d}", f"{a} {b}|{c}"


_EDGE = re.compile(rf"^{_PARTICLE}{_S}|{_S}{_PARTICLE}$")


def _loose_edge(span: str) -> bool:
    """Whether a part of a run begins or ends with a particle, or ends with a title."""
    return _EDGE.search(span) is not None or _RUN_WORD.findall(span)[-1].rstrip(".").lower() in _SKIPPED


_PARTS = re.compile(_PART)
_PARTICLES = set(re.sub(r"[(?:)]", "", _PARTICLE).replace("|", " ").split())


def _name_tokens(span: str) -> list[str]:
    return [w for w in map(str.lower, _PARTS.findall(span)) if w not in TITLES and w not in _PARTICLES]


def _trim_title(text: str, s: int, e: int) -> int:
    m = _TITLE.match(text, s, e)
    return m.end() if m else s


def _shape(s: str) -> str:
    s = re.sub(r"\d", "9", re.sub(_S, " ", s))
    return re.sub(r"(?i)(?:ext|x|extension|extensión|durchwahl|poste|apparat)\.? ?9+$", "ext", re.sub(r"[A-Z]", "A", s) if "ext" not in s else s)


def _number_keys(text: str, s: int) -> list[str]:
    a = _left(text, s, 3)
    return [" ".join(a), " ".join(a[1:])]


def _place_keys(text: str, s: int, e: int) -> list[str]:
    return [" ".join(_left(text, s, 2)), "|" + " ".join(_right(text, e, 2))]


def _labelled(key: str, labels: list[str]) -> bool:
    padded = f" {key} "
    return any(f" {x} " in padded for x in labels)


class _Free:
    """Spans of a text that no finding has claimed."""

    def __init__(self, size: int):
        self.taken = bytearray(size + 1)

    def take(self, s: int, e: int) -> bool:
        if any(self.taken[s:e]):
            return False
        self.taken[s:e] = b"\x01" * (e - s)
        return True


def _masks(text: str, free: _Free) -> list[tuple[int, int]]:
    mails = []
    for m in EMAIL.finditer(text):
        s, e = m.start(), m.end()
        if text[s:e].lower().startswith("mailto:"):
            s += 7
        if free.take(s, e):
            mails.append((s, e))
    return mails


def _numbers(text: str, free: _Free) -> Iterator[tuple[int, int, str]]:
    for m in NUMBER.finditer(text):
        v = m.group()
        s, e = m.start(), m.end()
        if v.count("(") > v.count(")"):
            if v[0] != "(":
                continue
            s, v = s + 1, v[1:]
        if v.count("(") != v.count(")") or sum(c.isdigit() for c in v) < 6 or any(free.taken[s:e]):
            continue
        yield s, e, _shape(v)


def _masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    if not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        out += [text[at:s], mark * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words, lists of persons parted: a comma parts where two name words or more stand on both sides of it."""
    chain: list[tuple[int, int]] = []

    def parted() -> Iterator[tuple[int, int]]:
        lo, hi = chain[0][0], chain[-1][1]
        commas = [c for c in range(lo, hi) if text[c] == ","] if "," in text[lo:hi] else []
        ends = [lo, *(c + 1 for c in commas), hi]
        full = [len(_name_tokens(text[a:b])) > 1 for a, b in zip(ends, ends[1:], strict=False)]
        cuts = [c for c, a, b in zip(commas, full, full[1:], strict=False) if a and b]
        if not cuts:
            yield from chain
            return
        for a, b in zip([lo, *(c + 1 for c in cuts)], [*cuts, hi], strict=True):
            yield from (m.span() for m in RUN.finditer(text, a, b))

    for m in RUN.finditer(text):
        if chain and not _JOINED.fullmatch(text, chain[-1][1], m.start()):
            yield from parted()
            chain = []
        chain.append(m.span())
    if chain:
        yield from parted()


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words, or persons of a list of them, without titles before and number labels within."""
    for s, e in _pieces(text):
        for w in _RUN_WORD.finditer(text, s, e):
            if w.group().rstrip(".").lower() in _LABEL_WORDS:
                e = w.start()
                break
        while e > s and text[e - 1] in ", \xa0":
            e -= 1
        s = _trim_title(text, s, e)
        if e > s:
            yield s, e


_RUN_WORD = re.compile(r"[^\s,]+")
_JOINED = re.compile(rf"(?:,?{_S}|{_S}{_PARTICLE}{_S})")


def _parts(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The run and, as a comma or a word before or after a name may have joined it wrongly, all that it may hold, longest first."""
    out = [(s, e)]
    words = [(m.start(), m.end()) for m in _RUN_WORD.finditer(text, s, e)]
    for i in range(len(words)):
        for j in range(len(words), i, -1):
            span = (words[i][0], words[j - 1][1])
            if span != (s, e):
                out.append(span)
    return sorted(out, key=lambda x: x[0] - x[1])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's candidates with their patterns: ``(kind, pat, inst, n)``, counted within a batch first."""
    for b in batches:
        seen: dict[tuple[str, str, str], int] = {}
        for text in b["text"].to_pylist():
            if not text:
                continue
            free = _Free(len(text))
            text = _masked(text, _masks(text, free), _MAIL)
            places = []
            for m in ADDRESS.finditer(text):
                if free.take(m.start(), m.end()):
                    places.append((m.start(), m.end()))
                    inst = xxhash.xxh3_128_hexdigest(m.group().encode("utf-8", "surrogatepass"))
                    for k in _place_keys(text, m.start(), m.end()):
                        seen["address", k, inst] = seen.get(("address", k, inst), 0) + 1
            text = _masked(text, places, _PLACE)
            numbers = list(_numbers(text, free))
            for s, _, shape in numbers:
                for k in _number_keys(text, s):
                    key = ("number", k, shape)
                    seen[key] = seen.get(key, 0) + 1
            text = _masked(text, [x[:2] for x in numbers], _DIGITS)
            words = _Words(text)
            for s, e in _runs(text):
                inst = " ".join(_name_tokens(text[s:e]))
                if inst:
                    for f in words.frames(s, e):
                        key = ("name", f, inst)
                        seen[key] = seen.get(key, 0) + 1
        kind, pat, inst = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(pat, pa.string()), pa.array(inst, pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "pat", "inst", "n"])


def _score_names(edges: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good patterns ``(pat, conf)`` and known tokens of names, after the rounds."""
    edges = cut(edges.select("pat", "inst", "n", F.explode(F.split("inst", " ")).alias("token")))
    seen = edges.groupBy("token").agg(F.sum("n").alias("all"))
    # Patterns with fewer distinct instances can't become good; leaving them out loses nothing.
    broad = edges.groupBy("pat").agg(F.count_distinct("inst").alias("total")).where(F.col("total") >= SUPPORT)
    graph = cut(edges.join(broad, "pat"))
    known = cut(listed)
    seen_known = -1
    while True:
        held = graph.join(known, "token", "left_semi").select("pat", "inst", "total").distinct()
        good = held.groupBy("pat", "total").agg(F.count(F.lit(1)).alias("hits")).where((F.col("hits") >= SUPPORT) & (F.col("hits") >= GOOD * F.col("total")))
        good = cut(good.select("pat", "hits", (F.col("hits") / F.col("total")).alias("conf")))
        # A token becomes known if several sure patterns hold it, and not just a small part of its occurrences.
        fresh = graph.join(good.where(F.col("conf") >= SURE), "pat").groupBy("token").agg(F.sum("n").alias("in"), F.count_distinct("pat").alias("pats")).join(seen, "token")
        fresh = fresh.where((F.col("pats") > 1) & (F.col("in") >= KEPT * F.col("all")) & (F.length("token") > 1)).select("token")
        known, now = cut_with(known.unionByName(fresh).distinct(), n=F.count(F.lit(1)))
        if now["n"] == seen_known:  # known parts only grow, and end
            return good, known
        seen_known = now["n"]


def _score_numbers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good patterns ``(pat, type, conf)`` and known shapes ``(inst, type)`` of phone and document numbers."""
    edges = cut(edges)
    digits = F.length(F.regexp_replace("inst", "[^9]", ""))
    phone_like = (digits.between(7, 15) | F.col("inst").endswith("ext")) & ~F.col("inst").rlike("A")
    label = F.concat(F.lit(" "), F.col("pat"), F.lit(" "))
    seeded = F.lit(False)
    for x in ID_LABELS:
        seeded = seeded | label.contains(f" {x} ")
    totals = edges.groupBy("pat").agg(F.sum("n").alias("total"), F.sum(F.when(phone_like, F.col("n")).otherwise(0)).alias("plausible"))
    shapes = edges.groupBy("inst").agg(F.sum("n").alias("all"))
    ids = edges.where(seeded).select("pat").distinct().select("pat", F.lit("id_number").alias("type"))
    first = edges.where(F.col("inst").startswith("+") & phone_like).select("inst").distinct().select("inst", F.lit("phone").alias("type"))
    good, known = cut(ids.withColumn("conf", F.lit(1.0))), cut(first)
    last = (-1, -1)
    while True:
        met = edges.join(good, "pat").groupBy("inst", "type").agg(F.sum("n").alias("in")).join(shapes, "inst")
        fresh = met.where(F.when(F.col("type") == "phone", phone_like & (F.col("in") >= 0.35 * F.col("all"))).otherwise(F.col("in") >= 0.5 * F.col("all"))).select("inst", "type")
        known, n_known = cut_with(known.unionByName(fresh).distinct(), n=F.count(F.lit(1)))
        held = edges.join(known, "inst").groupBy("pat", "type").agg(F.sum("n").alias("hits")).join(totals, "pat")
        found = held.where((F.col("hits") >= SUPPORT) & ((F.col("hits") >= SURE * F.col("total")) | (F.col("type") == "phone") & (F.col("plausible") >= 0.9 * F.col("total")) & (F.col("hits") >= PHONES * F.col("total")))).select("pat", "type", (F.col("hits") / F.col("total")).alias("conf"))
        good, n_good = cut_with(ids.withColumn("conf", F.lit(1.0)).unionByName(found.join(ids.select("pat"), "pat", "left_anti")), n=F.count(F.lit(1)))
        if (n_known["n"], n_good["n"]) == last:
            return good, known
        last = (n_known["n"], n_good["n"])


def _lefts(names: Mapping[str, float]) -> dict[str, None]:
    """What may stand before the bar of the patterns; a bar can be a word, so every one counts."""
    return {p[:i]: None for p in names for i, c in enumerate(p) if c == "|"}


class Finder:
    """Finds spans in one text with good patterns; ``None`` for the tokens of a span means it needs no further proof.

    With ``asking`` no name is taken, so that every pattern is asked for that could be, whatever the answers are.
    """

    def __init__(self, names: Mapping[str, float], numbers: Mapping[str, str], shapes: Mapping[str, str], places: Mapping[str, str], lefts: Mapping[str, None] | None = None, asking: bool = False):
        self.names, self.numbers, self.shapes, self.places, self.asking = names, numbers, shapes, places, asking
        self.lefts = _lefts(names) if lefts is None else lefts

    def __call__(self, text: str) -> list[tuple[int, int, str, list[str] | None, int, int]]:
        free = _Free(len(text))
        mails = _masks(text, free)
        out: list[tuple[int, int, str, list[str] | None, int, int]] = [(s, e, "email", None, 0, -1) for s, e in mails]
        text, places = _masked(text, mails, _MAIL), []
        for m in ADDRESS.finditer(text):
            keys = _place_keys(text, m.start(), m.end())
            full = _POSTCODE.search(m.group()) is not None or "Box" in m.group()
            if (full or any(k in self.places for k in keys) or _labelled(keys[0], ADDRESS_LABELS)) and free.take(m.start(), m.end()):
                places.append((m.start(), m.end()))
                out.append((m.start(), m.end(), "address", None, 0, -1))
        text = _masked(text, places, _PLACE)
        numbers = list(_numbers(text, free))
        for s, e, shape in numbers:
            keys = _number_keys(text, s)
            by_label = any(_labelled(k, ID_LABELS) for k in keys)
            kind = "id_number" if by_label else next(filter(None, map(self.numbers.get, keys)), None)
            if kind is None or kind == "phone" and "A" in shape:
                kind = self.shapes.get(shape)
            if kind and free.take(s, e):
                out.append((s, e, kind, None, 0, -1))
        text = _masked(text, [x[:2] for x in numbers], _DIGITS)
        words = _Words(text)
        for s, e in list(_runs(text)):
            self._name(text, words, s, e, free, out)
        lefts = self.lefts
        for k, s in enumerate(words.at):
            if not text[s].islower():
                continue
            a, b = words.left(k)
            if (f"{a} {b}" in lefts or b in lefts) and not free.taken[s] and (not s or text[s - 1] not in "_@#.-/'’" and not text[s - 1].isalnum()):
                self._lower(text, words, s, free, out)
        return out

    def _conf(self, words: _Words, s: int, e: int) -> float:
        return max(self.names.get(f, 0.0) for f in words.frames(s, e))

    def _name(self, text: str, words: _Words, s: int, e: int, free: _Free, out: list) -> None:
        if any(free.taken[s:e]):
            return
        parts = _parts(text, s, e)
        if self.asking:
            for a, b in parts:
                self._conf(words, _trim_title(text, a, b), b)
            return
        for a, b in parts:  # after a hit, what is left on both sides may hold further persons
            a = _trim_title(text, a, b)
            conf = self._conf(words, a, b)
            if conf and (tokens := _name_tokens(text[a:b])) and free.take(a, b):
                out.append((a, b, "name", None if conf >= SURE else tokens, 1, -1))
        # Which of the other parts are names is for the known tokens to say; they overlap, and the longest ones count.
        rest = {(_trim_title(text, a, b), b) for a, b in parts}
        rest = [(a, b, t) for a, b in sorted(rest) if not any(free.taken[a:b]) and not _loose_edge(text[a:b]) and len(t := _name_tokens(text[a:b])) > 1]
        for a, b, tokens in rest:
            free.taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, "name", tokens, len(tokens), s))

    def _lower(self, text: str, words: _Words, s: int, free: _Free, out: list) -> None:
        found = [m.span() for m in islice(_LOWER_PART.finditer(text, s), MOST_PARTS)]
        for k in range(len(found), 0, -1):
            e = found[k - 1][1]
            if text[e - 1] == "," or _NOT_NAME.search(text, s, e) or not self._conf(words, s, e):
                continue
            tokens = _name_tokens(text[s:e])
            if tokens and free.take(s, e):
                out.append((s, e, "name", tokens, 1, -1))
                return


_LOWER_PART = re.compile(rf"(?:{_PART}|[^\W\d_]\.)(?![\w@_])|,")
_NOT_NAME = re.compile(r"[^\w\s.,'’\-]|\n")


class _Asked:
    """Stands for the patterns that are not sent out: holds none, notes those asked for that may be among them."""

    def __init__(self, bits: bytes):
        self.bits, self.keys = bits, set()

    def __contains__(self, key: str) -> bool:
        at = xxhash.xxh64_intdigest(key.encode(), seed=42) % MAP_BITS  # as Spark's xxhash64
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def get(self, key: str, default=None):
        if key in self:
            self.keys.add(key)
        return default


def _with_own(model: dict[str, dict], own: list[dict] | None) -> dict[str, Mapping]:
    """The patterns sent out and those of one text."""
    mine: dict[str, dict] = {k: {} for k in KINDS}
    for x in own or []:
        mine[x["kind"]][x["key"]] = x["conf"] if x["kind"] == "name" else x["type"]
    return {k: ChainMap(mine[k], model[k]) if mine[k] else model[k] for k in KINDS}


def _ask(batches: Iterator[pa.RecordBatch], model, maps, places: bool) -> Iterator[pa.RecordBatch]:
    """``(h, kind, key)``: patterns, of places or of all else, that texts ask for and that may be among those not sent out."""
    for b in batches:
        rows = set()
        own = [None] * b.num_rows if places else b["own"].to_pylist()
        for h, text, mine in zip(b["h"].to_pylist(), b["text"].to_pylist(), own, strict=True):
            if places:
                asked = {"place": _Asked(maps.value["place"])}
                masked = _masked(text, _masks(text, _Free(len(text))), _MAIL)
                for m in ADDRESS.finditer(masked):
                    for k in _place_keys(masked, m.start(), m.end()):
                        asked["place"].get(k)
            else:
                asked = {k: _Asked(maps.value[k]) for k in KINDS[:3]}
                Finder(*asked.values(), _with_own(model.value, mine)["place"], _Asked(maps.value["left"]), asking=True)(text)
            rows |= {(h, k, key) for k, a in asked.items() for key in a.keys}
        h, kind, key = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.string()), pa.array(key, pa.string())], ["h", "kind", "key"])


def _map(keys: DataFrame) -> bytes:
    """A bit for each hash of column ``key``."""
    at = keys.select(F.pmod(F.xxhash64("key"), F.lit(MAP_BITS)).alias("at"))
    t = at.groupBy(F.expr("shiftright(at, 3)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at & 7 as int)))").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    out[t["byte"].to_numpy()] = t["bits"].to_numpy()
    return out.tobytes()


def _own_patterns(rows: DataFrame, rest: DataFrame, shared) -> DataFrame:
    """``rows`` with ``own``: the patterns of ``rest`` that the row's text asks for, found by joins.

    Which numbers and names a text asks for depends on its addresses, so these come first. Texts are known by a hash; two
    texts with one hash get the patterns of both, which are all good ones.
    """
    spark = rows.sparkSession
    lefts = rest.where("kind = 'name'").select(F.explode(F.array(*[F.substring_index("key", "|", i) for i in range(1, 6)])).alias("key"))
    maps = spark.sparkContext.broadcast({k: _map(rest.where(F.col("kind") == k)) for k in KINDS} | {"left": _map(lefts)})
    rows = rows.withColumn("h", F.xxhash64("text"))
    gather = lambda d: d.groupBy("h").agg(F.collect_list(F.struct("kind", "key", "conf", "type")).alias("own"))
    answers = lambda d: cut(d.distinct().join(rest, ["kind", "key"]).select("h", "kind", "key", "conf", "type"))
    asked = "h long, kind string, key string"
    first = answers(rows.select("h", "text").mapInArrow(lambda it: _ask(it, shared, maps, True), asked))
    second = rows.join(gather(first), "h", "left").select("h", "text", "own")
    second = answers(second.mapInArrow(lambda it: _ask(it, shared, maps, False), asked))
    return rows.join(gather(first.unionByName(second)), "h", "left").drop("h")


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    base = Finder(*(model.value[k] for k in KINDS))
    n = TaskContext.get().partitionId() << 40  # numbers the texts: ids may repeat
    for b in batches:
        rows = []
        owns = b["own"].to_pylist() if "own" in b.schema.names else [None] * b.num_rows
        for i, text, own in zip(b["id"].to_pylist(), b["text"].to_pylist(), owns, strict=True):
            if text:
                find = base
                if own:
                    both = _with_own(model.value, own)
                    find = Finder(*both.values(), ChainMap(_lefts({x["key"]: 0 for x in own if x["kind"] == "name"}), base.lefts))
                n += 1
                rows += [(i, *x, n) for x in find(text)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [b["id"].type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "s", "e", "kind", "tokens", "need", "run", "doc"])


def find(df: DataFrame, ident: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """``(id, start_pos, end_pos, pii_type)`` of every occurrence, from 0 in code points, end exclusive.

    Null and empty texts have none. ``names`` are the seeds of names. Spans of one text don't overlap: an address found in
    an e-mail, or a name in either, is not reported. Rows repeated with one id are each searched.
    """
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[ident]
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    rows = spread(rows)
    edges = rows.select("text").mapInArrow(_observe, "kind string, pat string, inst string, n long").groupBy("kind", "pat", "inst").agg(F.sum("n").alias("n"))
    edges = cut(edges)
    listed = names.select(F.explode(F.split(F.lower(F.col(f"`{name}`")), r"[^\p{L}'’\-]+")).alias("token")).where(F.length("token") > 1).distinct()
    good, known = _score_names(edges.where("kind = 'name'"), listed)
    numbers, shapes = _score_numbers(edges.where("kind = 'number'"))
    places = edges.where("kind = 'address'").groupBy("pat").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SUPPORT)
    none, text_type = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = [
        good.select(F.lit("name").alias("kind"), F.col("pat").alias("key"), "conf", text_type.alias("type"), F.col("hits").cast("double").alias("support")),
        # Of a pattern or shape of both types one counts.
        numbers.groupBy("pat").agg(F.min_by("type", F.struct("conf", F.col("type") != "phone")).alias("type"), F.max("conf").alias("support")).select(F.lit("number").alias("kind"), F.col("pat").alias("key"), none.alias("conf"), "type", "support"),
        shapes.groupBy("inst").agg(F.min("type").alias("type")).select(F.lit("shape").alias("kind"), F.col("inst").alias("key"), none.alias("conf"), "type", F.lit(0.0).alias("support")),
        places.select(F.lit("place").alias("kind"), F.col("pat").alias("key"), none.alias("conf"), text_type.alias("type"), F.col("k").cast("double").alias("support")),
    ]
    every = cut(reduce(DataFrame.unionByName, parts))
    more = {r["kind"] for r in every.groupBy("kind").count().where(F.col("count") > MOST_PATTERNS).collect()}
    hot = every
    if more:
        best = [every.where(F.col("kind") == k).orderBy(F.desc("support"), "key").limit(MOST_PATTERNS) for k in KINDS]
        hot = cut(reduce(DataFrame.unionByName, best))
    model: dict[str, dict] = {k: {} for k in KINDS}
    for r in hot.collect():
        model[r["kind"]][r["key"]] = r["conf"] if r["kind"] == "name" else r["type"]
    shared = spark.sparkContext.broadcast(model)
    if more:
        rest = cut(every.join(hot.select("kind", "key"), ["kind", "key"], "left_anti"))
        rows = _own_patterns(rows, rest, shared)
    spans = cut(rows.mapInArrow(lambda it: _extract(it, shared), f"id {kind}, s long, e long, kind string, tokens array<string>, need int, run long, doc long"))
    sure = spans.where(F.col("tokens").isNull()).select("id", "s", "e", "kind")
    key = ["id", "doc", "run", "s", "e", "kind"]
    asked = spans.where(F.col("tokens").isNotNull()).select(*key, "need", F.explode(F.array_distinct("tokens")).alias("token"), F.size(F.array_distinct("tokens")).alias("k"))
    proved = asked.join(known, "token", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("hits"), F.least(F.max("need"), F.max("k")).alias("need"))
    proved = cut(proved.where(F.col("hits") >= F.col("need")))
    runs = proved.where("run >= 0").groupBy("id", "doc", "run", "kind").agg(F.sort_array(F.collect_list(F.struct((F.col("s") - F.col("e")).alias("by"), "s", "e"))).alias("parts"))
    apart = lambda acc, x: F.when(F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), acc).otherwise(F.concat(acc, F.array(x)))
    runs = runs.select("id", "kind", F.explode(F.aggregate("parts", F.slice("parts", 1, 1), apart)).alias("x"))
    found = sure.unionByName(proved.where("run < 0").select("id", "s", "e", "kind")).unionByName(runs.select("id", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "kind"))
    return found.select("id", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), F.col("kind").alias("pii_type"))


def redact(df: DataFrame, ident: str, text: str, found: DataFrame) -> DataFrame:
    """``(id, redacted, n_spans)`` of each row: found spans replaced by ``[TYPE]``, the rest of the text unchanged; null stays null.

    ``ident`` must be unique. A text's spans are gathered into its own row only.
    """
    spans = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("spans"))
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(spans, "id", "left")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, (x["start_pos"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("out"), x["end_pos"].cast("int").alias("at"))
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("redacted"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"))
