from plumbline.llm import pii as P

GIVEN, SUR = ["Amara", "Bram", "Cormac", "Dmitra", "Eero", "Farid"], ["Quenorell", "Mawrovane", "Nadruvier", "Welkathorne", "Ibarostrin"]


def corpus():
    docs, want = [], []

    def add(*parts):
        text, i = "", len(docs)
        for p in parts:
            if isinstance(p, tuple):
                want.append((i, len(text), len(text) + len(p[0]), p[1]))
                p = p[0]
            text += p
        docs.append((i, text))

    for k in range(24):
        name = f"{GIVEN[k % 6]} {SUR[k % 5]}"
        add("I talked to ", (name, "name"), " yesterday and we agreed. The view dbo.T is fine.")
        add("-- Author: ", (name, "name"), "\n-- Mail: mailto:", (f"a.b{k}@mill-quay.example", "email"), "\nCREATE PROCEDURE dbo.p AS SELECT 1")
        add("Reported by ", (f"{SUR[k % 5].upper()} {GIVEN[k % 6]}", "name"), ", reachable at ", (f"+1 212 555 01{k:02d}", "phone"), ". Offsets 312 555 6204 4689 were written.")
        add("Call ", (f"(212) 555-01{k:02d}", "phone") if k % 2 else (f"+1 212 555 01{k:02d}", "phone"), " before restarting dbo.p, or write to ", (f"x{k} [at] graintoll [dot] example", "email"), ".")
        add("A real person: ", (name, "name"), ", SSN ", (f"936-35-55{k:02d}", "id_number"), ", living at ", (f"{k + 1} Kestrel Lane, Unit A{k % 9}, Dunmere 1234{k % 10}", "address"), ".")
    add("I talked to ", ("Unlisted Zorbanel", "name"), " yesterday and we agreed. The tool Reed reads page 12 Foundry Row dumps.")
    return docs, want


def test_finds_listed_and_unlisted(spark):
    docs, want = corpus()
    rows = [*((i, t, "x") for i, t in docs), (900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "z" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    names = spark.createDataFrame([(g,) for g in GIVEN], "name string")
    found = P.find(df, "doc_id", "text", names)
    got = {tuple(r) for r in found.collect()}
    missed, extra = set(want) - got, got - set(want)
    assert len(missed) <= 0.03 * len(want), sorted(missed)[:5]
    assert len(extra) <= 0.03 * len(want), sorted(extra)[:5]
    out = {r.id: r.redacted for r in P.redact(df, "doc_id", "text", found).collect()}
    assert out[900] is None and out[901] == ""
    assert out[0] == "I talked to [NAME] yesterday and we agreed. The view dbo.T is fine."
    assert P.find(df.limit(0), "doc_id", "text", names).count() == 0


def test_addresses_in_four_languages():
    for text in (
        "Lindenfährte 21b, 66466 Kaltenbrück", "Am Kupfergrund 46, 97824 Grünthalheim", "Nordwallstr. 166, 74364 Wiesenau a. d. Lerm", "73 rue des Saulnières, 46558 Valbrune", "51 chemin de l'Écluse, 54459 Aubeterre-sur-Lys",
        "Avda. de la Salina nº 222, bajo, 40801 Villaquieta", "C/ Molino Alto 13, 3º B, 33159 Torrelumbre", "Plaza de los Tejedores 205\n38098 Arroyofrío", "P.O. Box 9637, Dunmere", "140B St. Orsa Drive, Dunmere", "161 Marlowick Row, Apt 38, Quillmouth 35785",
    ):
        m = P.ADDRESS.search(f"Addr: {text}.")
        assert m and m.group() == text


def test_emails_however_spelled():
    for text in ("a.b+dba@hydro-grid.example", "x [at] mail [dot] wardcare [dot] test", "y(at)north-yard.test", "olu.s @ saltmere.invalid", "NWY@NORTH-YARD.TEST"):
        assert P.EMAIL.search(f"write to {text}, please").group() == text
    for text in ("rulepack@1.6.5", "Archive@ledger_dw fails", "@@ROWCOUNT", "N'@MeterPhase INT'"):
        assert not P.EMAIL.search(text)


def test_patterns_that_are_not_broadcast_are_joined(spark, monkeypatch):
    docs, _ = corpus()
    docs += [(1000 + k, f"Fax: {k} Foundry Row stands empty. cell 212 555 01{k:02d} or personal file 936-35-55{k:02d} is wrong") for k in range(5)]
    docs += [(2000 + k, f"Cell 212 555 01{k:02d} | mail | {GIVEN[k % 6].lower()} {SUR[k % 5].lower()} yesterday and we agreed") for k in range(9)]
    df = spark.createDataFrame([*docs, docs[0], docs[0]], "doc_id long, text string")
    names = spark.createDataFrame([(g,) for g in GIVEN], "name string")
    find = lambda: sorted(tuple(r) for r in P.find(df, "doc_id", "text", names).collect())
    whole = find()
    assert {r[3] for r in whole} == {"name", "phone", "email", "id_number", "address"}
    monkeypatch.setattr(P, "MOST_PATTERNS", 1)
    assert find() == whole


def test_all_persons_of_a_run(spark):
    docs, _ = corpus()
    at = len(docs)
    a, b, c = "Amara Quenorell", "Bram Mawrovane", "Cormac Nadruvier"
    runs = [(f"{a}, {b}", [a, b]), (f"{a}, {b}, {c}", [a, b, c]), (f"Kollegin {b}", [b]), (f"{b} Tabelle Zeile", [b]), ("Quenorell, Amara", ["Quenorell, Amara"]), (f"Kollegin Frau {b}", [b]), (f"{b} de Tabelle", [b])]
    cases = [(f"{x * 2} {x * 3} {t} {x * 4} {x * 5}", w) for x, (t, w) in zip("bcfghjk", runs, strict=True)]  # words around that no other run has
    cases.append((f"I talked to {a}, {b} yesterday and we agreed.", [a, b]))
    rows = [*docs, *((at + k, t) for k, (t, _) in enumerate(cases)), (at, cases[0][0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in P.find(df, "doc_id", "text", spark.createDataFrame([(g,) for g in GIVEN], "name string")).collect():
        if r.id >= at:
            got.setdefault(r.id - at, []).append(cases[r.id - at][0][r.start_pos : r.end_pos])
    want = {k: sorted(w) for k, (_, w) in enumerate(cases)} | {0: sorted([a, a, b, b])}  # the first text comes twice
    assert {k: sorted(v) for k, v in got.items()} == want
