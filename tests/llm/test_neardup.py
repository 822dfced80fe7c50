import random
import zlib

import numpy as np
import pytest

from plumbline.llm import neardup as N
from plumbline.llm import queries as Q


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_superminhash_estimates_and_permutes():
    rng = random.Random(2)
    universe = [rng.getrandbits(64) for _ in range(900)]
    a, b = set(universe[:600]), set(universe[300:])
    sig = N.superminhash([np.array(sorted(x), dtype=np.uint64) for x in (a, b, a, set(universe[:1]), set())], 256)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.1
    assert len({int(v) >> 48 for v in sig[3]}) == 256  # one element takes every rank once
    assert (sig[4] == np.iinfo(np.uint64).max).all()


def test_lower_variance_than_independent_slots():
    rng, errors = random.Random(4), []
    for _ in range(150):
        u = [rng.getrandbits(64) for _ in range(90)]
        a, b = set(u[:60]), set(u[30:])
        s = N.superminhash([np.array(sorted(x), dtype=np.uint64) for x in (a, b)], 256)
        errors.append((s[0] == s[1]).mean() - 1 / 3)
    assert np.std(errors) < np.sqrt(1 / 3 * 2 / 3 / 256)


def docs(rng, n_base=40):
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 80))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "two words"), (i + 3, "three words here"), (i + 4, "THREE words, here")]


def runs(t):
    w = N._WORD.findall(t.lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def brute_pairs(rows, share, key=lambda t: None):
    sets = [(i, runs(t), key(t)) for i, t in rows if t is not None and runs(t)]
    return {(i, j) for a, (i, x, k) in enumerate(sets) for j, y, m in sets[a + 1 :] if jaccard(x, y) >= share and (k is None or k != m)}


@pytest.mark.parametrize("block", [64, 3])
def test_pairs_match_brute_force(spark, block):
    """Small blocks force the way of large buckets."""
    rows = docs(random.Random(7))
    df = spark.createDataFrame(rows, "id long, t string")
    signed = N.signed_texts(df, "id", "t", 3, N.Layout(64, 4, 16), name="t", extra=lambda n, t: (zlib.crc32(t.encode()), 0, 0))
    links = N.linked_classes(signed, N.similar_sets(signed, 0.5, block))[1]
    got = {(min(r.p, r.q), max(r.p, r.q)) for r in N.expand(signed, links, piece=2).collect()}
    assert got == brute_pairs(rows, 0.5, key=lambda t: t)


def test_copies_collapse_and_are_not_linked(spark):
    rows = [(i, "one two three four five six") for i in range(50)] + [(60, "one two three four five seven"), (61, "nothing like it at all here")]
    df = spark.createDataFrame(rows, "id long, t string")
    signed = N.signed_texts(df, "id", "t", 3, N.Layout(64, 4, 16), name="t", extra=lambda n, t: (len(t), ord(t[-1]), 0))
    links = N.linked_classes(signed, N.similar_sets(signed, 0.5))[1]
    assert {(r.p, r.q) for r in N.expand(signed, links, piece=8).collect()} in ({(60, i) for i in range(50)}, {(i, 60) for i in range(50)})


def test_large_bucket_streams_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.range(0, 23).selectExpr("7L as h", "id as s1").unionByName(spark.range(100, 103).selectExpr("9L as h", "id as s1")).unionByName(spark.range(200, 202).selectExpr("11L as h", "id as s1"))
        out = df.repartition(1).sortWithinPartitions("h", "s1").mapInArrow(lambda it: N._pairs(it, 4), "a long, b long, h long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.a for r in out if r.h == 7) == list(range(23))
    assert {(r.a, r.b) for r in out if r.h is None} == {(100, 101), (100, 102), (101, 102)}
    assert sorted(r.a for r in out if r.h == 11) == [200, 201]  # the last bucket may go on in the next partition


def test_name_levels():
    levels = [Q.NAMES.level(n) for n in range(60)]
    assert levels == sorted(levels) and levels[0] == 0 and levels[59] == 7
    assert all(v == 0 or 1 - (1 - Q.NAMES.share(n) ** v) ** 54 >= 0.995 for n, v in enumerate(levels))


def test_two_sets_with_one_id_part(spark):
    rows = [(1, 5, 10), (2, 5, 11), (3, 5, 11), (4, 6, 12)]
    got = {r.id: r.s1 for r in N._own_ids(spark.createDataFrame(rows, "id long, s1 long, s2 long")).collect()}
    assert got[1] == 5 and got[4] == 6 and got[2] == got[3] and got[2] not in (5, 6)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 201)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(links, "x long, y long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {200: 200, 201: 200} | {300 + i: 300 for i in range(30)}
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_names_match_brute_force(spark):
    rng, names = random.Random(3), {"", "a", "ab", "abcd", "ABCD", "dbo.x"}
    for _ in range(25):
        base = "".join(rng.choice("abcdefghij._") for _ in range(rng.choice([5, 12, 30, 44, 50])))
        names.add(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(len(t)) if t else 0
                rng.choice([lambda: t.insert(k, "z"), lambda: t.pop(k) if t else None, lambda: t.__setitem__(k, "Q") if t else None])()
            names.add("".join(t))
            names.add("".join(t).upper())
    df = spark.createDataFrame([(n, "x") for n in sorted(names)] + [(None, "x"), ("dbo.x", "y")], "name string, low string")
    got = {(r.a, r.b) for r in N.near_names(df, 3, Q.NAMES).collect()}
    want = {(a, b) for a in names for b in names if a < b and distance(a.lower(), b.lower()) <= 3}
    assert got == want


def tables(spark, folder, modules, names=()):
    spark.createDataFrame(modules, "module_id long, object_name string, definition string").write.parquet(f"{folder}/live_modules.parquet")
    spark.createDataFrame([(n,) for n in names], "module_qualified_name string").write.parquet(f"{folder}/duplication_findings.parquet")
    return str(folder)


def test_groups_hold_copies_of_other_word_runs(spark, tmp_path):
    """Copies but for the order of a select list differ in word runs; a group must not need a third module to hold them."""
    tail = " from dbo.orders where region = 4 and status <> 7 and created >= @since group by region, status"
    one, two = f"select a, b{tail}", f"select b, a{tail}"
    modules = [(5, "usp_a", one), (9, "usp_a", two), (12, "usp_b", "create view dbo.v as select nothing that is like the others")]
    folder = tables(spark, tmp_path, modules)
    assert runs(one) != runs(two) and jaccard(runs(one), runs(two)) >= 0.5
    assert {r.module_id: r.group_id for r in Q.p3_groups(spark, folder).collect()} == {5: 5, 9: 5, 12: 12}
    assert Q.p3_found(spark, folder).count() == 0


def test_modules_without_runs_and_names_have_groups(spark, tmp_path):
    text = "select a, b from dbo.orders where region = 4"
    modules = [(1, "a", None), (2, "b", "two words"), (3, "c", text), (4, "d", text + " and 1 = 1"), (7, None, "")]
    names = ["dbo.usp_LoadOrders", "dbo.usp_LoadOrdres", "dbo.usp_LoadOrdres", "DBO.usp_LoadOrdresXYZ", "dbo.vw_Nothing", None, ""]
    folder = tables(spark, tmp_path, modules, names)
    assert sorted((r.module_id, r.group_id) for r in Q.p3_groups(spark, folder).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3), (7, 7)]
    least = "DBO.usp_LoadOrdresXYZ"
    assert distance(least.lower(), names[0].lower()) > 3  # held together by the name between them
    got = sorted(tuple(r) for r in Q.p3_name_groups(spark, folder).collect())
    assert got == sorted([(n, least) for n in (names[0], names[1], least)] + [("", ""), ("dbo.vw_Nothing", "dbo.vw_Nothing")])
