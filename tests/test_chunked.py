import random
from datetime import datetime, timedelta

from plumbline.operators.chunked import keyed_stats, prefix_sums


def brute(rows):
    out = {}
    for k, i, kind, at in rows:
        n, ids, kinds, ats = out.setdefault(k, [0, set(), set(), []])
        out[k][0] += 1
        ids |= {i} - {None}
        kinds |= {kind} - {None}
        ats += [at] if at is not None else []
    return {k: (n, len(i), len(c), min(a, default=None), max(a, default=None)) for k, (n, i, c, a) in out.items()}


def run(spark, rows, chunks):
    df = spark.createDataFrame(rows, "name string, id long, kind string, at timestamp, cell string, chunk int" if rows and len(rows[0]) == 6 else "name string, id long, kind string, at timestamp")
    return {r.key: (r.n_rows, r.n_ids, r.n_kinds, r.first_at, r.last_at) for r in keyed_stats(df, "name", "id", "kind", "at", chunks).collect()}


def test_hot_keys_hot_ids_nulls_and_repeats(spark):
    rng, t0 = random.Random(3), datetime(2025, 1, 1)
    rows = []
    for n in range(3000):
        u = rng.random()
        key = "hot" if u < 0.35 else None if u < 0.4 else f"k{rng.randrange(60)}"
        ident = 1 if key == "hot" and rng.random() < 0.9 else None if rng.random() < 0.05 else rng.randrange(400)
        rows.append((key, ident, rng.choice(["a", "b", None]), t0 + timedelta(seconds=rng.randrange(9999)) if rng.random() > 0.02 else None))
    for chunks in (1, 5, 64):
        assert run(spark, rows, chunks) == brute(rows)


def test_empty_single_and_clashing_columns(spark):
    assert run(spark, [], 4) == {}
    t = datetime(2025, 1, 1)
    assert run(spark, [("", 1, "a", t, "c", 1)], 4) == {"": (1, 1, 1, t, t)}


def test_prefix_sums(spark):
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as o", "id % 13 as n")
    rows = prefix_sums(df, "o", "n", "before", 5).orderBy("o").collect()
    acc = 0
    for r in rows:
        assert r.before == acc
        acc += r.n
