import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import mixing as M
from plumbline.llm import tokenizer as T


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  aB'sß9²中😀.,-\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_tree_equals_direct_encoding(reference, text):
    ids = reference.encode(text, add_special_tokens=False).ids
    for leaf in (2, 5, 17):
        tree = T.Tree(T.vocabulary_file(), leaf=leaf)
        assert tree.encode(text).tolist() == ids
    assert tree.decode(ids) == text


def test_long_runs_and_special_strings(reference):
    for text in ("x" * 9000, " " * 5000 + "a", "<|endoftext|>" * 30, "it's we'll " * 400, "\n" * 777):
        assert T.Tree(T.vocabulary_file(), leaf=64).encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_encode_whole_table_and_blocks(spark, reference):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcé '\n") for _ in range(9)) for _ in range(400))
    rows = [(1, None, "a"), (2, "", "a"), (3, "Hello, world", "a"), (3, "Hello, world", "b"), (4, long, "c"), (4, long[::-1], "c"), (4, long, "c"), (5, "y" * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((i, [] if not t else reference.encode(t, add_special_tokens=False).ids) for i, t, _ in rows)
    for block in (1 << 20, 300):
        got = sorted((r.id, list(r.ids)) for r in T.encode(df, "doc_id", "text", leaf=50, block=block).collect())
        assert got == want
        counts = T.count_tokens(df, "text", "doc_id", block=block).collect()
        assert sorted((r.doc_id, r.ids) for r in counts) == sorted((i, len(x)) for i, x in want)
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


def test_pfair_deviation_is_less_than_a_block():
    for quotas in ([50, 30, 20], [1, 1, 997], [333, 333, 334], [7]):
        sources = [M.Source(str(i), 0, 1, quota=q) for i, q in enumerate(quotas)]
        total = M.schedule(sources, 1)
        assert sorted(t for s in sources for t in s.slots) == list(range(total))
        for s in sources:
            share, given_ = Fraction(s.blocks, total), 0
            for t in range(total):
                given_ += t in set(s.slots)
                assert abs(given_ - share * (t + 1)) < 1


def test_allocation_fills_caps_and_sums_up():
    s = [M.Source("a", 0.5, 1, tokens=100), M.Source("b", 0.3, 2, tokens=1000), M.Source("none", 0.1, 3, tokens=0), M.Source("c", 0.1, 1, tokens=5000)]
    M.allocate(s, 1501)
    assert [x.quota for x in s][:3] == [100, 1051, 0] and sum(x.quota for x in s) == 1501
    M.allocate(s, 10**6)
    assert [x.quota for x in s] == [100, 2000, 0, 5000]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "unlisted"]), rng.choice([0, 1, 5, 40])) for i in range(400)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mix(sized, targets, blocks=50)
    got = mixed.collect()
    total = sum(r[2] for r in rows)
    have = {s: sum(r[2] for r in rows if r[1] == s) for s in "abc"}
    used = {s: sum(r.used_tokens for r in got if r.source == s) for s in "abc"}
    assert sum(used.values()) == min(total, have["a"] + 3 * have["b"] + 2 * have["c"])
    caps = {"a": 1, "b": 3, "c": 2}
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert uses[r.doc_id] <= caps[r.source] and 0 <= r.used_tokens <= r.n_tokens
    report = {r.source: r for r in M.shares(mixed, sized, targets).collect()}
    assert report["empty"].used_tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert {s: report[s].used_tokens for s in "abc"} == used
    assert M.mix(sized.limit(0), targets).count() == 0
