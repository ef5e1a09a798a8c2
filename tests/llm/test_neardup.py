"""Near-duplicates against all pairs."""

import random
from fractions import Fraction
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest
import xxhash

from tessella.llm import neardup
from tessella.llm.components import components


def brute(rows, num=4, den=5):
    ids = {}
    for i, t in rows:
        if i is not None and neardup.words_of(t):
            ids.setdefault(i, []).append(set(neardup.words_of(t)))
    return {(a, b) for a, b in combinations(sorted(ids), 2) if any(len(x & y) * den >= len(x | y) * num for x in ids[a] for y in ids[b])}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 90), st.integers(0, 30), st.integers(0, 30), st.integers(0, 10**6))
def test_every_pair_over_the_threshold_meets(common, a, b, seed):
    if 5 * common < 4 * (common + a + b):
        return
    h = np.array([xxhash.xxh64_intdigest(f"{seed}-{i}") for i in range(common + a + b)], dtype=np.uint64)
    flat = np.concatenate((h[: common + a], h[:common], h[common + a :]))
    at, keys, whole = neardup.variants(flat, np.array([common + a, common + b]), Fraction(4, 5))
    met = set(keys[at == 0]) & set(keys[at == 1])
    assert met & set(keys[whole])


@pytest.mark.parametrize(("hot", "step"), [(3, 1), (3, 7), (50, 4), (0, 5)])
def test_sorted_variants_meet_across_batches(hot, step):
    """Every pair under a key of up to hot rows comes out, and every row of larger keys, however the rows are cut into batches."""
    import pyarrow as pa

    rng = random.Random(hot * 100 + step)
    rows = [(k, k * 1000 + i, 10, 5) for k in range(12) for i in range(rng.choice([1, 2, 3, 4, 9]))]
    cut = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + step]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["key", "wid", "n", "sketch"]) for i in range(0, len(rows), step)]
    got = [r for b in neardup._meet(Fraction(4, 5), hot)(iter(cut)) for r in b.to_pylist()]
    groups = {k: [r[1] for r in rows if r[0] == k] for k in range(12)}
    pairs = [(r["wid_a"], r["wid_b"]) for r in got if r["key"] is None]
    assert sorted(pairs) == sorted(p for g in groups.values() if len(g) <= hot for p in combinations(g, 2))
    assert sorted(r["wid_a"] for r in got if r["key"] is not None) == sorted(w for g in groups.values() if len(g) > hot for w in g)


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(["quietly", "still", w[0], f"n{rng.randint(0, 99)}", ""])
    rng.shuffle(w)
    return " ".join(w)


@pytest.mark.parametrize("hot", [200, 2])
def test_small(spark, hot):
    rng = random.Random(hot)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 2, 5, 9, 25, 60]))]
        rows += [(f"i{g}-{k}", near(rng, base, rng.randint(0, 4))) for k in range(5)]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper() + " ."), ("null", None), (None, rows[0][1]), ("blank", " \n"), ("dots", "... !"), rows[0], ("long", "x y " * 50_000), ("long2", "y,  X!")]
    df = spark.createDataFrame(rows, "instance_id string, text string").withColumn("wid", neardup.F.lit(1)).withColumn("key", neardup.F.lit(1))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "instance_id", "text", hot=hot).collect()}
    assert got == brute(rows) and ("copy1", "copy2") in got and ("long", "long2") in got


def test_groups(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [("a", " ".join(base)), ("b", " ".join([*base, "x"])), ("c", " ".join([*base[2:], "x", "y"])), ("d", " ".join(base).title()), ("e", "alone"), ("f", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.doc_id: (r.class_id, r.group_id, r.links) for r in neardup.near_duplicate_groups(df, "id", "text", 0.85).collect()}
    assert got["a"][1] == got["b"][1] == got["c"][1] == got["d"][1] == "a" and got["e"] == ("e", "e", 0) and got["d"][0] == "a" and "f" not in got
    assert neardup.near_duplicate_groups(df.limit(0), "id", "text").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(None, 1), (5, 5)] + [(1000, i) for i in range(1001, 1100)]
    want = {}
    for a, b in edges:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_given_instances(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/instances.parquet").select("instance_id", "text").collect()]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.read.parquet(f"{sf}/instances.parquet"), "instance_id", "text").collect()}
    assert got == brute(rows)
