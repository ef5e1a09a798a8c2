"""Quota sampling: flows against exhaustive search, shortfalls against counting, and shares of the drawn rows."""

from collections import Counter, defaultdict
from datetime import datetime
from itertools import product
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quotas
from tessella.llm.flow import Network


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 2), st.integers(-3, 5)), min_size=1, max_size=5), st.lists(st.integers(0, 3), min_size=4, max_size=4), st.integers(0, 5))
def test_flow_is_cheapest(arcs, ends, wanted):
    def build():
        net = Network(6)
        for i in range(2):
            net.add(0, 2 + i, ends[i], 0.0)
            net.add(4 + i, 1, ends[2 + i], 0.0)
        return net, [net.add(2 + a, 4 + b, cap, float(cost)) for a, b, cap, cost in arcs]

    net, ids = build()
    sent = net.solve(0, 1, wanted)
    cost = sum(net.flow(i) * x[3] for i, x in zip(ids, arcs, strict=True))
    best = {}
    for f in product(*[range(x[2] + 1) for x in arcs]):
        if all(sum(n for n, x in zip(f, arcs, strict=True) if x[0] == i) <= ends[i] and sum(n for n, x in zip(f, arcs, strict=True) if x[1] == i) <= ends[2 + i] for i in range(2)):
            best[sum(f)] = min(best.get(sum(f), 99), sum(n * x[3] for n, x in zip(f, arcs, strict=True)))
    assert sent == min(wanted, max(best)) and cost == best[sent]


def frames(spark):
    rng = random.Random(9)
    ts = lambda k: datetime(2031, 1, 1 + k % 28, k % 24)
    inst, dec = [], []
    for i in range(900):
        pool = [1, 1, 1, 2, 3][i % 5]
        row = (f"i{i}", "t", rng.choice(["A", "a ", "b", "c", None]), "d", "s", (rng.choice([None, "Fiction", "travel"]) if pool != 2 else None, 1, 1, rng.choice(["short", "medium", "LONG"])), pool, ts(i))
        inst.append(row)
        if i % 40 == 0:
            inst.append((*row[:7], ts(i + 1)))
        if i % 7 == 0:
            dec += [(f"i{i}", "keep", "", ts(3)), (f"i{i}", rng.choice(["DROP", "Keep"]), None, ts(5))]
    inst += [(None, "t", "a", "d", "s", (None, 1, 1, "short"), 1, ts(1)), ("x", None, "a", "d", "s", None, None, ts(1)), ("y", "", "a", "d", "s", None, 1, None)]
    dec += [("nobody", "drop", "", ts(1)), (None, "drop", "", ts(1)), ("i1", None, "", ts(1)), dec[0]]
    rep = [(1, 200), (2, 60), (3, 5000), (4, 10), (5, None)]
    tgt = [(1, "label", "A ", 0.5, 0), (1, "label", "b", 0.3, 0), (1, "label", "c", 0.2, 0), (1, "length", "short", 0.6, 0), (1, "length", "long", 0.2, 50), (1, "length", "medium", 0.2, 0), (1, "genre", "fiction", 0.45, 0), (1, "genre", "travel", 0.3, 0)]
    tgt += [(2, "label", "a", 0.9, 0), (2, "label", "gone", 0.1, 0), (2, "length", "Short", 0.5, 3), (2, "genre", "fiction", 0.1, 0), (3, "label", "a", 0.5, 0), (4, "label", "a", 1.0, 2), (5, "label", "a", None, None), (1, "label", None, 0.5, 1), (None, "label", "a", 0.5, 1), (1, "label", "b", 0.1, 1)]
    return (
        spark.createDataFrame(inst, "instance_id string, text string, label string, dataset string, split string, metadata struct<genre:string,content_words:int,char_len:int,length_bucket:string>, curation_id long, loaded_at timestamp").withColumn("length", quotas.F.lit(1)),
        spark.createDataFrame(dec, "instance_id string, decision string, reason string, decided_at timestamp"),
        spark.createDataFrame(rep, "curation_id long, target_rows int"),
        spark.createDataFrame(tgt, "curation_id long, axis string, category string, target_share double, min_rows int"),
    )


def eligible(i, d):
    last = {}
    for r in d.collect():
        if r.instance_id is not None:
            last[r.instance_id] = max(last.get(r.instance_id, (datetime.min, "")), (r.decided_at, (r.decision or "").lower()))
    out = defaultdict(dict)
    for r in i.collect():
        if r.instance_id and r.curation_id is not None and last.get(r.instance_id, (0, ""))[1] != "drop":
            m = r.metadata
            out[r.curation_id][r.instance_id] = {"label": (r.label or "").strip().lower(), "genre": ((m and m.genre) or "").strip().lower(), "length": ((m and m.length_bucket) or "").strip().lower()}
    return out


def test_shortfalls_and_sample(spark):
    i, d, r, t = frames(spark)
    pools = eligible(i, d)
    size = {x.curation_id: x.target_rows or 0 for x in r.collect()}
    want = {}
    for x in t.collect():
        if x.curation_id is not None and x.category is not None:
            k = (x.curation_id, x.axis, x.category.strip().lower())
            want[k] = max(want.get(k, 0), x.min_rows or 0, int((x.target_share or 0) * size.get(x.curation_id, 0) + 0.5))
    short = {k for k, n in want.items() if sum(v[k[1]] == k[2] for v in pools[k[0]].values()) < n}
    assert {tuple(x) for x in quotas.unreachable(i, d, r, t).collect()} == short and (2, "label", "gone") in short and (4, "label", "a") in short
    drawn = quotas.balanced_sample(i, d, r, t).collect()
    by = defaultdict(list)
    for x in drawn:
        assert {a: x[a] for a in quotas.AXES} == pools[x.curation_id][x.instance_id]
        by[x.curation_id].append(x)
    assert len({(x.curation_id, x.instance_id) for x in drawn}) == len(drawn)
    assert len(by[1]) == 200 and len(by[2]) == 60 and len(by[3]) == len(pools[3]) and not by[4] and not by[5]
    labels, lengths = Counter(x.label for x in by[1]), Counter(x.length for x in by[1])
    assert (labels["a"], labels["b"], labels["c"]) == (100, 60, 40) and lengths["long"] >= 50 and lengths["short"] >= 110
    genres = Counter(x.genre for x in by[1])
    assert abs(genres["fiction"] - 90) <= 8 and abs(genres["travel"] - 60) <= 8
    report = {x.curation_id: x for x in quotas.sample_report(i, d, r, t).collect()}
    assert json.loads(report[1].label_distribution) == {k or "n/a": n for k, n in labels.items()} and report[1].final_count == 200
    assert any(s.startswith("label=gone: wanted 6, got 0") for s in report[2].shortfalls)


def test_empty_tables(spark):
    i, d, r, t = frames(spark)
    assert quotas.balanced_sample(i.limit(0), d, r, t).count() == 0
    assert quotas.unreachable(i, d.limit(0), r, t.limit(0)).count() == 0
    assert quotas.unreachable(i, d, r.limit(0), t).where("curation_id = 4").count() == 1


def test_quotas_are_random_but_repeatable(spark):
    i, d, r, t = frames(spark)
    draw = lambda seed: {x.instance_id for x in quotas.balanced_sample(i, d, r, t, seed).collect()}
    assert draw(1) == draw(1) != draw(2)


def pool(counts, wants):
    cells = quotas.pd.DataFrame([(*k, n) for k, n in sorted(counts.items())], columns=["label", "genre", "length", "rows"])
    size = wants[0][-1]
    return cells, quotas.pd.DataFrame(wants, columns=["axis", "category", "want", "floor", "size"]), size


def test_genre_minimums_hold():
    short = exact = 0
    for seed in range(40):
        rng = random.Random(seed)
        counts = {(a, g, b): 60 if g == "big" else rng.choice([0, 1, 1, 2]) for a in "abcd" for g in ("big", "rare", "odd") for b in "xyz"}
        have = Counter()
        for k, n in counts.items():
            have[k[1]] += n
        wants = [("label", a, 9, 3, 36) for a in "abcd"] + [("length", b, 12, 4, 36) for b in "xyz"] + [("genre", "rare", 6, min(6, have["rare"]), 36), ("genre", "odd", 6, min(6, have["odd"]), 36), ("genre", "big", 24, 0, 36)]
        cells, frame, size = pool(counts, wants)
        q = quotas.cell_quotas(cells, frame, quotas.np.random.default_rng(seed))
        got = {x: Counter() for x in quotas.AXES}
        for r, n in zip(cells.itertuples(), q, strict=True):
            assert 0 <= n <= r.rows
            for x in quotas.AXES:
                got[x][getattr(r, x)] += int(n)
        assert sum(q) == size
        short += sum(got[a][c] < low for a, c, _, low, _ in wants)
        exact += all(got["label"][a] == 9 for a in "abcd") and all(got["length"][b] == 12 for b in "xyz")
    assert (short, exact) == (0, 40)


def test_a_genre_minimum_comes_before_label_and_length_targets():
    counts = {("a", "big", "x"): 50, ("b", "big", "y"): 50, ("a", "rare", "x"): 8}
    cells, frame, _ = pool(counts, [("label", "a", 5, 0, 20), ("label", "b", 15, 14, 20), ("length", "x", 5, 0, 20), ("length", "y", 15, 0, 20), ("genre", "rare", 6, 6, 20), ("genre", "big", 14, 0, 20)])
    q = dict(zip(zip(cells["label"], cells["genre"], strict=True), quotas.cell_quotas(cells, frame, quotas.np.random.default_rng(1)), strict=True))
    assert q == {("a", "big"): 0, ("a", "rare"): 6, ("b", "big"): 14}
