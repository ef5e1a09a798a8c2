"""Samples whose shares by category follow targets, by minimum-cost flow on cross-classified cell counts.

Eligible rows of a pool are counted by cell (label, genre, length). For each axis a flow runs from its categories (as much
as each should have) through the cells, whose arcs hold what is available, or over the category's slack arc, which is dear:
the flow on it is the category's shortfall. Quotas come from a flow through the same cells, source - label - cell - length - sink: floors, targets and overflow are arcs of rising
cost at either end; a cell's arcs are cheap up to the whole part of its share in the fitted table (iterative
proportional fitting to all three axes), then one row at a random cost that falls with the fraction, then dear. So labels
and lengths follow their targets exactly where that is possible, genres up to rounding, and quotas are drawn at random.
Genres below their minimum are then raised by exchanges along cycles of the flow (``raise_minimums``).
Rows are drawn by a hash within each cell.

Only cell counts reach one task, never rows. Drawing keeps the best ranks within parts of each cell before the ranks of
the cell, so a pool that holds much of the table is not one task.

Defined results for unusual input: rows with null ids or pools are left out; an instance loaded again counts once (latest
load); null and blank categories are a category without a target, reported as n/a; null decisions do not drop; pools without
targets are sampled in proportion, targets without a pool are all short; a null share, minimum or target size is 0;
targets that name a category twice take the larger want; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.flow import Network
from tessella.session import materialise

AXES = ("label", "genre", "length")
SEED = 42
#: Parts of a cell whose best ranks are taken first.
PARTS = 16
ROUNDS = 30


def _clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def eligible_rows(instances: DataFrame, decisions: DataFrame) -> DataFrame:
    """curation_id, instance_id, label, genre, length of every instance that the latest decision does not drop."""
    axes = F.struct(F.col("loaded_at"), F.struct(_clean(F.col("label")).alias("label"), _clean(F.col("metadata.genre")).alias("genre"), _clean(F.col("metadata.length_bucket")).alias("length")).alias("of"))
    rows = instances.where("curation_id is not null and instance_id is not null").groupBy("curation_id", "instance_id").agg(F.max(axes).alias("x"))
    latest = decisions.where("instance_id is not null").groupBy("instance_id").agg(F.max(F.struct("decided_at", _clean(F.col("decision")).alias("d"))).alias("x")).select("instance_id", F.col("x.d").alias("decision"))
    kept = rows.join(latest, "instance_id", "left").where("decision is null or decision <> 'drop'")
    return kept.select("curation_id", "instance_id", *[F.coalesce(F.col(f"x.of.{a}"), F.lit("")).alias(a) for a in AXES])


def wanted_rows(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """curation_id, axis, category, want, floor, size: the rows that each category should have of size in all."""
    sizes = reports.where("curation_id is not null").groupBy("curation_id").agg(F.max("target_rows").alias("size"))
    want = F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("size", F.lit(0))).cast("long")
    each = targets.where("curation_id is not null and category is not null").join(sizes, "curation_id", "left")
    each = each.select("curation_id", _clean(F.col("axis")).alias("axis"), _clean(F.col("category")).alias("category"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("floor"), want.alias("want"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    return each.groupBy("curation_id", "axis", "category").agg(F.max(F.greatest("want", "floor")).alias("want"), F.max("floor").alias("floor"), F.max("size").alias("size"))


def shortfalls(cells: pd.DataFrame, axis: str, want: dict[str, int]) -> dict[str, int]:
    """Flow on the slack arcs of an axis' categories in the network source - category - cell - sink, whose cells hold what is
    available: what of each want no cell can give."""
    if not want:
        return {}
    names = list(want)
    at = {c: i + 2 for i, c in enumerate(names)}
    net = Network(2 + len(names) + len(cells))
    slack = {}
    for c in names:
        net.add(0, at[c], want[c], 0.0)
        slack[c] = net.add(at[c], 1, want[c], 1.0)
    for k, (c, rows) in enumerate(zip(cells[axis], cells["rows"], strict=True)):
        if c in at:
            net.add(at[c], 2 + len(names) + k, int(rows), 0.0)
            net.add(2 + len(names) + k, 1, int(rows), 0.0)
    net.solve(0, 1, sum(want.values()))
    return {c: net.flow(a) for c, a in slack.items()}


def fitted(counts: np.ndarray, codes: list[np.ndarray], margins: list[np.ndarray | None], size: int) -> np.ndarray:
    """Shares of the cells, of size in all, none above its count, that come near the margins of all axes."""
    x = counts.astype(float)
    x *= min(1.0, size / max(1.0, x.sum()))
    for _ in range(ROUNDS):
        for code, margin in zip(codes, margins, strict=True):
            if margin is not None:
                now = np.bincount(code, weights=x, minlength=len(margin))
                x = x * np.where(now > 0, np.divide(margin, now, out=np.ones_like(now), where=now > 0), 1.0)[code]
        x = np.minimum(x, counts)
    short = min(size, counts.sum()) - x.sum()
    if short < 0:
        return x * ((x.sum() + short) / x.sum())
    for room in (np.where(x > 1e-6, counts - x, 0.0), counts - x):
        room = np.minimum(room, counts - x)
        if short > 1e-9 and room.sum() > 0:
            add = room * min(1.0, short / room.sum())
            x, short = x + add, short - add.sum()
    return x


def _margin(names: list[str], want: dict[str, int], available: np.ndarray, size: int) -> np.ndarray | None:
    """What each category of an axis should have so that size rows come out."""
    if not want:
        return None
    ask = np.array([min(want.get(c, 0), available[i]) for i, c in enumerate(names)], dtype=float)
    missing = min(size, available.sum()) - ask.sum()
    if missing > 0:
        named = np.array([c in want for c in names])
        # what the targets leave open goes to categories without one, what is not available to the others with one
        for which, most in ((~named, max(0, size - sum(want.values()))), (named, missing), (~named, missing)):
            room = np.where(which, available - ask, 0.0)
            take = min(missing, room.sum(), most)
            if take > 0:
                ask += room * (take / room.sum())
                missing -= take
    elif missing < 0:
        ask *= min(size, available.sum()) / ask.sum()
    return ask


def raise_minimums(net: Network, arcs: list[list[int]], genre: np.ndarray, least: np.ndarray, reserved: set[int]) -> None:
    """Change a solved flow, arcs[k] being those of cell k, so that each genre has its least rows where a chain of exchanges gets there.

    A row is put into a cell of the genre and the flow closed by the cheapest cycle through the rest of the network, which
    takes rows from genres above their minimum. Label and length minimums stay; their targets give way only if no cycle keeps
    them, as leaving them costs more. Where all other genres are at their minimum, one of them lends a row and is raised in turn."""
    cell = {e: k for k, own in enumerate(arcs) for e in own}
    have = np.zeros(len(least), dtype=np.int64)
    for e, k in cell.items():
        have[genre[k]] += net.flow(e)

    def gain(edges: list[int]) -> np.ndarray:
        out = np.zeros_like(have)
        for e in edges:
            if (e & ~1) in cell:
                out[genre[cell[e & ~1]]] += -1 if e & 1 else 1
        return out

    def best(g: int, lends: frozenset[int], shut: frozenset[int]) -> list[int] | None:
        """The cheapest cycle that puts a row into g and takes rows only from genres above their minimum or in lends."""
        barred = {c for c in range(len(least)) if c in shut or c == g or have[c] <= least[c] and c not in lends}
        closed = reserved_back | {e ^ 1 for e, k in cell.items() if genre[k] in barred}
        found, cost = None, float("inf")
        for e, k in cell.items():
            if genre[k] == g and net.left[e]:
                way = net.cheapest_path(net.to[e], net.to[e ^ 1], closed | {e ^ 1})
                if way is not None and net.cost[e] + sum(net.cost[x] for x in way) < cost:
                    found, cost = [e, *way], net.cost[e] + sum(net.cost[x] for x in way)
        return found

    def cycle(g: int, lends: frozenset[int], shut: frozenset[int]) -> list[int] | None:
        """As best(), and no genre is left more than one row under its minimum; those it would be are shut one after another."""
        while (edges := best(g, lends, shut)) is not None:
            change = gain(edges)
            over = {c for c in range(len(least)) if change[c] < 0 and have[c] + change[c] < least[c] - (c in lends)}
            if not over:
                return edges
            shut = shut | over
        return None

    def push(edges: list[int], way: int) -> None:
        nonlocal have
        for e in edges:
            net.left[e] -= way
            net.left[e ^ 1] += way
        have = have + way * gain(edges)

    def lift(g: int, held: frozenset[int]) -> bool:
        """One row more for g; genres in held give none."""
        if (edges := cycle(g, frozenset(), held)) is not None:
            push(edges, 1)
            return True
        for lender in range(len(least)):
            if lender == g or lender in held or have[lender] != least[lender] or least[lender] == 0:
                continue
            if (edges := cycle(g, frozenset([lender]), held)) is None:
                continue
            push(edges, 1)
            if have[lender] >= least[lender] or lift(lender, held | {g}):
                return True
            push(edges, -1)
        return False

    reserved_back = {e ^ 1 for e in reserved}
    for g in range(len(least)):
        while have[g] < least[g] and lift(g, frozenset()):
            pass


def cell_quotas(cells: pd.DataFrame, wants: pd.DataFrame, rng: np.random.Generator) -> np.ndarray:
    """Rows to draw of each cell (label, genre, length, rows)."""
    counts = cells["rows"].to_numpy(dtype=np.int64)
    size = int(min(wants["size"].max() if len(wants) else 0, counts.sum()))
    if size <= 0 or not len(cells):
        return np.zeros(len(cells), dtype=np.int64)
    want = {a: {r.category: int(r.want) for r in wants[wants["axis"] == a].itertuples()} for a in AXES}
    floor = {a: {r.category: int(r.floor) for r in wants[wants["axis"] == a].itertuples()} for a in AXES}
    names, codes, margins = {}, [], []
    for a in AXES:
        names[a], code = np.unique(cells[a].to_numpy(dtype=str), return_inverse=True)
        codes.append(code)
        margins.append(_margin(list(names[a]), want[a], np.bincount(code, weights=counts), size))
    share = fitted(counts, codes, margins, size)
    whole = np.minimum(np.floor(share + 1e-9).astype(np.int64), counts)
    part = share - whole
    first, last = names["label"], names["length"]
    net = Network(2 + len(first) + len(last))
    at_first, at_last = 2, 2 + len(first)

    def ends(axis: str, own: np.ndarray, code: np.ndarray, arc) -> None:
        available = np.bincount(code, weights=counts, minlength=len(own))
        for i, c in enumerate(own):
            low = min(floor[axis].get(c, 0), int(available[i]))
            goal = max(low, min(want[axis].get(c, 0), int(available[i]))) if want[axis] else int(available[i])
            arc(i, low, 0.0)
            arc(i, goal - low, 100.0)
            arc(i, int(available[i]) - goal, 10_000.0)

    reserved = set()  # arcs of label and length minimums

    def end(a: int, b: int, n: int, cost: float) -> None:
        arc = net.add(a, b, n, cost)
        if cost == 0.0:
            reserved.add(arc)

    ends("label", first, codes[0], lambda i, n, c: end(0, at_first + i, n, c))
    ends("length", last, codes[2], lambda i, n, c: end(at_last + i, 1, n, c))
    arcs = []
    for k in range(len(cells)):
        a, b = at_first + int(codes[0][k]), at_last + int(codes[2][k])
        own = [net.add(a, b, int(whole[k]), 0.0)]
        rest = int(counts[k] - whole[k])
        if rest > 0:
            # the smallest of exponential times with rate part: drawn first in proportion to the fraction
            own.append(net.add(a, b, 1, 1.0 + min(20.0, rng.exponential() / max(float(part[k]), 0.05))))
            own.append(net.add(a, b, rest - 1, 30.0 + rng.random()))
        arcs.append(own)
    net.solve(0, 1, size)
    least = np.array([floor["genre"].get(g, 0) for g in names["genre"]], dtype=np.int64)
    raise_minimums(net, arcs, codes[1], np.minimum(least, np.bincount(codes[1], weights=counts, minlength=len(least)).astype(np.int64)), reserved)
    return np.array([sum(net.flow(e) for e in own) for own in arcs], dtype=np.int64)


_SOLVED = "curation_id long, kind string, axis string, category string, label string, genre string, length string, want long, available long, unavailable long, quota long"


def solve_pool(key: tuple, cells: pd.DataFrame, wants: pd.DataFrame, seed: int, quotas: bool) -> pd.DataFrame:
    out = []
    cells = cells.sort_values(list(AXES))
    for a in AXES:
        own = wants[wants["axis"] == a]
        available = cells.groupby(a)["rows"].sum().astype(int).to_dict() if len(cells) else {}
        want = {r.category: int(r.want) for r in own.itertuples()}
        for c, short in shortfalls(cells, a, want).items():
            out.append((key[0], "category", a, c, None, None, None, want[c], available.get(c, 0), short, None))
    if quotas:
        rng = np.random.default_rng([seed, zlib.crc32(repr(int(key[0])).encode())])
        for r, q in zip(cells.itertuples(), cell_quotas(cells, wants, rng), strict=True):
            out.append((key[0], "cell", None, None, r.label, r.genre, r.length, None, int(r.rows), None, int(q)))
    return pd.DataFrame(out, columns=["curation_id", "kind", "axis", "category", "label", "genre", "length", "want", "available", "unavailable", "quota"]).astype({k: "Int64" for k in ("want", "available", "unavailable", "quota")})


def solved(eligible: DataFrame, wanted: DataFrame, seed: int = SEED, quotas: bool = True) -> DataFrame:
    """Rows of kind category (want, available, unavailable) and, with quotas, of kind cell (label, genre, length, quota) of
    every pool."""
    cells = eligible.groupBy("curation_id", *AXES).agg(F.count("*").alias("rows"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return solve_pool(key, left, right, seed, quotas)

    # the partitions are named, as small ones would be merged into one task by their bytes, and solving takes time
    tasks = int(eligible.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = cells.repartition(tasks, "curation_id"), wanted.repartition(tasks, "curation_id")
    return left.groupBy("curation_id").cogroup(right.groupBy("curation_id")).applyInPandas(run, _SOLVED)


def unreachable(instances: DataFrame, decisions: DataFrame, reports: DataFrame, targets: DataFrame) -> DataFrame:
    """curation_id, axis, category of every target with a shortfall of available rows."""
    found = solved(eligible_rows(instances, decisions), wanted_rows(targets, reports), quotas=False)
    return found.where("kind = 'category' and unavailable > 0").select("curation_id", "axis", "category")


def _drawn(eligible: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    quotas = plan.where("kind = 'cell' and quota > 0").select("curation_id", *AXES, "quota")
    rows = eligible.join(quotas, ["curation_id", *AXES]).withColumn("h", F.xxhash64(F.lit(seed), "curation_id", "instance_id"))
    rows = rows.withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(PARTS)))
    cell = ["curation_id", *AXES]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*cell, "part").orderBy("h", "instance_id"))).where("r <= quota")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "instance_id"))).where("r <= quota")
    return rows.select("curation_id", "instance_id", *AXES)


def balanced_sample(instances: DataFrame, decisions: DataFrame, reports: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """curation_id, instance_id, label, genre, length of the drawn rows."""
    eligible = materialise(eligible_rows(instances, decisions), "eligible")
    return _drawn(eligible, materialise(solved(eligible, wanted_rows(targets, reports), seed), "quotas"), seed)


def sample_report(instances: DataFrame, decisions: DataFrame, reports: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per pool: final_count, the three distributions as JSON, and shortfalls ('axis=category: wanted n, got m')."""
    eligible = materialise(eligible_rows(instances, decisions), "eligible")
    plan = materialise(solved(eligible, wanted_rows(targets, reports), seed), "quotas")
    cells = plan.where("kind = 'cell'").select("curation_id", "quota", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in AXES])).alias("x")).select("curation_id", "x.axis", "x.category", "quota")
    got = cells.groupBy("curation_id", "axis", "category").agg(F.sum("quota").alias("got"))
    want = plan.where("kind = 'category'").select("curation_id", "axis", "category", "want")
    both = got.join(want, ["curation_id", "axis", "category"], "full").withColumn("got", F.coalesce("got", F.lit(0)))
    name = F.when(F.col("category") == "", F.lit("n/a")).otherwise(F.col("category"))
    short = F.when(F.col("got") < F.col("want"), F.concat("axis", F.lit("="), name, F.lit(": wanted "), "want", F.lit(", got "), "got"))
    shares = [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("axis") == a) & ((F.col("got") > 0) | F.col("want").isNotNull()), F.struct(name.alias("k"), F.col("got").alias("v"))))))).alias(f"{a}_distribution") for a in AXES]
    return both.groupBy("curation_id").agg(F.coalesce(F.sum(F.when(F.col("axis") == "label", F.col("got"))), F.lit(0)).alias("final_count"), *shares, F.array_sort(F.collect_list(short)).alias("shortfalls"))
