"""Schema drift against a plain Python walk over the files."""

import json
import re
from collections import defaultdict

from tessella.operators import drift

NUMBER = re.compile(r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$")


def kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", list: "array", dict: "object"}.get(type(v), "number")


def canon(v):
    if v is None:
        return None
    if not isinstance(v, bool) and (isinstance(v, (int, float)) or isinstance(v, str) and NUMBER.match(v)):
        return float(v)
    return kind(v), json.dumps(v)


def brute(files, lines):
    records = defaultdict(list)
    for file_id, payload in lines:
        if payload:
            records[file_id].append(json.loads(payload))
    series = defaultdict(list)
    for f in files:
        series[f[1]].append(f)
    out = set()
    for fs in series.values():
        fs.sort(key=lambda f: (f[3], f[0]))
        seen: dict[str, set] = {}
        before, recs_before = {}, []
        for n, (file_id, _, record_kind, _) in enumerate(fs):
            recs = records[file_id]
            now = defaultdict(set)
            for r in recs:
                for k, v in r.items():
                    now[k] |= {kind(v)} - {None}
            key = drift.RECORD_KEYS[record_kind]
            came: dict[str, str] = {}
            if n:
                gone, new = set(before) - set(now), set(now) - set(before)
                old_recs = defaultdict(list)
                for r in recs_before:
                    if r.get(key) is not None:
                        old_recs[r[key]].append(r)
                for a in gone:
                    for b in new:
                        pairs = [(r[key], canon(o.get(a)), canon(r.get(b))) for r in recs if r.get(key) is not None for o in old_recs.get(r[key], [])]
                        if all(x == y for _, x, y in pairs) and len({k for k, x, _ in pairs if x is not None}) >= 2:
                            out.add((file_id, "renamed", a, b))
                            came[b] = a
                out |= {(file_id, "removed", a, "") for a in gone - set(came.values())} | {(file_id, "added", "", b) for b in new - set(came)}
            last: dict[str, set] = {}
            for f, types in now.items():
                src = came.get(f, f if f in before else None)
                earlier = seen.get(src) if src else None
                if types and earlier and types != earlier:
                    out.add((file_id, "retyped", src, f))
                last[f] = types or earlier or set()
            seen, before, recs_before = last, dict(now), recs
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def check(spark, files, lines):
    f = spark.createDataFrame(files, "file_id long, series_id long, record_kind string, written_at long")
    ls = spark.createDataFrame([(a, n, b) for n, (a, b) in enumerate(lines)], "file_id long, line_no int, payload string")
    got = drift.field_changes(f, ls)
    assert got.columns == ["file_id", "drift", "old_field", "new_field"]
    assert rows(got) == brute(files, lines)
    return rows(got)


def test_given_tables(spark, sf):
    f, ls = spark.read.parquet(f"{sf}/metric_files.parquet"), spark.read.parquet(f"{sf}/metric_lines.parquet")
    want = brute([tuple(r) for r in f.select("file_id", "series_id", "record_kind", "written_at").collect()], [tuple(r) for r in ls.select("file_id", "payload").collect()])
    got = drift.field_changes(f.withColumn("field", f.file_name), ls.withColumn("value", ls.payload))
    assert rows(got) == want and len(want) > 5


def test_small_cases(spark):
    r = lambda i, **k: json.dumps({"instance_id": i, **k})
    files = [(n, 1, "instance_metrics", n) for n in range(1, 8)]
    lines = [
        *[(1, r(i, a=0.5 + len(i), b=None, c=1)) for i in ("x", "yy")],
        *[(2, r(i, a_2=str(0.5 + len(i)), b=None, c=None)) for i in ("x", "yy", "new")],
        (2, r("x", a_2="1.5", b=None, c=None)),
        (2, ""),
        *[(3, r(i, **{"a-2": 0.5 + len(i), "c": "t"})) for i in ("x", "yy")],
        *[(4, r(i, **{"a-2": None, "c": None, "b": 3})) for i in ("x", "yy")],
        *[(5, r(i, **{"A": None, "c": 2, "b": [3]})) for i in ("x", "yy")],
        *[(6, r(i, **{"A": "word", "c": {"d": 1}, "b": True})) for i in ("x", "yy")],
    ]
    got = check(spark, files, lines)
    assert (2, "renamed", "a", "a_2") in got and (2, "retyped", "a", "a_2") in got
    assert (3, "retyped", "a_2", "a-2") in got and (3, "retyped", "c", "c") in got and (3, "removed", "b", "") in got
    assert (7, "removed", "A", "") in got


def test_empty_and_null(spark):
    f = spark.createDataFrame([(1, None, None, None)], "file_id long, series_id long, record_kind string, written_at long")
    ls = spark.createDataFrame([(1, 1, None), (None, 2, "{}"), (1, 3, "{bad"), (1, 4, "[1]")], "file_id long, line_no int, payload string")
    assert drift.field_changes(f, ls).count() == 0
    assert drift.field_changes(f.limit(0), ls.limit(0)).count() == 0
    t = drift.ingest(ls, drift.INSTANCE_SCHEMA)
    assert sorted(x._corrupt for x in t.collect() if x._corrupt) == ["[1]", "{bad"]


def test_ingest_and_replay(spark):
    f = spark.createDataFrame([(1, 1, "instance_metrics", 1), (2, 1, "instance_metrics", 2)], "file_id long, series_id long, record_kind string, written_at long")
    lines = [(1, i, json.dumps({"instance_id": k, "ecs": v})) for i, (k, v) in enumerate([("x", 0.1), ("y", 0.2)])]
    lines += [(2, i, json.dumps({"instance_id": k, "ECS": str(v), "confidence": [1, 2], "extra": 7, "mean_ecs": 0.5})) for i, (k, v) in enumerate([("x", 0.1), ("y", 0.2)])]
    ls = spark.createDataFrame(lines, "file_id long, line_no int, payload string")
    t = drift.consistent_table(f, ls, "instance_metrics")
    got = {(r.file_id, r.instance_id): r for r in t.collect()}
    assert got[2, "y"].ecs == 0.2 and got[2, "y"].confidence is None and got[1, "x"]._rescued is None
    assert json.loads(got[2, "x"]._rescued) == {"confidence": [1, 2], "extra": 7, "mean_ecs": 0.5}
    again = {(r.file_id, r.instance_id): r for r in drift.replay(t, {"extra": "bigint"}).collect()}
    assert again[2, "x"].extra == 7 and json.loads(again[2, "x"]._rescued) == {"confidence": [1, 2], "mean_ecs": 0.5}


def test_nothing_is_lost(spark):
    """A value is in its typed column unchanged, or whole in the rescued JSON."""
    schema = {"d": "double", "n": "bigint", "b": "boolean", "s": "string", "a": "array<string>", "m": "map<string,bigint>"}
    values = [None, 3, 3.7, "3", "38.42%", True, "true", [0.5], ["x"], ["x", None], [1, 2], [], {"value": 0.25, "n": 4}, {"k": 1}, {"k": 1.5}, {}, "word", "", 1e300, -0.0]
    rows = [(1, i, json.dumps({c: v for c in schema} | {"other": v})) for i, v in enumerate(values)]
    t = drift.ingest(spark.createDataFrame(rows, "file_id long, line_no int, payload string"), schema)
    strict = {"d": (int, float), "n": int, "b": bool, "s": str}
    for r in t.collect():
        v = values[r.line_no]
        rest = json.loads(r._rescued)
        assert rest["other"] == v
        for c in schema:
            held = r[c]
            if held is None:
                assert v is None and c not in rest or rest[c] == v
            else:
                assert c not in rest and held == v and (c not in strict or isinstance(v, strict[c] if c != "n" else (int, float)) and (c == "b" or not isinstance(v, bool)))
    done = {r.line_no: r for r in drift.replay(t, {"d": "double", "n": "bigint", "b": "boolean"}).collect()}
    d = lambda v: done[values.index(v)].d
    assert [d(v) for v in ("3", "38.42%", [0.5], {"value": 0.25, "n": 4}, 3.7)] == [3.0, 0.3842, 0.5, 0.25, 3.7]
    assert d("word") is d([1, 2]) is d({"k": 1}) is d([]) is None and json.loads(done[values.index([1, 2])]._rescued)["d"] == [1, 2]
    assert done[values.index("3")].n == 3 and done[values.index(3.7)].n is None and done[values.index("true")].b is True
    assert all(json.loads(done[i]._rescued)["other"] == v for i, v in enumerate(values))
