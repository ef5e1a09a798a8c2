"""Records whose shape drifts from file to file: change log and rescue-column ingestion.

``ingest`` reads every payload once into one typed table that enforces the target schemas: a value fills its column only if
it has the column's JSON type and survives the cast (3.7 is no bigint, a number no boolean); unknown fields and values that
don't fit stay as JSON in ``_rescued``, and ``_types`` notes the JSON types that came in. ``field_changes`` lists every
added, removed, renamed and retyped top-level field of each file against the file before it in its series, from that
table: types from ``_types``, values from the typed columns and ``_rescued``. ``replay`` moves rescued values into typed
columns, also under the names that files gave a field later, and promotes approved fields (``APPROVED``): numbers written as
strings, percents, arrays of one value and objects with a ``value`` give their number; what gives none stays rescued.

Defined results for unusual input: null, empty or malformed payloads hold no field (``ingest`` keeps malformed ones
whole in ``_corrupt``); of a field that a record names twice the last holds; files without records have no field, so all fields of the file before are removed; files with
a null series_id are not compared; records with a null key are never the same record; equal written_at are ordered by
file_id; repeated rows of either table count once. Further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rescue
from tessella.session import materialise

# The fields by which records of a kind are the same, and the target schemas with their types.
RECORD_KEYS = {"instance_metrics": "instance_id", "aggregate_metrics": "group_name"}
INSTANCE_SCHEMA = {
    "instance_id": "string",
    "dataset": "string",
    "model": "string",
    "predicted_label": "string",
    "model_refused": "boolean",
    "correct": "boolean",
    "truncated_strategies": "array<string>",
    "confidence": "double",
    "jaccard_H_R": "double",
    "jaccard_H_CF": "double",
    "jaccard_H_RO": "double",
    "jaccard_R_CF": "double",
    "jaccard_R_RO": "double",
    "jaccard_CF_RO": "double",
    "rbo_H_RO": "double",
    "normalized_kendall_H_RO": "double",
    "ecs": "double",
    "ecs_extraction_rationale": "double",
}
AGGREGATE_SCHEMA = {
    "aggregation_level": "string",
    "group_name": "string",
    "n_instances": "bigint",
    "pair_ns": "map<string,bigint>",
    "mean_ecs": "double",
    "std_ecs": "double",
    "median_ecs": "double",
    "ecs_ci_lower": "double",
    "ecs_ci_upper": "double",
    "mean_rbo_H_RO": "double",
    "mean_kendall_H_RO": "double",
    "mean_ecs_extraction_rationale": "double",
    "mean_jaccard_H_R": "double",
    "mean_jaccard_H_CF": "double",
    "mean_jaccard_H_RO": "double",
    "mean_jaccard_R_CF": "double",
    "mean_jaccard_R_RO": "double",
    "mean_jaccard_CF_RO": "double",
}
# Fields that files add later and that are approved for promotion: record_kind, field, type.
APPROVED = (
    ("instance_metrics", "overlap_H_R", "double"),
    ("instance_metrics", "overlap_H_CF", "double"),
    ("instance_metrics", "overlap_H_RO", "double"),
    ("instance_metrics", "overlap_R_CF", "double"),
    ("instance_metrics", "overlap_R_RO", "double"),
    ("instance_metrics", "overlap_CF_RO", "double"),
    ("instance_metrics", "ecs_overlap", "double"),
    ("instance_metrics", "kendall_H_RO", "double"),
    ("instance_metrics", "ecs_random", "double"),
    ("instance_metrics", "ecs_lift", "double"),
    ("instance_metrics", "ecs_adj", "double"),
    ("instance_metrics", "ecs_adj_er", "double"),
    ("instance_metrics", "ecs_extraction_perturbation", "double"),
    ("instance_metrics", "r_introduced_concept_rate", "double"),
    ("instance_metrics", "cf_canonical_minimality", "double"),
    ("aggregate_metrics", "mean_ecs_overlap", "double"),
    ("aggregate_metrics", "mean_ecs_lift", "double"),
    ("aggregate_metrics", "mean_ecs_adj", "double"),
    ("aggregate_metrics", "mean_cc3_size", "double"),
    ("aggregate_metrics", "kappa_H_R", "double"),
    ("aggregate_metrics", "highlighting_success_rate", "double"),
    ("aggregate_metrics", "rationale_success_rate", "double"),
    ("aggregate_metrics", "counterfactual_success_rate", "double"),
    ("aggregate_metrics", "spearman_rho", "double"),
    ("aggregate_metrics", "spearman_p_value", "double"),
)


def file_sequence(files: DataFrame) -> DataFrame:
    """file_id, series_id, seq, prev_id, record_key of every file that belongs to a series."""
    w = Window.partitionBy("series_id").orderBy("written_at", "file_id")
    key = F.create_map(*[F.lit(x) for kv in RECORD_KEYS.items() for x in kv])
    return (
        files.where("series_id is not null and file_id is not null")
        .groupBy("file_id")
        .agg(F.min("series_id").alias("series_id"), F.min("written_at").alias("written_at"), F.min("record_kind").alias("record_kind"))
        .select(
            "file_id",
            "series_id",
            F.row_number().over(w).alias("seq"),
            F.lag("file_id").over(w).alias("prev_id"),
            F.coalesce(key[F.col("record_kind")], F.lit("instance_id")).alias("record_key"),
        )
    )


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def ingest(lines: DataFrame, schema: dict[str, str], keep: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """One typed row per payload: the schema's fields, ``_rescued`` (JSON of unknown fields and of values that don't fit),
    ``_types`` (field -> bit of its JSON type, 0 for null) and ``_corrupt``."""
    src = lines.where("payload is not null and payload <> ''").select(*keep, F.col("payload").alias("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = {c: rescue.fits(t) for c, t in schema.items()}
        for b in batches:
            values: dict[str, list] = {c: [] for c in schema}
            rescued, types, corrupt = [], [], []
            for payload in b.column(len(keep)).to_pylist():
                record = rescue.record_of(payload)
                held, rest = rescue.enforce(record or {}, fit)
                for c, column in values.items():
                    column.append(held.get(c))
                rescued.append(rescue.text_of(rest) if rest else None)
                types.append(None if record is None else [(k, rescue.bit_of(v)) for k, v in record.items()])
                corrupt.append(payload if record is None else None)
            columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in values[c]], rescue.arrow_of(t)) for c, t in schema.items()]
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(rescued, pa.string()), pa.array(types, pa.map_(pa.string(), pa.int32())), pa.array(corrupt, pa.string())], names=[*keep, *schema, "_rescued", "_types", "_corrupt"])

    kept = {f.name: f.dataType.simpleString() for f in src.schema.fields[:-1]}
    return src.mapInArrow(run, _ddl({**kept, **schema, "_rescued": "string", "_types": "map<string,int>", "_corrupt": "string"}))


def file_fields(table: DataFrame) -> DataFrame:
    """file_id, field, types: the fields of each file of an ingested table and the set of their JSON types as bits."""
    return table.select("file_id", F.explode("_types").alias("field", "type")).groupBy("file_id", "field").agg(F.bit_or("type").alias("types"))


def _values(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Of ingested rows with file, record_key and wanted: file, rec, field, value of each wanted field of each record
    (value is '' for null), and a row with a null field for the record itself."""
    typed = list(schema)
    src = rows.select("file", "record_key", "wanted", "_rescued", *typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(4 + i).to_pylist() for i, c in enumerate(typed)}
            at, recs, fields, values = [], [], [], []
            for i, (key, wanted, rescued) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                rest = rescue.record_of(rescued) if rescued else {}
                get = lambda f: columns[f][i] if f in columns and columns[f][i] is not None else rest.get(f)  # noqa: B023,E731
                rec = get(key)
                if rec is None:
                    continue
                rec = rec if isinstance(rec, str) else rescue.text_of(rec)
                at += [i] * (len(wanted) + 1)
                recs += [rec] * (len(wanted) + 1)
                fields += [None, *wanted]
                values += ["", *(rescue.canonical(dict(v) if isinstance(v := get(f), list) and schema.get(f, "").startswith("map") else v) or "" for f in wanted)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(recs, pa.string()), pa.array(fields, pa.string()), pa.array(values, pa.string())], names=["file", "rec", "field", "value"])

    return src.mapInArrow(run, f"file {src.schema['file'].dataType.simpleString()}, rec string, field string, value string")


def _renames(seq: DataFrame, status: DataFrame, table: DataFrame, schema: dict[str, str]) -> DataFrame:
    """file_id, old_field, new_field where all records in both files agree, at least two of them not null."""
    both = (
        status.groupBy("file_id")
        .agg(F.collect_list(F.when(~F.col("now"), F.col("field"))).alias("olds"), F.collect_list(F.when(~F.col("before"), F.col("field"))).alias("news"))
        .where("size(olds) > 0 and size(news) > 0")
        .join(seq.select("file_id", "prev_id", "record_key"), "file_id")
    )

    def side(id_col: str, wanted: str, out: str) -> DataFrame:
        """file_id, rec, out, value of what a file's records of one key agree on."""
        own = both.select(F.col("file_id").alias("file"), F.col(id_col).alias("file_id"), F.col(wanted).alias("wanted"), "record_key")
        each = _values(table.join(own, "file_id"), schema).groupBy("file", "rec", "field").agg(F.min("value").alias("value"), F.max("value").alias("other"))
        return materialise(each.where("value = other").select(F.col("file").alias("file_id"), "rec", F.col("field").alias(out), "value"), "values")

    old, new = side("prev_id", "olds", "old_field"), side("file_id", "news", "new_field")
    common = old.where("old_field is null").join(new.where("new_field is null"), ["file_id", "rec"]).groupBy("file_id").agg(F.count("*").alias("common"))
    agree = old.where("old_field is not null").join(new.where("new_field is not null"), ["file_id", "rec", "value"])
    agree = agree.groupBy("file_id", "old_field", "new_field").agg(F.count("*").alias("agree"), F.count(F.when(F.col("value") != "", 1)).alias("filled"))
    return agree.join(common, "file_id").where("agree = common and filled >= 2").select("file_id", "old_field", "new_field")


def _linked(islands: DataFrame) -> DataFrame:
    """Follow the renames between islands (a field under one name in consecutive files) by pointer jumping.

    Adds root (the name when the field was added) and carry (its last types before the island, not all null)."""
    pred = islands.select(F.col("series_id"), F.col("field").alias("from_field"), (F.col("last_seq") + 1).alias("first_seq"), F.col("first_seq").alias("p_first"), F.col("last_types").alias("p_types"))
    cur = islands.join(pred, ["series_id", "from_field", "first_seq"], "left").select(
        "series_id", "field", "first_seq", F.coalesce("from_field", "field").alias("root"), F.when(F.col("p_first").isNotNull(), F.col("from_field")).alias("up"), F.col("p_first").alias("up_first"), F.col("p_types").alias("carry")
    )
    cur = materialise(cur, "islands")
    while not cur.where("up is not null").isEmpty():
        above = cur.select("series_id", F.col("field").alias("up"), F.col("first_seq").alias("up_first"), F.col("root").alias("u_root"), F.col("up").alias("u_up"), F.col("up_first").alias("u_first"), F.col("carry").alias("u_carry"))
        cur = materialise(
            cur.join(above, ["series_id", "up", "up_first"], "left").select(
                "series_id", "field", "first_seq", F.coalesce("u_root", "root").alias("root"), F.col("u_up").alias("up"), F.col("u_first").alias("up_first"), F.coalesce("carry", "u_carry").alias("carry")
            ),
            "islands",
        )
    return cur


def field_history(files: DataFrame, table: DataFrame, schema: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(changes without retyped, fields of each file with from_field, root and earlier types) of an ingested table."""
    seq = materialise(file_sequence(files), "sequence")
    fields = materialise(file_fields(table), "fields")
    now = seq.join(fields, "file_id").select("file_id", "field", F.lit(True).alias("now"), F.lit(False).alias("before"))
    before = seq.join(fields.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "field", F.lit(False).alias("now"), F.lit(True).alias("before"))
    status = (
        now.unionAll(before)
        .groupBy("file_id", "field")
        .agg(F.max("now").alias("now"), F.max("before").alias("before"))
        .where("now <> before")
        .join(seq.where("prev_id is not null").select("file_id"), "file_id", "left_semi")
    )
    status = materialise(status, "status")
    renamed = materialise(_renames(seq, status, table, schema), "renames")
    removed = status.where("before").join(renamed.withColumnRenamed("old_field", "field"), ["file_id", "field"], "left_anti")
    added = status.where("now").join(renamed.withColumnRenamed("new_field", "field"), ["file_id", "field"], "left_anti")
    changes = (
        renamed.select("file_id", F.lit("renamed").alias("drift"), "old_field", "new_field")
        .unionAll(removed.select("file_id", F.lit("removed"), "field", F.lit("")))
        .unionAll(added.select("file_id", F.lit("added"), F.lit(""), "field"))
    )
    by_field = Window.partitionBy("series_id", "field").orderBy("seq")
    nodes = seq.join(fields, "file_id").withColumn("starts", F.coalesce(F.lag("seq").over(by_field) != F.col("seq") - 1, F.lit(True)))
    nodes = nodes.withColumn("first_seq", F.max(F.when(F.col("starts"), F.col("seq"))).over(by_field.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("series_id", "field", "first_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("earlier", F.last(F.expr("nullif(types, 0)"), ignorenulls=True).over(inside))
    nodes = nodes.join(renamed.select("file_id", F.col("new_field").alias("field"), F.col("old_field").alias("renamed_from")), ["file_id", "field"], "left")
    nodes = materialise(nodes, "nodes")
    islands = nodes.groupBy("series_id", "field", "first_seq").agg(
        F.max("seq").alias("last_seq"), F.max_by(F.expr("nullif(types, 0)"), F.when(F.col("types") > 0, F.col("seq"))).alias("last_types"), F.min("renamed_from").alias("from_field")
    )
    linked = _linked(islands)
    history = nodes.join(linked.select("series_id", "field", "first_seq", "root", "carry"), ["series_id", "field", "first_seq"]).select(
        "file_id",
        "field",
        "types",
        "root",
        F.when(F.col("starts"), F.col("renamed_from")).otherwise(F.col("field")).alias("from_field"),
        F.coalesce("earlier", "carry").alias("earlier"),
    )
    return changes, history


def ingested(lines: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table of all records of either kind, with the columns of both target schemas, and these columns."""
    schema = {**INSTANCE_SCHEMA, **AGGREGATE_SCHEMA}
    return materialise(ingest(lines, schema), "ingested"), schema


def field_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, drift, old_field, new_field: each change of each file against the file before it in its series."""
    changes, history = field_history(files, *ingested(lines))
    retyped = history.where("types > 0 and earlier is not null and types <> earlier and from_field is not null")
    return changes.unionAll(retyped.select("file_id", F.lit("retyped"), F.col("from_field"), "field")).distinct()


def replay(table: DataFrame, columns: dict[str, str], names: DataFrame | None = None) -> DataFrame:
    """Move rescued values into typed columns, old or new ones; what gives no value of the column's type stays rescued.

    names (file_id, field, root): the names under which a field goes in a file; a root's column takes them, too."""
    if names is not None:
        alias = names.where(F.col("root").isin(*columns) & (F.col("root") != F.col("field"))).groupBy("file_id", "root").agg(F.min("field").alias("field"))
        src = table.join(alias.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("root", "field"))).alias("_alias")), "file_id", "left")
    else:
        src = table.withColumn("_alias", F.lit(None).cast("map<string,string>"))
    own = [c for c in table.columns if c not in columns and c != "_rescued"]
    held = [c for c in columns if c in table.columns]
    tail = [c for c in own if c.startswith("_")]
    out = [*[c for c in table.columns if c in held or c in own and c not in tail], *[c for c in columns if c not in held], "_rescued", *tail]
    src = src.select(*own, *held, "_rescued", "_alias")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = {c: rescue.fits(t) for c, t in columns.items()}
        for b in batches:
            of = dict(zip(b.schema.names, b.columns, strict=True))
            values = {c: of[c].to_pylist() if c in held else [None] * b.num_rows for c in columns}
            rescued = of["_rescued"].to_pylist()
            for i, alias in enumerate(of["_alias"].to_pylist()):
                rest = rescue.record_of(rescued[i]) if rescued[i] else None
                if not rest:
                    continue
                names_of = dict(alias or ())
                for c, t in columns.items():
                    key = c if c in rest else names_of.get(c)
                    if values[c][i] is None and key in rest:
                        x = rest[key]
                        values[c][i] = None if x is None else rescue.mend(x, t, fit[c])
                        if x is None or values[c][i] is not None:
                            del rest[key]
                rescued[i] = rescue.text_of(rest) if rest else None
            of |= {c: pa.array([list(x.items()) if isinstance(x, dict) else x for x in values[c]], rescue.arrow_of(t)) for c, t in columns.items()}
            of["_rescued"] = pa.array(rescued, pa.string())
            yield pa.RecordBatch.from_arrays([of[c] for c in out], names=out)

    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields} | columns
    return src.mapInArrow(run, _ddl({c: kinds[c] for c in out}))


def consistent_table(files: DataFrame, lines: DataFrame, kind: str, approved: tuple[tuple[str, str, str], ...] = APPROVED) -> DataFrame:
    """All records of one record_kind in one typed table: the target schema and the approved fields of the kind, renamed
    fields under the name they had when added."""
    table, schema = ingested(lines)
    _, history = field_history(files, table, schema)
    own = files.where(F.col("record_kind") == kind).select("file_id").distinct()
    target = INSTANCE_SCHEMA if kind == "instance_metrics" else AGGREGATE_SCHEMA
    # a column of the other kind's schema is an unknown field here
    other = F.to_json(F.struct(*[c for c in schema if c not in target]))
    joined = F.when(F.col("_rescued").isNull(), other).otherwise(F.concat(F.expr("substring(_rescued, 1, length(_rescued) - 1)"), F.lit(","), F.expr("substring(_other, 2)")))
    rows = table.join(own, "file_id", "left_semi").withColumn("_other", other)
    rows = rows.withColumn("_rescued", F.when(F.col("_other") == "{}", F.col("_rescued")).otherwise(joined)).select("file_id", "line_no", *target, "_rescued", "_corrupt")
    return replay(rows, {**target, **{f: t for k, f, t in approved if k == kind}}, history.select("file_id", "field", "root").distinct())
