"""Catalog files (JSON of drifting shape) to canonical tables, with an issue for whatever was bent or dropped.

Files are read whole and parsed as VARIANT: a schema inferred by a JSON reader
would hide the type drift that has to be reported. Each check is an expression
that yields an issue or null; a record's issues are an array in the order in
which its checks apply.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import SPACE, dedupe_terms, label, let
from lodestar.operators.keys import keep_first, mark_duplicates, nth, resolve_identity, split_reference, unique_match
from lodestar.sources.shared import stored
from lodestar.session import configured
from lodestar.sources.schemas import COLUMNS, ISSUES, RULES, VALUES, Catalog

ISSUE = "struct<issue_type: string, entity_key: string, action: string, details: string>"
_REF = ["table_name", "column_name"]


class CatalogAdapter(Protocol):
    """Turns a source into the canonical catalog of one scope."""

    def load(self, spark: SparkSession, root: str, owner: str, namespace: str) -> Catalog: ...


# --- values of a VARIANT, seen as the types of a JSON parser in Python ----------------------


def type_name(v: Column) -> Column:
    """Let-bound, as most helpers here: records nest them, and an argument named twice would be copied at each level."""
    return let(
        F.coalesce(F.schema_of_variant(v), F.lit("VOID")),
        lambda kind: F.when(kind == "VOID", "NoneType")
        .when(kind == "STRING", "str")
        .when(kind == "BIGINT", "int")
        .when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .otherwise("float"),
    )


def member(v: Column, name: str) -> Column:
    """A member of an object: SQL null if it is missing, a VARIANT null if it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _missing(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def python_text(v: Column) -> Column:
    """The text that Python's ``str`` gives a JSON scalar; objects and arrays as JSON."""
    kind = type_name(v)
    return F.when(kind == "bool", F.initcap(as_string(v))).when(kind.isin("dict", "list"), F.to_json(v)).otherwise(as_string(v))


def truthy(v: Column) -> Column:
    def test(x: Column, kind: Column) -> Column:
        return (
            F.when(kind == "NoneType", False)
            .when(kind == "str", as_string(x) != "")
            .when(kind.isin("int", "float"), F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True)))
            .when(kind == "bool", F.try_variant_get(x, "$", "boolean"))
            .otherwise(~F.to_json(x).isin("{}", "[]"))
        )

    return let(v, lambda x: let(type_name(x), lambda kind: test(x, kind)))


def first_truthy(a: Column, b: Column) -> Column:
    return F.when(truthy(a), a).otherwise(b)


# --- issues ---------------------------------------------------------------------------------


def issue(kind: str | Column, entity: Column, action: str, **details: Column) -> Column:
    body = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("issue_type"), entity.cast("string").alias("entity_key"), F.lit(action).alias("action"), body.alias("details")
    ).cast(ISSUE)


def _when(test: Column, found: Column) -> Column:
    """An array of one issue, or none."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _all(*parts: Column) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def string_field(v: Column, name: str, entity: Column) -> tuple[Column, Column]:
    """(stripped text or null, issues)."""

    def parse(x: Column, kind: Column) -> Column:
        wrong = issue("invalid_field_type", entity, "ignored_field", field_name=F.lit(name), actual_type=kind)
        return F.struct(F.when(kind == "str", F.nullif(strip(as_string(x)), F.lit(""))).alias("value"), _when(~kind.isin("str", "NoneType"), wrong).alias("issues"))

    both = let(v, lambda x: let(type_name(x), lambda kind: parse(x, kind)))
    return both["value"], both["issues"]


def list_field(v: Column, name: str, entity: Column) -> tuple[Column, Column]:
    """(distinct stripped texts, issues)."""
    field, none = F.lit(name), F.array().cast(f"array<{ISSUE}>")

    def parse(x: Column, kind: Column) -> Column:
        items = F.transform(_items(x), lambda i, n: F.struct(i.alias("v"), type_name(i).alias("kind"), n.alias("n")))
        texts = F.filter(F.transform(F.filter(items, lambda i: i["kind"] == "str"), lambda i: strip(as_string(i["v"]))), lambda t: t != "")
        single = F.filter(F.array(strip(as_string(x))), lambda t: t != "")
        bad = F.transform(
            F.filter(items, lambda i: i["kind"] != "str"), lambda i: issue("invalid_list_field_item", entity, "dropped_list_item", field_name=field, index=i["n"], actual_type=i["kind"])
        )
        found = (
            F.when(kind == "list", bad)
            .when(kind == "str", F.array(issue("coerced_scalar_list_field", entity, "coerced_scalar_to_singleton_list", field_name=field)))
            .when(kind == "NoneType", none)
            .otherwise(F.array(issue("invalid_list_field_type", entity, "dropped_field", field_name=field, actual_type=kind)))
        )
        value = F.when(kind == "str", single).when(kind == "list", dedupe_terms(texts)).otherwise(F.array().cast("array<string>"))
        return F.struct(value.alias("value"), found.alias("issues"))

    both = let(v, lambda x: let(type_name(x), lambda kind: parse(x, kind)))
    return both["value"], both["issues"]


# --- files ----------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row, one VARIANT column ``doc``; of repeated keys the last counts."""
    conf = {"spark.sql.variant.allowDuplicateKeys": "true"}
    with configured(spark, conf):  # the analysed expression keeps the setting
        doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
        doc.schema  # noqa: B018
    return doc


def records(doc: DataFrame, name: str, wrappers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(pos, rec) of the objects in a payload, and the payload's issues (stage, item_pos, seq and the issue)."""
    v = F.col("doc")
    wrapped = F.lit(None).cast("string")
    for key in reversed(wrappers):
        wrapped = F.when(type_name(member(v, key)) == "list", F.lit(key)).otherwise(wrapped)
    payload = F.lit(None).cast("variant")
    for key in wrappers:
        payload = F.when(wrapped == key, member(v, key)).otherwise(payload)
    opened = doc.withColumn("wrapper", F.when(type_name(v) == "dict", wrapped)).withColumn("payload", F.when(type_name(v) == "dict", payload).otherwise(v))
    is_list = type_name(F.col("payload")) == "list"
    entity = F.lit(name)
    top = opened.select(
        F.explode(
            _all(
                _when(F.col("wrapper").isNotNull(), issue(f"wrapped_{name}_payload", entity, "accepted_wrapped_payload", wrapper_key=F.col("wrapper"))),
                _when(~is_list, issue(f"invalid_{name}_payload", entity, "ignored_payload", actual_type=type_name(v))),
            )
        ).alias("i")
    ).select(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("item_pos"), "i")
    rows = opened.where(is_list).select(F.posexplode(_items(F.col("payload"))).alias("pos", "rec")).withColumn("pos", F.col("pos").cast("long"))
    wrong = rows.where(type_name(F.col("rec")) != "dict").select(
        F.lit(1).alias("stage"),
        F.col("pos").alias("item_pos"),
        issue(f"invalid_{name.rstrip('s')}_record", F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]")), "skipped_record", actual_type=type_name(F.col("rec"))).alias("i"),
    )
    return rows.where(type_name(F.col("rec")) == "dict"), top.unionByName(wrong)


def _issue_rows(df: DataFrame, phase: int, record: Column, stage: Column, item: Column, issues: Column) -> DataFrame:
    rows = df.select(F.lit(phase).alias("phase"), record.cast("long").alias("record_pos"), stage.cast("int").alias("stage"), item.cast("long").alias("item_pos"), F.posexplode(issues).alias("seq", "i"))
    return rows.select("phase", "record_pos", "stage", "item_pos", "seq", "i.issue_type", "i.entity_key", "i.action", "i.details")


def _identity(rec: Column, entity: str) -> tuple[Column, Column, Column]:
    """(table, column, issues) of a record by its explicit names or its combined key."""
    named = F.coalesce(member(rec, "table_name"), member(rec, "table"))
    source = F.when(_missing(named), member(rec, "source_table")).otherwise(named)
    who = F.lit(entity)
    table, i1 = string_field(source, "table_name", who)
    key, i2 = string_field(member(rec, "column_key"), "column_key", who)
    column, i3 = string_field(member(rec, "column_name"), "column_name", who)
    table_, column_ = resolve_identity(table, column, key)
    return F.nullif(table_, F.lit("")), F.nullif(column_, F.lit("")), _all(i1, i2, i3)


def _reserved(table: Column, column: Column) -> Column:
    return F.contains(table, F.lit("::")) | F.contains(column, F.lit("::"))


def parse_columns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted columns by pos, issues)."""
    table, column, base = _identity(F.col("rec"), "column_definition")
    at = rows.select("pos", "rec", table.alias("table_name"), column.alias("column_name"), base.alias("base"))
    t, c = F.col("table_name"), F.col("column_name")
    at = at.withColumn(
        "fault", F.when(c.isNull(), "missing_column_name").when(t.isNull(), "missing_column_table_name").when(_reserved(t, c), "invalid_identifier_separator")
    )
    again = nth([*_REF, F.col("fault").isNull()], "pos") > 1
    at = at.withColumn("fault", F.when(F.col("fault").isNull() & again, "duplicate_column_identity").otherwise(F.col("fault")))
    me, rec = label(t, c), F.col("rec")
    raw, i1 = string_field(member(rec, "raw_column_name"), "raw_column_name", me)
    text, i2 = string_field(member(rec, "description"), "description", me)
    aliases, i3 = list_field(member(rec, "aliases"), "aliases", me)
    kind, i4 = string_field(member(rec, "data_type"), "data_type", me)
    fault = F.col("fault")
    entity = F.when(fault == "missing_column_name", "column_definition").when(fault == "missing_column_table_name", c).otherwise(me)
    stop = F.struct(
        fault.alias("issue_type"), entity.alias("entity_key"), F.when(fault == "duplicate_column_identity", "skipped_duplicate_column").otherwise("skipped_column").alias("action"), F.lit("{}").alias("details")
    ).cast(ISSUE)
    issues = F.concat(F.col("base"), F.when(fault.isNull(), _all(i1, i2, i3, i4)).otherwise(F.array(stop)))
    accepted = at.where(fault.isNull()).select(
        "pos", *_REF, raw.alias("raw_column_name"), F.coalesce(text, F.lit("")).alias("description"), aliases.alias("aliases"), kind.alias("data_type")
    )
    return accepted, _issue_rows(at, 1, F.col("pos"), F.lit(0), F.lit(0), issues)


def infer_tables(columns: DataFrame) -> DataFrame:
    """column_name, inferred: the table of each column name that only one table has."""
    return unique_match(columns, "column_name", "table_name").withColumnRenamed("table_name", "inferred")


def parse_values(groups: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted values by pos, issues)."""
    table, column, base = _identity(F.col("rec"), "value_definition")
    at = groups.select("pos", "rec", table.alias("table_name"), column.alias("column_name"), base.alias("base"))
    at = at.join(infer_tables(columns), "column_name", "left")
    guessed = F.col("table_name").isNull() & F.col("column_name").isNotNull() & F.col("inferred").isNotNull()
    at = at.withColumn("guessed", guessed).withColumn("table_name", F.coalesce("table_name", F.when(F.col("column_name").isNotNull(), F.col("inferred"))))
    at = at.join(columns.select(*_REF, F.lit(True).alias("known")), _REF, "left")
    t, c, rec = F.col("table_name"), F.col("column_name"), F.col("rec")
    fault = (
        F.when(c.isNull(), "missing_value_group_column_name")
        .when(t.isNull(), "missing_value_group_table_name")
        .when(_reserved(t, c), "invalid_identifier_separator")
        .when(F.col("known").isNull(), "missing_value_column")
    )
    at = at.withColumn("fault", fault)
    me, fault, given = label(t, c), F.col("fault"), member(F.col("rec"), "values")
    n_values = F.when(type_name(given) == "list", F.size(_items(given))).otherwise(0)
    entity = F.when(fault == "missing_value_group_column_name", "value_definition").when(fault == "missing_value_group_table_name", c).otherwise(me)
    details = F.when(fault == "missing_value_column", F.to_json(F.struct(n_values.alias("value_count")))).otherwise(F.lit("{}"))
    stop = F.struct(fault.alias("issue_type"), entity.alias("entity_key"), F.lit("skipped_value_group").alias("action"), details.alias("details")).cast(ISSUE)
    # a group without values has an empty list; an explicit null is a payload of the wrong type
    payload_ok = given.isNull() | (type_name(given) == "list")
    issues = _all(
        F.col("base"),
        _when(F.col("guessed"), issue("inferred_value_group_table_name", c, "accepted_legacy_value_group", table_name=F.col("inferred"))),
        _when(fault.isNotNull(), stop),
        _when(fault.isNull() & ~payload_ok, issue("invalid_values_payload", F.lit("values"), "ignored_payload", actual_type=type_name(given))),
    )
    found = _issue_rows(at, 2, F.col("pos"), F.lit(0), F.lit(0), issues)
    items = at.where(fault.isNull() & payload_ok).select(F.col("pos").alias("group_pos"), *_REF, F.posexplode(_items(given)).alias("item_pos", "rec"))
    wrong = items.where(type_name(rec) != "dict")
    bad = issue("invalid_value_record", F.concat(F.lit("values["), F.col("item_pos").cast("string"), F.lit("]")), "skipped_record", actual_type=type_name(rec))
    found = found.unionByName(_issue_rows(wrong, 2, F.col("group_pos"), F.lit(1), F.col("item_pos"), F.array(bad)))
    good = items.where(type_name(rec) == "dict").withColumn("raw", member(rec, "raw_value"))
    good = good.withColumn("raw_value", F.when(~_missing(F.col("raw")), python_text(F.col("raw")))).withColumn("raw_value", F.nullif("raw_value", F.lit("")))
    good = good.withColumn("again", F.col("raw_value").isNotNull() & (nth([*_REF, "raw_value"], "group_pos", "item_pos") > 1))
    gloss, i1 = string_field(first_truthy(member(rec, "value_gloss"), member(rec, "value_description")), "value_gloss", me)
    synonyms, i2 = list_field(member(rec, "synonyms"), "synonyms", me)
    tags, i3 = list_field(member(rec, "business_tags"), "business_tags", me)
    lost, again = F.col("raw_value").isNull(), F.col("again")
    issues = (
        F.when(lost, F.array(issue("missing_raw_value", me, "skipped_value")))
        .when(again, F.array(issue("duplicate_value_key", F.concat(me, F.lit("::"), F.col("raw_value")), "skipped_duplicate_value")))
        .otherwise(_all(i1, i2, i3))
    )
    found = found.unionByName(_issue_rows(good, 2, F.col("group_pos"), F.lit(2), F.col("item_pos"), issues))
    order = (F.col("group_pos") * (1 << 32) + F.col("item_pos")).alias("pos")  # places of groups and of values in them fit in 31 bits
    accepted = good.where(~lost & ~again).select(order, *_REF, "raw_value", F.coalesce(gloss, F.lit("")).alias("value_gloss"), synonyms.alias("synonyms"), tags.alias("business_tags"))
    return accepted, found


def priority_of(v: Column) -> tuple[Column, Column]:
    """(whole number, whether the value was refused)."""
    kind = type_name(v)
    digits = F.replace(strip(as_string(v)), F.lit("_"), F.lit(""))
    number = (
        F.when(kind == "NoneType", F.lit(0))
        .when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when(kind.isin("int", "float"), F.try_variant_get(v, "$", "double").cast("int"))
        .when((kind == "str") & strip(as_string(v)).rlike(r"^[+-]?\d+(_\d+)*$"), digits.try_cast("int"))
    )
    return F.coalesce(number, F.lit(0)), number.isNull()


def parse_rules(rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rules by pos, issues)."""
    rec = F.col("rec")
    rule_id, base = string_field(member(rec, "rule_id"), "rule_id", F.lit("rule_definition"))
    at = rows.select("pos", "rec", rule_id.alias("rule_id"), base.alias("base"), member(rec, "candidate_columns").alias("given"))
    given, me = F.col("given"), F.col("rule_id")
    kind = F.when(truthy(given), type_name(given)).otherwise("list")
    listed = F.when(~truthy(given), F.array().cast("array<variant>")).when(kind == "list", _items(given)).when(kind.isin("str", "dict"), F.array(given)).otherwise(F.array().cast("array<variant>"))
    at = at.withColumn("kind", kind).withColumn("listed", listed)
    # candidates: the first of each text, parsed, looked up among the known columns
    each = at.where(me.isNotNull()).select("pos", "rule_id", F.posexplode("listed").alias("k", "v"))
    marker = F.when(type_name(F.col("v")) == "dict", F.to_json("v")).otherwise(F.coalesce(python_text(F.col("v")), F.lit("None")))
    each = keep_first(each.withColumn("marker", marker), ["pos", "marker"], "k")
    v, text, vk = F.col("v"), as_string(F.col("v")), type_name(F.col("v"))
    table, i1 = string_field(member(v, "table_name"), "table_name", me)
    column, i2 = string_field(member(v, "column_name"), "column_name", me)
    named_table, named_column = split_reference(text)
    each = each.withColumn("table_name", F.when(vk == "dict", table).when(vk == "str", named_table)).withColumn("column_name", F.when(vk == "dict", column).when(vk == "str", named_column)).withColumn("vk", vk)
    each = each.join(columns.select(*_REF, F.lit(True).alias("known")), _REF, "left")
    named = F.col("table_name").isNotNull() & F.col("column_name").isNotNull()
    shown = F.when(F.col("vk") == "str", text).otherwise(F.to_json("v"))
    found = (
        F.when(named & F.col("known").isNotNull(), F.array().cast(f"array<{ISSUE}>"))
        .when(named, F.array(issue("unknown_rule_candidate_column", me, "dropped_candidate_column", column_name=shown)))
        .when(F.col("vk") == "str", F.array(issue("unqualified_rule_candidate_column", me, "dropped_candidate_column", column_name=shown)))
        .when(F.col("vk") == "dict", F.array(issue("malformed_rule_candidate_column", me, "dropped_candidate_column", candidate_column=shown)))
        .otherwise(F.array(issue("malformed_rule_candidate_column", me, "dropped_candidate_column", candidate_column=shown, actual_type=F.col("vk"))))
    )
    field_issues = F.when(F.col("vk") == "dict", _all(i1, i2)).otherwise(F.array().cast(f"array<{ISSUE}>"))
    each = each.withColumn("issues", F.concat(field_issues, found))
    refs = F.when(F.col("known").isNotNull() & named, F.struct("k", *_REF))
    by_rule = each.groupBy("pos").agg(
        F.count("*").alias("n_candidates"),
        F.array_sort(F.collect_list(refs)).alias("refs"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "issues"))), lambda x: x["issues"])).alias("candidate_issues"),
    )
    at = at.join(by_rule, "pos", "left")
    refs = F.coalesce(F.transform("refs", lambda r: F.struct(r["table_name"].alias("table_name"), r["column_name"].alias("column_name"))), F.array().cast("array<struct<table_name: string, column_name: string>>"))
    dead = (F.coalesce("n_candidates", F.lit(0)) > 0) & (F.size(refs) == 0)
    at = at.withColumn("candidate_columns", refs).withColumn("dead", dead)
    # an id is taken by the first rule that survives: earlier ones that were skipped don't hold it
    at = mark_duplicates(at, "rule_id", "pos", F.col("dead"), "later").withColumn("again", me.isNotNull() & F.col("later"))
    text, i1 = string_field(first_truthy(member(rec, "text_semantic"), member(rec, "description")), "description", me)
    triggers, i2 = list_field(member(rec, "trigger_terms"), "trigger_terms", me)
    intent, i3 = string_field(member(rec, "intent"), "intent", me)
    number, refused = priority_of(member(rec, "priority"))
    i4 = _when(refused, issue("invalid_rule_priority", me, "defaulted_priority", actual_type=type_name(member(rec, "priority"))))
    body, i5 = string_field(member(rec, "rule_text"), "rule_text", me)
    none = F.array().cast(f"array<{ISSUE}>")
    candidates = _all(
        _when(truthy(given) & F.col("kind").isin("str", "dict"), issue("coerced_rule_candidate_columns", me, "coerced_scalar_to_singleton_list")),
        _when(~F.col("kind").isin("str", "dict", "list"), issue("invalid_rule_candidate_columns_payload", me, "dropped_candidate_columns", actual_type=F.col("kind"))),
        F.coalesce("candidate_issues", none),
    )
    issues = F.concat(
        F.col("base"),
        F.when(me.isNull(), F.array(issue("missing_rule_id", F.lit("rule_definition"), "skipped_rule")))
        .when(F.col("again"), F.array(issue("duplicate_rule_id", me, "skipped_duplicate_rule")))
        .when(F.col("dead"), F.concat(candidates, F.array(issue("rule_without_valid_candidate_columns", me, "skipped_rule"))))
        .otherwise(F.concat(candidates, _all(i1, i2, i3, i4, i5))),
    )
    accepted = at.where(me.isNotNull() & ~F.col("again") & ~F.col("dead")).select(
        "pos", "rule_id", F.coalesce(text, F.lit("")).alias("description"), "candidate_columns", triggers.alias("trigger_terms"), intent.alias("intent"), number.alias("priority"), body.alias("rule_text")
    )
    return accepted, _issue_rows(at, 3, F.col("pos"), F.lit(0), F.lit(0), issues)


class JsonFolderAdapter:
    """A folder with column_descriptions.json and, optionally, unique_values.json (or value_catalog.json) and rules.json."""

    def load(self, spark: SparkSession, root: str, owner: str, namespace: str) -> Catalog:
        path = lambda name: f"{root.rstrip('/')}/{name}"
        if not _exists(spark, path("column_descriptions.json")):
            raise FileNotFoundError(f"column descriptions are missing: {path('column_descriptions.json')}")
        value_file = next((n for n in ("unique_values.json", "value_catalog.json") if _exists(spark, path(n))), None)
        rule_file = "rules.json" if _exists(spark, path("rules.json")) else None
        nothing = spark.range(1).select(F.parse_json(F.lit("[]")).alias("doc"))
        read = lambda name: read_document(spark, path(name)) if name else nothing
        raw_columns, issues_1 = records(read("column_descriptions.json"), "columns", ("columns",))
        raw_groups, issues_2 = records(read(value_file), "value_groups", ("value_groups", "values"))
        raw_rules, issues_3 = records(read(rule_file), "rules", ("rules",))
        columns, c_issues = parse_columns(raw_columns)
        columns = stored(columns, "columns")
        values, v_issues = parse_values(raw_groups, columns)
        rules, r_issues = parse_rules(raw_rules, columns)
        payload = [
            _issue_rows(df, 0, F.lit(n), F.col("stage"), F.col("item_pos"), F.array("i")) for n, df in enumerate((issues_1, issues_2, issues_3))
        ]
        issues = reduce(DataFrame.unionByName, [*payload, c_issues, v_issues, r_issues])
        listed = F.coalesce(F.size(F.when(type_name(member(F.col("rec"), "values")) == "list", _items(member(F.col("rec"), "values")))), F.lit(0))
        listed = F.when(type_name(member(F.col("rec"), "values")) == "list", listed).otherwise(0)
        counts = raw_groups.agg(F.count("*").alias("g"), F.coalesce(F.sum(listed), F.lit(0)).alias("v")).first()
        scoped = lambda df, ddl: conform(df.withColumn("resource_owner", F.lit(owner)).withColumn("resource_namespace", F.lit(namespace)), ddl)
        return Catalog(
            owner,
            namespace,
            scoped(columns, COLUMNS),
            scoped(values, VALUES),
            scoped(rules, RULES),
            conform(issues, ISSUES),
            {"columns": "column_descriptions.json", "values": value_file, "rules": rule_file},
            {"columns": raw_columns.count(), "value_groups": counts.g, "values": counts.v, "rules": raw_rules.count()},
        )


def conform(df: DataFrame, ddl: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(ddl)])


ADAPTERS: dict[str, Callable[[], CatalogAdapter]] = {"demo_json": JsonFolderAdapter, "demo": JsonFolderAdapter}


def register_adapter(name: str, factory: Callable[[], CatalogAdapter]) -> None:
    ADAPTERS[name.strip().lower()] = factory


def get_adapter(name: str) -> CatalogAdapter:
    try:
        return ADAPTERS[name.strip().lower()]()
    except KeyError:
        raise ValueError(f"no source adapter is called {name!r}") from None
