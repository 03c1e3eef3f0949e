"""Catalog files: drift, issues, and what is kept."""

import pytest

from lodestar.sources.catalog_json import get_adapter
from lodestar.sources.schemas import FATAL
from tests.catalogs import column, group, write


def load(spark, folder):
    c = get_adapter(" Demo_JSON ").load(spark, folder, "o", "n")
    return c, [(r.issue_type, r.entity_key, r.action) for r in c.ordered_issues().collect()]


def kinds(issues):
    return [i[0] for i in issues]


@pytest.fixture(autouse=True)
def interpreted(spark):
    from lodestar.session import interpreted

    with interpreted(spark):
        yield


def test_duplicates_and_candidates(spark, tmp_path):
    folder = write(
        tmp_path,
        [column("t", "a", "first"), column("t", "b", "x"), column("t", "a", "second")],
        [group("t", "a", "v", "v")],
        [
            {"rule_id": "r", "description": "d", "candidate_columns": ["a", "t.zzz"]},
            {"rule_id": "r", "description": "d", "candidate_columns": ["bare", "t.nope", "t.a", "t::b", "t.a"]},
            {"rule_id": "r", "description": "again", "candidate_columns": ["t.a"]},
        ],
    )
    c, issues = load(spark, folder)
    assert kinds(issues) == [
        "duplicate_column_identity", "duplicate_value_key", "unqualified_rule_candidate_column", "unknown_rule_candidate_column", "rule_without_valid_candidate_columns",
        "unqualified_rule_candidate_column", "unknown_rule_candidate_column", "duplicate_rule_id",
    ]
    assert [r.description for r in c.columns.orderBy("pos").collect()] == ["first", "x"]
    assert [[tuple(x) for x in r.candidate_columns] for r in c.rules.collect()] == [[("t", "a"), ("t", "b")]]


def test_names_keys_and_separators(spark, tmp_path):
    folder = write(
        tmp_path,
        [
            {"column_key": "t::a", "description": "d"}, {"table": "u", "column_key": "x::b"}, {"table_name": None, "table": "skipped", "source_table": "w", "column_name": "c"},
            {"column_name": "d"}, {"table_name": "t"}, column("bad::t", "e"), {"table_name": "t", "column_name": 5, "column_key": "f"}, 7, "x",
        ],
        [group(None, "a", "v"), group(None, "nowhere", "v"), group("t", "zzz", 1, 2), {"table_name": "t", "values": []}],
    )
    c, issues = load(spark, folder)
    assert [(r.table_name, r.column_name) for r in c.columns.orderBy("pos").collect()] == [("t", "a"), ("u", "b"), ("w", "c"), ("t", "f")]
    assert kinds(issues) == [
        "invalid_column_record", "invalid_column_record", "missing_column_table_name", "missing_column_name", "invalid_identifier_separator", "invalid_field_type",
        "inferred_value_group_table_name", "missing_value_group_table_name", "missing_value_column", "missing_value_group_column_name",
    ]
    assert c.source_counts == {"columns": 7, "value_groups": 4, "values": 4, "rules": 0}


def test_drift_of_types(spark, tmp_path):
    folder = write(
        tmp_path,
        {"columns": [column("t", "a", 12, aliases="one", data_type=["x"]), column("t", "b", " padded ", aliases=[" p ", "", 3, None, "p"])]},
        {"value_groups": [group("t", "a", {"raw_value": 1, "value_gloss": "", "value_description": "fallback"}, {"raw_value": True, "synonyms": {"a": 1}}, {"raw_value": 1.5}, {"raw_value": ""}, {"raw_value": None}, "text" and 5),
                          {"table_name": "t", "column_name": "b", "values": {"no": 1}}, {"table_name": "t", "column_name": "b", "values": None}, {"table_name": "t", "column_name": "b"}]},
        {"rules": [
            {"rule_id": "r", "candidate_columns": "t.a", "trigger_terms": "x", "priority": "high"}, {"rule_id": "s", "candidate_columns": 123, "priority": 2.7},
            {"rule_id": "u", "candidate_columns": [{"table_name": "t", "column_name": "b"}, {"table_name": "t"}, 5, None], "priority": " +7 "}, {"rule_id": " "}, {"rule_id": "v", "candidate_columns": 0, "priority": True}, [],
        ]},
    )
    c, issues = load(spark, folder)
    assert kinds(issues) == [
        "wrapped_columns_payload", "wrapped_value_groups_payload", "wrapped_rules_payload", "invalid_rule_record",
        "invalid_field_type", "coerced_scalar_list_field", "invalid_field_type", "invalid_list_field_item", "invalid_list_field_item",
        "invalid_list_field_type", "missing_raw_value", "missing_raw_value", "invalid_values_payload", "invalid_values_payload",
        "coerced_rule_candidate_columns", "coerced_scalar_list_field", "invalid_rule_priority", "invalid_rule_candidate_columns_payload",
        "malformed_rule_candidate_column", "malformed_rule_candidate_column", "malformed_rule_candidate_column", "missing_rule_id",
    ]
    columns = {r.column_name: r for r in c.columns.collect()}
    assert (columns["a"].description, columns["a"].aliases, columns["b"].description, columns["b"].aliases) == ("", ["one"], "padded", ["p"])
    assert [(r.raw_value, r.value_gloss) for r in c.values.orderBy("pos").collect()] == [("1", "fallback"), ("True", ""), ("1.5", ""), ("5", "5 it is")]
    assert {r.rule_id: r.priority for r in c.rules.collect()} == {"r": 0, "s": 2, "u": 7, "v": 1}


def test_payloads_of_the_wrong_kind(spark, tmp_path):
    c, issues = load(spark, write(tmp_path, {"bad": []}, 5, {"bad": []}))
    assert issues == [(f"invalid_{n}_payload", n, "ignored_payload") for n in ("columns", "value_groups", "rules")]
    assert c.columns.count() == 0 and {i[0] for i in issues} <= FATAL


def test_legacy_values_and_missing_files(spark, tmp_path):
    c, issues = load(spark, write(tmp_path / "a", [column("t", "a")], [{"column_key": "a", "values": [{"raw_value": "v"}]}], value_file="value_catalog.json"))
    assert kinds(issues) == ["inferred_value_group_table_name"] and c.source_files == {"columns": "column_descriptions.json", "values": "value_catalog.json", "rules": None}
    assert [(r.table_name, r.raw_value) for r in c.values.collect()] == [("t", "v")]
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        get_adapter("other")
