"""Schemas of the catalog tables, and what a loaded catalog is made of."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_SCOPE = "resource_owner string, resource_namespace string"
COLUMNS = f"{_SCOPE}, pos long, table_name string, column_name string, raw_column_name string, description string, aliases array<string>, data_type string"
VALUES = f"{_SCOPE}, pos long, table_name string, column_name string, raw_value string, value_gloss string, synonyms array<string>, business_tags array<string>"
RULES = (
    f"{_SCOPE}, pos long, rule_id string, description string, candidate_columns array<struct<table_name: string, column_name: string>>, "
    "trigger_terms array<string>, intent string, priority int, rule_text string"
)
ISSUES = "phase int, record_pos long, stage int, item_pos long, seq int, issue_type string, entity_key string, action string, details string"


@dataclass
class Catalog:
    """The canonical catalog of one scope: three tables, the issues found, and where it came from."""

    resource_owner: str
    resource_namespace: str
    columns: DataFrame
    values: DataFrame
    rules: DataFrame
    issues: DataFrame
    source_files: dict[str, str | None] = field(default_factory=dict)
    source_counts: dict[str, int] = field(default_factory=dict)

    def ordered_issues(self) -> DataFrame:
        return self.issues.orderBy("phase", "record_pos", "stage", "item_pos", "seq")


#: Issues that keep a catalog from being loaded. Fixed values.
FATAL = frozenset({
    "invalid_columns_payload",
    "invalid_value_groups_payload",
    "invalid_rules_payload",
    "missing_column_table_name",
    "invalid_identifier_separator",
    "duplicate_column_identity",
    "missing_value_group_table_name",
    "duplicate_value_key",
    "duplicate_rule_id",
})
