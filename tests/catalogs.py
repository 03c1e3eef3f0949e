"""Small catalogs of our own for the tests."""

from __future__ import annotations

import json
from pathlib import Path


def write(folder: Path, columns, values=None, rules=None, value_file: str = "unique_values.json") -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "column_descriptions.json").write_text(json.dumps(columns, ensure_ascii=False), encoding="utf-8")
    if values is not None:
        (folder / value_file).write_text(json.dumps(values, ensure_ascii=False), encoding="utf-8")
    if rules is not None:
        (folder / "rules.json").write_text(json.dumps(rules, ensure_ascii=False), encoding="utf-8")
    return str(folder)


def column(table, name, description="", **more):
    return {"table_name": table, "column_name": name, "description": description} | more


def group(table, name, *values, **more):
    return {"table_name": table, "column_name": name, "values": [v if isinstance(v, dict) else {"raw_value": v, "value_gloss": f"{v} it is"} for v in values]} | more


SHOP = (
    [
        column("orders", "state", "Where an order stands, such as blocked or shipped.", aliases=["order status"]),
        column("orders", "region", "Region of the buyer. Europe or elsewhere.", raw_column_name="rgn", data_type="text"),
        column("clients", "state", "Whether a client is active."),
        column("clients", "plan", "Commercial plan of the client"),
    ],
    [
        group("orders", "state", {"raw_value": "blocked_by_legal", "value_gloss": "Legal review stops the order", "synonyms": ["legal hold"], "business_tags": ["risk"]}, "shipped"),
        group("orders", "region", {"raw_value": "eu_only", "value_gloss": "Data must stay in Europe."}, "world"),
        group("clients", "state", "active", "dormant"),
    ],
    [
        {"rule_id": "r1", "description": "Blocked orders need approval. Always.", "candidate_columns": ["orders.state", "clients::state"], "trigger_terms": ["blocked", "approval"], "priority": "2"},
    ],
)
