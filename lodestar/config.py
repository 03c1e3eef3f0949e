"""Settings: defaults, overridden by the environment, then by the session (``lodestar.<name>``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    store: str = "lodestar-store"
    resource_owner: str = "demo"
    resource_namespace: str = "default"
    value_cardinality_limit: int = 25
    data_dir: str = "data"
    source_adapter: str = "demo_json"
    hybrid_search_limit: int = 24
    top_candidate_columns: int = 5
    weight_column_definition: float = 1.2
    weight_value_definition: float = 1.0
    weight_rule: float = 0.6
    #: Cells of the vector index that a question is sent to; 0: no index, every vector of the scope is compared.
    vector_probes: int = 0
    log_level: str = "INFO"
    log_dir: str = "logs"

    @property
    def chunk_type_weights(self) -> dict[str, float]:
        return {"column_definition": self.weight_column_definition, "value_definition": self.weight_value_definition, "rule": self.weight_rule}


#: Environment variables of each setting, the first that is set counts.
VARIABLES = {
    "store": ("LODESTAR_STORE",),
    "resource_owner": ("RESOURCE_OWNER",),
    "resource_namespace": ("RESOURCE_NAMESPACE", "CATALOG_NAMESPACE"),
    "value_cardinality_limit": ("VALUE_CARDINALITY_LIMIT",),
    "data_dir": ("DATA_DIR",),
    "source_adapter": ("SOURCE_ADAPTER",),
    "hybrid_search_limit": ("HYBRID_SEARCH_LIMIT",),
    "top_candidate_columns": ("TOP_CANDIDATE_COLUMNS",),
    "weight_column_definition": ("WEIGHT_COLUMN_DEFINITION",),
    "weight_value_definition": ("WEIGHT_VALUE_DEFINITION",),
    "weight_rule": ("WEIGHT_RULE",),
    "vector_probes": ("VECTOR_PROBES",),
    "log_level": ("LOG_LEVEL",),
    "log_dir": ("LOG_DIR",),
}


def settings(spark: SparkSession | None = None, **overrides) -> Settings:
    """Read anew at each call, so a changed environment or session takes effect."""
    out = Settings()
    for f in fields(Settings):
        kind = type(getattr(out, f.name))
        value = next((os.environ[v] for v in VARIABLES[f.name] if v in os.environ), None)
        if spark is not None:
            value = spark.conf.get(f"lodestar.{f.name}", value)
        if value is not None:
            out = replace(out, **{f.name: kind(value)})
    return replace(out, **{k: v for k, v in overrides.items() if v is not None})
