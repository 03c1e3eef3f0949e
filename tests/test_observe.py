import logging

import pytest

from lodestar.config import settings
from lodestar.observe import Run, logger_for


def test_stages(spark):
    run = Run("test")
    with run.timed("good", rows=3):
        spark.range(5).count()
    with pytest.raises(ValueError):
        with run.timed("bad"):
            raise ValueError("x")
    run.value("section", 5)
    run.text("question", "two words")
    found = run.metrics()
    stages = found["stages"]
    assert stages["good"]["status"] == "ok" and stages["good"]["context"] == {"rows": 3} and stages["bad"]["status"] == "error" and "context" not in stages["bad"]
    assert found["section"] == 5 and found["texts"]["question"]["chars"] == 9 and found["total_elapsed_ms"] >= stages["good"]["elapsed_ms"] > 0


def test_log_file(tmp_path):
    log = logger_for("filed", "INFO", str(tmp_path))
    log.info("hello")
    logging.shutdown()
    assert "hello" in (tmp_path / "filed.log").read_text()


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CATALOG_NAMESPACE", "second")
    monkeypatch.setenv("WEIGHT_RULE", "0.25")
    assert settings().resource_namespace == "second" and settings().chunk_type_weights["rule"] == 0.25
    monkeypatch.setenv("RESOURCE_NAMESPACE", "first")
    assert settings().resource_namespace == "first" and settings(value_cardinality_limit=3).value_cardinality_limit == 3
    spark.conf.set("lodestar.top_candidate_columns", "9")
    assert settings(spark).top_candidate_columns == 9
    spark.conf.unset("lodestar.top_candidate_columns")
