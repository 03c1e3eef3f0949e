"""Loads, isolation, refusals, answers, the stream: the engine end to end."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.operators.integrity import IntegrityError, check
from lodestar.plans.answer import answer, answer_one, prompt_json, report
from lodestar.plans.load import LoadRefused, load_namespace
from lodestar.sources import shared
from lodestar.sources.store import Store
from lodestar.streaming.questions import answer_stream
from tests.catalogs import SHOP, column, group, write


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    store = Store(spark, str(root / "s"))
    load_namespace(spark, store, write(root / "shop", *SHOP), "me", "shop")
    wide = [column("logs", "code", "Error code of the log"), column("logs", "host", "Host name"), column("logs", "level", "Level of the entry")]
    values = [group("logs", "code", *[f"c{i}" for i in range(27)]), group("logs", "host", *[f"h{i}" for i in range(27)]), group("logs", "level", "low", "high")]
    load_namespace(spark, store, write(root / "wide", wide, values), "me", "wide")
    load_namespace(spark, store, write(root / "twin", [column("deals", "approval_state", "Whether executive approval is pending")]), "you", "shop")
    return store


def test_stored_tables(store):
    chunks = store.table("chunks", "me", "shop").orderBy("id").collect()
    assert [r.chunk_key for r in chunks[:5]] == ["column_definition::orders::state", "column_definition::orders::region", "column_definition::clients::state", "column_definition::clients::plan", "value_definition::orders::state::blocked_by_legal"]
    assert chunks[-1].chunk_key == "rule::r1" and [r.id for r in chunks] == list(range(1, 12)) and all(len(r.embedding) == 24 for r in chunks)
    assert store.scopes() == [("me", "shop"), ("me", "wide"), ("you", "shop")]


def test_answer_of_one_question(store):
    a = answer_one(store, "which orders are stuck in legal", "me", "shop")
    assert list(a) == ["resource_owner", "resource_namespace", "raw_query", "normalized_query", "retrieval_rewrite", "lexical_query", "semantic_query", "keywords", "hits", "candidate_columns_debug", "prompt_metadata", "instrumentation"]
    first = a["candidate_columns_debug"][0]
    assert (first["table_name"], first["column_name"]) == ("orders", "state") and first["matched_values"][0]["raw_value"] == "blocked_by_legal"
    assert first["matched_rules"][0]["rule_id"] == "r1" and first["injection_source"] == "retrieval"
    prompt = a["prompt_metadata"]
    assert list(prompt) == ["resource_owner", "resource_namespace", "raw_query", "normalized_query", "retrieval_rewrite", "candidate_columns", "matched_rules"]
    assert list(prompt["candidate_columns"][0]) == ["table_name", "column_name", "raw_column_name", "short_description", "aliases", "data_type", "matched_values", "matched_rules"]
    assert prompt["matched_rules"][0]["candidate_columns"] == [{"table_name": "orders", "column_name": "state"}, {"table_name": "clients", "column_name": "state"}]
    assert list(a["instrumentation"]["stages"]) == ["build_retrieval_inputs", "build_query_embedding", "fetch_hybrid_results", "build_candidate_columns", "build_prompt_metadata"]
    assert "== hits" in report(a) and "orders.state" in report(a) and json.dumps(a, default=str)
    same_name = {(c["table_name"], c["column_name"]) for c in a["candidate_columns_debug"]}
    assert {("orders", "state"), ("clients", "state")} <= same_name


def test_batch_isolation_and_mandatory_columns(spark, store, tmp_path):
    asked = spark.createDataFrame([(1, "me", "shop", "buyers in Europe"), (2, "me", "wide", "show level"), (3, "you", "shop", "pending approval"), (4, "me", "wide", "")], "query_id long, resource_owner string, resource_namespace string, raw_query string")
    found = answer(store, asked)
    rows = found.candidates.orderBy("query_id", "section", "rank").collect()
    names = {q: [f"{r.table_name}.{r.column_name}" for r in rows if r.query_id == q] for q in (1, 2, 3, 4)}
    assert names[1][0] == "orders.region" and names[3] == ["deals.approval_state"]
    assert set(names[2]) == set(names[4]) == {"logs.code", "logs.host", "logs.level"}
    flags = {r.column_name: (r.mandatory_description_in_prompt, r.value_cardinality) for r in rows if r.query_id == 2}
    assert flags == {"code": (True, 27), "host": (True, 27), "level": (False, 2)}
    narrow = answer(store, asked.where("query_id = 2"), top_columns=1).candidates.orderBy("section", "rank").collect()
    assert [r.injection_source for r in narrow] == ["retrieval"] + ["mandatory_high_cardinality"] * (len(narrow) - 1) and len(narrow) >= 2
    prompts = {r.query_id: json.loads(r.prompt) for r in prompt_json(found.prompts).collect()}
    assert len(prompts) == 4 and all(p["retrieval_rewrite"] is None and not {"score", "coverage_terms"} & set(p["candidate_columns"][0]) for p in prompts.values())
    summary = {r.query_id: r for r in found.summary().collect()}
    assert summary[3].hit_count == 1 and summary[3].top_hit_columns == ["deals::approval_state"] and summary[1].chunk_type_counts["rule"] == 1


def test_a_stored_vector_index_gives_the_same_answers(spark, store, tmp_path):
    probing = Settings(vector_probes=1000)
    load_namespace(spark, store, write(tmp_path / "shop", *SHOP), "me", "probed", probing)
    asked = spark.createDataFrame([(1, "me", "probed", "buyers in Europe"), (2, "you", "shop", "pending approval")], "query_id long, resource_owner string, resource_namespace string, raw_query string")
    exact, found = (sorted(str(r) for r in answer(store, asked, c).hits.drop("payload").collect()) for c in (Settings(), probing))
    assert found == exact and len(found) > 5


def test_refused_loads_leave_the_store_as_it_is(spark, store, tmp_path):
    before = store.count("chunks", "me", "shop")
    with pytest.raises(LoadRefused):
        load_namespace(spark, store, write(tmp_path / "bad", [column("t", "a"), column("t", "a")]), "me", "shop")
    with pytest.raises(LoadRefused):
        load_namespace(spark, store, write(tmp_path / "empty", []), "me", "shop")
    assert store.count("chunks", "me", "shop") == before
    with pytest.raises(LookupError):
        store.table("chunks", "me", "unknown")


def test_a_new_load_replaces_all_tables(spark, store, tmp_path):
    first = load_namespace(spark, store, write(tmp_path / "one", *SHOP), "me", "tmp")
    assert first["loaded"] == {"columns": 4, "values": 6, "rules": 1, "chunks": 11} and first["value_indexing"]["indexed_values"] == 6
    second = load_namespace(spark, store, write(tmp_path / "two", [column("x", "y", "z")]), "me", "tmp")
    assert second["loaded"] == {"columns": 1, "values": 0, "rules": 0, "chunks": 1}
    assert store.count("rules", "me", "tmp") == 0 and store.count("values", "me", "tmp") == 0


def test_readers_keep_the_snapshot_they_began_with(spark, tmp_path):
    def put(kept, rows):
        folder = kept.stage("a", "b")
        spark.range(rows).write.parquet(f"{folder}/columns")
        kept.publish("a", "b", folder)
        return folder

    kept = Store(spark, str(tmp_path / "s"), retention=3600)
    put(kept, 3)
    reading = kept.view(("a", "b"))
    before = reading("columns")
    put(kept, 5)
    assert before.count() == reading("columns").count() == 3 and kept.table("columns", "a", "b").count() == 5
    last = put(Store(spark, str(tmp_path / "s"), retention=0), 7)
    assert [p.name for p in (tmp_path / "s" / "owner=a" / "namespace=b").glob("snapshot-*")] == [last.rsplit("/", 1)[1]]


def test_constraints(store):
    tables = {n: store.table(n, "me", "shop") for n in ("columns", "values", "rules", "chunks")}
    check(tables, 24)
    for name, broken in (
        ("columns", tables["columns"].union(tables["columns"])),
        ("columns", tables["columns"].where("column_name <> 'region'")),
        ("rules", tables["rules"].where("false")),
        ("chunks", tables["chunks"].withColumn("chunk_type", F.lit("other"))),
        ("chunks", tables["chunks"].withColumn("embedding", F.array(F.lit(1.0).cast("float")))),
        ("values", tables["values"].withColumn("synonyms", F.lit(None).cast("array<string>"))),
    ):
        with pytest.raises(IntegrityError):
            check(tables | {name: broken}, 24)


def test_stream_of_questions(spark, store, tmp_path):
    schema = "query_id long, resource_owner string, resource_namespace string, raw_query string"
    spark.createDataFrame([(7, "you", "shop", "approval")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = set(shared._made)
    answer_stream(store, stream, str(tmp_path / "out"), str(tmp_path / "check"), Settings(), available_now=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.query_id for r in rows] == [7] and "approval_state" in rows[0].prompt
    assert set(shared._made) == before  # no batch leaves a table behind
