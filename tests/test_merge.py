"""Changes of a scope by rows, and the difference of two versions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.operators.difference import difference
from lodestar.plans.load import LoadRefused, load_namespace
from lodestar.plans.merge import merge_namespace
from lodestar.sources.store import Store
from tests.catalogs import column, group, write

KEYS = ["chunk_key", "text_exact", "text_semantic"]


def catalog(version):
    columns = [column(f"t{i % 7}", f"c{i}", f"Column number {i} of the shop") for i in range(60)]
    values = [group(f"t{i % 7}", f"c{i}", *[f"v{i}_{k}" for k in range(3)]) for i in range(0, 60, 4)]
    if version == 2:
        columns[5] = column("t5", "c5", "A new description")
        columns[59:] = [column("t9", "c99", "A new column")]
        values[1] = group("t4", "c4", *[f"w{k}" for k in range(27)])  # too many: its values lose their chunks
    return columns, values


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("merge")
    store = Store(spark, str(root / "s"), retention=0)
    for version in (1, 2):
        write(root / f"v{version}", *catalog(version))
    results = [merge_namespace(spark, store, str(root / f"v{v}"), "me", "shop", parts=32) for v in (1, 1, 2)]
    load_namespace(spark, store, str(root / "v2"), "me", "whole")
    return root, store, results


def test_only_touched_parts_are_written(merged):
    root, store, (first, same, second) = merged
    assert first["chunks"]["added"] == 60 + 45 and first["chunks"]["parts_written"] > 25
    for name in ("columns", "values", "rules", "chunks", "index"):
        assert same[name]["parts_written"] == 0  # the same catalog again writes nothing
    # c5 described anew, c4's policy changed, c99 instead of c59; 3 values became 27 that have no chunks
    assert (second["columns"]["changed"], second["columns"]["added"], second["columns"]["removed"]) == (2, 1, 1)
    assert (second["values"]["added"], second["values"]["removed"]) == (27, 3)
    assert (second["chunks"]["changed"], second["chunks"]["added"], second["chunks"]["removed"]) == (2, 1, 4)
    assert second["columns"]["parts_written"] <= 4 and second["chunks"]["parts_written"] <= 7 and second["index"]["parts_written"] <= 3
    # what the new snapshot's own folder holds are those parts alone
    pointer = json.loads((root / "s/owner=me/namespace=shop/current.json").read_text())
    own = Path(root / "s/owner=me/namespace=shop" / pointer["snapshot"])
    for name in ("columns", "chunks", "index"):
        assert len(list((own / name).glob("part=*"))) <= second[name]["parts_written"]
        assert len(list((own / name).glob("part=*/*.parquet"))) <= second[name]["parts_written"]
    assert len(set(pointer["parts"]["columns"]["parts"].values())) == 2  # the rest lies where it lay, though its snapshot was replaced


def test_a_merge_gives_what_a_whole_load_gives(spark, merged):
    _, store, _ = merged
    for name, columns in (("columns", ["table_name", "column_name", "description", "value_cardinality", "mandatory_description_in_prompt"]), ("values", ["table_name", "column_name", "raw_value", "value_gloss"]), ("chunks", [*KEYS, "embedding"])):
        a, b = (sorted(map(str, store.table(name, "me", n).select(*columns).collect())) for n in ("shop", "whole"))
        assert a == b
    # postings name each chunk's words, by its key as ids differ
    def words(namespace):
        keys = store.table("chunks", "me", namespace).select("id", "chunk_key")
        docs = store.table("index", "me", namespace).select("lexeme", "block", F.explode("docs").alias("d")).select("lexeme", (F.col("block") * 64 + F.col("d.at")).alias("id"), "d.a", "d.b", "d.deltas")
        return sorted(map(str, docs.join(keys, "id").drop("id").collect())), docs.count()

    assert words("shop") == words("whole")


def test_chunks_that_stay_keep_their_ids(spark, merged, tmp_path):
    _, store, _ = merged
    ids = {r.chunk_key: r.id for r in store.table("chunks", "me", "shop").select("chunk_key", "id").collect()}
    assert len(set(ids.values())) == len(ids) and ids["column_definition::t9::c99"] == 106 and ids["column_definition::t5::c5"] == 6
    before = store.current("me", "shop")
    with pytest.raises(LoadRefused):
        merge_namespace(spark, store, write(tmp_path / "bad", [column("t", "a"), column("t", "a")]), "me", "shop")
    assert store.current("me", "shop") == before and store.count("chunks", "me", "shop") == len(ids)


def test_difference_of_multisets(spark):
    kind = "k string, x int, pos int"
    before = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("b", 2, 4), (None, 1, 5), ("c", 1, 6), ("d", None, 7)], kind)
    after = spark.createDataFrame([("a", 1, 1), ("b", 1, 3), ("b", 9, 4), ("b", 8, 5), (None, 1, 9), ("e", 1, 6), ("d", None, 7)], kind)
    got = sorted((str(r.k), r.change, r.n) for r in difference(before, after, ["k"], "pos").collect())
    assert got == [("None", "moved", 1), ("a", "removed", 1), ("b", "added", 1), ("b", "changed", 1), ("c", "removed", 1), ("e", "added", 1)]
    assert difference(before, before, ["k"], "pos").count() == 0
    assert {(r.change, r.n) for r in difference(before, before.where("false"), ["k"]).groupBy("change").agg(F.sum("n").alias("n")).collect()} == {("removed", 7)}
