"""Change a scope by rows: only what differs from the visible snapshot is embedded, indexed and written.

The tables of a scope are kept in parts: catalog tables and chunks by a hash of
their keys, postings by spans of ids. A merge compares digests of the new
catalog's rows with the stored ones, key by key. What follows from a change is
found the same way, by comparing chunks: a column whose description or policy
changed changes its own chunk, a column that now has too many values loses
those of its values, a removed rule loses its chunk. Chunks that stay keep
their ids and vectors, new ones get ids beyond the largest. Parts without a
change are taken over from the snapshot they lie in; the others are written to
a new snapshot, which becomes visible by one rename, as with a whole load.

A scope without a snapshot, or whose snapshot has whole tables, is written in
parts once.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings, settings
from lodestar.functions.embedding import Embedder, HashEmbedder
from lodestar.observe import Run
from lodestar.operators import chunks as C
from lodestar.operators.difference import row_digest
from lodestar.operators.integrity import PRIMARY_KEYS, check
from lodestar.operators.postings import SPAN_BITS, chunk_blocks
from lodestar.operators.search import SCOPE
from lodestar.plans.load import FEW, LoadRefused, fatal
from lodestar.session import interpreted
from lodestar.sources.catalog_json import get_adapter
from lodestar.sources.shared import dealt, stored
from lodestar.sources.store import Store, View

#: Parts of each table of a scope.
PARTS = 64
KEYS = {name: PRIMARY_KEYS[name] for name in ("columns", "values", "rules")} | {"chunks": [*SCOPE, "chunk_key"]}


def _part(columns: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def _changes(old: DataFrame | None, new: DataFrame, key: list[str], ignore: tuple[str, ...], parts: int) -> DataFrame:
    """``key``, change (same, added, removed, changed) and part."""
    compared = [c for c in new.columns if c not in ignore]
    a = new.select(*key, *row_digest(compared))
    if old is None:
        return a.select(*key, F.lit("added").alias("change"), _part(key, parts).alias("part"))
    b = old.select(*key, *[c.alias(n) for c, n in zip(row_digest(compared), ("o1", "o2"))])
    kind = F.when(F.col("o1").isNull(), "added").when(F.col("d1").isNull(), "removed").when((F.col("o1") == F.col("d1")) & (F.col("o2") == F.col("d2")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, kind.alias("change"), _part(key, parts).alias("part"))


def merge_namespace(
    spark: SparkSession, store: Store, data_dir: str, owner: str, namespace: str, config: Settings | None = None, run: Run | None = None, embedder: Embedder | None = None, parts: int = PARTS
) -> dict[str, Any]:
    """Bring one scope to the state of the catalog in ``data_dir``; returns, for each table, how many rows were added, removed, changed, and parts written."""
    config, run = config or settings(spark), run or Run("merge_metadata")
    with run.timed("load_source_files"), interpreted(spark):
        catalog = get_adapter(config.source_adapter).load(spark, data_dir, owner, namespace)
        tables = {name: stored(df, name) for name, df in (("columns", catalog.columns), ("values", catalog.values), ("rules", catalog.rules))}
        refused = fatal(catalog.issues).limit(5).collect()
        counts = {name: df.count() for name, df in tables.items()}
        tables = {name: dealt(df, counts[name], name) for name, df in tables.items()}
    if refused or not counts["columns"]:
        raise LoadRefused(f"{data_dir} names no column or has issues that a merge does not pass over; {owner}/{namespace} stays as it is: {refused}")
    with interpreted(spark, sum(counts.values()) <= FEW):
        return _merge(spark, store, owner, namespace, config, run, embedder or HashEmbedder(), parts, tables)


def _merge(spark: SparkSession, store: Store, owner: str, namespace: str, config: Settings, run: Run, embedder: Embedder, parts: int, tables: dict[str, DataFrame]) -> dict[str, Any]:
    pinned = store.parts(owner, namespace)
    view = store.view((owner, namespace)) if store.current(owner, namespace) else None
    known = (lambda name: None if view is None else view(name))
    every, flagged = C.unnumbered(tables["columns"], tables["values"], tables["rules"], config.value_cardinality_limit)
    every = stored(every, "chunks")
    new = {"columns": flagged.drop("pos"), "values": tables["values"].drop("pos"), "rules": C.rule_catalog(tables["rules"]), "chunks": every.drop("section", "group_pos", "item_pos")}
    folder = store.stage(owner, namespace)
    snapshot = folder.rsplit("/", 1)[1]
    manifest: dict[str, dict] = {}
    result: dict[str, Any] = {}

    def write(name: str, rows: DataFrame, touched: list[int], *order: str) -> None:
        """``rows``: all rows of the touched parts, with the column part; sorted inside by ``order``."""
        rows.repartition("part").sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{folder}/{name}")
        filled = {r.part for r in rows.select("part").distinct().collect()}  # no more than there are parts
        before = pinned.get(name, {}).get("parts", {})
        where = {p: s for p, s in before.items() if int(p) not in touched} | {str(p): snapshot for p in filled}
        manifest[name] = {"schema": rows.drop("part").schema.json(), "parts": where}
        result[name]["parts_written"] = len(touched)

    try:
        moves: dict[str, DataFrame] = {}
        for name, key in KEYS.items():
            with run.timed(f"compare_{name}"):
                # the column and value tables of whole loads hold the same columns, so their rows compare as they are
                moves[name] = stored(_changes(known(name), new[name], key, ("id", "embedding"), parts), f"changes-{name}")
                found = {r.change: r.n for r in moves[name].groupBy("change").agg(F.count("*").alias("n")).collect()}
                result[name] = {k: found.get(k, 0) for k in ("added", "removed", "changed", "same")}
        touched = {}
        for name, df in moves.items():
            parted = name in pinned
            touched[name] = sorted(r.part for r in df.where("change <> 'same'" if parted else "true").select("part").distinct().collect())
        for name in ("columns", "values", "rules"):
            rows = new[name].withColumn("part", _part(KEYS[name], parts))
            write(name, rows.where(F.col("part").isin(touched[name])), touched[name])

        with run.timed("embed_changed_chunks"):
            key = KEYS["chunks"]
            live = moves["chunks"].where("change <> 'removed'").join(every, key)
            if view is None:
                largest, held = 0, live.withColumn("id", F.lit(None).cast("long")).withColumn("was", F.lit(None).cast("array<float>"))
            else:
                largest = view("chunks").agg(F.max("id")).first()[0] or 0
                held = live.join(view("chunks").select(*key, "id", F.col("embedding").alias("was"), F.col("text_semantic").alias("said")), key, "left")
                held = held.withColumn("was", F.when(F.col("said").eqNullSafe(F.col("text_semantic")), F.col("was"))).drop("said")
            held = stored(held, "live-chunks")
            fresh = held.where("id IS NULL").drop("id")
            numbered = C.number(fresh, fresh.select(*SCOPE, "section", "group_pos")).withColumn("id", F.col("id") + largest)
            stay = held.where("id IS NOT NULL").drop("section", "group_pos", "item_pos")
            placed = stay.unionByName(numbered)
            # a vector is made only where the text is new
            made = placed.where("was IS NULL").withColumn("embedding", embedder(F.col("text_semantic")))
            chunks = placed.where("was IS NOT NULL").withColumn("embedding", F.col("was")).unionByName(made).drop("was")
            chunks = stored(chunks.withColumn("block", F.shiftright("id", SPAN_BITS)), "merged-chunks")
        columns = [*[c for c in new["chunks"].columns], "id", "embedding", "part"]
        write("chunks", chunks.where(F.col("part").isin(touched["chunks"])).select(columns), touched["chunks"])

        with run.timed("index_changed_spans"):
            changed = chunks.where("change <> 'same'").select("block")
            if view is not None:
                gone = view("chunks").join(moves["chunks"].where("change = 'removed'").select(*key), key, "left_semi")
                changed = changed.unionByName(gone.select(F.shiftright("id", SPAN_BITS).alias("block")))
            whole = "index" not in pinned
            spans = stored((chunks.select("block") if whole else changed).distinct(), "changed-spans")
            again = chunk_blocks(chunks.join(spans, "block", "left_semi"), SCOPE)
            part_of = F.pmod("block", F.lit(parts)).cast("int")
            touched_index = sorted(r.part for r in spans.select(part_of.alias("part")).distinct().collect())
            again = again.withColumn("part", part_of)
            if not whole:
                kept = view("index").withColumn("part", part_of).where(F.col("part").isin(touched_index)).join(spans, "block", "left_anti")
                again = kept.select(again.columns).unionByName(again)
            result["index"] = {"spans": spans.count()}
            write("index", again, touched_index, "lexeme", *SCOPE, "block")
        with run.timed("check"):
            merged = View(spark, [(folder, manifest)])
            check({n: merged(n) for n in ("columns", "values", "rules", "chunks")}, embedder.dim)
        with run.timed("db_commit"):
            store.publish(owner, namespace, folder, manifest)
    except BaseException:
        store.discard(folder)
        raise
    run.value("merged", result)
    return result
