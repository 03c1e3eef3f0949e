"""Every query against its SQL or for shape; the pipeline stage by stage."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import quality
from lodestar.llm.queries import oracle_sql, queries
from tests.compare import database, differences
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import classes, slow_fingerprint


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_and_sql_agree(spark, sf, name):
    assert differences(queries()[name](spark, sf), database(sf), oracle_sql()[name]) == ""


@pytest.mark.parametrize("name, table", [("op3_histogram_shards", "documents"), ("op4_html_extract", "pages"), ("op5_quality_classifier", "documents"), ("op9_simhash", "documents")])
def test_a_row_for_each_row(spark, sf, name, table):
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on what the one before it kept, its rows worked out one by one in Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    def stage(n, kept):
        return corpus_pipeline.STAGES[n][1](spark, spark.createDataFrame([rows[i] for i in kept], docs.schema), sf)

    kept = sorted(rows)
    score = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    good = [i for i in kept if score(rows[i].text or "") >= 0.3]
    got = stage(0, kept)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [tuple(rows[i]) for i in good] and 0 < len(good) < len(kept)
    root = classes([slow_fingerprint(rows[i].text) for i in good], 2)
    first = [i for n, i in enumerate(good) if root[n] == n]  # ids ascend, so a class is named by its smallest
    got = stage(1, good)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [tuple(rows[i]) for i in first] and len(first) < len(good)
    clean = [i for i in first if not brute(rows[i].text, items)[-1]]
    got = stage(2, first)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [tuple(rows[i]) for i in clean] and len(clean) < len(first)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for i in clean:
        ids = encode.encode(rows[i].text or "", add_special_tokens=False).ids + [0]
        wanted += [(i, n, at, len(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    packed = stage(3, clean).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in packed) == wanted
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 2048
    least = -(-sum(w[3] for w in wanted) // 2048)
    assert least <= len(sequences) <= 1.1 * least + 1
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in run) == wanted


def test_quality_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score, texts = model.scorer(), {r.doc_id: r.text for r in docs.collect()}
    rows = queries()["op5_quality_classifier"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and abs(r.score - score(texts[r.doc_id] or "")) < 1e-12 and r.predicted == int(r.score >= 0.3)


def test_pipeline_stages_on_odd_documents(spark, sf, docs, no_docs):
    """The whole fixture, whose columns have the names that the stages use, with a map, a variant and more clashes."""
    odd = docs.withColumns({
        "tags": F.create_map(F.lit("a"), F.col("doc_id")), "any": F.parse_json(F.lit('{"x": [1]}')), "_quality": F.lit("mine"),
        "ck2": F.lit("other"), "once": F.lit(1), "_row": F.lit(2), "digest": F.lit(3), "__id": F.lit(4), "contaminated": F.lit(False), "stays": F.lit(5),
    })
    kinds = odd.dtypes
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.keep_one_of_each, corpus_pipeline.keep_clean):
        got = stage(spark, odd, sf)
        assert got.dtypes == kinds and all(r._quality == "mine" and r.ck2 == "other" and r.ck1 == 7 for r in got.collect())
        assert stage(spark, odd.where("false"), sf).count() == 0
    left = corpus_pipeline.keep_one_of_each(spark, odd, sf).collect()
    assert {r.doc_id for r in left} == {1, 3, 6, 7, 8, 9, None} and all(r.tags == {"a": r.doc_id} for r in left)
    assert corpus_pipeline.pack(spark, odd, sf).where("piece = 0").count() == odd.count()


def test_pipeline_decisions_do_not_go_by_the_id_alone(spark, sf):
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").orderBy("item_id").first().text
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = "a text of its own about ships that sail in the north", "another unlike it, on the growing of pears and plums"
    rows = [(None, f"leak {passage}", "en", "a", 1), (1, passage, "en", "a", 1), (1, one, "en", "a", 1), (None, two, "en", "b", 1)]
    clean = corpus_pipeline.keep_clean(spark, spark.createDataFrame(rows, kinds), sf).collect()
    assert {(r.doc_id, r.text) for r in clean} == {(1, one), (None, two)} and len(clean) == 2
    # copies without ids leave one; an id that two texts share loses neither; rows that repeat id and text leave one
    rows = [(None, two, "en", "b", 1)] * 2 + [(5, one, "en", "b", 1)] * 2 + [(7, one, "en", "a", 1), (7, "a third: clocks, bells and the towers they hang in", "en", "a", 1)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, kinds), sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", two), ("5", one), ("7", rows[-1][1])])
