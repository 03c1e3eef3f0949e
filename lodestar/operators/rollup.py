"""Hits to ranked columns: weighted sums, rule bonuses, coverage, mandatory columns, prompt bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.search import SCOPE

REF = ["table_name", "column_name"]
_VALUES = "array<struct<raw_value: string, score: double, value_gloss: string, synonyms: array<string>>>"
_RULES = "array<struct<rule_id: string, score: double, text_semantic: string>>"
_CHUNKS = "array<struct<chunk_key: string, chunk_type: string, score: double, table_name: string, column_name: string, raw_value: string>>"
TOP_VALUES, TOP_RULES, TOP_CHUNKS = 4, 4, 6


def haystack(gaps: bool = True) -> Column:
    """The lower-cased text of a hit in which keywords are looked for.

    Its fields are joined by spaces. With ``gaps`` an empty field has its space
    too, so a keyword that ends with one is found at the end of the text.
    """
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    refs = F.filter(F.coalesce(F.col("payload.candidate_columns"), F.array().cast("array<struct<table_name: string, column_name: string>>")), lambda r: _named(r["table_name"], r["column_name"]))
    labels = F.array_join(F.transform(refs, lambda r: T.label(r["table_name"], r["column_name"])), " ")
    plain = [F.coalesce(F.col(c), F.lit("")) for c in ("text_exact", "column_name", "raw_value", "payload.raw_column_name")]
    fields = [*plain, joined("payload.aliases"), joined("payload.synonyms"), joined("payload.business_tags"), labels, joined("payload.trigger_terms")]
    return F.lower(F.concat_ws(" ", *(fields if gaps else [F.nullif(f, F.lit("")) for f in fields])))


def _named(table: Column, column: Column) -> Column:
    return F.coalesce((table != "") & (column != ""), F.lit(False))


def keyword_hits(keywords: Column, gaps: bool = True) -> Column:
    """Keywords that occur anywhere in the hit's text, inside words too."""
    return T.let(haystack(gaps), lambda text: F.filter(keywords, lambda k: F.contains(text, k)))


def contributions(hits: DataFrame, keywords: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A row for each hit and column that it counts for: ref, hit_pos, place, points, coverage and the hit.

    A rule counts for each of its candidate columns, with its weighted score
    divided by how many there are; other hits count for their own column.
    """
    rows = hits.join(keywords.select("query_id", "keywords"), "query_id").withColumn("coverage", keyword_hits(F.col("keywords"))).drop("keywords")
    weight = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("chunk_type")], F.lit(1.0))
    refs, n = F.col("payload.candidate_columns"), F.size("payload.candidate_columns")
    item = lambda place, points, table, column: F.struct(place.cast("int").alias("place"), points.alias("points"), table.alias("table_name"), column.alias("column_name"))
    own = F.array(item(F.lit(0), F.col("score") * weight, F.col("table_name"), F.col("column_name")))
    shares = F.transform(refs, lambda r, i: item(i, F.col("score") * F.lit(float(weights.get("rule", 1.0))) / n, r["table_name"], r["column_name"]))
    # one row generator, no union: rows stay dealt by question as the join left them
    counted = F.when(F.col("chunk_type") != "rule", own).when((F.col("chunk_type") == "rule") & (n > 0), shares)
    others = [c for c in rows.columns if c not in REF]
    found = rows.select(*others, F.explode(F.filter(counted, lambda x: _named(x["table_name"], x["column_name"]))).alias("counted"))
    return found.select(*others, "counted.*")


def by_column(parts: DataFrame) -> DataFrame:
    """query_id, ref and ``entries``: what counts for the column, in the order of hits.

    A question has no more hits than its limit, so its entries are few. The
    join with its keywords has dealt them by question already: what follows
    groups and ranks inside it.
    """
    gloss = F.when(F.col("chunk_type") == "value_definition", T.compact_sentence(F.col("payload.value_gloss")))
    entry = F.struct(
        "hit_pos", "place", "chunk_type", "chunk_key", "points", "score", "coverage", "raw_value", gloss.alias("value_gloss"),
        F.coalesce("payload.synonyms", F.array().cast("array<string>")).alias("synonyms"), "rule_id", "text_semantic",
    )
    rows = parts.select("query_id", *REF, entry.alias("entry"))
    return rows.groupBy("query_id", *REF).agg(F.array_sort(F.collect_list("entry")).alias("entries"))


def scores() -> dict[str, Column]:
    """The sum of the points, in the order of hits, and the terms that are covered, sorted."""
    total = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["points"])
    return {"score": total, "coverage_terms": F.array_sort(F.array_distinct(F.flatten(F.transform("entries", lambda e: e["coverage"]))))}


def _first(items: Column, n: int) -> Column:
    """The payloads ``v`` of the first n items in the order of the fields before it."""
    return F.transform(F.slice(F.array_sort(items), 1, n), lambda x: x["v"])


def top_values() -> Column:
    """The values that were hit: unweighted sums, the first hit's gloss and synonyms; best four."""
    hit = F.filter("entries", lambda e: (e["chunk_type"] == "value_definition") & (e["raw_value"] != ""))

    def item(name: Column) -> Column:
        mine = F.filter(hit, lambda e: e["raw_value"] == name)
        total, first = F.aggregate(mine, F.lit(0.0), lambda s, e: s + e["score"]), F.element_at(mine, 1)
        v = F.struct(name.alias("raw_value"), total.alias("score"), first["value_gloss"].alias("value_gloss"), first["synonyms"].alias("synonyms"))
        return F.struct((-total).alias("o"), name.alias("k"), v.alias("v"))

    return _first(F.transform(F.array_distinct(F.transform(hit, lambda e: e["raw_value"])), item), TOP_VALUES)


def top_rules() -> Column:
    """The rules that name the column; of repeated hits of a rule the last counts; best four."""
    hit = F.filter("entries", lambda e: e["chunk_type"] == "rule")

    def item(name: Column) -> Column:
        last = F.element_at(F.filter(hit, lambda e: e["rule_id"].eqNullSafe(name)), -1)
        v = F.struct(name.alias("rule_id"), last["points"].alias("score"), last["text_semantic"].alias("text_semantic"))
        return F.struct((-last["points"]).alias("o"), name.alias("k"), v.alias("v"))

    return _first(F.transform(F.array_distinct(F.transform(hit, lambda e: e["rule_id"])), item), TOP_RULES)


def top_chunks() -> Column:
    """The hits other than rules that the column's score is made of; best six."""
    hit = F.filter("entries", lambda e: e["chunk_type"] != "rule")
    body = lambda e: F.struct(*[e[c].alias(c) for c in ("chunk_key", "chunk_type", "score")], *[F.col(c) for c in REF], e["raw_value"].alias("raw_value"))
    return _first(F.transform(hit, lambda e: F.struct((-e["score"]).alias("o"), e["chunk_key"].alias("k"), e["hit_pos"].alias("p"), body(e).alias("v"))), TOP_CHUNKS)


def column_scores(parts: DataFrame) -> DataFrame:
    """query_id, ref, score, coverage_terms (sorted)."""
    return by_column(parts).select("query_id", *REF, *[c.alias(n) for n, c in scores().items()])


def matched_values(parts: DataFrame) -> DataFrame:
    return by_column(parts).select("query_id", *REF, top_values().alias("matched_values"))


def matched_rules(parts: DataFrame) -> DataFrame:
    return by_column(parts).select("query_id", *REF, top_rules().alias("matched_rules"))


def supporting_chunks(parts: DataFrame) -> DataFrame:
    return by_column(parts).select("query_id", *REF, top_chunks().alias("supporting_chunks"))


def rank_columns(scores: DataFrame, top: int) -> DataFrame:
    """The best ``top`` columns of each query, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.size("coverage_terms").desc(), *REF)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def candidate_columns(hits: DataFrame, queries: DataFrame, columns: DataFrame, weights: dict[str, float], top: int = 5) -> DataFrame:
    """A row for each candidate: query_id, section, rank and the 14 fields of the debug view.

    The best columns come first (section 0), then, uncapped, the mandatory
    columns of the scope that are not among them (section 1).
    """
    grouped = by_column(contributions(hits, queries, weights)).select("query_id", *REF, "entries", *[c.alias(n) for n, c in scores().items()])
    details_of = {"matched_values": top_values(), "matched_rules": top_rules(), "supporting_chunks": top_chunks()}  # of the best columns alone
    ranked = rank_columns(grouped, top).withColumns(details_of).drop("entries")
    scope = queries.select("query_id", *SCOPE)
    details = columns.select(*SCOPE, *REF, "raw_column_name", "description", "aliases", "data_type", "value_cardinality", "mandatory_description_in_prompt")
    fields = ("section", "rank", *REF, "score", "injection_source", "coverage_terms", "matched_values", "matched_rules", "supporting_chunks")
    ranked = ranked.withColumn("section", F.lit(0)).withColumn("injection_source", F.lit("retrieval"))
    best = ranked.groupBy("query_id").agg(F.collect_list(F.struct(*fields)).alias("best"))
    forced = details.where("mandatory_description_in_prompt").groupBy(*SCOPE).agg(F.array_sort(F.collect_set(F.struct(*REF))).alias("forced"))
    asked = scope.join(forced, SCOPE, "left").join(best, "query_id", "left")
    known = F.coalesce(F.transform("best", lambda b: F.struct(*[b[c].alias(c) for c in REF])), F.array().cast(f"array<struct<{', '.join(f'{c}: string' for c in REF)}>>"))
    values = {
        "section": F.lit(1), "score": F.lit(0.0), "injection_source": F.lit("mandatory_high_cardinality"), "coverage_terms": F.array().cast("array<string>"),
        "matched_values": F.lit(None).cast(_VALUES), "matched_rules": F.lit(None).cast(_RULES), "supporting_chunks": F.lit(None).cast(_CHUNKS),
    }
    added = F.transform(
        F.array_except("forced", known), lambda f, i: F.struct(*[(values[c] if c in values else (i + 1) if c == "rank" else f[c]).alias(c) for c in fields])
    )
    items = F.flatten(F.array_compact(F.array(F.col("best"), added)))
    both = asked.select("query_id", *SCOPE, F.explode(items).alias("item")).select("query_id", *SCOPE, "item.*").join(details, [*SCOPE, *REF], "left")
    empty = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c)
    return both.select(
        "query_id", "section", "rank", *REF, "raw_column_name", "score", "coverage_terms",
        T.compact_sentence(F.col("description")).alias("short_description"),
        empty("aliases", "array<string>"), "data_type",
        F.coalesce("value_cardinality", F.lit(0)).alias("value_cardinality"),
        F.coalesce("mandatory_description_in_prompt", F.lit(False)).alias("mandatory_description_in_prompt"),
        "injection_source", empty("matched_values", _VALUES), empty("matched_rules", _RULES), empty("supporting_chunks", _CHUNKS),
    )


def prompt_fields() -> Column:
    """The eight fields of a candidate that a prompt carries."""
    values = F.transform("matched_values", lambda v: F.struct(v["raw_value"].alias("raw_value"), v["value_gloss"].alias("value_gloss")))
    rules = F.transform("matched_rules", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["text_semantic"].alias("text_semantic")))
    return F.struct(*REF, "raw_column_name", "short_description", "aliases", "data_type", values.alias("matched_values"), rules.alias("matched_rules"))


def bundle_rules(hits: DataFrame) -> DataFrame:
    """query_id, matched_rules: each rule once, in the order in which it was first hit."""
    none = F.array().cast("array<struct<table_name: string, column_name: string>>")
    body = F.struct("rule_id", "text_semantic", F.coalesce("payload.candidate_columns", none).alias("candidate_columns"))
    first = hits.where(F.col("chunk_type") == "rule").groupBy("query_id", "rule_id").agg(F.min(F.struct("hit_pos")).alias("at"), F.min_by(body, "hit_pos").alias("v"))
    item = F.struct(F.col("at.hit_pos").alias("o"), F.col("v"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("matched_rules"))


def prompt_bundles(hits: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query: query_id and the seven fields of the prompt bundle."""
    item = F.struct("section", "rank", prompt_fields().alias("v"))
    gathered = candidates.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("candidate_columns"))
    asked = queries.select("query_id", *SCOPE, "raw_query", "normalized_query", F.lit(None).cast("string").alias("retrieval_rewrite"))
    out = asked.join(gathered, "query_id", "left").join(bundle_rules(hits), "query_id", "left")
    kinds = {c: out.schema[c].dataType for c in ("candidate_columns", "matched_rules")}
    return out.select("query_id", *SCOPE, "raw_query", "normalized_query", "retrieval_rewrite", *[F.coalesce(F.col(c), F.array().cast(k)).alias(c) for c, k in kinds.items()])


def retrieval_summary(hits: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Counts of hits, types, candidates, values and rules for each query; keys and columns of the first five hits."""
    first = F.col("hit_pos") <= 5
    top = lambda keep, x: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("hit_pos", x.alias("x"))))), lambda s: s["x"])
    by_hit = hits.groupBy("query_id").agg(
        F.count("*").alias("hit_count"),
        top(first, F.col("chunk_key")).alias("top_hit_chunk_keys"),
        top(first & _named(F.col("table_name"), F.col("column_name")), T.label(F.col("table_name"), F.col("column_name"))).alias("top_hit_columns"),
        F.collect_list(F.coalesce("chunk_type", F.lit("None"))).alias("kinds"),
    )
    of = lambda kind: F.struct(kind.alias("chunk_type"), F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias("count"))
    by_hit = by_hit.withColumn("chunk_type_counts", F.map_from_entries(F.array_sort(F.transform(F.array_distinct("kinds"), of)))).drop("kinds")
    by_column = candidates.groupBy("query_id").agg(
        F.count("*").alias("candidate_column_count"),
        F.sum(F.size("matched_values")).alias("matched_value_count"),
        F.sum(F.size("matched_rules")).alias("matched_rule_count"),
        F.count_if(F.col("injection_source") == "mandatory_high_cardinality").alias("mandatory_injected_columns"),
    )
    out = queries.select("query_id").join(by_hit, "query_id", "left").join(by_column, "query_id", "left")
    counts = ["hit_count", "candidate_column_count", "matched_value_count", "matched_rule_count", "mandatory_injected_columns"]
    return out.fillna(0, counts)
