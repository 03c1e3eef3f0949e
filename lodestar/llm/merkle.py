"""Merkle manifest of a table of documents, by parent preimages.

Every parent is stored as its preimage: the hexadecimal digests of its
children, side by side, 64 characters each. A leaf joins the preimages of all
its ancestors, cuts its own slot out of each to get its siblings (the proof),
and folds to the root by splicing a digest into its slot and hashing, level by
level. Preimages are handed down the tree from parent to child, so the leaves
take part in one join, not in one for each level.

Leaves are grouped by language, ordered by id; the subroots of the languages
are the leaves of a second tree. Nothing is collected but one count for each
partition and the heights of the trees.

Null columns are written as ``-``; null ids and null languages come first; rows
that share an id are ordered by their digest, and repeated rows are leaves
each. Empty and very long texts are like any other. An empty table has no
nodes and returns no rows. Other columns of the table are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER, bounded, stored
from lodestar.llm.ranks import ranked

FANOUT, DIGEST = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value: no two lists of values read the same."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[encoded(f) for f in fields]))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, n, preimage, hash) of the level above ``nodes`` (tree, pos, n, hash); n: nodes of the tree on the level."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("children"),  # no more than ``fanout``
        F.first("n").alias("below"),
    )
    preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    above = runs.select("tree", "pos", F.ceil(F.col("below") / fanout).cast("long").alias("n"), preimage.alias("preimage"))
    return above.withColumn("hash", digest(F.col("preimage")))


def tree_levels(leaves: DataFrame, height: int, fanout: int, name: str) -> list[DataFrame]:
    """The stored levels above ``leaves`` (tree, pos, n, hash), lowest first; a tree of one node is its own root."""
    levels, below = [], leaves
    for _ in range(height):
        below = stored(_parents(below, fanout), name)
        levels.append(below)
    return levels


def height(n: int, fanout: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _with_path(nodes: DataFrame, above: DataFrame | None, fanout: int, path: str) -> DataFrame:
    """``nodes`` (tree, pos and more) with the preimages of all their ancestors, lowest first, each with the slot that leads down to the node."""
    none = F.array().cast("array<struct<preimage: string, slot: int>>")
    if above is None:
        return nodes.withColumn(path, none)
    higher = above.select("tree", F.col("pos").alias("parent"), F.col("path").alias("higher"))
    joined = nodes.withColumn("parent", F.floor(F.col("pos") / fanout).cast("long")).join(higher, ["tree", "parent"], "left")
    slot = (F.col("pos") % fanout).cast("int")
    own = F.transform(F.slice("higher", 1, 1), lambda x: F.struct(x["preimage"].alias("preimage"), slot.alias("slot")))
    rest = F.slice("higher", 2, F.greatest(F.size("higher") - 1, F.lit(0)))
    return joined.withColumn(path, F.coalesce(F.concat(own, rest), none)).drop("parent", "higher")


def handed_down(levels: list[DataFrame], fanout: int, name: str) -> DataFrame | None:
    """(tree, pos, path) of the lowest level: each node's own preimage and those of all above it. The own slot is filled in by the child."""
    path = None
    for nodes in reversed(levels):
        own = F.array(F.struct("preimage", F.lit(0).alias("slot")))
        path = stored(_with_path(nodes, path, fanout, "upwards").select("tree", "pos", F.concat(own, "upwards").alias("path")), name)
    return path


def siblings(path: Column) -> Column:
    """Every preimage of ``path`` without the slot of the node that the path comes from."""
    at = lambda x: x["slot"] * DIGEST
    return F.array_join(F.transform(path, lambda x: F.concat(F.substr(x["preimage"], F.lit(1), at(x)), F.substr(x["preimage"], at(x) + DIGEST + 1))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to: spliced into its slot, hashed, and so on upwards."""
    splice = lambda x, h: F.concat(F.substr(x["preimage"], F.lit(1), x["slot"] * DIGEST), h, F.substr(x["preimage"], (x["slot"] + 1) * DIGEST + 1))
    return F.aggregate(path, start, lambda h, x: F.sha2(splice(x, h).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (concatenated digests), folded_root and verified for every row of ``docs``.

    ``fields``: the columns of a leaf, ``doc_id``, ``lang`` and ``text`` among
    them. ``tampered``: where true, the text is lower-cased (A-Z) before the
    leaf is folded, while the siblings stay those of the original.
    """
    columns = [F.col(c) for c in fields]
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields]
    bad = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select("doc_id", "lang", leaf(columns).alias("leaf"), F.when(bad, leaf(changed)).otherwise(leaf(columns)).alias("claimed"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = ranked(leaves, order, "place", "leaves-ranked")
    # languages in order: how many leaves each has and where they begin
    langs = stored(placed.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("begins")), "languages")
    langs = stored(ranked(langs, [F.col("begins")], "tree", "languages-ranked"), "languages-placed")
    # languages are few or many: their table is broadcast only if it is small
    total, most = langs.agg(F.count("*"), F.max("n")).first()
    named = langs.select(F.col("begins").alias("b"), "tree", "n", F.col("lang").alias("l"))
    nodes = placed.join(bounded(named, total), placed["lang"].eqNullSafe(named["l"])).select("tree", (F.col("place") - F.col("b")).alias("pos"), "n", F.col("leaf").alias("hash"), "doc_id", "claimed")
    nodes = stored(nodes, "nodes")
    lower = tree_levels(nodes.select("tree", "pos", "n", "hash"), height(most or 0, fanout), fanout, "level")
    subroots = nodes.where("n = 1").select("tree", "hash")
    for level in lower:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "hash"))
    subroots = stored(subroots, "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(total).cast("long").alias("n"), "hash")
    upper = tree_levels(tops, height(total, fanout), fanout, "top")
    root = (upper[-1] if upper else tops).select("hash").first()
    crowned = _with_path(tops, handed_down(upper, fanout, "top-path"), fanout, "upper")
    crowned = stored(crowned.select(F.col("pos").alias("tree"), F.col("hash").alias("subroot"), F.lit(root and root.hash).alias("root"), "upper"), "crowned")
    paths = _with_path(nodes, handed_down(lower, fanout, "path"), fanout, "lower").join(bounded(crowned, total), "tree")
    path = F.concat("lower", "upper")
    out = paths.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", siblings(path).alias("siblings"), folded(F.col("claimed"), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
