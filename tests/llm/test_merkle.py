import hashlib

from pyspark.sql import functions as F

from lodestar.llm.merkle import FIELDS, manifest


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row: dict, fields=FIELDS) -> str:
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields))


def climb(level: list[str], fanout: int) -> list[list[str]]:
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def brute(rows: list[dict], fanout: int) -> list[tuple]:
    """(doc_id, leaf, subroot, root, siblings) of every row, by recursion over lists."""
    languages = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in languages:
        members = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r)))
        trees[lang] = (members, climb([slow_leaf(r) for r in members], fanout))
    top = climb([trees[x][1][-1][0] for x in languages], fanout)
    out = []
    for n, lang in enumerate(languages):
        members, levels = trees[lang]
        for i, row in enumerate(members):
            proof = ""
            for at, every in ((i, levels[:-1]), (n, top[:-1])):
                for level in every:
                    run = at - at % fanout
                    proof += "".join(level[k] for k in range(run, min(run + fanout, len(level))) if k != at)
                    at //= fanout
            out.append((row["doc_id"], levels[0][i], levels[-1][0], top[-1][0], proof))
    return out


def check(rows: list[dict], df, fanout: int) -> None:
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in df.collect()]
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted(got, key=key) == sorted(brute(rows, fanout), key=key)


def test_odd_documents_with_several_heights(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    for fanout in (2, 3, 8):
        check(rows, manifest(docs, fanout=fanout), fanout)


def test_long_runs_and_a_last_run_of_one(spark):
    df = spark.range(0, 65).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("T"), "id").alias("text"))
    check([r.asDict() for r in df.collect()], manifest(df), 8)


def test_tampering_is_found_and_nothing_else(spark, docs):
    found = manifest(docs, F.col("doc_id") % 2 == 0).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in found:
        changed = r.doc_id % 2 == 0 and r.text is not None and any("A" <= c <= "Z" for c in r.text)
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified
    assert {r.verified for r in found} == {True, False}


def test_lone_leaf_and_empty_table(spark, docs, no_docs):
    one = manifest(docs.where("doc_id = 1")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.siblings == ""
    assert manifest(no_docs).count() == 0
