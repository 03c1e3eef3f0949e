"""Text, embedding, metric and stemming functions against independent Python."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import embedding as E
from lodestar.functions import metrics as M
from lodestar.functions import text as T
from lodestar.functions.stemming import stem
from lodestar.functions.text import SEARCH_TERMS
from lodestar.functions.unaccent import unaccent, unaccented
from lodestar.functions.vocabulary import EMBEDDING_TERMS, SEARCH_FAMILIES
from lodestar.plans.answer import retrieval_inputs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def many(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


TOKENS = [
    ("Blocked by LEGAL", "blocked by legal legal_review"),
    ("stuck in legal", "blocked_by_legal legal legal_review blocked"),
    ("exec sign off", "exec signoff approval_gate"),
    ("exec  signoff", "exec signoff approval_gate"),
    ("exec signoff", "needs_exec_signoff executive signoff approval_gate"),
    ("example.network a/b-c", "example dotnet work a b c"),
    ("early-access preview", "pilot early_rollout preview"),
    ("欧盟数据驻留和路线图承诺", "eu europe_region residency 和 roadmap roadmap_support 承诺"),
    ("中文x字", "中文 x 字"),
    ("naïve café", "na ve caf"),
    ("", ""),
    (None, ""),
]


def test_tokens(spark):
    assert many(spark, [t for t, _ in TOKENS], T.normalize_for_search) == [x for _, x in TOKENS]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abz09_ é法-/.!\n", max_size=30), min_size=1, max_size=20))
def test_tokens_are_distinct_words_in_order(spark, texts):
    for text, got in zip(texts, many(spark, texts, T.tokens)):
        raw = re.findall("[a-z0-9_]+|[一-鿿]+", text.lower().replace("/", " ").replace("-", " ").replace(".net", " dotnet "))
        assert len(set(got)) == len(got)
        assert [t for t in got if t in raw] == list(dict.fromkeys(t for t in raw if t in got))


def test_compact_sentence(spark):
    cases = {"Hello!": "Hello!.", "One. Two.": "One.", " a \n b ... c": "a b .", "": "", None: "", "...": ".", "No stop": "No stop.", "x.y z": "x.y z.", "全 角　空": "全 角 空."}
    assert many(spark, list(cases), T.compact_sentence) == list(cases.values())


def test_description_keywords(spark):
    text = "The current status of an app that tells whether id legal hold 法 applies before GA"
    assert one(spark, text, T.description_keywords) == ["legal", "legal_review", "hold", "法", "applies", "live_rollout"]
    assert one(spark, text, lambda c: T.description_keywords(c, 2)) == ["legal", "legal_review"]


def test_exact_text(spark):
    row = spark.createDataFrame([("t_x", ["a b", "a"], None)], "a string, b array<string>, c array<string>")
    got = row.select(T.exact_text(F.array("a"), F.col("b"), F.col("c")).alias("x")).first().x
    assert got == "t_x a b"


def test_retrieval_inputs(spark):
    asked = ["blocked by legal or waiting for exec approval", "欧盟数据驻留和路线图承诺", "the of", "", None, "  show 　 me  x "]
    rows = retrieval_inputs(spark.createDataFrame(list(enumerate(asked)), "i int, raw_query string")).orderBy("i").collect()
    assert rows[0].lexical_query == "blocked OR legal OR legal_review OR needs_exec_signoff OR executive OR approval OR approval_gate"
    assert rows[1].lexical_query == "eu OR europe_region OR residency OR roadmap OR roadmap_support OR 承诺" and rows[1].semantic_query == asked[1]
    assert (rows[2].normalized_query, rows[2].lexical_query, rows[2].keywords) == ("the of", "the of", ["the", "of"])
    assert all((r.lexical_query, r.semantic_query, r.keywords, r.raw_query) == ("", "", [], "") for r in rows[3:5])
    assert (rows[5].semantic_query, rows[5].lexical_query) == ("show me x", "show me x")


def unit(token, dim=24):
    v = [int.from_bytes(hashlib.sha256(f"{token}:{i}".encode()).digest()[:4], "big") / 2147483648.0 - 1.0 for i in range(dim)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_embedding(spark):
    got = one(spark, "paused for legal 法", E.expanded_tokens)
    assert got == ["paused", "frozen_state", "for", "legal", "legal_review", "legal_review", "法"]
    total = [sum(x) for x in zip(*[unit(t) for t in got])]
    norm = math.sqrt(sum(x * x for x in total))
    vector = one(spark, "paused for legal 法", E.embed_text)
    assert max(abs(a - b / norm) for a, b in zip(vector, total)) < 1e-12
    assert one(spark, " ", E.embed_text) == [0.0] * 24
    assert all(abs(x - round(x, 8)) < 1e-7 for x in one(spark, "legal", lambda c: E.stored_vector(E.embed_text(c))))


def test_cosine_distance(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = row.select(E.cosine_distance(F.col("a"), F.col("b")).alias("ab"), E.cosine_distance(F.col("a"), F.col("a")).alias("aa"), E.cosine_distance(F.col("a"), F.col("z")).alias("az")).first()
    assert r.ab == 1.0 and r.aa == 0.0 and math.isnan(r.az)


TEXTS = ["", None, "abc", "a b\nc, d!", "法务 x", "é　ß豈", "x" * 9, "\x1c a"]


def test_metrics_agree_with_the_driver_form(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    rows = df.select("i", *[c.alias(k) for k, c in M.text_metrics(F.col("t")).items()]).orderBy("i").collect()
    for r, text in zip(rows, TEXTS):
        assert {k: r[k] for k in M.local_text_metrics("")} == M.local_text_metrics(text), text
    summary = M.collection_summary(df.fillna(""), "t").first().asDict()
    assert summary == M.local_collection_summary([t or "" for t in TEXTS])
    assert M.collection_summary(df.where("false"), "t").first().asDict() == M.local_collection_summary([])


def test_payload_metrics():
    got = M.payload_metrics({"b": [1, {"c": None}], "a": "é"})
    assert (got["dict_nodes"], got["list_nodes"], got["leaf_nodes"], got["top_level_type"], got["top_level_size"]) == (2, 1, 3, "dict", 2)
    assert M.json_payload({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_count_by_key(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "k string")
    assert {r.bucket: r.n for r in M.count_by_key(df, "k").collect()} == {"x": 2, "None": 1}


@pytest.mark.parametrize(
    "word, expected",
    [
        ("running", "run"), ("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("conflated", "conflat"), ("sized", "size"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"), ("predication", "predic"),
        ("hopefulness", "hope"), ("formalize", "formal"), ("triplicate", "triplic"), ("adjustable", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("generously", "generous"),
        ("communication", "communic"), ("skies", "sky"), ("news", "news"), ("inning", "inning"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("blocked", "block"), ("legal", "legal"),
        ("approval", "approv"), ("approver", "approv"), ("licenses", "licens"), ("residency", "resid"), ("is", "is"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("hoping", "hope"), ("été", "été"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_terms_have_one_canonical_term():
    members = [m for ms in SEARCH_FAMILIES.values() for m in ms]
    assert len(members) == len(set(members)) == len(SEARCH_TERMS)
    assert len(EMBEDDING_TERMS) == 56


@pytest.mark.parametrize(
    "text, plain",
    [("Straße Øre æ ł đ", "Strasse Ore ae l d"), ("Œuvre ŒIL ĳs Þing ðe", "OEuvre OEIL ijs THing de"), ("Café naïve Å", "Cafe naive A"), ("ﬁne … ½", "fine ...  1/2"), ("abc 法务", "abc 法务"), ("", "")],
)
def test_unaccent(spark, text, plain):
    assert unaccent(text) == plain
    assert spark.createDataFrame([(text,)], "t string").select(unaccented(F.col("t")).alias("u")).first().u == plain


def test_alias_expand_reads_past_the_first_sentence(spark, tmp_path):
    from lodestar.plans.queries import queries

    def following(words, terms):
        return [x for w in words for x in ([w, terms[w]] if w in terms else [w])]

    texts = {1: "One is here. Two is amber! Three is severe? four", 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.expanded for r in queries()["alias_expand"](spark, str(tmp_path)).collect()}
    words = {k: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for k, t in texts.items()}
    assert got == {k: " ".join(following(list(dict.fromkeys(following(w, SEARCH_TERMS))), EMBEDDING_TERMS)) for k, w in words.items()}
