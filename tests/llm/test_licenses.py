import random
import re

from lodestar.llm.licenses import BASE_PHRASES, NOTICES, Template, default_templates, scan_licenses

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    found = [(i, label) for phrase, label in BASE_PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r


def test_notice_with_a_word_changed_and_one_left_out(spark):
    text = "x Permission is hereby granted, free of charge, to any person getting a copy of this software and documentation files"
    r = scan_licenses(spark.createDataFrame([(1, text), (2, "permission is granted to nobody")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "mit" and 0.6 <= r[0].score < 1 and r[0].n_base == 0
    assert r[1].labels == "" and r[1].score == 0


def test_empty_table(no_docs):
    assert scan_licenses(no_docs).count() == 0


def labels(spark, texts, **options):
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).orderBy("doc_id").collect()
    return [r.labels.split(",") if r.labels else [] for r in rows], rows


def test_no_label_is_lost_by_repetition(spark):
    texts = [" ".join([notice] * n) for notice, _ in NOTICES for n in (1, 2, 3, 40)] + [" and ".join([notice] * 3) for notice, _ in NOTICES]
    wanted = [label for _, label in NOTICES for _ in range(4)] + [label for _, label in NOTICES]
    got, rows = labels(spark, texts)
    assert all(w in g for w, g in zip(wanted, got)) and all(r.score == 1 for r in rows)
    assert [r.n_spans for r in rows if r.labels == "all-rights-reserved"] == [1, 2, 3, 40, 3]


def voter(text, shift=8, cover=0.6):
    """Labels by trying, for every diagonal of every template, which of its k-grams stand on it or a little further on."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))
    found = set()
    for t in default_templates():
        n = len(t.words) - t.k + 1
        for d in range(-n, len(words)):
            on = lambda j, e: 0 <= d + e + j <= len(words) - t.k and tuple(words[d + e + j : d + e + j + t.k]) == t.words[j : j + t.k]
            held = sum(any(on(j, e) for e in range(shift + 1)) for j in range(n))
            if any(on(j, 0) for j in range(n)) and (held == n and all(on(j, 0) for j in range(n)) if t.base else held >= cover * n):
                found.add(t.label)
    return sorted(found)


def test_broken_notices_against_a_voter_that_tries_all(spark):
    pick = random.Random(6)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(pick.randint(1, 3)):
            words += [pick.choice("a b license the".split())] * pick.randint(0, 4)
            for w in pick.choice(NOTICES)[0].split():
                words += [] if pick.random() < 0.06 else [w, "x"] if pick.random() < 0.06 else [w]
        texts.append(" ".join(words))
    assert labels(spark, texts)[0] == [voter(t) for t in texts]


def test_templates_of_any_length(spark):
    words = tuple(f"w{i}" for i in range(300))
    long = [Template("long", words, False, 3)]
    half, most = words[:100] + ("x",) * 3 + words[250:], words[:90] + ("x",) + words[95:270]
    assert labels(spark, [" ".join(words), " ".join(half), " ".join(most)], templates=long)[0] == [["long"], [], ["long"]]
