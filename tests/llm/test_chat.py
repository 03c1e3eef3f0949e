from lodestar.llm.chat import documents, perspectives

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 3, "cat", "tie"), (1, 3, "cat", "tie"),
    (2, None, None, "no turn"), (2, 5, "ann", "é"), (None, 1, "ann", "no conversation"), (3, 0, "system", "alone"), (1, 700, "bob", "late"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    out = []
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
        for who in {t[2] or "unknown" for t in mine} - {"system"}:
            at = 0
            for n, (_, _, role, text) in enumerate(mine):
                role = role or "unknown"
                chat = "system" if role == "system" else "assistant" if role == who else "user"
                body = f"<|{chat}|>\n" + (f"{role}: " if chat == "user" else "") + (text or "") + "\n"
                out.append((conv, who, n, role, chat, body, at, at + len(body), int(chat == "assistant")))
                at += len(body)
    return sorted(out, key=str)


def test_every_perspective(spark):
    turns = spark.createDataFrame(TURNS, SCHEMA).selectExpr("*", "1 AS block", "2 AS speaker", "3 AS start")
    for block in (256, 2):
        assert sorted((tuple(r) for r in perspectives(turns, block=block).collect()), key=str) == brute(TURNS)


def test_documents(spark):
    rotated = perspectives(spark.createDataFrame(TURNS, SCHEMA))
    r = documents(rotated).where("conv_id = 1 AND perspective = 'bob'").first()
    assert [r.text[s.start : s.stop] for s in r.spans] == ["<|assistant|>\nHello\n", "<|assistant|>\nlate\n"]
    assert r.text.startswith("<|system|>\nBe kind.\n<|user|>\nann: Hi\n")


def test_empty(spark):
    assert perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
