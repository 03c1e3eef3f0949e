import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.packing import WordEncoder, pack_documents, plan, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_plan_places_every_piece_in_few_sequences():
    random = np.random.default_rng(1)
    for n, low, high in ((1, 1, 64), (50, 1, 64), (4000, 1, 64), (4000, 20, 40)):
        counts = np.bincount(random.integers(low, high + 1, n), minlength=65)
        groups = plan(counts, 64)
        placed = np.zeros(65, dtype=int)
        for m, lengths in groups:
            assert 0 < sum(lengths) <= 64 and m > 0
            for v in lengths:
                placed[v] += m
        assert (placed == counts).all()
        if (low, high) == (1, 64) and n > 1000:
            assert sum(m for m, _ in groups) <= 1.02 * (counts @ np.arange(65)) / 64 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aBé' s!12<|>ßİΣ\n", max_size=40) | st.just("a <|endoftext|> b"))
def test_words_encode_like_whole_texts(text):
    encoder = WordEncoder(PATH)
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(docs, no_docs):
    encode = Tokenizer.from_file(PATH)
    packed = pack_documents(docs, with_ids=True)
    rows = packed.collect()
    expected = []
    for r in docs.collect():
        ids = encode.encode(r.text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected.append((r.doc_id or -1, n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.sequence_id: len(r.ids) for r in sequences(packed).collect()} == {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    assert pack_documents(no_docs).count() == 0
