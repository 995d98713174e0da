import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbweave.llm.packing import Encoder, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b   c \n d\t e", " lead", "tail  ", "x\n y\r\n z", "don't 'll  1 2", "<|endoftext|> hi<|endoftext|>", "\x85 a b", "é ñ 漢字 🙂", "a" * 3000, " " * 1500, "x!!??##", ""]


def test_encoder_gives_the_library_ids():
    tok, ours = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in ODD:
        assert np.frombuffer(ours(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece(counts):
    got, bins = Counter(), 0
    for lengths, n in plan(counts, 64):
        assert sum(lengths) <= 64
        assert sum(s > 64 // 3 for s in lengths) <= 2
        bins += n
        for s in lengths:
            got[s] += n
    assert got == Counter(counts)
    assert bins <= 1 + 1.5 * sum(s * n for s, n in counts.items()) / 32


def test_pack(spark):
    texts = [*ODD, None, "word " * 4000, "same text", "same text"]
    docs = [(i if i != 3 else 2, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, sequence_id string").repartition(3)
    rows = pack(df, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t, _ in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if not k else 1024
            want[d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= sum(r.length for r in rows) // 1024 + 1
    assert pack(df.limit(0), PATH).count() == 0
