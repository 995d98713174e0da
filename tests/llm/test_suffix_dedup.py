import hashlib
import random

import pytest

from orbweave.llm import induced, suffix_dedup
from orbweave.llm.suffix_dedup import digest, without_repeats

LENGTH, K = 40, 16


def brute(texts, length):
    seen = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "Ana", "ß", "ion", "xy", "é", "nd"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    passages = [make(14) for _ in range(4)]
    texts = [make(30) + passages[k % 4] + make(rng.randrange(20)) for k in range(40)]
    texts += [passages[0][: k + 30] + make(3) for k in range(20)]
    return [*texts, texts[0], texts[0], None, "", "short", "short", "ab" * 100, "For " * 60, "x" * 39, "x" * 40]


@pytest.mark.parametrize(("hot", "matcher"), [(2, suffix_dedup.hashed_matcher), (256, suffix_dedup.hashed_matcher), (256, induced.matcher)])
def test_digest_against_brute_force(spark, monkeypatch, hot, matcher):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in digest(df, LENGTH, K, matcher).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = brute([(t or "").encode() for t in texts], LENGTH)
    for k, (n, removed, spans, rest) in enumerate(want):
        assert got[k] == (n, removed, spans, hashlib.sha256(rest).hexdigest()), texts[k]
    assert sum(w[1] for w in want) > 2000


def test_without_repeats_keeps_rows_and_columns(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.source) for r in without_repeats(df, LENGTH, K).collect()}
    want = brute([(t or "").encode() for t in texts], LENGTH)
    for k, t in enumerate(texts):
        rest = None if t is None else want[k][3].decode("utf-8", "ignore")
        assert got[k] == (rest, f"s{k}")


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a" * 50), (1, "b" * 30), (None, "a" * 50)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in digest(df, LENGTH, K).collect()), key=str)
    assert got == [(1, 0), (1, 50), (None, 50)]
    assert digest(df.limit(0), LENGTH, K).count() == 0


def test_clashing_columns(spark):
    from orbweave.llm.suffix_dedup import without_repeats

    rows = [(1, "x" * 30 + "same passage of thirty bytes!!", 1, 2, None, "a"), (2, "y" * 30 + "same passage of thirty bytes!!", 3, 4, [1], "b"), (3, None, 5, 6, [], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 int, K2 long, _ranges array<int>, _Copied string")
    got = sorted(tuple(r) for r in without_repeats(df, length=24, k=8).collect())
    assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in rows]
    assert all("passage" not in (r[1] or "") for r in got)


def test_query_against_brute_force(spark):
    """op4 as it is registered, over a whole table: every column equal to what windows counted in plain Python give."""
    import hashlib

    import __spark_entry__ as entry

    at = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    seen = {}
    for text in docs.values():
        for a in range(len(text) - 399):
            h = hash(text[a : a + 400])
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for d, text in docs.items():
        gone = bytearray(len(text))
        for a in range(len(text) - 399):
            if seen[hash(text[a : a + 400])] > 1:
                gone[a : a + 400] = b"\1" * 400
        rest = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        want[d] = (len(text), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op4_suffix_array_dedup"](spark, at).collect()}
    assert got == want
    assert sum(r[1] for r in want.values()) > 10_000
