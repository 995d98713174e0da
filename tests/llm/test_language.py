from collections import Counter, defaultdict
from math import log2

import numpy as np
from pyspark.sql import functions as F

from orbweave.llm.language import _PAD, ORDER, Lookup, Trees, grams, identify, keep, learn, normalized
from orbweave.llm.store import fold


def trees_of(samples):
    out = []
    for texts in samples.values():
        g = grams(np.frombuffer(b"".join(_PAD + normalized(t) for t in texts), np.uint8))
        key, n = np.unique(g[(g & np.uint64(255)) > 0], return_counts=True)
        out.append((key, n.astype(float)))
    return Trees(list(samples), out)


def brute(text, texts):
    tree = defaultdict(Counter)
    for t in texts:
        d = _PAD + normalized(t)
        for i in range(ORDER, len(d)):
            for k in range(ORDER + 1):
                tree[d[i - k : i]][d[i]] += 1
    d, total = _PAD + normalized(text), 0.0
    for i in range(ORDER, len(d)):
        for k in range(ORDER, -1, -1):
            c = tree.get(d[i - k : i])
            if not c:
                continue
            n, kinds = sum(c.values()), len(c)
            if d[i] in c:
                total -= log2(c[d[i]] / (n + kinds))
                break
            total -= log2(kinds / (n + kinds))
        else:
            total += 8
    return total


SAMPLES = {"de": ["Das ist ein Satz über die Straße.", "Und noch ein Satz"], "en": ["This is a sentence about the street.", "And one more sentence"]}


def test_code_lengths_are_exact():
    trees = trees_of(SAMPLES)
    for text in ["The sentence", "Die Straße", "zzz ქართული 12", "a"]:
        got = trees.lengths([normalized(text), b"", normalized("more")])
        for k, texts in enumerate(SAMPLES.values()):
            assert abs(got[0, k] - brute(text, texts)) < 1e-3
        assert not got[1].any()


def test_lookup():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64)
    keys = np.unique(keys)
    find = Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all()
    assert (find(keys ^ np.uint64(1 << 41)) == -1).all()
    assert (Lookup(keys[:0])(keys[:3]) == -1).all()


def test_identify(spark):
    rows = [(k, t, lang, "clash") for k, (lang, t) in enumerate((x, f"{t} {n}") for n in range(20) for x, ts in SAMPLES.items() for t in ts)]
    odd = [(900, None, "de", ""), (901, "", "de", ""), (902, "12 !? ½", "en", ""), (903, "ein Satz " * 30_000, None, ""), (None, "about the sentence", "en", "")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    held = fold(F.col("doc_id"), 3) == 1
    trees = learn(df.filter(~held))
    got = {r.doc_id: r for r in identify(df, trees, held).collect()}
    assert all(got[k].lang_pred == lang and 0.5 < got[k].score <= 1 for k, _, lang, _ in rows)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert (got[903].lang_pred, got[None].lang_pred) == ("de", "en")
    kept = keep(df, trees, 0.5)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) + 2
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert learn(none) is None
    assert {r.lang_pred for r in identify(none, None, held).collect()} == {"und"}
    assert identify(df.limit(0), trees, held).count() == 0


def test_foreign_scripts_are_rejected(spark):
    """The score can't tell them, as one language is always the likeliest; their code lengths can."""
    rows = [(k, "the of and to in that it was for on are as with his they " * 3, "en") for k in range(20)] + [(100 + k, "der die und in den von zu das mit sich des auf für ist im " * 3, "de") for k in range(20)]
    odd = [(900, "это обычный русский текст без латинских букв", "x"), (901, "東京は日本の首都であり最大の都市です", "x"), (902, None, "x"), (903, "", "x"), (904, "12 ---", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = learn(docs)
    both = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    assert {r.doc_id for r in keep(both, known, 0.5).collect()} == {r[0] for r in rows}
    assert keep(docs.limit(0), known, 0.5).count() == 0
