from collections import Counter
from math import log

import duckdb
import pytest

from orbweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, epoch string"


def docs(spark):
    rows = [(k, "w" * (40 + 13 * (k % 17)), "big" if k % 3 else f"s{k % 7}", "clash") for k in range(900)]
    return spark.createDataFrame([*rows, (None, None, None, ""), (5, "", "s1", ""), (5, "", "s1", "")], SCHEMA).repartition(3)


@pytest.mark.parametrize("per_block", [mixing.PER_BLOCK, 2])
def test_repeats_against_sql(spark, monkeypatch, per_block):
    """Also with so small blocks that a source has hundreds, most of them with a head of their own."""
    sql = mixing.ORACLE.replace(f"docs / {mixing.PER_BLOCK}", f"docs / {per_block}")
    monkeypatch.setattr(mixing, "PER_BLOCK", per_block)
    df = docs(spark).filter("doc_id IS NOT NULL")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = mixing.mix(df, repeats=1.25)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def realised(few, made):
    spent, seen = Counter(), Counter()
    for r in mixing.dealt(few, made).collect():
        spent[r.source] += r.tokens
        seen[r.source, r.doc_id, r.tokens] += 1
    for r in made.sources.collect():
        assert r.budget - 100 < spent[r.source] <= r.budget
    return seen


def test_entropy(spark):
    few = mixing.light(docs(spark))
    made = mixing.plan(few, entropy=0.8)
    rows = made.sources.collect()
    h = -sum(r.weight * log(r.weight) for r in rows)
    assert abs(h - 0.8 * log(len(rows))) < 1e-4
    assert max(realised(few, made).values()) > 2


def test_no_repeats(spark):
    few = mixing.light(docs(spark))
    made = mixing.plan(few, repeats=1.0, part=0.9)
    assert all(r.budget <= r.total for r in made.sources.collect())
    seen = realised(few, made)
    assert sum(seen.values()) > 0.85 * 903
    assert max(seen.values()) <= 2  # the row that is there twice


def test_empty(spark):
    assert mixing.mix(docs(spark).limit(0), repeats=2.0).count() == 0


def test_entropy_below_that_of_the_shares(spark):
    rows = [(k, "w" * 400, s, "") for k, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 10)]
    few = mixing.light(spark.createDataFrame(rows, SCHEMA))
    made = mixing.plan(few, entropy=0.3)
    assert made.exponent > 1
    assert abs(-sum(r.weight * log(r.weight) for r in made.sources.collect()) - 0.3 * log(3)) < 1e-4
    even = mixing.light(spark.createDataFrame([r for r in rows if r[2] != "c"][30:], SCHEMA))
    with pytest.raises(ValueError, match="too even"):
        mixing.plan(even, entropy=0.5)


def test_clashing_columns(spark):
    names = ["blocks", "epochs", "rest", "block", "epoch", "doc_key", "block_key", "times", "at_block"]
    rows = [(k, "s", 5, *range(k, k + len(names))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, " + ", ".join(f"{n} long" for n in names))
    made = mixing.plan(df.select("doc_id", "source", "tokens"), repeats=1.0)
    assert sorted(tuple(r.row) for r in mixing.dealt(df, made).collect()) == rows
