"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

A source with token share ``q`` gets the weight ``q^a / sum(q^a)``. The exponent ``a`` is searched, in [0, 1] or, for an
entropy below that of the shares, above 1, so that the weights have a target entropy (a share of the largest possible one), or so that they are as even
as they can be while no source's budget repeats it more than ``repeats`` times. Each step of the search is one
aggregation over the sources that tries ``GRID`` exponents at once; sources are never collected.

A source's budget is its weight times all tokens to spend. It is spent in epochs. Every epoch deals the
source's documents in its own order: blocks (about ``PER_BLOCK`` documents by a hash of the id) by a hash of epoch and
block, and a block's documents by a hash of epoch and id. Full epochs take every document; the last takes documents in
order as long as they fit, or, on request, if it is the only one, all that start within the budget, so that no source is
left out and rounding loses no document. Prefix sums run over the 4096 ``HEAD``s (first digits) of a source's block
hashes, over the blocks of the one where the budget ends, and within the one block there, so a source of any size is
dealt without bringing it together.

Tokens of a document: one, and one for every four bytes of UTF-8. Edge cases: null and empty texts have one
token; a null source is a source of its own; rows with null or repeated ids are documents of their own,
ordered by their tokens; no documents give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orbweave.llm.store import Written

GRID = 64
ROUNDS = 5
PER_BLOCK = 256
#: Hexadecimal digits of a block's hash that its head has.
HEAD = 3
NONE = "\x01none"


def tokens(text: Column) -> Column:
    return F.lit(1).cast("long") + F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _hash(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _block(doc: Column, n: Column, seed: int) -> Column:
    return F.pmod(F.conv(F.substring(_hash(seed, doc), 1, 8), 16, 10).cast("long"), n)


@dataclass
class Plan:
    """``sources``: source, docs, total, blocks, weight, budget, epochs, rest; ``exponent``; ``spent``: the tokens to spend."""

    sources: DataFrame
    exponent: float
    spent: int


def plan(light: DataFrame, entropy: float | None = None, repeats: float | None = None, part: float = 1.0) -> Plan | None:
    """Weights and budgets for ``light`` (doc_id, source, tokens); ``None`` without documents.

    Just one of ``entropy`` (0 to 1, a share of the largest possible) and ``repeats`` (``part`` or more). ``part``: the
    tokens to spend, as a share of all tokens; with ``repeats=1`` and less than all, no document is taken twice. An
    entropy that no exponent reaches, as where the largest sources are equal, raises.
    """
    if (entropy is None) == (repeats is None) or (repeats is not None and repeats < part) or (entropy is not None and not 0 <= entropy <= 1):
        raise ValueError("give one of entropy (0 to 1) and repeats (of at least part)")
    sources = Written(light.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total")), "sources").df
    facts = sources.agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.min("total").alias("least"), F.max("total").alias("most")).first()
    if not facts["n"]:
        return None
    all_tokens = int(facts["total"])
    share = F.col("total") / F.lit(float(all_tokens))
    relative = F.col("total") / F.lit(float(facts["most"]))  # the same weights, and no power of the largest vanishes

    def tried(a: float) -> list[Column]:
        p = F.pow(share if a <= 1 else relative, F.lit(a))
        return [F.sum(p), F.sum(p * F.log(p))]

    def even_enough(a: float, row, k: int) -> bool:
        """Whether the exponent ``a`` meets the condition that all larger ones meet too."""
        norm, plog = row[2 * k], row[2 * k + 1]
        if repeats is not None:
            worst = max((facts["least"] / all_tokens) ** (a - 1), (facts["most"] / all_tokens) ** (a - 1)) / norm
            return worst * part <= repeats
        return math.log(norm) - plog / norm <= entropy * math.log(facts["n"]) + 1e-12

    lo, step, exponent = 0.0, 1.0 / GRID, 1.0
    if entropy is not None and not even_enough(1.0, sources.agg(*tried(1.0)).first(), 0):
        ends = [2.0**k for k in range(1, 13)]
        row = sources.agg(*[c for a in ends for c in tried(a)]).first()
        end = next((a for k, a in enumerate(ends) if even_enough(a, row, k)), None)
        if end is None:
            raise ValueError(f"no exponent gives these sources an entropy of {entropy} of the largest: the largest ones are too even")
        lo, step, exponent = end / 2, end / 2 / GRID, end
    for _ in range(ROUNDS):
        grid = [lo + k * step for k in range(GRID + 1)]
        row = sources.agg(*[c for a in grid for c in tried(a)]).first()
        k = next((k for k, a in enumerate(grid) if even_enough(a, row, k)), GRID)
        exponent = grid[k]
        if k == 0:
            break
        lo, step = grid[k - 1], step / GRID
    power = F.pow(share if exponent <= 1 else relative, F.lit(exponent))
    norm = sources.agg(F.sum(power)).first()[0]
    weighted = sources.withColumn("weight", F.round(power / F.lit(norm), 12))
    spend = int(part * all_tokens)
    budget = F.floor(F.col("weight") * F.lit(float(spend))).cast("long")
    planned = (
        weighted.withColumn("blocks", F.ceil(F.col("docs") / PER_BLOCK).cast("long"))
        .withColumn("budget", budget)
        .withColumn("epochs", F.floor(F.col("budget") / F.col("total")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("total"))
    )
    return Plan(Written(planned, "plan").df, exponent, spend)


def light(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), tokens(F.col("text").cast("string")).alias("tokens"))


def cuts(rows: DataFrame, made: Plan, seed: int, started: bool = False) -> DataFrame:
    """(source, epochs, at_block, at_doc, at_tokens): the last document of each source's last epoch, by its place in that order.

    ``rows``: doc_id, source, tokens, and the plan's columns. Sources whose last epoch takes nothing have nulls.
    ``started``: see ``dealt``.
    """
    if started:
        rows = rows.withColumn("rest", F.when(F.col("epochs") == 0, F.greatest("rest", F.lit(1))).otherwise(F.col("rest")))
    placed = rows.withColumn("block", _block(F.coalesce("doc_id", F.lit(-1)), F.col("blocks"), seed))
    sums = Written(placed.groupBy("source", "epochs", "rest", "block").agg(F.sum("tokens").alias("sum")).withColumn("block_key", _hash(seed, F.col("epochs"), F.col("source"), F.col("block"))).withColumn("head", F.substring("block_key", 1, HEAD)), "blocks").df
    ends_here = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))

    def summed(window: WindowSpec) -> Column:
        return F.coalesce(F.sum("sum").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    heads = sums.groupBy("source", "rest", "head").agg(F.sum("sum").alias("sum"))
    heads = heads.withColumn("before", summed(Window.partitionBy("source").orderBy("head"))).filter(ends_here)
    near = sums.join(heads.select("source", "head", F.col("before").alias("ahead")), ["source", "head"])
    dealt = near.withColumn("before", F.col("ahead") + summed(Window.partitionBy("source", "head").orderBy("block_key", "block")))
    cut = dealt.filter(ends_here).select("source", "block", "block_key", "before")
    one = placed.join(cut, ["source", "block"]).withColumn("doc_key", _hash(seed, F.col("epochs"), F.coalesce("doc_id", F.lit(-1))))
    upto = Window.partitionBy("source", "block").orderBy("doc_key", "tokens").rangeBetween(Window.unboundedPreceding, 0)
    within = F.col("before") + F.sum("tokens").over(upto) <= F.col("rest")
    if started:
        ahead = Window.partitionBy("source", "block").orderBy("doc_key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        starts = F.col("before") + F.coalesce(F.sum("tokens").over(ahead), F.lit(0))
        within = F.when(F.col("epochs") == 0, starts < F.col("rest")).otherwise(within)
    inside = one.withColumn("within", within).filter("within")
    last = inside.groupBy("source").agg(F.max(F.struct("doc_key", "tokens")).alias("last"))
    return cut.join(last, "source", "left").select("source", F.col("block_key").alias("at_block"), F.col("last.doc_key").alias("at_doc"), F.col("last.tokens").alias("at_tokens"))


def dealt(rows: DataFrame, made: Plan, seed: int = 7, started: bool = False) -> DataFrame:
    """(doc_id, source, tokens, row, epoch, block, block_key, doc_key): each of ``rows`` once for every time that it is taken.

    ``rows`` has doc_id, source, tokens and others of any name; ``row`` holds all of them as they were. ``started``: of
    a source that isn't taken whole even once, the document in which its budget ends is taken too.
    """
    rows = rows.select("doc_id", "source", "tokens", F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    planned = made.sources.select("source", "blocks", "epochs", "rest")
    known = rows.join(planned, "source")
    end = Written(cuts(known.select("doc_id", "source", "tokens", "blocks", "epochs", "rest"), made, seed, started), "cuts").df
    each = known.join(end, "source", "left").withColumn("block", _block(F.coalesce("doc_id", F.lit(-1)), F.col("blocks"), seed))
    last_block = _hash(seed, F.col("epochs"), F.col("source"), F.col("block"))
    last_doc = _hash(seed, F.col("epochs"), F.coalesce("doc_id", F.lit(-1)))
    fits = (last_block < F.col("at_block")) | ((last_block == F.col("at_block")) & ((last_doc < F.col("at_doc")) | ((last_doc == F.col("at_doc")) & (F.col("tokens") <= F.col("at_tokens")))))
    times = F.col("epochs") + F.when(F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    taken = each.withColumn("times", times).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return (
        taken.withColumn("block_key", _hash(seed, F.col("epoch"), F.col("source"), F.col("block")))
        .withColumn("doc_key", _hash(seed, F.col("epoch"), F.coalesce("doc_id", F.lit(-1))))
        .drop("blocks", "epochs", "rest", "at_block", "at_doc", "at_tokens", "times")
    )


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, part: float = 1.0, seed: int = 7) -> DataFrame:
    """(source, epoch, block, block_key, doc_id, tokens, place): the documents (doc_id, text, source) taken, in dealt order.

    Blocks of an epoch are in the order of block_key; ``place`` counts a block's documents from 1.
    """
    few = Written(light(docs), "light").df
    made = plan(few, entropy, repeats, part)
    if made is None:
        return few.select("source", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit("").alias("block_key"), "doc_id", "tokens", F.lit(0).alias("place"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("doc_key", "tokens")
    return dealt(few, made, seed).withColumn("place", F.row_number().over(inside)).select("source", "epoch", "block", "block_key", "doc_id", "tokens", "place")


#: ``mix(documents, repeats=1.25)`` in DuckDB's SQL.
ORACLE = f"""
WITH RECURSIVE light AS MATERIALIZED (
  SELECT doc_id, coalesce(source, chr(1) || 'none') AS source, (1 + strlen(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents
), s AS MATERIALIZED (
  SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS total FROM light GROUP BY source
), t AS MATERIALIZED (
  SELECT sum(total)::DOUBLE AS everything, min(total) AS least, max(total) AS most FROM s
), e(step_no, lo, step, a, stop) AS (
  SELECT 0, 0.0::DOUBLE, (1.0 / {GRID})::DOUBLE, 1.0::DOUBLE, false
  UNION ALL
  SELECT step_no + 1, CASE WHEN k = 0 THEN lo ELSE lo + (k - 1) * step END, step / {GRID}, lo + k * step, k = 0
  FROM (
    SELECT step_no, lo, step, coalesce(min(k) FILTER (ok), {GRID}) AS k
    FROM (
      SELECT e.step_no, e.lo, e.step, g.k,
        greatest(pow(any_value(t.least) / any_value(t.everything), e.lo + g.k * e.step - 1), pow(any_value(t.most) / any_value(t.everything), e.lo + g.k * e.step - 1))
          / sum(pow(s.total / t.everything, e.lo + g.k * e.step)) <= 1.25 AS ok
      FROM e, (SELECT unnest(generate_series(0, {GRID})) AS k) g, s, t
      WHERE e.step_no < {ROUNDS} AND NOT e.stop
      GROUP BY e.step_no, e.lo, e.step, g.k
    ) GROUP BY step_no, lo, step
  )
), x AS MATERIALIZED (
  SELECT a FROM e ORDER BY step_no DESC LIMIT 1
), w AS (
  SELECT s.*, round(pow(total / everything, a) / sum(pow(total / everything, a)) OVER (), 12) AS weight, everything FROM s, t, x
), b AS (
  SELECT *, floor(weight * everything)::BIGINT AS budget, ceil(docs / {PER_BLOCK})::BIGINT AS blocks FROM w
), p AS MATERIALIZED (
  SELECT source, blocks, budget // total AS epochs, budget % total AS rest FROM b
), d AS MATERIALIZED (
  SELECT light.*, epochs, rest, ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % blocks AS block FROM light JOIN p USING (source)
), last_blocks AS (
  SELECT source, block, coalesce(sum(sum(tokens)) OVER (PARTITION BY source ORDER BY md5('7:' || any_value(epochs) || ':' || source || ':' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, block
), last_epoch AS (
  SELECT d.*, before + sum(tokens) OVER (PARTITION BY d.source, d.block ORDER BY md5('7:' || epochs || ':' || doc_id), tokens) AS upto
  FROM d JOIN last_blocks USING (source, block)
), taken AS (
  SELECT source, block, doc_id, tokens, unnest(generate_series(0, epochs - 1)) AS epoch FROM d WHERE epochs > 0
  UNION ALL
  SELECT source, block, doc_id, tokens, epochs FROM last_epoch WHERE upto <= rest
)
SELECT source, epoch, block, md5('7:' || epoch || ':' || source || ':' || block) AS block_key, doc_id, tokens,
  row_number() OVER (PARTITION BY source, epoch, block ORDER BY md5('7:' || epoch || ':' || doc_id), tokens)::INTEGER AS place
FROM taken
"""
