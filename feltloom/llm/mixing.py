"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. A token budget is dealt from the root down: a node's share of its parent's budget
follows its weight among its siblings, but no node gets more than its capacity, the tokens below it times ``max_epochs``. What a
node cannot use goes to its siblings, by their weights, and as a parent never gets more than its children can take, only what
all siblings together cannot use has gone to the parent's own siblings: shortages are made up among siblings first, then among ancestors.
Among siblings with weights w and capacities c, the dealing is min(c, level * w) with the one level that spends the budget; it
comes from running sums in the order of c / w, which are summed range by range of that order.

A leaf's documents are put in a seeded order of their own for each epoch, and the leaf takes the shortest prefix of
epoch after epoch that reaches its budget, in tokens. Running sums are split: every epoch of a leaf is cut into ``parts``
by the hash that orders it, the parts' totals are summed first, and only within a part are single documents summed up. So a leaf
that holds a third of all rows is spread over as many tasks as it has parts.

Tokens are the words of the text. Null and empty texts, and texts without a word, weigh nothing and are taken with the first document after
them. Null domains, languages and sources are nodes of their own. Documents that repeat a doc_id are ordered by their text.
A leaf without tokens gives nothing, and an empty table an empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .quality import words_of

LEVELS = ("domain", "lang", "source")
MISSING = "\u0001"
#: Into how many parts rows that repeat each other are dealt.
PARTS = 64


@dataclass(frozen=True)
class Params:
    budget_permille: int = 900  # of the tokens there are
    max_epochs: int = 2
    #: Weights of a level's nodes by name; any other name weighs 1.
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 3, "books": 2, "code": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}})
    seed: str = "mix-1"
    part_docs: int = 10_000


def domain_of(source: Column) -> Column:
    """The domain of a source, by the last digit of its name: two fifths web, two fifths books, one fifth code."""
    last = F.substring(source, -1, 1)
    return F.when(source.isNull(), None).when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6", "7"), "books").otherwise("code")


def weight_of(level: str, p: Params) -> Column:
    named = F.lit(1)
    for name, w in sorted(p.weights.get(level, {}).items()):
        named = F.when(F.col(level) == name, F.lit(w)).otherwise(named)
    return named.cast("double")


def sibling_sums(per: DataFrame, above: list[str], level: str) -> DataFrame:
    """per with c_before and w_before, the sums over a node's siblings before it in the order of c / w, w_all and the parent's budget b_all.

    Siblings are dealt by ranges of that order, so that the millions of sources of one language are many tasks; a range adds the sums of the
    ranges before it. All sums are of whole numbers, so that where the ranges are cut doesn't change them. The ranges are written, as they have to stay what they are.
    """
    ranged = per.withColumn("ratio", F.col("c") / F.col("w"))
    ranged = written(ranged.repartitionByRange(*above, "ratio", level).withColumn("range", F.spark_partition_id()), f"mix-{level}")
    sums = ranged.groupBy(*above, "range").agg(F.sum("c").alias("c_range"), F.sum("w").alias("w_range"), F.max("b").alias("b_range"))
    earlier = W.partitionBy(*above).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(*above)
    sums = sums.select(
        *above,
        "range",
        (F.sum("c_range").over(earlier) - F.col("c_range")).alias("c_earlier"),
        (F.sum("w_range").over(earlier) - F.col("w_range")).alias("w_earlier"),
        F.sum("w_range").over(every).alias("w_all"),
        F.max("b_range").over(every).alias("b_all"),
    )
    inside = W.partitionBy(*above, "range").orderBy("ratio", level).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = ranged.withColumns({"c_inside": F.sum("c").over(inside) - F.col("c"), "w_inside": F.sum("w").over(inside) - F.col("w")}).join(sums, [*above, "range"])
    return ranged.withColumns({"c_before": F.col("c_earlier") + F.col("c_inside"), "w_before": F.col("w_earlier") + F.col("w_inside")})


def budgets(leaves: DataFrame, p: Params) -> DataFrame:
    """The leaves (domain, lang, source, tokens) with their budgets. A row for each leaf: as many as there are distinct sources and languages."""
    nodes = leaves.withColumn("cap", (F.col("tokens") * p.max_epochs).cast("double"))
    whole = nodes.agg(F.least(F.floor(F.sum("tokens") * p.budget_permille / 1000), F.sum("cap")).cast("double").alias("root")).first()
    above: list[str] = []
    budget = F.lit(whole.root or 0.0)
    for level in LEVELS:
        path = [*above, level]
        per = nodes.groupBy(*path).agg(F.sum("cap").alias("c"), F.max(budget).alias("b")).withColumn("w", weight_of(level, p))
        # With the k smallest ratios full, the rest share what is left by weight; the level is that of the first node which stays unfilled, the greatest of the unfilled ones.
        per = sibling_sums(per, above, level)
        per = per.withColumn("level", (F.col("b_all") - F.col("c_before")) / (F.col("w_all") - F.col("w_before"))).withColumn("full", F.col("c") <= F.col("level") * F.col("w"))
        cuts = per.groupBy(*above).agg(F.max(F.when(~F.col("full"), F.col("level"))).alias("cut"))
        # The cut goes to the ranges first, then to the nodes of each, so that no parent's children meet in one task.
        ranges = per.select(*above, "range").distinct()
        ranges = ranges.join(cuts, above) if above else ranges.crossJoin(F.broadcast(cuts))
        per = per.join(ranges, [*above, "range"]).withColumn(f"b_{level}", F.when(F.col("full"), F.col("c")).otherwise(F.col("cut") * F.col("w")))
        nodes = written(nodes.join(per.select(*path, f"b_{level}"), path), "mix-nodes")
        above, budget = path, F.col(f"b_{level}")
    return nodes.select(*LEVELS, "tokens", F.col("b_source").alias("budget"))


def keyed(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, the leaf, tokens, and a key that tells repeated doc_ids apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain_of(F.col("source")), F.lit(MISSING)).alias("domain"),
        F.coalesce("lang", F.lit(MISSING)).alias("lang"),
        F.coalesce("source", F.lit(MISSING)).alias("source"),
        F.size(words_of(F.col("text"))).cast("long").alias("tokens"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
    )


def selected(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each document and epoch in the mixture: doc_id, text_key, epoch, domain, lang, source, tokens."""
    rows = written(keyed(docs, p), "mix-rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    # Parts of some ten thousand documents; where they are cut doesn't change what is taken.
    most = leaves.agg(F.max("docs")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most / p.part_docs, 1), 16)))
    dealt = budgets(leaves, p)
    taken = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(p.max_epochs))))
    # An epoch of which nothing is needed is left out before any ordering; the ones before the last are needed whole.
    part = dealt.select(*LEVELS, (F.col("budget") / F.greatest("tokens", F.lit(1))).alias("epochs"), F.col("tokens").alias("leaf_tokens"), "budget")
    taken = taken.join(part, list(LEVELS)).where(F.col("epoch") - 1 < F.col("epochs"))
    order = F.md5(F.concat_ws("|", F.lit(p.seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))
    taken = taken.withColumn("h", order).withColumn("part", F.substring("h", 1, digits))
    taken = written(taken, "mix-order")
    leaf_epoch = [*LEVELS, "epoch"]
    parts = taken.groupBy(*leaf_epoch, "part").agg(F.sum("tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(W.partitionBy(*leaf_epoch).orderBy("part")) - F.col("part_tokens")
    parts = parts.select(*leaf_epoch, "part", before.alias("part_before"))
    inside = W.partitionBy(*leaf_epoch, "part").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = taken.withColumn("inside", F.sum("tokens").over(inside) - F.col("tokens")).join(parts, [*leaf_epoch, "part"])
    start = (F.col("epoch") - 1) * F.col("leaf_tokens") + F.col("part_before") + F.col("inside")
    return running.where(start < F.col("budget")).select("doc_id", "text_key", "epoch", *LEVELS, "tokens")


def mixed(docs: DataFrame, p: Params = Params(max_epochs=1)) -> DataFrame:
    """docs as often as the mixture takes them, with their own columns.

    Rows that are alike in doc_id, text, source and language can't be told apart by the mixture: of such repeated rows as many are taken as it holds,
    the first of each epoch. They are numbered only where there are several, so that no other row is put in order.
    """
    cols = docs.columns
    keys = ["k_id", "k_text", "k_source", "k_lang"]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    own = own.withColumns({"k_id": F.col(f"c{cols.index('doc_id')}").cast("long"), "k_text": F.md5(F.coalesce(f"c{cols.index('text')}", F.lit(""))), "k_source": F.coalesce(f"c{cols.index('source')}", F.lit(MISSING)), "k_lang": F.coalesce(f"c{cols.index('lang')}", F.lit(MISSING))})
    picks = selected(docs, p).groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"), F.col("source").alias("k_source"), F.col("lang").alias("k_lang")).agg(F.count("*").alias("n"))
    of = own.groupBy(*keys).agg(F.count("*").alias("of"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    taken = written(picks.join(of, same(picks, of)).select(*[picks[k] for k in keys], "n", "of"), "mix-taken")

    def joined(which: str) -> DataFrame:
        part = taken.where(which)
        return own.join(part, same(own, part)).select(*[own[f"c{i}"] for i in range(len(cols))], *[own[k] for k in keys], "n", "of")

    single = joined("of = 1").withColumn("times", F.col("n"))
    # Row k of ``of`` alike, from 0, is taken in every epoch that reaches it: n = q * of + r makes q + 1 of the first r, and q of the others.
    # They are numbered in parts, each after the rows of the parts before it, so that a row repeated ever so often is spread over tasks.
    several = written(joined("of > 1").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "mix-repeated")
    sizes = several.groupBy(*keys, "part").agg(F.count("*").alias("rows"))
    before = sizes.select(*[F.col(k).alias(f"b_{k}") for k in [*keys, "part"]], (F.sum("rows").over(W.partitionBy(*keys).orderBy("part")) - F.col("rows")).alias("before"))
    placed = several.withColumn("k", F.row_number().over(W.partitionBy(*keys, "part").orderBy(F.lit(0))) - 1)
    placed = placed.join(before, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in [*keys, "part"]]).withColumn("k", F.col("k") + F.col("before"))
    several = placed.select(*[F.col(f"c{i}") for i in range(len(cols))], *keys, "n", "of", (F.floor(F.col("n") / F.col("of")) + (F.col("k") < F.col("n") % F.col("of")).cast("long")).alias("times"))
    out = single.union(several).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    out = selected(table(spark, sf_dir, "documents"))
    missing = lambda c: F.when(F.col(c) == MISSING, None).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", F.col("epoch").cast("int").alias("epoch"), *map(missing, LEVELS), "tokens")


def oracle(p: Params = Params()) -> str:
    """The same mixture by plain running sums in DuckDB."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(p.weights.get(level, {}).items()))
        return f"(CASE {cases} ELSE 1 END)::DOUBLE" if cases else "1::DOUBLE"

    steps, above, budget, source = [], [], "root", "nodes"
    for level in LEVELS:
        path = [*above, level]
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        on = ", ".join(path)
        steps.append(f"""
    g_{level} AS (SELECT {on}, sum(cap) AS c, max({budget}) AS b, {weight(level)} AS w FROM {source} GROUP BY {on}),
    r_{level} AS (SELECT *, (b - (sum(c) OVER ({by} ORDER BY c / w, {level} ROWS UNBOUNDED PRECEDING) - c)) / (sum(w) OVER ({by}) - (sum(w) OVER ({by} ORDER BY c / w, {level} ROWS UNBOUNDED PRECEDING) - w)) AS lev FROM g_{level}),
    l_{level} AS (SELECT *, max(CASE WHEN c > lev * w THEN lev END) OVER ({by}) AS cut FROM r_{level}),
    n_{level} AS (SELECT s.*, CASE WHEN l.c <= l.lev * l.w THEN l.c ELSE l.cut * l.w END AS b_{level} FROM {source} s JOIN l_{level} l USING ({on})),""")
        above, budget, source = path, f"b_{level}", f"n_{level}"
    return f"""
    WITH k AS (SELECT doc_id, CASE WHEN source IS NULL THEN chr(1) WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6', '7') THEN 'books' ELSE 'code' END AS domain,
                      coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source,
                      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens, md5(coalesce(text, '')) AS text_key FROM documents),
    leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM k GROUP BY ALL),
    nodes AS (SELECT *, (tokens * {p.max_epochs})::DOUBLE AS cap, least(floor(sum(tokens) OVER () * {p.budget_permille} / 1000), sum(tokens * {p.max_epochs}) OVER ())::DOUBLE AS root FROM leaf),
    {"".join(steps)}
    e AS (SELECT k.*, unnest(generate_series(1, {p.max_epochs})) AS epoch FROM k),
    o AS (SELECT e.*, n.tokens AS leaf_tokens, n.b_source AS budget, md5(concat_ws('|', '{p.seed}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''), text_key)) AS h FROM e JOIN n_source n USING (domain, lang, source)),
    s AS (SELECT *, (epoch - 1) * leaf_tokens + sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM o)
    SELECT doc_id, epoch::INTEGER AS epoch, nullif(domain, chr(1)) AS domain, nullif(lang, chr(1)) AS lang, nullif(source, chr(1)) AS source, tokens FROM s WHERE start < budget
    """
