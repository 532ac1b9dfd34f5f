"""Mixing sources to target weights by hierarchical budgets.

A tree of domains, languages and sources carries weights at each level.  The token budget runs down the tree:
every node shares what it gets among its children by weight, but no child gets more than its sources can give in
``max_epochs`` passes; what one child cannot take goes to its siblings, and only what a whole subtree cannot
take reaches the siblings of its ancestors.  A leaf then takes its documents in a seeded order, new in every
epoch, until its budget is reached.

The leaf tables have a row per leaf.  The place where a leaf's last epoch ends is found from token sums of key
ranges, so no leaf is ever ordered as a whole, however large; whether a row is taken is then a comparison on the row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrid.llm import textscan as S
from hourgrid.llm.scratch import Scratch

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 4
SEED = 17
#: Bits of the order key that name a key range.
RANGE_BITS = 12
#: Leaf tables are sent to every executor up to this many rows, and joined by shuffle beyond.
BROADCAST_LEAVES = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def with_token_counts(docs: DataFrame, keep: Sequence[str], name: str = "__tokens") -> DataFrame:
    """The columns ``keep`` and the number of words of the whole text (null: none)."""
    keep = list(keep)
    picked = docs.select(*keep, F.col("text").alias("__counted"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.drop("__counted").schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = part.select(keep)
            for first, scan in S.slices(part.column("__counted")):
                counts = S.per_row(scan.words()[2], scan.rows)
                yield pa.RecordBatch.from_arrays([*held.slice(first, scan.rows).columns, pa.array(counts)], [*keep, name])

    return picked.mapInArrow(batches, f"{fields}`{name}` long")


def shared_out(nodes: DataFrame, parent: Sequence[str], order: Sequence[str], weight: str, cap: str, total: str, name: str) -> DataFrame:
    """Adds ``name``: the share of each node in its parent's ``total``, by weight and at most ``cap``.

    Children are taken in the order of cap over weight: while a child's cap is below its fair share of what is
    left, it is filled; the others share the rest by weight.
    """
    live = (F.col(weight) > 0) & (F.col(cap) > 0)
    c, w = F.when(live, F.col(cap)).otherwise(0.0), F.when(live, F.col(weight)).otherwise(0.0)
    nodes = nodes.withColumn("__c", c.cast("double")).withColumn("__w", w.cast("double"))
    ratio = F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")).otherwise(F.lit(float("inf")))
    all_ = W.partitionBy(*parent)
    before = all_.orderBy(ratio, *order).rowsBetween(W.unboundedPreceding, -1)
    left = F.col(total) - F.coalesce(F.sum("__c").over(before), F.lit(0.0))
    weights = F.sum("__w").over(all_) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    nodes = nodes.withColumn("__full", (F.col("__w") > 0) & (ratio * weights <= left))
    rest = F.col(total) - F.sum(F.when(F.col("__full"), F.col("__c")).otherwise(0.0)).over(all_)
    open_ = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w"))).over(all_)
    share = F.when(F.col("__full"), F.col("__c")).when(F.col("__w") > 0, F.col("__w") * F.greatest(rest, F.lit(0.0)) / open_).otherwise(0.0)
    return nodes.withColumn(name, share).drop("__c", "__w", "__full")


def budgets(leaves: DataFrame, budget: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens and a weight column for each level) with ``budget`` in tokens."""
    at = leaves.withColumn("__cap", F.when(F.col("source_weight") > 0, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    langs = at.groupBy("domain", "lang").agg(F.sum("__cap").alias("__cap"), F.max("lang_weight").alias("lang_weight"), F.max("domain_weight").alias("domain_weight"))
    langs = langs.withColumn("__cap", F.when(F.col("lang_weight") > 0, F.col("__cap")).otherwise(0.0))
    domains = langs.groupBy("domain").agg(F.sum("__cap").alias("__cap"), F.max("domain_weight").alias("domain_weight")).withColumn("__total", F.lit(float(budget)))
    domains = shared_out(domains, [], ["domain"], "domain_weight", "__cap", "__total", "__got")
    langs = langs.join(domains.select("domain", F.col("__got").alias("__total")), "domain")
    langs = shared_out(langs, ["domain"], ["lang"], "lang_weight", "__cap", "__total", "__got")
    out = at.join(langs.select("domain", "lang", F.col("__got").alias("__total")), ["domain", "lang"])
    out = shared_out(out, ["domain", "lang"], ["source"], "source_weight", "__cap", "__total", "__got")
    return out.select(*leaves.columns, F.floor(F.col("__got") + 1e-6).cast("long").alias("budget"))


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id)


def default_tree(leaves: DataFrame, flatten: float = 0.7, domains: int = 4) -> DataFrame:
    """Weights for every (lang, source) with tokens: sources fall into domains by a hash of their name, and each
    node weighs its tokens to the power ``flatten``, which lifts the small ones."""
    out = leaves.withColumn("domain", F.concat(F.lit("d"), F.pmod(F.crc32("source"), F.lit(domains)).cast("string")))
    for level, by in (("domain_weight", ["domain"]), ("lang_weight", ["domain", "lang"]), ("source_weight", ["domain", "lang", "source"])):
        out = out.withColumn(level, F.pow(F.sum("tokens").over(W.partitionBy(*by)).cast("double"), F.lit(flatten)))
    return out.select(*LEVELS, "domain_weight", "lang_weight", "source_weight")


def mix(docs: DataFrame, tree: DataFrame | None = None, share: float = 0.9, max_epochs: int = MAX_EPOCHS, seed: int = SEED, marks: bool = True) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once for each epoch that takes them, with ``mix_domain``,
    ``mix_tokens`` and ``mix_epoch`` in place of columns of these names; without ``marks`` only with their own columns.

    ``tree`` has a row per leaf (domain, lang, source and the three weights; ``default_tree`` where none is given);
    the budget is ``share`` of all words.  A leaf's last epoch takes the shortest prefix of its order that reaches
    the budget; rows of one doc_id have one place in it and go together.  Null lang or source count as an
    empty one, null doc_ids share one place, a null or empty text has no words and is taken with its
    place.  Rows whose leaf is not in the tree, or has weight or budget 0, are not taken.  An empty table gives an
    empty result.  Other columns are carried along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    lang, source = F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    counted = scratch.save(with_token_counts(docs, ["doc_id", "lang", "source"]).select("doc_id", lang.alias("lang"), source.alias("source"), "__tokens"), "counted")
    leaves = scratch.save(counted.groupBy("lang", "source").agg(F.sum("__tokens").alias("tokens")), "leaves")
    tree = default_tree(leaves) if tree is None else tree
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves.join(tree, ["lang", "source"]), share * total, max_epochs).where("budget > 0 AND tokens > 0")
    plan = plan.withColumn("__full", F.least(F.expr("budget div tokens"), F.lit(max_epochs)).cast("int"))
    plan = scratch.save(plan.withColumn("__rest", F.col("budget") - F.col("__full") * F.col("tokens")), "plan")

    leaf = ["lang", "source"]
    keyed = counted.join(_small(plan.where("__rest > 0").select(*leaf, "__full", "__rest")), leaf)
    keyed = keyed.withColumn("__key", _key(seed, F.col("__full"), F.col("doc_id"))).withColumn("__range", F.shiftright("__key", 64 - RANGE_BITS))
    ranges = keyed.groupBy(*leaf, "__range", "__rest").agg(F.sum("__tokens").alias("__tokens"))
    upto = F.sum("__tokens").over(W.partitionBy(*leaf).orderBy("__range").rowsBetween(W.unboundedPreceding, 0))
    ranges = ranges.withColumn("__upto", upto).where("__upto >= __rest").groupBy(*leaf).agg(F.min_by(F.struct("__range", F.expr("__rest - (__upto - __tokens)").alias("__open")), "__range").alias("r"))
    last = keyed.join(_small(ranges.select(*leaf, "r.*")), [*leaf, "__range"]).groupBy(*leaf, "__open", "__key").agg(F.sum("__tokens").alias("__tokens"))
    upto = F.sum("__tokens").over(W.partitionBy(*leaf).orderBy("__key").rowsBetween(W.unboundedPreceding, 0))
    ends = last.withColumn("__upto", upto).where("__upto >= __open").groupBy(*leaf).agg(F.min("__key").alias("__end"))
    plan = scratch.save(plan.join(ends, leaf, "left").select("domain", *leaf, "__full", "__end"), "ends")

    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}  # no column of the table can clash with those below
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], "text")
    out = with_token_counts(held, list(own.values()), "mix_tokens")
    small = _small(plan.select(F.col("domain").alias("mix_domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), "__full", "__end"))
    lang, source = (F.coalesce(F.col(own[c]), F.lit("")) for c in leaf)
    out = out.join(small, (lang == F.col("__lang")) & (source == F.col("__source")))
    last = F.col("__end").isNotNull() & (_key(seed, F.col("__full"), F.col(own["doc_id"])) <= F.col("__end"))
    out = out.withColumn("__times", F.col("__full") + F.when(last, 1).otherwise(0)).where("__times > 0")
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    added = ["mix_domain", "mix_tokens", "mix_epoch"] if marks else []
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if c not in added], *added)
