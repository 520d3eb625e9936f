"""Mixing sources to target weights, by budgets handed down a tree of domains, languages, sources.

A node's budget is dealt to its children in proportion to their weights. A child gets no more than
its subtree can give (its tokens times the epochs allowed); what it can't use goes to its siblings
by their weights. Only what a whole subtree can't use reaches the level above, because there the
subtree itself is capped. A leaf takes whole epochs and then the prefix, in tokens, of one more
epoch's seeded order.

DataFrame functions only. A leaf with a third of all documents is not sorted: token sums over
hash ranges find the range in which its prefix ends, only that range is put in order, and the
documents themselves are then kept or not by comparing their hash with the leaf's last one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import kept, sql_words, table

LEAF = ["domain", "lang", "source"]


def default_domain() -> Column:
    """Stand-in domain of a source: the last digit of its name, modulo three."""
    digit = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9])$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(digit, F.lit("9")) % 3, F.lit(0)).cast("int").cast("string"))


def one() -> Column:
    return F.lit(1.0)


@dataclass(frozen=True)
class Mix:
    """Target weights as Columns over domain, lang and source; zero or NULL takes nothing.

    `budget` is the number of tokens wanted; None stands for as many as the input has.
    """

    domain: Column = field(default_factory=default_domain)
    domain_weight: Column = field(default_factory=one)
    lang_weight: Column = field(default_factory=one)
    source_weight: Column = field(default_factory=one)
    epochs: int = 2
    seed: str = "mix-1"
    budget: int | None = None


def deal(nodes: DataFrame, parents: list[str], order: list[str], budget: str, most: str,
         weight: str, out: str) -> DataFrame:
    """Adds `out`: each node's part of its parent's budget, at most `most`, in whole tokens.

    Nodes are filled in the order of most / weight. The level at which the rest shares the
    remainder in proportion is found by running sums, without iteration.
    """
    live = F.when(F.col(weight) > 0, F.col(weight))
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("_full_at").asc_nulls_last(), *order)
    nodes = nodes.withColumn("_w", live).withColumn("_full_at", F.col(most) / F.col("_w"))
    nodes = nodes.withColumn("_before", F.coalesce(
        F.sum(F.when(F.col("_w").isNotNull(), F.col(most))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("_rest", F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("_capped", F.col("_full_at") * F.col("_rest") + F.col("_before") <= F.col(budget))
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_capped"), F.col(most))).over(by), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(by)
    return nodes.withColumn(out, F.when(F.col("_w").isNull(), F.lit(0)).when(F.col("_capped"), F.col(most))
                            .otherwise(F.floor(left * F.col("_w") / open_weight)).cast("long")).drop(
        "_w", "_full_at", "_before", "_rest", "_capped")


def leaf_budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: n_docs, supply, leaf_budget. `tokens` has the leaf columns and n_tokens."""
    leaves = tokens.groupBy(*LEAF).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("supply"))
    leaves = leaves.withColumn("cap", F.col("supply") * mix.epochs).withColumns({
        "w_domain": mix.domain_weight, "w_lang": mix.lang_weight, "w_source": mix.source_weight})
    langs = leaves.groupBy("domain", "lang").agg(F.sum(F.when(F.col("w_source") > 0, F.col("cap")).otherwise(0)).alias("cap"), F.sum("supply").alias("supply"), F.first("w_lang").alias("w_lang"), F.first("w_domain").alias("w_domain"))
    domains = langs.groupBy("domain").agg(F.sum(F.when(F.col("w_lang") > 0, F.col("cap")).otherwise(0)).alias("cap"), F.sum("supply").alias("supply"), F.first("w_domain").alias("w_domain"))
    all_domains = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("budget", F.sum("supply").over(all_domains) if mix.budget is None else F.lit(mix.budget).cast("long"))
    domains = deal(domains, [], ["domain"], "budget", "cap", "w_domain", "domain_budget")
    langs = langs.join(domains.select("domain", "domain_budget"), "domain")
    langs = deal(langs, ["domain"], ["lang"], "domain_budget", "cap", "w_lang", "lang_budget")
    leaves = leaves.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"])
    leaves = deal(leaves, ["domain", "lang"], ["source"], "lang_budget", "cap", "w_source", "leaf_budget")
    return leaves.select(*LEAF, "n_docs", "supply", "leaf_budget")


def with_leaf(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds the domain and replaces NULL languages and sources by `und` and `none`."""
    return docs.withColumn("domain", mix.domain).withColumns({
        "lang": F.coalesce("lang", F.lit("und")), "source": F.coalesce("source", F.lit("none"))})


def rank_hash(mix: Mix, epoch: str, doc_id: str) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(mix.seed), F.col(epoch).cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def leaf_cuts(tokens: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: whole_epochs, and the last hash taken from the epoch after them (NULL: none)."""
    leaves = kept(leaf_budgets(tokens, mix).withColumn(
        "whole_epochs", F.when(F.col("supply") > 0, F.floor(F.col("leaf_budget") / F.col("supply"))).otherwise(0).cast("long")
    ).withColumn("part", F.col("leaf_budget") - F.col("whole_epochs") * F.col("supply")
    ).withColumn("ranges", F.least(F.lit(65536), F.ceil(F.col("n_docs") / 500)).cast("long")), "leaves")
    rows = tokens.join(leaves.where("part > 0"), LEAF).withColumn("hash", rank_hash(mix, "whole_epochs", "doc_id"))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)).cast("long"))
    sums = rows.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("part").alias("part"))
    before = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = (sums.withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
            .where("start < part and start + in_range >= part").select(*LEAF, "range", "start"))
    inside = Window.partitionBy(*LEAF).orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "hash"))
    taken = (rows.join(last, [*LEAF, "range"])
             .withColumn("at", F.col("start") + F.sum("n_tokens").over(inside) - own).where("at < part"))
    cuts = taken.groupBy(*LEAF).agg(F.max("hash").alias("last_hash"))
    # One row per leaf, of known size once it is written; so the documents are not shuffled to meet it.
    return kept(leaves.select(*LEAF, "leaf_budget", "whole_epochs").join(cuts, LEAF, "left"), "cuts")


def copies(docs: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    """Documents (with leaf columns) and how often each is taken, 0 included."""
    return docs.join(cuts, LEAF).withColumn("copies", F.col("whole_epochs") + F.coalesce(
        (rank_hash(mix, "whole_epochs", "doc_id") <= F.col("last_hash")).cast("long"), F.lit(0)))


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per document taken and epoch: doc_id, the leaf, n_tokens, epoch from 0, leaf_budget.

    The last document of a prefix is taken whole, and rows with the same doc_id are taken
    together. NULL or empty text has no tokens and is taken with the prefix it lies in. Empty
    table: no rows.
    """
    tokens = kept(with_leaf(docs.select("doc_id", "lang", "source", F.size(sql_words(F.col("text"))).cast("long").alias("n_tokens")), mix), "tokens")
    taken = copies(tokens, leaf_cuts(tokens, mix), mix).where("copies > 0")
    return taken.select("doc_id", *LEAF, "n_tokens", "leaf_budget", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("epoch"))


def production_mix() -> Mix:
    """Domains alike, English twice any other language, sources alike."""
    return Mix(lang_weight=F.when(F.col("lang") == "en", 2.0).otherwise(1.0))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), production_mix())


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents of the mix with all their columns, once per epoch they are taken."""
    mix = production_mix()
    tokens = kept(with_leaf(docs.select("doc_id", "lang", "source", F.size(sql_words(F.col("text"))).cast("long").alias("n_tokens")), mix), "tokens")
    rows = with_leaf(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "lang", "source"), mix)
    taken = copies(rows, leaf_cuts(tokens, mix), mix).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
         'd' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INTEGER) % 3, 0) AS domain,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, 2 * sum(n_tokens)::BIGINT AS cap,
                CASE WHEN lang = 'en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY ALL),
lng AS (SELECT domain, lang, w, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL),
dom AS (SELECT domain, sum(cap)::BIGINT AS cap, (SELECT sum(supply)::BIGINT FROM leaf) AS b FROM lng GROUP BY ALL),
-- The common level of a family: least r at which all members, each cut at cap, use up the budget.
dom_full AS (SELECT a.domain, a.cap, a.b,
    (SELECT sum(least(o.cap, a.cap)) FROM dom o) <= a.b AS is_full FROM dom a),
dom_b AS (SELECT domain, CASE WHEN is_full THEN cap ELSE floor(
      (b - coalesce((SELECT sum(cap) FROM dom_full WHERE is_full), 0)) * 1.0::DOUBLE
      / (SELECT count(*) FROM dom_full WHERE NOT is_full)) END::BIGINT AS b FROM dom_full),
lng_full AS (SELECT a.*, (SELECT sum(least(o.cap, a.cap / a.w * o.w)) FROM lng o WHERE o.domain = a.domain) <= dom_b.b AS is_full, dom_b.b
  FROM lng a JOIN dom_b USING (domain)),
lng_b AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE floor(
      (b - coalesce(sum(cap) FILTER (is_full) OVER f, 0)) * w / sum(w) FILTER (NOT is_full) OVER f) END::BIGINT AS b
  FROM lng_full WINDOW f AS (PARTITION BY domain)),
leaf_full AS (SELECT a.*, (SELECT sum(least(o.cap, a.cap)) FROM leaf o WHERE o.domain = a.domain AND o.lang = a.lang) <= lng_b.b AS is_full, lng_b.b
  FROM leaf a JOIN lng_b USING (domain, lang)),
leaf_b AS (SELECT domain, lang, source, supply, CASE WHEN is_full THEN cap ELSE floor(
      (b - coalesce(sum(cap) FILTER (is_full) OVER f, 0)) * 1.0::DOUBLE / count(*) FILTER (NOT is_full) OVER f) END::BIGINT AS leaf_budget
  FROM leaf_full WINDOW f AS (PARTITION BY domain, lang)),
placed AS (
  SELECT d.*, leaf_budget, CASE WHEN supply > 0 THEN leaf_budget // supply ELSE 0 END AS whole,
         leaf_budget - CASE WHEN supply > 0 THEN leaf_budget // supply ELSE 0 END * supply AS part,
         md5('mix-1|' || (CASE WHEN supply > 0 THEN leaf_budget // supply ELSE 0 END) || '|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM d JOIN leaf_b USING (domain, lang, source)),
taken AS (SELECT *, whole + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      - sum(n_tokens) OVER (PARTITION BY domain, lang, source, h) < part THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, leaf_budget, unnest(range(copies::BIGINT))::INTEGER AS epoch
FROM taken WHERE copies > 0
"""
