"""Interaction of document filters under every order of application.

Each document fails some of five filters.  Four conditions read the document alone;
the fifth, "an earlier document has this text", is an existential self-join: documents
left-semi joined with the corpus on text hash, exact text and a smaller doc_id.

1. ``own_failures``: the first four conditions as bits, beside a hash of the text.
2. ``repeats``: hashes that occur once are put aside (a count of hashes, no texts); of
   the others the right side of the semi-join is one row per hash and text with its
   smallest doc_id, so a group of copies is one row there and never meets itself.
3. ``combinations``: the ids of the repeats are united with the other failure ids and
   each row's bits are put together; rows are counted by part and bit combination (at
   most 32 a part).  All orders follow from these counts, whatever the input's size.

Defined results: null text is empty (and equal to other empty texts); null lang is the
part ''; a null doc_id has no smaller one and is smaller than none; equal ids are not
smaller; rows that repeat are counted each; labels that repeat count once, the largest
value; an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, pick, read, sent_if_small

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
REPEAT = 1 << FILTERS.index("E")
HOT_COPIES = 10_000     # rows of one text that a task may get before they are dealt out
SALTS = 64


def own_failures(text: Column) -> Column:
    """Bits of the conditions A to D of a text (not null)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    number, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    conditions = [number < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * number,
                  100 * capitals > MOST_CAPITALS_PERCENT * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def repeats(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (doc_id, text, hash, ...) whose text an earlier doc_id has; all columns but the text."""
    counts = keep(rows.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-hashes")
    # copies of one text are dealt to SALTS tasks; that many times fewer rows a hash are not
    hot = F.when(F.col("_n") > HOT_COPIES, F.lit(SALTS)).otherwise(F.lit(1)).alias("_salts")
    among = rows.join(sent_if_small(counts.select("hash", hot)), "hash")
    first = (among.groupBy("hash", "_salts", "text").agg(F.min("doc_id").alias("_first"))
             .select(F.col("hash").alias("_hash"), F.col("text").alias("_text"), "_first",
                     F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_dealt")))
    salted = among.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.col("_salts")).cast("int"))
    return salted.join(first, (F.col("hash") == F.col("_hash")) & (F.col("_salt") == F.col("_dealt"))
                       & (F.col("text") == F.col("_text")) & (F.col("_first") < F.col("doc_id")),
                       "left_semi").drop("text", "_salt", "_salts")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, rows, good, toxic: documents of each part by the filters that they fail."""
    given = pick(docs, doc_id="bigint", text="string", lang="string")
    text = F.coalesce("text", F.lit(""))
    rows = given.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
                        F.xxhash64(text).alias("hash"))
    # a row's name: its id and, where ids repeat, what else tells its text from another's
    name = ["doc_id", "part", "hash", "chars"]
    rows = rows.withColumn("chars", F.length("text"))
    own = rows.select(*name, own_failures(F.col("text")).alias("bits"), F.lit(1).alias("rows"))
    repeated = repeats(rows).select(*name, F.lit(REPEAT).alias("bits"), F.lit(0).alias("rows"))
    failing = (own.unionByName(repeated).groupBy(*name)
               .agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows")))
    marked = (pick(labels, doc_id="bigint", quality="int", toxic="int").groupBy("doc_id")
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                   F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    return (failing.join(marked, "doc_id", "left")
            .groupBy("part", "bits")
            .agg(F.sum("rows").alias("rows"),
                 F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"),
                 F.sum(F.col("rows") * F.coalesce("toxic", F.lit(0))).alias("toxic")))


def _orders() -> Column:
    """Every order and step with the bit of its filter and the bits of those before, a constant table."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(f"struct('{''.join(order)}' as filter_order, {i + 1} as step, {bit} as bit, {before} as before)")
            before |= bit
    return F.expr(f"array({', '.join(steps)})")


def audit(counts: DataFrame) -> DataFrame:
    """Per part, order and step: what the filter removes, what earlier ones took from it, and its Shapley sum."""
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "rows", "good", "toxic")).alias("all"))
    each = packed.select("part", "all", F.explode(_orders()).alias("o")).select("part", "all", "o.*")
    bit, before = F.col("bit"), F.col("before")

    def total(value: str, holds) -> Column:
        return F.aggregate(F.filter("all", holds), F.lit(0).cast("bigint"), lambda a, x: a + x[value])

    def reached(x: Column) -> Column:
        return x["bits"].bitwiseAND(before) == 0

    def fails(x: Column) -> Column:
        return x["bits"].bitwiseAND(bit) != 0

    steps = each.select(
        "part", "filter_order", "step", "bit",
        total("rows", lambda x: reached(x) & ~fails(x)).alias("kept"),
        total("rows", lambda x: reached(x) & fails(x)).alias("removed"),
        total("rows", lambda x: ~reached(x) & fails(x)).alias("redundant"),
        total("rows", lambda x: x["bits"] == bit).alias("unique_fails"),
        total("good", lambda x: reached(x) & fails(x)).alias("good_lost"),
        total("toxic", lambda x: reached(x) & fails(x)).alias("toxic_lost"))
    # 120 rows a part and filter, whatever the input's size
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under five filters in all 120 orders, by language."""
    return audit(combinations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
marked AS (
  SELECT w.part,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS bits,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
counts AS (
  SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, bits),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS picked
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, picked[step] AS bit,
         CAST(coalesce(list_sum(list_slice(picked, 1, step - 1)), 0) AS BIGINT) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
done AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN bits & before = 0 AND bits & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bits & before <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM done
"""
