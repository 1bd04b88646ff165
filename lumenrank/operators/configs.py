"""Which configurations and splits of many data sets make up an evaluation.

Rules are tables with a rank; the best rule that applies wins (``min_by`` on the rank).  A
request that no rule can answer stays in the result, with an ``error`` and the ``choices``
there were, so one bad data set never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("corpus", "queries", "qrels")


def _has(name: str) -> Column:
    return F.coalesce(F.bool_or(F.col("config") == name), F.lit(False))


def layouts(configs: DataFrame) -> DataFrame:
    """``(dataset, standard, languages)`` of ``configs(dataset, config)``.

    A data set with plain ``corpus`` and ``queries`` is standard and has no languages.
    Else the language is what is left of a name with ``-corpus`` anywhere in it, if the
    two other roles exist for it.
    """
    per = configs.groupBy("dataset").agg((_has("corpus") & _has("queries")).alias("standard"))
    named = configs.where(F.col("config").contains("-corpus")).select(
        "dataset", F.replace("config", F.lit("-corpus"), F.lit("")).alias("lang"))
    for role in ROLES[1:]:
        there = configs.select("dataset", F.col("config").alias("_c")).distinct()
        named = (named.withColumn("_c", F.concat("lang", F.lit(f"-{role}")))
                 .join(there, ["dataset", "_c"], "left_semi").drop("_c"))
    langs = named.groupBy("dataset").agg(F.array_sort(F.collect_set("lang")).alias("found"))
    return per.join(langs, "dataset", "left").select(
        "dataset", "standard", F.when(F.col("standard") | F.col("found").isNull(), F.array().cast("array<string>"))
        .otherwise(F.col("found")).alias("languages"))


def resolve(configs: DataFrame, requests: DataFrame) -> DataFrame:
    """The three configurations of each ``requests(dataset, language)`` (null: none asked for).

    Result: dataset, language (asked), resolved (language used, null for a standard data
    set), corpus_config, queries_config, qrels_config, error, choices.  Errors:
    ``language_refused`` (standard data set), ``qrels_missing``, ``incomplete`` (no complete
    set of roles), ``language_needed`` (several to choose from), ``language_unknown``.
    """
    roles = "|".join(ROLES)
    complete = (configs.select("dataset", F.regexp_extract("config", f"^(.*)-({roles})$", 1).alias("lang"),
                               F.regexp_extract("config", f"^(.*)-({roles})$", 2).alias("role"))
                .where("role <> ''").groupBy("dataset", "lang").agg(F.count_distinct("role").alias("n"))
                .where(F.col("n") == len(ROLES)).groupBy("dataset").agg(F.array_sort(F.collect_set("lang")).alias("langs")))
    per = configs.groupBy("dataset").agg(
        (_has("corpus") & _has("queries")).alias("standard"),
        F.when(_has("qrels"), F.lit("qrels")).when(_has("default"), F.lit("default")).alias("plain_qrels"))
    known = (requests.select("dataset", "language").join(per, "dataset", "left").join(complete, "dataset", "left")
             .withColumn("standard", F.coalesce("standard", F.lit(False)))
             .withColumn("langs", F.coalesce("langs", F.array().cast("array<string>"))))
    asked, langs, standard = F.col("language"), F.col("langs"), F.col("standard")
    error = (F.when(standard & asked.isNotNull(), F.lit("language_refused"))
             .when(standard & F.col("plain_qrels").isNull(), F.lit("qrels_missing"))
             .when(standard, F.lit(None).cast("string"))
             .when(F.size(langs) == 0, F.lit("incomplete"))
             .when(asked.isNull() & (F.size(langs) > 1), F.lit("language_needed"))
             .when(asked.isNotNull() & ~F.array_contains(langs, F.coalesce(asked, F.lit(""))), F.lit("language_unknown")))
    known = known.withColumn("error", error).withColumn(
        "resolved", F.when(F.col("error").isNull() & ~standard, F.coalesce(asked, F.get(langs, F.lit(0)))))

    def config(role: str, plain: Column) -> Column:
        return F.when(F.col("error").isNull(), F.when(standard, plain).otherwise(
            F.concat("resolved", F.lit(f"-{role}")))).alias(f"{role}_config")

    return known.select("dataset", "language", "resolved", config("corpus", F.lit("corpus")),
                        config("queries", F.lit("queries")), config("qrels", F.col("plain_qrels")), "error",
                        F.when(F.col("error").isin("language_needed", "language_unknown"), langs)
                        .otherwise(F.array().cast("array<string>")).alias("choices"))


def match_splits(splits: DataFrame, requests: DataFrame) -> DataFrame:
    """The splits that belong together, per ``requests(dataset, split)`` (null: none asked for).

    ``splits(dataset, role, split)`` lists what each role has.  Rules by rank:

    * judgments: the split asked for; without one, the only one there is;
    * queries: the split of that name, else ``queries``;
    * corpus: ``corpus``, else the split of that name, else the only one there is.

    Result: dataset, split (asked), qrels_split, query_split, corpus_split, error, choices.
    Errors, the first that applies: ``corpus_missing``, ``queries_missing``, ``qrels_missing``
    (a role without splits), ``split_unknown``, ``split_needed``, ``queries_unmatched``,
    ``corpus_ambiguous``.
    """
    offered = splits.select("dataset", "role", "split").distinct()
    names = offered.groupBy("dataset").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("split")))).alias(f"{r}_names") for r in ROLES])
    asked = requests.select("dataset", F.col("split").alias("asked")).distinct()
    empty = F.array().cast("array<string>")
    known = asked.join(names, "dataset", "left").select(
        "dataset", "asked", *[F.coalesce(f"{r}_names", empty).alias(f"{r}_names") for r in ROLES])
    only = F.size("qrels_names") == 1
    known = known.withColumn("chosen", F.when(F.col("asked").isNotNull(), F.when(
        F.array_contains("qrels_names", F.coalesce("asked", F.lit(""))), F.col("asked"))).when(only, F.get("qrels_names", F.lit(0))))
    # every offered split of the other two roles with the rank of the rule that would take it
    other = offered.where(F.col("role") != "qrels").join(known.select("dataset", "asked", "chosen", "corpus_names"), "dataset")
    same = F.col("split") == F.col("chosen")
    rank = F.when(F.col("role") == "queries", F.when(same, 0).when(F.col("split") == "queries", 1)).otherwise(
        F.when(F.col("split") == "corpus", 0).when(same, 1).when(F.size("corpus_names") == 1, 2))
    taken = (other.withColumn("rank", rank).where("rank is not null and chosen is not null")
             .groupBy("dataset", F.coalesce("asked", F.lit("")).alias("key"), F.col("asked").isNull().alias("free"))
             .agg(*[F.min_by(F.when(F.col("role") == r, F.col("split")), F.when(F.col("role") == r, F.col("rank"))).alias(f"{r}_split")
                    for r in ("queries", "corpus")]))
    both = (known.withColumn("key", F.coalesce("asked", F.lit(""))).withColumn("free", F.col("asked").isNull())
            .join(taken, ["dataset", "key", "free"], "left"))
    error = F.when(F.size("corpus_names") == 0, F.lit("corpus_missing"))
    error = error.when(F.size("queries_names") == 0, F.lit("queries_missing")).when(F.size("qrels_names") == 0, F.lit("qrels_missing"))
    error = error.when(F.col("chosen").isNull() & F.col("asked").isNotNull(), F.lit("split_unknown")).when(
        F.col("chosen").isNull(), F.lit("split_needed"))
    error = error.when(F.col("queries_split").isNull(), F.lit("queries_unmatched")).when(
        F.col("corpus_split").isNull(), F.lit("corpus_ambiguous"))
    both = both.withColumn("error", error)
    fine = F.col("error").isNull()
    choices = (F.when(F.col("error").isin("split_unknown", "split_needed"), F.col("qrels_names"))
               .when(F.col("error") == "queries_unmatched", F.col("queries_names"))
               .when(F.col("error") == "corpus_ambiguous", F.col("corpus_names")).otherwise(empty))
    return both.select("dataset", F.col("asked").alias("split"), F.when(fine, F.col("chosen")).alias("qrels_split"),
                       F.when(fine, F.col("queries_split")).alias("query_split"),
                       F.when(fine, F.col("corpus_split")).alias("corpus_split"), "error", choices.alias("choices"))


def raise_errors(result: DataFrame) -> DataFrame:
    """The rows of a result, or an exception that names a request without an answer."""
    bad = result.where("error is not null").orderBy("dataset").limit(1).collect()
    if bad:
        row = bad[0]
        raise ValueError(f"data set {row.dataset}: {row.error}" + (f" ({', '.join(row.choices)})" if row.choices else ""))
    return result
