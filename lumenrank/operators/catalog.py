"""Data-set catalog operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.text import py_strip

# Task types kept by default.
DEFAULT_RETRIEVAL_TYPES = ("Retrieval", "InstructionRetrieval", "Any2AnyRetrieval",
                           "Any2AnyMultilingualRetrieval")

# ISO-639-1 -> ISO-639-3 map, in order.
ISO639_1_TO_3 = {
    "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por",
    "nl": "nld", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin", "ru": "rus",
    "pl": "pol", "cs": "ces", "tr": "tur", "ar": "ara", "he": "heb", "hi": "hin",
    "ja": "jpn", "ko": "kor", "zh": "cmn",
}

# Fixed values: ``Suite(lang[, version])`` benchmark names.
BENCH_NAME = r"^([A-Za-z0-9_-]+)\(\s*([A-Za-z]{2,10})\s*(?:,\s*([^)]+?)\s*)?\)$"

ROLES = ("corpus", "queries", "qrels")


def normalise_lang(c: Column) -> Column:
    """X11: strip + lower; ``ger`` -> ``deu``; two-letter codes mapped, others unchanged."""
    v = F.lower(py_strip(c))
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(ISO639_1_TO_3.items())])
    return (F.when(v == F.lit("ger"), F.lit("deu"))
            .when(F.length(v) == 2, F.coalesce(F.element_at(m, v), v))
            .otherwise(v))


def version_rank(c: Column) -> Column:
    """``vN`` -> 100+N, malformed ``v…`` -> 10, ``classic`` -> 1, else 0."""
    v = F.lower(py_strip(c))
    n = F.substring(v, 2, 1 << 20).try_cast("int")
    return (F.when(v.startswith("v"), F.coalesce(F.lit(100) + n, F.lit(10)))
            .when(v == F.lit("classic"), F.lit(1)).otherwise(F.lit(0)))


def parse_benchmark(name: Column) -> tuple[Column, Column, Column]:
    """(suite, language, version or null)."""
    suite = F.regexp_extract(name, BENCH_NAME, 1)
    lang = F.regexp_extract(name, BENCH_NAME, 2)
    ver = F.nullif(F.regexp_extract(name, BENCH_NAME, 3), F.lit(""))
    return suite, lang, ver


def best_versions(names: DataFrame, default_version: str = "v2") -> DataFrame:
    """K5: per (suite, normalised language) the name with the highest version
    rank (ties broken by name)."""
    suite, lang, ver = parse_benchmark(F.col("name"))
    p = (names.select("name", suite.alias("suite"), normalise_lang(lang).alias("lang"),
                      F.coalesce(ver, F.lit(default_version)).alias("version"))
         .where(F.col("suite") != "")
         .withColumn("rank", version_rank(F.col("version"))))
    return (p.groupBy("suite", "lang")
            .agg(F.max_by("name", F.struct("rank", "name")).alias("best_name"),
                 F.max("rank").alias("best_rank")))


def complete_groups(configs: DataFrame) -> DataFrame:
    """(dataset, language) groups whose corpus, queries and qrels configs
    all exist; config names are ``{lang}-{role}``."""
    role = F.regexp_extract("config", r"-(corpus|queries|qrels)$", 1)
    lang = F.regexp_replace("config", r"-(corpus|queries|qrels)$", "")
    return (configs.select("dataset", lang.alias("lang"), role.alias("role"))
            .where(F.col("role") != "")
            .groupBy("dataset", "lang").agg(F.count_distinct("role").alias("n"))
            .where(F.col("n") == len(ROLES)).select("dataset", "lang"))


def filter_types(tasks: DataFrame, allowed=DEFAULT_RETRIEVAL_TYPES) -> DataFrame:
    """C4."""
    return tasks.where(F.col("task_type").isin(list(allowed)))


def record_fields(tasks: DataFrame) -> DataFrame:
    """path = first non-empty of path/name/repo_id, else ''; revision or ''."""
    cols = set(tasks.columns)
    path = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("path", "name", "repo_id") if c in cols],
                      F.lit(""))
    rev = F.coalesce(F.col("revision"), F.lit("")) if "revision" in cols else F.lit("")
    return tasks.withColumn("dataset_path", path).withColumn("dataset_revision", rev)


def task_rows(tasks: DataFrame) -> DataFrame:
    """C5 per-task mode (a row per task record) + T3 order."""
    return (tasks.select("task_name", "task_type", "dataset_path", "dataset_revision")
            .orderBy("dataset_path", "dataset_revision", "task_name"))


def dedupe(tasks: DataFrame) -> DataFrame:
    """M16 + S10: unique (path, revision) with sorted distinct task names,
    also joined with ';' for CSV export."""
    return (tasks.groupBy("dataset_path", "dataset_revision")
            .agg(F.array_sort(F.collect_set("task_name")).alias("tasks"))
            .select("dataset_path", "dataset_revision", "tasks",
                    F.concat_ws(";", "tasks").alias("tasks_csv"),
                    F.size("tasks").cast("long").alias("n_tasks"))
            .orderBy("dataset_path", "dataset_revision"))


def resolve_names(requests: DataFrame, benchmarks: DataFrame, default_version: str = "v2") -> DataFrame:
    """K6: ``requests(user_value)`` -> ``resolved`` against ``benchmarks(name, alias)``.

    ``Suite(lang[, ver])`` (language normalised for MTEB), a bare 2-3 letter
    language (``MTEB(lang, default)``) or an exact name; an existing name or
    alias wins, else the best available MTEB version for that language (K5),
    else the candidate unchanged.  Joins only, no driver-side lookups.
    """
    raw = py_strip(F.col("user_value"))
    suite, lang, ver = parse_benchmark(raw)
    is_a = suite != F.lit("")
    is_b = ~is_a & raw.rlike(r"^[A-Za-z]{2,3}$")
    lang_n = F.when(is_a, normalise_lang(lang)).when(is_b, normalise_lang(raw))
    mteb = (is_a & (suite == F.lit("MTEB"))) | is_b
    cand = (F.when(is_a & (suite == F.lit("MTEB")),
                   F.concat(F.lit("MTEB("), lang_n, F.lit(", "), F.coalesce(ver, F.lit(default_version)), F.lit(")")))
            .when(is_a, raw)
            .when(is_b, F.concat(F.lit("MTEB("), lang_n, F.lit(f", {default_version})")))
            .otherwise(raw))
    req = requests.select("user_value", cand.alias("candidate"), F.when(mteb, lang_n).alias("lang"))
    # one answer per key: a benchmark's own name, else the last name (in order) with that alias
    lookup = (benchmarks.select(F.col("name").alias("key"), "name", F.lit(1).alias("own"))
              .unionByName(benchmarks.where(F.col("alias").isNotNull())
                           .select(F.col("alias").alias("key"), "name", F.lit(0).alias("own")))
              .groupBy("key").agg(F.max(F.struct("own", "name")).alias("last")).select("key", "last.name"))
    versioned = benchmarks.select("name").distinct().where(parse_benchmark(F.col("name"))[2].isNotNull())
    best = best_versions(versioned).where(F.col("suite") == "MTEB")
    return (req.join(lookup.withColumnRenamed("key", "candidate").withColumnRenamed("name", "hit"),
                     "candidate", "left")
            .join(best.select("lang", "best_name"), "lang", "left")
            .select("user_value", F.coalesce("hit", "best_name", "candidate").alias("resolved")))
