"""Exact substring-containment join without comparing all pairs.

``pairs(docs, passages)`` returns every (passage, document) where the passage
text occurs verbatim in the document text.

A passage split on white space has *interior* words (neither first nor last)
that are bounded by white space inside the passage, so any document containing
the passage has each of them as a whole white-space-delimited word.  For each
passage we pick its rarest interior word (document frequency counted only over
the passage vocabulary), equi-join documents on that anchor word, and verify
the candidates with ``instr``.  The anchor keeps candidate lists short even
when a passage is made of common words, and nothing is broadcast unless its
size has been checked.

Passages with fewer than three words have no interior word.  They are joined on
their first characters (at most ``GRAM``) with the documents' character runs of
the same lengths, and longer ones verified; this pass is made only if there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.text import words
from lumenrank.session import bounded_broadcast

GRAM = 16       # characters of a short passage that candidates must have


def pairs(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id",
          doc_text: str = "text", passage_id: str = "item_id",
          passage_text: str = "text") -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("doc_text"))
    p = (passages.select(F.col(passage_id).alias("item_id"), F.col(passage_text).alias("ptext"))
         .where(F.col("ptext").isNotNull() & (F.length("ptext") > 0))
         .withColumn("pw", words("ptext")))

    interior = (p.select("item_id", F.posexplode("pw").alias("pos", "word"), F.size("pw").alias("n"))
                .where((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1) & (F.col("word") != ""))
                .select("item_id", "word").distinct())
    vocab = bounded_broadcast(interior.select("word").distinct())
    doc_words = (d.select("doc_id", F.explode(F.array_distinct(words("doc_text"))).alias("word"))
                 .join(vocab, "word", "left_semi"))
    df = doc_words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchors = (interior.join(df, "word")
               .groupBy("item_id")
               .agg(F.min_by("word", F.struct("df", "word")).alias("word")))
    candidates = doc_words.join(anchors, "word").select("doc_id", "item_id")
    long_hits = (candidates
                 .join(d, "doc_id")
                 .join(p.select("item_id", "ptext"), "item_id")
                 .where(F.instr("doc_text", F.col("ptext")) > 0)
                 .select("item_id", "doc_id"))

    short = (p.where(F.size("pw") < 3).select("item_id", "ptext", F.substring("ptext", 1, GRAM).alias("gram"))
             .withColumn("size", F.length("gram")))
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())     # GRAM values at most
    return long_hits.unionByName(_short_hits(d, short, sizes)) if sizes else long_hits


def _short_hits(d: DataFrame, short: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents with each short passage: an equi-join on character runs of the given sizes."""
    signs, n = F.col("signs"), F.size("signs")

    def runs_of(g: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), n - g + 1), lambda i: F.array_join(F.slice(signs, i, g), ""))
        return F.when(n >= g, runs).otherwise(F.array().cast("array<string>"))

    grams = (d.select("doc_id", F.regexp_extract_all("doc_text", F.lit("(?s)."), F.lit(0)).alias("signs"))
             .select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[runs_of(g) for g in sizes])))).alias("gram")))
    grams = grams.join(bounded_broadcast(short.select("gram").distinct()), "gram", "left_semi")
    found = grams.join(short, "gram").select("doc_id", "item_id", "ptext", "size")
    whole = found.where(F.length("ptext") == F.col("size")).select("item_id", "doc_id")
    rest = (found.where(F.length("ptext") > F.col("size")).join(d, "doc_id")
            .where(F.instr("doc_text", F.col("ptext")) > 0).select("item_id", "doc_id"))
    return whole.unionByName(rest)
