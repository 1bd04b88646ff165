"""SimHash fingerprints and permuted block tables, in DataFrame operations only.

A text's terms are its distinct words (A-Z lowered); a term votes for or against each of
the 64 bits of its hash with its length as weight, up to ``MOST_WEIGHT``, since short words
are the common ones.  Votes of bits k and k + 32 are summed in one long (two lanes of 32
bits), so 32 sums count all 64 bits in a hash aggregate; over half of the weight sets a bit.

``neighbours`` cuts fingerprints into ``BLOCKS`` blocks.  Two that differ in at most
``RADIUS`` bits agree on at least ``BLOCKS - RADIUS`` whole blocks, so a table per choice
of that many blocks, joined on them, meets every such pair; it is counted in the first
table that has it.  Equal fingerprints form one class before that.

``with_next`` gives each row the next row's value without sorting all rows in one task:
quantiles of the id cut the rows into ranges, and each range gets a copy of the next
range's first row at its end.

Defined results: null text is empty; a text without words has fingerprint 0; rows come in
the order of id (null first), then text, so repeated rows have a fixed order; the only
row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, keep, read

RADIUS, BLOCKS = 3, 5
RANGES = 128
MOST_WEIGHT = 12
_UPPER, _SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\t\n\x0b\x0c\r"
_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Distinct words as longs: hash, and in its low four bits the weight (0 for no word)."""
    words = F.split(F.translate(text, _UPPER + _SPACES, _UPPER.lower() + " " * len(_SPACES)), " ")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~15)).bitwiseOR(
        F.least(F.length(w), F.lit(MOST_WEIGHT)).cast("long"))))


def vote_sums(term: Column) -> list[Column]:
    weight, bits = term.bitwiseAND(F.lit(15)), F.xxhash64(term)
    return [F.sum(weight * F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(_LANES))).alias(f"_v{k}")
            for k in range(32)] + [F.sum(weight).alias("_weight")]


def fingerprint_of_votes() -> Column:
    """The 64-bit fingerprint from the columns of :func:`vote_sums`."""
    bits = None
    for k in range(64):
        lane = F.col(f"_v{k % 32}")
        votes = lane.bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(lane, 32)
        bit = F.when(2 * votes > F.col("_weight"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(one: Column, two: Column) -> Column:
    return 1 - F.bit_count(one.bitwiseXOR(two)) / F.lit(64.0)


def in_ranges(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """doc_id, text, range number, and last = 1 for the copies of a next range's first row."""
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []))
    number = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>"), lambda x: x < F.col("doc_id")))
    rows = docs.withColumn("range", F.greatest(number, F.lit(0)))  # a null id is in range 0
    # one row a range, at most ``ranges`` in all
    least = rows.groupBy("range").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    heads = F.col("doc_id").isin([r.doc_id for r in least if not r.nulls])
    if any(r.nulls for r in least):
        heads = heads | F.col("doc_id").isNull()
    firsts = rows.where(heads).groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    order = Window.orderBy("range")
    wrapped = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(wrapped)).alias("first"))
    return rows.withColumn("last", F.lit(0)).unionByName(
        follow.select("first.doc_id", "first.text", "range", F.lit(1).alias("last")))


def neighbours(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For a column ``fingerprint`` (distinct values): how many others are within the radius.

    Only fingerprints that have some are returned: fingerprint, n_links.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
                                  for t, m in enumerate(tables)])).alias("e")
    one = fingerprints.select(F.col("fingerprint").alias("x"), entries).select("x", "e.table", "e.key")
    two = one.withColumnRenamed("x", "y")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first_table = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    links = one.join(two, ["table", "key"]).where(
        (F.col("x") < F.col("y")) & (F.bit_count(differ) <= radius) & (F.col("table") == first_table))
    return links.select(F.explode(F.array("x", "y")).alias("fingerprint")).groupBy("fingerprint").agg(
        F.count("*").alias("n_links"))


def edited_text(text: Column, other: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of another text."""
    n = F.char_length(text)
    quarter = F.floor(n / F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and fingerprints of the text, the edited text and the next text."""
    ordered = Window.partitionBy("range").orderBy("last", F.asc_nulls_first("doc_id"), "text")
    rows = in_ranges(documents(docs)).select(
        "range", "last", "doc_id", "text", F.row_number().over(ordered).alias("place"),
        F.coalesce(F.lead("text").over(ordered), F.lit("")).alias("following"))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("following")))
    keys = ["range", "place", "last", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")]
    both = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    names = ["range", "place", "last", "doc_id", "n_chars", "edited_sha256", "which"]
    votes = both.select(*names[:-1], "v.which", F.explode_outer(terms(F.col("v.t"))).alias("term")).groupBy(
        *names).agg(*vote_sums(F.col("term")))
    prints = votes.select(*names, fingerprint_of_votes().alias("f"))
    own = prints.groupBy(*names[:-1]).agg(F.max(F.when(F.col("which") == 0, F.col("f"))).alias("fingerprint"),
                                          F.max(F.when(F.col("which") == 1, F.col("f"))).alias("edited_fingerprint"))
    return own.withColumn("next_fingerprint", F.lead("fingerprint").over(
        Window.partitionBy("range").orderBy("place"))).where("last = 0").drop("range", "place", "last")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; classes and links of equal and near ones."""
    rows = keep(with_fingerprints(read(spark, sf_dir, "documents")), "fingerprints")
    classes = keep(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "classes")
    links = keep(classes.join(neighbours(classes.select("fingerprint")), "fingerprint", "left").select(
        "fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "linked")
    return rows.join(links, "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "class_id", "n_links")
