"""Repeated passages by MinHash banding of paragraphs.

A text is cut into paragraphs by its content alone: at line breaks, and after a word whose
rank is the smallest among the words less than ``LEAST_WORDS`` before and after it in its
line.  The ends of sentences rank before other words, else a hash of the word and the one
before it decides.  Of equal ranks that close to each other the first is a cut, then each
one ``LEAST_WORDS`` or more behind the last cut.  No cut depends on words further away than
the run of such equal ranks, so a passage is cut the same way wherever it stands, also in
the middle of a line, but for ``LEAST_WORDS`` words at its two ends.

Paragraphs' distinct shingles of ``SHINGLE`` words give ``ROWS * BANDS`` MinHash values.
Copies collapse to one digest, with the smallest and largest document id, before any
bucket is looked at; buckets with one digest go.  Colliding digests are compared
by the leader rounds of ``near_duplicates`` and verified on their full sets; components
of digests that reach over two documents or more are repeated paragraphs.  Neighbours are
linked if their components follow each other in another document too; linked paragraphs
make a passage.  Where it is broken by up to ``MOST_GAP`` paragraphs, the words between are
a candidate if another document has some between the same two components; candidates of
equal surroundings are compared by word edit distance (similarity ``THRESHOLD`` or more) and
linked to components, and a gap whose component reaches over two documents belongs to the
passage.  So near copies whose changed words lie between equal paragraphs are found whole.
Where a passage ends it goes on word by word into the neighbouring
paragraph, as far as another document has the same words beside the same component; that
part is a row of its own, ``group_id`` the hash of its words.  Passages are reported from
``LEAST_PASSAGE`` words on, their ends included; the smallest document id of a component
(of a part: that has its words) keeps its copy, the others are removed.

A paragraph's band recall at the threshold is 1 - (1 - 0.8**2)**3 = 0.95, of a copy 1; a
paragraph has about 11 words where sentences are long, so a passage of over 50 has four.

Defined results: null and word-less texts have no paragraphs; repeats inside one document
only are no removals; rows that share an id count as one document; a null id takes part
as document -1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import WIDE, Chunk, Words, _powers, chunks, distinct_per_row, join_hash, mix, ngrams, words
from .near_duplicates import THRESHOLD, link_in_buckets, verified
from .tables import documents, keep, read, scratch, sent_if_small

SHINGLE = 5
BANDS, ROWS = 3, 2
BUCKET_BITS = 42        # of a band's bucket: three are two numbers
LEAST_WORDS = 6
LEAST_PASSAGE = 25
MOST_GAP = 4            # paragraphs between two repeated ones
_FACTORS = mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?"]] = True


class Paragraphs(NamedTuple):
    words: Words            # offsets are those of paragraphs
    row: np.ndarray         # text of each paragraph
    number: np.ndarray      # place in its text
    sets: np.ndarray        # distinct shingle hashes, by paragraph
    offsets: np.ndarray
    digest: np.ndarray


def _soft(rank: np.ndarray, line: np.ndarray) -> np.ndarray:
    """If a word is a cut inside its line."""
    least = np.ones(len(rank), bool)
    for k in range(1, min(LEAST_WORDS, len(rank))):
        other = line[k:] != line[:-k]
        least[k:] &= other | (rank[k:] <= rank[:-k])
        least[:-k] &= other | (rank[:-k] <= rank[k:])
    at = np.flatnonzero(least)
    near = (np.diff(at) < LEAST_WORDS) & (line[at[1:]] == line[at[:-1]])     # equal ranks
    last = -1
    for i in np.flatnonzero(near).tolist():
        if not i or not near[i - 1]:
            last = at[i]
        if at[i + 1] - last < LEAST_WORDS:
            least[at[i + 1]] = False
        else:
            last = at[i + 1]
    return least


def paragraphs(c: Chunk, sets_too: bool = True) -> Paragraphs:
    """The paragraphs of a chunk; without their sets and digests if only their places are asked for."""
    w = words(c)
    n, row = len(w.start), w.row
    if not n:
        none = np.zeros(0, np.int64)
        return Paragraphs(w._replace(offsets=np.zeros(1, np.int64)), none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64), none)
    line = np.concatenate([[0], np.cumsum(c.data == 10)])[w.start]
    hard = np.ones(n, bool)     # the word ends its line or text
    hard[:-1] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    rank = w.hash.copy()
    rank[1:] = np.where(hard[:-1], rank[1:], join_hash(w.hash[:-1], w.hash[1:]))
    rank = (rank >> np.uint64(1)) | (~_STOP[c.data[w.end - 1]]).astype(np.uint64) << np.uint64(63)
    ends = np.flatnonzero(hard | _soft(rank, np.cumsum(hard) - hard))
    bounds = np.append(0, ends + 1)
    cut = w._replace(offsets=bounds)
    of = row[bounds[:-1]]
    first = np.searchsorted(of, of)
    if not sets_too:
        none = np.zeros(0, np.int64)
        return Paragraphs(cut, of, np.arange(len(of)) - first, none.view(np.uint64), none, none)
    sets, offsets = distinct_per_row(*ngrams(cut, SHINGLE, short=True))
    digest = mix(np.add.reduceat(mix(sets), offsets[:-1])).view(np.int64)
    return Paragraphs(cut, of, np.arange(len(of)) - first, sets, offsets, digest)


def _ids(batch: pa.RecordBatch, c: Chunk) -> np.ndarray:
    return batch.column("doc_id").slice(c.first, c.rows).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, smallest and largest document, bucket of each band: a row per distinct digest of a chunk."""
    for batch in batches:
        for c in chunks(batch.column("text"), 4 << 20):
            p = paragraphs(c)
            if not len(p.digest):
                continue
            order = np.argsort(p.digest, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(p.digest[order]) != 0))
            doc = _ids(batch, c)[p.row][order]
            digest, one = p.digest[order][first], order[first]
            low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            least = [np.minimum.reduceat((p.sets * f) >> np.uint64(32), p.offsets[:-1])[one] for f in _FACTORS]
            bucket = []
            for b in range(BANDS):
                key = np.full(len(one), mix(np.array([b], np.uint64))[0])
                for v in least[b * ROWS:(b + 1) * ROWS]:
                    key = mix(key ^ v)
                bucket.append(key >> np.uint64(64 - BUCKET_BITS))
            one_two = bucket[0] | bucket[1] << np.uint64(42)
            two_three = bucket[1] >> np.uint64(22) | bucket[2] << np.uint64(20)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest), pa.array(low), pa.array(high), pa.array(one_two.view(np.int64)), pa.array(two_three.view(np.int64))],
                names=["id", "low", "high", "one_two", "two_three"])


def _bucket(band: int) -> Column:
    """A band's bucket from the two numbers that hold all three, different for different bands."""
    one_two, two_three = F.col("one_two"), F.col("two_three")
    value = [one_two.bitwiseAND(F.lit((1 << 42) - 1)),
             F.shiftrightunsigned(one_two, 42).bitwiseOR(F.shiftleft(two_three.bitwiseAND(F.lit((1 << 20) - 1).cast("long")), 22)),
             F.shiftrightunsigned(two_three, 20)][band]
    return value.bitwiseOR(F.lit(band << BUCKET_BITS).cast("long"))


def _colliding(digests: DataFrame, band: int) -> DataFrame:
    """bucket and id of the digests that share a band's bucket with another one."""
    members = digests.select("id", _bucket(band).alias("bucket")).repartition("bucket")
    # both sides lie by bucket and share one exchange (a semi join would be moved below it and read
    # its own); the buckets that stay, one row each, are hashed rather than all rows sorted
    wide = members.groupBy("bucket").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b")
    return members.join(wide.select("bucket").hint("shuffle_hash"), "bucket").select("bucket", "id")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text"), WIDE):
            p = paragraphs(c)
            digest, one = np.unique(p.digest, return_index=True)
            size = np.diff(p.offsets)[one]
            ends = np.concatenate([[0], np.cumsum(size)])
            held = p.sets[np.repeat(p.offsets[one] - ends[:-1], size) + np.arange(ends[-1])]
            sets = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(held)])
            yield pa.RecordBatch.from_arrays([pa.array(digest), sets], names=["id", "set"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text's key, paragraph number, range of code points, words of it and of its neighbours, digest."""
    for batch in batches:
        for c in chunks(batch.column("text"), WIDE):
            p = paragraphs(c)
            points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            begin = points[c.offsets[p.row]]
            lo, hi = p.words.offsets[:-1], p.words.offsets[1:] - 1
            size = (hi - lo + 1).astype(np.int32)
            before, after = np.zeros_like(size), np.zeros_like(size)
            inner = p.row[1:] == p.row[:-1]
            before[1:], after[:-1] = size[:-1] * inner, size[1:] * inner
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch, c)[p.row]), batch.column("text_key").slice(c.first, c.rows).take(pa.array(p.row)),
                 pa.array(p.number.astype(np.int32)),
                 pa.array((points[p.words.start[lo]] - begin).astype(np.int32)),
                 pa.array((points[p.words.end[hi]] - begin).astype(np.int32)),
                 pa.array(size), pa.array(before), pa.array(after), pa.array(p.digest)],
                names=["doc_id", "text_key", "paragraph", "start", "end", "n_words", "before", "after", "id"])


ENDS = ("doc_id long, text_key long, paragraph int, side int, passage long, least int, near int, "
        "keys array<long>, far array<int>")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the ends listed in ``beside``: words before (side 0) or after (side 1) a paragraph.

    ``keys`` has, for each number of words up to ``LEAST_WORDS`` beyond the next paragraph, the key
    of that many words and the component; ``near`` is the code point where they begin beside the
    paragraph, ``far`` those where they end.
    """
    for batch in batches:
        for c in chunks(batch.column("text")):
            p, w = (q := paragraphs(c, sets_too=False)), q.words
            if not len(p.row):
                continue
            points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            up, down = _powers(len(w.hash))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash) * up[:len(w.hash)])])
            first = np.searchsorted(p.row, np.arange(c.rows))
            beside = batch.column("beside").slice(c.first, c.rows)
            flat = beside.flatten()
            of = np.repeat(np.arange(c.rows), beside.value_lengths().to_numpy(zero_copy_only=False))
            paragraph, side, group = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = first[of] + paragraph + 2 * side - 1
            # cuts less than LEAST_WORDS before a passage's end may differ from copy to copy
            lo = np.where(side == 1, w.offsets[at], np.maximum(w.offsets[at] - LEAST_WORDS, w.offsets[first[of]]))
            row_end = w.offsets[np.append(first[1:], len(p.row))[of]]
            size = np.where(side == 1, np.minimum(w.offsets[at + 1] + LEAST_WORDS, row_end), w.offsets[at + 1]) - lo
            offsets = np.concatenate([[0], np.cumsum(size)])
            one = np.repeat(np.arange(len(at)), size)
            k = np.arange(len(one)) - offsets[one] + 1
            right = side[one] == 1
            begin = np.where(right, lo[one], (lo + size)[one] - k)
            end = np.where(right, lo[one] + k, (lo + size)[one])
            key = mix((total[end] - total[begin]) * down[begin] ^ mix(group.astype(np.int64).view(np.uint64) * np.uint64(2) + side.astype(np.uint64))[one])
            zero = points[c.offsets[of]]
            far = np.where(right, points[w.end[end - 1]], points[w.start[begin]]) - zero[one]
            near = np.where(side == 1, points[w.start[lo]], points[w.end[lo + size - 1]]) - zero
            offsets = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch, c)[of]), batch.column("text_key").slice(c.first, c.rows).take(pa.array(of)),
                 pa.array(paragraph.astype(np.int32)), pa.array(side.astype(np.int32)), flat.field(3), flat.field(4),
                 pa.array(near.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(far.astype(np.int32)))],
                names=["doc_id", "text_key", "paragraph", "side", "passage", "least", "near", "keys", "far"])


def similar_words(x: bytes, y: bytes, threshold: tuple[int, int] = THRESHOLD) -> bool:
    """If two sequences of word hashes have an edit similarity (1 - distance / longer length) of the threshold or more."""
    a, b = np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()
    part, whole = threshold
    limit = max(len(a), len(b)) * (whole - part) // whole
    while a and b and a[-1] == b[-1]:
        a.pop(), b.pop()
    same = next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    if abs(len(a) - len(b)) > limit:
        return False
    far = limit + 1
    last = [min(j, far) for j in range(len(b) + 1)]
    for i, u in enumerate(a, 1):
        row = [far] * (len(b) + 1)     # only cells near the diagonal can stay within the limit
        if i <= limit:
            row[0] = i
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (u != b[j - 1]), far)
        if min(row) > limit:
            return False
        last = row
    return last[-1] <= limit


GAPS = "doc_id long, text_key long, paragraph int, upto int, start int, end int, n_words int, bucket long, id long, words binary"


def _gap_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words between paragraphs ``paragraph`` and ``upto`` of each gap listed in ``gaps``."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            p, w = (q := paragraphs(c, sets_too=False)), q.words
            if not len(p.row):
                continue
            points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            up, down = _powers(len(w.hash))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash) * up[:len(w.hash)])])
            first = np.searchsorted(p.row, np.arange(c.rows))
            gaps = batch.column("gaps").slice(c.first, c.rows)
            flat = gaps.flatten()
            of = np.repeat(np.arange(c.rows), gaps.value_lengths().to_numpy(zero_copy_only=False))
            paragraph, upto, key = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            lo, hi = w.offsets[first[of] + paragraph + 1], w.offsets[first[of] + upto]
            zero = points[c.offsets[of]]
            digest = mix((total[hi] - total[lo]) * down[lo] ^ mix(key.astype(np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch, c)[of]), batch.column("text_key").slice(c.first, c.rows).take(pa.array(of)),
                 flat.field(0), flat.field(1), pa.array((points[w.start[lo]] - zero).astype(np.int32)),
                 pa.array((points[w.end[hi - 1]] - zero).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                 flat.field(2), pa.array(digest.view(np.int64)),
                 pa.array([w.hash[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary())],
                names=["doc_id", "text_key", "paragraph", "upto", "start", "end", "n_words", "bucket", "id", "words"])


def _listed(docs: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """The texts that ``lists`` names, with their lists: others are left out before texts are exchanged.

    Lists are wide and as many as texts, so they are not broadcast, few or many: texts meet them
    in one exchange at every size, and small tables tell what large ones will write.
    """
    copies = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "text_key", "text")
    named = copies.join(sent_if_small(lists.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_semi")
    return named.join(lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", column)


def _bridged(docs: DataFrame, found: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, paragraph, upto, gap: gaps between repeated paragraphs that another document nearly has."""
    gaps = found.where(~F.col("linked") & (F.col("far.paragraph") > F.col("paragraph") + 1)).select(
        "doc_id", "text_key", "paragraph", F.col("far.paragraph").alias("upto"),
        F.xxhash64("group_id", "far.group_id").alias("key"))
    gaps = keep(gaps, "gaps")
    both = gaps.groupBy("key").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a <> _b").select("key")
    lists = keep(gaps.join(sent_if_small(keep(both, "gap_keys")), "key", "left_semi").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("paragraph", "upto", "key")).alias("gaps")), "gap_lists")
    made = keep(_listed(docs, lists, "gaps").mapInArrow(_gap_words, GAPS), "gap_words")
    texts = keep(made.groupBy("id").agg(F.first("words").alias("set")), "gap_texts")

    def close(pairs: DataFrame) -> DataFrame:
        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(s).to_pylist() for s in ("xa", "xb"))
                good = pa.array([i for i in range(len(batch)) if similar_words(x[i], y[i], threshold)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(s).take(good) for s in ("a", "b")], names=["a", "b"])

        joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b").join(
            texts.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a")
        return joined.select("a", "b", "xa", "xb").mapInArrow(verify, "a long, b long")

    labels = link_in_buckets(made.select("bucket", "id").distinct(), close,
                             lambda ids: texts.join(ids, "id", "left_semi").withColumn("signature", F.lit(b"")),
                             similar=lambda x, y: similar_words(x, y, threshold))
    near = made.drop("words", "bucket")
    near = near.withColumn("label", F.col("id")) if labels is None else near.join(labels, "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    groups = near.groupBy("label").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    return near.join(sent_if_small(keep(groups, "gap_groups")), "label").select(
        "doc_id", "text_key", "paragraph", "upto", F.struct(
            (F.col("paragraph") + 1).cast("int").alias("paragraph"), "start", "end", "n_words", F.col("label").alias("group_id"),
            "first_doc").alias("gap")).distinct()


def _parts(docs: DataFrame, found: DataFrame, least_passage: int) -> DataFrame:
    """doc_id, text_key, passage, and ``parts``: the longest repeated part on either side of the paragraph ``at`` where
    the passage ends."""
    # a passage too short without its ends needs one with half of the missing words; of the
    # steps the last one up to that is looked up first
    missing = F.lit(least_passage) - F.col("words")
    steps = [1 << i for i in range(max(1, ((least_passage + 1) // 2).bit_length()))]
    half = F.greatest(F.lit(1), F.ceil(missing / 2))
    least = F.greatest(*[F.when(half >= n, n).otherwise(1) for n in [1, *steps]])
    place = ["doc_id", "text_key", "paragraph"]
    own = [*place, F.col("passage").cast("long").alias("passage"), F.col("_least").cast("int").alias("least"), "group_id"]
    may = found.where(F.col("reach") >= least_passage).withColumn("_least", least)
    sides = F.array_compact(F.array(F.when(~F.col("after_linked") & (F.col("before") > 0), 0),
                                    F.when(~F.col("linked") & (F.col("after") > 0), 1)))
    ends = keep(may.select(*own, F.explode(sides).alias("side")).distinct(), "ends")
    # where a passage goes on, one copy in the first and in the last document is enough to meet ends of others
    inner = found.where("linked and gap is null")
    inner = inner.select(*place, F.lit(1).alias("side"), "group_id", F.col("next.id").alias("other")).unionByName(
        inner.select("doc_id", "text_key", (F.col("paragraph") + 1).alias("paragraph"), F.lit(0).alias("side"),
                     F.col("next.group_id").alias("group_id"), F.col("id").alias("other")))
    inner = inner.join(sent_if_small(keep(ends.select("group_id", "side").distinct(), "sides")), ["group_id", "side"], "left_semi")
    spot = F.struct(*place)
    inner = inner.groupBy("group_id", "side", "other").agg(F.array(F.min(spot), F.max(spot)).alias("_s"))
    inner = inner.select("group_id", "side", F.explode("_s").alias("_s")).select(
        "_s.*", "side", "group_id", F.lit(0).cast("long").alias("passage"), F.lit(0).alias("least"))
    all_ends = ends.unionByName(inner)
    lists = keep(all_ends.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(
        "paragraph", F.col("side").cast("int").alias("side"), "group_id", "passage", "least")).alias("beside")), "beside")
    def in_two(keys: DataFrame) -> DataFrame:
        """Keys that two documents have, with the first of them."""
        return keys.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_d")).where(
            "first_doc <> _d").drop("_d")

    def of_words(n):
        return F.get("keys", n - 1)

    with scratch(docs.sparkSession) as save:      # most ends go here, before those that stay are looked at word by word
        made = keep(_listed(docs, lists, "beside").mapInArrow(_ends, ENDS), "made")
        looked_up = made.select("doc_id", F.explode(F.array(*[of_words(F.lit(n)) for n in steps])).alias("key")).where("key is not null")
        mine = ["doc_id", "text_key", "passage"]
        own_ends = made.where("least > 0")
        alive = own_ends.select(*mine, of_words(F.col("least")).alias("key")).join(
            in_two(looked_up), "key", "left_semi").select(*mine).distinct()
        first = of_words(F.lit(1))
        # the key alone is exchanged, not all keys of an end
        firsts = own_ends.select(*mine, first.alias("first")).join(keep(alive, "alive"), mine, "left_semi").select("first").distinct()
        wanted = save(made.withColumn("first", first).join(sent_if_small(keep(firsts, "firsts")), "first", "left_semi")
                      .select(*place, "side", "passage", "least", "near", "keys", "far"), "wanted")
    one = wanted.select(*place, "side", "passage", "least", "near", F.posexplode(F.arrays_zip("keys", "far")).alias("_k", "_e")).select(
        *place, "side", "passage", "least", (F.col("_k") + 1).alias("n_words"), F.col("_e.keys").alias("key"),
        F.when(F.col("side") == 1, F.col("near")).otherwise(F.col("_e.far")).alias("start"),
        F.when(F.col("side") == 1, F.col("_e.far")).otherwise(F.col("near")).alias("end"))
    longest = one.where("least > 0").join(in_two(one), "key").groupBy(*place, "passage", "side").agg(
        F.max(F.struct("n_words", "start", "end", "key", "first_doc")).alias("_m"))
    return longest.groupBy(*mine).agg(F.collect_list(F.struct(
        F.col("paragraph").alias("at"), (F.col("paragraph") + 2 * F.col("side") - 1).cast("int").alias("paragraph"), "_m.start", "_m.end", "_m.n_words",
        F.col("_m.key").alias("group_id"), F.col("_m.first_doc").alias("first_doc"))).alias("parts"))


def _repeated(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """id, group_id, first_doc: digests whose component reaches over two documents."""
    # copies are one row with all its buckets before any bucket is looked at
    with scratch(docs.sparkSession) as save:
        banded = docs.mapInArrow(_bands, "id long, low long, high long, one_two long, two_three long")
        digests = save(banded.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                                F.first("one_two").alias("one_two"), F.first("two_three").alias("two_three")), "digests")
    mixed = []
    for band in range(BANDS):       # one after the other: only one band's shuffle lies on disk
        with scratch(docs.sparkSession) as save:
            mixed.append(save(_colliding(digests, band), "mixed"))
    mixed = reduce(DataFrame.unionByName, mixed)
    ids = keep(mixed.select("id").distinct(), "ids")
    sets = keep(docs.mapInArrow(_sets, "id long, set binary").join(sent_if_small(ids), "id", "left_semi")
                .groupBy("id").agg(F.first("set").alias("set")), "sets")
    labels = link_in_buckets(mixed, lambda pairs: verified(pairs, sets, threshold),
                             lambda ids: sets.join(ids, "id", "left_semi").withColumn("signature", F.lit(b"")))
    # a digest of one document that is linked with no other is no repeat; ``labels`` has every linked one
    seen = digests.select("id", "low", "high")
    if labels is not None:
        seen = seen.join(sent_if_small(labels), "id", "left").where("low <> high or label is not null").select(
            "id", "low", "high", F.coalesce("label", "id").alias("label"))
    else:
        seen = seen.where("low <> high").withColumn("label", F.col("id"))
    seen = keep(seen, "labelled")
    groups = keep(seen.groupBy("label").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc"))
                  .where("first_doc <> last_doc"), "groups")
    return seen.join(groups, "label").select("id", F.col("label").alias("group_id"), "first_doc")


def _passages(docs: DataFrame, repeated: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Places of repeated paragraphs, those of one passage (they follow each other, or nearly, in two documents)
    with one number ``passage``; ``gap`` is the near copy up to the passage's next paragraph, if any.  A passage's
    sums are on each of its rows: ``words``, ``reach`` (with all that its ends can have) and ``copies`` (equal rows)."""
    places = docs.mapInArrow(_places, "doc_id long, text_key long, paragraph int, start int, end int, n_words int, "
                             "before int, after int, id long")
    # equal rows (same id and text) have equal places; they share each window's frames
    order = Window.partitionBy("doc_id", "text_key").orderBy("paragraph")
    found = keep(places.join(sent_if_small(repeated), "id")
                 .withColumn("far", F.min(F.struct("paragraph", "group_id", "id")).over(order.rangeBetween(1, MOST_GAP + 1)))
                 .withColumn("next", F.when(F.col("far.paragraph") == F.col("paragraph") + 1, F.struct("far.group_id", "far.id")))
                 .withColumn("far", F.when(F.col("far").isNotNull(), F.struct("far.paragraph", "far.group_id"))), "found")
    links = found.where("next is not null").groupBy("group_id", F.col("next.group_id").alias("next_group")).agg(
        F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a <> _b").select("group_id", "next_group", F.lit(True).alias("linked"))
    found = found.withColumn("next_group", F.col("next.group_id")).join(
        sent_if_small(keep(links, "links")), ["group_id", "next_group"], "left").drop("next_group").withColumn("linked", F.coalesce("linked", F.lit(False)))
    gaps = keep(_bridged(docs, found, threshold), "bridged")
    found = found.drop("far").join(sent_if_small(gaps), ["doc_id", "text_key", "paragraph"], "left")
    found = found.withColumn("upto", F.when(F.col("linked"), F.col("paragraph") + 1).otherwise(F.col("upto")))
    found = found.withColumn("linked", F.col("upto").isNotNull()).withColumn("gap_words", F.coalesce("gap.n_words", F.lit(0)))
    found = found.withColumn("after_linked", F.coalesce(
        F.max("upto").over(order.rangeBetween(-MOST_GAP - 1, -1)) == F.col("paragraph"), F.lit(False)))
    found = found.withColumn("passage", F.sum((~F.col("after_linked")).cast("int")).over(order))
    # rows lie by text already, so a passage's sums need no exchange here, and none later
    passage = Window.partitionBy("doc_id", "text_key", "passage")
    own = F.col("n_words") + F.col("gap_words")
    ends = (F.when(F.col("after_linked"), 0).otherwise(F.col("before") + LEAST_WORDS)
            + F.when(F.col("linked"), 0).otherwise(F.col("after") + LEAST_WORDS))
    within = F.when(F.col("gap").isNotNull(), F.col("upto") - F.col("paragraph") - 1).otherwise(0)     # paragraphs of the gap
    span = F.max(F.col("paragraph") + within).over(passage) - F.min("paragraph").over(passage) + 1
    return found.withColumns({"words": F.sum(own).over(passage), "reach": F.sum(own + ends).over(passage),
                              "copies": F.sum(within + 1).over(passage) / span}).drop("upto", "gap_words")


PART = "paragraph:int,start:int,end:int,n_words:int,group_id:bigint,first_doc:bigint"


def repeated_paragraphs(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD,
                        least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """One row per paragraph of a repeated passage, near copy inside it, or part at its ends: its place, its component, and if it is removed."""
    docs = documents(docs).withColumn("text_key", F.xxhash64("text"))
    spark = docs.sparkSession
    with scratch(spark) as save:
        repeated = save(_repeated(docs, threshold), "repeated")
    with scratch(spark) as save:
        found = save(_passages(docs, repeated, threshold), "passages")
    with scratch(spark) as save:
        parts = save(_parts(docs, found, least_passage), "parts")
    # by passage, so that the words of its parts are on each of its rows without another exchange
    found = found.join(parts, ["doc_id", "text_key", "passage"], "left").withColumn("parts", F.coalesce(
        "parts", F.array().cast(f"array<struct<at:int,{PART}>>")))
    beside = F.aggregate("parts", F.lit(0), lambda n, x: n + x["n_words"])
    found = found.withColumn("passage_words", ((F.col("words") + F.col("copies") * beside) / F.col("copies")).cast("long"))
    own = F.array(F.struct("paragraph", "start", "end", "n_words", "group_id", "first_doc"))
    gap = F.when(F.col("gap").isNotNull(), F.array("gap")).otherwise(F.array().cast(f"array<struct<{PART}>>"))
    here = F.transform(F.filter("parts", lambda x: x["at"] == F.col("paragraph")), lambda x: x.dropFields("at"))
    rows = found.where(F.col("passage_words") >= least_passage).select(
        "doc_id", "passage_words", F.explode(F.concat(own, gap, here)).alias("_r"))
    return rows.select("doc_id", "_r.paragraph", "_r.start", "_r.end", "_r.n_words", "passage_words", "_r.group_id", "_r.first_doc",
                       (F.col("doc_id") != F.col("_r.first_doc")).alias("removed"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of passages that repeat across documents."""
    return repeated_paragraphs(read(spark, sf_dir, "documents"))
