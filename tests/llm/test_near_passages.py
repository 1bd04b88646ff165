import random

import numpy as np
import pytest

from lumenrank.llm import passages
from test_exact import frame


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        row = [i]
        for j, v in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (u != v)))
        last = row
    return last[-1]


def test_edit_similarity():
    random.seed(3)
    seen = {True: 0, False: 0}
    for _ in range(3000):
        a = [random.randrange(4) for _ in range(random.randrange(14))]
        b = list(a)
        for _ in range(random.randrange(5)):
            at = random.randrange(len(b) + 1)
            b[at:at + random.randrange(2)] = [random.randrange(4)] * random.randrange(2)
        longer = max(len(a), len(b))
        want = 100 * (longer - _distance(a, b)) >= 80 * longer
        as_bytes = [np.array(x, np.uint64).tobytes() for x in (a, b)]
        assert passages.similar_words(*as_bytes) == passages.similar_words(*as_bytes[::-1]) == want
        seen[want] += 1
    assert min(seen.values()) > 300


def _near(rng, text, every):
    words = text.split()
    for block in range(0, len(words), every):
        at = block + rng.randrange(every)
        if at < len(words):
            words[at] = f"c{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies(spark):
    """Passages with one word in 20 replaced, 40 other words on either side; clean documents stay."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    kinds = (51, 60, 80, 120)
    shared = [prose(n) for n in kinds for _ in range(40)]
    rows = [(2 * i + k, f"{prose(40)} {_near(rng, x, 20) if k else x} {prose(40)}") for i, x in enumerate(shared) for k in range(2)]
    rows += [(1000 + i, prose(150)) for i in range(100)]
    out = passages.repeated_paragraphs(frame(spark, rows)).collect()
    caught = {r.doc_id for r in out if r.removed}
    assert {r.doc_id for r in out} <= set(range(2 * len(shared))) and all(d % 2 for d in caught)
    recall = {n: sum(2 * (40 * i + j) + 1 in caught for j in range(40)) / 40 for i, n in enumerate(kinds)}
    print("recall", recall)
    texts = dict(rows)
    for r in out:
        words = texts[r.doc_id][r.start:r.end].split()
        assert len(words) == r.n_words and texts[r.doc_id][r.end:r.end + 1] in ("", " ")
    assert recall[120] >= 0.9 and recall[80] >= 0.7


def test_a_gap_of_other_words_is_no_copy(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    ends = [(prose(20), prose(20)) for _ in range(30)]
    rows = [(2 * i + k, f"{prose(40)} {a} {prose(25)} {b} {prose(40)}") for i, (a, b) in enumerate(ends) for k in range(2)]
    assert passages.repeated_paragraphs(frame(spark, rows)).collect() == []


@pytest.mark.parametrize("copies", [40])
def test_a_family_of_near_copies(spark, copies):
    """More near copies in a bucket than are compared as pairs: blocks find the same links."""
    rng = random.Random(13)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    a, b, c = prose(30), prose(12).split(), prose(30)
    rows = []
    for i in range(copies):
        own = list(b)
        own[6] = f"d{i}"
        rows.append((i, f"{prose(40)} {a} {' '.join(own)} {c} {prose(40)}"))
    out = passages.repeated_paragraphs(frame(spark, rows)).collect()
    assert {r.doc_id for r in out} == set(range(copies)) and {r.doc_id for r in out if r.removed} == set(range(1, copies))
    texts = dict(rows)
    assert all(any(f"d{i}" in texts[i][r.start:r.end] for r in out if r.doc_id == i) for i in range(copies))
