"""Spelling variants, filter audit and the token automaton against brute force."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF

from lumenrank.llm import bpe_automaton, filter_audit, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_variants(rows):
    """word -> (n, n_near, form, form_n, root), by comparing words that share a deletion."""
    counts = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    shared = collections.defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            shared[x].add(w)

    def one_edit(a, b):
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a != b and b[k + 1:] == a[k:] or a[k + 1:] == b[k:] or a[k + 1:] == b[k + 1:]

    near = collections.defaultdict(set)
    for group in shared.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def variants(docs, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, **options).collect()}


@pytest.fixture(scope="module")
def spelled(spark):
    """Words over few letters, many one edit apart, some with Latin-1 letters, and messy rows."""
    random.seed(8)
    base = ["".join(random.choice("abcéÿÀ") for _ in range(random.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = random.choice(base[:1 + random.randrange(len(base))])
            if random.random() < 0.5:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1:], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1:]])
            words.append(w.upper() if random.random() < 0.1 else w)
        rows.append((i, random.choice([" ", "-", "日", "\n", "×1"]).join(words)))
    rows += [(200, None), (201, ""), (None, "letters letters Letters lettérs"), (202, ("q" * 3000 + " ") * 3 + ("q" * 2999 + " ") * 7),
             (203, "same text twice"), (203, "same text twice"), (204, "same text twice " * 3)]
    return rows


def test_spelling_variants(spark, spelled):
    docs = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in spelled], "doc_id long, text string, n int, TEXT string, word int")
    want = brute_variants(spelled)
    assert sum(v[1] > 0 for v in want.values()) > 100 and sum(v[2] is not None for v in want.values()) > 30
    assert want["q" * 3000][2] in (None, "q" * 2999) and want["q" * 3000][1] == 1
    assert variants(docs) == want
    # every block is dealt into parts and slices, and the same comes out
    assert variants(docs, block=64) == want


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op11_spelling_variants(spark, SF).collect()} == brute_variants(rows)


def test_spelling_empty(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert variants(spark.createDataFrame([(1, None), (2, "only once")], "doc_id long, text string")) == {}


def test_checksums():
    random.seed(1)
    data = bytes(random.randrange(256) for _ in range(3000))
    start = np.array([0, 5, 5, 100, 2000, 7])
    end = np.array([5, 5, 9, 164, 2999, 72])
    before = np.array([zlib.crc32(b"12:"), 0, 7, 0, zlib.crc32(b"x"), 1], np.uint32)
    got = spelling._crc32(np.frombuffer(data, np.uint8), start, end, before)
    assert got.tolist() == [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(start, end, before)]


def brute_audit(rows, labels):
    smallest = collections.defaultdict(lambda: 1 << 62)
    for i, text, *_ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest[text or ""], i)
    parts = collections.defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text),
            i is not None and smallest[text] < i]) if bad}
        parts[lang or ""].append((fails, *labels.get(i, (0, 0))))
    out = []
    for part, docs in parts.items():
        total = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order):
                gone = [d for d in left if x in d[0]]
                before = set(order[:step])
                total[x] += len(gone)
                steps.append([part, "".join(order), step + 1, len(left) - len(gone), len(gone),
                              sum(x in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {x} for d in docs),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), x])
                left = [d for d in left if x not in d[0]]
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def audited():
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.sample(words, random.choice([40, 120, 150]))) + random.choice(["", "", " #", " X" * 30, " a" * 60])
             for _ in range(60)]
    rows = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(160)]
    return rows + [(900, None, "en"), (901, "", "en"), (None, texts[0], "en"), (None, texts[0], "en"), (902, "x" * 100_000, "xx"),
                   (903, " \t", "de"), (5, rows[5][1], "en"), (5, rows[5][1], rows[5][2]), (5, "other text", "en")]


@pytest.mark.parametrize("salted", [False, True])
def test_filter_audit(spark, audited, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(filter_audit, "HOT_COPIES", 2)
    docs = spark.createDataFrame([(i, t, p, "x", 1, 2) for i, t, p in audited],
                                 "doc_id long, text string, lang string, TEXT string, bits int, _n int")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2, 7) for i in range(100)] + [(3, 0, 0, 7), (None, 1, 1, 7)],
                                   "doc_id long, quality int, toxic int, rows int")
    want = brute_audit(audited, {i: (int(i % 2 == 1), int(i % 3 % 2 == 1)) for i in range(100)})
    got = filter_audit.audit(filter_audit.combinations(docs, labels)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == want


def test_filter_audit_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.combinations(docs, labels)).collect() == []


def test_filter_audit_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(filter_audit.OP12_SQL)
    names = [d[0] for d in rel.description]
    df = filter_audit.op12_filter_audit(spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_automaton.tokenizer_path())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_automaton_accepts_what_merging_gives():
    """Every word over two letters, with merges that overlap each other, against merging by rank."""
    merges = [(b"a", b"a"), (b"b", b"a"), (b"aa", b"a"), (b"a", b"b"), (b"ba", b"aa"), (b"ab", b"ab"), (b"aaa", b"b"), (b"b", b"b")]
    automaton = bpe_automaton.Automaton(merges)
    for n in range(1, 11):
        for word in itertools.product((b"a", b"b"), repeat=n):
            pieces = list(word)
            for u, v in merges:
                k = 0
                while k < len(pieces) - 1:
                    if pieces[k] == u and pieces[k + 1] == v:
                        pieces[k:k + 2] = [u + v]
                    k += 1
            assert [automaton.labels[x] for x in automaton.path(b"".join(word))] == pieces


def test_automaton_words(library):
    random.seed(2)
    e = bpe_automaton._encoder(bpe_automaton.tokenizer_path())
    signs = "abcdeé  \n\t'strl1²日本ا́\x1c\x85 ​　\U0001fae8ᲉꟋ՘"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "a" * 3000, "ab" * 1500, "=" * 999]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_query(spark, messy, library):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), messy):
        texts = collections.Counter((r.doc_id, *digests(library, r["text"] if docs is not messy else r[1])) for r in docs.collect())
        encoded = bpe_automaton.decode(bpe_automaton.encode(docs)).collect()
        got = collections.Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(),
                                   hashlib.sha256(r.text.encode()).hexdigest()) for r in encoded)
        assert got == texts
    rows = bpe_automaton.op13_bpe_automaton(spark, SF).collect()
    want = {r.doc_id: digests(library, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert bpe_automaton.decode(bpe_automaton.encode(messy.where("doc_id = -1"))).collect() == []
