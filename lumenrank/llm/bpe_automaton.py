"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its labels.

The automaton reads a word as a path of arcs, each labelled with a token; it accepts one
path for every word, and that path's labels are the word's tokens.  It starts as one state
with an arc per byte and grows by one gadget per merge, in the order of the merges.  The
gadget of ``(u, v) -> uv``, where ``v`` may follow ``u``,

* adds the arc ``uv``, wherever ``u`` then ``v`` can be read, to a copy of the state after ``v``;
* takes the arc ``v`` out of the state after ``u`` (a copy made before keeps it, one that
  is made later does not have it).

So there is one state per token, and a gadget is stored as its difference: the new label
with the two it joins, the state it copies, and the arc it removes with the gadget's
number.  Whether the state after ``x`` has the arc ``y`` is read from these tables: it has
it unless some gadget removed the arc of a label ``y`` starts with from a state that the
state after ``x`` is a copy of, while both were whole (:meth:`Automaton.follows`).

Encoding walks the automaton over a word, trying the longest label first; a place from
which the word's end cannot be reached is never tried twice.  Decoding puts the labels
of the arcs one after the other.

Defined results: null text is empty (no tokens); rows that repeat are each encoded; a
null id stays null; an empty table gives no rows; other columns are ignored.  A text with
the vocabulary's special tokens has them as such, as the tokenizers library does.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .arrays import chunks
from .tables import documents, read

TOKENIZER = "byte_bpe_50k.json"
CACHED_WORDS = 300_000      # words remembered in each of two generations
CACHED_BYTES = 64           # longer ones are encoded anew each time

EARLY = 0x500               # Unicode's tables do not change any more before this code point
EARLY_BYTE = 0xD4           # first UTF-8 byte of that code point

# Fixed value: how the vocabulary's pre-tokenizer cuts text before merges apply.
# (Where the regex module knows newer letters and numbers than it does: see _newer.)
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes in order for the
    code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The token automaton of a list of merges, as tables of gadgets.

    ``labels``: the bytes of each label; ``front``/``back``: the labels that a gadget
    joins (-1 for a byte); ``number``: the gadget that added a label (-1 for a byte);
    ``removed``: (state, arc) -> gadget that took the arc out.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.labels = [bytes([b]) for b in range(256)]
        self.front, self.back, self.number = [-1] * 256, [-1] * 256, [-1] * 256
        self.removed: dict[tuple[int, int], int] = {}
        self.arcs: dict[bytes, int] = {x: i for i, x in enumerate(self.labels)}
        self._end = len(merges)
        self._ahead = [[(b, self._end)] for b in range(256)]
        self._behind = [[(b, self._end)] for b in range(256)]
        self._known: dict[int, bool] = {}
        for i, (u, v) in enumerate(merges):
            self._gadget(i, u, v)
        lengths: dict[bytes, set[int]] = {}     # by the first two bytes of a label
        for x in self.labels[256:]:
            lengths.setdefault(x[:2], set()).add(len(x))
        self._lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def _gadget(self, i: int, u: bytes, v: bytes) -> None:
        if u + v in self.arcs:
            raise ValueError(f"two merges make {u + v!r}")
        left, right = self.arcs.get(u), self.arcs.get(v)
        if left is None or right is None or not self.follows(left, right):
            return  # no word has u before v by now: the gadget finds no place
        new = len(self.labels)
        self.labels.append(u + v)
        self.front.append(left)
        self.back.append(right)
        self.number.append(i)
        self.arcs[u + v] = new
        self.removed[left, right] = i
        # Labels that this one starts with (or whose states its state copies), each
        # with the gadget at which it became a part of the next longer one.
        self._ahead.append([(new, self._end), *((x, i if x == left else n) for x, n in self._ahead[left])])
        self._behind.append([(new, self._end), *((x, i if x == right else n) for x, n in self._behind[right])])

    def follows(self, x: int, y: int) -> bool:
        """Whether the state after label ``x`` has the arc ``y``."""
        removed = self.removed
        for a, copied in self._behind[x]:
            for b, grown in self._ahead[y]:
                gadget = removed.get((a, b))
                # the gadget came before a's state was copied and before b's arc grew; at
                # its own number the first of two places wins, so b's arc had not grown
                if gadget is not None and gadget < copied and gadget <= grown:
                    return False
        return True

    def _step(self, x: int, y: int) -> bool:
        key = x << 32 | y
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 4 * CACHED_WORDS:
                self._known.clear()
            known = self._known[key] = self.follows(x, y)
        return known

    def path(self, word: bytes) -> list[int]:
        """Labels of the one path that reads the whole word."""
        n, at, path = len(word), 0, []
        places: list[tuple[int, Iterator[int]]] = []    # where the path has been, and labels left to try there
        dead = bytearray(n + 1)
        tries = self._tries(word, 0)
        while at < n:
            for y in tries:
                end = at + len(self.labels[y])
                if not dead[end] and (not path or self._step(path[-1], y)):
                    places.append((at, tries))
                    path.append(y)
                    at, tries = end, self._tries(word, end)
                    break
            else:
                dead[at] = 1
                at, tries = places.pop()
                path.pop()
        return path

    def _tries(self, word: bytes, at: int) -> Iterator[int]:
        """Arcs that read on from a place, the longest first."""
        arcs, left = self.arcs, len(word) - at
        for n in self._lengths.get(word[at:at + 2], ()):
            if n <= left:
                y = arcs.get(word[at:at + n])
                if y is not None:
                    yield y
        if left:
            yield word[at]


class Vocabulary(NamedTuple):
    """A byte-level vocabulary file: merges in order, the id of each token's bytes, special tokens."""

    merges: list[tuple[bytes, bytes]]
    ids: dict[bytes, int]
    special: dict[str, int]


def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    signs = byte_signs()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    raw = {t: bytes(signs[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
    return Vocabulary([(raw[u], raw[v]) for u, v in pairs],
                      {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}, special)


def _newer() -> np.ndarray:
    """Whether a code point is a letter or number to ``regex`` but a sign to the pre-tokenizer.

    Only code points that Python's own, older table leaves open are asked for; there are
    none before ``EARLY``.
    """
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]")
    newer = np.zeros(0x110000, bool)
    newer[[c for c in range(EARLY, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))
           and len(cut("a" + chr(c))) > 1 and len(cut("1" + chr(c))) > 1]] = True
    return newer


class Encoder(dict):
    """Ids of pre-split words; remembers words in two generations of bounded size."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.automaton, self.old = Automaton(v.merges), {}
        self.ids = [v.ids[x].to_bytes(4, "little") for x in self.automaton.labels]
        self.special = {t: i.to_bytes(4, "little") for t, i in v.special.items()}
        self._cut, self._newer = regex.compile(CUT), _newer()
        self._special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.encode()
            ids = b"".join(map(self.ids.__getitem__, self.automaton.path(text)))
            if len(text) > CACHED_BYTES:
                return ids
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def words(self, text: str, plain: bool = False) -> list[str]:
        """The words of a text without special tokens; ``plain``: it has no letters that are too new."""
        if plain or not self.has_newer(text):
            return self._cut.findall(text)
        # signs instead of the letters that are too new, of the same length
        signs = "".join("\uffff" if self._newer[ord(x)] else x for x in text)
        return [text[m.start():m.end()] for m in self._cut.finditer(signs)]

    def has_newer(self, text: str) -> bool:
        return bool(self._newer[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def encode(self, text: str, plain: bool = False) -> bytes:
        """Ids of a text, little-endian unsigned 32 bit."""
        if not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.words(text, plain)))
        out, at = [], 0
        for m in self._special.finditer(text):
            out += map(self.__getitem__, self.words(text[at:m.start()], plain))
            out.append(self.special[m[0]])
            at = m.end()
        out += map(self.__getitem__, self.words(text[at:], plain))
        return b"".join(out)


class Labels(dict):
    """What the arcs of an id sequence say."""

    def __init__(self, v: Vocabulary):
        super().__init__({i: t for t, i in v.ids.items()} | {i: t.encode() for t, i in v.special.items()})

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """Compiled once per Python worker."""
    return Encoder(vocabulary(path))


@lru_cache(maxsize=2)
def _labels(path: str) -> Labels:
    return Labels(vocabulary(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit) of all documents."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for batch in batches:
            for c in chunks(batch.column("text")):
                texts = [c.text(i).decode("utf-8", "replace") for i in range(c.rows)]
                plain = c.data.max(initial=0) < EARLY_BYTE or not e.has_newer("".join(texts))
                ids = [e.encode(x, plain) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.first, c.rows), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the text of each row's ids."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _labels(path)
        for batch in batches:
            for c in chunks(batch.column("ids")):
                yield pa.RecordBatch.from_arrays(
                    [x.slice(c.first, c.rows) for x in batch.columns]
                    + [pa.array([labels.decode(c.text(i)) for i in range(c.rows)], pa.string())],
                    names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the automaton and decoded again, as digests."""
    return decode(encode(read(spark, sf_dir, "documents"))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
