"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and its text
alone under the loss mask.  A conversation whose last turn is no assistant's gets one
more example without a target, so that every turn is in the output.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  In roles and texts
``\\``, ``<`` and ``[`` get a ``\\`` behind them, so no control string of this or another
template (``</s>``, ``[INST]``, ``<|...|>``) can come from a text; ``unescape`` undoes it.

A conversation's turns meet in one task, sorted there by turn (then role and text, which
settles ties) and read as a stream; a task holds one conversation, and examples leave it
in batches of about ``BATCH_CHARS``, each with its own copy of the context.

Defined results: null text and null role are empty; repeated rows are turns of their own;
a null conversation id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import pick, read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BATCH_CHARS = 4_000_000
_PLAIN = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"([\\<\[])\\")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role is on one line: its line feeds are escaped too."""
    return escape(role).replace("\n", "]\\n")


def unescape_role(role: str) -> str:
    return unescape(role.replace("]\\n", "\n"))


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """Target turn's number, formatted text, and the loss mask's range, per example."""
    done = ""
    for i, (role, text) in enumerate(turns):
        head = f"{done}{OPEN}{escape_role(role)}\n"
        body = escape(text)
        done = f"{head}{body}{CLOSE}"
        if role == "assistant":
            yield i, done, len(head), len(head) + len(body)
    if turns and turns[-1][0] != "assistant":
        yield len(turns), done, len(done), len(done)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    rows = (row for b in batches for i in range(0, len(b), 1000)
            for row in zip(*(b.column(x).slice(i, 1000).to_pylist() for x in ("conv_id", "role", "text"))))
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        yield conv, [(role or "", text or "") for _, role, text in turns]


def _expand_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    names = ["conv_id", "target", "text", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    for conv, turns in _conversations(batches):
        for example in expand(turns):
            out.append((conv, *example))
            size += len(example[1])
            if size > BATCH_CHARS:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, target (turn number), text, loss_start, loss_end (code points)."""
    rows = pick(turns, conv_id="bigint", turn="bigint", role="string", text="string")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_expand_batches, "conv_id long, target long, text string, loss_start long, loss_end long"))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its examples, which follow one another."""
    rows = (row for b in batches for i in range(0, len(b), 100)
            for row in zip(*(c.slice(i, 100).to_pylist() for c in b.columns)))
    out = []
    for conv, examples in groupby(rows, key=lambda r: r[0]):
        loss, loss_chars, chars, last = hashlib.sha256(), 0, 0, ""
        for _, _, text, start, end in examples:
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            loss_chars += len(reply)
            chars += len(text)
            last = text
        turns = read_turns(last)
        whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        out.append((conv, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) == 1000:
            yield _digest_rows(out)
            out = []
    if out:
        yield _digest_rows(out)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say; takes ``format_conversations``'s output as it is."""
    return examples.mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, "
                               "loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one that consists of control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    turns = pick(read(spark, sf_dir, "conversations"), conv_id="bigint", turn="bigint", role="string", text="string")
    return read_back(format_conversations(turns.unionByName(own)))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             sum(24 + length(regexp_replace(role, '[\\<\[]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[]', 'xx', 'g')))
               OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
