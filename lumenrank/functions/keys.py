"""Cache keys as column expressions (md5, first 8 hex digits)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _short(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def content_fingerprints(table: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """One fingerprint of the rows of each group: ``(group…, content)``.

    Rows count as often as they occur and their order does not matter: the number of rows
    and the sum of 60 bits of each row's md5 (exact, so any order of partial sums agrees).
    A null differs from every text.
    """
    row = F.md5(F.concat(*[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return table.groupBy(*group).agg(F.md5(F.concat_ws(
        ":", F.count(F.lit(1)).cast("string"), F.sum(bits).cast("decimal(38,0)").cast("string"))).alias("content"))


def embedding_key(project: Column, model: Column, kind: str,
                  identity: dict | None = None, content: Column | None = None) -> Column:
    """``{project}_{model short}_{kind}_{md5[:8]}``; identity JSON with sorted keys.

    With the fingerprint of the texts a key changes with them."""
    s = F.concat(project, F.lit("_"), model, F.lit(f"_{kind}"))
    if identity:
        s = F.concat(s, F.lit("_" + json.dumps(identity, sort_keys=True)))
    if content is not None:
        s = F.concat(s, F.lit("_content"), content)
    return F.concat_ws("_", project, _short(model), F.lit(kind), F.substring(F.md5(s), 1, 8))


def metrics_signature(cutoffs: dict[str, list[int]]) -> str:
    return str(sorted((m, sorted(ks)) for m, ks in cutoffs.items()))


def eval_key(project: Column, model: Column, alpha: Column, k: int, display: Column | None = None,
             cutoffs: dict[str, list[int]] | None = None, identity: dict | None = None,
             content: Column | None = None) -> Column:
    """Adds alpha, max K, display name, sorted cutoffs, identity and the fingerprint of the texts."""
    disp = display if display is not None else F.lit("")
    s = F.concat(project, F.lit("_"), model, F.lit("_"), disp, F.lit("_alpha"),
                 alpha.cast("string"), F.lit(f"_k{k}"))
    if cutoffs:
        s = F.concat(s, F.lit("_metrics" + metrics_signature(cutoffs)))
    if identity:
        s = F.concat(s, F.lit("_identity" + json.dumps(identity, sort_keys=True)))
    if content is not None:
        s = F.concat(s, F.lit("_content"), content)
    short = F.when(disp != F.lit(""), disp).otherwise(_short(model))
    return F.concat(project, F.lit("_"), short, F.lit("_a"), alpha.cast("string"),
                    F.lit(f"_k{k}_"), F.substring(F.md5(s), 1, 8))
