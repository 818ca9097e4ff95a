"""Best-fit packing: vector best fit.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Documents longer
than the longest piece that a bin could hold alone are cut into such pieces. Pieces are taken by falling size; each goes,
among the open bins where it fits under every capacity, to the one that the rule prefers, or opens a new one:

- ``dot``: the largest weighted dot product of the piece and the bin's residual, both as shares of capacity;
- ``norm``: the smallest weighted Euclidean norm of the residual that would be left.

Ties go to the oldest bin. Best fit is sequential, so pieces are split by a hash of the document's id into groups of about
``group_pieces``, each packed by itself by one task; only ids and counts are shuffled. What a group leaves in bins that are
filled to less than ``FULL`` of every capacity, about one bin a group, is packed once more together with that of as many
groups as one task takes, and stays as it was where that saves no bin. So above ``group_pieces`` the result is not best fit
over the table, but close to it; the README has the numbers of bins.

Tokens are those of the tokenizer of ``token_counts``, so a text without blanks fills as many places as it has tokens. Cases:
NULL and empty texts have no pieces. Documents without id are grouped by a hash of their text and keep a NULL id. Repeated
rows are packed each for itself. An empty table gives an empty table. Other columns are not used. The document id is an
integer, or a string that is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import written
from millrace.llm.token_counts import counted

TOKENS, DOCS, COST_SHARE, RULE, WEIGHTS, GROUP_PIECES, SEED = 4096, 24, 0.75, "norm", (1.0, 0.25, 0.5), 4096, 37
FULL = 0.9
SCHEMA = "bin_id string, slot long, doc_id long, piece long, first_token long, n_tokens long"


def best_fit(sizes: np.ndarray, tokens: int, docs: int, cost: int, rule: str = RULE, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The bin of each piece; the pieces are in the order they are taken."""
    cap = np.array([tokens, docs, cost], float)
    w = np.array(weights, float)
    need = np.stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2], axis=1)
    share = need / cap
    left = np.empty((max(16, len(sizes) // 4), 3))  # of the open bins, as shares of capacity would round: absolute
    ids = np.empty(len(left), np.int64)
    open_, made = 0, 0
    smallest = sizes.min() if len(sizes) else 0
    out = np.empty(len(sizes), np.int64)
    for i in range(len(sizes)):
        res = left[:open_]
        ok = np.flatnonzero((res >= need[i]).all(axis=1))
        if len(ok):
            r = res[ok] / cap
            score = -(r * share[i] * w).sum(axis=1) if rule == "dot" else ((r - share[i]) ** 2 * w).sum(axis=1)
            j = int(ok[np.argmin(score)])
        else:
            if open_ == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            j = open_
            left[j], ids[j] = cap, made
            open_, made = open_ + 1, made + 1
        left[j] -= need[i]
        out[i] = ids[j]
        # a bin that can't take even the smallest piece is closed; the others keep their order
        if left[j, 0] < smallest or left[j, 1] < 1 or left[j, 2] < smallest * smallest:
            left[j : open_ - 1] = left[j + 1 : open_]
            ids[j : open_ - 1] = ids[j + 1 : open_]
            open_ -= 1
    return out


def longest_piece(tokens: int, cost: int) -> int:
    return max(1, min(tokens, isqrt(cost)))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS, docs: int = DOCS, cost_share: float = COST_SHARE, rule: str = RULE,
         weights: tuple[float, ...] = WEIGHTS, group_pieces: int = GROUP_PIECES, seed: int = SEED, **tokenizer) -> DataFrame:
    """One row a piece: (bin_id, slot in the bin, doc_id, piece, first_token, n_tokens). ``cost_share``: the attention
    capacity as a share of tokens². ``tokenizer``: see ``token_counts.counted``."""
    cost = max(1, int(cost_share * tokens * tokens))
    most = longest_piece(tokens, cost)
    t = F.col(f"`{text}`")
    i = F.col(f"`{doc_id}`").cast("long")
    h = F.when(i.isNull(), F.xxhash64(t, F.lit(seed))).otherwise(F.xxhash64(i, F.lit(seed)))
    slim = written(counted(df.select(i.alias("d"), h.alias("h"), t.alias("n")).filter("n <> ''"), **tokenizer), "pack")
    pieces = slim.agg(F.coalesce(F.sum(F.expr(f"(n + {most - 1}) div {most}")), F.lit(0))).first()[0]
    groups = max(1, -(-pieces // group_pieces))
    cut = slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))))
    cut = cut.withColumn("first", F.col("piece") * most).withColumn("n", F.least(F.lit(most), F.col("n") - F.col("first")).cast("long"))
    cut = cut.withColumn("g", F.pmod("h", F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values(["n", "h", "d", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        return pdf, best_fit(pdf["n"].to_numpy(np.int64), tokens, docs, cost, rule, weights)

    def rows(pdf: pd.DataFrame, b: np.ndarray, prefix: str) -> pd.DataFrame:
        return pd.DataFrame({"bin_id": prefix + str(pdf["g"].iloc[0]) + "-" + pd.Series(b).astype(str), "slot": pd.Series(b).groupby(b).cumcount(), "doc_id": pdf["d"].astype("Int64"),
                             "piece": pdf["piece"], "first_token": pdf["first"], "n_tokens": pdf["n"]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b = fit(pdf)
        n = pdf["n"].to_numpy(float)
        poor = (np.bincount(b, n) < FULL * tokens) & (np.bincount(b) < FULL * docs) & (np.bincount(b, n * n) < FULL * cost)
        return rows(pdf, b, "").assign(g=pdf["g"], h=pdf["h"], poor=poor[b])

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        new, b = fit(pdf.rename(columns={"doc_id": "d", "first_token": "first", "n_tokens": "n"}))
        return rows(new, b, "r") if b.max() + 1 < pdf["bin_id"].nunique() else pdf[["bin_id", "slot", "doc_id", "piece", "first_token", "n_tokens"]].astype({"doc_id": "Int64"})

    out = cut.select("g", "d", "h", "piece", "first", "n").groupBy("g").applyInPandas(one, f"{SCHEMA}, g long, h long, poor boolean")
    if groups == 1:
        return out.drop("g", "h", "poor")
    out = written(out, "bins")
    left = out.filter("poor").withColumn("g", F.expr(f"g div {max(2, group_pieces // docs)}"))
    return out.filter("not poor").drop("g", "h", "poor").unionByName(left.drop("poor").groupBy("g").applyInPandas(again, SCHEMA))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the packing of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
