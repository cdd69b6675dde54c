"""Filling fixed-capacity contexts with documents.

Method: cost-balanced packing. The cost of a sequence is estimated as linear in its tokens plus quadratic in the tokens of
each document (attention stays inside a document); documents, largest first, go to the sequence of the lowest cost that
still has room. Only a document larger than the capacity is divided: into full pieces and one rest, which is packed like a
document.

Scale: documents and pieces are dealt by hash to shards of about SHARD_ITEMS pieces, each packed on its own by one task; a shard leaves
at most its last sequences underfilled, so the waste doesn't grow with the corpus.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..session import cut

#: Fixed value: GPT-2's published split pattern. (?U) gives \\s its Unicode meaning in Java.
GPT2_SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents and pieces that one task packs at once, on average.
SHARD_ITEMS = 20_000
#: Budgets that one branch of the plan packs for; more take several branches.
SOME_BUDGETS = 200
#: Width of the model the costs are estimated for: attention over n tokens costs as much as n / (6 * WIDTH) tokens' rest.
WIDTH = 1024


def token_count(text: Column) -> Column:
    """Pieces of the text under GPT-2's split pattern; 0 for null and empty texts. They tile the text, so one character
    is written for each and those are counted: no array of pieces is built."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), GPT2_SPLIT, "x"))


def place(sizes: list[int], capacity: int) -> list[int]:
    """The sequence of each item. Items come in descending order and none is larger than the capacity."""
    cost = lambda n: n + n * n / (6 * WIDTH)
    count = -(-sum(sizes) // capacity)
    ready = [(0.0, i, capacity) for i in range(count)]  # cost, sequence, room: as a heap by cost
    full: list[tuple[int, int, float]] = []  # too little room for the size at hand: by room, the most first
    out = []
    for n in sizes:
        while full and -full[0][0] >= n:  # sizes fall, so some of these have room again
            room, i, spent = heapq.heappop(full)
            heapq.heappush(ready, (spent, i, -room))
        while ready and ready[0][2] < n:
            spent, i, room = heapq.heappop(ready)
            heapq.heappush(full, (-room, i, spent))
        spent, i, room = heapq.heappop(ready) if ready else (0.0, count, capacity)
        count = max(count, i + 1)
        out.append(i)
        heapq.heappush(ready, (spent + cost(n), i, room - n))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    base = int(pdf["shard"].iat[0]) << 32
    pdf["container_id"] = [base + i for i in place(pdf["tokens"].tolist(), int(pdf["capacity_tokens"].iat[0]))]
    return pdf[["budget_id", "container_id", "doc_id", "piece", "pieces", "tokens"]]


def pack(documents: DataFrame, budgets: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """budget_id, container_id, doc_id, piece, pieces, tokens: a container for every document, or piece of one.

    piece counts from 0; a document is divided (pieces > 1) only if it has more tokens than the capacity. Null and empty
    texts have no tokens and take no room. A row is an item: repeated documents are packed as often as they come. Budgets
    without a positive capacity pack nothing.
    """
    # numbers over a checkpoint stay the same, and deal equal ids to different shards
    sized = cut(documents.select("doc_id", token_count(F.col("text")).alias("size"))).withColumn("item", F.monotonically_increasing_id())
    capacities = sorted({(r["budget_id"], int(r["capacity_tokens"])) for r in budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").toLocalIterator()}, key=str)
    kind = budgets.schema["budget_id"].dataType
    parts = [_pack_some(sized, capacities[i : i + SOME_BUDGETS], kind, shard_items) for i in range(0, max(1, len(capacities)), SOME_BUDGETS)]
    return reduce(DataFrame.unionByName, parts)


def _pack_some(sized: DataFrame, capacities: list[tuple], kind: DataType, shard_items: int) -> DataFrame:
    """pack for some budgets, which go into the plan as literals."""
    pieces_for = lambda n: F.greatest(F.lit(1), F.ceil(F.col("size") / n)).cast("long")
    totals = sized.agg(*[F.coalesce(F.sum(pieces_for(n)), F.lit(0)).alias(f"n{i}") for i, (_, n) in enumerate(capacities)], F.count("*").alias("items")).first()
    shards = [max(1, -(-totals[f"n{i}"] // shard_items)) for i in range(len(capacities))]
    each = F.array(*[F.struct(F.lit(b).cast(kind).alias("budget_id"), F.lit(n).alias("capacity_tokens"), F.lit(k).alias("shards")) for (b, n), k in zip(capacities, shards, strict=True)])
    per_budget = sized.select("*", F.inline(each.cast(f"array<struct<budget_id:{kind.simpleString()},capacity_tokens:int,shards:bigint>>")))
    pieces = pieces_for(F.col("capacity_tokens")).cast("int")
    cuts = per_budget.withColumn("pieces", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    tokens = F.least(F.col("capacity_tokens"), F.col("size") - F.col("piece") * F.col("capacity_tokens"))
    shard = F.pmod(F.xxhash64("doc_id", "item", "piece"), F.col("shards"))
    dealt = cuts.select("budget_id", "capacity_tokens", "doc_id", "piece", "pieces", tokens.cast("int").alias("tokens"), shard.alias("shard"))
    kinds = dict(dealt.dtypes)
    return dealt.groupBy("budget_id", "shard").applyInPandas(_pack, f"budget_id {kinds['budget_id']}, container_id bigint, doc_id {kinds['doc_id']}, piece int, pieces int, tokens int")


def piece_texts(documents: DataFrame, packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, doc_id, piece, text of the documents that were divided."""
    divided = packed.where("pieces > 1").join(budgets.select("budget_id", "capacity_tokens"), "budget_id").join(documents.select("doc_id", "text"), "doc_id")
    tokens = F.regexp_extract_all("text", F.lit(GPT2_SPLIT), F.lit(0))
    part = F.slice(tokens, F.col("piece") * F.col("capacity_tokens") + 1, F.col("capacity_tokens"))
    return divided.select("budget_id", "doc_id", "piece", F.array_join(part, "").alias("text"))


def divided(packed: DataFrame) -> DataFrame:
    """budget_id, doc_id of the documents that had to be divided."""
    return packed.where("pieces > 1").select("budget_id", "doc_id").distinct()


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, containers, tokens, unused_share of each budget."""
    by = packed.groupBy("budget_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return by.join(F.broadcast(budgets.select("budget_id", "capacity_tokens").distinct()), "budget_id").select("budget_id", "containers", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused_share"))


def totals(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, documents, pieces, tokens, overfull (containers with more tokens than the capacity) of each budget."""
    by = packed.groupBy("budget_id", "container_id").agg(F.count_if(F.col("piece") == 0).alias("documents"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    named = by.join(F.broadcast(budgets.select("budget_id", "capacity_tokens").distinct()), "budget_id")
    return named.groupBy("budget_id").agg(F.sum("documents").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
