"""References to records that don't exist, were deleted before, or arrive only later.

Method: a Bloom filter of all parent keys, of bounded size and broadcast, proves most dead references dead before any
shuffle; what passes it is verified by an exact join, then counted. The filter is a table of blocks that is joined: as a
value in a condition it would be in every plan, description of a plan and task of the query, and fill the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.runstore import clean_id, seconds

#: Bits a parent key gets in the filter (about 1 % false positives) and the most that a filter may have (8 MB).
BITS_PER_KEY, MOST_BITS = 12, 1 << 26
#: Words of 64 bits in a row of the filter (as a power of two), and bits that a key sets in its word.
WORDS_LOG, BITS_SET = 10, 4


def _mask(hashed: Column) -> Column:
    """The bits of a key in its word, from the upper bits of its hash (the lower ones choose the word)."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58 - 6 * i).bitwiseAND(63).cast("int"))
    return reduce(Column.bitwiseOR, map(one, range(BITS_SET)))


def bloom_filter(keys: DataFrame, hashed: Column, expected: int) -> tuple[DataFrame, int]:
    """A Bloom filter of `hashed` (a long) over keys: __block and its __words, and how many words there are in all. At most
    MOST_BITS bits, whatever there is. A key has all its bits in one word; words without keys are there, too."""
    words = 1 << (max(min(MOST_BITS, expected * BITS_PER_KEY) // 64, 128) - 1).bit_length()
    held = keys.select(hashed.alias("__hash")).select(F.col("__hash").bitwiseAND(words - 1).alias("__word"), _mask(F.col("__hash")).alias("__bits"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("__word"), F.lit(0).cast("long").alias("__bits"))
    each = held.unionByName(none).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    row = F.transform(F.sort_array(F.collect_list(F.struct("__word", "__bits"))), lambda x: x["__bits"])
    return each.groupBy(F.shiftright("__word", WORDS_LOG).alias("__block")).agg(row.alias("__words")), words


def with_possible(df: DataFrame, bloom: tuple[DataFrame, int], hashed: Column) -> DataFrame:
    """df with __possible: false where the filter proves that `hashed` isn't in it."""
    blocks, words = bloom
    word = F.col("__hash").bitwiseAND(words - 1)
    keyed = df.withColumn("__hash", hashed).withColumn("__block", F.shiftright(word, WORDS_LOG))
    here, mask = F.get("__words", word.bitwiseAND((1 << WORDS_LOG) - 1).cast("int")), _mask(F.col("__hash"))
    return keyed.join(F.broadcast(blocks), "__block", "left").select(*df.columns, F.coalesce(here.bitwiseAND(mask) == mask, F.lit(False)).alias("__possible"))


def earliest(references: DataFrame) -> DataFrame:
    """A row delivered repeatedly is one, and its earliest time counts."""
    return references.groupBy("table_name", "run_id", "row_id", "ref_id").agg(F.min("ref_time").alias("ref_time"))


def run_store_deliveries(dependencies: DataFrame, edges: DataFrame, verifications: DataFrame) -> DataFrame:
    """table_name, run_id, row_id, ref_id, ref_time (seconds; null: unknown) of the three referring tables, as delivered.

    Null, empty and blank ids are no references.
    """
    of = lambda df, name, row, ref, time: df.select(F.lit(name).alias("table_name"), "run_id", clean_id(row).alias("row_id"), clean_id(ref).alias("ref_id"), seconds(time).alias("ref_time"))
    rows = reduce(DataFrame.unionByName, (
        of(dependencies, "task_dependencies", "task_id", "depends_on", "registered_at"),
        of(edges, "graph_edges", "edge_id", "source_episode_id", "recorded_at"),
        of(verifications, "claim_verifications", "decision_id", "claim_id", "created_at"),
    ))
    return rows.where("ref_id is not null")


def run_store_references(dependencies: DataFrame, edges: DataFrame, verifications: DataFrame) -> DataFrame:
    """The same, each reference once."""
    return earliest(run_store_deliveries(dependencies, edges, verifications))


def run_store_parents(tasks: DataFrame, episodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """table_name (of the referring table), run_id, ref_id, arrived, deleted (seconds) of the records referred to.

    A record delivered repeatedly is one, with its earliest arrival and deletion.
    """
    of = lambda df, name, key, time: df.select(F.lit(name).alias("table_name"), "run_id", clean_id(key).alias("ref_id"), seconds(time).alias("arrived"), seconds("deleted_at").alias("deleted"))
    rows = reduce(DataFrame.unionByName, (
        of(tasks, "task_dependencies", "task_id", "registered_at"),
        of(episodes, "graph_edges", "episode_id", "retrieved_at"),
        of(nodes.where("node_type = 'Claim'"), "claim_verifications", "node_id", "created_at"),
    ))
    return rows.where("ref_id is not null").groupBy("table_name", "run_id", "ref_id").agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"))


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references that no parent answers, with `reason`: missing, deleted (not after the reference) or later.

    references: table_name, run_id, row_id, ref_id, ref_time, repeated or not; parents: table_name, run_id, ref_id, arrived,
    deleted, one row per key. Without ref_time only non-existence counts; a parent without arrival time was always there.
    """
    key = ["table_name", "run_id", "ref_id"]
    hashed = F.xxhash64(*key)
    flagged = with_possible(references.select("table_name", "run_id", "row_id", "ref_id", "ref_time"), bloom_filter(parents, hashed, parents.count()), hashed)
    surely = earliest(flagged.where("not __possible")).withColumn("reason", F.lit("missing"))
    there = parents.select(*key, F.struct("arrived", "deleted").alias("parent"))
    reason = (
        F.when(F.col("parent").isNull(), "missing")
        .when(F.col("parent.deleted") <= F.col("ref_time"), "deleted")
        .when(F.col("parent.arrived") > F.col("ref_time"), "later")
    )
    verified = earliest(flagged.where("__possible")).join(there, key, "left").withColumn("reason", reason).where("reason is not null")
    return surely.unionByName(verified.select(*surely.columns))


def orphan_counts(found: DataFrame) -> DataFrame:
    """table_name, run_id, period (month of the reference; null: unknown), reason, orphans."""
    month = F.date_format(F.timestamp_seconds("ref_time"), "yyyy-MM")
    return found.groupBy("table_name", "run_id", month.alias("period"), "reason").agg(F.count("*").alias("orphans"))
