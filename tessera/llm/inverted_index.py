"""Cross-table retrieval: BM25 over an inverted index, exact pairs above a share of what both sides could reach.

A node is a query against the nodes of its type in every other source. Its tokens come in groups (a word and its
misspellings, a date and its parts); of a group only the heaviest token that two nodes share counts. Words one slip apart
share one of the words they give with a letter left out: this is worked out once over the vocabulary, where the rarer of
two such words points to the more frequent one (its hub), and a node carries the hubs of its words as further tokens.

Exact pruning. A pair counts if its sum of weights reaches `share` of what each of its two nodes could reach. Tokens have
one global order by weight; of a pair that counts, the heaviest shared token and the next one outside its family together
with all that is lighter must reach what is needed on both sides. So each node is indexed under the tokens and pairs of
tokens for which that holds, and two nodes meet only where they have such a key in common. Rare tokens are keys by
themselves. Weights are whole numbers, so no bound depends on rounding.

Skew. Keys under which more than HOT_ROWS nodes meet are salted; words and tokens that many nodes share are joined with
their small tables by broadcast after a check of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: BM25: every token occurs once in a node; its length is its number of groups.
K1, B = 1.2, 0.2
#: Weight of a misspelt word against that of the word.
FUZZY = 0.7
#: Tokens in at most so many nodes are keys by themselves (a matter of cost: the results are the same).
RARE_NODES = 30
#: Rows of one key from which on its join is salted, and the most keys whose salts are broadcast.
HOT_ROWS, MOST_HOT_KEYS = 1_000, 100_000
#: Units of a weight of 1, and the bits of a packed token: hash, weight, group.
UNIT, HASH_BITS, WEIGHT_BITS, GROUP_BITS = 128, 39, 12, 12
_LOW = (1 << GROUP_BITS) - 1
#: Token kinds whose values may be misspelt, with the kind of their hubs; and kinds that are parts of one attribute.
FUZZY_KINDS = {"w": "f", "c": "d"}
ONE_ATTRIBUTE = {"y": "date", "ym": "date", "ymd": "date", "md": "date", "g": "geo"}
#: Attributes without a known meaning count only if another source has the same value.
OTHER_KIND = "a"

TOKEN_TYPE = "array<struct<g:int,k:string,v:string>>"


def join_counted(left: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined with a table of one row per key, whose column count says how many rows of left have the key.

    The few keys with more than a thousandth of all rows (at most a thousand, so a broadcast is bounded) are joined without
    a shuffle of their rows; the rest meets in a shuffle in which no key is hot."""
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * 1000 > max(total, 1_000_000)
    hot = F.broadcast(table.where(is_hot))
    direct = left.join(hot, on)
    rest = left.join(F.broadcast(table.where(is_hot).select(*on)), on, "left_anti").join(table.where(~is_hot), on, how)
    return direct.unionByName(rest)


def vocabulary_hubs(tokens: DataFrame) -> DataFrame:
    """node_type, k, v, hubs, nodes: for each word that is a hub or has one, its hubs (itself included if it is one). A
    word's hubs are the words one slip apart that are at least as frequent. Words of fewer than five letters have none.

    The words that give one and the same string with a letter left out are at most (alphabet x length) many."""
    words = tokens.where(F.col("k").isin(*FUZZY_KINDS)).groupBy("node_type", "k", "v").agg(F.count("*").alias("nodes"))
    long = words.where(F.length("v") >= 5)
    shorter = F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.col("v").substr(F.lit(1), i - 1), F.col("v").substr(i + 1, F.length("v"))))
    given = long.select("node_type", "k", "v", "nodes", F.explode(F.array_distinct(F.array_append(shorter, F.col("v")))).alias("s"))
    alike = given.groupBy("node_type", "k", "s").agg(F.collect_list(F.struct("nodes", "v")).alias("ws")).where(F.size("ws") > 1)
    pairs = alike.select("node_type", "k", F.explode("ws").alias("one"), "ws").select("node_type", "k", F.col("one.v").alias("v"), F.explode(F.filter("ws", lambda x: x > F.col("one"))).alias("hub"))
    to_hub = pairs.select("node_type", "k", "v", F.col("hub.v").alias("hub"))
    own = pairs.select("node_type", "k", F.col("hub.v").alias("v"), F.col("hub.v").alias("hub"))
    hubs = to_hub.unionByName(own).groupBy("node_type", "k", "v").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))
    return hubs.join(words, ["node_type", "k", "v"])


def _family(kind: Column, value: Column) -> Column:
    """What the tokens have in common of which never two count for one word or attribute."""
    family = F.when(kind == "f", "w").when(kind == "d", "c").otherwise(kind)
    for k, name in ONE_ATTRIBUTE.items():
        family = F.when(kind == k, name).otherwise(family)
    return F.xxhash64("node_type", family, F.when(kind.isin(*ONE_ATTRIBUTE), "").otherwise(value))


def postings(indexed: DataFrame) -> DataFrame:
    """nid, node_type, src, g, own, t, family, other of every token, hubs of misspelt words included. own: not by way of a
    misspelling; other: of an attribute without a known meaning."""
    base = indexed.select("nid", "node_type", "src", F.inline("tokens"))
    hubs = cut(vocabulary_hubs(base))
    fuzzy = join_counted(base.where(F.col("k").isin(*FUZZY_KINDS)), hubs, ["node_type", "k", "v"], "nodes")
    hub_kind = F.create_map(*[F.lit(x) for pair in FUZZY_KINDS.items() for x in pair])[F.col("k")]
    fuzzy = fuzzy.select("nid", "node_type", "src", "g", F.col("v").alias("word"), hub_kind.alias("k"), F.explode("hubs").alias("v"))
    fuzzy = fuzzy.select("nid", "node_type", "src", "g", "k", "v", (F.col("v") == F.col("word")).alias("own"))
    both = base.withColumn("own", F.lit(True)).select(*fuzzy.columns).unionByName(fuzzy)
    token = F.shiftrightunsigned(F.xxhash64("node_type", "k", "v"), 64 - HASH_BITS)
    return both.select("nid", "node_type", "src", "g", "own", token.alias("t"), _family(F.col("k"), F.col("v")).alias("family"), F.col("k").isin(*FUZZY_KINDS.values()).alias("fuzzy"), (F.col("k") == OTHER_KIND).alias("other"))


def weighted(posted: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """postings with w (whole units), rare and shared (some other source has the token); attributes without a known
    meaning that no other source shares are left out."""
    frequency = posted.groupBy("t").agg(F.count("*").alias("df"), (F.min("src") < F.max("src")).alias("shared"))
    joined = join_counted(posted, cut(frequency), ["t"], "df")
    n = F.create_map(*[x for k, v in (sizes or {"": 0}).items() for x in (F.lit(k), F.lit(v))])[F.col("node_type")]
    idf = F.log(1 + (n - F.least("df", n) + 0.5) / (F.col("df") + 0.5))
    w = F.least(F.lit((1 << WEIGHT_BITS) - 1), F.greatest(F.lit(1), F.round(idf * F.when(F.col("fuzzy"), FUZZY).otherwise(1.0) * UNIT))).cast("int")
    kept = joined.where("shared or not other")
    return kept.select("nid", "node_type", "src", F.struct("t", w.alias("w"), "g", "family", "own", "shared", (F.col("df") <= RARE_NODES).alias("rare")).alias("x"))


def vector(xs: list[dict], share: float) -> tuple[int, int, list[int], list[int]]:
    """(self, need, packed tokens, keys) of a node's tokens."""
    tokens: dict[int, dict] = {}
    for x in sorted(xs, key=lambda x: (not x["own"], x["g"])):  # a hub that is a word of the node belongs to that word
        tokens.setdefault(x["t"], x)
    order = sorted(tokens.values(), key=lambda x: (x["w"], x["t"]))
    most: dict[int, int] = {}
    for x in order:
        x["g"] = 1 + x["g"] % _LOW
        most[x["g"]] = x["w"]
    whole = sum(most.values())
    need = max(1, -int(-share * whole // 1))
    order = [x for x in order if x["shared"]]  # what no other source has can't be met there
    best: dict[int, int] = {}
    reach, total = [], 0
    for x in order:
        total += x["w"] - best.get(x["g"], 0)
        best[x["g"]] = x["w"]
        reach.append(total)
    keys = []
    for i in range(len(order) - 1, -1, -1):
        if reach[i] < need:
            break
        x = order[i]
        if x["rare"] or x["w"] >= need:
            keys.append(x["t"])
        if not x["rare"]:
            for j in range(i - 1, -1, -1):
                if x["w"] + reach[j] < need:
                    break
                if order[j]["family"] != x["family"]:
                    keys.append(((x["t"] * 0x9E3779B97F4A7C15 + order[j]["t"]) & ((1 << 63) - 1)) | 1 << 62)
    packed = [x["t"] << (WEIGHT_BITS + GROUP_BITS) | x["w"] << GROUP_BITS | x["g"] for x in sorted(order, key=lambda x: (x["g"], -x["w"]))]
    return whole, need, packed, keys


def vectors(indexed: DataFrame, share: float) -> DataFrame:
    """nid, src, norm (BM25's length factor), self, need, vec, keys of each node with tokens."""
    stats = {r["node_type"]: r for r in indexed.groupBy("node_type").agg(F.count("*").alias("n"), F.avg("length").alias("length")).collect()}  # a row per type
    grouped = weighted(postings(indexed), {k: r["n"] for k, r in stats.items()}).groupBy("nid", "node_type", "src").agg(F.collect_list("x").alias("xs"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(xs, share) for xs in batch.column("xs").to_pylist()]
            columns = [batch.column("nid"), batch.column("src"), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["nid", "src", "self", "need", "vec", "keys"])

    built = grouped.mapInArrow(build, "nid bigint, src bigint, self int, need int, vec array<bigint>, keys array<bigint>")
    average = F.create_map(*[F.lit(x) for k, r in stats.items() for x in (k, float(r["length"]))]) if stats else F.create_map(F.lit(""), F.lit(1.0))
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / average[F.col("node_type")]))
    return cut(built.join(indexed.select("nid", norm.alias("norm")), "nid"))


def shared_weight(mine: Column, theirs: Column) -> Column:
    """The sum over the groups of `mine` (packed, by group and falling weight) of the heaviest token in `theirs` (hashes)."""
    common = F.filter(mine, lambda x: F.array_contains(theirs, F.shiftright(x, WEIGHT_BITS + GROUP_BITS)))
    group = lambda x: x.bitwiseAND(F.lit(_LOW))
    weight = lambda x: F.shiftright(x, GROUP_BITS).bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))
    # the state is the sum with the last group in its low bits
    add = lambda s, x: F.when(group(s) == group(x), s).otherwise(F.shiftleft(F.shiftright(s, GROUP_BITS) + weight(x), GROUP_BITS) + group(x))
    return F.shiftright(F.aggregate(common, F.lit(0).cast("long"), add), GROUP_BITS)


def pairs(vs: DataFrame) -> DataFrame:
    """node, other, src, other_src, raw, raw_back: pairs of nodes (nid, self, norm) of different sources whose shared weight
    reaches what both need; a pair may come more than once. raw is the sum by the groups of node, raw_back by those of other."""
    keyed = vs.select(F.struct("nid", "self", "norm").alias("node"), "nid", "src", "need", "vec", F.explode("keys").alias("key"))
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("met"), F.countDistinct("src").alias("srcs")).where((F.col("met") > HOT_ROWS) & (F.col("srcs") > 1)).select("key", F.ceil(F.col("met") / HOT_ROWS).cast("int").alias("salts")))
    many = hot.count()
    small = F.broadcast(hot) if many <= MOST_HOT_KEYS else hot
    spread = (keyed.join(small.select("key"), "key", "left_anti") if many else keyed).repartition("key")
    right = lambda df, *more: df.select("key", *more, F.col("node").alias("other"), F.col("src").alias("other_src"), F.col("need").alias("other_need"), F.col("vec").alias("other_vec"), F.transform("vec", lambda x: F.shiftright(x, WEIGHT_BITS + GROUP_BITS)).alias("other_ts"))
    met = spread.join(right(spread), "key").where("src < other_src").drop("key")
    if many:
        salted = keyed.join(small, "key")
        salt = F.pmod(F.xxhash64("nid"), F.col("salts"))
        left = salted.withColumn("salt", salt.cast("int")).drop("salts")
        each = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = met.unionByName(left.join(right(each, "salt"), ["key", "salt"]).where("src < other_src").drop("key", "salt"))
    # explode(array()) keeps the sum from being worked out twice
    one = met.select("*", F.explode(F.array(shared_weight(F.col("vec"), F.col("other_ts")))).alias("raw")).where("raw >= greatest(need, other_need)")
    ts = F.transform("vec", lambda x: F.shiftright(x, WEIGHT_BITS + GROUP_BITS))
    back = one.select("node", "other", "src", "other_src", "need", "other_need", "raw", F.explode(F.array(shared_weight(F.col("other_vec"), ts))).alias("raw_back"))
    return back.where("raw_back >= greatest(need, other_need)").select("node", "other", "src", "other_src", "raw", "raw_back")


def search(indexed: DataFrame, share: float, k: int = 1) -> DataFrame:
    """nid, other_id, other_src, score, share, nth, next_score: the k best nodes of each other source, with all that tie
    with the k-th. Only pairs count whose shared weight reaches `share` of what each of the two could reach at most.

    indexed: nid, node_type, src, length (number of groups), tokens. score is BM25's; next_score is that of the next node
    of the source (0 if there is none); share is the raw sum as a share of the most that nid could reach.
    """
    vs = vectors(indexed, share)
    found = pairs(vs)
    way = lambda a, b, s, raw: F.struct(F.col(a)["nid"].alias("a"), F.col(b)["nid"].alias("b"), F.col(s).alias("s"), F.round(F.col(raw) * F.col(b)["norm"] / UNIT, 4).alias("score"), (F.col(raw) / F.col(a)["self"]).alias("share"))
    both = found.select(F.explode(F.array(way("node", "other", "other_src", "raw"), way("other", "node", "src", "raw_back"))).alias("x")).select("x.*")
    scored = both.repartition("a").dropDuplicates(["a", "b"])
    in_source = Window.partitionBy("a", "s").orderBy(F.col("score").desc())
    ranked = scored.withColumns({"nth": F.rank().over(in_source), "next_score": F.coalesce(F.lead("score").over(in_source), F.lit(0.0))})
    # of nodes that tie, the one after the last of them is no rival either: they are rivals of each other
    tied = F.count("*").over(Window.partitionBy("a", "s", "score"))
    ranked = ranked.withColumn("next_score", F.when(tied > 1, F.col("score")).otherwise(F.col("next_score"))).where(F.col("nth") <= k)
    return ranked.select(F.col("a").alias("nid"), F.col("b").alias("other_id"), F.col("s").alias("other_src"), "score", "share", "nth", "next_score")
