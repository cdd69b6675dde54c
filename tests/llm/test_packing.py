from __future__ import annotations

import random
from collections import defaultdict

import regex

from tessera.llm import packing

GPT2 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def budgets(spark, *capacities):
    return spark.createDataFrame([(i + 1, "x", c) for i, c in enumerate(capacities)], "budget_id long, purpose string, capacity_tokens int")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["don't", "Prüfung", "x", "12", "3.5", "—", "  ", "\n\n", " ", "naïve", "we'll", "日本語", "🙂", "\t"]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


def test_token_counts_match_the_published_pattern(spark):
    texts = random_texts(200) + ["", None, " ", "a  b", "it's  \n x "]
    df = docs(spark, texts)
    got = {r.doc_id: r.n for r in df.select("doc_id", packing.token_count(df["text"]).alias("n")).collect()}
    assert got == {i: len(GPT2.findall(t or "")) for i, t in enumerate(texts)}


def test_packing_is_whole_bounded_and_tight(spark):
    texts = random_texts(600, 2) + ["", None, "word " * 500]
    df = docs(spark, texts)
    for shard_items in (50, 20_000):
        got = packing.pack(df, budgets(spark, 64, 128), shard_items).collect()
        for budget, capacity in ((1, 64), (2, 128)):
            mine = [r for r in got if r.budget_id == budget]
            load, seen = defaultdict(int), defaultdict(list)
            for r in mine:
                load[r.container_id] += r.tokens
                seen[r.doc_id].append((r.piece, r.tokens, r.pieces))
            assert max(load.values()) <= capacity
            for i, text in enumerate(texts):
                n = len(GPT2.findall(text or ""))
                assert sum(x[1] for x in seen[i]) == n and sorted(x[0] for x in seen[i]) == list(range(len(seen[i])))
                assert (len(seen[i]) > 1) == (n > capacity) and len(seen[i]) == max(1, -(-n // capacity))
            if shard_items > 1000:
                assert sum(load.values()) / (len(load) * capacity) > 0.95
        assert {(r.budget_id, r.doc_id) for r in packing.divided(packing.pack(df, budgets(spark, 64, 128))).collect()} == {(r.budget_id, r.doc_id) for r in got if r.pieces > 1}


def test_pieces_give_back_the_text(spark):
    df = docs(spark, random_texts(40, 3))
    b = budgets(spark, 16)
    packed = packing.pack(df, b)
    parts = defaultdict(dict)
    for r in packing.piece_texts(df, packed, b).collect():
        parts[r.doc_id][r.piece] = r.text
    texts = dict(enumerate(random_texts(40, 3)))
    assert parts and all("".join(p[i] for i in sorted(p)) == texts[d] for d, p in parts.items())


def test_place_takes_the_cheapest_sequence_with_room():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(0, 100) for _ in range(400)), reverse=True)
    out = packing.place(sizes, 100)
    load, cost = defaultdict(int), defaultdict(float)
    count = -(-sum(sizes) // 100)
    for n, i in zip(sizes, out, strict=True):
        open_ones = [j for j in range(max(count, i + 1)) if load[j] + n <= 100 and j < max(count, max(load, default=0) + 1)]
        assert load[i] + n <= 100 and cost[i] <= min(cost[j] for j in open_ones) + 1e-9
        load[i] += n
        cost[i] += n + n * n / (6 * packing.WIDTH)


def test_empty_table_and_repeats(spark):
    assert packing.pack(docs(spark, []), budgets(spark, 8)).count() == 0
    twice = docs(spark, ["a b"]).unionByName(docs(spark, ["a b"])).selectExpr("*", "1 as size", "2 as shard", "3 as piece")
    assert packing.pack(twice, budgets(spark, 8, 0)).count() == 2


def test_a_very_long_text(spark):
    text = "wall loss of 3 mm, " * 50_000
    df = docs(spark, [text, "x"])
    got = packing.pack(df, budgets(spark, 1000)).where("doc_id = 0").collect()
    assert sum(r.tokens for r in got) == len(GPT2.findall(text)) and max(r.tokens for r in got) == 1000


def test_many_budgets_and_long_documents(spark, monkeypatch):
    """No bound on the number of budgets; shards are sized by pieces, however long single documents are."""
    monkeypatch.setattr(packing, "SOME_BUDGETS", 2)
    df = docs(spark, ["word " * 3000, "a b c", "d"])
    packed = packing.pack(df, budgets(spark, 8, 16, 32, 64, 128), 100)
    got = {r.budget_id: r for r in packing.totals(packed, budgets(spark, 8, 16, 32, 64, 128)).collect()}
    size = len(GPT2.findall("word " * 3000))
    assert {b: (r.documents, r.pieces, r.tokens, r.overfull) for b, r in got.items()} == {i + 1: (3, -(-size // c) + 2, size + 4, 0) for i, c in enumerate((8, 16, 32, 64, 128))}
    shards = {(r.budget_id, r.container_id >> 32) for r in packed.collect()}
    assert len([s for s in shards if s[0] == 1]) == 4
