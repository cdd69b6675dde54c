from __future__ import annotations

import random

import pytest

from tessera.llm import leakage

WORDS = "the crew of Prüfung measured coverage near Zolauk while inspection hours fell below plan because risers had cracked twice under load and nobody could say whether thermography or radiography was to blame for it in the second campaign of that wet year".split()


def items(spark, passages):
    return spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, passages, texts):
    return sorted(tuple(r) for r in leakage.leaked(docs(spark, texts), items(spark, passages)).collect())


def change(words, at, how):
    w = list(words)
    if how == "change":
        w[at] = "something"
    elif how == "drop":
        del w[at]
    else:
        w.insert(at, "surely")
    return w


def test_disguises_are_seen_through(spark):
    text = " ".join(WORDS)
    texts = [
        text.upper(),
        text.replace(" ", "\n"),
        text.replace("inspection", "inspec-\ntion").replace("radiography", "radio­graphy").replace("ü", "ü"),
        text.replace(" ", " ​").replace("Prüfung", "Prufung"),
        "noise before " + ", ".join(WORDS[5:23]) + " and after",
        *["intro " + " ".join(change(WORDS[4:30], at, how)) for at in (8, 13, 17) for how in ("change", "drop", "add")],
        " ".join(change(change(WORDS, 8, "change"), 20, "drop")),
    ]
    assert found(spark, [text], texts) == [(i, 0) for i in range(len(texts))]


def test_short_quotations_prompts_and_other_order_are_no_cases(spark):
    text = " ".join(WORDS)
    half = len(WORDS) // 3
    other = WORDS[half * 2 :] + WORDS[half : half * 2] + WORDS[:half]
    texts = [" ".join(WORDS[:17]), " ".join(WORDS[3:20]), " ".join(other), "x " * 100, "", None, text[::-1]]
    assert found(spark, [text], texts) == []
    assert found(spark, [" ".join(WORDS[:17]), "", None], [text]) == []


def test_exact_stretches_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}x" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))] for _ in range(12)]
    texts, want = [], set()
    for d in range(60):
        p = rng.randrange(len(passages))
        n = min(rng.randrange(12, 26), len(passages[p]))
        at = rng.randrange(len(passages[p]) - n + 1)
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(20)] + passages[p][at : at + n] + [rng.choice(vocabulary) for _ in range(20)]))
        for q, words in enumerate(passages):
            joined = f" {texts[-1]} "
            if any(f" {' '.join(words[i : i + 18])} " in joined for i in range(len(words) - 17)):
                want.add((d, q))
    assert set(found(spark, [" ".join(p) for p in passages], texts)) >= want
    extra = set(found(spark, [" ".join(p) for p in passages], texts)) - want
    assert len(extra) <= 2  # a stretch of 17 may go on by chance


def test_offsets_point_into_the_original(spark):
    text = "Vorspann: ﬁx! " + " — ".join(WORDS[2:24]).replace("measured", "meas-\nured") + " (Ende)"
    row = leakage.leaks(docs(spark, [text]), items(spark, [" ".join(WORDS)])).first()
    cut = text[row.char_from : row.char_to]
    assert cut.startswith("of — Prüfung") and leakage.normalise(cut) == leakage.normalise(" ".join(WORDS[2:24])) and row.words == 22


def test_same_passage_twice_clashing_columns_and_bound(spark):
    text = " ".join(WORDS)
    df = docs(spark, [text]).selectExpr("*", "1 as item_id", "2 as words")
    assert sorted(tuple(r) for r in leakage.leaked(df, items(spark, [text, text])).collect()) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        leakage.leaks(df, items(spark, [text]), most_chars=10)
    other = " ".join(reversed(WORDS))
    many = leakage.leaks(docs(spark, [text, other]), items(spark, [text, other, text]), most_chars=len(text))  # several automata
    assert sorted((r.doc_id, r.item_id) for r in many.collect()) == [(0, 0), (0, 2), (1, 1)]


def hits(words, changed):
    texts = ["in front of it " + " ".join(w) + " and after it" for w in changed]
    p = leakage.Passages([(0, " ".join(words))])
    return [bool(p.stretches(t)) for t in texts]


def test_one_slip_at_every_place_of_the_shortest_stretch():
    cut = WORDS[8:26]
    assert len(cut) == 18
    assert hits(WORDS, [change(cut, at, how) for at in range(1, 17) for how in ("change", "drop", "add")]) == [True] * 48
    assert hits(WORDS, [change(cut, at, "change") for at in (0, 17)] + [cut[1:], cut[:-1]]) == [False] * 4


def test_several_slips():
    cut = WORDS[8:26]
    pairs = [change(change(cut, a, "change"), b, how) for a in range(1, 15) for b in range(a + 2, 17) for how in ("change", "drop", "add")]
    assert all(hits(WORDS, pairs))
    # three in a stretch of 18 words, wherever they are, and every fifth word of 24
    threes = [change(change(change(cut, a, "change"), b, "change"), c, "change") for a in range(1, 13) for b in range(a + 2, 15) for c in range(b + 2, 17)]
    assert all(hits(WORDS, threes))
    assert hits(WORDS, [[("something" if i % 5 == 4 else w) for i, w in enumerate(WORDS[6:30])]]) == [True]


def test_other_figures_are_another_statement():
    said = "with worn probes in place of new ones the yield at Homem fell from 594 to 26 during three long night shifts".split()
    other = [{"594": "2274", "26": "1644"}.get(w, w) for w in said]
    assert hits(said, [said, other, change(said, 13, "change")]) == [True, False, True]
    long = [*WORDS[:12], "17", *WORDS[12:]]
    assert hits(long, [["18" if w == "17" else w for w in long]]) == [True]  # long runs on both sides


def test_a_very_long_text(spark):
    text = "nothing of note here " * 50_000 + " ".join(WORDS) + " and on it goes" * 50_000
    row = leakage.leaks(docs(spark, [text]), items(spark, [" ".join(WORDS)])).first()
    assert row.words == len(WORDS) and text[row.char_from : row.char_to] == " ".join(WORDS)
