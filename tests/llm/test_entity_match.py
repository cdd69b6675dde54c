from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import entity_match as em
from tessera.llm import inverted_index as ii

SCHEMA = "run_id string, node_id string, node_type string, data_json string"


def nodes(spark, *rows):
    return spark.createDataFrame([("r", i, kind, data if data is None or isinstance(data, str) else json.dumps(data)) for i, kind, data in rows], SCHEMA)


def registry(name, **attributes):
    return {"source_system": "registry", "name": name, "attributes": attributes}


def crawl(name, **attributes):
    return {"source_system": "webcrawl", "name": name, "attributes": attributes}


def listed(name, **attributes):
    return {"src": "supplier_list", "label": name, "attributes": attributes}


def test_common_forms():
    f = em.features(json.dumps(crawl("The Drobriprer Castíngs Company", location="Bralia, NL", since="22 Dec 1982", tel="0966/988-784", site="drobriprer.example")))
    assert (f["source"], f["words"], f["city"], f["country"], f["date"], f["tel"], f["site"]) == ("webcrawl", ["drobriprer", "castings"], "bralia", "nl", (1982, 12, 22), "966988784", "drobriprer")
    g = em.features(json.dumps(listed("Sula model DL 7626s", mass="200600 g", est="07/10/1966")))
    assert (g["words"], g["codes"], g["mass"], g["date"]) == (["sula"], ["dl7626s"], 200600, (1966, 10, 7))
    assert em.features(json.dumps(registry("X AT-9905", mass="200.6 kg")))["mass"] == 200600
    assert em.features(json.dumps(listed("Romia-09 Refinery")))["numbers"] == [9]
    assert em.features('{"attributes": {"city": "Oslo", "founded": "2001"}, "na')["source"] == "registry"  # cut off
    assert em.features(None)["source"] is None and em.features("[1, 2]")["words"] == []
    assert [em.date_of(x) for x in ("2002-03-21", "08/2022", "2017", "16/05/1949", "?")] == [(2002, 3, 21), (2022, 8, 0), (2017, 0, 0), (1949, 5, 16), None]


def test_words():
    assert em.same_word("robotics", "rob") and em.same_word("inspection", "insepction") and em.same_word("test", "tst") and em.same_word("controls", "ctrl")
    assert not em.same_word("composites", "controls") and not em.same_word("com", "controls") and not em.same_word("welding", "robotics")


def world(spark, n=40, seed=2):
    rng = random.Random(seed)
    syllables = "bra klo vei tris gou nep stal wim drau fex".split()
    rows, want = [], set()
    for i in range(n):
        stem = "".join(rng.sample(syllables, 3)).capitalize()
        sector = rng.choice(["Welding", "Robotics", "Optics"])
        city, year, month, day = "".join(rng.sample(syllables, 2)), rng.randrange(1950, 2020), rng.randrange(1, 13), rng.randrange(1, 28)
        rows.append((f"o:{i:03}a", "Organization", registry(f"{stem} {sector} Ltd", city=city, founded=f"{year}-{month:02}-{day:02}")))
        slip = stem[:3] + stem[4:]
        rows.append((f"o:{i:03}b", "Organization", crawl(f"{slip} {sector[:3]}.", location=f"{city}, NL", since=f"{month:02}/{year}")))
        want.add((f"o:{i:03}a", f"o:{i:03}b"))
        if i % 2:
            rows.append((f"o:{i:03}c", "Organization", listed(f"{sector.upper()}, {stem}", town=city.upper(), est=f"{day:02}/{month:02}/{year}")))
            want |= {(f"o:{i:03}a", f"o:{i:03}c"), (f"o:{i:03}b", f"o:{i:03}c")}
    return nodes(spark, *rows), want


def test_misspelt_entities_are_found(spark):
    df, want = world(spark)
    got = {(r.left_node_id, r.right_node_id) for r in em.matches(df).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


@pytest.mark.parametrize(("rare", "hot"), [(30, 1_000), (1, 1_000), (1, 2)])
def test_search_is_exact(spark, monkeypatch, rare, hot):
    """The pruned search finds the same best nodes and scores as scoring every pair, with salted keys too."""
    monkeypatch.setattr(ii, "RARE_NODES", rare)
    monkeypatch.setattr(ii, "HOT_ROWS", hot)
    df, _ = world(spark, 30, 8)
    few = nodes(spark, ("o:y1", "Organization", registry("", founded="1999")), ("o:y2", "Organization", crawl("", since="1999")), ("o:y3", "Organization", listed("Optics Optcs", est="1999")))
    indexed = em.index_classes(em.read_nodes(df.unionByName(few)))
    length = {r.nid: (r.length, r.src) for r in indexed.collect()}
    average = sum(n for n, _ in length.values()) / len(length)
    own = {}
    for r in ii.weighted(ii.postings(indexed), {"Organization": len(length)}).orderBy(F.desc("x.own"), "x.g").collect():
        own.setdefault(r.nid, {}).setdefault(r.x.t, (r.x.g, r.x.w))

    def total(a, shared):
        best = {}
        for t in shared:
            g, w = own[a][t]
            best[g] = max(best.get(g, 0), w)
        return sum(best.values())

    share, want = 0.3, {}
    need = {a: share * total(a, own[a]) for a in own}
    for a in own:
        for b in own:
            if length[a][1] != length[b][1]:
                shared = own[a].keys() & own[b].keys()
                if min(total(a, shared), total(b, shared)) >= max(need[a], need[b]) > 0:
                    norm = (ii.K1 + 1) / (1 + ii.K1 * (1 - ii.B + ii.B * length[b][0] / average))
                    want.setdefault((a, length[b][1]), []).append((round(total(a, shared) * norm / ii.UNIT, 3), b))
    got = {}
    for r in ii.search(indexed, share).collect():
        got.setdefault((r.nid, r.other_src), []).append((round(r.score, 3), r.other_id, round(r.next_score, 3)))
    assert got.keys() == want.keys() and len(want) > 60
    for key, found in want.items():
        best = max(s for s, _ in found)
        assert {b for s, b in found if s > best - 2e-3} == {b for _, b, _ in got[key]}
        rival = sorted((s for s, _ in found), reverse=True)[1:2] or [0]
        assert all(abs(s - best) < 2e-3 and abs(n - rival[0]) < 2e-3 for s, _, n in got[key])


def test_confidence_is_fitted_without_labels():
    """The fit finds held-out matches of a made-up mixture, never seeing which pairs they are."""
    rng = random.Random(4)

    def pair(match):
        pick = lambda yes, no, p: yes if rng.random() < p else no
        good = 0.9 if match else 0.15
        out = {"name": pick("same", "other", good), "city": pick("same", "other", good), "date": pick("month", "other", good), "gap": pick("3", "0", good)}
        return {k: v for k, v in out.items() if rng.random() < 0.9}

    truth = [rng.random() < 0.6 for _ in range(4000)]
    seen = [pair(m) for m in truth]
    constant, weights = em.fit(seen[:2000])
    right = sum((em.confidence(p, weights, constant) >= 0.5) == m for p, m in zip(seen[2000:], truth[2000:], strict=True))
    assert right >= 0.93 * 2000
    assert abs(em.confidence({}, weights, constant) - 0.6) < 0.05
    with pytest.raises(ValueError):
        em.fit([{}] * (em.FIT_PAIRS + 1))


def test_names_in_any_script_and_unknown_attributes(spark):
    df, _ = world(spark, 20)
    two = nodes(
        spark,
        ("o:r1", "Organization", registry("Северсталь Оптика", headquarters="Череповец")), ("o:r2", "Organization", crawl("Северсталь Оптика", based_in="Череповец")),
        ("o:z1", "Organization", {"name": "Wotan Klamm", "attributes": {"headquarters": "Uxmal", "motto": ["per aspera"]}}), ("o:z2", "Organization", listed("Wotan Klamm", motto="Per Aspera")),
    )
    got = {tuple(r)[:2] for r in em.matches(df.unionByName(two)).collect()}
    assert {("o:r1", "o:r2"), ("o:z1", "o:z2")} <= got


def test_all_versions_of_a_node_count(spark):
    df, _ = world(spark, 20)
    two = nodes(spark, ("o:v1", "Organization", registry("Trukloun Group")), ("o:v1", "Organization", registry("Zzz Nothing")), ("o:v2", "Organization", listed("Trukloun")))
    assert ("o:v1", "o:v2") in {tuple(r)[:2] for r in em.matches(df.unionByName(two)).collect()}


def test_other_things_of_the_same_brand_are_no_match(spark):
    df = nodes(
        spark,
        ("p:1", "Product", registry("Pugrourt AP-38659", city="Brupen", since="1972-04-25")),
        ("p:2", "Product", crawl("AP3865S by Pugrourt", location="Brupen, PT", since="26/01/2004")),
        ("f:1", "Facility", registry("Suvar Pumping Station 59", city="Huvliath")),
        ("f:2", "Facility", listed("Suvar Pumping #34", town="Huvliath")),
        *[(f"p:x{i}", "Product", registry(f"Filler{chr(97 + i)}{chr(98 + i)} QX-{1000 + i}")) for i in range(20)],
    )
    assert em.matches(df).count() == 0


def test_nulls_empty_and_repeats(spark):
    df, want = world(spark, 6)
    odd = nodes(spark, ("o:n", "Organization", None), ("o:e", "Organization", ""), ("o:j", "Organization", "{}"), (None, "Organization", {"name": "x"}), ("c:1", "Claim", crawl("Any Name")))
    again = df.unionByName(odd).unionByName(df.withColumn("run_id", F.lit("other"))).selectExpr("*", "1 as nid", "2 as t", "3 as w")
    assert {tuple(r)[:2] for r in em.matches(again).collect()} <= want
    assert em.matches(df.limit(0)).count() == 0


def test_equal_nodes_all_match(spark):
    """Copies under other ids, in any order and partitioning, have the pairs of the node they repeat."""
    df, _ = world(spark, 20)
    one = {tuple(r) for r in em.matches(df).collect()}
    copies = df.where("node_id like '%b'").withColumn("node_id", F.concat(F.lit("a"), "node_id"))
    more = copies.unionByName(copies.withColumn("node_id", F.concat("node_id", F.lit("x"))).withColumn("run_id", F.lit("other")))
    b_ids = lambda x: [x, "a" + x, "a" + x + "x"] if x.endswith("b") else [x]
    want = {(min(a, b), max(a, b), kind, c) for left, right, kind, c in one for a in b_ids(left) for b in b_ids(right)}
    both = df.unionByName(more)
    assert len(want) > len(one) and {tuple(r) for r in em.matches(both).collect()} == want
    assert {tuple(r) for r in em.matches(both.orderBy(F.desc("node_id")).repartition(7)).collect()} == want


def test_one_rare_word_is_enough(spark):
    """The score a match needs does not grow with the number of nodes: a name of one word finds its like."""
    df, _ = world(spark, 20)
    two = nodes(spark, ("o:x1", "Organization", registry("Trukloun Group")), ("o:x2", "Organization", listed("Trukloun")))
    got = {tuple(r)[:2] for r in em.matches(df.unionByName(two)).collect()}
    assert ("o:x1", "o:x2") in got
