"""Matching entities across sources that share no key.

Method: every node is a query against the nodes of its type in every other source. All its attributes, brought to a common
form, are tokens of an inverted index (`inverted_index`): BM25 with exact top-k pruning, in which misspelt words meet.
Nodes of a source that say the same are searched as one. Two nodes match if each is the other's best in its source (ties
are all kept). The confidence comes from the gap of the score to the runner-up and from which attributes agree or differ, through a logistic function. Its weights were fitted by `fit`; they are the logarithms of how much more often an
outcome occurs among matches than among other mutual best pairs.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.runstore import clean_id
from . import inverted_index

#: The source of nodes that do not tell it.
UNKNOWN = "unknown"
NOTHING = {"words": [], "codes": [], "numbers": [], "city": "", "country": "", "date": None, "tel": "", "mass": 0, "geo": None, "site": "", "other": []}
NODE_TYPES = ("Organization", "Product", "Facility")
#: The share of what either node could reach that a match needs at least.
LEAST_SHARE = 0.2

#: Words of names that tell nothing: legal forms and fillers.
FILLERS = frozenset("the company co inc incorporated ltd limited llc plc gmbh mbh gesellschaft aktiengesellschaft ag kg group gruppe groupe grupo holding holdings sa sarl sas srl bv nv b v s a pty oy ab by model mod type scanner no nr number".split())
#: Fillers long enough to be known when misspelt.
LONG_FILLERS = tuple(sorted(w for w in FILLERS if len(w) >= 5))
#: The keys that mean the same in different sources.
KEYS = {
    "city": ("city", "town", "location"), "country": ("jurisdiction", "country"), "date": ("founded", "since", "est", "established"),
    "tel": ("tel", "phone", "telephone"), "mass": ("mass", "weight"), "geo": ("geo", "coordinates"), "site": ("site", "website", "url"),
}
KNOWN_KEYS = frozenset(["name", "label", "source_system", "src", *(k for keys in KEYS.values() for k in keys)])
SOURCE_HINTS = {"supplier_list": ("label", "src", "town", "est", "staff"), "webcrawl": ("location", "site", "tel"), "registry": ("founded", "city", "jurisdiction")}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
GRAMS = {"g": 1, "kg": 1000, "t": 1_000_000, "lb": 453.592, "lbs": 453.592}

_PAIR = re.compile(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"')
_CODE = re.compile(r"\b([a-z]{1,3})[\s-]?(\d{3,6}[a-z]?)\b")
_NUMBER = re.compile(r"(?<![a-z\d])\d{1,4}(?![a-z\d])")
_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


def read(data: str | None) -> dict[str, list[str]]:
    """The texts of a data_json by key, whatever its nesting; of one that is cut off, what can be read."""
    out: dict[str, list[str]] = {}
    try:
        todo = [("", json.loads(data or "{}"))]
        while todo:
            key, x = todo.pop()
            if isinstance(x, dict):
                todo.extend(reversed(x.items()))
            elif isinstance(x, list):
                todo.extend((key, y) for y in reversed(x))
            elif isinstance(x, (str, int, float)) and not isinstance(x, bool) and str(x).strip():
                out.setdefault(key, []).append(str(x))
    except ValueError:
        for key, x in _PAIR.findall(data):
            out.setdefault(key, []).append(x)
    return out


def source_of(fields: dict[str, list[str]]) -> str | None:
    """The source a node names, else the one whose keys it uses; None if it says nothing of it."""
    named = fields.get("source_system") or fields.get("src")
    if named:
        return plain(named[0].strip())
    hits = {s: sum(k in fields for k in keys) for s, keys in SOURCE_HINTS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else None


def date_of(text: str) -> tuple[int, int, int] | None:
    """year, month, day; 0 where unknown. Days come before months."""
    text = plain(text)
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    word = next((MONTHS[w[:3]] for w in _WORD.findall(text) if w[:3] in MONTHS), 0)
    year = next((n for n in numbers if 1000 <= n <= 2999), 0)
    if not year:
        return None
    rest = numbers[1:] if numbers[0] == year else numbers[-2::-1] if numbers[-1] == year else []
    if word:
        return year, word, rest[0] if rest and 1 <= rest[0] <= 31 else 0
    month, day = (rest + [0, 0])[:2]
    return (year, month, day) if month <= 12 and day <= 31 else (year, 0, 0)


def features(data: str | None) -> dict:
    """What a node says, in a common form."""
    fields = read(data)
    pick = lambda kind: next((fields[k][0] for k in KEYS[kind] if k in fields), "")
    name = plain(next((fields[k][0] for k in ("name", "label") if k in fields), ""))
    inside = re.search(r"\(([^)]*)\)", name)
    name = re.sub(r"\([^)]*\)", " ", name)
    name = re.sub(r"\b([a-z])\.([a-z])\.", r"\1\2", name)
    codes = ["".join(c) for c in _CODE.findall(name) if c[0] not in FILLERS]
    name = _CODE.sub(lambda c: c[0] if c[1] in FILLERS else " ", name)
    place = plain(pick("city"))
    place, _, after = place.partition(",")
    place = place or (inside[1] if inside else "")
    mass = re.match(r"\s*([\d.]+)\s*([a-z]+)", plain(pick("mass")))
    geo = re.findall(r"-?\d+(?:\.\d+)?", pick("geo"))
    tel = re.sub(r"\D", "", pick("tel"))
    return {
        "source": source_of(fields),
        "other": sorted({plain(x).strip() for k, xs in fields.items() if k not in KNOWN_KEYS for x in xs}),
        "words": [w for w in _WORD.findall(name) if len(w) > 1 and not is_filler(w)],
        "codes": codes,
        "numbers": sorted({int(n) for n in _NUMBER.findall(name)}),
        "city": "".join(_WORD.findall(place)),
        "country": "".join(_WORD.findall(plain(pick("country")) or after)),
        "date": date_of(pick("date")),
        "tel": tel[-9:] if len(tel) >= 7 else "",
        "mass": round(float(mass[1]) * GRAMS[mass[2]]) if mass and mass[2] in GRAMS and mass[1].count(".") < 2 and mass[1] != "." else 0,
        "geo": [float(geo[0]), float(geo[1])] if len(geo) >= 2 else None,
        "site": "".join(_WORD.findall(plain(pick("site")).removeprefix("https://").removeprefix("http://").removeprefix("www.").partition(".")[0])),
    }


def tokens(f: dict) -> tuple[list[tuple[int, str, str]], int]:
    """(group, kind, value) of each token, and the number of groups."""
    groups: list[list[tuple[str, str]]] = [[("w", w)] for w in dict.fromkeys([*f["words"], *([f["site"]] if f["site"] else [])])]
    groups += [[("k", c)] for c in f["codes"]] + [[("n", str(n))] for n in f["numbers"]]
    groups += [[(k, f[name])] for k, name in (("c", "city"), ("l", "country"), ("t", "tel")) if f[name]]
    if f["date"]:
        y, m, d = f["date"]
        groups.append([("y", f"{y}")] + ([("ym", f"{y}-{m}")] if m else []) + ([("ymd", f"{y}-{m}-{d}"), ("md", f"{m}-{d}")] if d else []))
    if f["mass"]:
        groups.append([("m", str(f["mass"]))])
    if f["geo"]:
        cells = {(math.floor((f["geo"][0] + a) * 10), math.floor((f["geo"][1] + b) * 10)) for a in (-0.02, 0.02) for b in (-0.02, 0.02)}
        groups.append([("g", f"{a}:{b}") for a, b in sorted(cells)])
    length = len(groups)
    groups += [[(inverted_index.OTHER_KIND, x)] for x in f["other"]]
    return [(g, k, v) for g, group in enumerate(groups) for k, v in group], length


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known = [features(x) for x in pdf["data_json"].tolist()]
        for f in known:  # neither the order of words and codes nor their number tells anything: equal nodes have equal texts
            f.update(words=sorted(set(f["words"])), codes=sorted(set(f["codes"])))
        said = [json.dumps({k: v for k, v in f.items() if v and k != "source"}, ensure_ascii=False) for f in known]
        yield pd.DataFrame({"node_id": pdf["node_id"].tolist(), "node_type": pdf["node_type"].tolist(), "source": [f["source"] or UNKNOWN for f in known], "features": said})


def said(features_text: str) -> dict:
    """The features of a node from their text, in which empty ones are left out."""
    return NOTHING | json.loads(features_text)


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [tokens(said(f)) for f in pdf["features"].tolist()]
        yield pdf.assign(tokens=[[{"g": g, "k": k, "v": v} for g, k, v in ts] for ts, _ in made], length=[n for _, n in made]).drop(columns="features")


READ_SCHEMA = "node_id string, node_type string, source string, features string"


def read_nodes(nodes: DataFrame) -> DataFrame:
    """nid, node_id, node_type, source, features: what each node of the types to match says, in a common form. Nodes of a
    type and source that say the same have one nid. A node that says different things in different runs has a row for each."""
    kept = nodes.where(F.col("node_type").isin(*NODE_TYPES) & F.col("data_json").isNotNull())
    read_once = kept.select(clean_id("node_id").alias("node_id"), "node_type", "data_json").where("node_id is not null").mapInPandas(_read, READ_SCHEMA)
    return cut(read_once.select(F.xxhash64("node_type", "source", "features").alias("nid"), "*").dropDuplicates(["node_id", "nid"]))


def index_classes(known: DataFrame) -> DataFrame:
    """nid, node_type, src, length, tokens: one row per nid of read_nodes, see inverted_index.search."""
    classes = known.select("nid", "node_type", F.xxhash64("source").alias("src"), "features").dropDuplicates(["nid"])
    return cut(classes.mapInPandas(_tokenise, f"nid bigint, node_type string, src bigint, tokens {inverted_index.TOKEN_TYPE}, length int"))


def slips(a: str, b: str, most: int = 2) -> bool:
    """Whether a becomes b with at most so many letters changed, added, missing or swapped."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row, older = row, [i + 1], before
        for j, y in enumerate(b):
            v = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                v = min(v, older[j - 1] + 1)
            row.append(v)
        before = last
    return row[-1] <= most


def less_one(word: str) -> set[str]:
    """The word, and the word with each of its letters left out: words one slip apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


_FILLERS_LESS_ONE = frozenset().union(*map(less_one, LONG_FILLERS))


def is_filler(word: str) -> bool:
    """Whether a word of a name tells nothing, misspelt or not."""
    if word in FILLERS:
        return True
    if not 3 < len(word) < 12 or _FILLERS_LESS_ONE.isdisjoint(less_one(word)):
        return False
    return any((word[0] == x[0] or word[-1] == x[-1]) and slips(word, x, 1) for x in LONG_FILLERS)


def same_word(a: str, b: str) -> bool:
    """Equal, misspelt, or one the abbreviation of the other."""
    short, long = sorted((a, b), key=len)
    if short == long or (len(short) >= 6 and slips(short, long)) or (len(short) >= 4 and len(short) > len(long) - 2 and slips(short, long, 1)):
        return True
    if 2 <= len(short) and len(long) <= 5 and slips(short, long, 1):
        return True
    if not 3 <= len(short) <= 6 or len(long) <= len(short) + 1 or short[0] != long[0]:
        return False
    if len(short) == 3:
        return set(short) <= set(long[:5])
    return slips(short, long[: len(short)], 1) or not Counter(short) - Counter(long)


def outcome(a: dict, b: dict) -> dict[str, str]:
    """How two nodes compare, by attribute; attributes that one of them lacks are left out."""
    out = {}
    rest_a = [w for w in a["words"] if not any(same_word(w, x) for x in b["words"])]
    rest_b = [w for w in b["words"] if not any(same_word(w, x) for x in a["words"])]
    if a["words"] and b["words"]:
        out["name"] = "other" if rest_a and rest_b else "part" if rest_a or rest_b else "same"
    # names that differ in a number are of different things, whatever their words; swapped letters of a code are a slip
    code = lambda c: "".join(sorted(_WORD.match(c)[0])) + c[_WORD.match(c).end() :]
    for mine, theirs in ((set(map(code, a["codes"])), set(map(code, b["codes"]))), (set(a["numbers"]), set(b["numbers"]))):
        if mine and theirs and not mine & theirs:
            out["name"] = "other"
    if a["city"] and b["city"]:
        out["city"] = "same" if a["city"] == b["city"] or slips(a["city"], b["city"]) else "other"
    if a["country"] and b["country"]:
        out["country"] = "same" if a["country"] == b["country"] else "other"
    if a["date"] and b["date"]:
        (y, m, d), (y2, m2, d2) = a["date"], b["date"]
        months = (not (m and m2) or m == m2) and (not (d and d2) or d == d2)
        out["date"] = "other" if abs(y - y2) > 1 or not months else ("month" if m and m2 else "year") if y == y2 else "near"
    if a["tel"] and b["tel"]:  # the last digits are an extension of an exchange
        out["tel"] = "same" if a["tel"] == b["tel"] else "exchange" if a["tel"][:6] == b["tel"][:6] else "other"
    if a["mass"] and b["mass"]:
        out["mass"] = "same" if abs(a["mass"] - b["mass"]) <= 0.01 * max(a["mass"], b["mass"]) else "other"
    if a["geo"] and b["geo"]:
        off = max(abs(x - y) for x, y in zip(a["geo"], b["geo"], strict=True))
        out["geo"] = "same" if off <= 0.025 else "near" if off <= 0.1 else "other"
    return out


#: Where the steps of the gap to the runner-up begin.
GAP_STEPS = (0.02, 0.2, 0.5)


def gap_step(gap: float) -> str:
    return str(sum(gap >= x for x in GAP_STEPS))


#: Outcomes that speak for a match where nothing is known yet.
AGREEING = frozenset(["same", "part", "month", "year", "near", "exchange"])
#: The most pairs `fit` is meant for: a sample of that size is enough for some thirty weights.
FIT_PAIRS = 50_000


def fit(pairs: list[dict[str, str]], rounds: int = 200) -> tuple[float, dict[str, dict[str, float]]]:
    """(constant, weights) of the logistic function from the outcomes of at most FIT_PAIRS mutual best pairs, without
    labels: the two-class model of record linkage (Fellegi and Sunter 1969), by expectation and maximisation.

    Each outcome has one chance among matches and one among other pairs; its weight is the logarithm of their ratio. A
    count of one for each outcome keeps rare ones finite."""
    if len(pairs) > FIT_PAIRS:
        raise ValueError(f"{len(pairs)} pairs; the fit is meant for a sample of at most {FIT_PAIRS}")
    counted = Counter(tuple(sorted(p.items())) for p in pairs)
    values: dict[str, set[str]] = {}
    for p in pairs:
        for k, v in p.items():
            values.setdefault(k, set()).add(v)
    fields = [k for k in values if k != "gap"]
    agree = {p: sum(1 if v in AGREEING else -1 for k, v in p if k in fields) for p in counted}
    posterior = {p: 0.9 if a > 0 else 0.1 for p, a in agree.items()}
    constant, weights = 0.0, {}
    for _ in range(rounds):
        total = sum(n * posterior[p] for p, n in counted.items())
        chance = total / len(pairs)
        weights = {}
        for k, vs in values.items():
            yes, no = dict.fromkeys(vs, 1.0), dict.fromkeys(vs, 1.0)
            for p, n in counted.items():
                v = dict(p).get(k)
                if v is not None:
                    yes[v] += n * posterior[p]
                    no[v] += n * (1 - posterior[p])
            all_yes, all_no = sum(yes.values()), sum(no.values())
            weights[k] = {v: math.log(yes[v] / all_yes) - math.log(no[v] / all_no) for v in sorted(vs)}
        constant = math.log(chance / (1 - chance))
        before, posterior = posterior, {p: confidence(dict(p), weights, constant) for p in counted}
        if max(abs(before[p] - posterior[p]) for p in counted) < 1e-6:
            break
    return round(constant, 3), {k: {v: round(x, 3) for v, x in ws.items()} for k, ws in weights.items()}


#: Logistic weights of the outcomes and the constant, fitted by `fit` on the 5,786 mutual best pairs of the sf0.1 tables.
CONSTANT = 0.746
WEIGHTS: dict[str, dict[str, float]] = {
    "city": {"other": -6.486, "same": 0.469},
    "country": {"other": -4.55, "same": 0.091},
    "date": {"month": 2.661, "near": 1.947, "other": -6.475, "year": 0.957},
    "gap": {"0": -6.367, "1": -3.285, "2": 0.252, "3": 2.017},
    "geo": {"near": -4.052, "other": -6.1, "same": 3.527},
    "mass": {"other": -6.395, "same": 1.791},
    "name": {"other": -6.073, "part": 2.833, "same": 3.581},
    "tel": {"exchange": 4.478, "other": -1.093, "same": 2.791},
}


def confidence(outcomes: dict[str, str], weights: dict[str, dict[str, float]] | None = None, constant: float | None = None) -> float:
    weights, constant = weights or WEIGHTS, CONSTANT if constant is None else constant
    z = constant + sum(weights.get(k, {}).get(v, 0.0) for k, v in outcomes.items())
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for gap, fa, fb in zip(pdf["gap"].tolist(), pdf["left_features"].tolist(), pdf["right_features"].tolist(), strict=True):
            found = outcome(said(fa), said(fb)) | {"gap": gap_step(gap)}
            rows.append((json.dumps(found), round(confidence(found), 6)))
        judged = pd.DataFrame(rows, columns=["outcomes", "confidence"], index=pdf.index)
        yield pd.concat([pdf[["left", "right", "node_type", "share", "gap"]], judged], axis=1)


MATCH_SCHEMA = "left bigint, right bigint, node_type string, share double, gap double, outcomes string, confidence double"


def mutual_classes(known: DataFrame) -> DataFrame:
    """MATCH_SCHEMA: all pairs of nid that are each other's best (or score as it), with their confidence."""
    best = cut(inverted_index.search(index_classes(known), LEAST_SHARE).select("nid", "other_id", "share", ((F.col("score") - F.col("next_score")) / F.col("score")).alias("gap")))
    back = best.select(F.col("other_id").alias("nid"), F.col("nid").alias("other_id"), F.col("share").alias("share_back"), F.col("gap").alias("gap_back"))
    both = best.where("nid < other_id").join(back, ["nid", "other_id"])
    texts = known.select("nid", "node_type", "features").dropDuplicates(["nid"])
    both = both.join(texts.withColumnRenamed("features", "left_features"), "nid").join(texts.select(F.col("nid").alias("other_id"), F.col("features").alias("right_features")), "other_id")
    return both.select(F.col("nid").alias("left"), F.col("other_id").alias("right"), "node_type", F.greatest("share", "share_back").alias("share"), F.least("gap", "gap_back").alias("gap"), "left_features", "right_features").mapInPandas(_judge, MATCH_SCHEMA)


def mutual(nodes: DataFrame) -> DataFrame:
    """left_node_id, right_node_id, node_type, confidence of all pairs of nodes that are each other's best; smaller id first.
    Nodes that say the same share their pairs."""
    known = read_nodes(nodes)
    return to_members(mutual_classes(known), known)


def to_members(classes: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of classes as pairs of their nodes, the greatest confidence for each."""
    member = lambda name: known.select(F.col("nid").alias(name), F.col("node_id").alias(f"{name}_member"))
    named = classes.join(member("left"), "left").join(member("right"), "right").where("left_member <> right_member")
    ends = [F.least("left_member", "right_member").alias("left_node_id"), F.greatest("left_member", "right_member").alias("right_node_id")]
    return named.groupBy(*ends, "node_type").agg(F.max("confidence").alias("confidence"))


def matches(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """left_node_id, right_node_id, node_type, confidence of the pairs that describe the same thing; smaller id first.

    Nodes of a source that say the same have the same matches, all of them. Null, cut off and empty data_json say what can
    be read of them; nodes that say too little match nothing. Nodes that don't tell their source make a source of their own.
    """
    known = read_nodes(nodes)
    return to_members(mutual_classes(known).where(F.col("confidence") >= least), known)
