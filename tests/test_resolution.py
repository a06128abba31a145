"""Entity resolution against plain Python on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import graph, ledger
from tidewater.operators import resolution as res

KIND = "id long, day date, title string, description string, participants string, venue string, minute int, url string, link string, publisher string, source string, richness double, tokens array<string>"


def records(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["owl", "river", "stone", "lamp", "violin", "harbor", "концерт", "сова"]
    rows = []
    for i in range(n):
        title = " ".join(rng.sample(words, 2)) if i % 13 else None
        day = f"2024-05-0{rng.randint(1, 3)}" if i % 9 else None
        rows.append((i, day, title, rng.choice(["", "a long night of violin and stone", None]), rng.choice(["", "Ann B", "Carl D", "Carl D, Ann B", "Eve & Ann B"]), rng.choice(["Old Hall", "New Barn", "", "clubhouse", "superclubhouse", "the new barn yard"]), rng.choice([None, 600, 610, 1200]),
                     rng.choice(["", "http://A.example/x/"]), rng.choice(["", "http://b.example/1"]), "", rng.choice(["tickets", "primary", "other"]), float(rng.randint(0, 3)), (title or "").split()))
    frame = spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], KIND)
    days = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, d string")
    return frame.drop("day").join(days.withColumn("day", F.to_date("d")).drop("d"), "id").select(*[c.split()[0] for c in KIND.split(", ")]), rows


def similarity(a, b):
    """Text similarity of two normal texts, spelled out."""
    if not a or not b:
        return 0.0
    short, long_ = sorted((a, b), key=len)
    if a == b:
        return 1.0
    if len(short) >= 8 and short in long_:
        return max(0.82, len(short) / len(long_))
    x, y = set(a.split()), set(b.split())
    jaccard, inside = len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))
    words = max(jaccard, 0.58 * jaccard + 0.42 * inside)
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    dice = float(a == b) if len(short) < 3 else 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
    return max(words, 0.68 * words + 0.32 * dice)


def people(text):
    return {n for p in (text or "").lower().replace("&", ",").split(",") if (n := " ".join(p.split()))}


def components_of(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 230)] + [(5, 5), (7, None)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == {i: r for i, r in components_of(real, {x for e in real for x in e}).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_candidates_equal_all_pairs(spark):
    frame, rows = records(spark)
    useful = {(r["id"], r["key"]) for r in res.blocks(frame).collect()}
    keys = {i: {k for j, k in useful if j == i} for i, *_ in rows}
    words = {r["id"]: set(r["w"]) for r in frame.select("id", res.content_words(F.coalesce("title", F.lit(""))).alias("w")).collect()}
    want = set()
    for x, y in itertools.combinations(rows, 2):
        a, b, same = x[0], y[0], x[1] is not None and x[1] == y[1]
        cyrillic = [any("а" <= c <= "я" for c in r[2] or "") for r in (x, y)]
        latin = [not c and any("a" <= ch <= "z" for ch in r[2] or "") for c, r in zip(cyrillic, (x, y))]
        if (
            keys[a] & keys[b] and (x[1] is None or y[1] is None or abs(int(x[1][-1]) - int(y[1][-1])) <= 2)
            or same and (words[a] & words[b] or people(x[4]) & people(y[4]) or not keys[a] or not keys[b])
            or same and similarity(x[5].lower(), y[5].lower()) >= 0.82 and (cyrillic[0] and latin[1] or cyrillic[1] and latin[0])
        ):
            want.add((a, b))
    assert {tuple(r) for r in res.candidates(frame).collect()} == want
    new = {3, 7, 11, 20, 21}
    got = {tuple(r) for r in res.candidates(frame, new=spark.createDataFrame([(i,) for i in new], "id long")).collect()}
    assert got == {p for p in want if new & set(p)}
    got = {tuple(r) for r in res.unknown_date_pairs(frame).collect()}
    assert got == {p for p in want if rows[p[0]][1] is None or rows[p[1]][1] is None}


def test_hot_words_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(res, "MEETING", 3)
    frame, rows = records(spark, 90, 4)
    words = {r["id"]: set(r["w"]) for r in frame.select("id", tx.words(F.coalesce("title", F.lit("")), 4).alias("w")).collect()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] and x[1] == y[1] and words[x[0]] & words[y[0]]}
    got = [tuple(r) for r in res.same_day_pairs(frame).collect()]
    assert set(got) == want and len(got) == len(want) > 300


def test_venues_alike_equal_all_pairs(spark):
    venues = ["Old Hall", "old hall", "clubhouse", "superclubhouse", "the old hall", "new old hall barn", "hall", "Old-Hall!", "a" * 9, "b" + "a" * 9 + "c", "", None, "x"]
    frame = spark.createDataFrame([(v,) for v in venues], "venue string")
    normal = {" ".join("".join(c if c.isalnum() else " " for c in (v or "").lower()).split()) for v in venues} - {""}
    assert {tuple(r) for r in res.like_venues(frame).collect()} == {(v, w) for v in normal for w in normal if similarity(v, w) >= 0.82}


def greedy(rows):
    """Complete-link groups over all pairs of a day, in the order of id."""
    owner, members = {r[0]: r[0] for r in rows}, {r[0]: [r[0]] for r in rows}
    by_id = {r[0]: r for r in rows}
    for x, y in itertools.combinations(sorted(rows), 2):
        p, q = owner[x[0]], owner[y[0]]
        if x[1] and x[1] == y[1] and set(x[-1]) & set(y[-1]) and p != q and all(set(by_id[m][-1]) & set(by_id[n][-1]) for m in members[p] for n in members[q]):
            for m in members[q]:
                owner[m] = p
            members[p] += members.pop(q)
    rank = {"tickets": 3, "primary": 2}
    best = {p: min(m, key=lambda i: (-rank.get(by_id[i][10], 1), -by_id[i][11], i)) for p, m in members.items()}
    return {i: best[p] for i, p in owner.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_complete_link(spark, seed):
    frame, rows = records(spark, 80, seed)
    keepers = res.complete_link(frame)
    want = greedy(rows)
    assert dict(map(tuple, keepers.collect())) == want


def test_verdicts_and_schedules(spark):
    frame, rows = records(spark, 50, 5)
    joined = res.beside(res.candidates(frame), frame)
    scored = res.pair_score(joined)
    twins = [(r["a"], r["b"]) for r in scored.where("duplicate").collect()]
    assert twins and all(rows[a][1] == rows[b][1] for a, b in twins)
    judged = {(r["a"], r["b"]): r for r in res.verdict(joined).collect()}
    assert all(r["verdict"] == "different" for (a, b), r in judged.items() if rows[a][1] and rows[b][1] and rows[a][1] != rows[b][1])
    assert not any(r["verdict"] == "same" for (a, b), r in judged.items() if not rows[a][1] or not rows[b][1])
    arbiter = spark.createDataFrame([(a, b, "same") for a, b in judged], "a long, b long, verdict string")
    decided = res.arbitrated(joined, arbiter)
    same = {(r["a"], r["b"]): r["score"] for r in decided.collect() if r["same"]}
    assert set(same) == {p for p, r in judged.items() if r["verdict"] != "different"}
    assert all(r["approved"] == r["same"] for r in decided.collect())
    vetoed = res.arbitrated(joined, arbiter.withColumn("verdict", F.lit("different")))
    assert vetoed.where("same or approved").count() == 0
    owner = {r[0]: r[0] // 4 for r in rows}
    for r in res.schedule(frame, frame.select("id", F.floor(F.col("id") / 4).alias("cluster"))).collect():
        own = [x for x in rows if owner[x[0]] == r["cluster"] and x[1] == str(r["day"])]
        assert r["minute"] == min((x[6] for x in own if x[6] is not None), default=None) and len(r["venue"]) == max(len(x[5]) for x in own)


def test_fallback_needs_all_three(spark):
    row = spark.range(1).select(*(res.fallback(F.lit(a), F.lit(b), F.lit(c), F.lit(d), F.lit(e)).alias(f"x{i}") for i, (a, b, c, d, e) in enumerate([(0.6, 0.7, 0.45, True, False), (0.59, 1.0, 1.0, True, False), (1.0, 1.0, 1.0, False, False), (1.0, 1.0, 1.0, True, True)]))).first()
    assert tuple(row) == (True, False, False, False)


def test_near_duplicates_of_a_ledger(spark):
    kind = "id long, source string, item string, url string, text string, attachments array<string>, observed long"
    text = "a rather long text about an evening by the sea with many words in it"
    current = spark.createDataFrame([(1, "s", "i", "", text, ["u"], 1000), (2, "s", "j", "http://A.example/p?x=1", text, [], 5000), (3, "s", "k", "", text, None, 9000), (4, "t", None, None, None, None, None)], kind)
    seen = spark.createDataFrame([(10, "s", "i", "", text.upper(), ["u"], 1200), (11, "s", "i", "", text + " too and more of it", ["u"], 1000), (12, "s", "z", "http://a.example/p/", text, [], 5100), (13, "s", "y", "", text, [], 9100), (14, "other", "k", "", text, [], 9000)], kind)
    got = {r["id"]: (r["seen_id"], round(r["similarity"], 4)) for r in ledger.near_duplicates(current, seen).collect()}
    assert got == {1: (10, 1.0), 2: (12, 1.0), 3: (13, 0.97)}
    assert ledger.near_duplicates(current, seen.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ledger.near_duplicates(current, seen, 0.9)


def test_tokens_leave_out_stop_and_generic_words(spark):
    row = spark.range(1).select(tx.tokens(F.lit("Концерт в клубе Owl https://x.example/y и 7"), generic=False).alias("a"), tx.tokens(F.lit("Концерт в городе")).alias("b")).first()
    assert row["a"] == ["клубе", "owl"] and row["b"] == ["концерт", "городе"]
