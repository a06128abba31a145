"""The numbered operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bit_sliced, byte_bpe, ivf_pq, licenses, line_dedup, mixing, quality, simhash, suffix_dedup, toxicity
from tidewater.llm.common import NULL_ID

KIND = "doc_id long, text string, lang string, dk string, th string, key long"


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a long text, passages of others."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=n)) for n in (30, 80, 200, 400, 5000)]
    texts = base + [base[1], base[2] + " tail", "x " + base[3][100:900] + "\n" + base[0], None, "", "é" * 70, "é" * 80, "ab" * 300, "Line one\nLine two"]
    rows = [(i, t, "en", "x", "y", 7) for i, t in enumerate(texts)] + [(2, base[2], "en", "x", "y", 7), (None, base[0], None, "x", "y", 7)]
    return spark.createDataFrame(rows, KIND), [(r[0], r[1] or "") for r in rows]


def test_line_dedup(spark):
    texts = [f"Common\n  {'MINE' if i % 2 else 'mine'} \nonly {i}\n\n" for i in range(6)] + [None, "", "common"]
    docs = documents(spark, texts)
    got = {r["dk"]: r["text"] for r in line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, 3, False)).collect()}
    assert got == {**{i: f"only {i}\n\n" for i in range(6)}, 6: "", 7: "", 8: ""}
    got = {r["dk"]: r["text"] for r in line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, 3, True)).collect()}
    assert got[0] == texts[0] and got[1] == "only 1\n\n" and got[8] == ""
    assert line_dedup.keep_bitmaps(docs.limit(0)).count() == 0


def test_suffix_dedup(spark, odd):
    docs, rows = odd
    least = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49) if d is not None else ():
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    want = []
    for d, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 49) if d is not None else ():
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((NULL_ID if d is None else d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    for hot in (4096, 1):
        # With so low a limit every bucket is compared window by window.
        got = [(r["dk"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(docs, hot=hot).collect()]
        assert sorted(got) == sorted(want)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_byte_bpe(spark, odd):
    docs, rows = odd
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|> it's  x 　 y\x1c z", "日本語 😀😀 naïve", " \n\n  a  ", "0" * 300]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert r["ids"] == own.encode_ordinary(r["text"]) and bytes(r["decoded"]) == r["text"].encode()
    plain = lambda rows_: sorted((r["dk"], r["ids"]) for r in rows_)
    checked = byte_bpe.encode_checked(docs, path).collect()
    assert plain(checked) == plain(got) and all(r["round_trip"] for r in checked)
    assert byte_bpe.encode_checked(docs.limit(0), path).count() == 0


def test_simhash(spark, odd):
    docs, rows = odd
    prints = {}
    for i, (d, t) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(prints, 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    want = Counter((d, prints[i], min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))
    got = Counter((r["doc_id"], r["f0"] % 2**64, r["component_id"]) for r in simhash.simhash_classes(docs).collect())
    assert got == want


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(len(other)):
            for bit in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(bit)
        a, b = (defaultdict(set) for _ in range(2))
        for keys, some in ((a, words), (b, other)):
            for r, k in zip(*simhash.golay_keys(some)):
                keys[r].add(k)
        assert all(a[i] & b[i] for i in range(len(words)))


def test_near_duplicates_at_five_words(spark):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(300)) for _ in range(30)]
    near = [" ".join(w if i % 97 else "changed" for i, w in enumerate(t.split(), 1)) for t in base]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(documents(spark, base + near)).collect()}
    assert all(got[i] == i for i in range(30)) and sum(got[30 + i] == i for i in range(30)) >= 29


def near_pairs(rng, similarity, n, size=400):
    """Pairs of texts of distinct words; blocks of 5 changed words bring the shingle sets just to this similarity or above."""
    out = []
    for _ in range(n):
        words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(size)]
        total = size - 4
        changed, other = 0, list(words)
        for i in range(2, size - 8, 9):  # each single word takes five shingles
            if (total - changed - 5) / (total + changed + 5) < similarity:
                break
            other[i], changed = "changed" + "".join(rng.choices("abcdefgh", k=8)), changed + 5
        out.append((" ".join(words), " ".join(other), (total - changed) / (total + changed)))
    return out


def test_near_duplicates_are_exactly_those_at_similarity(spark):
    rng = random.Random(11)
    for target, found in ((0.8, True), (0.85, True), (0.775, False)):
        pairs = near_pairs(rng, target, 80)
        assert all((s >= 0.8) == found for *_, s in pairs)
        docs = documents(spark, [t for a, b, _ in pairs for t in (a, b)])
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
        hits = sum(got[2 * i + 1] == 2 * i for i in range(80))
        assert hits >= 78 if found else hits == 0


def test_near_duplicate_classes_equal_all_pairs(spark):
    """Chains in which near misses lie between true pairs, copies, short texts: as by comparing every pair."""
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        text = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(200)]
        for _ in range(12):
            texts.append(" ".join(text))
            text = list(rng.choice(texts[-3:]).split())
            for i in rng.sample(range(200), rng.randint(1, 6)):
                text[i] = "x" + "".join(rng.choices("abcdefgh", k=8))
    texts += [texts[0].upper(), texts[5], "", None, "one two", "one two three four five six"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(documents(spark, texts), tables=20).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def vectors(spark, n=600, dim=8):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(rng.normal(size=(n, dim)))]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] * dim, 1)
    rows[7] = (7, [float("nan")] * dim, 1)
    rows[8] = (8, rows[9][1], 1)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int"), {i: np.array(np.float32(v), float) for i, v, _ in rows if i not in (5, 6, 7)}


def test_exact_top_k(spark):
    rows, known = vectors(spark)
    got = defaultdict(list)
    for r in bit_sliced.top_k(rows, rows.where("vec_id % 100 = 0"), 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(1024 * v).astype(int) for i, v in known.items()}
    for q in range(0, 600, 100):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert bit_sliced.top_k(rows.limit(0), rows.limit(0), 10).count() == 0


def test_nearest_recall_and_scores(spark):
    rows, known = vectors(spark)
    hits = total = 0
    got = defaultdict(dict)
    for r in ivf_pq.search(rows, rows.where("vec_id % 20 = 0"), 20).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    for q in (i for i in known if i % 20 == 0):
        best = sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q)[:20]
        hits, total = hits + len(got[q].keys() & {i for _, i in best}), total + 20
        assert all(math.isclose(s, known[q] @ known[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in got[q].items())
    assert hits / total >= 0.9


def test_licenses(spark):
    s = licenses.SENTENCES
    wrapped = s["mit-1"].replace(" copy of", " copy\nof") + "\n\n" + s["mit-2"] + "\n" + s["mit-3"]
    bsd = "\n".join(s[f"bsd-{i}"] for i in (1, 2, 3))
    far = s["apache-1"] + " One. Two. Three. Four. " + s["apache-2"]
    texts = [wrapped, bsd, bsd + "\n" + s["bsd-4"], s["apache-1"] + " One. " + s["apache-2"], far, "some title\nReleased under the MIT License.\nmore", None, "", "a license of no kind", s["mit-2"] + "\n" + s["mit-1"] + "\n" + s["mit-3"]]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i] for i in range(10)] == [["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["Apache-2.0"], [], ["MIT"], [], [], [], []]


def test_quality_model_equals_a_plain_one(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "cat", "sat", "on", "mat", "dog"], k=rng.randint(1, 40))) for _ in range(60)] + [None, "", "ab", "QX9!" * 30]
    docs = documents(spark, texts)
    found = {r["dk"]: r for r in quality.perplexities(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    fold = {r[0]: r[1] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 7).alias("t")).collect()}
    n = 5
    counts = {n: Counter()}
    for i, t in enumerate(texts[:60]):
        if not fold[i]:
            b = t.encode()
            counts[n].update(b[j : j + n] for j in range(len(b) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        c = [sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4)]
        if not all(c):
            return [0.5] * 3
        y = c[0] / (c[0] + 2 * c[1])
        return [min(max(j - (j + 1) * y * c[j] / c[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]

    cuts = {k: discount(k) for k in counts}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        same = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        cut = {h: cuts[k][min(c, 3) - 1] for h, c in same.items()}
        total = sum(same.values())
        return (same.get(g, 0) - cut.get(g, 0)) / total + sum(cut.values()) / total * p(g[1:])

    logs = {i: [math.log(p((t or "").encode()[j : j + n])) for j in range(len((t or "").encode()) - n + 1)] for i, t in enumerate(texts)}
    unseen = [x for i in range(60) if fold[i] for x in logs[i]]
    mean = sum(unseen) / len(unseen)
    for i, x in logs.items():
        assert math.isclose(found[i]["perplexity"], math.exp(-(sum(x) + 64 * mean) / (len(x) + 64)), rel_tol=1e-4)
    assert not found[63]["kept"] and found[60]["kept"] and found[61]["kept"]
    assert all(r["kept"] and r["perplexity"] is None for r in quality.perplexities(docs, docs.limit(0).select("doc_id")).collect())


def test_mixing_moves_totals_to_targets(spark):
    rng = random.Random(4)
    calm, loud = ["sun", "sea", "sand"], ["BAD!!", "awful", "worse"]
    texts = [" ".join(rng.choices(calm, k=50)) for _ in range(60)] + [" ".join(rng.choices(calm, k=40) + rng.choices(loud, k=10)) for _ in range(60)] + [None, ""]
    docs = documents(spark, texts)
    labelled = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(120)] + [(None, "a"), (3, None)], "doc_id long, domain string")
    rows = mixing.mixed(docs, labelled, {"a": 0.9, "b": 0.1}).collect()
    total = sum(r["n_tokens"] for r in rows)
    share = sum(r["n_tokens"] * r["rate"] * r["p_b"] for r in rows) / total
    assert abs(share - 0.1) < 0.05 and all(r["rate"] >= 0 for r in rows)
    assert {r["rate"] for r in rows if not r["n_tokens"]} == {1.0}
    # The same least squares, solved directly.
    p = np.array([[r["p_a"], r["p_b"]] for r in rows if r["n_tokens"]])
    rate = np.ones(len(p))
    for _ in range(5000):
        e = (p * (rate / len(p))[:, None]).sum(axis=0) - [0.9, 0.1]
        rate = np.maximum(0, rate - (p @ e + mixing.RIDGE * (rate - 1)) / (1 + mixing.RIDGE))
    assert np.abs(rate - [r["rate"] for r in rows if r["n_tokens"]]).max() < 0.02
    assert mixing.mixed(docs.limit(0), labelled.limit(0), {"a": 1.0, "b": 1.0}).count() == 0


def test_mixing_reaches_small_targets(spark):
    """Domains of 10 % with targets of 1 and 2 %: every total is within CLOSE, with rates above 1 or without."""
    rng = random.Random(14)
    words = {"clean": ["sun", "sea", "sand"], "low": ["zzz", "qqq", "www"], "toxic": ["BAD!!", "awful", "worse"]}
    domain = ["low" if i % 10 == 0 else "toxic" if i % 10 == 1 else "clean" for i in range(600)]
    docs = documents(spark, [" ".join(rng.choices(words[d], k=rng.randint(20, 60))) for d in domain])
    labelled = spark.createDataFrame(list(enumerate(domain)), "doc_id long, domain string")
    for most in (math.inf, 1.0):
        rows = mixing.mixed(docs, labelled, mixing.WEIGHTS, "clean", most=most).collect()
        assert all(0 <= r["rate"] <= most for r in rows)
        reached = {d: sum(r["n_tokens"] * r["rate"] * r[f"p_{d}"] for r in rows) for d in mixing.WEIGHTS}
        total = sum(reached.values())
        assert all(abs(reached[d] / total - t) < 5e-4 for d, t in mixing.WEIGHTS.items())
    assert {r["rate"] for r in mixing.mixed(docs, labelled.limit(0), mixing.WEIGHTS, "clean").collect()} == {1.0}


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioustn", k=5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(600):
        t = rng.choices(words, k=rng.randint(5, 120))
        bad = i % 4 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["Vile,", "nasty", "NASTY!"])
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    docs = documents(spark, texts + [None, ""])
    marked = spark.createDataFrame(labels + [(None, 1), (0, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, marked, where=~toxicity.held_out())
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, net).collect()}
    aside = [r[0] for r in docs.where(toxicity.held_out() & F.expr("doc_id < 600")).select("doc_id").collect()]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in aside) / len(aside)
    assert right > 0.95 and got[600] == got[601] < 0.5
    assert toxicity.scored(docs, toxicity.fit(docs, marked.limit(0))).select("score").distinct().first()[0] == 0.0


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"dk": F.lit("own"), "_dk0": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        before, docs = docs.count(), spark.read.parquet(path)
        assert 0.4 * before < docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_top_k_of_large_values_repeats_and_ties(spark):
    """Scores beyond 32 bits are exact, beyond 64 bits at the ends; equal rows rank by id, repeats count each."""
    kind = "vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3e6, 1.0]), (2, [5.0, 5.0]), (4, [5.0, 5.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (100, [2.0, 2.0]), (100, [2.0, 2.0])], kind)
    got = [tuple(r)[1:] for r in bit_sliced.top_k(rows, rows.where("vec_id = 100"), 10).orderBy("rank").collect()]
    five = 5 * 1024 * 2048 * 2
    assert got == [(1, 1, 6291458097152), (2, 2, five), (3, 3, five), (4, 3, five), (5, 4, five), (6, 0, 4194304)]
    rows = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0]), (100, [2.0, 2.0])], kind)
    got = [tuple(r)[1:] for r in bit_sliced.top_k(rows, rows.where("vec_id = 100"), 10).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 1024 * 2048), (3, 2, -(2**63))]


def recall_of(spark, x, k=20):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ivf_pq.search(rows, rows.where("vec_id % 40 = 0"), k).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 40):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()))
    model = ivf_pq.model_of(rows, k, x.shape[1])
    return hits / (k * len(range(0, len(x), 40))), model.probes / len(model.centre)


def test_nearest_recall_with_unprobed_lists(spark):
    rng = np.random.default_rng(21)
    loose = rng.normal(size=(4000, 8))
    recall, probed = recall_of(spark, loose)
    assert recall >= 0.9 and probed < 0.5
    centre = rng.normal(size=(40, 16))
    tight = centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.02
    tight[:1500] = centre[0] + rng.normal(size=(1500, 16)) * 1e-4  # one list, one code, many near copies
    recall, probed = recall_of(spark, tight)
    assert recall >= 0.9 and probed < 0.5


def test_nearest_of_zero_vectors_ties_and_repeats(spark):
    kind = "vec_id long, embedding array<double>, list int, shard long"
    rows = spark.createDataFrame([(20, [0.0, 0.0], 1, 1), (20, [1.0, 0.0], 1, 1), (2, [2.0, 2.0], 1, 1), (1, [2.0, 2.0], 1, 1), (1, [2.0, 2.0], 1, 1), (3, [0.0, 0.0], 1, 1), (4, None, 1, 1), (40, [0.0, 0.0], 1, 1), (None, [1.0, 1.0], 1, 1)], kind)
    got = [tuple(r) for r in ivf_pq.search(rows, rows.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0)]
    assert ivf_pq.search(rows.limit(0), rows.limit(0), 5).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_license_headers_plain_and_in_comments(spark):
    """Headers as files hold them, below a copyright line, plain and in the comments of several languages."""
    heads = {"MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "GPL-3.0-or-later": GPL, "ISC": licenses.SENTENCES["isc-1"], "Zlib": licenses.SENTENCES["zlib-1"] + "\n\n" + licenses.SENTENCES["zlib-2"]}
    texts, want = [], []
    for name, body in heads.items():
        for owner in ("Copyright (c) 2020 A. Body\n\n", "Copyright 2020 Some Body. All rights reserved.\n", ""):
            whole = (owner + body).split("\n")
            for before, mark, after in (("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("", ";; ", "")):
                texts.append(before + "\n".join((mark + line).rstrip() for line in whole) + after + "\nint main;\n")
                want.append([name])
    for tag in ("MIT", "Apache-2.0", "LGPL-2.1-or-later"):
        texts += [f"// SPDX-License-Identifier: {tag}\n#include <a>", f"# SPDX-License-Identifier: {tag}\n# Copyright 2020 B\n\nimport os"]
        want += [[tag]] * 2
    texts += ["Copyright law is old. A warranty is a promise. Read the license: it says much.", "We redistribute income, with permission.", MIT.split("\n\n")[1]]
    want += [[]] * 3
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert licenses.scan(documents(spark, texts).limit(0)).count() == 0


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_bit_sliced_topk", "op7_license_scan"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tidewater.llm import queries

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found, rel = queries.QUERIES[name](spark, folder), duck.sql(queries.ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(rel.columns)
    rows = lambda some: sorted(tuple(map(plain, r)) for r in some)
    assert rows(found.select(columns).collect()) == rows(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_license_sql_on_headers(spark):
    """The SQL agrees on headers, comments, empty lines and odd marks."""
    import duckdb
    import pandas as pd

    texts = [c + b.replace("\n", "\n" + m) for b in (MIT, APACHE, BSD, GPL) for m in ("", "# ", " * ", "\r\n") for c in ("", "Copyright x\n", "\n\n \n(c) y\n *\n# \n")] + [None, "", "License: MIT\nx", "License:\n\nMIT", "a license.\n\n\n:\n \n!"]
    docs = documents(spark, texts)
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {r[0]: r[1:] for r in duck.sql(licenses.OP7_SQL).fetchall()}
    got = {r["doc_id"]: (len(r["matches"]), " ".join(m["id"] for m in r["matches"]), ",".join(r["licenses"])) for r in licenses.scan(docs).collect()}
    assert got == want


def test_fits_are_bounded_and_count_repeats_once(spark):
    """Repeated label rows and repeated documents add nothing to a fit; fit_rows and fit_bytes bound it."""
    from tidewater.llm.common import labelled_sample

    docs = documents(spark, ["a" * 10] * 40 + [None]).union(documents(spark, ["a" * 10] * 40))
    labels = spark.createDataFrame([(i % 45, i % 2) for i in range(180)] + [(None, 1), (1, None), (40, 1)], "doc_id long, label int")
    got = labelled_sample(docs, labels, 1000, 1 << 20)
    assert got.num_rows == len({(r["dk"], r["label"]) for r in got.to_pylist()}) == 82
    assert labelled_sample(docs, labels, 30, 1 << 20).num_rows <= 30
    assert sum(map(len, labelled_sample(docs, labels, 1000, 95).column("text").to_pylist())) <= 95
    assert labelled_sample(docs, labels.limit(0), 1000, 95).num_rows == 0


def test_toxicity_scores_equal_a_plain_network(spark):
    """Each score recomputed word by word from the net's weights."""
    rng = random.Random(16)
    words = ["".join(rng.choices("aeioustn", k=4)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30)) + (["nasty"] if i % 3 == 0 else [])) for i in range(90)] + [None, "", "one", "  \n "]
    docs = documents(spark, texts)
    net = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, net).collect()}
    for i, t in enumerate(texts):
        x = [np.concatenate([net.tables[0][a], net.tables[1][b]]).astype(float) for a, b in map(toxicity.key, (t or "").split())]
        pooled = []
        for j, span in enumerate(toxicity.SPANS):
            for f in range(toxicity.FILTERS):
                at = [sum(x[p + k] @ net.filters[j][k, :, f] for k in range(span) if p + k < len(x)) + net.bias[j * toxicity.FILTERS + f] for p in range(len(x))]
                pooled.append(max([0.0, *at]))
        z = float(np.dot(pooled, net.out)) + float(net.shift)
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=1e-4)
    assert toxicity.scored(docs.limit(0), net).count() == 0


def test_mixing_of_repeats_keeps_wanted_documents(spark):
    """Clean documents keep rates near 1 or above; repeated rows share one rate."""
    rng = random.Random(15)
    words = {"clean": ["sun", "sea", "sand"], "low": ["zzz", "qqq", "www"], "toxic": ["BAD!!", "awful", "worse"]}
    domain = ["low" if i % 8 == 0 else "toxic" if i % 8 == 1 else "clean" for i in range(400)]
    docs = documents(spark, [" ".join(rng.choices(words[d], k=30)) for d in domain])
    labelled = spark.createDataFrame(list(enumerate(domain)) * 2, "doc_id long, domain string")
    rows = mixing.mixed(docs.union(docs), labelled, mixing.WEIGHTS, "clean").collect()
    assert len(rows) == 800 and len({(r["dk"], r["rate"]) for r in rows}) == 400
    assert min(r["rate"] for r in rows if domain[r["dk"]] == "clean") > 0.97
    frame = spark.createDataFrame(rows)
    assert all(abs(r["share"] - r["target"]) < 5e-4 for r in mixing.reached(frame, mixing.WEIGHTS).collect())


def brute_components(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}


def test_large_buckets_are_dealt_in_blocks(spark):
    """Buckets far above the block's size: the same components as from comparing all pairs."""
    from tidewater.llm.components import components

    rng = random.Random(31)
    words = [rng.getrandbits(64)]
    for _ in range(70):  # a chain of words, some within 3 bits of the one before, some not
        words.append(words[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 5]))))
    words = sorted({w - 2**64 if w >= 2**63 else w for w in words})
    prints = spark.createDataFrame([(w, w) for w in words], "node long, f0 long")
    near = [(a, b) for a, b in itertools.combinations(words, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    want = brute_components(near, {x for p in near for x in p})
    for block in (3, 2048):
        got = {r["node"]: r["root"] for r in components(simhash.linked(prints, simhash.radius_keys, ["f0"], ["f0"], 3, block)).collect()}
        assert got == want


def test_classes_are_crossed_in_blocks(spark, monkeypatch):
    """Links between classes that share a key, with blocks of a few members, equal those of all pairs."""
    rng = np.random.default_rng(33)
    rows, sets = [], {}
    for i in range(60):
        base = np.arange(100) + 1000 * (i % 2)
        some = np.unique(np.where(rng.random(100) < 0.1, rng.integers(10**6, 10**9, 100), base)).astype(np.uint64)
        sets[i] = set(some.tolist())
        rows.append((i % 2, i, i if i % 3 else 1000 + i % 2, some.tobytes(), *(0 for _ in range(2))))
    frame = spark.createDataFrame(rows, "key long, node long, class long, hashes binary, f0 long, f1 long")
    alike = [(i, j) for i, j in itertools.combinations(range(60), 2) if i % 2 == j % 2 and rows[i][2] != rows[j][2] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    classes = [r[2] for r in rows]
    want = brute_components([(classes[i], classes[j]) for i, j in alike], set(classes))
    for limit in (4, 1024):
        monkeypatch.setattr(simhash, "ACROSS", limit)
        got = [(r["u"], r["v"]) for r in simhash.across(frame, ["f0", "f1"], 10, 0.8).collect()]
        assert all((v, u) in alike for u, v in got)
        assert brute_components([(classes[u], classes[v]) for u, v in got], set(classes)) == want
    assert {r["u"] for r in simhash.across(frame.drop("hashes"), ["f0", "f1"], 10).collect()} == set(range(60))


def test_line_dedup_of_null_ids_and_repeats(spark):
    """Rows without id are one document, as are repeated rows, but each row has its result."""
    kind = "doc_id long, text string, dk string"
    rows = [(None, "a\nx", "c"), (None, "a\ny", "c"), (1, "a\nz", "c"), (1, "a\nz", "c"), (2, "b", "c"), (3, "b\n\n", "c")]
    docs = spark.createDataFrame(rows, kind)
    got = Counter((None if r["dk"] == NULL_ID else r["dk"], r["text"], r["n_dropped"]) for r in line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, 2, False)).collect())
    assert got == Counter({(None, "x", 1): 1, (None, "y", 1): 1, (1, "z", 1): 2, (2, "", 1): 1, (3, "\n", 1): 1})
    assert Counter(r["text"] for r in line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, 3, False)).collect()) == Counter(t for _, t, _ in rows)


def test_empty_tables_give_empty_results(spark):
    none = documents(spark, ["x"]).limit(0)
    assert simhash.simhash_classes(none).count() == simhash.similar_classes(none).count() == licenses.scan(none).count() == 0
    assert quality.perplexities(none, none.select("doc_id")).count() == 0
