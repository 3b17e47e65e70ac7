"""SimHash, embedding and passage de-duplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barloom.llm import components, embeddings, mixing, repeats, simhash

TEXTS = "doc_id long, text string"


def words(rng, n, pool=("er", "on", "the", "é", "Ing", "ab")):
    return " ".join("".join(rng.choice(pool) for _ in range(rng.randint(1, 3))) for _ in range(n))


def least_reachable(nodes, linked):
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[a] < label[b] and linked(a, b):
                    label[b], changed = label[a], True
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in links if b is not None and a != b} | {(b, a) for a, b in links if b is not None and a != b}
    nodes = sorted({a for p in pairs for a in p})
    assert got == least_reachable(nodes, lambda a, b: (a, b) in pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_portions(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(80)] + [(2000, 2001 + i) for i in range(60)]
    rng.shuffle(links)
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    plain = {}
    for a, b in sorted(links):
        low, high = sorted((plain.setdefault(a, a), plain.setdefault(b, b)))
        plain = {x: low if r == high else r for x, r in plain.items()}
    lone = {x for a, b in links for x in (a, b)} - {x for a, b in links if a != b for x in (a, b)}
    want = {x: r for x, r in plain.items() if x not in lone}
    for portion in (7, 100, 1000):
        got = components.connected_components(table, portion=portion).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_components_of_few_links_take_few_jobs(spark):
    """Each round of stars costs the driver some twenty jobs; a table of one portion has none."""
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert {r.component for r in components.connected_components(links).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# SimHash ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    grams = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(2)
    base = [words(rng, rng.randint(30, 200)) for _ in range(30)]
    rows = base + base[:5] * 3 + ["", None, " \t\n", "one", "One", "a b c", "x " * 50]
    for _ in range(60):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = "changed"
        rows.append(" ".join(t))
    return [(3 * i + 1, t) for i, t in enumerate(rows)] + [(1, base[0]), (1, base[0]), (None, base[1])]


def test_simhash_groups(spark, near_texts):
    df = spark.createDataFrame([(*r, "x", 1) for r in near_texts], TEXTS + ", fp string, component_id int").repartition(3)
    got = simhash.query(df).collect()
    fp = {t: plain_fingerprint(t) for _, t in near_texts}
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{fp[t]:016x}") for i, t in near_texts)
    ids = {}
    for i, t in near_texts:
        if i is not None:
            ids.setdefault(fp[t], []).append(i)
    label = least_reachable(sorted(ids, key=lambda f: min(ids[f])), lambda a, b: (a ^ b).bit_count() <= 4)
    name = {f: min(min(ids[g]) for g in ids if label[g] == label[f]) for f in ids}
    # label holds some member of each group, the name its smallest doc_id
    want = sorted((str(i), str(name.get(fp[t]))) for i, t in near_texts)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


def test_near_copies_go_and_others_stay(spark, near_texts):
    df = spark.createDataFrame([(*r, "x", 1) for r in near_texts], TEXTS + ", fp string, `a.b` int").repartition(3)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    first = {}
    for i, t in near_texts:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    sets = {t: set(simhash.shingle_hashes(t.encode(), 5)) for t in first}
    # texts in the order of which stays; the rank of one stands for it
    order = sorted(first, key=lambda t: (first[t], hashlib.md5(t.encode()).hexdigest()))
    share = lambda a, b: len(sets[order[a]] & sets[order[b]]) >= 0.8 * len(sets[order[a]] | sets[order[b]])
    want = {(first[order[r]], order[r]) for r in least_reachable(range(len(order)), share).values()}
    assert [i for i, _ in got].count(None) == 1 and len(got) == len(set(got))
    got = {x for x in got if x[0] is not None}
    # none goes that should stay; fingerprints further apart than the search reaches may stay
    assert want <= got and len(got - want) <= 0.05 * len(sets)
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_repeated_rows_with_a_map_column(spark):
    rows = [(1, "one two three", {"a": 1}), (1, "one two three", {"b": 2}), (1, "one two three", {"a": 1}), (2, "four five six", None), (2, "four five six", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    assert sorted((r.doc_id, r.more) for r in simhash.keep_first(df).collect()) == [(1, {"a": 1}), (2, None)]


def test_other_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 5), (1, b, 5), (1, b, 4), (2, b, 1), (3, a, 0), (4, c, 2), (4, c, 1), (None, c, 9)]
    df = spark.createDataFrame(rows, TEXTS + ", first_id int").withColumnRenamed("first_id", "FIRST_ID").repartition(3)
    got = sorted((r[0] or 0, r[1][0], r[2]) for r in simhash.keep_first(df).collect())
    assert got == [(0, "c", 9), (1, "a", 5), (1, "b", 4), (4, "c", 1)]


def copies_of_one(n, seed=8):
    """A text of 300 words and n copies with five changed words each: alike to the text, less so to each other."""
    rng = random.Random(seed)
    base = [words(rng, 1) + str(i) for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        own = list(base)
        for at in rng.sample(range(0, 300, 6), 5):
            own[at] = f"changed{i}x{at}"
        rows.append((i, " ".join(own)))
    return rows


def by_all_pairs(rows):
    """The smallest ids of the groups that all pairs with a Jaccard similarity of 0.8 make."""
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows}
    label = {}
    for i in sorted(sets):
        if i not in label:
            front = [i]
            while front:
                x = front.pop()
                label[x] = i
                front += [y for y in sets if y not in label and y not in front and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    return set(label.values())


@pytest.mark.parametrize("n", [8, 50, 1000])
def test_copies_that_are_alike_to_the_original_only_go(spark, n):
    rows = [(n - i, t) for i, t in copies_of_one(n)]  # the original last
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, TEXTS).repartition(3)).collect()}
    assert len(by_all_pairs(rows)) == 1
    # fingerprints further from the original's than the search reaches may stay
    assert 0 in got and len(got) <= 1 + 0.05 * n


def whole_links(fps, tau):
    """What the verification of one bucket gives: all stored, none probing."""
    n = len(fps)
    columns = {"part": [0] * n, "value": [0] * n, "cell": [0] * n, "probe": [False] * n, "fp": np.array(fps, dtype=np.uint64).view(np.int64), "rep": range(n)}
    (batch,) = pa.table({k: pa.array(v) for k, v in columns.items()}).to_batches()
    found = pa.Table.from_batches(simhash._verify(tau, True)([batch])).to_pylist()
    return {(r["a"], r["b"]) for r in found if not r["dense"]}, [(r["a"], r["b"]) for r in found if r["dense"]]


@pytest.mark.parametrize("many", [50, 200_000])
def test_no_pair_is_lost_however_many_links_a_bucket_has(monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(100)]
    fps = sorted({c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for c in centers for _ in range(2)} | {centers[0] ^ 1 << b for b in range(5)})
    links, dense = whole_links(fps, 4)
    label = least_reachable(range(len(fps)), lambda a, b: (a, b) in dense or (b, a) in dense)
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                assert (a, b) in links or (b, a) in links or label[a] == label[b]


def test_cells_of_texts_with_one_fingerprint_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rows = spark.createDataFrame([(7, i) for i in range(1000)], "fp long, rep long").selectExpr("fp", "rep", "0 part", "fp value", "false probe")
    cells = {}
    for r in simhash._dealt(rows).collect():
        cells.setdefault(r.cell, set()).add(r.rep)
    assert max(map(len, cells.values())) <= 300
    met = np.zeros((1000, 1000), dtype=bool)
    for own in cells.values():
        met[np.ix_(sorted(own), sorted(own))] = True
    assert met.all()


def test_pairs_just_above_the_similarity_are_found(spark):
    rng, rows = random.Random(10), []
    for g in range(400):
        own = [words(rng, 1) + f"{g}w{i}" for i in range(100)]
        rows.append((2 * g, " ".join(own)))
        own[20], own[70] = "changed", "altered"  # 86 of 106 shingles: 0.81
        rows.append((2 * g + 1, " ".join(own)))
    assert len(by_all_pairs(rows)) == 400
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, TEXTS)).collect()}
    assert {2 * g for g in range(400)} <= got and len(got) <= 402


def test_dense_groups_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [np.arange(100 * g, 100 * g + 60) for g in range(5)]
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 10**6, 60), base[i % 5])) for i in range(120)] + [np.zeros(0, dtype=np.int64)] * 3
    groups = spark.createDataFrame([(i, i % 2) for i in range(len(sets))], "node long, component long")
    table = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "id long, s array<long>")
    alike = lambda a, b: a % 2 == b % 2 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    want = least_reachable(range(len(sets)), alike)
    for size in (600, 1 << 18):
        monkeypatch.setattr(simhash, "SETS", size)
        got = {r.node: r.component for r in components.connected_components(simhash.jaccard_groups(groups, table, 0.8)).collect()}
        assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("block", [8, 8192])
def test_links_join_all_pairs_within_reach(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) % 2**64 for c in centers for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)} | {0})
    signed = [x - (x >> 63 << 64) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"))
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    want = least_reachable(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {i: got.get(i, i) for i in want} == want


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(0)
    correlated = rng.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xFF00FF00FF00FF0F)
    for sample, n in ((correlated, 10**6), (correlated[:1], 1), (correlated[:0], 0), (correlated, 10**11)):
        chosen = simhash.allocate(sample, n)
        whole = [m for m, _ in chosen]
        assert all(a & b == 0 for i, a in enumerate(whole) for b in whole[:i])
        assert sum(t + 1 for _, t in chosen) >= 5  # more than tau errors can't avoid all partitions


def test_simhash_of_an_empty_table(spark):
    assert simhash.query(spark.createDataFrame([], TEXTS)).count() == 0


# embeddings ------------------------------------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(8):
            c = rng.standard_normal(16)
            for _ in range(rng.integers(1, 25)):
                rows.append((i, (c + rng.normal(0, 0.12, 16)).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + j, rows[0][1], 1) for j in range(30)] + [(i + 40, [float(x) * 2 for x in rows[0][1]], 1)]
    odd = [(None, 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), (rows[0][1], None), (rows[0][1], 3), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([], 1), ([float("inf")] * 16, 1)]
    return rows + [(1000 + j, v, y) for j, (v, y) in enumerate(odd)]


@pytest.mark.parametrize("block", [4, 1024])
def test_embedding_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = {r.vec_id: r for r in embeddings.query(df).collect()}
    unit = {}
    for i, v, y in rows:
        if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = (y, np.array(v, dtype=float) / np.linalg.norm(v))
    linked = lambda a, b: a in unit and b in unit and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98
    ids = [r[0] for r in rows]
    label = least_reachable(ids, linked)
    links = {a: sum(a != b and linked(a, b) for b in ids) for a in ids}
    assert sum(g.n_links for g in got.values()) >= 0.97 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in ids)
    assert {i: got[i].component_id for i in ids} == label
    assert all(got[i].kept == (label[i] == i) for i in ids)


def test_embedding_recall_at_the_given_size(spark):
    """Planted pairs of 64 dimensions, at known cosines: the tables given hold no link at all."""
    rng = np.random.default_rng(12)
    bands, each = ((0.98, 0.985), (0.985, 0.99), (0.99, 0.995), (0.995, 1.0), (0.97, 0.9799)), 600
    rows, band = [], {}
    for b, (lo, hi) in enumerate(bands):
        for c in rng.uniform(lo, hi, each):
            x, y = rng.normal(size=(2, 64))
            x /= np.linalg.norm(x)
            y -= (y @ x) * x
            y = c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)
            band[len(rows)] = b
            rows += [(len(rows), (x * rng.uniform(0.1, 9)).tolist(), 1), (len(rows) + 1, y.tolist(), 1)]
    got = {r.vec_id: r.n_links for r in embeddings.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    recall = [np.mean([got[i] > 0 for i in band if band[i] == b]) for b in range(len(bands))]
    print("recall by band", dict(zip(bands, recall, strict=True)))
    assert recall[-1] == 0 and min(recall[:-1]) >= 0.98


def test_embedding_edge_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.query(spark.createDataFrame([], schema)).count() == 0
    rows = embeddings.query(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in rows) == [("1", 0, True), ("None", 0, False)]


# repeated passages -----------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen, covered = {}, [bytearray(len(t)) for t in texts]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p : p + length] = b"\1" * length
    kept = [bytes(x for x, c in zip(t, m, strict=True) if not c) for t, m in zip(texts, covered, strict=True)]
    return [(len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(k).hexdigest(), k) for t, m, k in zip(texts, covered, kept, strict=True)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    shared = [words(rng, rng.randint(10, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = words(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            t += " " + rng.choice(shared) + " " + words(rng, rng.randint(0, 20))
        texts.append(t)
    texts += [texts[3]] * 5 + ["", None, "ab" * 300, "x" * 500, "x" * 39] + ["Is onhe. " * rng.randint(3, 60) + words(rng, rng.randint(0, 10)) for _ in range(20)]
    return texts


@pytest.mark.parametrize(("length", "gram", "block"), [(60, 12, 4096), (60, 12, 6), (40, 40, 40), (60, 1, 300)])
def test_repeats(spark, passages, length, gram, block):
    df = spark.createDataFrame([(i % 90, t, "k") for i, t in enumerate(passages)], TEXTS + ", k string").coalesce(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.without_repeats(df, length, gram, block).collect()]
    want = [(i % 90, *r) for i, r in enumerate(brute_repeats([(t or "").encode() for t in passages], length))]
    assert sorted(got) == sorted(want)


def test_repeats_of_long_texts_and_empty_tables(spark, monkeypatch):
    shared = "é" + "x" * 19 + " some shared passage of text" * 16
    df = spark.createDataFrame([(1, "first " + shared), (2, shared + " second"), (3, "ée"), (4, None)], TEXTS)
    for r in repeats.query(df).collect():
        assert (r.n_removed > 0) == (r.doc_id < 3)
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 or "\ufffd" in r.text
    assert repeats.query(spark.createDataFrame([], TEXTS)).count() == 0
    monkeypatch.setattr(repeats, "_INDEX_BITS", 20)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    a, b = repeats.chosen_positions(long.encode()), repeats.chosen_positions(long.encode()[1_000_000:])
    windows = np.concatenate([np.arange(p - most, p - least + 1) for p, most, least in a[0]])
    assert np.array_equal(np.sort(windows), np.arange(len(long) - 399))  # each string once
    assert {(p - 1_000_000, h) for (p, _, _), h in zip(a[0].tolist(), a[1].tolist(), strict=True) if p > 1_001_000} <= {(p, h) for (p, _, _), h in zip(b[0].tolist(), b[1].tolist(), strict=True)}


def test_suffix_order():
    rng = random.Random(7)
    for _ in range(50):
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) + b"x" * rng.choice((0, 0, 200)) for _ in range(60)})
        strings = list({b"c" * rng.choice((0, 130, 200)) + s for s in strings})
        assert [strings[i] for i in repeats.suffix_order(strings)] == sorted(strings)


# mixing ----------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_meets_its_weights(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "hot", 2) for i in range(6000)] + [(7001, None, None, None, None), (None, "x", "en", "big", 1)]
    df = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 1.0), ("hot", 3.0), ("none", 9.0), ("big", 0.0)], "source string, weight double")
    out = mixing.mixed(df, weights, total=30_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "hot"}
    # the weight of an absent source is not counted
    for s, want in (("big", 7_500), ("hot", 22_500)):
        assert abs(n[s] - want) < 5 * want**0.5
    again = mixing.mixed(df.repartition(7), weights, total=30_000)
    key = lambda d: sorted((str(r.doc_id), r.copy) for r in d.select("doc_id", "copy").collect())
    assert key(again) == key(out)
    order = [r.doc_id for r in out.limit(200).collect()]
    assert order != sorted(order, key=lambda x: -1 if x is None else x)
    # Poisson: the variance of the counts is their mean
    counts = [r["count"] for r in out.where("source = 'hot'").groupBy("doc_id").count().collect()]
    counts += [0] * (2000 - len(counts))
    assert abs(np.var(counts) / np.mean(counts) - 1) < 0.15


def test_mixing_large_rates_and_edges(spark):
    df = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(30)], DOCS)
    n = mixing.mixed(df, total=30_000).count()
    assert abs(n - 30_000) < 5 * 30_000**0.5
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(df, total=0).count() == 0
    clash = df.selectExpr("*", "-1 as COPY", "2 as `a.b`", "'x' as _source", "7 as times", "8 as draws", "9 as cumulative", "10 as place", "11 as own_source", "12 as n", "13 as weight")
    out = mixing.mixed(clash, total=60)
    assert out.columns == [*clash.columns, "copy_"]
    rows = out.collect()
    kept = [(r.doc_id, r.copy_) for r in rows]
    assert sorted(kept) == sorted((r.doc_id, r.copy) for r in mixing.mixed(df, total=60).collect())
    assert {tuple(r)[5:-1] for r in rows} == {(-1, 2, "x", 7, 8, 9, 10, 11, 12, 13)}


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("sent", [100_000, 3])
def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(simhash, "SENT", sent)
    rng = random.Random(21)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for i in range(600)]
    rows += [(600 + i, rows[i][1].replace(" ", " new ", 1)) for i in range(0, 60, 2)] + [(700 + i, rows[i][1]) for i in range(1, 20, 2)]
    spark.createDataFrame(rows, TEXTS).write.parquet(f"{tmp_path}/in")
    before = shuffled_bytes(spark)
    got = {r.doc_id for r in simhash.keep_first(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert got == set(range(600))
    # a few hundred bytes a text, and what may go, but not the texts, of which there are 2.5 million bytes
    assert shuffled_bytes(spark) - before < 1_200_000


@pytest.mark.parametrize(("held", "grid"), [(300_000, 8), (40, 3)])
def test_cells_join_all_pairs_within_reach(spark, monkeypatch, held, grid):
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "GRID", grid)
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 16)
    rng = random.Random(22)
    centers = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for c in centers for _ in range(40)] + [rng.getrandbits(64) for _ in range(100)] + [0, 0]
    sizes = [rng.choice((0, 50, 60, 100)) for _ in fps]
    rows = [(x - (x >> 63 << 64), i, s) for i, (x, s) in enumerate(zip(fps, sizes, strict=True))]
    links = simhash.cell_links(spark.createDataFrame(rows, "fp long, rep long, size long"), 12, 0.8).collect()
    label = {r.node: r.component for r in components.connected_components(spark.createDataFrame([(r.a, r.b) for r in links if r.dense] or [(-1, -2)], "a long, b long")).collect()}
    single = {(r.a, r.b) for r in links if not r.dense}
    for a in range(len(fps)):
        for b in range(a):
            near = (fps[a] ^ fps[b]).bit_count() <= 12 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])
            assert not near or (a, b) in single or label.get(a, a) == label.get(b, b)
            assert near or (a, b) not in single
    assert simhash.cell_links(spark.createDataFrame([], "fp long, rep long, size long"), 12, 0.8).count() == 0


def test_sketches_keep_all_similar_sets():
    rng, ruled_out = np.random.default_rng(23), 0
    for _ in range(3000):
        n = int(rng.choice([0, 1, 3, 12, 63, 64, 130, 500, 3000]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(n) < rng.choice([0.7, 0.9, 1.0])], rng.integers(0, 2**64, int(n * rng.choice([0, 0.1, 0.3])), dtype=np.uint64))))
        if rng.random() < 0.2:  # full counts
            a, b = (np.unique(v >> np.uint64(5)) for v in (a, b))
        shared = len(np.intersect1d(a, b))
        may = simhash.may_be_similar(len(a), simhash.counts_sketch(a).tobytes(), len(b), simhash.counts_sketch(b).tobytes(), 0.8)
        assert may or shared < 0.8 * (len(a) + len(b) - shared)
    for n in (200, 1000, 5000):
        a, b = (simhash.counts_sketch(rng.integers(0, 2**64, n, dtype=np.uint64)).tobytes() for _ in range(2))
        ruled_out += not simhash.may_be_similar(n, a, n, b, 0.8)
    assert ruled_out == 3
