"""The pipeline's stages against plain computations, on small tables with all that may go wrong, and end to end."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from barloom.llm import bpe, mixing, pii, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (None, None, None, None, None), (3, "one", "", "", 3), (3, "one", "", "", 3), (3, "another text", "", "", 12)]


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioustrnml") for _ in range(rng.randint(2, 9))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with near copies, toxic texts, personal data, odd rows and very long texts."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        text = sentence(rng, rng.randint(20, 80))
        if i % 8 == 0:
            text += " you stupid worthless idiot " + sentence(rng, 5)
        if i % 5 == 0:
            text += f" mail ab{i}@example.org or (415) 555-{1000 + i}"
        rows.append((10 + i, text, "en", "big" if i % 3 else f"s{i % 7}", len(text)))
    near = [(1000 + r[0], r[1].replace(" ", " extra ", 1), *r[2:]) for r in rows[1:40:4]]
    copies = [(2000 + r[0], *r[1:]) for r in rows[1:20:2]]
    long = sentence(rng, 30_000)
    rows += near + copies + ODD + [(5000, long, "en", "big", len(long))]
    folder = tmp_path_factory.mktemp("corpus")
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 500 and r[0] > 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_equal_plain_computations(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(docs)
    # toxicity: exactly the rows under the cut, by a model fitted on the same rows
    kept = STAGES["toxicity"](spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), lambda d: d.isNotNull())
    got = rows_of(kept)
    assert kept.columns == docs.columns
    assert Counter(got) == Counter(r for r in before if model.score((r[1] or "").encode())[0] < toxicity.CUT)
    gone = Counter(before) - Counter(got)
    assert sum("idiot" in (r[1] or "") for r in gone) >= 0.9 * sum("idiot" in (r[1] or "") for r in before)
    assert sum("idiot" not in (r[1] or "") for r in gone) <= 0.02 * len(before)
    # near copies: one of each group by all pairs, rows without doc_id stay
    docs, before = spark.createDataFrame(got, DOCS), got
    got = rows_of(STAGES["simhash near-dedup"](spark, docs, folder))
    texts = {}
    for r in before:
        if r[0] is not None:
            texts[r[1] or ""] = min(r[0], texts.get(r[1] or "", r[0]))
    order = sorted(texts, key=lambda t: (texts[t], hashlib.md5(t.encode()).hexdigest()))
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in order]
    root = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = {(texts[order[x]], order[x]) for x in root}
    assert Counter((r[0], r[1] or "") for r in got if r[0] is not None) == Counter(want)
    assert Counter(r for r in got if r[0] is None) == Counter(r for r in before if r[0] is None)
    # personal data: the operator's own text, everything else untouched
    docs, before = spark.createDataFrame(got, DOCS), got
    out = STAGES["pii"](spark, docs, folder)
    got = rows_of(out)
    assert out.columns == docs.columns and len(got) == len(before)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in before)
    old = {m for r in before for m in re.findall(r"ab\d+@example\.org|\(415\) 555-\d{4}", r[1] or "")}
    assert len(old) > 80 and not any(m in (r[1] or "") for m in old for r in got)
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in got)
    # mixing: each row as often as its hash says, under the target rates
    docs, before = spark.createDataFrame(got, DOCS), got
    got = rows_of(STAGES["source mixing"](spark, docs, folder))
    size = Counter(r[3] for r in before)
    mass = sum(n**0.5 for n in size.values())

    def times(r):
        from math import exp

        rate = len(before) * size[r[3]] ** 0.5 / mass / size[r[3]]
        name = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{mixing.SEED}|{name}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, total = 0, exp(-rate), exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        return n

    assert max(len(before) * n**0.5 / mass / n for n in size.values()) < mixing.PIECE
    assert Counter(got) == Counter(x for r in before for x in [r] * times(r))
    # token ids: those of the library, which decode to the text
    out = STAGES["byte-level bpe"](spark, spark.createDataFrame(got, DOCS), folder)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
    plain = Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), r[1] or "") for r in got)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text) for r in out.collect()) == plain
    assert all(r.n_tokens * 4 == len(r.ids) for r in out.collect())


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids", "text"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    assert Counter(map(str, got.collect())) == Counter(map(str, docs.collect()))


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_odd_tables(spark, folder, name):
    odd = table(spark, ODD)
    clash = odd.selectExpr("*", *[f"'{i}' as `{c}`" for i, c in enumerate(("_text", "found", "pairs", "_source", "times", "copy", "first_id", "own_text", "c0", "_score", "a.b", "id", "fp", "same", "k"))])
    none = odd.limit(0)
    for docs in (odd, none, clash):
        out = STAGES[name](spark, docs, folder)
        rows = out.collect()
        if name != "byte-level bpe":
            assert out.columns == docs.columns
        if docs is none:
            assert not rows
        if name == "toxicity" or name == "pii":
            assert len(rows) == docs.count()  # nothing toxic here
        if name == "simhash near-dedup" and docs is not none:
            assert sorted((str(r[0]), r[1] or "") for r in rows) == [("1", ""), ("3", "another text"), ("3", "one"), ("None", ""), ("None", "x")]
        if docs is clash and name in ("toxicity", "pii", "simhash near-dedup"):
            assert {tuple(r)[5:] for r in rows} == {tuple(map(str, range(15)))}
