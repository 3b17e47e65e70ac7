"""Vector codes and token counts against plain loops and the libraries."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import token_counts as tc
from barloom.llm import vector_codes as vc

VECTORS = "vec_id long, label long, embedding array<double>"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def nearest(entries, part):
    d = [sum((a - b) ** 2 for a, b in zip(e, part, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Codes with Python's whole numbers, comparing every part with every entry."""
    kept = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = len(kept[0][2]) // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[list(part(v, p)) for _, _, v in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            members: dict = {}
            for _, _, v in kept:
                members.setdefault(nearest(book, part(v, p))[0], []).append(part(v, p))
            for e, own in members.items():
                book[e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, lab, v in kept:
        found = [nearest(b, part(v, p)) for p, b in enumerate(books)]
        error = sum(d for _, d in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in found), error))
    return [(i, code, error, sums[lab], sha) for i, lab, code, error in out]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [None, 1, 2, 3][i % 4], (rng.integers(-3, 4, 32) / 256).tolist()) for i in range(300)]  # many ties
    rows += [(1000 + i, 5, (rng.standard_normal(32) * 3).tolist()) for i in range(100)]
    same = rng.standard_normal(32).tolist()
    rows += [(2000 + i, 6, same) for i in range(200)]
    bad = [(-1, 1, None), (-2, 1, [0.0] * 31 + [None]), (-3, 1, [float("nan")] * 32), (-4, None, [float("inf")] * 32)]
    return rows + bad


def test_codes_equal_plain_ones(spark, vectors):
    extra = spark.createDataFrame([(*r, "x") for r in vectors], f"{VECTORS}, code string").repartition(5)
    got = sorted(tuple(r) for r in vc.query(extra).collect())
    assert got == sorted(plain_codes(vectors)) and len(got) == 600


@pytest.mark.parametrize("k", [1, 2, 5, 64])
def test_search_equals_all_distances_and_makes_fewer(k):
    rng = np.random.default_rng(k)
    for spread in (3, 1000):
        entries = rng.integers(-spread, spread, (k, 4))
        entries[k // 2 :] = entries[: k - k // 2]  # equal entries: the lower number counts
        x = rng.integers(-spread, spread, (500, 4))
        code, d, made = vc.Codebook(entries).search(x)
        all_d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
        assert made <= all_d.size and (k < 64 or made < all_d.size / 2)


def test_codes_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert vc.query(frame([])).count() == 0 and vc.query(frame([(1, 1, None), (2, 1, []), (3, 1, [1.0] * 15)])).count() == 0
    rows = [(2, None, [1.0] * 16), (2, None, [1.0] * 16), (None, 3, [-0.001] * 16), (5, 3, [2.0] * 32), (6, 3, [1e300] * 16)]
    got = vc.query(frame(rows)).collect()
    # another length than the smallest vec_id's is left out; a huge component counts as the bound
    assert sorted((r.vec_id or 0, r.error) for r in got) == [(0, 0), (2, 0), (2, 0), (6, 0)]
    assert {r.label_error for r in got} == {0} and len({r.codebooks_sha256 for r in got}) == 1
    with pytest.raises(ValueError):
        vc.encoded(frame(rows), entries=300)


# token counts ----------------------------------------------------------------------------------------------------------

POOL = [
    "a", "é", "!", "  ", "\n", " ", "'s", "'ll", "1", "½", "中", "<|endoftext|>", "<|endo", "Ᲊ", "\x1c", "\x85", " ", "Z" * 40, " " * 30, "𐺰", "​", "ab cd", "'", "힣", "🙂",
]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["x" * 5000, " " * 5000, "", "<|endoftext|>" * 100, None, "a b " * 3000, "'ll" * 2000]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 40), (100, 64), (1000, 512), (tc.CHUNK, tc.OVERLAP)])
def test_counts_equal_the_library(spark, library, texts, chunk, overlap):
    """Small chunks cut through special strings and through runs that are longer than any overlap at first."""
    df = spark.createDataFrame([(i % 90, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").coalesce(3)
    rows = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, PATH, PATTERN, chunk=chunk, overlap=overlap).collect())
    n = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert rows == sorted((i % 90, len((t or "").encode()), n[i], n[i] > 1024) for i, t in enumerate(texts))


def test_counts_of_the_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tc.query(docs, PATH, PATTERN).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in docs.collect()}
    assert tc.query(docs.limit(0), PATH, PATTERN).count() == 0


def test_other_kinds_of_tokenizers(spark, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            t = Tokenizer.from_file(path)
            want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
        else:
            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x or "" for x in texts], num_threads=1)]
        got = {r.doc_id: r.n_tokens for r in tc.token_counts(df, path, PATTERN).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_widths_must_fit(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        tc.token_counts(df, PATH, PATTERN, chunk=10, overlap=20)
    with pytest.raises(ValueError):
        tc.token_counts(df, PATH, PATTERN, chunk=100, overlap=20)
