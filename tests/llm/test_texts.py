"""Extraction, tokenising, fingerprints, pseudonyms and classifiers against plain computations and held-out labels."""

import hashlib
import random
import re
import weakref
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from barloom.llm import bpe, pages, pii, quality, sketch, toxicity

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
TEXTS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, n, pool=("er", "on", "the", "é", "Ing", "ab\n")):
    return " ".join("".join(rng.choice(pool) for _ in range(rng.randint(1, 3))) for _ in range(n))


# pages -----------------------------------------------------------------------------------------------------------------


def best_sum(scores):
    return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_best_run():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        a, b = pages.best_run(s)
        assert sum(s[a:b]) == best_sum(s)


def article_of(source):
    import html

    article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    article = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)[^>]*>", "\n", article)))
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in article.split("\n")) if x)


def test_given_pages_give_their_articles(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    for r in pages.query(df).collect():
        assert r.text == article_of(source[r.page_id])
        assert r.n_chars == len(r.text)


#: Other ways of building the given pages, which leave their article's text as it is.
REBUILT = {
    "no article": lambda h: re.sub("</?article>", "", h),
    "div": lambda h: h.replace("article>", "div>"),
    "has-sidebar": lambda h: h.replace("<article>", '<div class="has-sidebar"><article>').replace("</article>", "</article></div>"),
    "no-comments": lambda h: h.replace("<article>", '<div class="post no-comments">').replace("</article>", "</div>"),
    "content-sidebar-wrap": lambda h: h.replace("<article>", '<div class="content-sidebar-wrap">').replace("</article>", "</div>"),
    "promo-free": lambda h: h.replace("<p>", '<p class="promo-free">'),
    "form around the page": lambda h: h.replace("<body>", "<body><form>").replace("</body>", "</form></body>"),
    "div that a slash leaves open": lambda h: h.replace("<article>", "<div/><article>"),
    "comments": lambda h: h.replace("</article>", '</article><section id="comments"><p>' + "nice post " * 200 + "</p></section>"),
    "comments without article": lambda h: h.replace("<article>", "<div>").replace("</article>", '</div><section id="comments"><p>nice post</p></section>'),
    "sidebar": lambda h: h.replace("<article>", '<div class="sidebar"><h3>Latest</h3><p>see also this</p></div><article>'),
    "header": lambda h: h.replace("<nav>", '<header><a href="/">Site</a><p>all the daily words</p></header><nav>'),
    "cookies": lambda h: h.replace("<nav>", '<div id="cookie-notice"><p>We use cookies</p><button>OK</button></div><nav>'),
    "form in the article": lambda h: h.replace("</article>", "<form><label>Mail</label><input name=a><button>Send</button></form></article>"),
    "advert in the article": lambda h: h.replace("</article>", '<div class="ad-slot"><p>buy this</p></div></article>'),
}


def test_rebuilt_pages_give_the_same_articles():
    import pyarrow.parquet as pq

    sources = pq.read_table(f"{SF2}/pages.parquet", columns=["html"])["html"].to_pylist()
    weights = pages.fit(sources[:100])
    for name, rebuilt in REBUILT.items():
        wrong = [h for h in sources[100:] if pages.main_text(rebuilt(h), weights) != article_of(h)]
        assert not wrong, (name, len(wrong))


def test_tables_lists_and_forms_of_an_article_stay():
    """A short table or list as an article's first, second or last block, whether an <article> or a <div> is around it; a
    <form> in the article's place."""
    import pyarrow.parquet as pq

    sources = pq.read_table(f"{SF2}/pages.parquet", columns=["html"])["html"].to_pylist()
    weights = pages.fit(sources[:100])
    blocks = {"<table><tr><td>aa bb</td><td>cc dd</td></tr></table>": "<p>aa bb cc dd</p>", "<ul><li>aa bb</li><li>cc dd</li></ul>": "<p>aa bb</p><p>cc dd</p>", "<dl><dt>aa</dt><dd>bb</dd></dl>": "<p>aa</p><p>bb</p>"}
    places = {
        "first": lambda h, x: h.replace("<article>", "<article>" + x),
        "second": lambda h, x: re.sub(r"(<article>.*?</p>)", lambda m: m[1] + x, h, count=1, flags=re.S),
        "last": lambda h, x: h.replace("</article>", x + "</article>"),
    }
    for name, put in places.items():
        for block, same in blocks.items():
            for around in ("article", "div"):
                if (name, around) == ("first", "div"):
                    continue  # nothing says where that article begins
                wrong = [h for h in sources[100:] if pages.main_text(put(h, block).replace("article>", f"{around}>"), weights) != article_of(put(h, same))]
                assert not wrong, (name, block, around, len(wrong))
    assert not [h for h in sources[100:] if pages.main_text(h.replace("article>", "form>"), weights) != article_of(h)]


def test_the_query_equals_a_scan_of_all_runs(spark):
    """Pages with the weights that the query fits, their region found by trying all runs."""
    df = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    rows = df.orderBy("page_id").collect()
    weights = pages.fit([r.html for r in rows])
    got = {r.page_id: r.text for r in pages.query(df).collect()}
    for r in rows:
        elements, found = pages.parsed(r.html)
        weights.set_aside(elements)
        scores = [weights.of(t, elements) for t in found]
        sums = [0.0]
        for x in scores:
            sums.append(sums[-1] + x)
        best = max((sums[j] - sums[i], -i, j) for i in range(len(sums)) for j in range(i, len(sums)))
        a, b = -best[1], best[2]
        begin, end = pages.best_run(scores)
        assert abs((sums[end] - sums[begin]) - best[0]) < 1e-9
        whole = pages._region_text(elements, found, weights)
        assert got[r.page_id] == whole and (abs(sums[b] - sums[a] - best[0]) < 1e-9)


def test_labelled_pages_teach_what_no_name_says():
    """Boilerplate with classes that mean nothing by themselves: fitted weights know it, the plain ones don't."""
    rng = random.Random(4)
    article = lambda i: "".join(f"<p>{words(rng, rng.randint(5, 40), ('a', 'b', 'c'))} {i}</p>" for _ in range(3))
    page = lambda i, tag: f'<div class="q7"><p>{"x " * 30}</p></div><{tag}>{article(i)}</{tag}><section class="zu ro"><p>{"y " * 30}</p></section>'
    labelled = pages.fit([page(i, "article") for i in range(20)])
    right = {"fitted": 0, "plain": 0}
    for i in range(50):
        h = page(i, "main")
        text = re.search("<main>(.*)</main>", h, re.S)[1]
        text = "\n".join(" ".join(x.split()) for x in re.findall("<p>(.*?)</p>", text, re.S))
        right["fitted"] += pages.main_text(h, labelled) == text
        right["plain"] += pages.main_text(h, pages.PLAIN) == text
    assert right == {"fitted": 50, "plain": 0}
    # a class that one page has proves nothing
    assert pages.fit([page(0, "article")]).marks["q7"] > pages.ASIDE


def test_odd_pages(spark):
    cases = {
        "<p>a<p>b": "a\nb",
        '<div class="reader-comments"><p>bad</p></div><p>good &lt;b&gt; text</p>': "good <b> text",
        "<p title='a>b' x=\"q>\">he<b>ll</b>o w&nbsp;&#233;\n\t z</p><script>x<p>y</script": "hello w é z",
        "": "",
        None: "",
        "no tags at all <": "no tags at all <",
        "< p > 3 < 4": "< p > 3 < 4",
        "<p unclosed='": "",
        "<form><p>name</p></form><p>the text</p><!-- no --><style>p{}</style>": "the text",
        "<body class='has-sidebar'><p>kept</p><aside>not</aside></body>": "kept",
    }
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(cases)], "page_id long, url string, html string, text string")
    assert [r.text for r in pages.query(df).orderBy("page_id").collect()] == list(cases.values())
    assert pages.query(df.limit(0)).count() == 0


def test_weights_have_their_signs():
    w = pages.fit(["<nav><a>x y</a></nav><article><p>a b c</p></article><div>z</div>"] * 3)
    assert all(v > 0 for v in w.words.values()) and all(v <= 0 for v in w.tags.values())
    assert pages.fit(["<p>no article</p>"]) is pages.PLAIN


# byte-level BPE --------------------------------------------------------------------------------------------------------


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 40), (32_768, 512)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    rng = random.Random(2)
    texts = [None, "", "a", "it's  a\n\n  test 123 <|endoftext|> é 漢字 😀", "x" * 3000, " " * 500 + "y", " \n" * 300, "ab 'r" * 200, "'ll 're" * 100]
    texts += ["".join(rng.choice("abc  \n\t'stérlv12%$漢😀 ") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(50, 300))) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], TEXTS + ", k int").coalesce(3)
    rows = bpe.encoded(df, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    enc = library()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()


def test_bpe_query_and_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    enc, texts = library(), {r.doc_id: r.text for r in df.collect()}
    for r in bpe.query(df, RANKS, public_tokenizers.PATTERN).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.query(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_merges_equal_short_ones():
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(100):
        data = bytes(rng.choice(b"abcdet ") for _ in range(rng.randint(2, 60)))
        if data not in c.ranks:
            assert c._merge_long(data) == c._merge(data)


# fingerprints ----------------------------------------------------------------------------------------------------------


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    make = lambda t: sketch.sketch(sketch.shingle_hashes(sketch._words(t)))
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = make(t), make(edited), make(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), sketch.likeness(a, b), sketch.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [512, 8])
def test_fingerprints(spark, span):
    rng = random.Random(4)
    rows = [(rng.randint(-5000, 20000) * 7, words(rng, rng.randint(0, 60))) for _ in range(150)] + [(5, None), (5, "b"), (5, "b"), (None, "x y"), (None, None)]
    for own in (rows, rows[:1], [(3, "a b"), (9, "q w e r t y")], []):
        df = spark.createDataFrame([(*r, 1) for r in own], TEXTS + ", g int").repartition(4)
        assert sorted((tuple(r)[:7] for r in sketch.fingerprints(df, span=span).collect()), key=str) == brute_fingerprints(own)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    for sizes in ((20_000, 2_000), (3_000, 40), (40, 300), (10, 0)):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) * 2 for n in sizes)
        both = np.concatenate([a, b])
        x, y, whole = sketch.sketch(a), sketch.sketch(b), sketch.sketch(both)
        for s, h in ((x, a), (y, b)):
            # every hash below the fixed fraction is there, and no other than those below the sketch's own cut
            assert set(h[h < 2**64 // sketch.SCALE].tolist()) <= set(s.hashes.tolist()) == set(h[h < 2**64 // s.scale].tolist() if s.scale > 1 else h.tolist())
        merged = sketch.merged(x, y)
        scale = max(merged.scale, whole.scale)
        assert np.array_equal(merged.cut(scale), whole.cut(scale))
        assert sketch.containment(y, whole) == 1
        assert abs(sketch.likeness(x, whole) - len(a) / len(both)) < 0.12
    empty, tiny = sketch.sketch(np.zeros(0, dtype=np.uint64)), sketch.sketch(np.array([2**64 - 1], dtype=np.uint64))
    assert sketch.likeness(empty, empty) == 1 and sketch.likeness(empty, tiny) == 0 and len(tiny.hashes) == 1
    assert sketch.containment(tiny, sketch.sketch(rng.integers(0, 2**60, 9000, dtype=np.uint64))) == 0


def test_likeness_is_close_for_texts_of_all_lengths(spark):
    """Against the exact Jaccard similarity of all shingles: no error below 64 shingles, then that of 64 hashes."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") < 2000)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in sketch.query(df).collect()}
    shingles = lambda t: set(sketch.shingle_hashes(sketch._words(t)).tolist())
    errors = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        a, b = shingles(t), shingles(sketch.edited_text(t, after))
        exact = len(a & b) / len(a | b) if a | b else 1.0
        errors.append((len(a), abs(got[d].near_edited - exact)))
    assert max(e for n, e in errors if n < sketch.ENOUGH) < 1e-9
    assert np.mean([e for _, e in errors]) < 0.05 and max(e for _, e in errors) < 0.25


# pseudonyms ------------------------------------------------------------------------------------------------------------


KEY = pii.EXAMPLE_KEY


def number(key, *parts):
    return int(hashlib.sha256("|".join((key, *parts)).encode()).hexdigest()[:15], 16)


def plain_feistel(a, b, ra, rb, key, kind):
    for r in range(pii.ROUNDS):
        shift = number(key, f"{kind}:{ra}:{rb}", str(r), str(b if r % 2 == 0 else a))
        a, b = ((a + shift) % ra, b) if r % 2 == 0 else (a, (b + shift) % rb)
    return a, b


def plain_card(digits, key):
    body = digits[:-1]
    left = len(body) // 2
    a, b = plain_feistel(int(body[:left]), int(body[left:]), 10**left, 10 ** (len(body) - left), key, "card")
    body = f"{a:0{left}d}{b:0{len(body) - left}d}"
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def luhn(s):
    d = [int(x) for x in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark):
    rng = random.Random(6)
    cards = []
    while len(cards) < 40:
        c = "".join(rng.choice("0123456789") for _ in range(rng.choice((13, 15, 16, 19))))
        cards += [c] if luhn(c) else []
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(40)]
    rows = [(i, f"card {c}, ip {p}.") for i, (c, p) in enumerate(zip(cards, ips, strict=True))]
    got = {r.doc_id: r for r in pii.query(spark.createDataFrame(rows, TEXTS)).collect()}
    for i, (c, p) in enumerate(zip(cards, ips, strict=True)):
        o = [int(x) for x in p.split(".")]
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, KEY, "ip")
        assert got[i].text == f"card {plain_card(c, KEY)}, ip {a // 256}.{a % 256}.{b // 256}.{b % 256}."
        assert got[i].n_replaced == 2


def plain_phone(ten, key):
    area, exchange, line = int(ten[:3]), int(ten[3:6]), int(ten[6:])
    base, size = (0, 200) if area < 200 else (200, 800)
    low, many = (0, 1000) if area < 200 else (0, 200) if exchange < 200 else (200, 800)
    a, b = plain_feistel(area - base, (exchange - low) * 10_000 + line, size, many * 10_000, key, "phone")
    return f"{a + base:03d}{low + b // 10_000:03d}{b % 10_000:04d}"


def plain_ssn(value, key):
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = map(int, value.split("-"))
    x, y = plain_feistel(areas.index(a), (g - 1) * 9999 + s - 1, 898, 99 * 9999, key, "ssn")
    return f"{areas[x]:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"


def plain_day(day, form, key):
    from datetime import date, timedelta

    begin = date(2000, 1, 1) if day.year >= 2000 else date(1600, 1, 1)
    while True:
        n = (day - begin).days
        a, b = plain_feistel(n // 189, n % 189, 773, 189, f"{key}|{form}", "date")
        day = begin + timedelta(days=a * 189 + b)
        if form != "by day" or day.day > 12:
            return day


def plain_local(local, key):
    run = lambda c: next(((a, z - a + 1) for a, z in pii.LETTERS if a <= c <= z), (c, 1))
    codes = [ord(c) for c in local]
    tag = ",".join(str(run(c)[0]) for c in codes)
    for r in range(pii.ROUNDS):
        fixed = ",".join(str(c) if i % 2 == r % 2 else "" for i, c in enumerate(codes))
        moved = lambda c, i: run(c)[0] + (c - run(c)[0] + number(key, "email", tag, str(r), str(i), fixed)) % run(c)[1]
        codes = [c if i % 2 == r % 2 else moved(c, i) for i, c in enumerate(codes)]
    return "".join(map(chr, codes))


def test_pseudonyms_of_all_kinds_equal_plain_ones(spark):
    from datetime import date, timedelta

    rng = random.Random(7)
    want = {}
    for _ in range(60):
        ten = "".join(rng.choice("0123456789") for _ in range(10))
        new = plain_phone(ten, KEY)
        want[f"({ten[:3]}) {ten[3:6]}-{ten[6:]}"] = f"({new[:3]}) {new[3:6]}-{new[6:]}"
        if ten[0] > "1" and ten[3] > "1":
            want[ten] = new
        ssn = f"{rng.choice([1, 665, 667, 899, rng.randint(1, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        want[ssn] = plain_ssn(ssn, KEY)
        day = date(1600, 1, 1) + timedelta(days=rng.randrange(2 * 146_097))
        for form, how in (("iso", "%Y-%m-%d"), ("by month", "%m/%d/%Y"), ("dotted", "%d.%m.%Y"), *([("by day", "%d/%m/%Y")] if day.day > 12 else [])):
            want[day.strftime(how)] = plain_day(day, form, KEY).strftime(how)
        pool = rng.choice(("abcXYZ019", "éÜøß", "иванЁ", "王伟例", "αβγ", "שלום", "김서", "かな"))
        local = rng.choice(pool) + "".join(rng.choice(pool + "._-") for _ in range(rng.randint(0, 8))) + rng.choice(pool)
        want[f"{local}@x.org"] = f"{plain_local(local, KEY)}@x.org"
    df = spark.createDataFrame([(i, f"<{v}>") for i, v in enumerate(want)], TEXTS)
    for r in pii.query(df).collect():
        old = list(want)[r.doc_id]
        assert r.text == f"<{want[old]}>", old
        assert r.n_replaced == (want[old] != old)


def test_slashed_dates_are_one_to_one(spark):
    from pyspark.sql import functions as F

    days = spark.range(0, 146_097, 3).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    written = days.select(F.date_format("d", "MM/dd/yyyy").alias("s")).union(days.where("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy")))
    new = written.select("s", pii.date(F.col("s"), F.lit("k")).alias("p"))
    assert new.where("p is null or (substr(p, 1, 2) > '12') <> (substr(s, 1, 2) > '12')").count() == 0
    assert new.select("p").distinct().count() == new.count()


def test_formats_stay_valid_and_links_stay(spark):
    text = "Mail Zoë.a_1@mail5.example.com or +1 (743) 555-3824 (+1 (743) 555-3824), 123-45-6789 on 2024-02-29, 12/31/1999, 31/12/1999, 01.02.2003."
    keep = ["000-12-1234 2001-02-29 13/13/2000 999.1.1.1 4785380592391138 version 4.0. 1.2.3", "no number here", "", None]
    rows = [(1, text, 0), (2, "again +1 (743) 555-3824", 0), *((10 + i, t, 0) for i, t in enumerate(keep)), (1, text, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    more = df.selectExpr("*", "'x' as `a.b`", "'f' as FOUND", "'p' as pairs", "'t' as new_text", "'_' as _text")
    out = pii.pseudonymised(more, KEY, count="_n_replaced")
    assert out.columns == [*more.columns, "_n_replaced"]
    got = out.collect()
    assert {tuple(r)[3:8] for r in got} == {("x", "f", "p", "t", "_")}
    assert [r.text for r in got if r.doc_id >= 10] == keep
    first, last = [r for r in got if r.doc_id == 1]
    assert first.text == last.text and first._n_replaced == 8 and first.n_chars == len(first.text)
    m = re.fullmatch(
        r"Mail ([A-Z][a-z][^.])\.([a-z])_(\d)@mail5\.example\.com or (\+1 \(\d{3}\) \d{3}-\d{4}) \((\+1 \(\d{3}\) \d{3}-\d{4})\), (\d{3})-(\d{2})-(\d{4}) on (\d{4}-\d\d-\d\d), (\d\d)/(\d\d)/\d{4}, (\d\d)/(\d\d)/\d{4}, (\d\d)\.(\d\d)\.\d{4}\.", first.text
    )
    assert m and m[4] == m[5] and m[4] != "+1 (743) 555-3824"
    assert next(r for r in got if r.doc_id == 2).text == f"again {m[4]}"
    assert m[6] not in ("000", "666") and m[6] < "900" and m[7] != "00" and m[8] != "0000"
    from datetime import date

    assert date.fromisoformat(m[9]) != date(2024, 2, 29)
    assert int(m[10]) <= 12 and int(m[13]) <= 12 and int(m[15]) <= 12
    other = pii.pseudonymised(df, "another").first()
    assert other.text != first.text
    assert pii.query(df.limit(0)).count() == 0


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    p = pii.feistel(F.col("id") % 7, F.floor(F.col("id") / 7), F.lit(7), F.lit(11), F.lit("k"), "t")
    assert spark.range(77).select(p.alias("p")).distinct().count() == 77
    days = spark.range(3000).select(pii.date(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string"), F.lit("k")).alias("d"))
    assert days.where("d is null").count() == 0 and days.distinct().count() == 3000
    mails = spark.range(500).select(pii.email(F.concat(F.lit("ab"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("@x.org")), F.lit("k")).alias("m"))
    assert mails.distinct().count() == 500


def test_pseudonyms_run_in_the_engine_alone(spark):
    plan = pii.query(spark.createDataFrame([(1, "x")], TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [10_000, 1_000_000, 10_000_000])
def test_hostile_texts_neither_grow_the_stack_nor_the_time(spark, size):
    """Runs of what an address, a number or a date is made of, with and without a valid end, around values that must go."""
    from pyspark.sql import functions as F

    runs = ["x@" + "a." * (size // 2), "x@" + "ab." * (size // 3) + "org", "a" * size + "@x.org", "a.b@" * (size // 4), "1" * size, "1.2." * (size // 4), "123-" * (size // 4), "(555) " * (size // 6), "é@" + "-" * size]
    runs = runs if size < 5_000_000 else runs[:2]
    df = spark.createDataFrame([(i, f"write to ann@x.org, {r} or bob@x.org") for i, r in enumerate(runs)], TEXTS)
    texts = pii.pseudonymised(df, KEY).select("doc_id", F.substring("text", 1, 20).alias("head"), F.substring("text", -15, 15).alias("tail"), F.length("text").alias("n")).collect()
    assert len(texts) == len(runs)
    for r in texts:
        assert r.head.startswith(f"write to {plain_local('ann', KEY)}@x.org")
        assert r.tail.endswith(f" or {plain_local('bob', KEY)}@x.org") and r.n == len(runs[r.doc_id]) + len("write to ann@x.org,  or bob@x.org")


def test_addresses_are_bounded_as_mail_is(spark):
    found = {"l" * 64 + "@x.org": True, "l" * 65 + "@x.org": False, "x@" + "a." * 126 + "org": True}
    df = spark.createDataFrame(list(enumerate(found)), TEXTS)
    got = pii.query(df).collect()
    assert [r.n_replaced for r in sorted(got, key=lambda r: r.doc_id)] == [int(v) for v in found.values()]


def test_the_key_is_in_no_plan_and_its_absence_is_told(spark):
    df = spark.createDataFrame([(1, "ann@x.org 123-45-6789")], TEXTS)
    made = pii.pseudonymised(df, "a-secret-key")
    assert made.first().text == f"{plain_local('ann', 'a-secret-key')}@x.org {plain_ssn('123-45-6789', 'a-secret-key')}"
    for plan in (made._jdf.queryExecution().toString(), made._jdf.queryExecution().explainString(made._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))):
        assert "a-secret-key" not in plan
    with pytest.warns(UserWarning, match="public example key"):
        pii.session_key(df)


# classifiers -----------------------------------------------------------------------------------------------------------


def held_out_scores(spark, module, label, divisor, rest):
    import zlib

    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    rows = module.query(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    return [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def auc(pairs):
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))


def test_quality_on_held_out_rows(spark):
    assert auc(held_out_scores(spark, quality, "quality", 5, 0)) > 0.95


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out_scores(spark, toxicity, "toxic", 4, 2)
    assert auc(pairs) > 0.95
    assert sum(s >= 0.3 and not y for s, y in pairs) == 0


def test_edges_of_the_classifiers(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x", 1.0), (3, "word " * 300_000, 1.0), (3, "x", 1.0)], TEXTS + ", score double")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for rows in ([], [(1, 1), (2, 0), (2, 1), (3, None)], [(3, 0), (2, 1)]):
            labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
            got = module.query(docs, labels).collect()
            assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert module.query(docs.limit(0), labels).count() == 0


def test_labels_held_out_teach_nothing(spark):
    from barloom.llm.labelled import sample_of

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    import zlib

    ids = [r[0] for r in sample_of(docs, labels, "toxic", 1000, lambda d: ~toxicity.held_out(d))]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(sample_of(docs, labels, "toxic", 10, lambda d: ~toxicity.held_out(d))) == 10


def test_features_cover_whole_texts():
    text = b"ab cd ab\n ef" * 10
    assert len(quality.features(text)) > len(text)
    long = b"some words of text " * 120_000
    whole = Counter(quality.features(long).tolist())
    quality_piece, quality._PIECE = quality._PIECE, 50_000
    try:
        parts = Counter(quality.features(long).tolist())
    finally:
        quality._PIECE = quality_piece
    # only n-grams over the borders of pieces are other
    assert sum((whole - parts).values()) + sum((parts - whole).values()) < 0.001 * sum(whole.values())


def test_nearest_equals_all_cosines():
    rng = random.Random(8)

    def vector():
        t = sorted(rng.sample(range(30), rng.randint(1, 5)))
        w = np.array([rng.random() + 0.01 for _ in t])
        return np.array(t), w / np.sqrt((w * w).sum())

    dense = lambda v: np.bincount(v[0], v[1], 30)
    vectors = [vector() for _ in range(300)]
    vectors += vectors[:20]  # ties go to the smaller number
    for block in (1, 16, 1000):
        index = toxicity.Index(vectors, 30, block=block)
        for without in (-1, 3):
            for _ in range(100):
                q = vector() if rng.random() < 0.8 else vectors[3]
                cosines = [round(float(dense(q) @ dense(v)), 9) if i != without else 0 for i, v in enumerate(vectors)]
                want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[:7]
                ids, near = index.nearest(*q, 7, without=without)
                assert [round(float(s), 9) for s in near] == [-c for c, _ in want]
                assert without not in ids.tolist()
                assert all(cosines[i] == round(float(s), 9) for i, s in zip(ids.tolist(), near, strict=True))
    assert len(toxicity.Index([], 30).nearest(np.array([1]), np.array([1.0]), 3)[0]) == 0


def zipf_vectors(n, seed):
    """Vectors of 40 draws from a few common and many rare terms, as words of texts are; some of them twice."""
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(n):
        t = np.unique((2000 ** rng.random(40)).astype(np.int64) - 1)
        w = rng.random(len(t)) + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum())))
    return vectors + vectors[: n // 10]


@pytest.mark.parametrize("common", [0, 5, toxicity.COMMON])
@pytest.mark.parametrize("block", [4, 64])
def test_nearest_equals_all_cosines_however_many_terms_are_common(common, block):
    vectors = zipf_vectors(600, 3)
    index = toxicity.Index(vectors, 2000, block=block, common=common)
    assert len(index.common) == common or 5 < len(index.common) < common
    space = np.zeros((len(vectors), 2000))
    for i, (t, w) in enumerate(vectors):
        space[i, t] = w
    for j, (t, w) in enumerate(zipf_vectors(100, 4)[:100] + vectors[:50]):
        without = j - 100 if j >= 100 else -1
        cosines = np.round(space[:, t] @ w, 9)
        if without >= 0:
            cosines[without] = 0
        want = np.lexsort((np.arange(len(cosines)), -cosines))[:15]
        ids, near = index.nearest(t, w, 15, without=without)
        assert ids.tolist() == want.tolist()
        assert np.round(near, 9).tolist() == np.minimum(1, cosines[want]).tolist()


def test_common_terms_cost_no_postings(monkeypatch):
    """Of the postings of a text's terms, most of which belong to common terms, few are looked into one by one."""
    vectors = zipf_vectors(3000, 5)
    index, looked, ranges = toxicity.Index(vectors, 2000), [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda *a: looked.append(len((found := ranges(*a))[0])) or found)
    often = np.bincount(np.concatenate([t for t, _ in vectors]), minlength=2000)
    texts = zipf_vectors(50, 6)
    for t, w in texts:
        index.nearest(t, w, 15)
    assert sum(looked) < 0.5 * sum(often[t].sum() for t, _ in texts)


def test_model_holds_one_index_at_a_time(monkeypatch):
    """The folds' indexes are made one after the other in the driver's memory."""
    made, most = [], []

    class Told(toxicity.Index):
        def __init__(self, *args, **more):
            made.append(weakref.ref(self))
            most.append(sum(x() is not None for x in made))
            super().__init__(*args, **more)

    monkeypatch.setattr(toxicity, "Index", Told)
    rng = random.Random(5)
    examples = [(i, (words(rng, 20) + " idiot" * (i % 3 == 0)).encode(), int(i % 3 == 0)) for i in range(60)]
    terms = sorted({t for _, x, _ in examples for t in toxicity.terms_of(x)})
    model = toxicity.Model(examples, terms, np.ones(len(terms), dtype=np.int64), 60)
    assert len(made) == toxicity.FOLDS + 1 and set(most) == {1}
    assert model.score(b"idiot")[0] > model.score(b"er on")[0]


def test_toxicity_query_equals_all_cosines(spark):
    """Evidence and score of every document, computed anew over all examples with dictionaries."""
    from math import log, sqrt

    from barloom.llm.labelled import sample_of

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    examples = sample_of(docs, labels, "toxic", toxicity.SAMPLE, lambda d: ~toxicity.held_out(d))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    model = toxicity.fit(docs, labels, lambda d: ~toxicity.held_out(d))
    vocabulary = {t for _, x, _ in examples for t in toxicity.terms_of(x)}
    often = Counter(t for x in texts.values() for t in set(toxicity.terms_of(x)))
    names = sorted(vocabulary)
    learned = toxicity.relevance([np.array([names.index(t) for t in sorted(set(toxicity.terms_of(x)))]) for _, x, _ in examples], np.array([y for *_, y in examples]), len(names))
    scale = {t: (log((len(texts) + 1) / (often[t] + 1)) + 1e-3) * r for t, r in zip(names, learned.tolist(), strict=True)}

    unseen = (log(len(texts) + 1) + 1e-3) * toxicity.FLOOR  # words that no example holds

    def vector(text):
        w = {t: (1 + log(n)) * scale.get(t, unseen) for t, n in Counter(toxicity.terms_of(text)).items()}
        size = sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    space = [(i, vector(x), y) for i, x, y in examples]
    rows = toxicity.query(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = vector(texts[r.doc_id])
        near = sorted(((sum(w * v.get(t, 0.0) for t, w in own.items()), -i, y) for i, v, y in space), reverse=True)[: toxicity.NEIGHBOURS]
        near = [x for x in near if x[0] > 0]
        assert bool(near) == bool(own.keys() & vocabulary)  # every document with a word of the examples has neighbours
        assert [round(e.cosine, 9) for e in r.evidence] == [round(min(1, c), 9) for c, *_ in near[: toxicity.EVIDENCE]]
        if near:
            vote = sum(c * c * y for c, _, y in near) / sum(c * c for c, *_ in near)
            at, value = model.knots
            level = value[max(0, int(np.searchsorted(at, vote + 1e-12, side="right")) - 1)]
            low = value[max(0, int(np.searchsorted(at, vote - 1e-9, side="right")) - 1)]
            assert min(abs(r.score - 0.98 * v - 0.02 * vote) for v in (level, low)) < 1e-9


def test_words_that_no_example_holds_count():
    """A toxic example among thousands of other words is no longer at cosine 1, and the score is as before."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")  # noqa: E731  digits are no words
    examples = [(i, f"bad worse{word(i)} worst".encode(), 1) for i in range(8)] + [(10 + i, f"fine good{word(i)} better".encode(), 0) for i in range(8)]
    terms = sorted({t for _, x, _ in examples for t in toxicity.terms_of(x)})
    model = toxicity.Model(examples, terms, np.full(len(terms), 3), 1000)
    text = f"bad worse{word(1)} worst "
    (alone, near), (among, far) = (model.score(x.encode()) for x in (text, text + " ".join(f"other{word(i)}" for i in range(3000))))
    assert near[0][0] == far[0][0] == 1 and abs(near[0][1] - 1) < 1e-9 and far[0][1] < 0.9
    assert abs(alone - among) < 1e-9


def test_isotonic():
    x, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0])
    at, value = toxicity.isotonic(x, y)
    assert at.tolist() == [0.0, 1.0, 3.0] and value.tolist() == [0.0, 0.5, 1.0]


def test_document_frequencies_cover_all_documents(spark):
    df = spark.createDataFrame([(i, "abc defghij" if i % 3 == 0 else "Abc") for i in range(30)], TEXTS)
    count, n = toxicity._frequencies(df, [b"abc", b"defghij", b"none"])
    assert (count.tolist(), n) == ([30, 10, 0], 30)


def test_relevance():
    every, mark = np.array([0, 1]), np.array([0, 2])
    counts = [np.append(mark if i % 2 else every, i + 3) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    r = toxicity.relevance(counts, labels, 63)
    assert r[2] > 0.5 and r[0] == r[1] == toxicity.FLOOR  # what clean examples hold more often marks nothing
    assert (toxicity.relevance(counts, labels * 0, 63) == toxicity.FLOOR).all()
    copies = toxicity.relevance([np.array([0, 1, 2])] * 50 + [np.array([0, 5, 6])], np.array([1] * 50 + [0]), 7)
    assert copies[2] < 0.3  # copies count once
