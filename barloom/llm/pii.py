"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions only.

Found and validated: payment card numbers (Luhn), IPv4 addresses, social security numbers, phone numbers of ten digits,
calendar dates and e-mail addresses (local parts of up to 64 characters and domains of up to 127 labels, as mail allows).
Each is permuted among the values of its own kind and way of writing under a key, so
the same value gets the same pseudonym in every document, two values that are written alike never share one, and a
pseudonym is as valid as what it stands for. A value is split into two parts that take turns in being shifted by a keyed
hash of the other one (mixed radix: the shift is modulo the number of values that the part can have). What fails its
validation stays. IBANs, IPv6 addresses and phone numbers of other lengths are not looked for.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import unused

ROUNDS = 8
#: The session's setting that holds the secret, and what stands for it where none is set (tests and examples).
SETTING, EXAMPLE_KEY = "spark.barloom.pseudonymKey", "pseudonym-key"

#: Patterns of each kind. A value neither begins nor ends inside a word or a longer number. Groups repeat a bounded number
#: of times: the engine's stack grows with each turn of a group, and a text may be made of nothing else.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]+\.){1,127}\p{L}{2,}"
PHONE = r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2}[2-9]\d{6})(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\p{N})"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
DATE = r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{L}\p{N}/-]|\.\p{N})"
ANY = "|".join((EMAIL, PHONE, DATE, SSN, IP, CARD))

#: Days are permuted within 400 years, after which the calendar repeats: 146097 = 773 * 189 days.
EPOCHS = ("1600-01-01", "2000-01-01")
DAYS = (773, 189)
#: A date that is written day first is permuted until its day can't be a month; each turn leaves 2 in 5 to go on.
TURNS = 64

# Fixed values of Unicode: first and last code points of runs of letters or digits without gaps, of one case and script.
LETTERS = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9),
    (0x3AC, 0x3CE), (0x400, 0x42F), (0x430, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x63F), (0x641, 0x64A), (0x660, 0x669), (0x905, 0x939),
    (0x966, 0x96F), (0xE01, 0xE30), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)


def keyed_number(key: Column, *parts: Column) -> Column:
    """A long below 2**60 from a SHA-256 over the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, radix_a: Column, radix_b: Column, key: Column, kind: str) -> Column:
    """Struct (a, b): the pair permuted among all pairs below the radixes."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    tag = F.concat_ws(":", F.lit(kind), radix_a.cast("string"), radix_b.cast("string"))

    def turn(s: Column, r: Column) -> Column:
        shift = keyed_number(key, tag, r.cast("string"), F.when(r % 2 == 0, s["b"]).otherwise(s["a"]).cast("string"))
        return F.struct(
            F.when(r % 2 == 0, (s["a"] + shift) % radix_a).otherwise(s["a"]).alias("a"),
            F.when(r % 2 == 0, s["b"]).otherwise((s["b"] + shift) % radix_b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by these, in order."""
    at = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _number(digits: Column, key: Column, kind: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    radix = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long"), radix(left), radix(n - left), key, kind)
    # evaluated once: the pair goes through a lambda
    return F.element_at(F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0"))), 1)


def card(value: Column, key: Column) -> Column:
    """All digits but the check digit are permuted; the check digit follows from them."""
    digits = _digits(value)

    def checked(body: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))
        return F.concat(body, F.element_at(fits, 1).cast("string"))

    body = _number(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    new = F.element_at(F.transform(F.array(body), checked), 1)
    return F.when(F.call_function("luhn_check", digits), F.element_at(F.transform(F.array(new), lambda d: _refilled(value, d)), 1))


def phone(value: Column, key: Column) -> Column:
    """The last ten digits are permuted; a country code stays. Area and exchange codes that begin with 2 to 9 keep to
    those, and so do the others, which no numbering plan gives out."""
    digits = _digits(value)
    part = lambda i, n: F.substring(digits, F.length(digits) - 10 + i, F.lit(n)).cast("long")
    area, exchange, line = part(1, 3), part(4, 3), part(7, 4)
    base = lambda code: F.when(code < 200, 0).otherwise(200)
    size = lambda code: F.when(code < 200, 200).otherwise(800)
    # where the area code is none, the exchange may be any
    low, many = F.when(area < 200, 0).otherwise(base(exchange)), F.when(area < 200, 1000).otherwise(size(exchange))
    pair = feistel(area - base(area), (exchange - low) * 10_000 + line, size(area), many * 10_000, key, "phone")

    def text(p: Column) -> Column:
        ten = F.lpad(((p["a"] + base(area)) * 10_000_000 + low * 10_000 + p["b"]).cast("string"), 10, "0")
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), ten)

    new = F.element_at(F.transform(F.array(pair), text), 1)
    return F.element_at(F.transform(F.array(new), lambda d: _refilled(value, d)), 1)


def ip(value: Column, key: Column) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    text = lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)))
    return F.when(F.array_max(o) <= 255, F.element_at(F.transform(F.array(pair), text), 1))


def ssn(value: Column, key: Column) -> Column:
    """Areas are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(value, "-"), i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(p: Column) -> Column:
        number = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((number, 3), (F.floor(p["b"] / 9999) + 1, 2), (p["b"] % 9999 + 1, 4))))

    return F.when(valid, F.element_at(F.transform(F.array(pair), text), 1))


def date(value: Column, key: Column) -> Column:
    """yyyy-mm-dd, mm/dd/yyyy, dd/mm/yyyy where the first number is no month, and dd.mm.yyyy, of the years 1600 to 2399.

    Dates that are written with slashes and day first become dates whose day is no month either, so that none is written
    like one that comes month first.
    """
    part = lambda i, n: F.substring(value, i, n)
    iso, dotted = F.substring(value, 5, 1) == "-", F.substring(value, 3, 1) == "."
    by_day = ~iso & ~dotted & (part(1, 2).cast("int") > 12)
    read = F.when(iso, value).when(dotted | by_day, F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2))).otherwise(
        F.concat(part(7, 4), F.lit("-"), part(1, 2), F.lit("-"), part(4, 2))
    )
    form = F.when(iso, "iso").when(dotted, "dotted").when(by_day, "by day").otherwise("by month")

    def permuted(day: Column) -> Column:
        late = day >= F.lit(EPOCHS[1]).cast("date")
        begin = F.when(late, F.lit(EPOCHS[1])).otherwise(F.lit(EPOCHS[0])).cast("date")
        n = F.datediff(day, begin)
        pair = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.concat_ws("|", key, form), "date")
        return F.element_at(F.transform(F.array(pair), lambda p: F.date_add(begin, (p["a"] * DAYS[1] + p["b"]).cast("int"))), 1)

    def again(day: Column, turn: Column) -> Column:
        return F.when((turn == 0) | (by_day & (F.day(day) <= 12)), permuted(day)).otherwise(day)

    def written(day: Column) -> Column:
        y, m, d = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
        slashed = F.when(by_day, F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
        return F.when(iso, F.concat_ws("-", y, m, d)).when(dotted, F.concat_ws(".", d, m, y)).otherwise(slashed)

    day = F.call_function("try_to_date", read, F.lit("yyyy-MM-dd"))
    new = F.aggregate(F.when(by_day, F.sequence(F.lit(0), F.lit(TURNS))).otherwise(F.array(F.lit(0))), day, again)
    return F.when(day.isNotNull() & (F.year(day) >= 1600) & (F.year(day) < 2400), F.element_at(F.transform(F.array(new), written), 1))


def email(value: Column, key: Column) -> Column:
    """The local part is permuted, character by character within the runs of ``LETTERS``; other characters and the domain stay."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    runs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(z - a + 1).alias("size")) for a, z in LETTERS])
    # (code, first code of its run, size of the run); a character outside all runs is a run of its own
    alone = lambda c: F.struct(c.alias("first"), F.lit(1).alias("size"))
    own = lambda c: F.coalesce(F.get(F.filter(runs, lambda r: (c >= r["first"]) & (c < r["first"] + r["size"])), F.lit(0)), alone(c))
    held = lambda c: F.transform(F.array(own(c)), lambda r: F.struct(c.alias("c"), r["first"].alias("first"), r["size"].alias("size")))[0]
    start = F.transform(F.transform(F.split(local, ""), F.ascii), held)

    def turn(s: Column, r: Column) -> Column:
        """Characters of one half (even or odd places) are shifted by a hash of the other half and of all runs."""
        tag = F.array_join(F.transform(s, lambda x: x["first"].cast("string")), ",")
        fixed = F.array_join(F.transform(s, lambda x, i: F.when(i % 2 == r % 2, x["c"].cast("string")).otherwise("")), ",")
        shift = lambda i: keyed_number(key, F.lit("email"), tag, r.cast("string"), i.cast("string"), fixed)
        moved = lambda x, i: (x["first"] + (x["c"] - x["first"] + shift(i)) % x["size"]).cast("int")
        return F.transform(s, lambda x, i: F.when(i % 2 == r % 2, x).otherwise(F.struct(moved(x, i).alias("c"), x["first"].alias("first"), x["size"].alias("size"))))

    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    return F.concat(F.array_join(F.transform(new, lambda x: letter(x["c"])), ""), F.lit("@"), domain)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one found value; null if it isn't valid."""
    is_kind = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(value, F.lit("@")), email(value, key))
        .when(is_kind(SSN), ssn(value, key))
        .when(is_kind(DATE), date(value, key))
        .when(is_kind(IP), ip(value, key))
        .when(is_kind(PHONE), phone(value, key))
        .otherwise(card(value, key))
    )


def _hidden(spark: SparkSession, key: str) -> Column:
    """The key as the only row of a table; a literal would stand in the plan."""
    return spark.createDataFrame([(key,)], "secret string").scalar()


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the values in ``text`` replaced and ``n_chars`` (if there is one) counted anew.

    count: name of a long column to add, with the number of values that changed. Whole texts, whatever their length. A
    null text stays null with 0 changed; repeated rows stay; columns of any name stay as they are. The key decides the
    pseudonyms and nothing else does, so tables that are processed apart stay linked. It comes from a table of one row, so
    that no plan, page or log of the session shows it.
    """
    found, pairs, new_text, secret = unused(docs, "found", "pairs", "new_text", "secret")
    docs_columns, docs = docs.columns, docs.withColumn(secret, _hidden(docs.sparkSession, key))
    own = F.col(f"`{text}`")
    some = F.when(own.rlike("[0-9@]"), F.regexp_extract_all(own, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn(found, F.coalesce(some, F.array().cast("array<string>")))
    fresh = F.transform(found, lambda v: F.struct(v.alias("old"), F.coalesce(pseudonym(v, F.col(secret)), v).alias("new")))
    marked = marked.withColumn(pairs, F.when(F.size(found) > 0, fresh))
    values = F.array_append(F.transform(pairs, lambda p: p["new"]), F.lit(""))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split(own, ANY, -1), values, lambda a, b: F.array(a, b))), "")
    out = marked.withColumn(new_text, F.when(F.col(pairs).isNull(), own).otherwise(rebuilt))
    changed = F.coalesce(F.size(F.filter(pairs, lambda p: p["new"] != p["old"])), F.lit(0)).cast("long")
    columns = [F.col(new_text).alias(c) if c == text else F.length(new_text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs_columns]
    return out.select(*columns, *([changed.alias(count)] if count else []))


def session_key(docs: DataFrame) -> str:
    """The secret that the session holds. A run without one is an example, whose pseudonyms anyone can undo, and warns."""
    key = docs.sparkSession.conf.get(SETTING, None)
    if key is None:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a public example key and hide nothing", stacklevel=2)
    return EXAMPLE_KEY if key is None else key


def query(docs: DataFrame) -> DataFrame:
    return pseudonymised(docs.select("doc_id", "text"), session_key(docs), count="n_replaced")
