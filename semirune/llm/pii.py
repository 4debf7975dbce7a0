"""Format-preserving pseudonyms of personal data by keyed Feistel permutations."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session keeps the key of its pseudonyms.
KEY_SETTING = "spark.semirune.pseudonyms.key"
ROUNDS = 8

#: The first letter or digit of a run, whatever its length, or the first after the value before; so no run is read twice.
EMAIL_START = r"(?<![A-Za-z0-9])(?:(?<![A-Za-z0-9][._%+-]{1,8})|(?<=\G[._%+-]{1,8}))"
DOMAIN = r"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
EMAIL = rf"{EMAIL_START}[A-Za-z0-9][A-Za-z0-9._%+-]*+{DOMAIN}"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
#: Digits and single separators up to a value of another kind: a card, or cards beside other numbers.
CARD = rf"(?<!\d)\d(?:\d|[ -](?![A-Za-z0-9][A-Za-z0-9._%+-]{{0,99}}{DOMAIN}|{DATE}|{IP}|{SSN}|{PHONE})\d){{12,}}+"
#: How many digits the parts of a card have, longest first; a card of one part has 13 to 19.
CARD_PARTS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
CARD_DIGITS = (13, 19)
FOUND = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))
KINDS = ("email", "date", "ip", "ssn", "phone", "card")

#: Dates from FIRST_DAY on, for DAYS days (two centuries), are permuted among themselves; so are the other days of the
#: years 1 to 9999, of which EARLIER lie before. The sizes are followed by two factors whose product is that size or little more.
FIRST_DAY, DAYS, DAYS_BY = "1900-01-01", 73049, (270, 271)
EARLIER, OTHER_DAYS, OTHER_BY = 693595, 3579010, (1258, 2845)


def _random(key: str, tweak: str, *values: Column) -> Column:
    """Pseudorandom long of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[v.cast("string") for v in values]), 256), 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(17)]), n + 1)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permutation of the digit strings of one length (2 to 32): halves are added to in turn, modulo their powers of ten."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = _power(u), _power(n - u)
    start = F.struct(F.substr(digits, F.lit(1), u).cast("long").alias("a"), F.substr(digits, u + 1, n).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["a"] + _random(key, tweak, n, i, s["b"]) % a, a)).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _random(key, tweak, n, i, s["a"]) % b, b))
        return F.struct(left.alias("a"), right.alias("b"))

    zeros = lambda x, width: F.lpad(x.cast("string"), width, F.lit("0"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: F.concat(zeros(s["a"], u), zeros(s["b"], n - u)))


def permute_number(x: Column, a: int, b: int, size: int, key: str, tweak: str) -> Column:
    """Permutation of 0 .. size-1, walking cycles of one over a * b numbers; a * b - size + 1 steps always suffice."""

    def once(v: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left = (s["l"] + _random(key, tweak, i, F.lit(0), s["r"]) % a) % a
            right = (s["r"] + _random(key, tweak, i, F.lit(1), left) % b) % b
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS // 2)]), start, step, lambda s: s["l"] * b + s["r"])

    walk = F.array(*[F.lit(0)] * (a * b - size)) if a * b > size else None
    first = once(x.cast("long"))
    return F.aggregate(walk, first, lambda v, _: F.when(v < size, v).otherwise(once(v))) if walk is not None else first


def refill(template: Column, digits: Column) -> Column:
    """Puts ``digits`` in the places of the template's digits."""
    kept = F.regexp_replace(template, r"\d", "0")
    put = F.aggregate(
        F.split(kept, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c == "0", F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(c == "0", 1).otherwise(0)).alias("at")),
        lambda s: s["out"],
    )
    return put


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, value(i)).otherwise(doubled(value(i))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn(digits: Column) -> Column:
    return luhn_sum(digits) % 10 == 0


def _once(value: Column, f) -> Column:
    """f(value), with ``value`` computed once: lambdas would compute it wherever it stands."""
    return F.element_at(F.transform(F.array(value), f), 1)


def card_spans(parts: Column, lengths: Column) -> Column:
    """Which of a run's ``parts`` (digit strings) with their ``lengths`` are cards: an array of (first, n), places from 1.

    Luhn-valid parts or groups of parts that are written as cards are, come
    first. What lies between them is taken up to 19 digits at a time, however
    it is spaced, and is a card where that is Luhn-valid.
    """
    low, high = CARD_DIGITS
    kind_of = "array<struct<first:int,n:int>>"
    places = F.sequence(F.lit(1), F.size(parts))
    joined = lambda i, n: F.array_join(F.slice(parts, i, n), "")
    start = F.struct(F.lit(1).alias("next"), F.array().cast(kind_of).alias("spans"))

    def written(s: Column, i: Column) -> Column:
        n = F.lit(0)
        for form in reversed(CARD_PARTS):
            fits = F.slice(lengths, i, F.lit(len(form))) == F.array(*[F.lit(x) for x in form])
            n = F.when(fits & _luhn(joined(i, F.lit(len(form)))), len(form)).otherwise(n)
        n = F.when(F.element_at(lengths, i).between(low, high) & _luhn(F.element_at(parts, i)), 1).otherwise(n)
        return F.aggregate(F.array(F.when(i >= s["next"], n).otherwise(0)), s, lambda t, k: F.when(k > 0, F.struct((i + k).alias("next"), F.concat(t["spans"], F.array(F.struct(i.alias("first"), k.alias("n")))).alias("spans"))).otherwise(t))

    def spaced(s: Column, i: Column) -> Column:
        free = lambda k: ~F.exists(s["spans"], lambda x: (x["first"] < i + k) & (x["first"] + x["n"] > i))
        fitting = F.filter(F.sequence(F.lit(1), F.least(F.lit(high), F.size(parts) - i + 1)), lambda k: (F.length(joined(i, k)) <= high) & free(k))
        most = F.when(i >= s["next"], F.coalesce(F.array_max(fitting), F.lit(0))).otherwise(0)

        def take(t: Column, k: Column) -> Column:
            digits = joined(i, k)
            found = F.when(_luhn(digits), F.concat(t["spans"], F.array(F.struct(i.alias("first"), k.alias("n"))))).otherwise(t["spans"])
            return F.when((k > 0) & (F.length(digits) >= low), F.struct((i + k).alias("next"), found.alias("spans"))).otherwise(t)

        return F.aggregate(F.array(most), s, take)

    as_written = F.aggregate(places, start, written, lambda s: F.struct(F.lit(1).alias("next"), s["spans"].alias("spans")))
    return F.aggregate(places, as_written, spaced, lambda s: s["spans"])


def cards(m: Column, key: str) -> Column:
    """(new, n): the run with its cards changed, and how many there are; other numbers beside them stay."""

    def of_parts(x: Column) -> Column:
        parts, between = x["parts"], x["between"]

        def text(i: Column, n: Column) -> Column:
            return F.array_join(F.transform(F.sequence(i, i + n - 1), lambda k: F.concat(F.when(k > i, F.substr(between, k - 1, F.lit(1))).otherwise(""), F.element_at(parts, k))), "")

        def one(spans: Column) -> Column:
            def piece(k: Column) -> Column:
                of = F.try_element_at(F.filter(spans, lambda s: (s["first"] <= k) & (s["first"] + s["n"] > k)), F.lit(1))
                gap = F.when(k > 1, F.substr(between, k - 1, F.lit(1))).otherwise("")
                return _once(of, lambda s: F.when(s.isNull(), F.concat(gap, F.element_at(parts, k))).when(s["first"] == k, F.concat(gap, _once(text(s["first"], s["n"]), lambda t: card(t, key)))).otherwise(""))

            new = F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), piece), "")
            return F.struct(F.when(F.size(spans) > 0, new).otherwise(m).alias("new"), F.size(spans).alias("n"))

        return _once(card_spans(parts, x["lengths"]), one)

    parts = F.split(m, "[ -]")
    return _once(F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.length(p)).alias("lengths"), F.regexp_replace(m, r"\d", "").alias("between")), of_parts)


def card(m: Column, key: str) -> Column:
    """A Luhn-valid number: all but the last digit are permuted and the check digit is made anew."""
    d = _digits(m)
    payload = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10
    return refill(m, F.concat(payload, check.cast("string")))


def phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code stays."""
    d = _digits(m)
    code = F.length(d) - 10
    return refill(m, F.concat(F.substr(d, F.lit(1), code), permute_digits(F.substr(d, code + 1, F.lit(10)), key, "phone")))


def _ssn_valid(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def ssn(m: Column, key: str) -> Column:
    """Numbers that may be issued are permuted among themselves: the cycle is walked to the next one (64 steps; 1 in 10 fails a step). Others are null."""
    d = _digits(m)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), permute_digits(d, key, "ssn"), lambda x, _: F.when(_ssn_valid(x), x).otherwise(permute_digits(x, key, "ssn")))
    return F.when(_ssn_valid(d), refill(m, found))


def ip(m: Column, key: str) -> Column:
    """Addresses with octets up to 255 are permuted among all; others are null."""
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    put = permute_number(number, 2**16, 2**16, 2**32, key, "ip")
    out = F.aggregate(F.array(put), F.lit(""), lambda _, p: F.concat_ws(".", *[(F.shiftright(p, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(octets, lambda x: x <= 255), out)


def date(m: Column, key: str) -> Column:
    """Days of the calendar are permuted among those of 1900 to 2099, or among all others, and written in the same form; what is no day is null.

    12/31/2020 is read month first where that is a day, else day first.
    """
    first = F.lit(FIRST_DAY).cast("date")

    def moved(at: Column) -> Column:
        near = permute_number(at, *DAYS_BY, DAYS, key, "date")
        # Days outside the two centuries are numbered without a gap.
        far = permute_number(F.when(at < 0, at + EARLIER).otherwise(at - DAYS + EARLIER), *OTHER_BY, OTHER_DAYS, key, "other date")
        far = F.aggregate(F.array(far), F.lit(0).cast("long"), lambda _, x: F.when(x < EARLIER, x - EARLIER).otherwise(x - EARLIER + DAYS))
        return F.when(at.between(0, DAYS - 1), near).otherwise(far)

    def as_form(form: str) -> tuple[Column, Column]:
        day = F.try_to_date(m, form)
        at = F.datediff(day, first)
        out = F.aggregate(F.array(moved(at)), F.lit(""), lambda _, x: F.date_format(F.date_add(first, x.cast("int")), form))
        return day.isNotNull() & (at >= -EARLIER), out

    iso, us, eu, dotted = map(as_form, ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy"))
    return F.when(m.contains("-") & iso[0], iso[1]).when(m.contains("/") & us[0], us[1]).when(m.contains("/") & eu[0], eu[1]).when(m.contains(".") & dotted[0], dotted[1])


def email(m: Column, key: str) -> Column:
    """Letters and digits of the local part are moved within their class; each half is the key of the other's moves."""
    local = F.split(F.substring_index(m, "@", 1), "")
    half = F.floor((F.size(local) + 1) / 2).cast("int")
    start = F.struct(F.slice(local, F.lit(1), half).alias("a"), F.slice(local, half + 1, F.size(local)).alias("b"))

    def move(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.size(local).cast("string"), i.cast("string"), F.array_join(other, "")), 256)

        def one(c: Column, at: Column) -> Column:
            by = F.conv(F.substr(stream, (at * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int")
            shifted = lambda base, size: F.char(((F.ascii(c) - base + by) % size + base).cast("long"))
            return F.when(c.rlike("[0-9]"), shifted(48, 10)).when(c.rlike("[a-z]"), shifted(97, 26)).when(c.rlike("[A-Z]"), shifted(65, 26)).otherwise(c)

        return F.transform(part, one)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, move(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(move(s["b"], s["a"], i)).alias("b"))

    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))
    return F.concat(done, F.lit("@"), F.substring_index(m, "@", -1))


def kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(whole(DATE), "date").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card")


def session_key(spark: SparkSession) -> str:
    """The key in the session's KEY_SETTING; where there is none, a random one is put there, which only this session knows."""
    known = spark.conf.get(KEY_SETTING, None)
    if not known:
        known = token_hex(32)
        spark.conf.set(KEY_SETTING, known)
    return known


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replaces personal data in ``docs.text`` by pseudonyms of the same format, and adds ``n_<kind>``, how many of each kind.

    E-mail addresses, dates, IPv4 addresses, US social security numbers, phone
    numbers and payment card numbers are found by pattern and validated (Luhn,
    calendar, octets, issuable areas); what fails stays as it is and isn't
    counted. Each value is permuted by ``key`` within its format, so equal
    values, however they are spaced, get equal pseudonyms in all documents, and
    different values different ones; who has the key can turn them back, so it
    has no default. One value in a format's number of values is its own
    pseudonym; it counts.

    All else stays: null texts stay null and count nothing, empty ones stay
    empty, texts of any length are read whole, repeated rows are changed alike,
    and an empty table is empty. Columns are kept whatever their names, except
    that any named n_<kind> is replaced. One pass over the rows, without a
    shuffle.
    """
    if not key:
        raise ValueError("pseudonyms take a key")
    named = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    has = F.col("text").rlike("[0-9@]")
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"), "text", F.when(has, F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))).alias("found"))
    change = {"email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone}

    def moved(x: Column) -> Column:
        m, known = x["m"], x["kind"]
        alone = lambda new: _once(new, lambda v: F.struct(F.coalesce(v, m).alias("new"), v.isNotNull().cast("int").alias("n")))
        out = F.when(known == "card", cards(m, key))
        for name, by in change.items():
            out = out.when(known == name, alone(by(m, key)))
        return F.struct(known.alias("kind"), out.alias("put"))

    some = F.size("found") > 0
    put = split.select("row", "text", F.when(some, F.transform(F.transform("found", lambda m: F.struct(m.alias("m"), kind(m).alias("kind"))), moved)).alias("found"))
    between = F.split(F.col("text"), FOUND, -1)
    ends = F.concat(F.transform("found", lambda f: f["put"]["new"]), F.array(F.lit("")))
    text = F.when(F.col("found").isNotNull(), F.array_join(F.zip_with(between, ends, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    counted = lambda name: lambda s, f: s + F.when(f["kind"] == name, f["put"]["n"]).otherwise(0)
    counts = [F.coalesce(F.aggregate("found", F.lit(0), counted(k)), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return put.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in named], *counts)
