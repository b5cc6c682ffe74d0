"""Format-preserving pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
SIGNS = ALNUM + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days are permuted within blocks of this many, from this day on. The blocks at both ends of the calendar of four-digit years
#: are cut off where it ends: by number, where they begin and the sizes whose product is their number of days.
DAY_BLOCK, FIRST_DAY = (288, 256), "1900-01-01"
CUT_BLOCKS = {-10: (-693_595, (13, 2311)), 40: (2_949_120, (128, 73))}
#: Valid area and group pairs (898 x 99) and serials of US social security numbers.
SSN_PARTS = (898 * 99, 9999)

#: Countries by the length of their IBAN, whose printed form is blocks of four, so that a block after it is no part of it.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "DZ|IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
IBAN_BLOCKS = "|".join(rf"(?:{c})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_COUNTRIES.items())
#: Card numbers: four or more blocks of four (see card_parts), 4-6-5 or 4-6-4, plain; else any run of 13 to 19 digits without one
#: of these inside, so a number beside a card stays outside the match.
CARD_END = r"(?!\w|-\d)"
CARD_BLOCKS = r"\d{4}(?:[ -]\d{4}){3,}(?:[ -]\d{3}(?!\w|[ .-]\d))?"
CARD_KNOWN = rf"(?:{CARD_BLOCKS}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{13,19}}){CARD_END}"
CARD = rf"(?<![\w-])(?:{CARD_KNOWN}|(?!(?:\d{{1,18}}[ -]){{1,18}}{CARD_KNOWN})\d(?:[ -]?\d){{12,18}}{CARD_END})"

#: Telephone country codes of one and two digits; the others have three.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Forms of widely used access keys.
TOKENS = r"AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36,255}|sk-[0-9A-Za-z_-]{20,255}|xox[abeoprs]-[0-9A-Za-z-]{10,255}"
TOKEN_FRONT = r"^(?:AKIA|AIza|gh[pousr]_|sk-|xox[abeoprs]-)"
GROUP = "[0-9A-Fa-f]{1,4}"

#: What is looked for, in this order at each place. Validation follows; what fails it stays as it is.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:{GROUP}(?::{GROUP}){{7}}|{GROUP}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![\w:])",
    "iban": rf"(?<!\w)(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{IBAN_BLOCKS})(?!\w)",
    "token": rf"(?<![\w-])(?:{TOKENS})(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
    "iso_date": r"(?<![\w-])\d{4}-\d{1,2}-\d{1,2}(?![\w-])",
    "date": r"(?<![\w./])\d{1,2}[./]\d{1,2}[./]\d{4}(?!\w|[./]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)",
    "dialled": r"(?<![\w+])\+(?:\d{8,15}|\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,8})?(?:[ .-]\d{1,8}){1,4})(?!\w|[.-]\d)",
    "card": CARD,
}
ANY = "|".join(PATTERNS.values())
#: What every match has in it, quickly found.
HINT = r"[0-9@]|AIza|gh[pousr]_|sk-|xox"
#: A mark around matches, what stands for it in a text that has it, and the sign that starts such stand-ins.
MARK, ESCAPE = "\x01", "\x02"


def hashed(key: str, *parts: Column) -> Column:
    """SHA-256 in hex of the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


def byte_at(h: Column, j: Column) -> Column:
    return F.conv(F.substring(h, j * 2 - 1, F.lit(2)), 16, 10).cast("int")


def feistel_text(s: Column, alphabet: str, kind: Column, key: str) -> Column:
    """A keyed permutation of the strings of s's length over the alphabet: halves take turns in being shifted, sign by sign, by
    a hash of the other half. Halves are up to 32 signs long."""
    r = len(alphabet)

    def shift(u: Column, v: Column, i: Column) -> Column:
        h = hashed(key, kind, i.cast("string"), F.length(u).cast("string"), v)
        moved = F.transform(F.sequence(F.lit(1), F.length(u)), lambda j: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), F.substring(u, j, F.lit(1))) - 1 + byte_at(h, j), F.lit(r)) + 1, F.lit(1)))
        return F.when(F.length(u) == 0, F.lit("")).otherwise(F.array_join(moved, ""))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    turn = lambda x, i: F.struct(F.when(i % 2 == 0, shift(x["a"], x["b"], i)).otherwise(x["a"]).alias("a"), F.when(i % 2 == 0, x["b"]).otherwise(shift(x["b"], x["a"], i)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["a"], x["b"]))


def feistel_number(n: Column, sizes: tuple[int, int], kind: Column, key: str) -> Column:
    """A keyed permutation of the numbers below sizes[0] * sizes[1]: the two digits of that mixed radix take turns."""
    a, b = sizes
    h = lambda x, i: F.conv(F.substring(hashed(key, kind, i.cast("string"), x.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")
    start = F.struct(F.floor(n / b).cast("long").alias("a"), F.pmod(n, F.lit(b)).cast("long").alias("b"))
    turn = lambda x, i: F.struct(F.when(i % 2 == 0, F.pmod(x["a"] + h(x["b"], i), F.lit(a))).otherwise(x["a"]).alias("a"), F.when(i % 2 == 0, x["b"]).otherwise(F.pmod(x["b"] + h(x["a"], i), F.lit(b))).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: x["a"] * b + x["b"])


def only(x: Column, signs: str) -> Column:
    return F.regexp_replace(x, f"[^{signs}]", "")


def relay(x: Column, s: Column, signs: str) -> Column:
    """x with its characters of the class `signs` replaced, in order, by those of s."""
    one = lambda i: F.substring(x, i, F.lit(1))
    put = lambda i: F.when(one(i).rlike(f"[{signs}]"), F.substring(s, F.length(only(F.substring(x, F.lit(1), i), signs)), F.lit(1))).otherwise(one(i))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), put), "")


def luhn_sum(digits: Column) -> Column:
    """Digits doubled at every second place from the right, the last one plain."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)))


def mod97(x: Column) -> Column:
    """Of an IBAN's rearranged text, letters as 10 to 35; blanks do not count."""
    x = F.replace(x, F.lit(" "), F.lit(""))
    v = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(x, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda s, i: F.pmod(s * F.when(v(i) > 9, 100).otherwise(10) + v(i), F.lit(97)))


def is_card(x: Column) -> Column:
    return (F.pmod(luhn_sum(only(x, "0-9")), F.lit(10)) == 0) & only(x, "0-9").rlike("[1-9]")


def parts(x: Column) -> Column:
    """A match as parts (x, kind); kind is null where nothing is replaced. Of more than four blocks of digits the first four
    that are a valid card are one, with the three digits at the end where these make it valid; the rest is searched on."""
    part = lambda x, kind: F.struct(x.alias("x"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    cut = lambda s, i, n: F.substring(s, i, n)
    n = F.length(x)

    def step(done: Column, i: Column) -> Column:
        at = i * 5 + 1
        long = (at + 22 == n) & is_card(cut(x, at, F.lit(23)))
        size = F.when(at < done["next"], 0).when(long, 23).when((at + 18 <= n) & is_card(cut(x, at, F.lit(19))), 19).otherwise(0)
        before = part(cut(x, done["next"], at - done["next"]), none)
        found = F.concat(done["out"], F.array(before, part(cut(x, at, size), F.lit("card"))))
        return F.struct(F.when(size > 0, at + size).otherwise(done["next"]).cast("int").alias("next"), F.when(size > 0, found).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<x:string,kind:string>>").alias("out"))
    end = lambda done: F.concat(done["out"], F.array(part(cut(x, done["next"], n), none)))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 19) / 5).cast("int")), start, step, end)
    return F.when((n > 19) & x.rlike(f"^{CARD_BLOCKS}$"), blocks).otherwise(F.array(part(x, kind_of(x))))


def kind_of(x: Column) -> Column:
    """The first pattern whose form the whole match has and whose validation holds, or null."""
    whole = lambda k: x.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.split(x, r"\.")
    groups = F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    n = F.length(only(x, "0-9"))
    valid = {
        "ip": F.forall(octets, lambda o: o.cast("int") <= 255),
        "ipv6": x.rlike("[0-9]") & (groups >= 3) & ((groups == 8) | (groups <= 7) & x.contains("::")),
        "iban": mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1,
        "secret": x.rlike("[0-9]") & x.rlike("[A-Fa-f]"),
        "iso_date": as_date(x).isNotNull(),
        "date": as_date(x).isNotNull(),
        "ssn": ~x.rlike(r"^(000|666|9)|-00-|-0000$"),
        "dialled": (n >= 8) & (n <= 15),
        "card": is_card(x),
    }
    return F.coalesce(*[F.when(whole(k) & valid[k] if k in valid else whole(k), F.lit(k)) for k in PATTERNS])


def fields(x: Column) -> Column:
    return F.split(x, "[-./]")


def month_first(x: Column) -> Column:
    """Day first, unless a slash and the second number ask for the month first."""
    f = fields(x)
    return x.contains("/") & (F.try_element_at(f, F.lit(1)).cast("int") <= 12) & (F.try_element_at(f, F.lit(2)).cast("int") > 12)


def as_date(x: Column) -> Column:
    """The date of a text in one of the forms, null if there is no such day. A slash date that fits both orders is read
    day first; the pseudonym's day then is at most 12 or not as it happens, the form stays."""
    f = lambda i: F.try_element_at(fields(x), F.lit(i))
    two = lambda c: F.lpad(c, 2, "0")
    iso = F.when(x.rlike(r"^\d{4}-"), F.concat_ws("-", f(1), two(f(2)), two(f(3)))).when(month_first(x), F.concat_ws("-", f(3), two(f(1)), two(f(2)))).otherwise(F.concat_ws("-", f(3), two(f(2)), two(f(1))))
    return F.when(x.rlike(r"^[0-9./-]{8,10}$") & ~iso.startswith("0000"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def show_date(day: Column, x: Column) -> Column:
    """The day in the form of x: its order, its signs between, and without leading zeros if x has a field of one digit."""
    short = x.rlike(r"(^|[-./])\d([-./]|$)")
    cut_ = lambda c: F.when(short, F.regexp_replace(c, "^0", "")).otherwise(c)
    y, m, d = F.date_format(day, "yyyy"), cut_(F.date_format(day, "MM")), cut_(F.date_format(day, "dd"))
    signs = F.regexp_replace(x, "[0-9]", "")
    a, b = F.substring(signs, 1, 1), F.substring(signs, 2, 1)
    return F.when(x.rlike(r"^\d{4}-"), F.concat_ws("-", y, m, d)).when(month_first(x), F.concat(m, a, d, b, y)).otherwise(F.concat(d, a, m, b, y))


def feistel_day(day: Column, kind: Column, key: str) -> Column:
    """A keyed permutation of the days of each block, counted from FIRST_DAY; no day leaves the years 1 to 9999."""
    size = DAY_BLOCK[0] * DAY_BLOCK[1]
    block = F.floor(day / size)
    out = None
    for number, (start, sizes) in CUT_BLOCKS.items():
        mine = feistel_number(day - start, sizes, kind, key) + start
        out = F.when(block == number, mine) if out is None else out.when(block == number, mine)
    return out.otherwise(block * size + feistel_number(F.pmod(day, F.lit(size)), DAY_BLOCK, kind, key))


def national(x: Column) -> Column:
    """The digits of a telephone number after its country code; a number without one is all digits."""
    d = only(x, "0-9")
    return F.when(x.startswith("+"), F.regexp_replace(d, rf"^(?:{COUNTRY}|\d{{3}})", "")).otherwise(d)


def in_parts(f, s: Column, width: int) -> Column:
    """f on each stretch of `width` signs."""
    at = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / width).cast("int"))
    return F.array_join(F.transform(at, lambda i: f(F.substring(s, i * width + 1, F.lit(width)))), "")


def pseudonym(key: str) -> tuple:
    """Three steps for a match m: what is permuted, its permutation, and the match around it."""
    digits = lambda m: only(m["x"], "0-9")

    def core(m: Column) -> Column:
        x, k = m["x"], m["kind"]
        d = digits(m)
        octet = lambda o: F.lpad(F.lower(F.hex(o.cast("long"))), 2, "0")
        area = F.substring(d, 1, 3).cast("long")
        ssn = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(d, 4, 2).cast("long") - 1) * SSN_PARTS[1] + F.substring(d, 6, 4).cast("long") - 1
        return (
            F.when(k == "email", only(F.lower(F.substring_index(x, "@", 1)), "a-z0-9"))
            .when(k == "ipv6", F.lower(only(x, "0-9A-Fa-f")))
            .when(k == "token", only(F.regexp_replace(x, TOKEN_FRONT, ""), "0-9A-Za-z"))
            .when(k == "ip", F.array_join(F.transform(F.split(x, r"\."), octet), ""))
            .when(k == "iban", only(F.substring(x, F.lit(5), F.length(x)), "0-9"))
            .when(k == "secret", F.lower(x))
            .when(k.isin("iso_date", "date"), F.date_diff(as_date(x), F.lit(FIRST_DAY).cast("date")).cast("string"))
            .when(k == "ssn", ssn.cast("string"))
            .when(k.isin("phone", "dialled"), national(x))
            .when(k == "card", F.substring(d, F.lit(1), F.length(d) - 1))
        )

    def permuted(m: Column) -> Column:
        k, c = m["kind"], m["core"]
        kind = F.when(k == "iso_date", F.lit("date")).when(k == "dialled", F.lit("phone")).otherwise(k)
        return (
            F.when(k == "email", feistel_text(c, ALNUM, k, key))
            .when(k.isin("ip", "ipv6", "secret"), feistel_text(c, HEX, k, key))
            .when(k == "token", in_parts(lambda s: feistel_text(s, SIGNS, k, key), c, 64))
            .when(k.isin("iban", "phone", "dialled", "card"), feistel_text(c, DIGITS, kind, key))
            .when(k.isin("iso_date", "date"), feistel_day(c.cast("long"), kind, key).cast("string"))
            .when(k == "ssn", feistel_number(c.cast("long"), SSN_PARTS, k, key).cast("string"))
        )

    def shown(m: Column) -> Column:
        x, k, p = m["x"], m["kind"], m["p"]
        octet = lambda i: F.conv(F.substring(p, i * 2 + 1, F.lit(2)), 16, 10)
        n = p.cast("long")
        pair, serial = F.floor(n / SSN_PARTS[1]), F.pmod(n, F.lit(SSN_PARTS[1])) + 1
        area = F.floor(pair / 99) + 1
        bban = relay(F.substring(x, F.lit(5), F.length(x)), p, "0-9")
        return (
            F.when(k == "email", F.concat(relay(F.lower(F.substring_index(x, "@", 1)), p, "a-z0-9"), F.lit("@"), F.substring_index(x, "@", -1)))
            .when(k == "ip", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet), "."))
            .when(k == "iban", F.concat(F.substring(x, 1, 2), F.lpad((98 - mod97(F.concat(bban, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0"), bban))
            .when(k == "secret", F.when(x == F.upper(x), F.upper(p)).otherwise(p))
            .when(k == "ipv6", relay(x, F.when(x == F.upper(x), F.upper(p)).otherwise(p), "0-9A-Fa-f"))
            .when(k == "token", F.concat(F.regexp_extract(x, TOKEN_FRONT, 0), relay(F.regexp_replace(x, TOKEN_FRONT, ""), p, "0-9A-Za-z")))
            .when(k.isin("iso_date", "date"), show_date(F.date_add(F.lit(FIRST_DAY).cast("date"), p.cast("int")), x))
            .when(k == "ssn", F.concat_ws("-", F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.pmod(pair, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0")))
            .when(k.isin("phone", "dialled"), relay(x, F.concat(F.substring(digits(m), F.lit(1), F.length(digits(m)) - F.length(p)), p), "0-9"))
            .when(k == "card", relay(x, F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")), "0-9"))
            .otherwise(x)
        )

    return core, permuted, shown


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of docs with personal data in the text replaced, and __found (the kinds replaced, in order).

    E-mail addresses (their local part; the domain stays), IPv4 and IPv6 addresses, IBANs (mod 97), telephone numbers (their
    part after the country code), card numbers (Luhn), US social security numbers, dates of the years 1 to 9999, access keys and hex secrets become
    other valid values of the same form by keyed Feistel permutations, so equal values stay equal in all documents and different
    ones different. Check digits are set anew; punctuation stays; letters of e-mail local parts become small. Numbers that fail
    validation (a Luhn sum, an octet over 255, 30 February) stay. An IPv6 address is linked to others written the same way.

    `key` is the secret that the permutations depend on. Rows are mapped one by one: no shuffle, no Python. Whole texts of any length are searched, once; texts without
    a digit, an @ or the front of an access key are passed over. Null texts stay null; empty texts stay empty; an empty table
    gives an empty one. Extra columns pass through, one named __found is replaced. Rows that are equal give equal results.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    docs = docs.drop("__found")
    (pieces, hits) = fresh(docs.columns, "pieces", "hits")
    core, permuted, shown = pseudonym(key)
    text = F.col(text_col)
    each = lambda f, found: F.transform(found, lambda x: F.transform(x, f))
    lit = lambda x: F.lit(x)
    safe = F.replace(F.replace(text, lit(ESCAPE), lit(ESCAPE + "\x04")), lit(MARK), lit(ESCAPE + "\x03"))
    marked = F.split(F.regexp_replace(safe, ANY, f"{MARK}$0{MARK}"), MARK, -1)  # matches are every second piece
    out = docs.withColumn(pieces, F.when(text.rlike(HINT), marked))
    found = F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), parts)
    found = each(lambda m: F.struct(m["x"].alias("x"), m["kind"].alias("kind"), core(m).alias("core")), found)
    found = each(lambda m: F.struct(m["x"].alias("x"), m["kind"].alias("kind"), permuted(m).alias("p")), found)
    found = each(lambda m: F.struct(m["kind"].alias("kind"), shown(m).alias("y")), found)
    # One column each, so nothing is computed twice.
    out = out.withColumn(hits, F.when(F.size(pieces) > 1, found))
    gaps = F.filter(pieces, lambda _, i: i % 2 == 0)
    joined = F.array_join(F.flatten(F.zip_with(gaps, hits, lambda g, x: F.array(g, F.coalesce(F.array_join(F.transform(x, lambda m: m["y"]), ""), F.lit(""))))), "")
    joined = F.replace(F.replace(joined, lit(ESCAPE + "\x03"), lit(MARK)), lit(ESCAPE + "\x04"), lit(ESCAPE))
    return out.select(
        *[F.when(F.col(hits).isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.filter(F.transform(F.flatten(hits), lambda m: m["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")).alias("__found"),
    )


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_replaced, kinds (distinct, sorted) of every row. Nulls, empty and long texts, repeated rows and empty
    tables: see pseudonymize. Only two columns are read."""
    out = pseudonymize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    return out.select("doc_id", "text", F.size("__found").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("__found")).alias("kinds"))
