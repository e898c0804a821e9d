"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets, in SQL functions only.

Each recognised value is validated, taken apart into two mixed-radix halves (L in 0..a-1, R in 0..b-1) and sent
through a keyed Feistel network, L += F(R) mod a and R += F(L) mod b in turn. Every round is a bijection, so
the whole is a permutation of the values of that format: equal values get equal pseudonyms in every document,
different values different ones, and check digits, separators and letter case stay valid. Card, account and phone
numbers are permuted without their separators and dates as days, so a value is linked across its spellings.

Kinds: email (local part), hex secret of 32 digits or more, IBAN (mod 97), date (ISO, dotted, slashed), social
security number, IPv4, payment card (Luhn), phone. A value that fails its validation is left as it is.

Defined results: a null text stays null, an empty one empty; texts without a value come back unchanged, byte for
byte; repeated rows give repeated results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The key of tests. A session names its own in spark.threadline.pseudonym.key.
DEFAULT_KEY = "threadline-pseudonyms"
#: Characters that a Feistel network takes at once, in ASCII and else; longer values are taken in numbered pieces.
PIECE, WIDE_PIECE = 24, 8
#: Ranges of letters outside ASCII that are permuted among themselves; every code point in them is a letter.
WIDE_RANGES = ("ÀÖ", "ØÞ", "ßö", "øÿ", "Āž", "ΑΡ", "ΣΩ", "αω", "АЯ", "ая", "ぁゖ", "ァヺ", "一龥", "가힣")

PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "hex": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Days of a Gregorian cycle of 400 years from FIRST_DAY on, 146097 = 189 * 773.
FIRST_DAY, DAY_RADICES = "1900-01-01", (189, 773)
LETTERS = {"hex": 6}


def session_key(spark: SparkSession) -> str:
    """The secret key of a session, from ``spark.threadline.pseudonym.key``; the test key where it is unset."""
    return spark.conf.get("spark.threadline.pseudonym.key", None) or DEFAULT_KEY


def prf(key: str, kind: Column | str, round_: Column, half: Column, modulus: Column) -> Column:
    """60 bits of SHA-256 over key, kind, round and the other half, below ``modulus``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    wide = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, round_.cast("string"), half.cast("string"), modulus.cast("string")), 256), 1, 15), 16, 10)
    return F.pmod(wide.cast("long"), modulus)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: Column | str) -> Column:
    """struct(l, r) of the permuted halves."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l2 = F.when(even, F.pmod(acc["l"] + prf(key, kind, i, acc["r"], a), a)).otherwise(acc["l"])
        r2 = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + prf(key, kind, i, acc["l"], b), b))
        return F.struct(l2.alias("l"), r2.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_at(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def wide_range(c: Column) -> Column:
    """The first and last code point of the range of a letter outside ASCII; null for other characters."""
    ranges = F.array(*[F.array(F.lit(ord(low)), F.lit(ord(high))) for low, high in WIDE_RANGES])
    return F.get(F.filter(ranges, lambda r: F.ascii(c).between(F.get(r, F.lit(0)), F.get(r, F.lit(1)))), F.lit(0))


def radix(c: Column, letters: int) -> Column:
    """``letters`` of 0: letters outside ASCII count too."""
    ascii_only = F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), letters or 26)
    if letters:
        return ascii_only.otherwise(1).cast("long")
    return ascii_only.otherwise(F.coalesce(let(wide_range(c), lambda r: F.get(r, F.lit(1)) - F.get(r, F.lit(0)) + 1), F.lit(1))).cast("long")


def base(c: Column, letters: int) -> Column:
    ascii_only = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    return ascii_only.otherwise(F.ascii(c) if letters else F.coalesce(F.get(wide_range(c), F.lit(0)), F.ascii(c)))


def character(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.when(code < 128, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def places(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def size_of(text: Column, letters: int) -> Column:
    return F.aggregate(places(text), F.lit(1).cast("long"), lambda acc, i: acc * radix(char_at(text, i), letters))


def number_of(text: Column, letters: int) -> Column:
    """The mixed-radix number of a text's digits and letters; other characters have radix 1."""
    return F.aggregate(places(text), F.lit(0).cast("long"), lambda acc, i: let(char_at(text, i), lambda c: let(radix(c, letters), lambda r: acc * r + F.when(r > 1, F.ascii(c) - base(c, letters)).otherwise(0))))


def text_of(number: Column, shape: Column, letters: int) -> Column:
    start = F.struct(number.alias("rest"), F.lit("").alias("out"))

    def put(acc: Column, c: Column, r: Column) -> Column:
        code = base(c, letters) + F.pmod(acc["rest"], r)
        one = F.when(r > 1, F.char(code) if letters else let(code, character)).otherwise(c)
        return F.struct(F.call_function("div", acc["rest"] - F.pmod(acc["rest"], r), r).alias("rest"), F.concat(one, acc["out"]).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        return let(char_at(shape, i), lambda c: let(radix(c, letters), lambda r: put(acc, c, r)))

    return F.aggregate(F.reverse(places(shape)), start, step)["out"]


def permute_piece(text: Column, key: str, kind: Column, letters: int) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return let(F.struct(F.substring(text, F.lit(1), half).alias("x"), F.substring(text, half + 1, F.length(text)).alias("y")), lambda h: let(
        feistel(number_of(h["x"], letters), number_of(h["y"], letters), size_of(h["x"], letters), size_of(h["y"], letters), key, kind),
        lambda n: F.concat(text_of(n["l"], h["x"], letters), text_of(n["r"], h["y"], letters)),
    ))


def permute_chars(text: Column, key: str, kind: str, wide: bool = False) -> Column:
    """Permute the digits and letters of a text among those of their class; the rest stays in place."""
    def by(size: int, letters: int) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
        return F.array_join(F.transform(pieces, lambda i: let(F.substring(text, i * size + 1, F.lit(size)), lambda piece: permute_piece(piece, key, F.concat(F.lit(kind), i.cast("string")), letters))), "")

    plain = by(PIECE, LETTERS.get(kind, 26))
    out = F.when(text.rlike(r"[^\x00-\x7F]"), by(WIDE_PIECE, 0)).otherwise(plain) if wide else plain
    return F.when(F.length(text) > 0, out).otherwise(text)


def laid_out(shape: Column, letters: Column) -> Column:
    """``shape`` with its digits and letters replaced in turn by ``letters``; separators stay in place."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        c = char_at(shape, i)
        fill = c.rlike("[0-9A-Za-z]")
        return F.struct((acc["n"] + fill.cast("int")).alias("n"), F.concat(acc["out"], F.when(fill, char_at(letters, acc["n"] + 1)).otherwise(c)).alias("out"))

    return F.aggregate(places(shape), start, step)["out"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def card(m: Column, key: str) -> Column:
    def close(head: Column) -> Column:
        last = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(digits(head), c.cast("string")))), F.lit(0))
        return F.concat(head, last.cast("string"))

    head = let(digits(m), lambda d: permute_chars(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))
    return F.when(F.call_function("luhn_check", digits(m)), let(let(head, close), lambda d: laid_out(m, d))).otherwise(m)


def mod97(text: Column) -> Column:
    """The number of a text of digits and capitals (A = 10) modulo 97."""
    letter = lambda c: c.between("A", "Z")
    return F.aggregate(places(text), F.lit(0).cast("long"), lambda acc, i: let(char_at(text, i), lambda c: F.pmod(F.when(letter(c), acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48), F.lit(97))))


def iban(m: Column, key: str) -> Column:
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    moved = lambda x, check: F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 2), check)

    def close(body: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(plain(body), F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(m, 1, 2), check, body)

    valid = mod97(moved(plain(m), F.substring(m, 3, 2))) == 1
    body = let(plain(m), lambda p: permute_chars(F.substring(p, F.lit(5), F.length(p)), key, "iban"))
    return F.when(valid, let(let(body, close), lambda d: laid_out(m, d))).otherwise(m)


def moved_day(at: Column, key: str, kind: str) -> Column:
    a, b = DAY_RADICES
    halves = lambda n: feistel(F.call_function("div", n, F.lit(b)), F.pmod(n, F.lit(b)), F.lit(a), F.lit(b), key, kind)
    return let(at, lambda n: let(halves(n), lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["l"] * b + h["r"]).cast("int"))))


def date(m: Column, key: str) -> Column:
    """ISO dates; day.month.year; month/day/year where that is a date, else day/month/year. One or two digits stay so where the number allows."""
    a, b = DAY_RADICES
    number = lambda i: F.regexp_extract(m, r"^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$", i).try_cast("int")
    made = lambda y, mo, d: F.to_date(F.when(mo.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, mo, d)), "yyyy-MM-dd")
    safe = lambda y, mo, d: F.when(d <= F.dayofmonth(F.last_day(made(y, mo, F.lit(1)))), made(y, mo, F.least(d, F.dayofmonth(F.last_day(made(y, mo, F.lit(1)))))))
    forms = (
        (m.rlike("^[0-9]{4}-"), safe(number(1), number(2), number(3)), "yyyy-MM-dd", "yyyy-MM-dd"),
        (m.contains("."), safe(number(3), number(2), number(1)), "dd.MM.yyyy", "d.M.yyyy"),
        (m.contains("/"), safe(number(3), number(1), number(2)), "MM/dd/yyyy", "M/d/yyyy"),
        (m.contains("/"), safe(number(3), number(2), number(1)), "dd/MM/yyyy", "d/M/yyyy"),
    )
    out = m
    for shape, day, padded, short in reversed(forms):
        at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        new = moved_day(at, key, "date")
        shown = F.when(m.rlike("^[0-9]{2}[./][0-9]{2}[./]|^[0-9]{4}-"), F.date_format(new, padded)).otherwise(F.date_format(new, short))
        out = F.when(shape & day.isNotNull() & at.between(0, a * b - 1), shown).otherwise(out)
    return out


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: 898 * 99 * 9999 valid numbers."""
    area, group, serial = (F.substring(m, i, n).try_cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    at = area - 1 - (area > 666).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    new = lambda h: let(F.call_function("div", h["l"], F.lit(99)), lambda x: F.format_string("%03d-%02d-%04d", x + 1 + (x >= 665).cast("long"), F.pmod(h["l"], F.lit(99)) + 1, h["r"] + 1))
    return F.when(valid, let(feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), new)).otherwise(m)


def ipv4(m: Column, key: str) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).try_cast("long")
    valid = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256)
    show = lambda h: F.concat_ws(".", *[x.cast("string") for side in (h["l"], h["r"]) for x in (F.shiftright(side, 8), F.pmod(side, F.lit(256)))])
    return F.when(valid, let(feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), key, "ipv4"), show)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The country code stays; 7 to 15 digits in all."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .-]?", 1)
    code = F.when(m.rlike(r"^\+[0-9]{1,3}[ .(-]"), code).otherwise(F.when(m.startswith("+"), F.substring(m, 1, 2)).otherwise(""))
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    new = F.concat(code, laid_out(rest, permute_chars(digits(rest), key, "phone")))
    return F.when(F.length(digits(m)).between(7, 15), new).otherwise(m)


def email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_chars(local, key, "email", wide=True), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one matched value, by the first kind whose whole pattern it is."""
    whole = lambda kind: m.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    return (
        F.when(m.contains("@"), email(m, key))
        .when(whole("hex"), permute_chars(m, key, "hex"))
        .when(whole("iban"), iban(m, key))
        .when(whole("date"), date(m, key))
        .when(whole("ssn"), ssn(m, key))
        .when(whole("ipv4"), ipv4(m, key))
        .when(whole("card"), card(m, key))
        .otherwise(phone(m, key))
    )


def pseudonymize(docs: DataFrame, *, text_col: str = "text", key: str = DEFAULT_KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with every recognised value of ``text_col`` replaced; ``count_col`` gets the number of changed values.

    Texts without a digit or an at sign, nearly all, cost one scan. In the others the pieces between matches
    and the matches are zipped together again, so nothing else in a text can change.
    """
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    # Names that no column of the caller has.
    marks = "_" * (1 + max(map(len, docs.columns), default=0))
    f, n = marks + "found", marks + "new"
    named = docs.withColumn(f, found).withColumn(n, F.transform(f, lambda m: pseudonym(m, key)))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.col(n).alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(F.col(f).alias("a"), F.col(n).alias("b")), lambda x: x["a"] != x["b"]))
    out = named.withColumn(text_col, F.when(F.size(f) > 0, joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(F.size(f) > 0, changed).otherwise(0).cast("long"))
    return out.drop(f, n)
