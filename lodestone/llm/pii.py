"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates are validated first (checksums, ranges, calendar); what isn't valid
stays as it is. A valid value's number within its format is permuted by an alternating
Feistel network over Z_a x Z_b with a * b the size of the format's domain, so distinct
values stay distinct and equal values stay equal, in all documents. Check digits are
made anew. E-mail addresses, which are no numbers, become keyed hashes in the form of an
address. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import number_of

ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds in the order of their precedence at one place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:\x20[0-9]{4}){2}\x20[0-9]{1,4}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,4}|[0-9]{4}\x20[0-9]{6}\x20[0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])",
}
NUMBERS = rf"(?<![A-Za-z0-9])(?:(?=[0-9+(])(?:{'|'.join(KINDS[k] for k in ('date', 'ssn', 'ip', 'phone', 'card'))})|{KINDS['iban']})"
ANY = rf"{KINDS['email']}|{NUMBERS}"


def _f(key: str, kind: str, step: Column, x: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _whole(x: Column, y: int | Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", x, F.lit(y) if isinstance(y, int) else y).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1 (a long), or its inverse."""
    zero = F.struct(_whole(value, b).alias("l"), (value % b).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        sign = -1 if back else 1
        return F.struct(
            F.when(even, F.pmod(acc["l"] + sign * (_f(key, kind, i, acc["r"]) % a), a)).otherwise(acc["l"]).cast("long").alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * (_f(key, kind, i, acc["l"]) % b), b)).cast("long").alias("r"),
        )

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, zero, step, lambda acc: acc["l"] * b + acc["r"])


def permuted_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string of 1 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(10)])
    a, b = F.get(tens, F.floor(n / 2).cast("int")), F.get(tens, F.ceil(n / 2).cast("int"))
    return F.lpad(feistel(digits.cast("long"), a, b, key, kind, back).cast("string"), n, F.lit("0"))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def put_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    spots = F.transform(F.split(form, ""), lambda c: F.struct(c.alias("c"), c.rlike("^[0-9]$").alias("d")))
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        spots, zero,
        lambda acc, x: F.struct(F.concat(acc["s"], F.when(x["d"], F.substring(digits, acc["i"], F.lit(1))).otherwise(x["c"])).alias("s"), (acc["i"] + x["d"].cast("int")).alias("i")),
        lambda acc: acc["s"],
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit counted once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def mod97(text: Column) -> Column:
    """Of a string of digits and capital letters (A = 10 and so on) as one number."""
    values = F.transform(F.split(text, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97)


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = permuted_digits(body, key, "card")
    check = (10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(d) % 10 == 0, put_digits(m, F.concat(new, check.cast("string"))))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the rest, 6 to 14 digits, is permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[\x20.(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    d = digits_of(rest)
    return F.when(F.length(d).between(6, 14), F.concat(code, put_digits(rest, permuted_digits(d, key, "phone"))))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    new = feistel(F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p), F.lit(65536), F.lit(65536), key, "ip")
    return F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.call_function("shiftright", new, s).bitwiseAND(F.lit(255)).cast("string")), ".")


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    place = area - 1 - (area > 666).cast("long")
    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    to = F.transform(F.array(new), lambda v: F.struct(_whole(_whole(v, 9999), 99).alias("a"), (_whole(v, 9999) % 99 + 1).alias("g"), (v % 9999 + 1).alias("s")))
    out = F.transform(to, lambda t: F.concat_ws(
        "-", F.lpad((t["a"] + 1 + (t["a"] >= 665).cast("long")).cast("string"), 3, "0"), F.lpad(t["g"].cast("string"), 2, "0"), F.lpad(t["s"].cast("string"), 4, "0")
    ))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.get(out, F.lit(0)))


def _date(m: Column, key: str) -> Column:
    """Days from 1900-01-01 to 2099-12-31: 17 * 4297 of them. A date with slashes is read
    day first where that is a date, else month first."""
    out = F.lit(None).cast("string")
    for shape, form in ((r"^.{4}-", "yyyy-MM-dd"), (r"^..\.", "dd.MM.yyyy"), (r"^../", "MM/dd/yyyy"), (r"^../", "dd/MM/yyyy")):
        y, mo, d = (F.substring(m, form.index(c) + 1, form.count(c)) for c in "yMd")
        day = F.concat_ws("-", y, mo, d).try_cast("date")
        n = F.date_diff(day, F.lit("1900-01-01").cast("date")).cast("long")
        new = F.date_add(F.lit("1900-01-01").cast("date"), feistel(n, F.lit(17), F.lit(4297), key, "date").cast("int"))
        out = F.when(m.rlike(shape) & n.between(0, 73048), F.date_format(new, form)).otherwise(out)
    return out


def _iban(m: Column, key: str) -> Column:
    """The last digits of the account part, 18 at most, are permuted; the check digits are
    made anew, the country and letters stay."""
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    d = digits_of(account)
    tail = F.substring(d, F.greatest(F.length(d) - 17, F.lit(1)), F.least(F.length(d), F.lit(18)))
    digits = F.concat(F.substring(d, F.lit(1), F.length(d) - F.length(tail)), permuted_digits(tail, key, "iban"))
    new = put_digits(account, digits)
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = F.length(plain).between(15, 34) & (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & (F.length(d) > 0)
    return F.when(valid, put_digits(m, F.concat(check, digits)))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@pseudonym.invalid"))


REPLACE = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and an array column ``pii`` of
    (kind, value, pseudonym) in the order of the text.

    Null text stays null, with no entries; empty text stays empty. Rows are kept as they
    are, repeated ones too; a column named pii is replaced; an empty table stays empty.
    Matches that don't validate stay in the text. ``key`` is the secret: the same key
    gives the same pseudonyms in any run, and whoever has it can invert them. An empty key
    is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    names = [c for c in docs.columns if c not in ("pii", "_found")]
    found = F.when(F.col(text).contains("@"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))
    found = docs.select(*names, F.when(F.col(text).rlike("[0-9@]"), found).otherwise(F.array().cast("array<string>")).alias("_found"))

    def judged(m: Column) -> Column:
        kind = F
        for name, pattern in KINDS.items():
            kind = kind.when(m.rlike(f"^(?:{pattern})$"), F.lit(name))
        return F.struct(kind.alias("kind"), m.alias("value"))

    def replaced(x: Column) -> Column:
        value = F
        for name, function in REPLACE.items():
            value = value.when(x["kind"] == name, function(x["value"], key))
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), value.alias("pseudonym"))

    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    made = F.when(F.size("_found") > 0, F.transform(F.transform("_found", judged), replaced)).otherwise(none)
    found = found.withColumn("pii", made)
    pieces = F.zip_with(F.split(text, ANY, -1), "pii", lambda gap, p: F.concat(gap, F.coalesce(p["pseudonym"], p["value"], F.lit(""))))
    new = F.when(F.size("pii") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    columns = [new.alias(c) if c == text else F.col(c) for c in names]
    return found.select(*columns, F.filter("pii", lambda p: p["pseudonym"].isNotNull()).alias("pii"))


def summary(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_pii, n_<kind> ..., pseudonyms) of every row."""
    counts = [number_of("pii", k).alias(f"n_{k}") for k in KINDS]
    done = pseudonymised(docs.select("doc_id", "text"), key)
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *counts, F.array_join(F.transform("pii", lambda p: p["pseudonym"]), "|").alias("pseudonyms"))
