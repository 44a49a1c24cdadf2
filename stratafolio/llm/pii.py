"""Format-preserving pseudonyms for personal data, in built-in functions only.

Candidates are found by one pattern, validated (Luhn, mod 97, octets, calendar, number ranges), and replaced by a keyed
Feistel permutation of their own format: the other half of a value, hashed with the key, shifts each character within its
class. A permutation maps equal values to equal pseudonyms in all documents and different values to different ones; what is
valid stays valid. Candidates that fail validation stay as they are.

What is permuted is a value's canonical form (digits of cards and phone numbers, local parts of addresses in lower case, the day of a date, all
digits of an IPv6 address); separators and case are put back afterwards, so a value stays linked however it is written. A value that the permutation
would leave as it is takes the next one.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting that holds the key.
KEY_SETTING = "spark.stratafolio.pii.key"
ROUNDS = 8
DIGITS, LOWER, UPPER, HEX_LOWER, HEX_UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"

# The formats, tried in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]*[A-Za-z0-9](?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"
IP = r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)"
IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3}|(?:[0-9A-Fa-f]+::?){2}[0-9A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{10,30})(?![A-Za-z0-9])"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{1,4}){3,6}(?!\w)|(?<![\w+.-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ip": f"{IP}|{IP6}", "iban": IBAN, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE, "secret": SECRET}
ANY = "|".join(KINDS.values())
#: A text without these has no candidate.
HINT = "[0-9]{4}|@|::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]|[0-9]\\.[0-9]|\\+[0-9]|[A-Z]{2}[0-9]{2}|AKIA|gh[pousr]_|sk-|[0-9A-Fa-f]{32}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and standing once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(key: str | Column, kind: str, turn: Column, other: Column) -> Column:
    """The round function as a number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def permuted_pair(x: Column, y: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of the pairs below (a, b), as a struct x, y."""
    turn = lambda s, i: F.when(i % 2 == 0, F.struct(F.pmod(s["x"] + _number(key, kind, i, s["y"]), F.lit(a)).alias("x"), s["y"].alias("y"))).otherwise(F.struct(s["x"].alias("x"), F.pmod(s["y"] + _number(key, kind, i, s["x"]), F.lit(b)).alias("y")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), turn)


def _shifted(half: Column, other: Column, key: str, kind: str, turn: Column, classes: tuple[str, ...]) -> Column:
    """half with each character moved within its class by a byte of the hash of the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 512)

    def move(c: Column, j: Column) -> Column:
        byte = F.conv(F.substr(stream, (j % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for chars in classes:
            at = F.position(c, F.lit(chars))
            out = F.when(at > 0, F.substr(F.lit(chars), F.pmod(at - 1 + byte, F.lit(len(chars))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))


def permuted_text(value: Column, key: str, kind: str, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A permutation of the strings with the same class at each place."""
    cut = lambda v: F.floor(F.length(v) / 2).cast("int")
    start = let(value, lambda v: F.struct(F.substr(v, F.lit(1), cut(v)).alias("l"), F.substr(v, cut(v) + 1, F.length(v)).alias("r")))
    turn = lambda s, i: F.when(i % 2 == 0, F.struct(_shifted(s["l"], s["r"], key, kind, i, classes).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], s["l"], key, kind, i, classes).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _moved(value: Column, classes: tuple[str, ...]) -> Column:
    """value with its last character of a class moved by one within the class; without such a character as it is."""
    every = "".join(classes)
    following = "".join(chars[1:] + chars[0] for chars in classes)
    at = lambda v: F.length(F.regexp_extract(v, f"^.*[{every}]", 0))
    return let(value, lambda v: F.when(at(v) == 0, v).otherwise(F.concat(F.substr(v, F.lit(1), at(v) - 1), F.translate(F.substr(v, at(v), F.lit(1)), every, following), F.substr(v, at(v) + 1, F.length(v)))))


def _without_fixed_points(value: Column, permuted: Callable[[Column], Column], moved: Callable[[Column], Column]) -> Column:
    """The permutation, but a value that would stay as it is goes to the next one. Only that one value and what is permuted to the next one then meet."""
    return let(value, lambda v: let(permuted(v), lambda z: F.when(z == v, moved(z)).otherwise(z)))


def replaced_text(value: Column, key: str, kind: str, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    return _without_fixed_points(value, lambda v: permuted_text(v, key, kind, classes), lambda v: _moved(v, classes))


def replaced_pair(x: Column, y: Column, a: int, b: int, key: str, kind: str) -> Column:
    pair = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return _without_fixed_points(pair, lambda s: permuted_pair(s["x"], s["y"], a, b, key, kind), lambda s: F.struct(s["x"].alias("x"), F.pmod(s["y"] + 1, F.lit(b)).cast("bigint").alias("y")))


def filled(template: Column, digits: Column) -> Column:
    """template with its digits replaced in order."""
    before = lambda i: F.length(F.regexp_replace(F.substr(template, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(template, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, before(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, where places with this parity, counted from the right, are doubled."""

    def add(total: Column, x: Column) -> Column:
        return total + x

    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    checked = lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string"))
    new = lambda d: let(let(replaced_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), checked), lambda n: filled(m, n))
    return let(F.regexp_replace(m, "[ -]", ""), lambda d: F.when(luhn_sum(d, 1) % 10 == 0, new(d)).otherwise(m))


def _mod97(text: Column) -> Column:
    step = lambda a, c: F.when(F.position(c, F.lit(DIGITS)) > 0, (a * 10 + F.position(c, F.lit(DIGITS)) - 1) % 97).otherwise((a * 100 + F.position(c, F.lit(UPPER)) + 9) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    check = lambda new, country: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")

    def swap(plain: Column) -> Column:
        country, own = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
        whole = let(replaced_text(own, key, "iban"), lambda new: F.concat(country, check(new, country), new))
        spaced = F.when(F.contains(m, F.lit(" ")), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)
        return F.when(_mod97(F.concat(own, F.substring(plain, 1, 4))) == 1, spaced).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), swap)


def _ip(m: Column, key: str) -> Column:
    o = lambda parts, k: F.get(parts, F.lit(k))
    pair = lambda p: replaced_pair(o(p, 0) * 256 + o(p, 1), o(p, 2) * 256 + o(p, 3), 65536, 65536, key, "ip")
    shown = lambda s: F.concat_ws(".", F.floor(s["x"] / 256).cast("string"), (s["x"] % 256).cast("string"), F.floor(s["y"] / 256).cast("string"), (s["y"] % 256).cast("string"))
    four = let(F.transform(F.split(m, r"\."), lambda x: x.try_cast("int")), lambda p: F.when(F.forall(p, lambda x: x <= 255), let(pair(p), shown)).otherwise(m))
    return F.when(F.contains(m, F.lit(":")), _ip6(m, key)).otherwise(four)


def _ip6(m: Column, key: str) -> Column:
    """All 32 digits are permuted in lower case, whether or not zeros were left out, and written as eight groups."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    short = F.contains(m, F.lit("::"))
    ends = F.struct(groups(F.substring_index(m, "::", 1)).alias("head"), F.when(short, groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>")).alias("tail"))
    digits = lambda e, n: F.lower(F.array_join(F.transform(F.concat(e["head"], F.array_repeat(F.lit("0"), 8 - n), e["tail"]), lambda g: F.lpad(g, 4, "0")), ""))
    valid = lambda n: F.when(short, (n < 8) & (F.length(m) - F.length(F.replace(m, F.lit("::"), F.lit(""))) == 2) & ~F.contains(m, F.lit(":::"))).otherwise(n == 8)
    new = lambda e, n: F.regexp_replace(replaced_text(digits(e, n), key, "ip6", (HEX_LOWER,)), "(.{4})(?=.)", "$1:")
    return let(ends, lambda e: let(F.size(e["head"]) + F.size(e["tail"]), lambda n: F.when(valid(n), new(e, n)).otherwise(m)))


def _ssn(m: Column, key: str) -> Column:
    shown = lambda s: F.concat_ws("-", F.lpad((F.floor(s["x"] / 99) + F.when(s["x"] >= 665 * 99, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["y"] + 1).cast("string"), 4, "0"))

    def swap(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(k)) for k in range(3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        x = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
        return F.when(valid, let(replaced_pair(x, serial - 1, 898 * 99, 9999, key, "ssn"), shown)).otherwise(m)

    return let(F.transform(F.split(m, "-"), lambda x: x.try_cast("int")), swap)


def _date(m: Column, key: str) -> Column:
    """Year first, day first, or month first where day first is no date. Days of the 400 years from 1700 are 189 * 773."""
    iso = m.rlike(r"^\d{4}")
    form = F.when(iso, "yyyy-MM-dd").when(F.substring(m, 4, 2) > "12", "MM-dd-yyyy").otherwise("dd-MM-yyyy")
    first = F.lit("1700-01-01").cast("date")
    plain = F.regexp_replace(m, r"\D", "-")
    ordered = lambda f: F.when(f == "yyyy-MM-dd", plain).when(f == "MM-dd-yyyy", F.regexp_replace(plain, "(..)-(..)-(....)", "$3-$1-$2")).otherwise(F.regexp_replace(plain, "(..)-(..)-(....)", "$3-$2-$1"))
    day = lambda s: F.date_add(first, (s["x"] * 773 + s["y"]).cast("int"))
    shown = lambda d, f: F.when(f == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(f == "MM-dd-yyyy", F.date_format(d, "MM-dd-yyyy")).otherwise(F.date_format(d, "dd-MM-yyyy"))
    swap = lambda n, f: let(replaced_pair(F.floor(n / 773), n % 773, 189, 773, key, "date"), lambda s: F.replace(let(day(s), lambda d: shown(d, f)), F.lit("-"), F.regexp_extract(m, r"\D", 0)))
    return let(form, lambda f: let(F.datediff(ordered(f).try_cast("date"), first), lambda n: F.when((n >= 0) & (n < 146097), swap(n, f)).otherwise(m)))


def _email(m: Column, key: str) -> Column:
    cased = lambda low, local: F.array_join(F.zip_with(F.split(low, ""), F.split(local, ""), lambda c, was: F.when(was.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    # an address without a letter or digit before the @ has nothing to permute and is not taken as one
    return let(F.substring_index(m, "@", 1), lambda local: F.when(~local.rlike("[A-Za-z0-9]"), m).otherwise(F.concat(cased(replaced_text(F.lower(local), key, "email"), local), F.lit("@"), F.substring_index(m, "@", -1))))


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code are permuted; ten of them as (ddd) ddd-dddd, whatever their separators."""
    dialled = lambda v: v.rlike(r"^\([2-9]..\) [2-9]")
    step = lambda w: permuted_text(w, key, "phone")
    # What can be dialled walks on along the permutation until its pseudonym can be, too; at 64 steps one in 10**12 is left.
    walked = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(64)), v, lambda w, k: F.when((k > 1) & (~dialled(v) | dialled(w)), w).otherwise(step(w)))

    def swap(country: Column) -> Column:
        rest = F.substr(m, F.length(country) + 1, F.length(m))
        shape = F.regexp_replace(F.regexp_replace(rest, "[^0-9]", ""), "^(...)(...)(....)$", "($1) $2-$3")
        return F.concat(country, let(_without_fixed_points(shape, walked, lambda v: _moved(v, (DIGITS,))), lambda n: filled(rest, F.regexp_replace(n, "[^0-9]", ""))))

    return let(F.regexp_extract(m, r"^\+\d{1,3}[ .-]|^\+\d", 0), swap)


def _secret(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, "^(AKIA|gh[pousr]_|sk-)", 0)
    by_class = let(mark, lambda k: F.concat(k, replaced_text(F.substr(m, F.length(k) + 1, F.length(m)), key, "secret")))
    return F.when(m.rlike("^(AKIA|gh[pousr]_|sk-)") | ~m.rlike("[a-fA-F]"), by_class).when(m.rlike("[a-f]"), replaced_text(m, key, "secret", (HEX_LOWER,))).otherwise(replaced_text(m, key, "secret", (HEX_UPPER,)))


REPLACE = {"email": _email, "ip": _ip, "iban": _iban, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "secret": _secret}


def kind_of(m: Column) -> Column:
    """The first format that a whole candidate has."""
    out = F.lit("secret")
    for kind in reversed(list(KINDS)[:-1]):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = value
    for k, f in REPLACE.items():
        out = F.when(kind == k, f(value, key)).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    """The key that the session is configured with; without one a new key, so that pseudonyms are linked in one result only and nobody can invert them."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """A row for each row of docs: `row` (its columns as they were), `text` with pseudonyms, `found` (array of kind, value, pseudonym).

    A null text stays null with nothing found; empty texts and texts without candidates stay as they are; every candidate of a
    text of any length is treated; repeated rows give repeated results, an empty table none. The key is a secret, of the caller or of the
    setting KEY_SETTING; with another key the pseudonyms differ. It comes to the rows from a table of two rows, so that no plan, event log or page of the UI shows
    it. `found` lists validated values only, in order.
    """
    keys = docs.sparkSession.createDataFrame([(blank, key or key_of(docs.sparkSession)) for blank in (False, True)], "blank boolean, key string")
    hinted = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"), F.coalesce(F.col("text").rlike(HINT), F.lit(False)).alias("hint"), F.col("text").isNull().alias("blank")).join(F.broadcast(keys), "blank")
    none = F.array().cast("array<string>")
    key = F.col("key")
    cut = hinted.select("row", "t", "key", F.when(F.col("hint"), F.regexp_extract_all("t", F.lit(ANY), 0)).otherwise(none).alias("values"))
    named = cut.select("row", "t", "key", F.transform("values", lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))).alias("values"))
    replaced = named.select("row", "t", F.transform("values", lambda v: F.struct(v["kind"].alias("kind"), v["value"].alias("value"), pseudonym(v["value"], v["kind"], key).alias("pseudonym"))).alias("values"))
    joined = F.array_join(F.zip_with(F.split("t", ANY, -1), F.col("values"), lambda gap, v: F.concat(gap, F.coalesce(v["pseudonym"], F.lit("")))), "")
    text = F.when(F.size("values") == 0, F.col("t")).otherwise(joined)
    return replaced.select("row", text.alias("text"), F.filter("values", lambda v: v["value"] != v["pseudonym"]).alias("found"))
