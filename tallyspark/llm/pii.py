"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Found by pattern and then validated: card numbers (Luhn), IBANs (mod 97), social security
numbers (numbering rules), IPv4 addresses and calendar dates; also phone numbers of any area code, the local part of
e-mail addresses, access keys and secrets. Each value is permuted within its own format under the key, so equal values stay equal across
documents, other values stay apart, and the key's owner can turn them back. What does not validate stays. The caller
gives the key; there is no default.

Two networks do the work. Over strings, one half's letters and digits shift, within their kind, by a stream from
SHA-256 of the key and the other half. Over pairs of numbers, the halves are added modulo their ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

# The patterns of each kind (no capturing groups inside), in order of precedence. None starts inside a word.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-])",
    "access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?:(?i:password|passwd|secret|token|api_key|apikey))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-+/]{12,128}[\"']?",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w/-])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "card": r"[3-6][0-9]{3}(?:[ -]?[0-9]){9,15}(?![\w-])",
}
ANY = r"(?<![\w.+%-])(?:" + "|".join(PATTERNS.values()) + ")"
#: Every pattern needs one of these; most texts of prose have none.
HINT = "[0-9@=:]|AKIA|ASIA"


def _shift(part: Column, stream: Column, back: bool) -> Column:
    """Letters and digits of the part moved along their alphabets by bytes of the hexadecimal stream."""

    def one(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(stream, (j % 32) * 2 + 1, 2), 16, 10).cast("int")
        code = F.ascii(c)
        move = lambda low, n: F.chr(low + F.pmod(code - low + (-by if back else by), F.lit(n)))
        return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def permute_text(value: Column, key: str, kind: str, back: bool = False) -> Column:
    """A permutation of the strings with the same pattern of digits, small and capital letters."""
    half = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        def stream(other: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.length(value).cast("string"), other), 256)

        if back:
            return F.struct(_shift(s["b"], stream(s["a"]), True).alias("a"), s["a"].alias("b"))
        return F.struct(s["b"].alias("a"), _shift(s["a"], stream(s["b"]), False).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, state, step, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(x: Column, y: Column, m: Column | int, n: Column | int, key: str, kind: str, back: bool = False, rounds: int = ROUNDS) -> Column:
    """A permutation of the pairs with 0 <= x < m and 0 <= y < n, as a struct (x, y)."""
    m, n = (F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in (m, n))

    def f(r: Column, side: str, other: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind + side), r.cast("string"), other.cast("string")), 256), 1, 14), 16, 10).cast("bigint")

    def step(s: Column, r: Column) -> Column:
        if back:
            yy = F.pmod(s["y"] - F.pmod(f(r, "y", s["x"]), n), n)
            return F.struct(F.pmod(s["x"] - F.pmod(f(r, "x", yy), m), m).alias("x"), yy.alias("y"))
        xx = F.pmod(s["x"] + F.pmod(f(r, "x", s["y"]), m), m)
        return F.struct(xx.alias("x"), F.pmod(s["y"] + F.pmod(f(r, "y", xx), n), n).alias("y"))

    turns = F.sequence(F.lit(rounds // 2), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(rounds // 2))
    return F.aggregate(turns, F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), step)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a string of digits, the last one being the check digit."""
    place = F.transform(F.split(F.reverse(d), ""), lambda c, j: F.struct(c.cast("int").alias("d"), j.alias("j")))
    twice = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(place, F.lit(0), lambda t, p: t + F.when(p["j"] % 2 == 1, twice(p["d"])).otherwise(p["d"]))


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN: four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _refill(shape: Column, new: Column, kind: str = "[0-9]") -> Column:
    """The characters of ``new`` in the places of the characters of ``shape`` that are of the kind."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    put = lambda s, c: F.when(c.rlike(kind), F.struct(F.concat(s["out"], F.substring(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("bigint"), F.lit(0))


def _pad(v: Column, n: int) -> Column:
    return F.lpad(v.cast("string"), n, "0")


def _card(v: Column, key: str, back: bool) -> Column:
    d = digits(v)
    n = F.length(d)
    body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), n - 2), key, "card", back))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when((n >= 13) & (n <= 19) & (luhn_sum(d) % 10 == 0), _refill(v, F.concat(body, check)))


def _iban(v: Column, key: str, back: bool) -> Column:
    def made(shape: Column) -> Column:
        d = F.replace(shape, F.lit(" "))
        body = permute_text(F.substring(d, F.lit(5), F.length(d)), key, "iban", back)
        check = F.lit(98) - mod97(F.concat(F.substring(d, 1, 2), F.lit("00"), body))
        new = _refill(shape, F.concat(F.substring(d, 1, 2), _pad(check, 2), body), "[A-Z0-9]")
        return F.when(F.length(d).between(15, 34) & (mod97(d) == 1), new)

    # Printed in groups, the last one may be a word after the number.
    tail = F.regexp_extract(v, " [A-Z0-9]{1,4}$", 0)
    return F.coalesce(made(v), F.when(tail != "", F.concat(made(F.substring(v, F.lit(1), F.length(v) - F.length(tail))), tail)))


def _ssn(v: Column, key: str, back: bool) -> Column:
    area, group, serial = (_number(F.substring(v, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    new = permute_pair(at, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", back)
    out = F.transform(F.array(new), lambda p: F.concat_ws("-", _pad(p["x"] + 1 + F.when(p["x"] + 1 >= 666, 1).otherwise(0), 3), _pad(F.floor(p["y"] / 9999) + 1, 2), _pad(p["y"] % 9999 + 1, 4)))
    return F.when(good, out[0])


def _phone(v: Column, key: str, back: bool) -> Column:
    d = digits(v)
    d = F.substring(d, F.length(d) - 9, F.lit(10))
    area, rest = _number(F.substring(d, 1, 3)), _number(F.substring(d, 4, 7))
    # Areas from 200 up, which the numbering plan allows, and those below stay apart.
    low = F.when(area >= 200, 200).otherwise(0)
    new = permute_pair((area - low) * 1000 + F.floor(rest / 10000), rest % 10000, F.when(area >= 200, 800_000).otherwise(200_000), 10_000, key, "phone", back)
    ten = F.transform(F.array(new), lambda p: F.concat(_pad(F.floor(p["x"] / 1000) + low, 3), _pad(p["x"] % 1000, 3), _pad(p["y"], 4)))[0]
    lead = F.when(v.startswith("+1"), F.lit("1")).otherwise(F.lit(""))
    return _refill(v, F.concat(lead, ten))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ipv4(v: Column, key: str, back: bool) -> Column:
    o = F.transform(F.split(v, r"\."), _number)
    new = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4", back)
    out = F.transform(F.array(new), lambda p: F.concat_ws(".", *[F.floor(x / 256).cast("string") if k == 0 else (x % 256).cast("string") for x in (p["x"], p["y"]) for k in (0, 1)]))
    return F.when(v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), out[0])  # no leading zeros


# Dates from 1900-01-01 to 2099-12-31: 73,049 days, 17 x 4,297; so uneven halves take more rounds.
_EPOCH, _DAYS, _HALVES = "1900-01-01", 73_049, (17, 4297)


def _date(v: Column, key: str, back: bool) -> Column:
    def pair(x: Column, y: Column, m: int, n: int, kind: str) -> Column:
        return permute_pair(x, y, m, n, key, "date" + kind, back, 2 * ROUNDS)

    def of(fmt: str) -> Column:
        k = F.datediff(F.try_to_timestamp(v, F.lit(fmt)).cast("date"), F.lit(_EPOCH).cast("date"))
        new = pair(F.floor(k / _HALVES[1]), k % _HALVES[1], *_HALVES, "")
        out = F.transform(F.array(new), lambda p: F.date_format(F.date_add(F.lit(_EPOCH).cast("date"), (p["x"] * _HALVES[1] + p["y"]).cast("int")), fmt))[0]
        return F.when(k.between(0, _DAYS - 1), out)

    # Day first with slashes: only a day above 12 tells it from month first, so such days stay above 12. Days 13 to 28
    # of 2,400 months are one rectangle; later days keep day and month and change the year, 29 February to leap years.
    day, month, year = (_number(F.substring(v, a, n)) for a, n in ((1, 2), (4, 2), (7, 4)))
    since = year - 1900
    slashes = lambda d, m, y: F.concat_ws("/", _pad(d, 2), _pad(m, 2), _pad(y, 4))
    mid = F.transform(F.array(pair(since * 12 + month - 1, day - 13, 2400, 16, "mid")), lambda p: slashes(p["y"] + 13, p["x"] % 12 + 1, F.floor(p["x"] / 12) + 1900))[0]
    leap = F.transform(F.array(pair(F.floor((since - 4) / 28), F.floor((since - 4) / 4) % 7, 7, 7, "leap")), lambda p: slashes(day, month, (p["x"] * 7 + p["y"]) * 4 + 1904))[0]
    late = F.transform(F.array(pair(F.floor(since / 10), since % 10, 20, 10, "late")), lambda p: slashes(day, month, p["x"] * 10 + p["y"] + 1900))[0]
    day_first = F.when(F.try_to_timestamp(v, F.lit("dd/MM/yyyy")).isNotNull() & since.between(0, 199) & (day > 12), F.when(day <= 28, mid).when(month == 2, leap).otherwise(late))
    return F.when(v.rlike("^[0-9]{4}-"), of("yyyy-MM-dd")).when(v.contains("/"), F.coalesce(of("MM/dd/yyyy"), day_first)).otherwise(of("dd.MM.yyyy"))


def _email(v: Column, key: str, back: bool) -> Column:
    at = F.instr(v, "@")
    return F.concat(permute_text(F.substring(v, F.lit(1), at - 1), key, "email", back), F.substring(v, at, F.length(v)))


def _access_key(v: Column, key: str, back: bool) -> Column:
    return F.concat(F.substring(v, 1, 4), permute_text(F.substring(v, 5, 16), key, "access_key", back))


def _secret(v: Column, key: str, back: bool) -> Column:
    lead = F.regexp_extract(v, r"(?i)^[a-z_]+\s*[=:]\s*[\"']?", 0)
    tail = F.regexp_extract(v, r"[\"']?$", 0)
    body = F.substring(v, F.length(lead) + 1, F.length(v) - F.length(lead) - F.length(tail))
    return F.concat(lead, permute_text(body, key, "secret", back), tail)


_MAKERS: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "access_key": _access_key, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value, or null if it does not validate."""
    out = None
    for kind, make in _MAKERS.items():
        is_kind = value.rlike("^(?:" + PATTERNS[kind] + ")$")
        made = make(value, key, back)
        out = F.when(is_kind, made) if out is None else out.when(is_kind, made)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False, count_col: str = "n_replaced") -> DataFrame:
    """All columns, with the text's private values replaced in place, plus ``count_col``.

    A narrow, native projection without shuffle: rows that repeat an id or a text are rows like any others, equal
    values get equal pseudonyms in all of them, and whole texts are read however long. A null text stays null with
    count 0; a text without private values stays as it is. ``back=True`` turns pseudonyms back under the same key. An
    input column named like the count is replaced; any other name may occur.
    """
    text = F.col(f"`{text_col}`")
    mark = "_" * max(map(len, docs.columns))  # names longer than any column's
    found, new = f"found{mark}", f"new{mark}"
    df = docs.withColumn(found, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    df = df.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key, back))))
    pieces = F.split(text, ANY, -1)
    put = F.transform(F.arrays_zip(F.col(found).alias("old"), F.col(new).alias("new")), lambda p: F.coalesce(p["new"], p["old"]))
    rebuilt = F.array_join(F.zip_with(pieces, F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    count = F.coalesce(F.size(F.filter(new, lambda v: v.isNotNull())), F.lit(0)).cast("bigint")
    count = F.when(F.col(new).isNull(), F.lit(0).cast("bigint")).otherwise(count)
    return df.withColumn(text_col, F.when(F.col(new).isNull(), text).otherwise(rebuilt)).withColumn(count_col, count).drop(found, new)
