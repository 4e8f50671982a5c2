"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Every value found is validated (card numbers by their check digit, dates by the calendar, social
security numbers and addresses by their ranges, account numbers by their check digits) and then
permuted by a keyed Feistel network within its own format: digits stay digits, the layout stays, a
card number gets a right check digit again, a date becomes another date. The permutation depends
on the key and the value only, so equal values stay linked across documents, and who has the key
can go back. Digits that fail the validation of all kinds are no personal value and stay as they are.
The forms that are covered are those of ``PATTERNS``; the README lists what is not. A text of any length and symbols is treated
whole.

All of it is Spark SQL expressions: one split by one pattern, a transform of the pieces found,
and a join of the parts. No row moves.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import table
from shoplight.session import prepare

ROUNDS = 8
# The session's setting that names the key, and the key of a session without one (for tests only).
KEY_SETTING, TEST_KEY = "spark.shoplight.pseudonym.key", "not-a-secret"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR = r"(?:18|19|20|21)\d\d"
# Symbols of an account number, by country. Groups of four need it: the next word of a text could be another group.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}
_IBAN_GROUPS = "|".join(
    rf"(?<=(?:{codes.replace(' ', '|')})\d\d)(?:[ -][A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[ -][A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, codes in IBAN_LENGTHS.items())
# Ten digits as 3-3-4 (with or without a 1 before them), after a + and a country code, and with a leading 0.
_NORTH_AMERICAN = (r"(?:1[ .-])?(?:\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d\d [2-9]\d\d[ -]\d{4})")
_ABROAD = (r"\+(?:1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
           r"|(?=(?:[ .()-]{0,2}\d){7,19}(?!\w))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,5}"
           r"|\d{1,3}[ -]?\(\d{2,4}\)(?:[ -]?\d{2,4}){2,3})")
_LEADING_ZERO = r"(?:0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})|(?:\(0\d{2,4}\)[ -]?|0\d{2,4}[ -])\d{3,4}[ -]?\d{3,4})"
# No loop over a group is without a bound: the regular expression engine goes one call deeper with every turn of it. A domain
# has at most 127 labels, so no address is lost.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}-]++\.){1,126}\p{L}[\p{L}\p{M}]++",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iso_date": rf"(?<![\w-]){_YEAR}-[01]?\d-[0-3]?\d(?![\w-])",
    "slash_date": rf"(?<![\w/])[0-3]?\d/[0-3]?\d/{_YEAR}(?![\w/])",
    "dot_date": rf"(?<![\w.])[0-3]?\d\.[0-3]?\d\.{_YEAR}(?!\w)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": rf"(?:(?<![\w+]){_ABROAD}(?!\w)|(?<![\w.+-])(?:{_NORTH_AMERICAN}|{_LEADING_ZERO})(?!\w|[.-]\d))",
    "iban": rf"(?<!\w)[A-Z]{{2}}\d\d(?:[A-Z0-9]{{11,30}}|{_IBAN_GROUPS})(?!\w)",
    "card": r"(?<![\w-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{28,128}|[0-9A-F]{28,128})(?!\w)",
}
# Symbols stay within their own alphabet.
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸŒ"]
HEX = ["0123456789abcdef"]
# Runs of so many code points that are letters of one script and case are moved by number; other letters by a table.
LONG_RUN, FEW_LETTERS = 500, 10


@lru_cache(maxsize=1)
def other_letters() -> tuple[list[str], list[tuple[int, int]]]:
    """All letters and numbers outside ``LETTERS``: alphabets of a script and a case, and long runs (first, size)."""
    known = set("".join(LETTERS))
    alphabets: dict[tuple[str, str], list[int]] = {}
    for point in range(128, 0x110000):
        category = unicodedata.category(chr(point))
        if category[0] in "LN" and chr(point) not in known:
            script = unicodedata.name(chr(point), "other").split(" ")[0]
            alphabets.setdefault((script, category if category in ("Lu", "Ll", "Nd") else "other"), []).append(point)
    short: dict[tuple[str, str], list[str]] = {}
    runs: list[tuple[int, int]] = []
    for (script, case), points in alphabets.items():
        for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
            some = [point for _, point in run]
            if len(some) >= LONG_RUN:
                runs.append((some[0], len(some)))
            else:
                short.setdefault((script if len(points) >= FEW_LETTERS else "few", case), []).extend(map(chr, some))
    return ["".join(v) for v in short.values()], sorted(runs)


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _moved_letter(c: Column, move: Column) -> Column:
    """A letter of any script, moved within its script and case. Other symbols stay."""
    short, runs = other_letters()
    every, sizes = F.lit("".join(short)), [len(x) for x in short]
    starts = _numbers([1, *(1 + n for n in accumulate(sizes))])
    lows, counts = _numbers([low for low, _ in runs]), _numbers([n for _, n in runs])

    def by_table(place: Column) -> Column:
        number = F.size(F.filter(starts, lambda s: s <= place))
        first, size = F.element_at(starts, number), F.element_at(starts, number + 1) - F.element_at(starts, number)
        return F.substring(every, (first + (place - first + move) % size).cast("int"), F.lit(1))

    def by_number(point: Column) -> Column:
        number = F.size(F.filter(lows, lambda low: low <= point))
        low, size = F.element_at(lows, number), F.element_at(counts, number)
        moved = F.decode(F.unhex(F.lpad(F.hex(low + (point - low + move) % size), 8, "0")), "UTF-32")
        return F.when((number > 0) & (point < low + size), moved).otherwise(c)

    return F.when(c.rlike(r"[^\p{L}\p{N}]"), c).otherwise(let(F.instr(every, c), lambda place: F.when(
        place > 0, by_table(place)).otherwise(let(F.ascii(c), by_number))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _shifted(half: Column, other: Column, turn: Column, key: str, alphabets: list[str], any_letter: bool) -> Column:
    """``half`` with each symbol moved along its alphabet by a hash of the other half."""
    every = "".join(alphabets)

    def symbol(c: Column, move: Column) -> Column:
        place = F.instr(F.lit(every), c)  # from 1; 0 if in no alphabet
        moved, first = c, 1
        choice = None
        for letters in alphabets:
            inside = place.between(first, first + len(letters) - 1) & (F.length(c) == 1)
            moved = F.substring(F.lit(every), (F.lit(first) + (place - first + move) % len(letters)).cast("int"), F.lit(1))
            choice = F.when(inside, moved) if choice is None else choice.when(inside, moved)
            first += len(letters)
        return choice.otherwise(F.when(c != "", _moved_letter(c, move)).otherwise(c) if any_letter else c)

    def with_stream(stream: Column) -> Column:
        return F.array_join(F.transform(
            F.split(half, ""),
            lambda c, i: symbol(c, _number(F.substring(stream, (i % 32 * 4 + 1).cast("int"), F.lit(4))))), "")

    return let(F.sha2(F.concat_ws("|", F.lit(key), turn, other), 512), with_stream)


def permuted_symbols(value: Column, key: str, alphabets: list[str] = LETTERS, any_letter: bool = False) -> Column:
    """A keyed permutation of the texts with this layout: an alternating Feistel network on the two halves.

    Symbols outside the alphabets stay; with ``any_letter`` letters of all other scripts are moved as well.
    """
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, turn: F.struct(s["b"].alias("a"), _shifted(s["a"], s["b"], turn, key, alphabets, any_letter).alias("b")),
        lambda s: F.concat(s["a"], s["b"]))


def permuted_number(value: Column, left: int, right: int, key: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: a Feistel network on quotient and remainder."""
    start = F.struct(F.floor(value / right).cast("long").alias("x"), (value % right).cast("long").alias("y"))

    def hashed(turn: Column, other: Column) -> Column:
        return _number(F.substring(F.md5(F.concat_ws("|", F.lit(key), turn, other)), 1, 15))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, turn: F.when(turn % 2 == 1, F.struct(((s["x"] + hashed(turn, s["y"])) % left).alias("x"), s["y"].alias("y")))
        .otherwise(F.struct(s["x"].alias("x"), ((s["y"] + hashed(turn, s["x"])) % right).alias("y"))),
        lambda s: s["x"] * right + s["y"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _laid_out(symbols: Column, like: Column, kind: str = "[0-9]") -> Column:
    """``symbols`` in the places of the digits of ``like``, or of its symbols of another kind."""
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike(f"^{kind}$"), F.substring(symbols, F.length(
        F.regexp_replace(F.substring(like, F.lit(1), i + 1), f"[^{kind[1:]}", "")), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    """The sum of the card check rule over digits that still lack their check digit."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
            i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda total, d: total + d)


def _check_digit(body: Column) -> Column:
    return ((10 - _luhn_sum(body) % 10) % 10).cast("string")


def _card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = F.concat(body, _check_digit(body)) == digits
        return F.when(valid, let(permuted_symbols(body, f"{key}card"),
                                 lambda p: _laid_out(F.concat(p, _check_digit(p)), value)))

    return let(_digits(value), of)


def _mod97(text: Column) -> Column:
    """Of an account number whose first four symbols were moved to the end."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda m, c: F.when(
        c.rlike("^[0-9]$"), (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97))


def _iban(value: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = _mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1
        return F.when(valid, let(permuted_symbols(rest, f"{key}iban"), lambda p: _laid_out(F.concat(
            country, F.lpad((98 - _mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p), value, "[A-Z0-9]")))

    return let(F.regexp_replace(value, "[ -]", ""), of)


def _moved_day(day: Column, key: str) -> Column:
    """Any day of the 400 years from 1800 becomes another: 146,097 days, 189 times 773."""
    first = F.to_date(F.lit("1800-01-01"))
    return F.date_add(first, permuted_number(F.datediff(day, first), 189, 773, f"{key}date").cast("int"))


def _date(value: Column, layout: str, key: str) -> Column:
    """``layout`` has the day before the month; days and months may lack their zeros.

    What is no date so is read with the month first. Such a day is above 12, and is moved until it is so again: a result
    that could be read both ways always has the day first.
    """
    zeros = ~value.rlike(r"(?<!\d)\d(?!\d)")

    def written(day: Column, layout: str) -> Column:
        return F.when(zeros, F.date_format(day, layout.replace("d", "dd").replace("M", "MM"))).otherwise(F.date_format(day, layout))

    def month_first() -> Column:
        other = layout.translate(str.maketrans("dM", "Md"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.try_to_date(value, other), lambda day, turn: F.when(
            (turn > 1) & (F.dayofmonth(day) > 12), day).otherwise(_moved_day(day, key)))
        return written(walked, other)

    made = written(_moved_day(F.try_to_date(value, layout), key), layout)
    return made if layout.startswith("y") else F.coalesce(made, month_first())


def _ssn(value: Column, key: str) -> Column:
    """898 areas, 99 groups and 9,999 serials are valid."""
    area = F.substring(value, 1, 3).cast("long")
    index = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + F.substring(value, 5, 2).cast("long") - 1

    def of(n: Column) -> Column:
        place = F.floor(n / 9999)
        new = F.floor(place / 99) + 1
        return F.concat_ws("-", F.lpad((new + F.when(new > 665, 1).otherwise(0)).cast("string"), 3, "0"),
                           F.lpad((place % 99 + 1).cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0"))

    return let(permuted_number(index * 9999 + F.substring(value, 8, 4).cast("long") - 1, 898 * 99, 9999, f"{key}ssn"), of)


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda n, octet: n * 256 + octet.cast("long"))
    return let(permuted_number(number, 65536, 65536, f"{key}ip"), lambda n: F.concat_ws(
        ".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def _phone(value: Column, key: str) -> Column:
    """The country code stays, and the 0 or 1 that stands for none."""
    ten = r"^(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}$"
    code = F.when(value.rlike(ten), "").otherwise(F.regexp_extract(value, r"^\+\d{1,3}?(?=[ (.-])|^\+\d|^1(?=[ .-])|^\(?0", 0))
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _laid_out(permuted_symbols(_digits(rest), f"{key}phone"), rest))


def _email(value: Column, key: str) -> Column:
    """The name before the @ is permuted; the domain stays."""
    name = F.substring_index(value, "@", 1)
    return F.concat(permuted_symbols(name, f"{key}email", any_letter=True), F.substring(value, F.length(name) + 1, F.length(value)))


def _secret(value: Column, key: str) -> Column:
    low = F.lower(value)
    return let(permuted_symbols(low, f"{key}secret", HEX), lambda p: F.when(value == low, p).otherwise(F.upper(p)))


def pseudonym(value: Column, key: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """The pseudonym of one value that a pattern found, as the first kind whose validation it passes.

    An account number that fails it may hold another value, such as a card; any other value stays then.
    """
    made = {
        "email": _email, "ip": _ip, "iso_date": lambda v, k: _date(v, "yyyy-M-d", k), "slash_date": lambda v, k: _date(v, "d/M/yyyy", k),
        "dot_date": lambda v, k: _date(v, "d.M.yyyy", k), "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card, "secret": _secret,
    }
    choices = [F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), made[kind](value, key)) for kind in kinds]
    if "iban" in kinds:
        choices.append(F.when(value.rlike("^[A-Z]{2}.*[ -]"), replaced(value, key, ("ssn", "phone", "card"))))
    return F.coalesce(*choices, value)


def replaced(text: Column, key: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """``text`` with every value of these kinds replaced."""
    pattern = "|".join(PATTERNS[kind] for kind in kinds)
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    made = F.zip_with(parts, F.transform(found, lambda v: pseudonym(v, key, kinds)),
                      lambda part, value: F.concat(part, F.coalesce(value, F.lit(""))))
    return F.array_join(made, "")


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with every personal value replaced. Null stays null; texts without a digit or an @ are not searched."""
    return F.when(text.rlike("[0-9@]|[A-Fa-f]{28}"), replaced(text, key)).otherwise(text)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal values of the column ``text`` replaced; all other columns and the row count stay.

    Null and empty texts stay as they are, equal rows stay equal, an empty table stays empty, and
    a text of any length is treated whole.
    """
    if not key:
        raise ValueError("the key is empty")
    return docs.withColumn(text, pseudonymised(F.col(text).cast("string"), key))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the whole pseudonymised text of every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark))
