"""Format-preserving pseudonyms for personal numbers and dates, by Feistel networks.

Found values are validated, then permuted with a key inside their own format: a card number
becomes another card number with the same separators and a right check digit, a date another
date. The permutation is a function of the key and the value alone: separators are taken out
before and put back after it, so equal values stay equal in all documents and layouts, and
whoever holds the key can undo it (``restore``). There is no default key.

A value is a vector of digits, each modulo its own radix. Every round adds to the digits at
even places a keyed hash of those at odd places, or the other way round, so each round can
be subtracted again. Kinds, formats and checks:

    card    13 to 19 digits, plain, by fours or 4-6-5         Luhn; check digit recomputed
    iban    two letters, two check digits, 11 to 30 more,     mod 97; check digits recomputed
            plain or in groups of four
    ssn     ddd-dd-dddd                                       no 000/666/9dd, 00, 0000; kept so
    phone   + country code and digits, (ddd) ddd-dddd or      8 to 15 digits; country code kept
            ddd-ddd-dddd
    ip      four decimal octets                               each up to 255
    date    yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy,   in the calendar, years 1800-2199
            dd/mm/yyyy from day 13 on
    email   local part @ domain                               letters and digits; last label kept
    secret  32 or more hexadecimal digits of one case         digits and letters both occur

A date with slashes whose first number exceeds 12 is day-first. It is permuted until its day
exceeds 12 again, as it could not be read back otherwise; where one step does not do, it is
not linked to the same date in another layout.

Values that fail their check stay as they are, as does all other text. A null text stays
null. Equal rows get equal results; no column but the text is looked at. Everything is done by
column functions, row by row: no shuffle, no Python. Patterns begin at a border and give nothing
back, so a word of a million characters is looked through once.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the key of a session is read from.
KEY_SETTING = "spark.footfall.pseudonymKey"
ROUNDS = 8
# Steps until the day of a date exceeds 12; each fails two times in five.
WALK = 128
# Country codes of two digits (fixed values); those that begin with 1 or 7 have one digit,
# all others three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58"
    " 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
SEPARATORS = " -.()"
# 400 Gregorian years from 1800-01-01 have 146,097 = 189 * 773 days.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773
HEX = "0123456789abcdef"
# Digits of the keyed hash (SHA-512 in hexadecimal) used for one place: 65,536 values, so a
# radix must stay well below that.
HASH_STEP, HASH_PLACES = 4, 32

_NOT_IN_WORD = r"(?<![A-Za-z0-9])"
_END = r"(?![A-Za-z0-9])"
_DATE = (
    r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d])"
)
# The local part is taken whole, from a border on; a domain has at most 127 labels.
_LOCAL = r"[A-Za-z0-9._%+\-]"
_EMAIL = (
    rf"(?<!{_LOCAL})(?=[._%+\-]*+[A-Za-z0-9]){_LOCAL}++"
    r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,125}\.[A-Za-z]{2,}"
)
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_PHONE = r"\+[1-9]\d{0,2}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
_LOCAL_PHONE = r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
_BARE_PHONE = r"(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
_SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
_CARD_GROUPS = r"(?<!\d)(?:\d{4}-){3}\d{1,7}(?!\d)|(?<!\d)(?:\d{4} ){3}\d{1,7}(?!\d)"
_CARD_GROUPS += r"|(?<!\d)\d{4}-\d{6}-\d{5}(?!\d)|(?<!\d)\d{4} \d{6} \d{5}(?!\d)"
_CARD = r"(?<!\d)\d{13,19}(?!\d)"
# of the groups only the first may lack a digit: what follows may be a word
_IBAN_GROUPS = r"[A-Z]{2}\d{2} [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}"
_IBAN_GROUPS += r"(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?"
_IBAN = _NOT_IN_WORD + r"(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + _IBAN_GROUPS + ")" + _END
_SECRET = _NOT_IN_WORD + r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _END
PATTERN = "|".join(
    [_EMAIL, _SECRET, _IBAN, _IP, r"(?<!\d)" + _DATE, _SSN, _PHONE, _LOCAL_PHONE, _BARE_PHONE, _CARD_GROUPS, _CARD]
)

_INTS = "array<int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _permute(values: Column, radices: Column, key: str, tweak: str, undo: bool) -> Column:
    """Feistel rounds over a vector of digits, each modulo its radix."""

    def one_round(state: Column, number: Column) -> Column:
        def stays(_, place):
            return place % 2 != number % 2

        other = F.array_join(F.filter(state, stays).cast("array<string>"), ",")
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), number.cast("string"), other)

        def add(hashed: Column) -> Column:
            def digit(value, place):
                begin = (F.floor(place / 2) % HASH_PLACES * HASH_STEP + 1).cast("int")
                part = F.conv(F.substring(hashed, begin, F.lit(HASH_STEP)), 16, 10).cast("int")
                moved = value - part if undo else value + part
                radix = F.element_at(radices, place + 1)
                return F.when(place % 2 == number % 2, F.pmod(moved, radix)).otherwise(value)

            return F.transform(state, digit)

        return _let(F.sha2(seed, 512), add)

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, order)), values, one_round)


def _permute_text(
    text: Column, radix_of: Callable[[Column, Column], Column], key: str, tweak: str, undo: bool
) -> Column:
    """Permute digits and letters within their class; ``radix_of`` (character, place from 0)
    gives 10, 26 or 16, and 1 for what is kept."""

    def with_chars(chars: Column) -> Column:
        radices = F.transform(chars, radix_of)

        def with_radices(radices: Column) -> Column:
            def base(char, radix):
                return (
                    F.when(radix == 1, F.ascii(char))
                    .when(char.between("0", "9"), 48)
                    .when(char.between("a", "z"), 97)
                    .otherwise(65)
                )

            def value(char, radix):
                hexadecimal = F.instr(F.lit(HEX), F.lower(char)) - 1
                return F.when(radix == 16, hexadecimal).otherwise(F.ascii(char) - base(char, radix))

            values = F.zip_with(chars, radices, value).cast(_INTS)
            moved = _permute(values, radices, key, tweak, undo)
            upper = F.upper(text) == text

            def back(value, place):
                char, radix = F.element_at(chars, place + 1), F.element_at(radices, place + 1)
                digit = F.substring(F.lit(HEX), value + 1, F.lit(1))
                return (
                    F.when(radix == 1, char)
                    .when(radix == 16, F.when(upper, F.upper(digit)).otherwise(digit))
                    .otherwise(F.char(value + base(char, radix)))
                )

            return F.array_join(F.transform(moved, back), "")

        return _let(radices, with_radices)

    return _let(F.split(text, ""), with_chars)


def _is_digit(char: Column) -> Column:
    return char.between("0", "9")


def _class_radix(char: Column) -> Column:
    return (
        F.when(_is_digit(char), 10)
        .when(char.between("a", "z") | char.between("A", "Z"), 26)
        .otherwise(1)
    )


def _digits(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\D", ""), "").cast(_INTS)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of digits that include a check digit."""

    def weighed(digit, place):
        doubled = digit * 2
        return F.when(place % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(
            digit
        )

    return F.aggregate(F.transform(F.reverse(digits), weighed), F.lit(0), lambda a, x: a + x) % 10


def _without_separators(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \-.()]", "")


def _with_separators(text: Column, permuted: Callable[[Column], Column]) -> Column:
    """``text`` with its digits and letters permuted as if there were no separators."""

    def put_back(moved: Column) -> Column:
        def at(char, place):
            ahead = F.length(_without_separators(F.substring(text, F.lit(1), place)))
            own = F.substring(moved, ahead + 1, F.lit(1))
            return F.when(char.isin(*SEPARATORS), char).otherwise(own)

        return F.array_join(F.transform(F.split(text, ""), at), "")

    return _let(_let(_without_separators(text), permuted), put_back)


def _card(text: Column, key: str, undo: bool) -> Column:
    return _with_separators(text, lambda plain: _plain_card(plain, key, undo))


def _plain_card(text: Column, key: str, undo: bool) -> Column:
    last = F.length(text) - 1

    def radix(char, place):
        return F.when(_is_digit(char) & (place < last), 10).otherwise(1)

    moved = _permute_text(text, radix, key, "card", undo)

    def checked(moved):
        body = moved.substr(F.lit(1), last)
        check = (10 - _luhn(_digits(F.concat(body, F.lit("0"))))) % 10
        return F.concat(body, check.cast("string"))

    valid = F.length(text).between(13, 19) & (_luhn(_digits(text)) == 0)
    return F.when(valid, _let(moved, checked)).otherwise(text)


def _mod_97(text: Column) -> Column:
    """Remainder of an IBAN, rearranged and with letters as two-digit numbers."""

    def add(total, char):
        letter = F.ascii(char) - 55
        return F.when(_is_digit(char), total * 10 + F.ascii(char) - 48).otherwise(
            total * 100 + letter
        ) % 97

    turned = F.concat(text.substr(F.lit(5), F.length(text)), text.substr(1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _iban(text: Column, key: str, undo: bool) -> Column:
    return _with_separators(text, lambda plain: _plain_iban(plain, key, undo))


def _plain_iban(text: Column, key: str, undo: bool) -> Column:
    def radix(char, place):
        return F.when(place >= 4, _class_radix(char)).otherwise(1)

    def checked(moved):
        country, body = moved.substr(1, 2), moved.substr(F.lit(5), F.length(moved))
        check = F.lit(98) - _mod_97(F.concat(country, F.lit("00"), body))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    moved = _permute_text(text, radix, key, "iban", undo)
    return F.when(_mod_97(text) == 1, _let(moved, checked)).otherwise(text)


def _ssn(text: Column, key: str, undo: bool) -> Column:
    area = text.substr(1, 3).cast("int")
    group, serial = text.substr(5, 2).cast("int"), text.substr(8, 4).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    values = F.array(place, group - 1, serial - 1)
    moved = _permute(values, F.array(*map(F.lit, (898, 99, 9999))), key, "ssn", undo)

    def written(moved):
        first = F.element_at(moved, 1)
        new_area = first + F.when(first >= 665, 2).otherwise(1)
        return F.concat_ws(
            "-",
            F.lpad(new_area.cast("string"), 3, "0"),
            F.lpad((F.element_at(moved, 2) + 1).cast("string"), 2, "0"),
            F.lpad((F.element_at(moved, 3) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, _let(moved, written)).otherwise(text)


def _phone(text: Column, key: str, undo: bool) -> Column:
    return _with_separators(text, lambda plain: _plain_phone(plain, key, undo))


def _plain_phone(text: Column, key: str, undo: bool) -> Column:
    """The digits behind the country code, which are the same with and without it."""
    code = (
        F.when(F.substring(text, 2, 1).isin("1", "7"), 1)
        .when(F.substring(text, 2, 2).isin(*TWO_DIGIT_CODES), 2)
        .otherwise(3)
    )
    kept = F.when(text.startswith("+"), code + 1).otherwise(0)
    own = text.substr(kept + 1, F.length(text))
    moved = _permute_text(own, lambda char, place: F.lit(10), key, "phone", undo)
    size = F.length(F.regexp_replace(text, r"\D", ""))
    hidden = F.concat(text.substr(F.lit(1), kept), moved)
    return F.when(size.between(8, 15), hidden).otherwise(text)


def _ip(text: Column, key: str, undo: bool) -> Column:
    octets = F.split(text, r"\.").cast(_INTS)
    # a leading zero would be lost and with it the way back
    valid = F.forall(octets, lambda o: o < 256) & (
        F.array_join(octets.cast("array<string>"), ".") == text
    )
    moved = _permute(octets, F.array(*[F.lit(256)] * 4), key, "ip", undo)
    return F.when(valid, F.array_join(moved.cast("array<string>"), ".")).otherwise(text)


def _date(text: Column, key: str, undo: bool) -> Column:
    layout = (
        F.when(text.rlike(r"^\d{4}-"), "yyyy-MM-dd")
        .when(text.rlike(r"^\d{4}/"), "yyyy/MM/dd")
        .when(text.rlike(r"^\d{2}\."), "dd.MM.yyyy")
        .when(text.rlike(r"^(?:1[3-9]|2\d|3[01])/"), "dd/MM/yyyy")
        .otherwise("MM/dd/yyyy")
    )
    # written in one layout, so that parsing and formatting need a constant pattern only
    iso = (
        F.when(text.rlike(r"^\d{4}"), F.regexp_replace(text, "/", "-"))
        .when(
            layout.isin("dd.MM.yyyy", "dd/MM/yyyy"),
            F.concat_ws("-", text.substr(7, 4), text.substr(4, 2), text.substr(1, 2)),
        )
        .otherwise(F.concat_ws("-", text.substr(7, 4), text.substr(1, 2), text.substr(4, 2)))
    )
    day = iso.try_cast("date")
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    values = F.array(F.floor(number / DAYS_LOW).cast("int"), F.pmod(number, F.lit(DAYS_LOW)))

    def step(values):
        return _permute(values, F.array(F.lit(DAYS_HIGH), F.lit(DAYS_LOW)), key, "date", undo)

    def date_of(values):
        days = F.element_at(values, 1) * DAYS_LOW + F.element_at(values, 2)
        return F.date_add(F.lit(FIRST_DAY).cast("date"), days)

    def until_late(state, _):
        return F.when(F.dayofmonth(date_of(state)) > 12, state).otherwise(step(state))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(values), until_late)
    moved = F.when(layout == "dd/MM/yyyy", walked).otherwise(step(values))

    def written(moved):
        new = date_of(moved).cast("string")
        y, m, d = new.substr(1, 4), new.substr(6, 2), new.substr(9, 2)
        return (
            F.when(layout == "yyyy-MM-dd", new)
            .when(layout == "yyyy/MM/dd", F.concat_ws("/", y, m, d))
            .when(layout == "dd.MM.yyyy", F.concat_ws(".", d, m, y))
            .when(layout == "dd/MM/yyyy", F.concat_ws("/", d, m, y))
            .otherwise(F.concat_ws("/", m, d, y))
        )

    known = number.between(0, DAYS_HIGH * DAYS_LOW - 1)
    return F.when(F.coalesce(known, F.lit(False)), _let(moved, written)).otherwise(text)


def _email(text: Column, key: str, undo: bool) -> Column:
    last_label = F.length(text) - F.length(F.regexp_extract(text, r"\.[A-Za-z]+$", 0))

    def radix(char, place):
        return F.when(place < last_label, _class_radix(char)).otherwise(1)

    return _permute_text(text, radix, key, "email", undo)


def _secret(text: Column, key: str, undo: bool) -> Column:
    mixed = text.rlike("[0-9]") & text.rlike("[A-Fa-f]")
    hidden = _permute_text(text, lambda char, place: F.lit(16), key, "secret", undo)
    return F.when(mixed, hidden).otherwise(text)


def _pseudonym(found: Column, key: str, undo: bool) -> Column:
    """The replacement of one match; the kind follows from its form."""

    def whole(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    return (
        F.when(found.contains("@"), _email(found, key, undo))
        .when(found.startswith("+") | found.startswith("("), _phone(found, key, undo))
        .when(whole(_IP), _ip(found, key, undo))
        .when(whole(_DATE), _date(found, key, undo))
        .when(whole(_SSN), _ssn(found, key, undo))
        .when(whole(_BARE_PHONE), _phone(found, key, undo))
        .when(whole(r"[\d \-]+") & (F.length(found) <= 23), _card(found, key, undo))
        .when(whole(r"[0-9a-f]+|[0-9A-F]+") & (F.length(found) >= 32), _secret(found, key, undo))
        .otherwise(_iban(found, key, undo))
    )


def _replaced(text: Column, key: str, undo: bool) -> Column:
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(text, PATTERN, -1)
    new = F.transform(matches, lambda m: _pseudonym(m, key, undo))
    pieces = F.zip_with(between, new, lambda gap, name: F.concat(gap, F.coalesce(name, F.lit(""))))
    # every form has a digit or an @; most texts have neither and cost one quick look
    found = text.rlike("[0-9@]") & text.rlike(PATTERN)
    return F.when(found, F.array_join(pieces, "")).otherwise(text)


def session_key(spark: SparkSession) -> str:
    """The key in the settings of the session; without one, a random one for the session.

    With a random key values are linked within the session, and nobody can undo them later.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymize(text: Column, key: str) -> Column:
    """The text with every validated value replaced by its pseudonym."""
    return _replaced(text, key, undo=False)


def restore(text: Column, key: str) -> Column:
    """The text before ``pseudonymize`` with the same key."""
    return _replaced(text, key, undo=True)


def n_found(text: Column) -> Column:
    """Values of a known form in the text, valid or not; 0 for a null text."""
    counted = F.when(text.rlike("[0-9@]"), F.regexp_count(text, F.lit(PATTERN)))
    return F.coalesce(counted, F.lit(0)).cast("long")


def hide_personal(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The table with pseudonyms in its texts, other columns unchanged."""
    return docs.withColumn(text_col, pseudonymize(F.col(f"`{text_col}`"), key))
