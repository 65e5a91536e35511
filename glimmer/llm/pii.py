"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Candidates are found by one pattern. A candidate is replaced as a whole, and only if it is valid in its own format:
payment cards and accounts by their check digits, dates by the calendar, addresses by their ranges, national numbers by
their issued ranges, phone numbers by an assigned country code and their length. Its value is split into two halves and
permuted within the format by a keyed Feistel network of modular additions; so the pseudonym is valid too, different
values stay different, and equal values stay linked across documents. Mail addresses and secrets, which have no numeric
format, become keyed digests.

    kind    permuted                                       kept
    card    all digits but the last                        separators; the check digit is computed anew
    phone   all digits behind the country code; in the     country code, separators; a first digit of a part that is
            North American plan parts begin with 2 to 9    0 or 1 there (such a number is not issued)
    iban    the digits of the account                      country, letters, spaces; the check digits are computed anew
    ipv4    the 32-bit address                             dots
    ssn     area, group and serial, within their ranges    dashes
    ipv6    network and host, 64 bits each                 the form of eight groups
    date    the day among 73,000 days from 1900-01-01,     the way it is written
            292,000 before; with two digits of the year
            among the days of 1950 to 2049
    email   becomes a digest at example.invalid
    secret  becomes 16 to 64 hexadecimal digits            the name before it, quotes, closing punctuation

A secret is a key of a known shape, or a value behind a name such as "password" and a colon or equals sign: up to the
closing quote, else to the next white space or quote, without closing punctuation. Every value that is not empty counts,
but for prose: behind a colon and a space, without quotes, a plain word (letters, lower case behind the first, fewer than
16) that another word follows on the line; behind a key's name (api_key) there is no prose. So `password = None` in code
becomes a digest too. No kind has a greatest length beyond that of its format.

Mail addresses and the words around candidates may hold letters of any script. Not found: American numbers of ten digits
without separators, local numbers without country code, dates with names of months, names and postal addresses.

A null text stays null, an empty one stays empty. Digits are ASCII digits.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import quoted

#: Rounds of the network.
ROUNDS = 8
#: Dates are permuted among so many days from the first.
FIRST_DAY, DAY_PARTS = "1900-01-01", (250, 292)
#: Those before, among so many that end the day before; those with two digits of the year, from 1950 to 2049.
OLD_PARTS = (1000, 292)
SHORT_FIRST, SHORT_PARTS = "1950-01-01", (75, 487)

EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}.-]*[\p{L}\p{M}\p{N}-]\.\p{L}{2,}"
#: What stands before a secret; behind a key's name there is no prose.
BEFORE = r"[\x22\x27]?[ \t]*+[:=][ \t]*+"
KEY_NAMES = r"api[_-]?key|access[_-]?key"
NAMED = rf"(?i:token|secret|passwd|password|pwd|{KEY_NAMES}){BEFORE}"
#: Behind a colon and a space: a plain word that another word follows.
PROSE = r"(?<=:[ \t]{1,4})\p{L}[\p{Ll}\x27’-]{0,14}[,;]?[ \t]+\p{L}"
SECRET = (
    rf"(?:(?i:{KEY_NAMES}){BEFORE}|{NAMED}(?!{PROSE}))(?:\x22[^\x22\r\n]++(?=\x22)|\x27[^\x27\r\n]++(?=\x27)|[\x22\x27]?[^\s\x22\x27]*[^\s\x22\x27.,;:)\]}}])"
    r"|(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9_])"
)
#: Groups of an IPv6 address, some with a digit: eight, or three to seven around one gap.
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:._])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{GROUP}:){{7}}{GROUP}|(?=(?::*{GROUP}){{3}})(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:_]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:[0-9]{2}){1,2}|[0-9]{2}/[0-9]{2}/(?:[0-9]{2}){1,2})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NANP = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"
#: The assigned country codes by their first digits.
COUNTRY = r"\+(?:[17]|2(?:[07]|[1-69][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))"
PHONE = rf"(?<![0-9(+.-]){NANP}(?![0-9]|[.-][0-9])|(?<![0-9+])\+[0-9](?:[ .-]?[0-9]|[ .-]?\([0-9]{{1,4}}\)){{4,14}}(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV6, IPV4, DATE, SSN, PHONE, CARD))
#: Texts without any of these hold no candidate.
HINT = r"[0-9@]|(?i:token|secret|passwd|password|pwd|key)|AKIA|gh[pousr]_|sk-"
#: The kinds that are counted.
KINDS = ("email", "phone", "card", "iban", "ipv4", "ipv6", "date", "ssn", "secret")


def digest(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), value).cast("binary"), 256)


def permuted(key: str, kind: str, a: Column, b: Column, a_size: Column | int, b_size: Column | int, beside: Column | None = None) -> Column:
    """The struct (a, b), 0 <= a < a_size and 0 <= b < b_size, after the rounds: each adds a keyed digest of one half to the other."""

    def turn(held: Column, i: Column) -> Column:
        def value(half: Column) -> Column:
            return F.conv(F.substring(digest(key, kind, F.concat_ws(":", i.cast("string"), half.cast("string"), sizes)), 1, 12), 16, 10).cast("long")

        even = F.struct(F.pmod(held["a"] + value(held["b"]), F.lit(a_size) if isinstance(a_size, int) else a_size).cast("long").alias("a"), held["b"].alias("b"))
        odd = F.struct(held["a"].alias("a"), F.pmod(held["b"] + value(held["a"]), F.lit(b_size) if isinstance(b_size, int) else b_size).cast("long").alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    sizes = F.concat_ws(":", *((F.lit(x) if isinstance(x, int) else x).cast("string") for x in (a_size, b_size)), *([] if beside is None else [beside]))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def once(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permuted_digits(key: str, kind: str, digits: Column, beside: Column | None = None) -> Column:
    """A string of 2 to 30 digits as another of the same length; beside: what else the permutation depends on."""
    left, right = F.floor(F.length(digits) / 2).cast("int"), F.ceil(F.length(digits) / 2).cast("int")
    halves = permuted(key, kind, F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, right).cast("long"), power_of_ten(left), power_of_ten(right), beside)
    return once(halves, lambda x: F.concat(F.lpad(x["a"].cast("string"), left, "0"), F.lpad(x["b"].cast("string"), right, "0")))


def luhn(digits: Column) -> Column:
    """The sum modulo 10 in which every second digit from the right counts double, the last one single."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.floor(x.cast("int") * 2 / 10) + x.cast("int") * 2 % 10).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, digits: Column) -> Column:
    """text with its digits replaced, in order."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(text, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def card(key: str, m: Column) -> Column:
    def with_check(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    def replaced(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return F.when((luhn(d) == 0) & ~d.rlike("^0+$"), once(once(permuted_digits(key, "card", body), with_check), lambda new: refilled(m, new)))

    return once(digits_of(m), replaced)


def phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, f"^{COUNTRY}", 0)

    def plain(digits: Column) -> Column:
        return permuted_digits(key, "phone", digits)

    def american(digits: Column) -> Column:
        """Area, exchange and line of ten digits."""
        area, exchange = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 3).cast("long")
        halves = permuted(key, "phone-plan", (area - 200) * 800 + exchange - 200, F.substring(digits, 7, 4).cast("long"), 800 * 800, 10_000)
        issued = once(halves, lambda x: F.concat((F.floor(x["a"] / 800) + 200).cast("string"), (x["a"] % 800 + 200).cast("string"), F.lpad(x["b"].cast("string"), 4, "0")))
        first, second = F.substring(digits, 1, 1), F.substring(digits, 4, 1)
        rest = permuted_digits(key, "phone-rest", F.concat(F.substring(digits, 2, 2), F.substring(digits, 5, 6)), F.concat(first, second))
        other = once(rest, lambda x: F.concat(first, F.substring(x, 1, 2), second, F.substring(x, 3, 6)))
        return F.when((area >= 200) & (exchange >= 200), issued).otherwise(other)

    def replaced(p: Column) -> Column:
        rest, total = F.substring(m, F.length(p) + 1, F.length(m)), F.length(digits_of(m))
        valid = total.between(8, 15) & (F.length(digits_of(rest)) >= 6) & ((p != "") | ~m.startswith("+"))
        ten = (F.length(digits_of(rest)) == 10) & p.isin("", "+1")
        new = once(digits_of(rest), lambda d: F.when(ten, american(d)).otherwise(plain(d)))
        return F.when(valid, F.concat(p, once(new, lambda d: refilled(rest, d))))

    return once(code, replaced)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, in which A is 10 and Z is 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda held, c: F.when(c.rlike("[0-9]"), (held * 10 + F.ascii(c) - 48) % 97).otherwise((held * 100 + F.ascii(c) - 55) % 97))


def iban(key: str, m: Column) -> Column:
    def replaced(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def written(new: Column) -> Column:
            check = 98 - mod97(F.concat(refilled(account, new), country, F.lit("00")))
            return refilled(m, F.concat(F.lpad(check.cast("string"), 2, "0"), new))

        valid = F.length(plain).between(15, 34) & (F.length(digits_of(account)) >= 2) & (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, once(permuted_digits(key, "iban", digits_of(account)), written))

    return once(F.regexp_replace(m, " ", ""), replaced)


def ipv4(key: str, m: Column) -> Column:
    def replaced(o: Column) -> Column:
        halves = permuted(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16)
        return once(halves, lambda x: F.concat_ws(".", *(F.floor(v).cast("string") for v in (x["a"] / 256, x["a"] % 256, x["b"] / 256, x["b"] % 256))))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    return F.when(m.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"), once(octets, replaced))


def ssn(key: str, m: Column) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    group, serial = F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    halves = permuted(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

    def written(x: Column) -> Column:
        new = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), once(halves, written))


def ipv6(key: str, m: Column) -> Column:
    """Network and host parts of 64 bits, the host's permutation beside its network; written as eight groups."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def number(part: Column) -> Column:
        return F.conv(part, 16, 10).cast("long")

    def moved(name: str, part: Column, beside: Column | None = None) -> Column:
        halves = permuted(key, name, number(F.substring(part, 1, 8)), number(F.substring(part, 9, 8)), 1 << 32, 1 << 32, beside)
        return once(halves, lambda x: F.concat(*(F.lpad(F.lower(F.conv(x[h].cast("string"), 10, 16)), 8, "0") for h in "ab")))

    def replaced(sides: Column) -> Column:
        left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, 1), F.lit("")))
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return once(F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(F.lower(g), 4, "0")), ""), written)

    def written(whole: Column) -> Column:
        network, host = F.substring(whole, 1, 16), F.substring(whole, 17, 16)
        new = F.concat(moved("ipv6-network", network), moved("ipv6-host", host, network))
        return F.when(F.length(whole) == 32, once(new, lambda x: F.concat_ws(":", *(F.substring(x, 4 * i + 1, 4) for i in range(8)))))

    return once(F.split(m, "::"), replaced)


def date(key: str, m: Column) -> Column:
    def among(name: str, first: Column, parts: tuple[int, int], day: Column, form: str) -> Column:
        whole = F.when((day >= 0) & (day < parts[0] * parts[1]), day)
        halves = permuted(key, name, F.floor(whole / parts[1]), whole % parts[1], *parts)
        return F.when(whole.isNotNull(), once(halves, lambda x: F.date_format(F.date_add(first, (x["a"] * parts[1] + x["b"]).cast("int")), form)))

    def by(form: str, read: Column) -> Column:
        first, old = F.to_date(F.lit(FIRST_DAY)), F.date_sub(F.to_date(F.lit(FIRST_DAY)), OLD_PARTS[0] * OLD_PARTS[1])
        day = F.try_to_timestamp(read, F.lit("yyyy-MM-dd")).cast("date")
        return F.when(day < first, among("date-old", old, OLD_PARTS, F.datediff(day, old), form)).otherwise(among("date", first, DAY_PARTS, F.datediff(day, first), form))

    def short(form: str, read: Column) -> Column:
        first = F.to_date(F.lit(SHORT_FIRST))
        return among("date-short", first, SHORT_PARTS, F.datediff(F.try_to_timestamp(read, F.lit("yyyy-MM-dd")).cast("date"), first), form)

    def part(start: int, size: int) -> Column:
        return F.substring(m, start, size)

    full = F.length(m) == 10
    year = F.when(full, part(7, 4)).otherwise(F.concat(F.when(part(7, 2) < "50", "20").otherwise("19"), part(7, 2)))

    def written(form: str, read: Column) -> Column:
        return F.when(full, by(f"{form}yyyy", read)).otherwise(short(f"{form}yy", read))

    iso = by("yyyy-MM-dd", m)
    dotted = written("dd.MM.", F.concat_ws("-", year, part(4, 2), part(1, 2)))
    month_first = written("MM/dd/", F.concat_ws("-", year, part(1, 2), part(4, 2)))
    day_first = written("dd/MM/", F.concat_ws("-", year, part(4, 2), part(1, 2)))
    return F.when(m.contains("-"), iso).when(m.contains("."), dotted).otherwise(F.coalesce(month_first, day_first))


def secret(key: str, m: Column) -> Column:
    def replaced(name: Column) -> Column:
        value = F.substring(m, F.length(name) + 1, F.length(m))
        size = F.least(F.lit(64), F.greatest(F.lit(16), F.length(value)))
        return F.concat(name, F.substring(digest(key, "secret", value), F.lit(1), size))

    return once(F.regexp_extract(m, rf"^{NAMED}[\x22\x27]?", 0), replaced)


def replacement(key: str, m: Column) -> Column:
    """(kind, new) of a candidate; nulls where it is not valid in its format."""

    def as_kind(kind: str, new: Column) -> Column:
        return F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), new.alias("new"))

    def whole(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    email = F.concat(F.lit("u"), F.substring(digest(key, "email", F.lower(m)), 1, 16), F.lit("@example.invalid"))
    return (
        F.when(m.rlike(f"^{NAMED}"), as_kind("secret", secret(key, m)))
        .when(whole(EMAIL), as_kind("email", email))
        .when(whole(IBAN), as_kind("iban", iban(key, m)))
        .when(whole(IPV6), as_kind("ipv6", ipv6(key, m)))
        .when(whole(IPV4), as_kind("ipv4", ipv4(key, m)))
        .when(whole(DATE), as_kind("date", date(key, m)))
        .when(whole(SSN), as_kind("ssn", ssn(key, m)))
        .when(whole(PHONE), as_kind("phone", phone(key, m)))
        .when(whole(CARD), as_kind("card", card(key, m)))
        .otherwise(as_kind("secret", secret(key, m)))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", prefix: str | None = "n_") -> DataFrame:
    """All columns of docs with the text rewritten, and how many of each kind were replaced, as <prefix><kind> in place of
    columns of these names; without a prefix nothing is added. key: the secret that fixes the permutations. One scan, no
    exchange, no Python."""
    kinds = KINDS if prefix is not None else ()
    docs = docs.drop(*(f"{prefix}{kind}" for kind in kinds))
    mark = next(name for i in count() if (name := f"found_{i}") not in {c.lower() for c in docs.columns})
    content, found = F.col(quoted(text)), F.col(mark)
    searched = content.rlike(HINT) & content.rlike(ANY)
    marked = docs.withColumn(mark, F.when(searched, F.transform(F.regexp_extract_all(content, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), replacement(key, m).alias("at")))))
    gaps = F.split(content, ANY, -1)
    pieces = F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(found, i)["at"]["new"], F.get(found, i)["old"], F.lit(""))))
    new = F.when(found.isNull(), content).otherwise(F.array_join(pieces, ""))

    def counted(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(found, lambda x: x["at"]["kind"] == kind)), F.lit(0)).cast("long").alias(f"{prefix}{kind}")

    return marked.select(*(new.alias(text) if c == text else F.col(quoted(c)) for c in docs.columns), *map(counted, kinds))
