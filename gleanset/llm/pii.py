"""Personal data replaced by format-preserving pseudonyms, with built-in functions only.

A number that looks like personal data is validated (check digits, octets, calendar), then permuted
within its own format by a keyed Feistel network: a card number becomes another one that passes the
same check, in the same grouping; a date becomes a date. The permutation depends on the key and the
format alone, so a value has the same pseudonym in every document, and different values of a format
have different ones. Values that fail validation stay as they are.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.keys import free_name

ROUNDS = 10
#: Steps of a walk to the next value of the format; one in about nine lands outside of it.
WALK = 24
#: Near days (212 x 212, from this one on) are permuted among themselves.
FIRST_DAY, HALF_DAYS = "1905-01-01", 212
NEAR = HALF_DAYS * HALF_DAYS
#: So are all others from 0000-01-01 (366 days before Python's first) to 9999-12-31; they just fit in the two sizes.
BEFORE = date.fromisoformat(FIRST_DAY).toordinal() - 1 + 366
FAR, FAR_LEFT, FAR_RIGHT = date.max.toordinal() + 366 - NEAR, 1899, 1900

#: Matches whose places are added up together: the work for a text grows with their number, not its square.
RUN = 512

#: What a candidate of each kind looks like (Java patterns). Every repeat of a group is bounded,
#: as the matcher goes one call deeper for each; a host name has 127 labels at most.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}"
    r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.-])(?:\+?1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
    r"|(?<![0-9A-Za-z+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
    r"|(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{1,4}){2,4}(?![0-9A-Za-z]|[.-][0-9])"
)
DATE = (
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?=[Tt][0-9]{2})"
    r"|(?:[0-9]{4}(?:-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}|\.[0-9]{2}\.[0-9]{2})"
    r"|[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4})(?![0-9A-Za-z]|[./-][0-9]))"
)
CANDIDATE = "|".join((EMAIL, IBAN, SSN, DATE, IPV4, PHONE, CARD))


def _random(key: str, *on: Column) -> Column:
    """60 bits that depend on the key and all the columns."""
    text = F.concat_ws("|", F.lit(key), *[c.cast("string") for c in on])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permute the pairs ``left`` below ``left_size``, ``right`` below ``right_size``: struct ``l``, ``r``."""

    def one_round(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(s["r"].alias("l"), ((s["l"] + _random(key, kind, i, s["r"])) % size).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted(key: str, kind: str, digits: Column) -> Column:
    """Permute the strings of as many digits. Fewer than two digits stay."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = _feistel(
        key,
        F.concat_ws("/", F.lit(kind), n.cast("string")),
        F.substring(digits, F.lit(1), half).cast("long"),
        F.substring(digits, half + 1, n - half).cast("long"),
        size(half),
        size(n - half),
    )
    done = F.transform(
        F.array(pair),
        lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")),
    )[0]
    return F.when(n < 2, digits).otherwise(done)


def _refilled(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced one by one."""
    between = F.split(layout, "[0-9]", -1)
    return F.array_join(
        F.zip_with(between, F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""
    )


def _luhn(payload: Column) -> Column:
    """The check digit that follows a string of digits."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10


def _mod97(text: Column) -> Column:
    """Digits and letters (A = 10 ... Z = 35) read as one number, modulo 97."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97,
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _email(key: str, m: Column) -> Column:
    """An address has no number to permute: a keyed name of fixed form, the same for upper and lower case."""
    name = F.lpad(F.lower(F.hex(_random(key, F.lit("email"), F.lower(m)))), 15, "0")
    return F.concat(F.lit("user-"), name, F.lit("@example.invalid"))


def _ipv4(key: str, m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def made(o: Column) -> Column:
        pair = _feistel(
            key, F.lit("ipv4"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)
        )
        parts = lambda p: [F.floor(p / 256).cast("string"), (p % 256).cast("string")]
        return _let(pair, lambda p: F.concat_ws(".", *parts(p["l"]), *parts(p["r"])))

    return _let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), made(o)))


def _card(key: str, m: Column) -> Column:
    """The first digit tells the network and stays; the last is the check digit."""

    def made(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substring(d, 1, 1), _permuted(key, "card", F.substring(d, F.lit(2), n - 2)))
        return _let(payload, lambda p: _refilled(m, F.concat(p, _luhn(p).cast("string"))))

    def valid(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return (_luhn(body) == F.substring(d, -1, 1).cast("int")) & ~d.rlike("^(.)\\1*$")

    return _let(_digits(m), lambda d: F.when(valid(d), made(d)))


def _phone(key: str, m: Column) -> Column:
    """The country code stays. A number written with or without it has the same pseudonym."""
    digits = _digits(m)
    coded = F.length(F.regexp_extract(m, r"^\+?([0-9]{1,3})[ .(-]", 1))
    code = (
        F.when(m.rlike(r"^\+?1") & (F.length(digits) == 11), 1)
        .when(m.startswith("+"), F.when(coded > 0, coded).otherwise(2))
        .otherwise(0)
    )
    own = F.substring(digits, code + 1, F.length(digits) - code)
    fits = F.length(digits).between(7, 15)
    new = F.concat(F.substring(digits, F.lit(1), code), _permuted(key, "phone", own))
    return F.when(fits, _refilled(m, new))


def _ssn_valid(d: Column) -> Column:
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _ssn(key: str, m: Column) -> Column:
    """Permuted until the result is a number that can be given, which again is a permutation."""
    walked = lambda d: F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _permuted(key, "ssn", d),
        lambda x, _: F.when(_ssn_valid(x), x).otherwise(_permuted(key, "ssn", x)),
    )
    return _let(_digits(m), lambda d: F.when(_ssn_valid(d), _refilled(m, walked(d))))


def _day(key: str, number: Column) -> Column:
    """Permute the days, counted from FIRST_DAY: near ones among themselves, and all others as well, with
    steps until the result is one of them, of which one in about 5,800 needs a second."""
    near = number.between(0, NEAR - 1)
    size = lambda a, b: F.when(near, a).otherwise(b)
    left, right = size(HALF_DAYS, FAR_LEFT), size(HALF_DAYS, FAR_RIGHT)

    def step(n: Column) -> Column:
        pair = _feistel(key, size("date", "date/far"), F.floor(n / right), n % right, left, right)
        return _let(pair, lambda p: p["l"] * right + p["r"])

    # The others are numbered without the near ones between them.
    start = F.when(near, number).when(number < 0, number + BEFORE).otherwise(number + BEFORE - NEAR).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), step(start), lambda n, _: F.when(near | (n < FAR), n).otherwise(step(n))
    )
    return _let(walked, lambda n: F.when(near, n).otherwise(n - BEFORE + F.when(n < BEFORE, 0).otherwise(NEAR)).cast("int"))


def _date(key: str, m: Column) -> Column:
    """A day of the calendar, years 0000 to 9999; 1/2/1990 is read day first where that is one. A day of
    1905-01-01 to 2028-01-19 becomes another one of these, any other becomes another of the others."""
    plain = F.regexp_replace(m, "[./]", "-")
    year_first = m.rlike("^[0-9]{4}")
    read = lambda form: F.try_to_timestamp(plain, F.lit(form)).cast("date")
    day_first = read("d-M-yyyy")
    day = F.when(year_first, read("yyyy-M-d")).otherwise(F.coalesce(day_first, read("M-d-yyyy")))
    start = F.lit(FIRST_DAY).cast("date")

    def written(d: Column) -> Column:
        mark = F.regexp_extract(m, "[./-]", 0)
        padded = m.rlike("^(?:[0-9]{4}.)?[0-9]{2}.[0-9]{2}(?:.[0-9]{4})?$")
        form = lambda f: F.date_format(d, f)
        first = F.when(padded, form("dd")).otherwise(form("d"))
        second = F.when(padded, form("MM")).otherwise(form("M"))
        turned = F.when(year_first | day_first.isNull(), F.concat_ws("-", second, first)).otherwise(F.concat_ws("-", first, second))
        whole = F.when(year_first, F.concat_ws("-", form("yyyy"), turned)).otherwise(F.concat_ws("-", turned, form("yyyy")))
        return F.replace(whole, F.lit("-"), mark)

    made = lambda n: F.when(n.isNotNull(), _let(F.date_add(start, _day(key, n)), written))
    return _let(F.datediff(day, start), made)


def _iban(key: str, m: Column) -> Column:
    """Country and letters stay, the account's digits are permuted, the check digits follow."""
    compact = F.replace(m, F.lit(" "))

    def made(c: Column) -> Column:
        account = F.substring(c, 5, 40)
        new = _refilled(account, _permuted(key, "iban", _digits(account)))

        def checked(a: Column) -> Column:
            country = F.substring(c, 1, 2)
            check = F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
            flat = F.concat(country, check, a)
            # Back into the original's spacing.
            gaps = F.split(m, "[A-Z0-9]", -1)
            return F.array_join(F.zip_with(gaps, F.concat(F.split(flat, ""), F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")

        return _let(new, checked)

    right = lambda c: _mod97(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))) == 1
    return _let(compact, lambda c: F.when(right(c), made(c)))


#: In this order: the first kind whose pattern fits the whole candidate and which validates it.
KINDS = (
    ("email", EMAIL, _email),
    ("iban", IBAN, _iban),
    ("ssn", SSN, _ssn),
    ("date", DATE, _date),
    ("ipv4", IPV4, _ipv4),
    ("phone", PHONE, _phone),
    ("card", CARD, _card),
)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``docs`` with personal data in the text replaced, and ``found``: kind, start (characters before
    it in the original), length, and pseudonym of each, in order.

    A null text stays null and an empty one empty, with nothing found; a text without personal data
    is unchanged to the byte. Rows are independent: repeated rows come back alike, an empty table stays
    empty. Every other column is passed through, whatever it is called; one that is called like ``found`` is
    replaced. A text may be as long as a string can be, with any number of matches. No shuffle.
    """
    text = F.col(text_col)
    maybe = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")

    def judged(m: Column) -> Column:
        options = [(kind, F.when(m.rlike(f"^(?:{shape})$"), make(key, m))) for kind, shape, make in KINDS]
        choice = reduce(
            lambda rest, option: F.when(option[1].isNotNull(), F.lit(option[0])).otherwise(rest),
            reversed(options),
            F.lit(None).cast("string"),
        )
        return F.struct(choice.alias("kind"), m.alias("old"), F.coalesce(*[o for _, o in options], m).alias("new"))

    kept = docs.drop(found_col) if found_col in docs.columns else docs
    # Working columns, under names that the table does not have.
    found, checked, between = (free_name(kept, name) for name in ("_matches", "_judged", "_between"))
    named = kept.withColumn(found, F.when(maybe, F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).otherwise(none))
    named = named.withColumns(
        {
            checked: F.transform(found, judged),
            between: F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)).otherwise(none),
        }
    )
    new = F.array_join(
        F.zip_with(
            between,
            F.concat(F.transform(checked, lambda j: j["new"]), F.array(F.lit(""))),
            lambda a, b: F.concat(a, b),
        ),
        "",
    )
    items = F.arrays_zip(
        F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x)).alias("gap"), F.col(checked).alias("item")
    )
    changed = F.size(found) > 0
    spans = F.when(changed, _let(items, _spans)).otherwise(F.array().cast(SPANS))
    return named.withColumns({text_col: F.when(changed, new).otherwise(text), found_col: spans}).drop(found, checked, between)


SPANS = "array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def _spans(items: Column) -> Column:
    """Kind, start, length and pseudonym of the items that have a kind. An item is a match and the characters
    between it and the one before. Places are added up in runs of :data:`RUN` items, and over the runs."""
    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
    run = lambda i: F.slice(items, i * RUN + 1, F.lit(RUN))
    size = lambda x: x["gap"] + F.length(x["item"]["old"])
    sizes = F.transform(runs, lambda i: F.aggregate(run(i), F.lit(0), lambda n, x: n + size(x)))
    begins = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )

    def add(s: Column, x: Column) -> Column:
        item, start = x["item"], s["at"] + x["gap"]
        span = F.struct(
            item["kind"].alias("kind"),
            start.alias("start"),
            F.length(item["old"]).alias("length"),
            item["new"].alias("pseudonym"),
        )
        more = F.when(item["kind"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(span)))
        return F.struct((s["at"] + size(x)).alias("at"), more.alias("out"))

    def spans_of(begin: Column, i: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(run(i), start, add, lambda s: s["out"])

    return F.flatten(F.zip_with(begins, runs, spans_of))
