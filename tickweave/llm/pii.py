"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their own checks are permuted by a keyed Feistel network
inside their format: a card stays a card with a right check digit, a date stays a date,
punctuation stays in place. The permutation depends on the key, the kind and the value
alone, so equal values get equal pseudonyms in every document, and different values
different ones. E-mail addresses, which have no fixed format, get a keyed name.

| kind | found when | pseudonym |
| --- | --- | --- |
| email | an address | ``u`` and 16 hex digits of a keyed hash ``@example.invalid`` |
| secret | a key word, ``=`` or ``:``, then 8 or more characters on the same line, a digit among them | value permuted |
| key | an access key of a known form | permuted after its prefix |
| iban | mod 97 is 1 | digits permuted, check digits made anew |
| card | 13 to 19 digits, the first 2 to 6, Luhn right | digits between first and last permuted, check digit made anew |
| ssn | valid area, group and serial | permuted among the valid ones |
| phone | 8 to 15 digits with ``+``, or 3-3-4 digits | permuted, country code kept |
| ip, ip6 | four numbers up to 255; eight hex groups, or fewer around ``::`` with a digit among them | permuted |
| date | a real day of 1900 to 2099, a time behind ``T`` may follow | permuted among these days |

Defined results: a null text stays null. A text without a match is returned as it is,
to the byte. Candidates that fail their check stay, and use up no characters: what starts
inside one is found. Matches do not overlap; the leftmost
wins, then the order of the table. An ip6 written in another form is another value. Null ids, repeated rows and further columns are kept.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, fresh

KEY_SETTING = "spark.tickweave.pseudonym.secret"

ROUNDS = 10
DIGITS = "0123456789"
HEX = DIGITS + "abcdef"
UPPER = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = UPPER + "abcdefghijklmnopqrstuvwxyz"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SECRET_WORD = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_SECRET = _SECRET_WORD + r"[\"']?[^\S\n]{0,3}[=:][^\S\n]{0,3}[\"']?"
#: Length of an IBAN by country, for those written in groups of four.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


def _grouped(length: int) -> str:
    lands = "|".join(c for c, n in IBAN_LENGTHS.items() if n == length)
    whole, rest = divmod(length - 4, 4)
    return rf"(?:{lands})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{whole}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")


_SPACED_IBAN = "|".join(_grouped(n) for n in sorted(set(IBAN_LENGTHS.values())))
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_HEX = "[0-9a-fA-F]{1,4}"
#: Groups before and behind the ``::``, seven at most.
_SHORT_IP6 = "|".join(
    [f"(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{1,{n}}}" for n in range(1, 7)] + [f":(?::{_HEX}){{1,7}}", f"(?:{_HEX}:){{1,7}}:"]
)
#: In this order; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "secret": rf"(?i:(?<![\p{{L}}\p{{N}}]){_SECRET}(?=[^\s\"']{{0,200}}[0-9])[^\s\"']{{7,}}[A-Za-z0-9/+=_-])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_SPACED_IBAN}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])",
    "card": r"(?<![\p{L}\p{N}.+-])(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}]|[.-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+(?!1[ .(-])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}]|[.-][0-9])"
    r"|(?<![\p{L}\p{N}(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[a-fA-F:]{{0,39}}[0-9])(?:{_SHORT_IP6}))(?![\p{{L}}\p{{N}}:]|\.[0-9])",
    "date": rf"(?<![\p{{L}}\p{{N}}-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR}|{_DAY}/{_MONTH}/{_YEAR})(?!(?![Tt][0-9]{{2}})[\p{{L}}\p{{N}}]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds with a check besides the pattern.
CHECKED = ("iban", "card", "phone", "date")
#: What is tried at each start, in order: kinds without a check together.
TRIED = [
    "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "key")), PATTERNS["iban"], PATTERNS["card"], PATTERNS["ssn"],
    PATTERNS["phone"], "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ip6")), PATTERNS["date"],
]
STARTS = f"(?={ANY})"
AT_STARTS = STARTS + "".join(f"(?:(?=({p})))?" for p in TRIED)
#: Cheap test: every kind has one of these characters, and none goes on in another line.
MAYBE = "[@0-9]"
#: Lines with one of them; only these are searched.
LINE = r"(?dm)^[^\n@0-9]*+[@0-9][^\n]*+"

FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days are the years 1900 to 2099
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 12), 16, 10).cast(
        "long"
    )


def _rounds() -> Column:
    return F.sequence(F.lit(1), F.lit(ROUNDS))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], tweak: Column) -> Column:
    """A keyed permutation of the pairs below ``sizes``: struct(a, b).

    Each round adds a keyed number made from one half to the other, modulo its size.
    That can be undone, so no two pairs meet, and the result never leaves the format.
    """

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_a = F.when(even, (acc["a"] + _number(tweak, r, acc["b"])) % sizes[0]).otherwise(acc["a"])
        new_b = F.when(even, acc["b"]).otherwise((acc["b"] + _number(tweak, r, acc["a"])) % sizes[1])
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(_rounds(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_text(text: Column, alphabet: str, tweak: Column) -> Column:
    """A keyed permutation of the texts of one length over ``alphabet``."""
    letters = F.lit(alphabet)

    def shift(half: Column, other: Column, r: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            at = (F.instr(letters, ch) - 1 + _number(tweak, r, i, other)) % len(alphabet)
            return F.when(ch == "", ch).otherwise(F.substr(letters, (at + 1).cast("int"), F.lit(1)))

        return F.array_join(F.transform(_chars(half), one), "")

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b")
    )
    end = F.aggregate(
        _rounds(),
        start,
        lambda acc, r: F.struct(acc["b"].alias("a"), shift(acc["a"], acc["b"], r).alias("b")),
    )
    return F.concat(end["a"], end["b"])


def only(text: Column, alphabet_class: str) -> Column:
    return F.regexp_replace(text, f"[^{alphabet_class}]", "")


def refill(shape: Column, letters: Column, alphabet: str) -> Column:
    """``shape`` with its characters of ``alphabet`` replaced in order by ``letters``."""

    def put(acc: Column, ch: Column) -> Column:
        taken = (F.instr(F.lit(alphabet), ch) > 0) & (ch != "")
        return F.struct(
            F.concat(acc["out"], F.when(taken, F.substr(acc["rest"], F.lit(1), F.lit(1))).otherwise(ch)).alias("out"),
            F.when(taken, F.substr(acc["rest"], F.lit(2))).otherwise(acc["rest"]).alias("rest"),
        )

    start = F.struct(F.lit("").alias("out"), letters.alias("rest"))
    return F.aggregate(_chars(shape), start, put)["out"]


def luhn_sum(digits: Column) -> Column:
    """Modulo 10; 0 for a number with the right check digit."""

    def worth(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda a, x: a + x) % 10


def mod97(text: Column) -> Column:
    """Of the number that the characters spell, A as 10 to Z as 35."""

    def add(acc: Column, ch: Column) -> Column:
        value = F.instr(F.lit(UPPER), ch) - 1
        return ((acc * F.when(value > 9, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(_chars(text), F.lit(0), add)


def _card(hit: Column, tweak: Column) -> Column:
    digits = only(hit, "0-9")
    inner = F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(inner, DIGITS, tweak))
    check = (10 - luhn_sum(F.concat(body, F.lit("0")))) % 10
    return refill(hit, F.concat(body, check.cast("string")), DIGITS)


def _iban(hit: Column, tweak: Column) -> Column:
    plain = F.regexp_replace(hit, " ", "")
    land, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    new = refill(body, permute_text(only(body, "0-9"), DIGITS, F.concat(tweak, land)), DIGITS)
    check = F.lpad((98 - mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    return refill(hit, F.concat(land, check, new), UPPER)


def _ssn(hit: Column, tweak: Column) -> Column:
    area, group, serial = (F.substr(hit, F.lit(s), F.lit(n)).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    sizes = (SSN_AREAS * SSN_GROUPS, SSN_SERIALS)
    new = permute_pair(place * SSN_GROUPS + group - 1, serial - 1, sizes, tweak)
    at = F.floor(new["a"] / SSN_GROUPS)
    return F.concat_ws(
        "-",
        F.lpad((at + 1 + F.when(at >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((new["a"] % SSN_GROUPS + 1).cast("string"), 2, "0"),
        F.lpad((new["b"] + 1).cast("string"), 4, "0"),
    )


def _ip(hit: Column, tweak: Column) -> Column:
    part = F.transform(F.split(hit, r"\."), lambda x: x.cast("long"))
    new = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), tweak)
    return F.concat_ws(
        ".", *((F.floor(new[h] / 256) if high else new[h] % 256).cast("string") for h in "ab" for high in (True, False))
    )


def _day(hit: Column) -> tuple[Column, Column]:
    """The day, null if there is none, and its format."""
    forms = {"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{2}\.": "dd.MM.yyyy", "^(?:0[1-9]|1[0-2])/": "MM/dd/yyyy"}
    form, day = F.lit("dd/MM/yyyy"), F.try_to_timestamp(hit, F.lit("dd/MM/yyyy"))
    for start, f in forms.items():
        form = F.when(hit.rlike(start), F.lit(f)).otherwise(form)
        day = F.when(hit.rlike(start), F.try_to_timestamp(hit, F.lit(f))).otherwise(day)
    return day.cast("date"), form


def _date(hit: Column, tweak: Column) -> Column:
    day, form = _day(hit)
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    new = permute_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, tweak)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (new["a"] * DAYS[1] + new["b"]).cast("int"))
    out = F.date_format(moved, "dd/MM/yyyy")
    for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"):
        out = F.when(form == f, F.date_format(moved, f)).otherwise(out)
    return out


def _phone(hit: Column, tweak: Column) -> Column:
    land = F.regexp_extract(hit, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)
    rest = F.substr(hit, F.length(land) + 1)
    return F.concat(land, refill(rest, permute_text(only(rest, "0-9"), DIGITS, F.concat(tweak, land)), DIGITS))


def _secret(hit: Column, tweak: Column) -> Column:
    word = F.regexp_extract(hit, f"(?i)^({_SECRET})", 1)
    value = F.substr(hit, F.length(word) + 1)
    letters = F.when(
        value.rlike("^[0-9a-f]+$"), permute_text(value, HEX, tweak)
    ).otherwise(refill(value, permute_text(only(value, "0-9A-Za-z"), ALNUM, tweak), ALNUM))
    return F.concat(word, letters)


def _key(hit: Column, tweak: Column) -> Column:
    start = F.regexp_extract(hit, r"^(AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_)", 1)
    rest = F.substr(hit, F.length(start) + 1)
    new = F.when(hit.rlike("^A"), permute_text(rest, UPPER, tweak)).otherwise(permute_text(rest, ALNUM, tweak))
    return F.concat(start, new)


def _email(hit: Column, tweak: Column) -> Column:
    name = F.substring(F.sha2(F.concat(tweak, F.lower(hit)), 256), 1, 16)
    return F.concat(F.lit("u"), name, F.lit("@example.invalid"))


def _ip6(hit: Column, tweak: Column) -> Column:
    low = F.lower(hit)
    return refill(low, permute_text(only(low, "0-9a-f"), HEX, tweak), HEX)


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(only(hit, "0-9"))
    return {
        "card": luhn_sum(only(hit, "0-9")) == 0,
        "iban": mod97(F.concat(F.substr(F.regexp_replace(hit, " ", ""), F.lit(5)), F.substr(hit, F.lit(1), F.lit(4)))) == 1,
        "phone": (n >= 8) & (n <= 15),
        "date": _day(hit)[0].isNotNull(),
    }.get(kind, F.lit(True))


MAKERS = {
    "email": _email, "secret": _secret, "key": _key, "iban": _iban, "card": _card, "ssn": _ssn,
    "phone": _phone, "ip": _ip, "ip6": _ip6, "date": _date,
}


def _chosen(source: Column, kind_of) -> Column:
    """Pieces of text and the matches behind them, checked before they are chosen.

    The text is cut at every start of a candidate, overlapping ones too. Of the starts
    from left to right, each that has a right candidate and lies behind the last match
    is taken. A piece is the text from a start, or from the end of a match if that is
    later, to the next start; the first has no start.
    """

    def best(*found: Column) -> Column:
        return F.coalesce(*(F.when(x["kind"].isNotNull(), x) for x in found), F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("hit")))

    tried = [F.transform(F.regexp_extract_all(source, F.lit(AT_STARTS), F.lit(k + 1)), kind_of) for k in range(len(TRIED))]
    found = F.transform(F.arrays_zip(*(t.alias(f"t{k}") for k, t in enumerate(tried))), lambda x: best(*(x[f"t{k}"] for k in range(len(TRIED)))))
    cut = F.split(source, STARTS, -1)
    # A start at the first character makes no piece before it.
    cut = F.when(F.size(cut) == F.size(found), F.concat(F.array(F.lit("")), cut)).otherwise(cut)

    def take(acc: Column, x: Column) -> Column:
        """``left``: characters from this start on that the last match still holds."""
        size = F.length(x["piece"])
        taken = x["found"]["kind"].isNotNull() & (acc["left"] <= 0)
        held = F.when(taken, F.length(x["found"]["hit"])).otherwise(acc["left"])
        step = F.struct(
            F.when(taken, x["found"]["kind"]).alias("kind"),
            F.when(taken, x["found"]["hit"]).otherwise("").alias("hit"),
            F.substr(x["piece"], F.greatest(held, F.lit(0)) + 1).alias("piece"),
        )
        return F.struct((held - size).alias("left"), F.concat(acc["steps"], F.array(step)).alias("steps"))

    starts = F.arrays_zip(F.slice(cut, F.lit(2), F.size(found)).alias("piece"), found.alias("found"))
    none = F.array().cast("array<struct<kind: string, hit: string, piece: string>>")
    steps = F.aggregate(starts, F.struct(F.lit(0).alias("left"), none.alias("steps")), take, lambda acc: acc["steps"])
    return F.struct(
        F.concat(F.slice(cut, 1, 1), F.transform(steps, lambda s: s["piece"])).alias("pieces"),
        F.transform(steps, lambda s: F.struct(s["kind"].alias("kind"), s["hit"].alias("hit"))).alias("hits"),
    )


def session_key(spark: SparkSession) -> str:
    """The key named by the session's ``KEY_SETTING``; if unset, a random one that the session keeps.

    Pseudonyms agree between sessions, and can be undone by the key's owner, only if it is set.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def with_pseudonyms(
    docs: DataFrame, text: str = "text", out: str = "text", found: str | None = None, *, secret: str
) -> DataFrame:
    """``docs`` with ``text`` pseudonymised in ``out``.

    ``found`` names a further column: array of (kind, pseudonym) in text order. The
    key ``secret`` is part of the plan; keep event logs as safe as the key.
    """

    def kind_of(hit: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name in reversed(PATTERNS):
            fits = hit.rlike(f"^(?:{PATTERNS[name]})$")
            kind = F.when(fits & _valid(name, hit) if name in CHECKED else fits, F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("kind"), hit.alias("hit"))

    def pseudonym(x: Column) -> Column:
        new = x["hit"]
        for name, make in MAKERS.items():
            new = F.when(x["kind"] == name, make(x["hit"], F.lit(f"{secret}|{name}"))).otherwise(new)
        return F.struct(x["kind"].alias("kind"), new.alias("value"))

    source = col(text)
    names = fresh(docs, "pii_lines", "pii_hits", "pii_cuts", "pii_new")
    lines, hits, cuts, values = (F.col(n) for n in names)
    marked = docs.withColumn(
        names[0], F.when(source.rlike(MAYBE), F.array_join(F.regexp_extract_all(source, F.lit(LINE), F.lit(0)), "\n"))
    )
    plain = F.coalesce(F.regexp_extract_all(lines, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    marked = marked.withColumn(names[1], F.transform(plain, kind_of))
    failed = F.exists(hits, lambda x: x["kind"].isNull())
    # Pieces of the lines between the matches; where a candidate failed, chosen anew from all starts.
    # The scans get a null instead of lines they are not for, so that those cost nothing.
    whole, torn = F.when((F.size(hits) > 0) & ~failed, lines), F.when(failed, lines)
    cut = F.when(failed, _chosen(torn, kind_of)).otherwise(
        F.struct(F.split(whole, ANY, -1).alias("pieces"), hits.alias("hits"))
    )
    marked = marked.withColumn(names[2], cut)
    marked = marked.withColumn(names[3], F.transform(cuts["hits"], pseudonym))
    changed = F.exists(values, lambda v: v["kind"].isNotNull())
    new_lines = F.array_join(
        F.zip_with(cuts["pieces"], values, lambda p, v: F.concat(p, F.coalesce(v["value"], F.lit("")))), ""
    )
    # The text between the lines, each piece followed by its line.
    between = F.split(F.when(changed, source), LINE, -1)
    joined = F.array_join(
        F.zip_with(between, F.split(new_lines, "\n", -1), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""
    )
    done = marked.withColumn(out, F.when(changed, joined).otherwise(source))
    if found:
        real = F.filter(values, lambda v: v["kind"].isNotNull())
        none = F.array().cast("array<struct<kind: string, value: string>>")
        done = done.withColumn(found, F.when(source.isNotNull(), F.coalesce(real, none)))
    return done.drop(*names)
