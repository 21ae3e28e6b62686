"""Operator 4: format-preserving pseudonyms for personal data and secrets.

Everything is found by one pattern and validated; what is valid is replaced by a
keyed permutation of itself within its format, a Feistel network. Equal values
get equal pseudonyms in all documents, different ones different pseudonyms, and
whoever holds the key can undo them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: A character moves within its alphabet. Hexadecimal letters are their own, so that hexadecimal texts stay so and others stay others.
ALPHABETS = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", _DIGITS)

#: What is looked for, in this order where matches begin at the same place.
PATTERNS = {
    "secret": r"""(?<![A-Za-z0-9_-])(?i:[a-z_-]*(?:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[a-z_]*)"? ?[=:] ?"?(?=[^\s"]*[0-9])[^\s"]{8,}+|(?<![A-Za-z0-9_-])(?i:bearer) (?=[^\s"]*[0-9])[^\s"]{16,}+""",
    "cloud_key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-)[A-Za-z0-9_-]{20,}+|sk-[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "date": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?[()]?[ .-]?[0-9]){6,14}|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![0-9A-Za-z.-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}|(?<![0-9A-Za-z.-])(?<![0-9] )[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
#: How country codes of phone numbers begin: one digit, two, or three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No match without one of these: a digit or a sign that all other patterns need, or how a bare key begins. A text without any is not searched.
_MARKS = "[0-9@=:]|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|eyJ"
KINDS = list(PATTERNS)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256)


def _number(hexes: Column, at: int = 1, digits: int = 14) -> Column:
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("long")


def permute_pair(left: Column, right: Column, a: int, b: int, key: str) -> Column:
    """A permutation of pairs (left < a, right < b): alternating rounds add a keyed hash of the one to the other."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def one(s: Column, i: Column) -> Column:
        moved = (s["l"] + _number(_hash(key, i, F.lit("l"), s["r"]))) % a
        return F.struct(moved.alias("l"), ((s["r"] + _number(_hash(key, i, F.lit("r"), moved))) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, one)


def _stream(key: str, i: Column, text: Column, length: Column) -> Column:
    """Numbers of at most 8 bits, as many as asked for: keyed hashes of the text, or from the fourth on of the text's hash."""

    def blocks(whole: Column) -> Column:
        one = lambda n: F.when(n < 3, _hash(key, i, n, text)).otherwise(_hash(key, i, n, whole))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 32).cast("int")), one), "")

    # computed once; else it would be anew for each block
    hexes = F.transform(F.array(F.when(length > 96, _hash(key, i, F.lit("long"), text))), blocks)[0]
    return F.transform(F.slice(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), F.lit(1), length), lambda x: F.conv(x, 16, 10).cast("int"))


def _shift(text: Column, stream: Column) -> Column:
    """Every letter and digit moved within its alphabet by a number of the stream; other characters stay."""

    def char(c: Column, by: Column) -> Column:
        out = c
        for alphabet in ALPHABETS:
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.zip_with(F.split(text, ""), stream, char), "")


def permute_text(text: Column, key: str) -> Column:
    """A permutation of texts of any length that keeps which characters are small or capital letters, hexadecimal or not, digits or signs, and where."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def one(s: Column, i: Column) -> Column:
        moved = F.when(s["a"] == "", s["a"]).otherwise(_shift(s["a"], _stream(key, i, s["b"], F.length(s["a"]))))
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    # an even number of rounds brings the halves back to their places
    return F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, one)), lambda s: F.concat(s["a"], s["b"]))[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _parts(text: Column, sign: str) -> list[Column]:
    found = F.split(text, sign)
    return [F.try_element_at(found, F.lit(i)) for i in range(1, 5)]


#: Dates from 1900-01-01 to 2099-12-31 are 319 * 229; social security numbers have 898 areas and 99 * 9999 numbers in each.
_DAYS = (319, 229)
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """(the day, or null if there is no such day from 1900 to 2099; the pseudonym). With slashes the month comes first, unless only the day can."""
    formats = [("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{2}\\.", "dd.MM.yyyy"), ("^(0[0-9]|1[0-2])/[0-9]{2}/", "MM/dd/yyyy"), ("^[0-9]{2}/", "dd/MM/yyyy")]
    day = shown = F.lit(None)
    rank = lambda d: F.datediff(d, F.lit("1900-01-01").cast("date"))
    for start, fmt in reversed(formats):
        d = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        day = F.when(m.rlike(start), d).otherwise(day)
        moved = F.transform(F.array(permute_pair(F.floor(rank(d) / _DAYS[1]), rank(d) % _DAYS[1], *_DAYS, f"{key}|date")), lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")))[0]
        shown = F.when(m.rlike(start), F.date_format(moved, fmt)).otherwise(shown)
    return F.when((F.year(day) >= 1900) & (F.year(day) <= 2099), day), shown


def _ip(m: Column, key: str) -> Column:
    n = [p.cast("long") for p in _parts(m, "\\.")]
    moved = permute_pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, f"{key}|ip")
    return F.transform(F.array(moved), lambda s: F.concat_ws(".", *(F.floor(s[h] / 256 if k == 0 else s[h] % 256).cast("string") for h in "lr" for k in (0, 1))))[0]


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (p.cast("long") for p in _parts(m, "-")[:3])
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permute_pair(place, (group - 1) * _SERIALS + serial - 1, _AREAS, _GROUPS * _SERIALS, f"{key}|ssn")
    shown = F.transform(F.array(moved), lambda s: F.concat_ws("-", F.lpad((s["l"] + F.when(s["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / _SERIALS) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % _SERIALS + 1).cast("string"), 4, "0")))[0]
    return valid, shown


def _refill(form: Column, of: str, values: Column) -> Column:
    """form with its characters of the class ``of`` replaced by those of values, in order: one value has one pseudonym in all notations."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def one(s: Column, c: Column) -> Column:
        fits = c.rlike(of)
        return F.struct(F.concat(s["out"], F.when(fits, F.substring(values, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + fits.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, one, lambda s: s["out"])


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the check digit again."""
    digits = _digits(m)
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), f"{key}|card")
    check = lambda b: F.filter(F.array(*map(F.lit, _DIGITS)), lambda d: F.call_function("luhn_check", F.concat(b, d)))[0]
    return _once(body, lambda b: _refill(m, "[0-9]", F.concat(b, check(b))))


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code, which stays; a number has the same pseudonym with and without ``+1``."""
    digits = _digits(m)
    code = F.regexp_replace(F.regexp_extract(F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits), COUNTRY, 0), r"\+", "")
    return _once(permute_text(F.substring(digits, F.length(code) + 1, F.length(digits)), f"{key}|phone"), lambda d: _refill(m, "[0-9]", F.concat(code, d)))


def _ipv6(m: Column, key: str) -> tuple[Column, Column]:
    """(valid, the address in full): 32 hexadecimal digits are permuted, whatever notation they came in."""
    halves = F.split(m, "::")
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = groups(halves[0]), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    digits = F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    valid = F.when(F.contains(m, F.lit("::")), missing >= 1).otherwise(missing == 0) & (F.length(m) - F.length(F.replace(m, F.lit("::"), F.lit(""))) <= 2)
    return valid, _once(permute_text(digits, f"{key}|ipv6"), lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(d, k * 4 + 1, F.lit(4))), ":"))


def _iban_rest(text: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters were put last; letters are 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: ((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    """(valid, the pseudonym): country and length stay, the account is permuted, the check digits fit again."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, check, account = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = (_iban_rest(F.concat(account, country, check)) == 1) & check.between("02", "98")
    new = lambda a: F.concat(country, F.lpad((98 - _iban_rest(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
    return valid, _once(permute_text(account, f"{key}|iban"), lambda a: _refill(m, "[0-9A-Z]", new(a)))


def _found(m: Column, key: str) -> Column:
    """struct(kind: null where the match is not valid, text: the pseudonym or the match)."""
    label = F.regexp_extract(m, """^(?:(?i:bearer) |[A-Za-z_-]+"? ?[=:] ?["']?)""", 0)
    rest = F.substring(m, F.length(label) + 1, F.length(m))
    # signs stay, so those at the end belong to the sentence: a secret has one pseudonym with and without them
    value = F.regexp_replace(rest, r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    tail = F.substring(rest, F.length(value) + 1, F.length(rest))
    # with a label or as a bare key: the same permutation, so both stay linked
    secret = F.concat(label, permute_text(value, f"{key}|secret"), tail)
    at = F.locate("@", m)
    email = F.concat(permute_text(F.substring(m, F.lit(1), at - 1), f"{key}|email"), F.substring(m, at, F.length(m)))
    day, date = _date(m, key)
    ssn_valid, ssn = _ssn(m, key)
    ipv6_valid, ipv6 = _ipv6(m, key)
    iban_valid, iban = _iban(m, key)
    cases = [
        ("secret", m.rlike(r'^(?:(?i:bearer) |[A-Za-z_-]+"? ?[=:] ?"?.)') & value.rlike("[0-9]") & ~m.rlike("^[0-9A-Fa-f:]+$"), secret), ("cloud_key", m.rlike("^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|eyJ)") & (at == 0), secret),
        ("email", at > 0, email), ("ip", m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _ip(m, key)), ("ipv6", m.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & ipv6_valid, ipv6),
        ("date", m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4})$") & day.isNotNull(), date), ("ssn", m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ssn_valid, ssn),
        ("phone", m.rlike(r"^(\+|\()|^[0-9]{3}([-. ])[0-9]{3}\2[0-9]{4}$"), _phone(m, key)), ("iban", m.rlike("^[A-Z]{2}[0-9]{2}") & iban_valid, iban), ("card", m.rlike("^[0-9 -]{13,}$") & F.call_function("luhn_check", _digits(m)), _card(m, key)),
    ]
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, fits, text in reversed(cases):
        out = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(kind).alias("kind"), text.alias("text"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with pseudonyms in the whole text, and ``private``: map of kind -> number of values replaced.

    ``key`` belongs in a secret store: who has it can undo all. A card number must
    pass the Luhn check and an IBAN its own (and they pass it afterwards), a date
    must exist, an address's numbers be at most 255, a social security number be
    one that can be issued, a secret hold a digit; all else stays. Cards, phone
    numbers, IBANs and addresses keep their notation but are permuted without it,
    so one value has one pseudonym however it is written (IPv6 is written in
    full). Country codes and the domains of mail addresses stay in clear. Phone
    numbers are found with ``+`` and 7 to 15 digits, or as three, three and four
    digits. A secret is the whole run without spaces and double quotes after its
    label (which may be quoted, as in JSON), in any case, or after "Bearer", or a bare key of a known form; as everywhere, only ASCII
    letters and digits are replaced. Null texts stay null, with an empty map; an
    existing column ``private`` is replaced. Equal rows stay equal; texts of any length are read whole.
    """
    columns = [c for c in docs.columns if c != "private"]
    text = F.col("text")
    may = F.coalesce(text.rlike(_MARKS), F.lit(False))
    rows = docs.select(
        *columns,
        F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("__matches"),
    ).withColumn("__found", F.when(F.size("__matches") > 0, F.transform("__matches", lambda m: _found(m, key))))
    gaps = F.split(text, PATTERN)
    filled = F.array_join(F.zip_with(gaps, F.transform("__found", lambda f: f["text"]), lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))), "")
    kinds = F.filter(F.transform(F.coalesce("__found", F.array().cast("array<struct<kind:string,text:string>>")), lambda f: f["kind"]), lambda k: k.isNotNull())
    counts = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value")))
    return rows.select(*(F.when(F.col("__found").isNotNull(), filled).otherwise(text).alias("text") if c == "text" else F.col(c) for c in columns), F.map_from_entries(counts).alias("private"))
