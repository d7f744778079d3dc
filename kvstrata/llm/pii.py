"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A pattern finds candidates; numbers and dates are validated (Luhn for cards, mod 97 for
IBANs, calendar for dates, ranges for the rest), and what is valid is replaced by a
keyed permutation of itself within its format: a Feistel network whose halves are lists
of symbols, each with its own radix, and whose round function is SHA-256 under the key.
Check digits are computed anew. Equal values get equal pseudonyms in all documents, and
different values of a kind get different ones. Digits stay digits, letters stay letters of
their case, so punctuation, length and layout are kept; in phone numbers 0 and 1 stay among
themselves, as they may start no area code. Secrets keep nothing but their alphabet: keys
are permuted over all 36 letters and digits, hex values over all 16 digits of their case
(over digits, small and capital letters apart if they mix the two).

The key is no part of the plan: it comes from a scalar subquery over a table of one row.

Kinds: e-mail addresses (local part), phone numbers, payment cards, IBANs, IPv4
addresses, US social security numbers, ISO and day-first dates, and secrets (AKIA keys,
hex values of password/token/secret/key settings, in either case).

Defined results: a null text stays null; text without valid candidates is returned
unchanged, byte for byte; repeated rows are treated alike; an empty table gives no rows; a
very long text is rewritten whole; all other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> (pattern inside the text, pattern of a whole candidate)
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|token|secret|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']?[0-9a-fA-F]{12,64}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date_iso": r"(?<![0-9A-Za-z-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![0-9A-Za-z-])",
    "date_dmy": r"(?<![0-9A-Za-z/.])(?:0[1-9]|[12]\d|3[01])([/.])(?:0[1-9]|1[0-2])\1(?:19|20)\d{2}(?![0-9A-Za-z/])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?<!\d\.)(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\4\d{4})(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_WHOLE = {
    "email": "@",
    "aws": "^AKIA[A-Z0-9]{16}$",
    "secret": "^(?i:password|passwd|token|secret|api_key|apikey)",
    "iban": r"^[A-Z]{2}\d{2}",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_dmy": r"^\d{2}[/.]\d{2}[/.]\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "card": r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$",
}
ROUNDS = 8
_FIRST_DAY, _DAYS = "1900-01-01", (229, 319)  # 229 * 319 = 73049 days: up to 2099-12-31


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(symbols: str, radices: str, key: str, tweak: str) -> str:
    """SQL of the permuted symbols: ``symbols`` and ``radices`` are SQL of arrays of
    int, symbol i being below radix i; ``key`` is SQL of the key. Halves change places after each of an even number of
    rounds, so that each symbol ends where it began."""
    digest = f"sha2(concat({key}, {_q('|' + tweak + '|')}, r, '|', i, '|', array_join(s.b, ',')), 256)"
    return f"""transform(array(struct({symbols} AS v, {radices} AS m)), z -> aggregate(sequence(1, {ROUNDS}),
      struct(slice(z.v, 1, size(z.v) DIV 2) AS a, slice(z.m, 1, size(z.v) DIV 2) AS ra, slice(z.v, size(z.v) DIV 2 + 1, size(z.v)) AS b, slice(z.m, size(z.v) DIV 2 + 1, size(z.v)) AS rb),
      (s, r) -> struct(s.b AS a, s.rb AS ra, transform(s.a, (x, i) -> CAST(pmod(x + CAST(conv(substring({digest}, 1, 12), 16, 10) AS BIGINT), s.ra[i]) AS INT)) AS b, s.ra AS rb),
      s -> concat(s.a, s.b)))[0]"""


#: Classes of characters that stay among themselves.
_DIGITS, _PHONE = ["0123456789"], ["01", "23456789"]
_LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def _by_class(value: str, classes: list[str], key: str, tweak: str) -> str:
    """SQL of a text whose characters of the classes are permuted, each within its
    class; all other characters stay."""
    case = lambda of: "CASE " + " ".join(f"WHEN locate(c, '{k}') > 0 THEN {of(k)}" for k in classes)
    inside = "[" + "".join(dict.fromkeys("".join(classes))) + "]"
    chars = f"filter(split({value}, ''), c -> c RLIKE '{inside}')"
    symbols = f"transform({chars}, c -> {case(lambda k: f"locate(c, '{k}') - 1")} END)"
    radices = f"transform({chars}, c -> {case(lambda k: str(len(k)))} END)"
    # Walk over all characters; the n-th of a class takes the n-th permuted symbol.
    back = "CASE " + " ".join(f"WHEN locate(c, '{k}') > 0 THEN substring('{k}', p.y[w.n] + 1, 1)" for k in classes) + " ELSE c END"
    return f"""transform(array(struct({feistel(symbols, radices, key, tweak)} AS y)), p -> aggregate(split({value}, ''), struct('' AS o, 0 AS n),
      (w, c) -> struct(concat(w.o, {back}) AS o, w.n + CAST(c RLIKE '{inside}' AS INT) AS n), w -> w.o))[0]"""


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum (mod 10) of a string of digits, the last one not doubled."""
    return f"pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 DIV 10 + CAST(c AS INT) * 2 % 10 END), 0L, (s, x) -> s + x), 10)"


def _mod97(text: str) -> str:
    """SQL of an IBAN's remainder: its letters as 10..35, first four characters last."""
    return f"aggregate(split(concat(substring({text}, 5), substring({text}, 1, 4)), ''), 0, (s, c) -> CASE WHEN c RLIKE '[0-9]' THEN (s * 10 + CAST(c AS INT)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"


def _refill(layout: str, plain: str) -> str:
    """SQL of ``plain`` with the blanks and dashes of ``layout`` put where they were."""
    return f"aggregate(split({layout}, ''), struct('' AS o, 1 AS n), (w, c) -> struct(concat(w.o, CASE WHEN c IN (' ', '-') THEN c ELSE substring({plain}, w.n, 1) END) AS o, w.n + CAST(c NOT IN (' ', '-') AS INT) AS n), w -> w.o)"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def replacement(key: str) -> str:
    """SQL of the pseudonym of a candidate ``v``, ``key`` being SQL of the key; the
    candidate itself if not valid."""
    email = f"concat({_by_class("substring_index(v, '@', 1)", _DIGITS + _LETTERS, key, 'email')}, '@', substring_index(v, '@', -1))"
    aws = f"concat('AKIA', {_by_class('substring(v, 5)', [_DIGITS[0] + _LETTERS[1]], key, 'aws')})"
    value = "regexp_extract(v, '([0-9a-fA-F]{12,64})$', 1)"
    hexes = [("x NOT RLIKE '[A-F]'", ["0123456789abcdef"]), ("x NOT RLIKE '[a-f]'", ["0123456789ABCDEF"]), ("true", [*_DIGITS, "abcdef", "ABCDEF"])]
    permuted = "CASE " + " ".join(f"WHEN {test} THEN {_by_class('x', classes, key, 'secret')}" for test, classes in hexes) + " END"
    secret = f"concat(substring(v, 1, length(v) - length({value})), {_bind(value, 'x', permuted)})"
    # Cards: first digit stays, the rest but the check digit is permuted.
    d = "regexp_replace(v, '[ -]', '')"
    body = f"concat(substring(d, 1, 1), {_by_class('substring(d, 2, length(d) - 2)', ['0123456789'], key, 'card')})"
    card = _bind(d, "d", f"CASE WHEN {_luhn('d')} <> 0 OR d RLIKE '^0+$' THEN v ELSE {_bind(body, 'e', _bind(f"concat(e, CAST(pmod(10 - {_luhn("concat(e, '0')")}, 10) AS STRING))", 'f', _refill('v', 'f')))} END")
    i = "regexp_replace(v, ' ', '')"
    bban = _by_class("substring(d, 5)", ["0123456789", _LETTERS[1]], key, "iban")
    iban = _bind(i, "d", f"CASE WHEN {_mod97('d')} <> 1 THEN v ELSE {_bind(f"concat(substring(d, 1, 2), '00', {bban})", 'e', _bind(f"concat(substring(e, 1, 2), lpad(CAST(98 - {_mod97('e')} AS STRING), 2, '0'), substring(e, 5))", 'f', _refill('v', 'f')))} END")
    # IPv4: octets; the first stays within 1..255.
    ip = _bind(f"transform(split(v, '[.]'), (c, i) -> CAST(c AS INT) - CAST(i = 0 AS INT))", "o", f"CASE WHEN o[0] < 0 THEN v ELSE array_join(transform({feistel('o', 'array(255, 256, 256, 256)', key, 'ip')}, (x, i) -> CAST(x + CAST(i = 0 AS INT) AS STRING)), '.') END")
    # Social security numbers: area 1..899 without 666, group 1..99, serial 1..9999.
    part = lambda at, n: f"CAST(substring(v, {at}, {n}) AS INT)"
    area = f"{part(1, 3)} - CASE WHEN {part(1, 3)} > 666 THEN 2 ELSE 1 END"
    valid = f"{part(1, 3)} BETWEEN 1 AND 899 AND {part(1, 3)} <> 666 AND {part(5, 2)} > 0 AND {part(8, 4)} > 0"
    s = feistel(f"array({area}, {part(5, 2)} - 1, {part(8, 4)} - 1)", "array(898, 99, 9999)", key, "ssn")
    ssn = f"CASE WHEN {valid} THEN {_bind(s, 's', "concat(lpad(CAST(s[0] + CASE WHEN s[0] >= 665 THEN 2 ELSE 1 END AS STRING), 3, '0'), '-', lpad(CAST(s[1] + 1 AS STRING), 2, '0'), '-', lpad(CAST(s[2] + 1 AS STRING), 4, '0'))")} ELSE v END"

    def date(text: str, layout: str) -> str:
        """Days since the first day, as two mixed-radix symbols."""
        a, b = _DAYS
        n = f"datediff(try_to_date({text}, '{layout}'), DATE'{_FIRST_DAY}')"
        y = feistel(f"array(CAST(n DIV {b} AS INT), CAST(n % {b} AS INT))", f"array({a}, {b})", key, "date")
        new = _bind(y, "y", f"date_format(date_add(DATE'{_FIRST_DAY}', CAST(y[0] * {b} + y[1] AS INT)), '{layout}')")
        return _bind(n, "n", f"CASE WHEN n IS NULL THEN NULL ELSE {new} END")

    iso = f"coalesce({date('v', 'yyyy-MM-dd')}, v)"
    dmy = f"coalesce(replace({date("replace(v, '.', '/')", 'dd/MM/yyyy')}, '/', substring(v, 3, 1)), v)"
    head = r"regexp_extract(v, '^(\\+\\d{1,3})', 1)"
    phone = f"CASE WHEN length(regexp_replace(v, '[^0-9]', '')) BETWEEN 8 AND 15 THEN concat({head}, {_by_class(f'substring(v, length({head}) + 1)', _PHONE, key, 'phone')}) ELSE v END"
    sql = {"email": email, "aws": aws, "secret": secret, "iban": iban, "date_iso": iso, "date_dmy": dmy, "ssn": ssn, "ip": ip, "card": card}
    return "CASE " + " ".join(f"WHEN v RLIKE {_q(_WHOLE[k])} THEN {e}" for k, e in sql.items()) + f" ELSE {phone} END"


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; all other columns unchanged. A narrow
    projection: no shuffle, no Python."""
    c = "`" + text_col.replace("`", "``") + "`"
    p = _q(PATTERN)
    name = "__key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    new = f"transform(regexp_extract_all({c}, {p}, 0), v -> {replacement(name)})"
    woven = f"array_join(flatten(zip_with(split({c}, {p}, -1), concat({new}, array('')), (g, x) -> array(g, x))), '')"
    text = F.expr(f"CASE WHEN {c} RLIKE {p} THEN {woven} ELSE {c} END")
    return keyed.select(*[text.alias(n) if n == text_col else F.col("`" + n.replace("`", "``") + "`") for n in docs.columns])
