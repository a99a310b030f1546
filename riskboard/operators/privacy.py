"""Masking of personal data before publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Figures and signs may be full-width; a separator may stand between the groups of a number.
_D = "[0-9０-９]"
_GAP = "[ .．\\-－]"
# Numbers that are masked only if their check digit is right, and so may be written in groups:
# identity numbers (6, 8 and 3 figures and a figure or X) and cards (13 to 19 in fours).
IDENTITY = rf"{_D}{{6}}{_GAP}?{_D}{{8}}{_GAP}?{_D}{{3}}{_GAP}?[0-9０-９XxＸｘ]"
CARD = rf"{_D}{{4}}({_GAP}?{_D}{{4}}){{2}}({_GAP}?{_D}{{4}}({_GAP}?{_D}{{1,3}})?|{_GAP}?{_D}{{1,3}})"
# Patterns, applied in this order after those: mail, network addresses, identity numbers
# by their length (an X at the end), phone numbers (bracketed or plain area code; mobile in
# groups of 3-4-4), long runs of figures.
PATTERNS = [
    (r"[\p{L}\p{N}._%+-]+[@＠][\p{L}\p{N}-]+([.．][\p{L}\p{N}-]+)+", "[MAIL]"),
    (r"\b([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|\b[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){0,6}::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){0,6})?", "[ADDR]"),
    (rf"{_D}{{17}}[0-9０-９XxＸｘ]|{_D}{{14}}[XxＸｘ]", "[ID]"),
    (rf"{_D}{{1,3}}[.．]{_D}{{1,3}}[.．]{_D}{{1,3}}[.．]{_D}{{1,3}}", "[ADDR]"),
    (rf"[+＋]?{_D}{{1,3}}[ -]?[(（]{_D}{{2,4}}[)）][ -]?{_D}{{3,4}}[ -]?{_D}{{4}}", "[PHONE]"),
    (rf"([+＋]?(86|８６){_GAP}?)?[1１][3-9３-９]{_D}{_GAP}?{_D}{{4}}{_GAP}?{_D}{{4}}[Xx]?", "[PHONE]"),
    (rf"[(（][0０]{_D}{{2,3}}[)）]{_GAP}?{_D}{{3,4}}{_GAP}?{_D}{{4}}", "[PHONE]"),
    (rf"[0０]{_D}{{2,3}}{_GAP}{_D}{{3,4}}{_GAP}?{_D}{{4}}", "[PHONE]"),
    (rf"{_D}{{9,}}", "[ID]"),
]
_MARK = "\ue000"
_WIDE, _PLAIN = "０１２３４５６７８９ＸｘX", "0123456789xxx"


def _figures(t: Column) -> Column:
    """The figures of a number as plain ones, an X as a small x."""
    return F.regexp_replace(F.translate(t, _WIDE, _PLAIN), "[^0-9x]", "")


def _at(n: Column, i: Column) -> Column:
    return F.substring(n, i, F.lit(1)).try_cast("int")


def valid_identity(t: Column) -> Column:
    """Check digit modulo 11-2: the weights are the powers of two from the right."""
    n = _figures(t)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda s, i: (
        s + _at(n, i) * F.pmod(F.pow(F.lit(2), F.lit(18) - i).cast("int"), F.lit(11))))
    last = F.when(F.endswith(n, F.lit("x")), 10).otherwise(_at(n, F.lit(18)))
    return F.coalesce(F.pmod(total + last, F.lit(11)) == 1, F.lit(False))


def valid_card(t: Column) -> Column:
    """Check digit by doubling each second figure from the right."""
    n = F.reverse(_figures(t))
    total = F.aggregate(F.sequence(F.lit(1), F.length(n)), F.lit(0), lambda s, i: (
        s + F.when(F.pmod(i, F.lit(2)) == 1, _at(n, i)).otherwise(
            F.pmod(_at(n, i) * 2, F.lit(10)) + F.floor(_at(n, i) * 2 / 10).cast("int"))))
    return F.coalesce(F.pmod(total, F.lit(10)) == 0, F.lit(False))


def _checked(c: Column, pattern: str, valid, tag: str) -> Column:
    """The text with those matches masked whose check digit is right."""
    parts = F.split(F.regexp_replace(c, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    whole = f"^({pattern})$"
    told = F.transform(parts, lambda t: F.when(t.rlike(whole), F.when(valid(t), F.lit(tag)).otherwise(t)).otherwise(t))
    return F.when(c.rlike(pattern), F.array_join(told, "")).otherwise(c)


def mask(c: Column) -> Column:
    """Mask one text; texts without an at-sign skip the mail pattern."""
    c = _checked(c, IDENTITY, valid_identity, "[ID]")
    c = _checked(c, CARD, valid_card, "[ID]")
    mail, *rest = PATTERNS
    c = F.when(c.rlike("[@＠]"), F.regexp_replace(c, *mail)).otherwise(c)
    for pattern, tag in rest:
        c = F.regexp_replace(c, pattern, tag)
    return c


def mask_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace mail addresses, phone numbers, network addresses, identity and card numbers
    (with separators where their check digit is right) and long digit runs."""
    return df.withColumns({c: mask(F.col(c)) for c in cols})


def pseudonymise(df: DataFrame, cols: list[str], salt: str) -> DataFrame:
    """Replace ids by a salted hash."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)
                           for c in cols})
