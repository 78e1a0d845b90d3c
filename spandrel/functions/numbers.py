"""Accounting numbers: four grammars that turn a cell's string into a double, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
WIDE = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
#: What accounts write for "no value".
PLACEHOLDERS = ("-", "—", "–", "--", "n/a", "na", "nm", "n/m")
SPACE = r"^(?U)\s+|(?U)\s+$"


def trimmed(s: Column) -> Column:
    """s without leading and trailing white space of any kind."""
    return F.regexp_replace(s, SPACE, "")


def parse_num(s: Column) -> Column:
    """The detectors' grammar: any letter makes it text, brackets anywhere make it negative, other signs are ignored."""
    t = trimmed(s)
    negative = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))
    bare = F.regexp_replace(t, r"[^0-9.\-]", "")
    value = F.when(bare.rlike(PLAIN), bare.cast("double"))
    return F.when(~t.rlike("[A-Za-z]"), F.when(negative, -F.abs(value)).otherwise(value))


def parse_cell(s: Column) -> Column:
    """The materializer's grammar: brackets around the whole, currency, percent and commas dropped, floats as written."""
    t = trimmed(s)
    negative = t.startswith("(") & t.endswith(")")
    bare = F.regexp_replace(t, r"[,$%() ]", "")
    low = F.lower(bare)
    value = F.when(low.rlike(r"(?i)inf"), F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(low.rlike(r"(?i)nan"), F.lit(float("nan"))).otherwise(bare.cast("double"))
    return F.when(bare.rlike("(?i)" + WIDE), F.when(negative, -F.abs(value)).otherwise(value))


def parse_plain(s: Column) -> Column:
    """The probe's grammar: dollar, comma, percent and spaces dropped, one pair of brackets negates."""
    bare = F.regexp_replace(F.coalesce(s, F.lit("")), r"[$,%\s]", "")
    inside = F.when(bare.rlike(r"^\(.*\)$"), F.regexp_replace(bare, r"^\(|\)$", ""))
    value = F.coalesce(inside, bare)
    return F.when(value.rlike("(?i)" + WIDE), F.when(inside.isNotNull(), -value.cast("double")).otherwise(value.cast("double")))


def is_placeholder(s: Column) -> Column:
    return F.lower(trimmed(s)).isin(*PLACEHOLDERS)


def let(value: Column, f) -> Column:
    """f(value) with value worked out once: long chains of steps would else double at every step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: What a step of parse_number is called in the audit trail, and the scale letters.
CURRENCY = "$€£¥"
SCALES = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
STEPS = {"currency": "strip currency", "bracket": "paren→neg", "percent": "percent", "credit": "CR→neg", "after": "trailing−→neg", "scale": "scale ×", "signed": "signed"}


def parse_number(s: Column) -> Column:
    """The typed-table grammar as a struct: value, negative, percent, currency, scale, integral, transforms; null if no number.

    Each step sees what the one before left: currency signs, brackets, percent, one of CR and DR, a minus behind and one in
    front, one scale letter.
    """
    raw = trimmed(F.coalesce(s, F.lit("")))

    def bare_of(t: Column) -> Column:
        """From the text less currency signs: what stands in brackets, less a percent sign, and what was there."""
        bracket = t.startswith("(") & F.contains(t, F.lit(")"))
        inside = trimmed(F.when(bracket, F.regexp_extract(t, r"(?s)^\((.*)\)", 1)).otherwise(t))
        return let(inside, lambda x: F.struct(trimmed(F.regexp_replace(x, "%$", "")).alias("t"), bracket.alias("bracket"), x.endswith("%").alias("percent")))

    def unsigned(x: Column) -> Column:
        credit, debit = x.t.rlike("(?i)cr$"), x.t.rlike("(?i)dr$")
        body = trimmed(F.when(credit | debit, F.regexp_replace(x.t, "(?s)..$", "")).otherwise(x.t))

        def cut(b: Column) -> Column:
            after = b.endswith("-")
            front = trimmed(F.when(after, F.regexp_replace(b, "-$", "")).otherwise(b))
            return let(front, lambda f: F.struct(trimmed(F.regexp_replace(f, "^-", "")).alias("t"), x.bracket.alias("bracket"), x.percent.alias("percent"), credit.alias("credit"), after.alias("after"), f.startswith("-").alias("before")))

        return let(body, cut)

    def made(x: Column) -> Column:
        scaled = x.t.rlike("(?is)[0-9].*[kmbt]$")
        letter = F.lower(F.right(x.t, F.lit(1)))
        scale = F.lit(1.0)
        for name, factor in SCALES.items():
            scale = F.when(scaled & (letter == name), factor).otherwise(scale)
        number = F.replace(trimmed(F.when(scaled, F.regexp_replace(x.t, "(?s).$", "")).otherwise(x.t)), F.lit(","), F.lit(""))
        currency, negative = raw.rlike(f"[{CURRENCY}]"), x.bracket | x.credit | x.after | x.before
        steps = F.array(
            F.when(currency, STEPS["currency"]), F.when(x.bracket, STEPS["bracket"]), F.when(x.percent, STEPS["percent"]), F.when(x.credit, STEPS["credit"]), F.when(x.after, STEPS["after"]),
            *(F.when(scale == f, f"{STEPS['scale']}{f:g}") for f in SCALES.values()), F.when(negative, STEPS["signed"]),
        )
        return let(number, lambda n: F.when(n.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), F.struct(
            (n.cast("double") * scale * F.when(negative, -1.0).otherwise(1.0)).alias("value"), negative.alias("negative"), x.percent.alias("percent"), currency.alias("currency"),
            scale.alias("scale"), (~F.contains(n, F.lit(".")) & (scale == 1.0)).alias("integral"), F.filter(steps, lambda v: v.isNotNull()).alias("transforms"),
        )))

    plain = trimmed(F.regexp_replace(raw, f"[{CURRENCY}]", ""))
    return F.when(~F.lower(raw).isin("", *PLACEHOLDERS), let(let(let(plain, bare_of), unsigned), made))


def sign_fix(s: Column) -> Column:
    """Accounting signs as a leading minus: brackets, a CR suffix and a trailing minus negate, a DR suffix goes."""
    t = trimmed(s)
    has_digit, ascii_only = t.rlike("[0-9]"), ~t.rlike(r"[^\x00-\x7F]")
    inside = F.trim(F.regexp_replace(t, r"^\(|\)$", ""))
    cut = F.trim(F.regexp_replace(t, "(?i)(cr|dr)$", ""))
    return (
        F.when(t.rlike(r"^\(.*\)$") & inside.rlike("[0-9]"), F.concat(F.lit("-"), inside))
        .when(has_digit & ascii_only & t.rlike("(?i)cr$"), F.concat(F.lit("-"), cut))
        .when(has_digit & ascii_only & t.rlike("(?i)dr$"), cut)
        .when(has_digit & t.rlike("-$"), F.concat(F.lit("-"), F.trim(F.regexp_replace(t, "-$", ""))))
        .otherwise(s)
    )
