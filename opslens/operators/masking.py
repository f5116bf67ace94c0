"""Sensitive values replaced by pseudonyms under a key, as an alternative to leaving columns out.

A pseudonym is taken from the HMAC (SHA-256) of the value, so equal values stay equal within and across tables masked under
one key, and can be joined; without the key they cannot be guessed and tried. Numbers keep how many digits they have and the
signs between: their digits are permuted by a Feistel network whose rounds add HMACs, so different numbers stay different.
Other values become "x" and 16 digits of the HMAC. In free text only the sensitive spans are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from opslens.functions.coerce import plain_text
from opslens.operators.privacy import VALUE_RULES

# Block size and pads of HMAC with SHA-256.
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C

#: Texts of digits and signs only, like telephone, card and account numbers.
NUMBER_LIKE = r"^[+(]?\d[\d\s().+/-]*$"
_SIGNS = "().+/- \t\n\x0b\f\r"
_ROUNDS, _LONGEST = 8, 36


def hmac_hex(key: str, value: Column) -> Column:
    """HMAC with SHA-256 of a text, in hex."""
    secret = key.encode() if len(key.encode()) <= _BLOCK else hashlib.sha256(key.encode()).digest()
    pad = lambda byte: F.lit(bytearray(b ^ byte for b in secret.ljust(_BLOCK, b"\0")))
    return F.sha2(F.concat(pad(_OUTER), F.unhex(F.sha2(F.concat(pad(_INNER), value.cast("binary")), 256))), 256)


def pseudonym(key: str, value: Column) -> Column:
    """The replacement of a text; NULL stays NULL."""
    def placed(v: Column) -> Column:
        """The new digits where the text has digits."""
        at = lambda i: F.length(F.translate(F.substring(v["text"], F.lit(1), i + 1), _SIGNS, ""))
        mixed = F.array_join(F.transform(F.split(v["text"], ""), lambda c, i: F.when(
            (c >= "0") & (c <= "9"), F.substring(v["digits"], at(i), F.lit(1))).otherwise(c)), "")
        return F.when(F.length(v["text"]) == F.length(v["digits"]), v["digits"]).otherwise(mixed)

    def number(text: Column) -> Column:
        return _bound(F.struct(text.alias("text"), permuted(key, F.regexp_replace(text, r"\D", "")).alias("digits")), placed)

    return F.when(value.isNotNull(), _bound(value, lambda text: F.when(text.rlike(NUMBER_LIKE), number(text)).otherwise(
        F.concat(F.lit("x"), F.substring(hmac_hex(key, text), 1, 16)))))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def permuted(key: str, digits: Column) -> Column:
    """A text of digits turned into another of the same length; no two into the same. Those of more than 36 digits are replaced
    by digits of their HMAC, repeated."""
    def rounds(v: Column) -> Column:
        d, n, left, right = (v[x] for x in ("d", "n", "left", "right"))
        part = lambda start, size: F.coalesce(F.substring(d, start, size).try_cast("bigint"), F.lit(0).cast("bigint"))
        added = lambda i, half: F.conv(F.substring(hmac_hex(key, F.concat(i.cast("string"), v["told"], half.cast("string"))), 1, 15), 16, 10).cast("bigint")

        def two(state: Column, i: Column) -> Column:
            """An even round changes the left half, the odd one after it the right half."""
            turned = (state["a"] + added(i, state["b"])) % v["left_size"]
            return _bound(turned, lambda a: F.struct(a.alias("a"), ((state["b"] + added(i + 1, a)) % v["right_size"]).alias("b")))

        start = F.struct(part(F.lit(1), left).alias("a"), part(left + 1, right).alias("b"))
        written = lambda x, places: F.lpad(x.cast("string"), places, F.lit("0"))
        mixed = F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 2), F.lit(2)), start, two, lambda s: F.concat(
            F.when(left > 0, written(s["a"], left)).otherwise(""), written(s["b"], right)))
        long = F.rpad(F.lit(""), n, F.translate(hmac_hex(key, d), "abcdef", "012345"))
        return F.when(n <= _LONGEST, mixed).otherwise(long)

    def sizes(d: Column) -> Column:
        """What all rounds need, worked out once."""
        n = F.length(d)
        left = F.shiftright(n, 1)
        size = lambda places: F.pow(F.lit(10.0), F.least(places, F.lit(_LONGEST // 2))).cast("bigint")
        return F.struct(d.alias("d"), n.alias("n"), left.alias("left"), (n - left).alias("right"), size(left).alias("left_size"),
                        size(n - left).alias("right_size"), F.concat(F.lit(":"), n.cast("string"), F.lit(":")).alias("told"))

    return _bound(_bound(digits, sizes), rounds)


def masked_spans(key: str, text: Column, rules: Sequence[str]) -> Column:
    """A text whose spans that match any of the value rules are replaced; NULL stays NULL."""
    pattern = "|".join(f"(?:{VALUE_RULES[r][0]})" for r in VALUE_RULES if r in rules)

    def joined(parts: Column) -> Column:
        return F.array_join(F.zip_with(parts["between"], parts["found"], lambda b, f: F.concat(
            F.coalesce(b, F.lit("")), F.coalesce(pseudonym(key, f), F.lit("")))), "")

    parts = F.struct(F.split(text, pattern).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.isNotNull(), _bound(parts, joined))


def masked(df: DataFrame, findings: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """The table with its sensitive columns masked, as text.

    Columns flagged by their values alone have the spans that rules found replaced; those flagged by header, or as
    identifiers, have whole values replaced.
    """
    if not key:
        raise ValueError("masking needs a key")
    reason = {text: rule for rule, (_, _, text) in VALUE_RULES.items()}

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name not in findings:
            return c
        rules = [reason.get(r) for r in findings[f.name]]
        text = plain_text(c, f.dataType)
        return (masked_spans(key, text, rules) if rules and all(rules) else pseudonym(key, text)).alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])
