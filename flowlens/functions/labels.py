"""Protocol, service and label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.common import as_column, collapse_blanks, lookup, strip


def norm_protocol(c: Column | str) -> Column:
    """Protocol text or number to ``struct(name, number)``; blank means tcp."""
    text = F.lower(strip(F.coalesce(as_column(c), F.lit(""))))
    names = {number: name for name, number in S.PROTOCOL_NUMBERS.items()}
    digits = text.rlike("^[0-9]+$")
    number = F.when(digits, text).try_cast("decimal(38,0)")
    name = (
        F.when(text == "", F.lit("tcp"))
        .when(digits, F.coalesce(lookup(names, number.try_cast("int")), text))
        .when(text.isin("http", "https"), F.lit("tcp"))
        .when(text == "dns", F.lit("udp"))
        .otherwise(text)
    )
    code = F.when(digits, number.cast("string")).otherwise(
        F.coalesce(lookup(S.PROTOCOL_NUMBERS, name), F.lit(6)).cast("string")
    )
    return F.struct(name.alias("name"), code.alias("number"))


def alert_protocol(c: Column | str, numbers: bool = True) -> Column:
    """Protocol of an alert; numbers are read for feature rows, not for conn rows."""
    text = F.upper(strip(F.coalesce(as_column(c), F.lit(""))))
    if numbers:
        for name, number in S.PROTOCOL_NUMBERS.items():
            text = F.when(text == str(number), F.lit(name.upper())).otherwise(text)
    known = [p for p in S.PROTOCOLS if p != "Other"]
    return F.when(text.isin(known), text).otherwise(F.lit("Other"))


def guess_service(port: Column | str) -> Column:
    """Service name of a destination port, ``-`` when unknown."""
    return F.coalesce(lookup(S.SERVICE_BY_PORT, as_column(port).cast("int")), F.lit("-"))


def norm_label(c: Column | str) -> Column:
    """Flow label to ``struct(label, class)``: dashes and blanks unified."""
    text = F.translate(F.coalesce(as_column(c), F.lit("")), "–—�", "-- ")
    label = collapse_blanks(text)
    cls = F.coalesce(lookup(S.LABEL_CLASSES, F.upper(label)), label)
    return F.struct(label.alias("label"), cls.alias("class"))


def cic_label(c: Column | str) -> Column:
    """Raw flow label with web attacks in their en-dash spelling."""
    text = strip(c)
    return F.coalesce(lookup(S.CIC_DASH_SPELLINGS, text), text)


def cic_attack_group(c: Column | str) -> Column:
    """Raw flow label to one of nine groups, NULL when unmapped."""
    return lookup(S.CIC_ATTACK_GROUPS, strip(c))


def kdd_label(c: Column | str) -> Column:
    """Lower-case label without its trailing dots."""
    return F.regexp_replace(F.lower(strip(c)), r"[.]+$", "")


def kdd_superclass(c: Column | str) -> Column:
    """KDD label to one of five superclasses, NULL when unmapped."""
    return lookup(S.KDD_CLASS_OF, kdd_label(c))


def map_label10(c: Column | str) -> Column:
    """Flow label to ten classes by substring, earlier rules win."""
    raw = strip(F.coalesce(as_column(c), F.lit("")))
    low = F.lower(raw)
    brute = low.contains("patator") | low.contains("brute force") | low.contains("bruteforce")
    return (
        F.when(raw == "BENIGN", F.lit("BENIGN"))
        .when(low.contains("web attack"), F.lit("WEB_ATTACK"))
        .when(low.contains("infiltration"), F.lit("INFILTRATION"))
        .when(low.contains("ddos"), F.lit("DDOS"))
        .when(low.contains("dos "), F.lit("DOS"))
        .when(low.contains("portscan") | low.contains("port scan"), F.lit("PORTSCAN"))
        .when(low == "bot", F.lit("BOT"))
        .when(brute, F.lit("BRUTE_FORCE"))
        .when(low.contains("heartbleed"), F.lit("HEARTBLEED"))
        .otherwise(F.lit("OTHER"))
    )


def map_label6(c: Column | str) -> Column:
    """Flow label to the six model classes by substring, the rest is OTHER."""
    raw = strip(F.coalesce(as_column(c), F.lit("")))
    low = F.lower(raw)
    brute = low.contains("patator") | low.contains("brute force") | low.contains("bruteforce")
    return (
        F.when(raw == "BENIGN", F.lit("BENIGN"))
        .when(low.contains("ddos"), F.lit("DDOS"))
        .when(low.contains("dos"), F.lit("DOS"))
        .when(low.contains("bot"), F.lit("BOT"))
        .when(brute, F.lit("BRUTE_FORCE"))
        .when(low.contains("portscan"), F.lit("PORTSCAN"))
        .otherwise(F.lit("OTHER"))
    )


def label_to_attack(c: Column | str) -> Column:
    """Raw flow label to alert attack type; unknown labels are DOS."""
    return F.coalesce(lookup(S.LABEL_ATTACK_TYPES, as_column(c)), F.lit("DOS"))


def parse_attack_type(c: Column | str, on_unknown: str = "raise") -> Column:
    """Loosely written attack type to its wire name; blank stays NULL.

    ``on_unknown`` is ``raise`` or ``null`` (rows to quarantine).
    """
    text = strip(as_column(c))
    key = F.translate(F.lower(text), "_ ", "")
    table = {a.lower().replace("_", ""): a for a in S.ATTACK_TYPES}
    found = lookup(table, key)
    if on_unknown == "null":
        return found
    failure = F.raise_error(F.concat(F.lit("unknown attack type: "), text)).cast("string")
    return F.when(as_column(c).isNull() | (as_column(c) == ""), F.lit(None).cast("string")).otherwise(
        F.when(found.isNull(), failure).otherwise(found)
    )


def flow_id(src: Column | str, dst: Column | str, sport: Column | str, dport: Column | str,
            proto: Column | str) -> Column:
    """``src-dst-sport-dport-protocol`` text; a missing port is ``<NA>``."""
    number = F.coalesce(lookup(S.PROTOCOL_NUMBERS, as_column(proto)), F.lit(0))

    def port(c: Column | str) -> Column:
        return F.coalesce(as_column(c).try_cast("double").try_cast("bigint").cast("string"), F.lit("<NA>"))

    def host(c: Column | str) -> Column:
        return F.coalesce(as_column(c), F.lit("nan"))

    return F.concat_ws("-", host(src), host(dst), port(sport), port(dport), number.cast("string"))


def hashed_uid(*columns: Column | str) -> Column:
    """20 hex digits derived from the row key, the same on every run."""
    key = F.concat_ws("~", *[as_column(c).cast("string") for c in columns])
    return F.substring(F.md5(key), 1, 20)


def row_uid(columns: list[str], copy: Column) -> Column:
    """20 hex digits of a whole row and its number among equal rows; NULL is no text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.md5(F.to_json(F.array(*cells, copy.cast("string")))), 1, 20)
