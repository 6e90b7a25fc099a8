"""Severity, score and text rules of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.common import as_column, lookup, lookup_list, quoted, strip


def severity_rank(c: Column | str, base: int = 0) -> Column:
    """Low..Critical as 0..3 (policy) or 1..4 (dashboard, ``base=1``)."""
    return lookup({k: v + base for k, v in S.SEVERITY_RANK.items()}, c)


def _at_least(rank: Column, attack: Column) -> Column:
    """Raise a severity rank to the floor of its attack type and name it."""
    floor = lookup({a: S.SEVERITY_RANK[s] for a, s in S.SEVERITY_FLOOR.items()}, attack)
    names = F.array(*[F.lit(s) for s in S.SEVERITIES])
    return F.get(names, F.greatest(rank, F.coalesce(floor, F.lit(0))))


def severity(score: Column | str, attack: Column | str) -> Column:
    """Severity of a scored alert: score bands and attack type, then the floor."""
    score, attack = as_column(score), as_column(attack)
    rank = (
        F.when(score >= 0.9, F.lit(3))
        .when((score >= 0.75) | attack.isin(S.HIGH_BY_TYPE), F.lit(2))
        .when((score >= 0.4) | (attack == "PORTSCAN"), F.lit(1))
        .otherwise(F.lit(0))
    )
    return _at_least(rank, attack)


def severity_policy(score: Column | str, attack: Column | str) -> Column:
    """Severity fixed per attack type; score bands only for unknown types."""
    score, attack = as_column(score), as_column(attack)
    fixed = lookup({a: S.SEVERITY_RANK[s] for a, s in S.SEVERITY_POLICY.items()}, attack)
    by_score = (
        F.when(score >= 0.9, F.lit(3))
        .when(score >= 0.6, F.lit(2))
        .when(score >= 0.3, F.lit(1))
        .otherwise(F.lit(0))
    )
    return _at_least(F.coalesce(fixed, by_score), attack)


def malicious_score(p_benign: Column | str) -> Column:
    """``1 - P(BENIGN)`` held between 0 and 0.999."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.lit(1.0) - as_column(p_benign)))


def label_of_class(cls: Column | str) -> Column:
    return F.when(as_column(cls) == "BENIGN", F.lit("benign")).otherwise(F.lit("malicious"))


def class_labels(probabilities: Column | str, classes: list[str] | None = None) -> Column:
    """Class name of every position of a probability array; its number past the known ones."""
    known = F.array(*[F.lit(n) for n in classes or S.CLASS_NAMES])
    return F.transform(as_column(probabilities), lambda _, i: F.coalesce(F.get(known, i), i.cast("string")))


def top_index(probabilities: Column | str) -> Column:
    """Position of the first maximum."""
    p = as_column(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_class(probabilities: Column | str, classes: list[str] | None = None) -> Column:
    """``struct(index, name, probability, probabilities)`` of the most probable class.

    ``probabilities`` is an array in class order; the first maximum wins. A position past
    the known classes is named by its number.
    """
    p = as_column(probabilities)
    label, index = class_labels(p, classes), top_index(p)
    return F.struct(
        index.alias("index"),
        F.get(label, index).alias("name"),
        F.array_max(p).alias("probability"),
        F.map_from_arrays(label, p).alias("probabilities"),
    )


def class_to_attack(name: Column | str) -> Column:
    """Class name to attack type; classes outside the enumeration are DOS."""
    return F.when(as_column(name).isin(S.ATTACK_TYPES), as_column(name)).otherwise(F.lit("DOS"))


def label_from_score(label: Column | str, score: Column | str) -> Column:
    """Malicious when the flow label is an attack and the score is at least one half."""
    hit = (as_column(label) != "BENIGN") & (as_column(score) >= 0.5)
    return F.when(hit, F.lit("malicious")).otherwise(F.lit("benign"))


def top_k_map(m: Column | str, k: int) -> Column:
    """The ``k`` map entries with the largest values, in falling order."""
    def falling(a: Column, b: Column) -> Column:
        return (
            F.when(a["value"] > b["value"], F.lit(-1))
            .when(a["value"] < b["value"], F.lit(1))
            .otherwise(F.lit(0))
        )

    return F.slice(F.array_sort(F.map_entries(as_column(m)), falling), 1, k)


def display_confidence(score: Column | str, label: Column | str) -> Column:
    """``struct(value, title, percent)`` shown for an alert."""
    clipped = F.least(F.greatest(as_column(score), F.lit(0.0)), F.lit(1.0))
    benign = as_column(label) == "benign"
    value = F.when(benign, F.lit(1.0) - clipped).otherwise(clipped)
    title = F.when(benign, F.lit(S.CONFIDENCE_TEXT["benign"])).otherwise(
        F.lit(S.CONFIDENCE_TEXT["malicious"])
    )
    return F.struct(value.alias("value"), title.alias("title"), percent(value).alias("percent"))


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", as_column(c) * F.lit(100.0))


def endpoint(ip: Column | str, port: Column | str) -> Column:
    return F.concat_ws(":", as_column(ip), as_column(port).cast("string"))


def endpoints(df: DataFrame) -> Column:
    """``src:port → dst:port`` of an alert row."""
    return F.concat_ws(
        " → ", endpoint(df["src_ip"], df["src_port"]), endpoint(df["dst_ip"], df["dst_port"])
    )


def attack_label(c: Column | str) -> Column:
    """Display name of an attack type; unknown names lose their underscores."""
    c = as_column(c)
    return F.coalesce(lookup(S.ATTACK_TEXT, c), F.replace(c, F.lit("_"), F.lit(" ")))


def severity_label(c: Column | str) -> Column:
    return F.coalesce(lookup(S.SEVERITY_TEXT, c), as_column(c))


def attack_briefing(attack: Column | str) -> Column:
    """``struct(summary, playbook)`` attached to an alert when it is written."""
    summary = F.coalesce(lookup(S.ATTACK_SUMMARY, attack), F.lit(S.ATTACK_SUMMARY["DOS"]))
    steps = F.coalesce(lookup_list(S.ATTACK_PLAYBOOKS, attack), F.array().cast("array<string>"))
    return F.struct(summary.alias("summary"), steps.alias("playbook"))


def incident_context(attack: Column | str, meta: Column | str) -> Column:
    """``struct(title, summary, playbook)`` shown for an alert.

    Values in the alert's own metadata win over the tables.
    """
    attack = as_column(attack)
    title = F.coalesce(lookup(S.INCIDENT_TITLES, attack), attack_label(attack))
    summary = F.coalesce(
        F.nullif(meta_field(meta, "summary"), F.lit("")),
        lookup(S.INCIDENT_TITLES, attack),
        attack,
    )
    own = F.from_json(F.get_json_object(as_column(meta), "$.playbook"), "array<string>")
    fallback = F.coalesce(
        lookup_list(S.FALLBACK_PLAYBOOKS, attack),
        F.array(*[F.lit(x) for x in S.FALLBACK_PLAYBOOKS["DOS"]]),
    )
    steps = F.when(F.size(own) > 0, own).otherwise(fallback)
    return F.struct(title.alias("title"), summary.alias("summary"), steps.alias("playbook"))


def meta_field(meta: Column | str, name: str) -> Column:
    """One field of the JSON metadata as unquoted text."""
    return F.get_json_object(as_column(meta), f"$.{name}")


def dataset_label(meta: Column | str) -> Column:
    """Dataset shown for an alert: label, else dataset source, else writer."""
    fields = ("dataset_label", "dataset_source", "source")
    return F.coalesce(*[F.nullif(meta_field(meta, f), F.lit("")) for f in fields])


def with_meta(meta: Column | str, **fields: Column) -> Column:
    """JSON metadata with the given top-level fields set; NULL fields are left out.

    Other fields keep their value, nested ones included.
    """
    empty = F.parse_json(F.lit("{}"))
    old = F.coalesce(F.parse_json(as_column(meta)), empty).cast("map<string,variant>")
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(fields)))
    pairs = [x for n, v in fields.items() for x in (F.lit(n), v.cast("variant"))]
    added = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.to_json(F.map_concat(kept, added))


def tag_dataset(df: DataFrame, source: str, dataset_id: str | None = None) -> DataFrame:
    """Write the dataset an alert came from into its metadata."""
    fields = {
        "dataset_label": F.lit(S.DATASET_TEXT[source]),
        "dataset_source": F.lit(source),
    }
    if dataset_id:
        fields["dataset_id"] = F.lit(dataset_id)
    return df.withColumn("meta", with_meta("meta", **fields))


def original_label(df: DataFrame) -> Column:
    """Label of a feature row: the first label column the file has."""
    present = [c for c in S.ORIGINAL_LABEL_COLUMNS if c in df.columns]
    return quoted(present[0]) if present else F.lit(None).cast("string")


def first_present(df: DataFrame, names: list[str]) -> Column:
    """First non-blank value among the named columns that exist, else empty text."""
    values = []
    for name in [n for n in names if n in df.columns]:
        text = strip(F.replace(quoted(name).cast("string"), F.lit("﻿"), F.lit("")))
        values.append(F.nullif(text, F.lit("")))
    return F.coalesce(*values, F.lit(""))
