"""One profile per cluster: evidence, surviving values, confidence, reasons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import fixed, pyround, sorted_ignoring_case, strip
from ..plans.scratch import Scratch
from .order import numbered
from .resolve import pairwise_signals

# --- Fixed values: they decide results and are stated as the specification has them. ---
FIELDS = ["full_name", "email", "phone", "country", "skills", "date_of_birth", "experience_yrs"]
TRUST = {"ATS": 1.0, "Resume": 0.95, "CSV": 0.90, "Notes": 0.80}
UNKNOWN_TRUST, HIGH_TRUST = 0.5, 0.9
AGREEMENT = [0.0, 0.85, 0.92, 0.96, 0.99]  # by the number of sources, the last for all more
OVERALL_WEIGHTS = {"full_name": 2.0, "email": 2.0, "phone": 1.5, "country": 1.0, "skills": 1.0, "experience_yrs": 1.0, "date_of_birth": 0.5}
REVIEW_BELOW = 0.75
# --- End of fixed values. ---

_SCALARS = ["full_name", "email", "phone", "country", "date_of_birth"]
_PENALISED = ["full_name", "email", "phone", "country"]


def agreement_base(n: Column) -> Column:
    out = F.when(n <= 0, AGREEMENT[0])
    for k in (1, 2, 3):
        out = out.when(n == k, AGREEMENT[k])
    return out.otherwise(AGREEMENT[4])


def trust(source_type: Column, weights: dict[str, float] | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (weights or TRUST).items() for x in p]), source_type), F.lit(UNKNOWN_TRUST))


_EVIDENCE = ["seq", "source_type", "source_tag", "priority", *_SCALARS, "experience_yrs"]


def _cut(rows: DataFrame) -> DataFrame:
    """A row per record and scalar field with a value, where the record is."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(None).cast("double").alias("num")) for f in _SCALARS]
    parts.append(F.struct(F.lit("experience_yrs").alias("field"), F.col("experience_yrs").cast("string").alias("value"), F.col("experience_yrs").alias("num")))
    long = rows.select("cluster_id", "seq", "source_type", "source_tag", "priority", F.explode(F.array(*parts)).alias("e"))
    return long.select("cluster_id", "e.field", "e.value", "e.num", "source_type", "source_tag", "priority", "seq").where("value is not null and value != ''")


def evidence(rows: DataFrame) -> DataFrame:
    """A row per record and scalar field with a value (experience as text and as a number).

    Records move to their cluster's task before they are cut into fields; what is grouped by cluster and more after that stays there.
    """
    return _cut(rows.select("cluster_id", *_EVIDENCE).repartition("cluster_id"))


def _reasons() -> Column:
    """What a value of a field is chosen by: the largest wins."""
    name, phone = F.col("field") == "full_name", F.col("field") == "phone"
    digits = F.length(F.regexp_replace("value", r"\D", "")).cast("long")
    return F.struct(
        F.when(F.col("field") == "experience_yrs", F.col("num")).alias("largest"),
        F.when(name, F.length("value").cast("long")).otherwise(F.col("support")).alias("first"),
        F.when(name, F.col("support")).when(phone, digits).otherwise(F.col("priority").cast("long")).alias("second"),
        F.col("priority").cast("long").alias("third"),
        F.col("value"),
        F.col("num"),
    )


def survivors(long: DataFrame, n: int = 3) -> DataFrame:
    """The value that wins each field, the largest by the field's order of reasons.

    ``variants`` are the ``n`` smallest different values (no more of them meet in one row), ``distinct_values`` how many differ in more than case.
    """
    values = long.groupBy("cluster_id", "field", "value").agg(F.count("*").alias("support"), F.max("priority").alias("priority"), F.max("num").alias("num"))
    # places within a cluster, from those where its field begins: rows that are at their cluster's task stay there
    cluster = Window.partitionBy("cluster_id")
    place = F.row_number().over(cluster.orderBy("field", "value")) - F.rank().over(cluster.orderBy("field"))
    placed = values.withColumn("loose", strip(F.lower("value"))).withColumn("place", place).withColumn("kind", F.dense_rank().over(cluster.orderBy("field", "loose")))
    kinds = (F.max("kind") - F.min("kind") + 1).cast("long")
    best = placed.groupBy("cluster_id", "field").agg(F.max(_reasons()).alias("w"), F.collect_list(F.when(F.col("place") < n, F.col("value"))).alias("variants"), kinds.alias("distinct_values"))
    return best.select("cluster_id", "field", F.col("w.value").alias("selected"), F.col("w.num").alias("selected_num"), "variants", "distinct_values")


def _supports() -> Column:
    loose = strip(F.lower("value")) == strip(F.lower("selected"))
    return F.when(F.col("field") == "experience_yrs", F.col("num") == F.col("selected_num")).when(F.col("field").isin("email", "full_name", "country"), loose).otherwise(F.col("value") == F.col("selected"))


def confidence_of(base: Column, trusted: Column, penalty: Column) -> Column:
    return pyround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (0.6 + 0.4 * trusted) - penalty)), 2)


def string_penalty(distinct: Column, n: Column) -> Column:
    return F.when(n > 1, F.least(F.lit(0.15), 0.20 * (distinct - 1) / n)).otherwise(0.0)


def variance_penalty(deviation: Column, n: Column) -> Column:
    return F.when(n > 1, F.least(F.lit(0.30), 0.05 * deviation)).otherwise(0.0)


def _penalty() -> Column:
    known, texts = F.col("field") == "experience_yrs", F.col("field").isin(_PENALISED)
    return F.when(known, variance_penalty(F.col("deviation"), F.col("n"))).when(texts, string_penalty(F.col("distinct_values"), F.col("n"))).otherwise(0.0)


def field_confidence(long: DataFrame, won: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Confidence, trust, penalty, sources and reasons per cluster and scalar field."""
    # a cluster's fields as one row, so that both sides are joined where they are
    known = F.map_from_entries(F.collect_list(F.struct("field", F.struct("selected", "selected_num", "variants", "distinct_values"))))
    rows = long.join(won.groupBy("cluster_id").agg(known.alias("won")), "cluster_id").withColumn("won", F.col("won")[F.col("field")])
    rows = rows.select(*long.columns, "won.*").withColumn("yes", _supports()).withColumn("trust", trust(F.col("source_type"), weights))
    tagged = F.array_sort(F.collect_list(F.when(F.col("yes"), F.struct("seq", "source_tag", "source_type", "trust"))))
    # numbers are shown all, of other values the first three that differ
    numbers = F.array_sort(F.collect_list(F.when(F.col("field") == "experience_yrs", F.struct("seq", "value"))))
    stats = rows.groupBy("cluster_id", "field", "selected", "selected_num").agg(
        F.count("*").alias("n"),
        F.count_if("yes").alias("support"),
        F.first("distinct_values").alias("distinct_values"),
        F.stddev_pop("num").alias("deviation"),
        tagged.alias("tagged"),
        numbers.alias("numbers"),
        F.first("variants").alias("variants"),
    )
    # added up in the order of the records: means that lie on half a digit depend on it
    total = F.aggregate("tagged", F.lit(0.0), lambda a, x: a + x["trust"])
    stats = stats.withColumn("trusted", F.when(F.col("support") > 0, total / F.col("support")))
    base = agreement_base(F.col("support"))
    number = F.col("field") == "experience_yrs"
    stats = stats.withColumn("base", base).withColumn("trusted", F.coalesce("trusted", F.lit(0.0))).withColumn("penalty", _penalty())
    stats = stats.withColumn("confidence", confidence_of(F.col("base"), F.col("trusted"), F.col("penalty")))
    high = F.transform(F.filter("tagged", lambda x: x["trust"] >= HIGH_TRUST), lambda x: x["source_type"])
    numbers = F.array_join(F.transform("numbers", lambda x: x["value"]), ", ")
    variants = F.array_join(F.array_sort("variants"), ", ")
    conflict = F.col("penalty") > 0.01
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("Present in "), F.col("support").cast("string"), F.lit(" source(s) → agreement base "), fixed(F.col("base"), 2)),
            F.concat(F.lit("Trust-weighted score: "), fixed(F.col("trusted"), 2)),
            F.when(F.size(high) > 0, F.concat(F.lit("High trust source confirmed: "), F.array_join(high, ", "))),
            F.when(conflict, F.concat(F.lit("Conflict penalty: -"), fixed(F.col("penalty"), 2), F.when(number, F.concat(F.lit(" (values: "), numbers)).otherwise(F.concat(F.lit(" (variants: "), variants)), F.lit(")"))),
            F.concat(F.lit("Final calibrated confidence: "), fixed(F.col("confidence"), 2)),
        )
    )
    sources = F.transform("tagged", lambda x: x["source_tag"])
    return stats.select("cluster_id", "field", "selected", "selected_num", "support", "base", "confidence", pyround(F.col("trusted"), 2).alias("trust_score"), pyround(F.col("penalty"), 2).alias("penalty"), sources.alias("sources"), reasons.alias("reasoning"), conflict.alias("conflict"))


def _type_mean(weights: dict[str, float] | None) -> Column:
    of_type = F.transform(F.array_sort("types"), lambda t: trust(t, weights))
    return F.aggregate(of_type, F.lit(0.0), lambda a, x: a + x) / F.size("types")


def skills_confidence(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The union of a cluster's skills, with confidence by its distinct sources."""
    long = rows.select("cluster_id", "source_type", "source_tag", F.explode("skills").alias("skill"))
    # of spellings that differ in case the first in code-point order would be as good; both stay, as in a list of exact values
    skills = long.groupBy("cluster_id").agg(sorted_ignoring_case(F.collect_set("skill")).alias("skills"), F.array_sort(F.collect_set("source_tag")).alias("sources"), F.collect_set("source_type").alias("types"))
    base = agreement_base(F.size("sources"))
    out = skills.withColumn("base", base).withColumn("trusted", _type_mean(weights))
    out = out.withColumn("confidence", confidence_of(F.col("base"), F.col("trusted"), F.lit(0.0)))
    reasons = F.array(
        F.concat(F.lit("Skills from "), F.size("sources").cast("string"), F.lit(" source(s) → agreement base "), fixed(F.col("base"), 2)),
        F.concat(F.lit("Trust-weighted score: "), fixed(F.col("trusted"), 2)),
        F.concat(F.lit("Total "), F.size("skills").cast("string"), F.lit(" canonical skills extracted")),
        F.concat(F.lit("Final calibrated confidence: "), fixed(F.col("confidence"), 2)),
    )
    return out.select("cluster_id", "skills", "base", "confidence", pyround(F.col("trusted"), 2).alias("trust_score"), F.lit(0.0).alias("penalty"), "sources", reasons.alias("reasoning"), F.lit(False).alias("conflict"))


def overall_confidence(of: dict[str, Column]) -> Column:
    """The weighted mean of the confidences that are there; 0 without any."""
    top = sum((F.coalesce(of[f] * w, F.lit(0.0)) for f, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(of[f].isNotNull(), w).otherwise(0.0) for f, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    return F.when(weight > 0, pyround(top / weight, 2)).otherwise(0.0)


_ORDER = ["coalesce(email, '')", "coalesce(full_name, '')", "coalesce(phone, '')", "cluster_id"]
_META = ["confidence", "trust_score", "penalty", "sources", "reasoning", "conflict"]


def profiles(rows: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, *, matched: bool = True) -> DataFrame:
    """One row per cluster: the canonical fields, a ``meta_<field>`` struct each, and the cluster's scores; ``weights`` are other trusts of the source types.

    Without ``matched`` the ``match_probability`` is null, for results that don't show it.
    """
    long = evidence(rows)
    scalar = field_confidence(long, survivors(long), weights).select("cluster_id", "field", F.struct("selected", "selected_num", *_META).alias("m"))
    wide = scalar.groupBy("cluster_id").pivot("field", [*_SCALARS, "experience_yrs"]).agg(F.first("m"))
    skilled = skills_confidence(rows, weights).select("cluster_id", F.struct(F.col("skills").alias("selected"), *_META).alias("skills"))
    clusters = rows.groupBy("cluster_id").agg(F.count("*").alias("n_records"))
    joined = clusters.join(wide, "cluster_id", "left").join(skilled, "cluster_id", "left")
    meta = {f: F.when(F.col(f).isNotNull(), F.struct(*[F.col(f)[k].alias(k) for k in _META])).alias(f"meta_{f}") for f in FIELDS}
    values = {f: F.col(f)["selected_num" if f == "experience_yrs" else "selected"].alias(f) for f in FIELDS}
    values["skills"] = F.coalesce(values["skills"], F.array().cast("array<string>")).alias("skills")
    overall = overall_confidence({f: F.col(f)["confidence"] for f in FIELDS})
    out = joined.select("cluster_id", "n_records", *values.values(), *meta.values(), overall.alias("overall_confidence"))
    return _reviewed(_with_match(out, rows, scratch) if matched else out.withColumn("match_probability", F.lit(None).cast("double")))


def _with_match(out: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    match = pairwise_signals(rows, scratch).select("cluster_id", "match_probability")
    return out.join(match, "cluster_id", "left").withColumn("match_probability", F.coalesce("match_probability", F.lit(1.0)))


def _reviewed(out: DataFrame) -> DataFrame:
    return out.withColumn("needs_review", F.col("overall_confidence") < REVIEW_BELOW)


#: Equal trusts that are added up at once, in their order.
ADDED = 1 << 16


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of trusts (``n`` times each) of a cluster's field, one after another in the order of the rows, which keys follow."""
    key, total, support = None, 0.0, 0
    for batch in batches:
        out = []
        for cluster, field, trusted, n in zip(*(batch.column(k).to_pylist() for k in ("cluster_id", "field", "trust", "n")), strict=True):
            if (cluster, field) != key:
                if key:
                    out.append((*key, total, support))
                key, total, support = (cluster, field), 0.0, 0
            support += n
            while n > 1:
                some = min(n, ADDED)
                total = float(np.add.accumulate(np.concatenate(([total], np.full(some, trusted))))[-1])
                n -= some
            if n:
                total += trusted
        if out:
            yield _totals(out)
    if key:
        yield _totals([(*key, total, support)])


def _totals(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cluster_id", "field", "total", "support"])


def _trust_totals(long: DataFrame, counts: DataFrame, won: DataFrame, scratch: Scratch) -> DataFrame:
    """How many records support each field's value, and the sum of their trusts in the order of the records.

    Records of one trust that follow each other are one row with their number.
    Only where those of different trusts are mixed is there a row per record.
    """
    group, chosen = ["cluster_id", "field"], won.select("cluster_id", "field", "selected", "selected_num")
    yes = counts.join(chosen, group).where(_supports())
    runs = yes.groupBy(*group, "trust").agg(F.sum("n").alias("n"), F.min("first").alias("seq"), F.max("last").alias("last"))
    before = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("meets", F.coalesce(F.col("seq") < F.max("last").over(before), F.lit(False)))
    runs = scratch.table(runs.withColumn("mixed", F.max("meets").over(Window.partitionBy(*group))), release=False)
    parts, mixed = runs.where("not mixed").select(*group, "seq", "trust", "n"), runs.where("mixed").select(*group).distinct()
    if not mixed.isEmpty():
        each = long.join(mixed, group).join(chosen, group).where(_supports())
        parts = parts.unionByName(each.select(*group, "seq", "trust", F.lit(1).cast("long").alias("n")))
    return parts.repartition(*group).sortWithinPartitions(*group, "seq").mapInArrow(_added, "cluster_id long, field string, total double, support long")


def _skill_scores(rows: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """The union of a cluster's skills and its confidence; sources are counted, not listed."""
    some = rows.where("size(skills) > 0")
    sources = some.select("cluster_id", "source_tag").distinct().groupBy("cluster_id").agg(F.count("source_tag").alias("n"))
    long = some.select("cluster_id", "skills", "source_type").distinct().select("cluster_id", "source_type", F.explode("skills").alias("skill"))
    found = long.groupBy("cluster_id").agg(sorted_ignoring_case(F.collect_set("skill")).alias("skills"), F.collect_set("source_type").alias("types")).join(sources, "cluster_id")
    return found.select("cluster_id", "skills", confidence_of(agreement_base(F.col("n")), _type_mean(weights), F.lit(0.0)).alias("skills_confidence"))


def scores(rows: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None) -> DataFrame:
    """``profiles`` without metadata, for results that don't show it.

    No list has an entry per record or per value, so no row grows with its
    cluster, and records are counted by value and trust before they move.
    """
    group = ["cluster_id", "field"]
    long = _cut(rows).withColumn("trust", trust(F.col("source_type"), weights))
    counts = long.groupBy(*group, "value", "trust").agg(F.count("*").alias("n"), F.max("priority").alias("priority"), F.max("num").alias("num"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    counts = scratch.table(counts)
    values = counts.groupBy(*group, "value").agg(F.sum("n").alias("support"), F.max("priority").alias("priority"), F.max("num").alias("num"))
    kinds = F.count_distinct(strip(F.lower("value"))).alias("distinct_values")
    won = values.groupBy(*group).agg(F.max(_reasons()).alias("w"), kinds, F.sum("support").alias("n"))
    won = scratch.table(won.select(*group, F.col("w.value").alias("selected"), F.col("w.num").alias("selected_num"), "distinct_values", "n"))
    clusters = scratch.table(rows.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.stddev_pop("experience_yrs").alias("deviation")))
    stats = won.join(_trust_totals(long, counts, won, scratch), group).join(clusters, "cluster_id")
    confidence = confidence_of(agreement_base(F.col("support")), F.col("total") / F.col("support"), _penalty())
    shown = stats.select(*group, F.struct("selected", "selected_num", confidence.alias("confidence")).alias("m"))
    wide = shown.groupBy("cluster_id").pivot("field", [*_SCALARS, "experience_yrs"]).agg(F.first("m"))
    skilled = _skill_scores(rows, weights)
    joined = clusters.join(wide, "cluster_id", "left").join(skilled, "cluster_id", "left")
    values = {f: F.col(f)["selected_num" if f == "experience_yrs" else "selected"].alias(f) for f in FIELDS if f != "skills"}
    values["skills"] = F.coalesce("skills", F.array().cast("array<string>")).alias("skills")
    overall = overall_confidence({f: F.col("skills_confidence") if f == "skills" else F.col(f)["confidence"] for f in FIELDS})
    out = joined.select("cluster_id", "n_records", *[values[f] for f in FIELDS], overall.alias("overall_confidence"))
    return _reviewed(_with_match(out, rows, scratch))


def positions(df: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``position``, the place (from 0) in the output order."""
    return numbered(df, list(map(F.expr, _ORDER)), "position", scratch)


def in_order(df: DataFrame) -> DataFrame:
    """The output order: e-mail, name, phone, then the first record."""
    return df.orderBy(*map(F.expr, _ORDER))
