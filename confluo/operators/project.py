"""Projecting profiles to a configured output schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import str_title
from .merge import FIELDS

# --- Fixed values: they decide results and are stated as the specification has them. ---
FIELD_KEYS = {
    "full_name": "full_name",
    "name": "full_name",
    "email": "email",
    "emails": "email",
    "primary_email": "email",
    "phone": "phone",
    "phones": "phone",
    "country": "country",
    "location": "country",
    "skills": "skills",
    "date_of_birth": "date_of_birth",
    "dob": "date_of_birth",
    "experience_yrs": "experience_yrs",
    "years_experience": "experience_yrs",
    "experience": "experience_yrs",
}
# --- End of fixed values. ---


class ProjectionError(ValueError):
    """A configuration that can't be applied."""


class Config:
    """A checked projection configuration."""

    def __init__(self, given: dict | None = None):
        given = given or {}
        self.on_missing = given.get("on_missing", "null")
        self.output_format = given.get("output_format", "flat")
        if self.on_missing not in ("null", "omit", "error"):
            raise ProjectionError(f"on_missing: {self.on_missing}")
        if self.output_format not in ("flat", "enterprise"):
            raise ProjectionError(f"output_format: {self.output_format}")
        self.normalization = given.get("normalization") or {}
        self.include_confidence = bool(given.get("include_confidence", False))
        self.include_provenance = bool(given.get("include_provenance", False))
        self.fields = given.get("fields") or [{"path": f} for f in FIELDS]
        names = []
        for field in self.fields:
            if not isinstance(field.get("path"), str):
                raise ProjectionError("a field needs a path")
            if self.key(field) not in FIELDS:
                raise ProjectionError(f"no such field: {field['path']}")
            names += self.names(field)
        if len(set(names)) < len(names):
            raise ProjectionError(f"an output name occurs twice: {names}")

    @staticmethod
    def key(field: dict) -> str:
        """The canonical field that a path or a ``from`` expression means."""
        head = (field.get("from") or field["path"]).split("[")[0].split(".")[0].lower()
        return FIELD_KEYS.get(head, head)

    @staticmethod
    def name(field: dict) -> str:
        return field.get("rename") or field["path"]

    def names(self, field: dict) -> list[str]:
        n, flat = self.name(field), self.output_format == "flat"
        return [n] + [f"{n}_confidence"] * (flat and self.include_confidence) + [f"{n}_provenance"] * (flat and self.include_provenance)

    def required(self, field: dict) -> bool:
        wanted = field.get("required")
        return self.on_missing == "error" or bool(wanted)


#: What a required field of a flat output has to be.
KINDS = {f: "string" for f in FIELDS} | {"skills": "array<string>", "experience_yrs": "double"}
FROM_KINDS = {"emails": "array<string>", "phones": "array<string>", "skills[].name": "array<struct<name:string>>"}


def checked_types(out: DataFrame, config: Config) -> DataFrame:
    """The output itself, unless a required field has another type than its name promises. Types are the plan's, so no row is read."""
    kinds = dict(out.dtypes)
    for field in config.fields:
        if not config.required(field) or config.output_format == "enterprise":
            continue
        want, got = FROM_KINDS.get(field.get("from"), KINDS[config.key(field)]), kinds[config.name(field)]
        if got != want:
            raise ProjectionError(f"{config.name(field)} is {got}, not {want}")
    return out


def _extracted(field: dict, key: str) -> Column:
    """What ``from`` makes of the value."""
    c, how = F.col(key), field.get("from")
    if how in ("emails", "phones"):
        return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    if how == "skills[].name":
        return F.transform(c, lambda s: F.struct(s.alias("name"))) if key == "skills" else F.array().cast("array<struct<name: string>>")
    return c


def _normalised(c: Column, kind: str, key: str, options: dict) -> Column:
    """Output case and the country's code; other formats leave values as they are."""
    case = options.get("case")
    if kind == "string" and case in ("upper", "lower", "title"):
        return {"upper": F.upper, "lower": F.lower, "title": str_title}[case](c)
    if key == "country" and kind == "string" and str(options.get("format", "alpha2")).lower() == "alpha2":
        return F.upper(c)
    return c


def project(profiles: DataFrame, config: Config) -> DataFrame:
    """One output row per profile. A missing required value fails the query that reads it.

    With ``on_missing = omit`` missing values are null here, metadata included;
    the JSON sinks leave null fields out then.
    """
    kinds = dict(profiles.dtypes)
    out: list[Column] = []
    for field in config.fields:
        key, name = config.key(field), config.name(field)
        value = _extracted(field, key)
        lists = kinds[key].startswith("array") or field.get("from") in ("emails", "phones", "skills[].name")
        missing = (value.isNull() | (F.size(value) == 0)) if lists else value.isNull()
        options = dict(config.normalization.get(key, {}))
        if field.get("normalize"):
            options |= {"format": field["normalize"], "canonicalize": True}
        shown = _normalised(value, "list" if lists else kinds[key], key, options)
        if config.required(field):
            shown = F.when(missing, F.raise_error(F.lit(f"Required field '{field['path']}' is missing"))).otherwise(shown)
        else:
            shown = F.when(~missing, shown)
        meta = F.col(f"meta_{key}")
        omit = config.on_missing == "omit"

        def of(what: str, none: Column, meta: Column = meta, missing: Column = missing, omit: bool = omit) -> Column:
            found = F.coalesce(meta[what], none)
            return F.when(~missing, found) if omit else F.when(missing, none).otherwise(found)

        no_list = F.array().cast("array<string>")
        if config.output_format == "enterprise":
            full = F.struct(shown.alias("value"), of("confidence", F.lit(0.0)).alias("confidence"), of("sources", no_list).alias("sources"), of("reasoning", no_list).alias("evidence"), of("trust_score", F.lit(0.0)).alias("trust_score"))
            out.append((F.when(~missing, full) if omit else full).alias(name))
            continue
        out.append(shown.alias(name))
        if config.include_confidence:
            out.append(of("confidence", F.lit(0.0)).alias(f"{name}_confidence"))
        if config.include_provenance:
            out.append(of("sources", no_list).alias(f"{name}_provenance"))
    if config.output_format == "enterprise":
        out += [F.col("overall_confidence"), F.col("needs_review"), F.col("match_probability")]
    return checked_types(profiles.select(*out), config)
