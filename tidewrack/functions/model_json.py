"""Model replies: finding the JSON in them and repairing it against closed vocabularies, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab
from .records import string_of
from .text import _col, let, py_strip, strip_lower

FACET = "array<struct<name:string,evidence:string,out_of_schema:boolean>>"
SPECIES = "array<struct<name:string,scientific_name:string,category:string,evidence:string,out_of_schema:boolean>>"
#: Facet lists with the member that names an item and its vocabulary; species have none.
FACETS = {
    "stages": ("stage", vocab.STAGES),
    "features": ("feature", vocab.FEATURES),
    "modalities": ("modality", vocab.MODALITIES),
    "contexts": ("context", vocab.CONTEXTS),
    "domains": ("domain", vocab.DOMAINS),
}


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; null otherwise.

    The parser itself stops after the first value, so the text is read as a member of an object and the
    member after it must have been reached.
    """
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":1}')))
    members = F.map_keys(F.try_variant_get(held, "$", "map<string,variant>"))
    whole = (F.size(members) == 2) & (F.try_variant_get(held, "$.end", "int") == 1)
    return F.when(whole, F.try_variant_get(held, "$.v", "variant"))


def extract_json(text: Column | str) -> Column:
    """VARIANT of the whole text, else of its first ``{`` to its last ``}``, else null."""
    s = py_strip(text)
    inner = F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(strict_json(s), strict_json(inner))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def truthy(v: Column) -> Column:
    """Truth of a VARIANT as scripting languages see it: zero, empty and null values are false."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) > 0)
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
    )


def facet(v: Column, path: str, name: str, allowed: list[str]) -> Column:
    """Items with a non-blank name, flagged when the name as it stands is not in the vocabulary; else []."""
    items = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    said = lambda x: string_of(x, f"$.{name}")
    good = F.filter(items, lambda x: F.coalesce(py_strip(said(x)) != "", F.lit(False)))
    known = F.array(*[F.lit(a) for a in allowed])
    return F.transform(good, lambda x: F.struct(said(x).alias("name"), string_of(x, "$.evidence").alias("evidence"), (~F.array_contains(known, said(x)) | truthy(F.try_variant_get(x, "$.out_of_schema", "variant"))).alias("out_of_schema"))).cast(FACET)


def species_items(v: Column) -> Column:
    """Species objects; whatever sounds like a bat is one."""
    items = F.filter(F.coalesce(F.try_variant_get(v, "$.species", "array<variant>"), F.array().cast("array<variant>")), is_object)
    pattern = "|".join(vocab.BAT_WORDS)

    def one(x: Column) -> Column:
        name = string_of(x, "$.name")
        bat = F.lower(F.coalesce(name, F.lit(""))).rlike(pattern)
        return F.struct(
            name.alias("name"),
            string_of(x, "$.scientific_name").alias("scientific_name"),
            F.when(bat, "Bat").otherwise(string_of(x, "$.category")).alias("category"),
            string_of(x, "$.evidence").alias("evidence"),
            truthy(F.try_variant_get(x, "$.out_of_schema", "variant")).alias("out_of_schema"),
        )

    return F.transform(items, one).cast(SPECIES)


def clamp_score(v: Column) -> Column:
    """1 to 10: numbers and whole-number strings are cut and clamped, everything else is 5."""
    s = F.try_variant_get(v, "$.relevance_score", "variant")
    kind = F.schema_of_variant(s)
    text = py_strip(F.try_variant_get(s, "$", "string"))
    got = (
        F.when(kind == "STRING", F.lit(None).cast("double"))
        .when(kind == "BOOLEAN", F.try_variant_get(s, "$", "boolean").cast("int").cast("double"))
        .otherwise(F.try_variant_get(s, "$", "double"))
    )
    whole = F.when((kind == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("double"))
    n = F.coalesce(got, whole)
    return F.when(n.isNull() | F.isnan(n), F.lit(5)).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("int"))))


def one_of(v: Column, path: str, allowed: list[str], default: str) -> Column:
    s = string_of(v, f"$.{path}")
    return F.when(s.isin(allowed), s).otherwise(F.lit(default))


def copied_summary(summary: Column) -> Column:
    """Whether a summary was copied from the instructions."""
    low = strip_lower(F.coalesce(summary, F.lit("")))
    return low.isin(vocab.COPIED_SUMMARIES) | (low.contains("<") & low.contains(">"))


def normalize_reply(reply: Column | str, title: Column | str | None = None) -> Column:
    """A reply as a struct of fixed shape.

    Unusable text and empty objects become ``silent_failure``, other JSON ``parse_error``; a reply that is
    not relevant loses its facets and keeps its reason, or ``template_leak`` if that was copied; a relevant
    one is repaired: lists that are none are emptied, vocabularies checked, an empty modality list is
    acoustic on the title's evidence, scores clamped, enumerations defaulted.
    """
    return let(extract_json(reply), lambda v: normalized(v, title))


def normalized(v: Column, title: Column | str | None) -> Column:
    """``normalize_reply`` of a reply that is parsed already."""
    obj = is_object(v)
    empty = v.isNull() | (obj & (F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == 0))
    flag = F.try_variant_get(v, "$.is_relevant", "variant")
    score = F.try_variant_get(v, "$.relevance_score", "variant")
    has_flag = F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), "is_relevant")
    kind = F.schema_of_variant(score)
    positive = F.when(kind.isin("STRING") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False)).when(kind == "BOOLEAN", F.try_variant_get(score, "$", "boolean")).otherwise(F.coalesce(F.try_variant_get(score, "$", "double") > 0, F.lit(False)))
    relevant = obj & ~empty & F.when(F.coalesce(has_flag, F.lit(False)), truthy(flag)).otherwise(F.coalesce(positive, F.lit(False)))
    summary = string_of(v, "$.summary")
    said = F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), "summary")
    reason = F.when(empty, "silent_failure").when(~obj, "parse_error").when(copied_summary(summary), "template_leak").when(F.coalesce(said, F.lit(False)), summary).otherwise("rejected")
    evidence = F.coalesce(F.nullif(_col(title), F.lit("")), F.lit("inferred from context")) if title is not None else F.lit("inferred from context")
    none = F.array().cast(FACET)
    lists = {k: facet(v, k, n, a) for k, (n, a) in FACETS.items()}
    acoustic = F.array(F.struct(F.lit("Acoustic").alias("name"), evidence.alias("evidence"), F.lit(False).alias("out_of_schema"))).cast(FACET)
    lists["modalities"] = F.when(F.size(lists["modalities"]) > 0, lists["modalities"]).otherwise(acoustic)
    yes = lambda k: F.when(relevant, truthy(F.try_variant_get(v, f"$.{k}", "variant"))).otherwise(False)
    return F.struct(
        relevant.alias("is_relevant"),
        F.when(relevant, species_items(v)).otherwise(F.array().cast(SPECIES)).alias("species"),
        *[F.when(relevant, lists[k]).otherwise(none).alias(k) for k in FACETS],
        F.when(relevant, one_of(v, "social_scale", vocab.SOCIAL_SCALES, "not_applicable")).otherwise("not_applicable").alias("social_scale"),
        F.when(relevant, one_of(v, "research_tradition", vocab.TRADITIONS, "biological")).otherwise("biological").alias("research_tradition"),
        F.when(relevant, one_of(v, "paper_type", vocab.PAPER_TYPES, "empirical")).otherwise("irrelevant").alias("paper_type"),
        *[yes(k).alias(k) for k in ("has_dataset", "has_code", "has_benchmark")],
        F.when(relevant, F.when(F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), "relevance_score"), clamp_score(v)).otherwise(5)).otherwise(0).alias("relevance_score"),
        F.when(relevant, F.coalesce(summary, F.lit(""))).otherwise(reason).alias("summary"),
    )
