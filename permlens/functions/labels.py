"""The access rule and the scope rule, each written once and used by every reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clearance levels from open to closed, and the version name of the rule.
LEVELS = ("public", "internal", "confidential", "restricted")
POLICY_VERSION = "abac/1"


def clearance_rank(name: Column) -> Column:
    """Rank of a clearance or classification; missing, unknown and differently cased names rank lowest."""
    rank = F.lit(0)
    for level, known in enumerate(LEVELS):
        rank = F.when(name == known, level).otherwise(rank)
    return rank.cast("int")


def authorized(principal: str, document: str) -> Column:
    """Deny by default: true only when tenant, clearance, department and project all admit. Arguments are the relation aliases."""
    p, d = (lambda name: F.col(f"{principal}.{name}")), (lambda name: F.col(f"{document}.{name}"))
    return (p("tenant_id") == d("tenant_id")) & label_rule(principal, document)


def label_rule(principal: str, document: str) -> Column:
    """The part of the rule inside one tenant."""
    p, d = (lambda name: F.col(f"{principal}.{name}")), (lambda name: F.col(f"{document}.{name}"))
    department = (F.size(d("allowed_departments")) == 0) | F.array_contains(d("allowed_departments"), p("department"))
    project = (F.size(d("required_projects")) == 0) | F.arrays_overlap(d("required_projects"), p("projects"))
    return F.coalesce((d("classification_rank") <= p("clearance_rank")) & department & project, F.lit(False))


def in_scope(as_of: Column, region: Column, document: str) -> Column:
    """Whether a version applies at a time and in a region; without a time there is no scope at all."""
    d = lambda name: F.col(f"{document}.{name}")
    started = d("valid_from").isNull() | (d("valid_from") <= as_of)
    open_ended = d("valid_to").isNull() | (as_of < d("valid_to"))
    applies = (F.size(d("applies_to_regions")) == 0) | region.isNull() | F.array_contains(d("applies_to_regions"), region)
    return as_of.isNull() | F.coalesce(started & open_ended & applies, F.lit(False))


def in_region(request: str, document: str) -> Column:
    """The part of the scope rule that no window has: without a time (`untimed`) nothing binds, without a region every one applies."""
    regions, region = F.col(f"{document}.applies_to_regions"), F.col(f"{request}.region")
    return F.col(f"{request}.untimed") | F.coalesce((F.size(regions) == 0) | region.isNull() | F.array_contains(regions, region), F.lit(False))


def as_set(values: Column) -> Column:
    """An array compared as a set."""
    return F.sort_array(F.array_distinct(values))
