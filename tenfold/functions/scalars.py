"""Scalar rules as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenfold.schemas import DAY_S, MS_ABOVE, ROLES

# Patterns of a profile link, after its site and what stands before it there, and of a name with its tag; the site.
PROFILE = r"/profile/([a-z0-9]+)/([^/]+?)-([^/-]+)(?:/|$)"
SITE = "u.gg/lol"
NAME_TAG = r"^\s*([^#]{1,32})#([A-Za-z0-9]{2,8})\s*$"


def parse_patch(version: Column) -> Column:
    """The first two dotted parts; null if there are fewer."""
    parts = F.split(version, r"\.")
    return F.when((version != "") & (F.size(parts) >= 2), F.concat_ws(".", parts[0], parts[1]))


def patch_number(patch: Column) -> Column:
    """(major, minor) for comparison; what cannot be read is (0, 0)."""
    parts = F.split(F.coalesce(patch, F.lit("")), r"\.")
    major, minor = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1))
    bad = major.isNull() | (minor.isNotNull() & minor.try_cast("int").isNull())
    return F.when(bad, F.struct(F.lit(0).alias("major"), F.lit(0).alias("minor"))).otherwise(F.struct(F.coalesce(major, F.lit(0)).alias("major"), F.coalesce(minor.try_cast("int"), F.lit(0)).alias("minor")))


def duration_seconds(raw: Column) -> Column:
    """Values above the limit are milliseconds."""
    raw = F.coalesce(raw, F.lit(0))
    return F.when(raw > MS_ABOVE, F.floor(raw / 1000)).otherwise(raw).cast("int")


def start_time(start_ms: Column, created_ms: Column) -> Column:
    """UTC without zone; zero counts as absent."""
    ms = F.coalesce(F.nullif(start_ms, F.lit(0)), F.nullif(created_ms, F.lit(0)), F.lit(0))
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def position_index(position: Column) -> Column:
    """Place in the role order, from 0; -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), position) - 1, F.lit(-1)).cast("int")


def smoothed(wins: Column, games: Column, prior: Column | float, weight: float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (wins + prior * F.lit(float(weight))) / (games + F.lit(float(weight)))


def days_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(DAY_S))


def parse_target(text: Column, site: str = SITE) -> Column:
    """struct(name, tag, platform) of a profile link of that site or of name#tag; null fields if it is neither."""
    profile = "(?i)" + re.escape(site) + PROFILE
    link = F.regexp_extract(text, profile, 1) != ""
    plain = F.regexp_extract(text, NAME_TAG, 2) != ""
    name = F.replace(F.replace(F.regexp_extract(text, profile, 2), F.lit("+"), F.lit(" ")), F.lit("%20"), F.lit(" "))
    return F.struct(
        F.when(link, name).when(plain, F.trim(F.regexp_extract(text, NAME_TAG, 1))).alias("name"),
        F.when(link, F.regexp_extract(text, profile, 3)).when(plain, F.regexp_extract(text, NAME_TAG, 2)).alias("tag"),
        F.when(link, F.lower(F.regexp_extract(text, profile, 1))).alias("platform"),
    )


def anonymous_id(game_id: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("anon"), game_id.cast("string"), index.cast("string"))


def parse_limits(text: str) -> list[tuple[int, int]]:
    """"20:1,100:120" as [(20, 1), (100, 120)]."""
    return [(int(a), int(b)) for a, _, b in (x.partition(":") for x in text.split(",") if x.strip())]


def parse_patch_floor(text: str) -> tuple[int, int]:
    """"15.3" as (15, 3); what is empty or cannot be read sets no floor."""
    major, _, minor = text.strip().partition(".")
    try:
        return int(major), int(minor or 0)
    except ValueError:
        return 0, 0
