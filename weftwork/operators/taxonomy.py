"""Domains and areas of pages, from their paths and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.vocab import AREAS_BY_PATH, AREAS_BY_TOPIC


def plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def area_of_topic(topic: Column) -> Column:
    key = plain(topic)
    return reduce(lambda other, area: F.when(key.isin(*AREAS_BY_TOPIC[area]), area).otherwise(other), reversed(AREAS_BY_TOPIC), F.lit("general"))


def area_of_path(path: Column, topic: Column) -> Column:
    """The first path part that decides, else the topic's area."""
    key = plain(path)
    within = lambda part: F.contains(key, F.lit(f"/{part}/")) | key.startswith(f"{part}/")
    return reduce(lambda other, rule: F.when(within(rule[0]), rule[1]).otherwise(other), reversed(AREAS_BY_PATH), area_of_topic(topic))


def domain_of(path: Column) -> Column:
    key = plain(path)
    return F.when(key == "", "unknown").otherwise(F.split_part(key, F.lit("/"), F.lit(1)))
