"""The registered queries of the slide operators, with the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import queries_codecs, queries_interaction, queries_meta, queries_pixels, queries_slides
from tesserae.plans.queries_pixels import flagship
from tesserae.session import configure

_ALL = queries_pixels.QUERIES | queries_meta.QUERIES | queries_interaction.QUERIES | queries_slides.QUERIES | queries_codecs.QUERIES


def _configured(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(query) for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
