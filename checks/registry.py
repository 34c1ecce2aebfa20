"""Collects query functions and their SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import derived
from voxspark.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "voxels": derived.VOXELS,
    "far_voxels": derived.FAR_VOXELS,
    "chunked": derived.CHUNKED,
    "cells": derived.CELLS,
    "manifest": derived.MANIFEST,
    "probes": derived.PROBES,
    "files": derived.FILES,
    "artefacts": derived.ARTEFACTS,
    "cache": derived.CACHE,
    "progress_lines": derived.PROGRESS,
    "vertices": derived.VERTICES_DUCK,
}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` names the derived tables its SQL reads, ``sql`` may start with more of its own."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            tables = ", ".join(f"{cte} AS ({derived.duck(CTES[cte])})" for cte in ctes)
            body = sql.strip()
            if body.upper().startswith("WITH "):
                body = ", " + body[5:] if tables else body
            ORACLES[name] = f"WITH {tables} {body}" if tables else body
        return function

    return register
