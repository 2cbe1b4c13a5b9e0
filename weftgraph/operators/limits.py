"""Limit rules: how a caller's number becomes the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def traversal_limit(limit: int | None, default: int = 25, top: int = 100) -> int:
    """Neighborhood, paths, impact and reachability return 1 to 100 rows."""
    return default if limit is None else max(1, min(limit, top))


def node_limit(limit: int | None) -> int | None:
    """Node scans: none if not positive, else 1 to 50 000."""
    return None if limit is None or limit <= 0 else min(limit, 50_000)


def edge_limit(limit: int | None) -> int:
    """Edge scans: 25 if not positive, else 1 to 50 000."""
    return 25 if limit is None or limit <= 0 else min(limit, 50_000)


def depth_limit(depth: int | None, default: int, top: int) -> int:
    return default if depth is None else max(1, min(depth, top))


def first_rows(df: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """The first rows in insertion order; a top-k, so no task sorts everything."""
    return df if limit is None else df.orderBy(order).limit(limit)
