"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundplan.plans.silver import Silver, with_views

#: The similarity by longest matching blocks in SQL: of ``pairs`` (a, b) all common runs, then the longest block of each segment, the leftmost of equal ones, and what lies before and behind it.
RATIO_SQL = """numbered AS (SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT a, b FROM pairs) d),
 runs AS (SELECT id, i, j, len(list_filter(range(1, CAST(least(length(a) - i, length(b) - j) + 1 AS BIGINT)), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))) AS k
  FROM (SELECT p.*, unnest(range(0, length(b))) AS j FROM (SELECT p.*, unnest(range(0, length(a))) AS i FROM numbered p) p) x WHERE substr(a, i + 1, 1) = substr(b, j + 1, 1)),
 seg AS (SELECT id, CAST(0 AS BIGINT) AS alo, length(a) AS ahi, CAST(0 AS BIGINT) AS blo, length(b) AS bhi, CAST(0 AS BIGINT) AS k FROM numbered
  UNION ALL
  SELECT id, CASE side WHEN 0 THEN alo ELSE i + k END, CASE side WHEN 0 THEN i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE j + k END, CASE side WHEN 0 THEN j ELSE bhi END, CASE side WHEN 0 THEN k ELSE 0 END
  FROM (SELECT s.id, alo, ahi, blo, bhi, r.i, r.j, least(r.k, ahi - r.i, bhi - r.j) AS k, row_number() OVER (PARTITION BY s.id, alo, ahi, blo, bhi ORDER BY least(r.k, ahi - r.i, bhi - r.j) DESC, r.i, r.j) AS rn
   FROM seg s JOIN runs r ON r.id = s.id AND r.i >= alo AND r.i < ahi AND r.j >= blo AND r.j < bhi) y, (SELECT unnest([0, 1]) AS side) z WHERE rn = 1),
 ratio AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE CAST(2.0 AS DOUBLE) * coalesce(sum(k), 0) / (length(a) + length(b)) END AS ratio FROM numbered n LEFT JOIN seg ON seg.id = n.id GROUP BY n.id, a, b)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of a Silver; ``oracle`` may name silver views and base tables."""

    def add(build: Callable[[Silver], DataFrame]) -> Callable[[Silver], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: build(Silver(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return build

    return add
