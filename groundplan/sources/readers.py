"""Readers: delimited text, JSON features, partitioned keys, flood dimension, generated rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header aliases and the names they stand for.
ALIASES = {"post_code": "postcode", "zip_code": "postcode", "zip": "postcode", "post": "postcode", "property_ref": "property_reference", "uprn_number": "uprn", "lat": "latitude", "lon": "longitude", "lng": "longitude", "long": "longitude", "buildyear": "build_year", "year_built": "build_year", "epc": "epc_rating"}
KEY = re.compile(r"ha_id=(?P<ha_id>[^/]+)/bronze/dataset=(?P<dataset>[^/]+)/ingest_date=(?P<ingest_date>[^/]+)/submission_id=(?P<submission_id>[^/]+)/(?P<file>[^/]+)$")


def normal_name(name: str) -> str:
    """Lower case, blanks and dashes as underscores, other signs dropped."""
    return re.sub(r"[^\w]", "", re.sub(r"[\s-]+", "_", name.strip().lower()))


def standard_names(names: Sequence[str]) -> dict[str, str]:
    """New name of each column; of several with one target the later ones are numbered."""
    found: dict[str, str] = {}
    for name in names:
        plain = ALIASES.get(normal_name(name), normal_name(name)) or "column"
        taken = sum(1 for v in found.values() if re.fullmatch(rf"{re.escape(plain)}(_\d+)?", v))
        found[name] = plain if not taken else f"{plain}_{taken + 1}"
    return found


def delimited(spark: SparkSession, path: str, standard: bool = True) -> DataFrame:
    """A CSV with a header, all columns text, empty cells null; other files are refused."""
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"not a .csv file: {path}")
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="PERMISSIVE")
    return df.withColumnsRenamed(standard_names(df.columns)) if standard else df


def features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``features.json`` objects with their partition keys."""
    df = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*features.json")
    return df.withColumns(key_parts(F.col("_metadata.file_path")))


def key_parts(path: Column) -> dict[str, Column]:
    """The named parts of an object key; null where the path is no such key."""
    pattern = re.sub(r"\?P<\w+>", "", KEY.pattern)
    return {name: F.nullif(F.regexp_extract(path, pattern, k), F.lit("")) for k, name in enumerate(KEY.groupindex, 1)}


def flood_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(postcode without blanks, band) of a postcode risk table; a byte-order mark does not matter."""
    from groundplan.functions.scoring import flood_band

    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c: c.lstrip("﻿") for c in raw.columns}
    count = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    df = raw.withColumnsRenamed(names)
    code = F.upper(F.regexp_replace("Postcode", r"\s", ""))
    return df.where(code != "").select(code.alias("postcode"), flood_band(count("HIGH_CNT"), count("MED_CNT"), count("LOW_CNT")).alias("band"))


#: A draw below {2} from id {0} and seed {1}, in SQL; a multiplier and a modulus of a linear congruence.
DRAW_SQL = "((({0} + {1}) * 1103515245 + 12345) % 2147483648 * 69069 + {1}) % 2147483647 % {2}"


def draw(seed: int, below: int) -> Column:
    """A whole number from 0 to ``below`` - 1 that follows from ``id`` and a seed alone, so a task that runs again draws the same."""
    return F.expr(DRAW_SQL.format("id", seed, below))


def seeded(ids: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated rows for given ``id``s, such as a series for each row of a table; columns are expressions over what is given."""
    return ids.select(*ids.columns, *(c.alias(name) for name, c in columns.items()))


def choice(options: Sequence[object], seed: int) -> Column:
    return F.get(F.array(*map(F.lit, options)), draw(seed, len(options)).cast("int"))
