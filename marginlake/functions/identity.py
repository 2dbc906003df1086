"""Pseudonyms for personal identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALT_CONF = "spark.marginlake.idSalt"


def id_salt(spark: SparkSession) -> str:
    """The salt, from the session's settings only."""
    salt = spark.conf.get(SALT_CONF, None)
    if not salt:
        raise ValueError(f"set {SALT_CONF} before hashing identifiers")
    return salt


def pseudonym(raw_id: Column, salt: str, prefix: str = "CUST_") -> Column:
    """``CUST_`` plus 16 hex digits of SHA-256 over ``id_salt``; NULL stays NULL."""
    salted = F.concat(raw_id.cast("string"), F.lit(f"_{salt}"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(salted, 256), 1, 16))


def hash_identifiers(df: DataFrame, columns: Sequence[str], salt: str) -> DataFrame:
    """Replace each id or e-mail column by its pseudonym, in one projection."""
    return df.withColumns({c: pseudonym(F.col(c), salt) for c in columns})
