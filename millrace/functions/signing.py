"""Signed requests: canonical query strings and keyed hashes (no SQL function has HMAC)."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_query(params: Column) -> Column:
    """A map's entries by key, URL-encoded and joined."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["key"]), F.lit("="), encoded(p["value"]))), "&")


@F.pandas_udf(T.StringType())
def hmac_sha256(key: pd.Series, message: pd.Series) -> pd.Series:
    """Base64 of the keyed hash."""
    return pd.Series([None if k is None or m is None else base64.b64encode(hmac.new(k.encode(), m.encode(), hashlib.sha256).digest()).decode() for k, m in zip(key, message)])


@F.pandas_udf(T.StringType())
def derived_key(secret: pd.Series, date: pd.Series, region: pd.Series, service: pd.Series) -> pd.Series:
    """Hex of a signing key derived step by step from date, region and service."""

    def one(s: str, *steps: str) -> str:
        key = ("AWS4" + s).encode()
        for step in (*steps, "aws4_request"):
            key = hmac.new(key, step.encode(), hashlib.sha256).digest()
        return key.hex()

    return pd.Series([one(*row) for row in zip(secret, date, region, service)])
