"""Hashes that Catalyst lacks, as Arrow-batched functions, and what is derived from them."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blake2b(text: Column, size: int = 8) -> Column:
    """Hex BLAKE2b digest of the UTF-8 bytes."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=size).hexdigest())

    return digest(text)


def unit_hash(text: Column) -> Column:
    """The 64-bit BLAKE2b digest as a double from 0 to below 1."""

    @F.pandas_udf("double")
    def unit(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2**64)

    return unit(text)


def keyed_pseudonym(text: Column, key: bytes, size: int = 16) -> Column:
    """Hex keyed BLAKE2b digest."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=size, key=key).hexdigest())

    return digest(text)


def strict_json(text: Column) -> Column:
    """The canonical form (sorted keys) of a JSON object; null for anything else, and for repeated keys or NaN."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        def pairs(items: list) -> dict:
            if len({k for k, _ in items}) != len(items):
                raise ValueError("repeated key")
            return dict(items)

        def constant(name: str) -> None:
            raise ValueError(name)

        def one(x: str | None) -> str | None:
            try:
                value = json.loads(x, object_pairs_hook=pairs, parse_constant=constant) if x is not None else None
            except ValueError:
                return None
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(value, dict) else None

        return s.map(one)

    return parse(text)
