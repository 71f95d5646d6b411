"""Identities that need what the JVM lacks: NFKC, case folding, canonical JSON, key walks."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that may reach neither a model nor an output.
SECRET_KEYS = frozenset(("api_key", "authorization", "secret", "password", "credential", "llm_reasoning_api_key", "deepseek_api_key"))


def fold(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def canonical_json(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)


def walk_keys(value) -> set[str]:
    if isinstance(value, dict):
        return {k.casefold() for k in value} | {x for v in value.values() for x in walk_keys(v)}
    return {x for v in value for x in walk_keys(v)} if isinstance(value, list) else set()


@F.pandas_udf(T.StringType())
def state_key(scope: pd.Series, path: pd.Series) -> pd.Series:
    """Identity of an interactive state by its folded scope and state paths."""

    def one(a, b):
        body = {"scope_path": [fold(x) for x in a], "state_path": [fold(x) for x in b]}
        return "interactive-state:" + hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(scope, path, strict=True)])


@F.pandas_udf(T.StringType())
def fingerprint(body: pd.Series) -> pd.Series:
    """sha256 of JSON text with sorted keys; NULL for NULL."""
    return body.map(lambda x: None if x is None else hashlib.sha256(canonical_json(x).encode()).hexdigest())


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_keys(body: pd.Series) -> pd.Series:
    """Every key of JSON text at any depth, folded and sorted."""
    return body.map(lambda x: None if x is None else sorted(walk_keys(json.loads(x))))


def leaks(body, forbidden):
    """Whether JSON text has a forbidden key anywhere."""
    return F.arrays_overlap(all_keys(body), F.array(*[F.lit(k.casefold()) for k in sorted(forbidden)]))
