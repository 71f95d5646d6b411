"""Model roles as injected functions; without one, decisions stay open and nothing leaves the cluster."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.operators.events import gate

Decide = Callable[[str, dict], dict | None]


def undecided(prompt: str, payload: dict) -> dict | None:
    """The default role: no decision."""
    return None


def decide_udf(decide: Decide, prompt: str):
    """payload JSON to decision JSON, one call a row, NULL for no decision; no retry."""

    @F.pandas_udf(T.StringType())
    def run(payload: pd.Series) -> pd.Series:
        def one(body):
            got = decide(prompt, json.loads(body)) if body is not None else None
            return None if got is None else json.dumps(got, ensure_ascii=False, sort_keys=True)

        return payload.map(one)

    return run


def detect(inputs: DataFrame, decide: Decide = undecided, prompt: str = "detect") -> DataFrame:
    """Adds gate_decision, model_decision (only where the gate is open) and model_calls.

    Columns: evidence_status, detection_path, source_credibility, comparison_status, previous_state, current_state, n_diff.
    """
    gated = gate(*[F.col(c) for c in ("evidence_status", "detection_path", "source_credibility", "comparison_status", "previous_state", "current_state", "n_diff")])
    out = inputs.withColumn("gate_decision", gated)
    payload = F.when(F.col("gate_decision").isNull(), F.to_json(F.struct("previous_state", "current_state", "detection_path")))
    return out.withColumn("model_decision", decide_udf(decide, prompt)(payload)).withColumn("model_calls", F.col("gate_decision").isNull().cast("int"))


def rerank(candidates: DataFrame, query: str, text: str, score: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """Adds rerank_score from an injected model, one call a query; candidates of a query are few (top N)."""
    schema = candidates.schema.add("rerank_score", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(rerank_score=score(str(pdf[query].iloc[0]), pdf[text].fillna("").tolist()))

    return candidates.groupBy(query).applyInPandas(run, schema)


def greedy_match(expected: DataFrame, actual: DataFrame, case: str, kind: Callable[[str, str], str]) -> DataFrame:
    """One-to-one matches of expected and actual URLs in a case: in expected order, exact before equivalent."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, out = list(right["url"]), []
        for url in left.sort_values("seq")["url"] if len(left) else ():
            best = next((a for want in ("exact", "equivalent") for a in free if kind(url, a) == want), None)
            if best is not None:
                free.remove(best)
            out.append((left[case].iloc[0], url, best, "unmatched" if best is None else kind(url, best)))
        return pd.DataFrame(out, columns=[case, "expected", "actual", "kind"])

    return expected.groupBy(case).cogroup(actual.groupBy(case)).applyInPandas(run, f"{case} {expected.schema[case].dataType.simpleString()}, expected string, actual string, kind string")
