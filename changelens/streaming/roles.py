"""Model roles as table functions: rows of a partition go to a role in batches, within a budget of calls, and what it proposes is checked.

The function is polymorphic: its result has the key columns of whatever table
it is given, with their types.  A role is any function from a list of texts to
a list of proposals for each; a check names the first rule that a proposal
breaks.  Nothing is dropped in silence: proposals that break a rule, texts that
the budget left out and calls that failed are rows with their status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Role = Callable[[list[str]], list[list[str]]]
RESULT = (T.StructField("call", T.IntegerType()), T.StructField("proposal", T.StringType()), T.StructField("status", T.StringType()))


def role_function(role: Role, check: Callable[[str, str], str | None], keys: list[str], text: str, batch: int = 10, budget: int | None = None):
    """A table function; give it a table partitioned and ordered as the role is to see it.

    Result: keys, call (from 1 in each partition), proposal, status: accepted,
    the rule that was broken, budget (never sent), empty (nothing proposed) or
    failed (the role raised, or answered for another number of texts).
    """

    class Roles:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            held = {f.name: f for f in table.dataType.fields}
            missing = [c for c in (*keys, text) if c not in held]
            if missing:
                raise ValueError(f"the table has no {', '.join(missing)}")
            return AnalyzeResult(T.StructType([*(held[k] for k in keys), *RESULT]))

        def __init__(self):
            self.waiting: list = []
            self.calls = 0

        def _call(self):
            rows, self.waiting = self.waiting, []
            if not rows:
                return
            texts = [r[text] or "" for r in rows]
            if budget is not None and self.calls >= budget:
                yield from ((*(r[k] for k in keys), None, None, "budget") for r in rows)
                return
            self.calls += 1
            try:
                answers = role(texts)
                if len(answers) != len(texts):
                    raise ValueError("an answer for each text is needed")
            except Exception:  # a role's failure is a result, as the rows of other calls are
                yield from ((*(r[k] for k in keys), self.calls, None, "failed") for r in rows)
                return
            for r, own, proposals in zip(rows, texts, answers, strict=True):
                head = tuple(r[k] for k in keys)
                if not proposals:
                    yield (*head, self.calls, None, "empty")
                for p in proposals:
                    yield (*head, self.calls, p, check(own, p) or "accepted")

        def eval(self, row):
            self.waiting.append(row)
            if len(self.waiting) == batch:
                yield from self._call()

        def terminate(self):
            yield from self._call()

    return udtf(Roles)


def ask(rows: DataFrame, role: Role, check: Callable[[str, str], str | None], keys: list[str], text: str, partition: str, order: str, batch: int = 10, budget: int | None = None) -> DataFrame:
    """A role over the texts of each partition in order. Rows of one partition go through one task, in batches."""
    function = role_function(role, check, keys, text, batch, budget)
    return function(rows.select(*dict.fromkeys([*keys, text, partition, order])).asTable().partitionBy(partition).orderBy(order))


def tally(asked: DataFrame, by: list[str]) -> DataFrame:
    """Proposals by outcome: accepted, and rejected by each rule."""
    return asked.where("proposal is not null").groupBy(*by, F.col("status").alias("outcome")).agg(F.count("*").alias("n"))
