"""Registered queries of the rules for evidence, knowledge and memory, over documents and conversations.

Ten documents in a row are the citations of one report; their ids decide what
kind of source each is, so that every rule is kept by some and broken by others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators import events as EV
from changelens.operators import memory as M
from changelens.operators import research as RS
from changelens.operators import retrieval as R
from changelens.plans.catalog import query, t

_R, _I = "doc_id // 10", "doc_id % 10"
#: Column of a citation or a support: its value as SQL that both engines read ({r}: report, {i}: place in it).
_CASES = {
    "source": "CASE WHEN {r} % 5 = 0 AND {i} = 3 THEN 'memory' WHEN {r} % 7 = 0 AND {i} = 4 THEN 'search' WHEN {i} % 3 = 0 AND NOT ({i} = 6 AND {r} % 5 <> 2) THEN 'page' WHEN {i} % 3 = 2 THEN 'event' ELSE 'knowledge' END",
    "domain": "CASE WHEN {i} % 2 = 0 THEN 'own_product' ELSE 'competitor' END",
    "credibility": "CASE WHEN {r} % 4 = 1 AND {i} = 9 OR {r} % 6 = 1 AND {i} = 0 THEN 'third_party' WHEN {r} % 11 = 3 AND {i} = 3 THEN NULL ELSE 'official' END",
    "status": "CASE WHEN {r} % 9 = 2 AND {i} = 1 THEN 'pending' WHEN {r} % 13 = 5 AND {i} = 2 THEN NULL WHEN {i} % 2 = 0 THEN 'confirmed' ELSE 'read' END",
    "section": "CASE WHEN {i} < 2 THEN 'event_summary' WHEN {i} = 2 THEN 'background' WHEN {i} = 3 THEN 'competitor_context' WHEN {i} < 8 THEN 'own_product_comparison' WHEN {i} = 8 THEN 'implications' ELSE 'watch_next' END",
    "kind": "CASE WHEN {i} < 8 THEN 'fact' WHEN {i} = 8 AND {r} % 6 = 3 THEN 'fact' WHEN {i} = 8 THEN 'inference' ELSE 'recommendation' END",
    "excerpt": "CASE WHEN {r} % 10 = 7 AND {i} = 2 THEN concat('not there: ', substr(text, 1, 20)) WHEN {r} % 10 = 8 AND {i} = 5 THEN '  ' ELSE substr(text, CAST(1 + doc_id % 7 AS INT), 20) END",
    "claim_no": "CASE WHEN {i} < 6 THEN 0 ELSE 1 END",
}


def _sql(column: str, spark: bool = False) -> str:
    divided = "(doc_id div 10)" if spark else "(doc_id // 10)"
    return _CASES[column].format(r=divided, i="(doc_id % 10)") + f" AS {column}"


def _cited(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").selectExpr("doc_id", "doc_id div 10 AS report_id", "concat('d', doc_id) AS result_id", "text AS content", *[_sql(c, True) for c in _CASES])


_CITED = f"""cited AS (SELECT doc_id, doc_id // 10 AS report_id, 'd' || doc_id AS result_id, text AS content, {", ".join(map(_sql, _CASES))} FROM documents),
checked AS (SELECT *, coalesce(source NOT IN ('memory', 'search') AND status IN ('confirmed', 'read'), false) AND coalesce(trim(excerpt, ' ') <> '' AND contains(content, excerpt), false) AS supported FROM cited)"""
_THIRD = "bool_or(kind = 'fact' AND source = 'page' AND credibility IS DISTINCT FROM 'official')"


def _named(rules: str) -> str:
    return f"array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',')"


def _text(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.array_join("violations", ",").alias("violations"))


@query(f"WITH {_CITED} SELECT doc_id FROM checked WHERE NOT supported")
def q_unsupported_claims(spark, sf):
    c = _cited(spark, sf)
    return RS.unsupported(c.select("doc_id", "result_id", "excerpt"), c.drop("excerpt", "doc_id")).select("doc_id")


@query(f"WITH {_CITED} SELECT doc_id, source, status FROM cited WHERE source NOT IN ('memory', 'search') AND status IN ('confirmed', 'read')")
def q_factual_citations(spark, sf):
    return RS.factual(_cited(spark, sf)).select("doc_id", "source", "status")


def _supports(spark, sf, key: str) -> tuple[DataFrame, DataFrame]:
    """Supports whose list of references lacks the last one in every eighth report, and the citations."""
    c = _cited(spark, sf)
    listed = F.collect_list(F.when(~((F.col("report_id") % 8 == 5) & (F.col("doc_id") % 10 == 9)), F.col("result_id")))
    refs = c.groupBy("report_id").agg(listed.alias("refs"))
    return c.join(refs, "report_id").withColumnRenamed("report_id", key), c


_LISTED = "bool_or(report_id % 8 = 5 AND doc_id % 10 = 9)"


@query(f"""WITH {_CITED},
claims AS (SELECT report_id, claim_no, coalesce(bool_or(source = 'knowledge' AND domain = 'own_product'), false) AS own, coalesce(bool_or(domain = 'competitor'), false) AS other
  FROM checked WHERE section = 'own_product_comparison' GROUP BY ALL),
compared AS (SELECT report_id, bool_and(own) AS own, bool_and(other) AS other FROM claims GROUP BY report_id),
rules AS (SELECT report_id, bool_or(NOT supported) AS bad, {_THIRD} AS third, bool_or(section IN ('implications', 'watch_next') AND kind = 'fact') AS advice, {_LISTED} AS differ FROM checked GROUP BY report_id)
SELECT report_id, {_named("CASE WHEN bad THEN 'unsupported' END, CASE WHEN third THEN 'third_party_fact' END, CASE WHEN NOT coalesce(own, true) THEN 'own_knowledge_missing' END, CASE WHEN NOT coalesce(other, true) THEN 'competitor_missing' END, CASE WHEN advice THEN 'fact_in_advice' END, CASE WHEN differ THEN 'references_differ' END")} AS violations
FROM rules LEFT JOIN compared USING (report_id)""")
def q_report_violations(spark, sf):
    supports, citations = _supports(spark, sf, "report_id")
    return _text(RS.report_violations(supports.select("report_id", "section", "claim_no", "kind", "result_id", "excerpt", "refs"), citations.drop("excerpt")), "report_id")


@query(f"""WITH {_CITED}
SELECT report_id AS answer_id, {_named(f"CASE WHEN bool_or(NOT supported) THEN 'unsupported' END, CASE WHEN {_THIRD} THEN 'third_party_fact' END, CASE WHEN {_LISTED} THEN 'references_differ' END")} AS violations FROM checked GROUP BY report_id""")
def q_follow_up_violations(spark, sf):
    supports, citations = _supports(spark, sf, "answer_id")
    return _text(RS.follow_up_violations(supports.select("answer_id", "kind", "result_id", "excerpt", "refs"), citations.drop("excerpt")), "answer_id")


@query(f"""WITH {_CITED}, v AS (
  SELECT report_id, bool_or(report_id % 3 > 0 AND NOT supported) AS bad, {_LISTED} AND any_value(report_id) % 3 > 0 OR any_value(report_id) % 7 = 4 AND any_value(report_id) % 3 > 0 OR any_value(report_id) % 3 = 0 AS not_new,
    bool_or(report_id % 3 > 0 AND credibility = 'official') AS official, report_id % 4 = 0 AS open FROM checked GROUP BY report_id)
SELECT report_id AS verification_id, {_named("CASE WHEN bad THEN 'unsupported' END, CASE WHEN not_new THEN 'not_new' END, CASE WHEN NOT open AND NOT coalesce(official, false) THEN 'official_missing' END, CASE WHEN open AND report_id % 5 = 0 THEN 'question_missing' END")} AS violations FROM v""")
def q_verification_violations(spark, sf):
    """Every third verification cites nothing, every fourth stays open, every seventh cites what was there before."""
    supports, citations = _supports(spark, sf, "verification_id")
    n, cites = F.col("verification_id"), F.col("verification_id") % 3 > 0
    initial = F.when(n % 7 == 4, F.array(F.concat(F.lit("d"), (n * 10).cast("string"))))
    decision, questions = F.when(n % 4 == 0, "still_pending").otherwise("confirmed"), F.when(n % 5 != 0, 2).otherwise(0)
    rows = supports.select("verification_id", F.when(cites, F.col("result_id")).alias("result_id"), F.when(cites, F.col("excerpt")).alias("excerpt"), decision.alias("decision"), F.col("refs").alias("new_refs"), initial.alias("initial_refs"), questions.alias("n_unresolved"))
    return _text(RS.verification_violations(rows, citations.drop("excerpt")), "verification_id")


_DOC = {
    "domain": "CASE WHEN doc_id % 4 = 0 THEN 'own_product' WHEN doc_id % 29 = 0 THEN NULL ELSE 'competitor' END",
    "source_type": "CASE doc_id % 6 WHEN 0 THEN 'verified_official_content' WHEN 1 THEN 'competition_event' WHEN 2 THEN 'evidence' WHEN 3 THEN 'confirmed_product_state' WHEN 4 THEN 'research_result' END",
    "credibility": "CASE doc_id % 5 WHEN 0 THEN 'user_provided' WHEN 1 THEN 'third_party' WHEN 2 THEN NULL ELSE 'official' END",
    "status": "CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN NULL ELSE 'confirmed' END",
    "reference": "CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('r', doc_id) END",
    "title": "CASE doc_id % 13 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE substr(text, 1, 30) END",
    "url": "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x.example' WHEN 2 THEN 'https://user@x.example/a' ELSE concat('https://x.example/', doc_id) END",
    "observed_at": "CASE doc_id % 8 WHEN 0 THEN '2024-03-01T10:00:00' WHEN 1 THEN '2024-13-01T10:00:00Z' WHEN 2 THEN NULL WHEN 3 THEN '2024-03-01T10:00:00Z' ELSE '2024-03-01T10:00:00+08:00' END",
    "previous_at": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-03-01T03:00:00+00:00' WHEN 2 THEN '2024-02-01T03:00:00' ELSE '2024-02-01T03:00:00Z' END",
}
_DOCS = f"d AS (SELECT doc_id, text, {', '.join(f'{sql} AS {c}' for c, sql in _DOC.items())} FROM documents)"


def _docs(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").selectExpr("doc_id", "text", *[f"{sql} AS {c}" for c, sql in _DOC.items()])


@query(f"""WITH {_DOCS} SELECT doc_id, CASE
  WHEN domain IS NOT DISTINCT FROM 'own_product' THEN CASE WHEN credibility IS DISTINCT FROM 'user_provided' THEN 'own_not_user_provided' END
  WHEN source_type IS NULL OR source_type NOT IN ('verified_official_content', 'competition_event', 'evidence', 'confirmed_product_state') THEN 'type_not_allowed'
  WHEN status IS DISTINCT FROM 'confirmed' THEN 'not_confirmed'
  WHEN coalesce(reference, '') = '' THEN 'verification_missing'
  WHEN source_type IN ('verified_official_content', 'confirmed_product_state') AND credibility IS DISTINCT FROM 'official' THEN 'not_official' END AS violation FROM d""")
def q_knowledge_admission(spark, sf):
    columns = [F.col(c) for c in ("domain", "source_type", "credibility", "status", "reference")]
    return _docs(spark, sf).select("doc_id", R.admission_violation(*columns).alias("violation"))


@query(f"""WITH {_DOCS} SELECT doc_id, {_named("CASE WHEN domain IS NULL THEN 'domain' END, CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN 'title' END, CASE WHEN doc_id % 9 IN (1, 2) THEN 'url' END, CASE WHEN url IS NULL AND reference IS NULL THEN 'source' END, CASE WHEN doc_id % 8 < 3 THEN 'observed_at' END")} AS violations FROM d""")
def q_source_metadata(spark, sf):
    columns = [F.col(c) for c in ("domain", "title", "url", "reference", "observed_at")]
    return _docs(spark, sf).select("doc_id", F.array_join(R.metadata_violations(*columns), ",").alias("violations"))


@query(f"""WITH {_DOCS}, e AS (SELECT *, CASE doc_id % 8 WHEN 3 THEN 10 ELSE CASE WHEN doc_id % 8 > 3 THEN 2 END END AS now_hour FROM d)
SELECT doc_id, {_named(f"CASE WHEN doc_id % 8 < 3 THEN 'current_time_missing' END, CASE WHEN doc_id % 5 = 2 THEN 'previous_time_without_offset' END, CASE WHEN doc_id % 5 = 1 AND now_hour <= 3 THEN 'previous_not_earlier' END, CASE WHEN doc_id % 5 = 0 AND length(text) > 0 THEN 'previous_time_missing' END, CASE WHEN length(text) > {EV.MAX_INPUT_CHARS} THEN 'input_too_large' END")} AS violations FROM e""")
def q_observation_rules(spark, sf):
    """The hour of the current time is 10 or, at an offset of eight hours, 2; the previous one is 3 of the same day, or a month before."""
    columns = [F.col(c) for c in ("previous_at", "observed_at", "text", "text")]
    return _docs(spark, sf).select("doc_id", F.array_join(EV.input_violations(*columns), ",").alias("violations"))


_TURN = {
    "kind": "CASE (conv_id + turn) % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'goal' WHEN 2 THEN 'constraint' WHEN 3 THEN 'decision' END",
    "said": "CASE conv_id % 4 WHEN 0 THEN concat('I prefer this: ', text) WHEN 1 THEN concat('Our goal: ', text) WHEN 2 THEN concat('We decided, and you must keep it: ', text) ELSE text END",
    "content": "CASE turn % 5 WHEN 0 THEN substr(text, 3, 25) WHEN 1 THEN concat(substr(text, 1, 9), ' (sic)') WHEN 2 THEN NULL ELSE substr(text, 1, 12) END",
    "source_kind": "CASE conv_id % 9 WHEN 0 THEN 'event' WHEN 1 THEN NULL ELSE 'conversation' END",
}
_SIGNALS = " OR ".join(f"kind = '{k}' AND (" + " OR ".join(f"contains(lower(said), '{s}')" for s in M.TYPE_SIGNALS[k]) + ")" for k in ("preference", "goal", "constraint", "decision"))


@query(f"""WITH c AS (SELECT conv_id, turn, {", ".join(f"{sql} AS {c}" for c, sql in _TURN.items())} FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '(?i)key|token|secret|password|bearer|sk-'))
SELECT conv_id, turn, CASE WHEN trim(coalesce(said, ''), ' ') = '' THEN 'source_blank' WHEN length(said) > {M.MAX_SOURCE_CHARS} THEN 'source_too_long' WHEN source_kind IS NULL OR source_kind = 'event' THEN 'fact_source'
  WHEN content IS NULL OR NOT contains(said, content) THEN 'not_verbatim' WHEN NOT coalesce({_SIGNALS}, false) THEN 'no_signal' END AS violation FROM c""")
def q_candidate_policy(spark, sf):
    """What users say, with a word of intent before most of it; turns that may hold secrets are another query's."""
    c = t(spark, sf, "conversations").where("role = 'user'").where(~F.col("text").rlike("(?i)key|token|secret|password|bearer|sk-"))
    c = c.selectExpr("conv_id", "turn", *[f"{sql} AS {name}" for name, sql in _TURN.items()])
    return c.select("conv_id", "turn", M.candidate_violation(F.col("content"), F.col("kind"), F.col("said"), F.col("source_kind")).alias("violation"))
