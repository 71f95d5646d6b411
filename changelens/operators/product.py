"""Product rules around a run: inputs, steps, ingest identity, views for models, preferences, rescoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions.identity import all_keys
from changelens.functions.text import contains_secret, list_identity
from changelens.functions.urls import authority, is_valid
from changelens.operators.metrics import run_summary, score_case

# Keys that outputs never carry, and expectations of other stages that a gold record may not hold.
SECRET_FIELDS = ("api_key", "authorization", "password", "secret", "access_token", "refresh_token")
OTHER_STAGES = ("state_matching_expected", "contextual_diff_expected", "contextual_state_diff_expected")
MEANINGFUL = ("paragraph", "list", "table", "code")
MODEL_VIEW = ("result_id", "source", "source_group", "domain", "title", "content", "credibility", "status")
ID_CHARS, PROFILE_CHARS, FOCUS_CHARS, MANY = 200, 4000, 2000, 20


def _some(rules: Column) -> Column:
    return F.filter(rules, lambda x: x.isNotNull())


def unsafe_text(text: Column) -> Column:
    """A text that holds a secret, or nothing but white space; an empty one and NULL pass."""
    return contains_secret(text) | ((F.length(text) > 0) & (F.trim(text) == ""))


def unsafe_url(url: Column) -> Column:
    return ~is_valid(url) | F.contains(authority(url), F.lit("@")) | contains_secret(url)


def input_violations(workspace: Column, product: Column, competitor: Column, official: Column, more: Column, profile: Column, focus: Column) -> Column:
    """Names of the rules that a product's input breaks."""
    length = lambda c, most: (F.coalesce(F.length(c), F.lit(0)) < 1) | (F.length(c) > most)
    texts = (workspace, product, competitor, profile, focus)
    bad = F.exists(F.coalesce(more, F.array().cast("array<string>")), unsafe_url)
    return _some(F.array(
        F.when(length(workspace, ID_CHARS), "workspace_length"), F.when(product.isNotNull() & length(product, ID_CHARS), "product_length"),
        F.when(length(competitor, ID_CHARS), "competitor_length"), F.when(F.length(profile) > PROFILE_CHARS, "profile_length"), F.when(F.length(focus) > FOCUS_CHARS, "focus_length"),
        F.when(F.exists(F.array(*texts), lambda x: F.coalesce(unsafe_text(x), F.lit(False))), "unsafe_text"),
        F.when((official.isNotNull() & (official != "") & unsafe_url(official)) | bad, "unsafe_url"), F.when(F.size(more) > MANY, "too_many_urls"),
    ))


def scope_id(workspace: Column, product: Column) -> Column:
    """Identity of a product's knowledge; of the workspace alone (as a JSON string) without a product."""
    alone = F.regexp_replace(F.to_json(F.array(workspace)), r"^\[|\]$", "")
    return F.when(product.isNotNull(), list_identity(workspace, product)).otherwise(F.sha2(alone, 256))


def ingest_fingerprint(document_json: Column, max_chars: int, space_id: str, version: str = "structure-v1") -> Column:
    """sha256 over document (canonical JSON), chunking version, size and vector space, as JSON with sorted keys."""
    text = F.concat(F.lit(f'{{"chunking": "{version}", "document": '), document_json, F.lit(f', "max_chars": {max_chars}, "space_id": "{space_id}"}}'))
    return F.sha2(text, 256)


def replace_chunks(current: DataFrame, incoming: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks after an ingest: those of documents inserted or updated by `plan` (keys, outcome) are replaced, all others stay."""
    moved = plan.where("outcome <> 'unchanged'").select(*keys).distinct()
    return current.join(moved, keys, "left_anti").unionByName(incoming.join(moved, keys, "left_semi"))


def store_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents")).join(chunks.agg(F.count("*").alias("chunks")))


def semantic_view(facts: list[str], evidence: str = "evidence") -> Column:
    """JSON of what two events are compared by: facts, and of each piece of evidence its source, status, claims and excerpt; no ids, no observation times."""
    shown = ("source_url", "source_credibility", "evidence_status", "evidence_capability", "relevant_excerpt")
    view = F.transform(evidence, lambda e: F.struct(*[e[c].alias(c) for c in shown]))
    return F.to_json(F.struct(*facts, view.alias("evidence")), {"ignoreNullFields": "false"})


def local_context(changes: Column) -> Column:
    """JSON of the headings, headers, context and card title of each change, absent ones left out; NULL without changes."""
    part = lambda c: F.struct(*[c[k].alias(k) for k in ("heading_path", "headers", "context_blocks", "card_title")])
    return F.when(F.size(changes) > 0, F.to_json(F.transform(changes, part)))


def model_items(citations: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Citations as a model sees them: no addresses, no storage paths; of `ids` only, if given."""
    return (citations if ids is None else citations.where(F.col("result_id").isin(*ids))).select(*MODEL_VIEW)


def research_view(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Public state of each research task: the result of a completed one, a stable error of a failed one."""
    joined = states.join(artifacts.select("namespace", "key", "result"), ["namespace", "key"], "left")
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    return joined.select("event_id", F.lit(True).alias("recommended"), "status", F.when(done, F.col("result")).alias("result"), F.when(failed, F.coalesce("error_type", F.lit("research_error"))).alias("error_type"))


def has_meaningful_blocks(types: Column, cards: Column) -> Column:
    """Whether a state has content of its own: text, list, table, code, or a group with cards; headings alone aren't."""
    pairs = F.arrays_zip(types.alias("type"), cards.alias("cards"))
    return F.exists(pairs, lambda b: b["type"].isin(*MEANINGFUL) | ((b["type"] == "group") & (F.coalesce(b["cards"], F.lit(0)) > 0)))


def secret_fields(body: Column) -> Column:
    """Keys of JSON text, at any depth, that an output may not carry."""
    return F.array_intersect(all_keys(body), F.array(*map(F.lit, SECRET_FIELDS)))


def legacy_violations(records: DataFrame, expected: str = "expected") -> DataFrame:
    """case_id, violations of legacy gold records: an id, used once, and no expectation of another stage at any depth."""
    over = W.partitionBy("case_id")
    foreign = F.arrays_overlap(all_keys(F.col(expected)), F.array(*map(F.lit, OTHER_STAGES)))
    marked = records.withColumn("_foreign", F.coalesce(foreign, F.lit(False))).withColumn("_n", F.count("*").over(over))
    missing = F.trim(F.coalesce("case_id", F.lit(""))) == ""
    rules = F.array(F.when(missing, "case_id_missing"), F.when(F.col("_n") > 1, "duplicate_case"), F.when(F.col("_foreign"), "forbidden_field"))
    return marked.select("case_id", _some(rules).alias("violations"))


def filter_cases(records: DataFrame, case_id: str | None = None, path: str | None = None) -> DataFrame:
    """The cases of an id, a path, or both; none left is an error."""
    for column, wanted in (("case_id", case_id), ("path", path)):
        records = records if wanted is None else records.where(F.col(column) == wanted)
    if not records.limit(1).count():
        raise ValueError("no case matches")
    return records


def rescore(gold: DataFrame, saved: DataFrame) -> DataFrame:
    """The run summary of saved predictions against gold, without a model call; a case without a prediction is BLOCKED."""
    joined = gold.join(saved, "case_id", "left").withColumn("execution_status", F.coalesce("execution_status", F.lit("BLOCKED")))
    return run_summary(score_case(joined))


def pending_steps(planned: DataFrame, steps: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, key) that a resumed run has to do: its steps that aren't complete, unless it has a result that isn't failed."""
    final = results.where("status <> 'failed'").select("run_id").distinct()
    done = steps.where("status = 'complete'").select("run_id", "key").distinct()
    return planned.join(final, "run_id", "left_anti").join(done, ["run_id", "key"], "left_anti").select("run_id", "key")
