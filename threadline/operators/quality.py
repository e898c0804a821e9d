"""Row validators, leakage guards and redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET_KEYS = ("api_key", "apikey", "authorization", "token", "secret")


def errors(checks: Mapping[str, Column]) -> Column:
    """The messages of the checks that hold (a null check counts as failed), joined by a semicolon."""
    return F.concat_ws(";", *[F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for message, bad in checks.items()])


def missing(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def not_in(column: str, allowed: Sequence[str]) -> Column:
    return ~F.col(column).isin(*allowed)


def outside(column: str, low: float, high: float) -> Column:
    return ~F.col(column).between(low, high)


def observation_errors(session: str, text: str, role: str, roles: Sequence[str]) -> Column:
    return errors({"session is required": missing(session), "text is required": missing(text), "role is unknown": not_in(role, roles)})


def edge_errors(relations: Sequence[str]) -> Column:
    return errors({"from is required": F.col("from_id").isNull(), "to is required": F.col("to_id").isNull(), "self loop": F.col("from_id") == F.col("to_id"), "relation is unknown": not_in("relation", relations)})


def forbidden_keys(payload: str, keys: Sequence[str]) -> Column:
    """Whether a JSON text has one of the keys at any depth."""
    return F.col(payload).rlike('"(?i:' + "|".join(keys) + r')"\s*:')


def redact(text: Column, keys: Sequence[str] = SECRET_KEYS) -> Column:
    """Values of secret keys in JSON or assignments become [REDACTED]; the keys stay."""
    names = "|".join(keys)
    return F.regexp_replace(text, rf'(?i)\b({names})("?\s*[:=]\s*")[^"]*"', '$1$2[REDACTED]"')


def split_by_errors(rows: DataFrame, checks: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine with their errors)."""
    marked = rows.withColumn("errors", checks)
    return marked.filter("errors = ''").drop("errors"), marked.filter("errors <> ''")


# What a record's rows may hold.
SOURCES = ("patient", "doctor", "structured")
FORBIDDEN_SOURCES = ("query", "gold_answer", "answer_options", "judge_score", "future_session", "derived")
POLARITIES = ("affirmed", "negated", "uncertain")
OPERATIONS = ("ADD", "UPDATE", "SUPERSEDE", "RESOLVE", "CONFLICT", "NOOP")
ACTIONS = ("ANSWER", "ASK", "VERIFY", "EDUCATE", "ESCALATE", "REFUSE")
FAMILIES = ("BC", "PE", "PA", "CS", "CP", "LO")
EDGE_FAMILIES = ("temporal", "clinical_care")
RELATIONS = ("persists", "updates", "supersedes", "resolves", "recurs", "conflicts", "informs", "motivates", "constrains", "followed_by", "contributes_to")
EDGE_STATUSES = ("candidate", "verified", "rejected")
SUPPORTS = ("asserted", "structural", "hypothesized")
OBSERVATION_FIELDS = ("observation_id", "subject_id", "source_type", "episode_id", "turn_id", "event_time", "raw_text")


def required(*columns: str) -> dict[str, Column]:
    return {f"{c} must be a non-empty string": missing(c) for c in columns}


def payload_errors(payload: str) -> Column:
    """Errors of an observation in JSON: fields that must be there, its source, its time, fields that nobody knows."""
    fields = F.from_json(payload, "map<string,string>")
    value = lambda n: F.try_element_at(fields, F.lit(n))
    empty = lambda n: F.trim(F.coalesce(value(n), F.lit(""))) == ""
    source = value("source_type")
    extra = F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, OBSERVATION_FIELDS))))
    time = value("event_time")
    return F.concat_ws(
        ";", *[F.when(empty(n), f"{n} must be a non-empty string") for n in ("subject_id", "source_type", "episode_id", "turn_id", "raw_text")], F.when(~F.coalesce(source.isin(*SOURCES), F.lit(False)), "source_type is unknown"),
        F.when(source.isin(*FORBIDDEN_SOURCES), F.concat(source, F.lit(" is not a core observation source"))), F.when((F.coalesce(time, F.lit("")) != "") & time.try_cast("timestamp").isNull(), "event_time must be ISO-compatible"),
        F.when(F.size(extra) > 0, F.concat(F.lit("unsupported observation fields: "), F.array_join(extra, ", "))),
    )


def evidence_errors() -> Column:
    """Of rows with evidence_id, subject_id, text, source_type, polarity, certainty, span_start and span_end."""
    span = F.col("span_start").isNotNull() & ((F.col("span_start") < 0) | ~F.coalesce(F.col("span_end") > F.col("span_start"), F.lit(False)))
    return errors({**required("evidence_id", "subject_id", "text", "source_type"), "invalid evidence source_type": not_in("source_type", SOURCES), "invalid polarity": not_in("polarity", POLARITIES), "certainty must be 0..1": outside("certainty", 0, 1), "span must be null or integer [start,end) offsets": span})


def state_errors() -> Column:
    return errors({**required("state_id", "subject_id", "family", "value", "status"), "invalid state family": not_in("family", FAMILIES), "state requires evidence_ids": F.size("evidence_ids") <= 0, "version_chain must be an array": F.col("version_chain").isNull()})


def delta_errors() -> Column:
    return errors({"invalid operation": not_in("operation", OPERATIONS), "invalid family": not_in("family", FAMILIES), **required("evidence_id")})


def graph_edge_errors() -> Column:
    return errors({
        **required("edge_id", "subject_id", "from_id", "to_id", "edge_family", "relation", "status"), "invalid edge_family": not_in("edge_family", EDGE_FAMILIES), "invalid relation_type": not_in("relation", RELATIONS), "invalid edge status": not_in("status", EDGE_STATUSES),
        "invalid support_kind": not_in("support", SUPPORTS), "graph edge cannot be a self-loop": F.col("from_id").eqNullSafe(F.col("to_id")), "graph edge requires evidence_ids": F.size("evidence_ids") <= 0, "confidence must be 0..1": outside("confidence", 0, 1),
        "patient graph edge must be persistent": ~F.col("persistent"), "patient graph edge cannot claim causality": F.col("causal"),
    })


def action_errors() -> Column:
    return errors({"invalid action type": not_in("type", ACTIONS), "required_evidence_ids must be array": F.col("required_evidence_ids").isNull(), "content constraints must be arrays": F.col("required_content").isNull() | F.col("forbidden_content").isNull(), **required("explanation")})


def redact_json(payload: Column, keys: Sequence[str] = SECRET_KEYS) -> Column:
    """Values of secret keys at any depth of a JSON text, be they strings, numbers, literals, or flat lists and objects."""
    names = "|".join(keys)
    value = r'(?:"(?:[^"\\]|\\.)*"|\[[^\[\]]*\]|\{[^{}]*\}|[^,}\]\s]+)'
    return F.regexp_replace(payload, rf'("(?i:{names})"\s*:\s*){value}', '$1"[REDACTED]"')
