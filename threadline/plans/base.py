"""The registry of record queries, and the rows that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FACTORS = 10


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: the user is the subject, the event type the family, a bucket of props.k the factor."""
    factor = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(FACTORS))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("family"), factor.alias("factor_key"), F.col("ts").alias("event_ts"), "value", F.col("event_id").alias("ingest_seq"))


# ---- statements ----------------------------------------------------------------------------------------------------

#: What an event says, by props.k: the events table holds no prose, and the rules need words to act on.
PHRASES = (
    "patient is taking metformin 500 mg", "patient stopped metformin", "the fasting glucose is 7.1 mmol/l", "患者空腹血糖 6.5 mmol/L", "pain went away after treatment", "no nausea today, not at all",
    "patient may have anxiety about cost and insurance", "患者正在服用二甲双胍", "because of insulin the plan cannot change", "follow-up visit: measure blood pressure 120 mmHg", "hello, thank you doctor",
    "glucose verified after review, 7.1 mmol/l", "sleep is worse, missed a dose of insulin", "restarted amoxicillin 250 mg following surgery", "UACR 30 mg/g and HbA1c 6.8 %", "work and family support, therefore we prefer home care",
    "我把二甲双胍停了", "医生建议停药", "I am taking Tylenol", "if the pain returns, resume ibuprofen", "既往病史: 过敏, 禁忌青霉素", "血压升高, 较前恶化", "Patient: weight 82 kg", "what is the latest test result?",
)
PREFIXES = ("", "", "Actually, ", "", "currently ", "", "no longer: ")
TASKS = ("entity_exact_match", "temporal_localization", "state_update", "multiple_choice", "inference_generation", "multi_hop_clinical_deduction", "generic")


def _pick(values: tuple[str, ...], by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: The columns of a statement, in SQL that both engines read, over events with props.k as k and ts as seconds and day number.
STATEMENT = {
    "state_id": "event_id", "subject_id": "user_id", "seconds": "seconds", "session_no": "session_no", "ingest_seq": "(event_id % 7) * 1000000000 + event_id",
    "family": "CASE WHEN event_id % 9 = 4 THEN 'PA' WHEN event_type = 'signup' THEN 'BC' WHEN event_type = 'view' THEN 'PE' WHEN event_type = 'click' THEN 'CS' WHEN event_type = 'purchase' THEN 'CP' ELSE 'LO' END",
    "source_type": _pick(("patient", "doctor", "structured"), "event_id"),
    "polarity": "CASE WHEN event_id % 7 = 3 THEN 'negated' WHEN event_id % 11 = 5 THEN 'uncertain' ELSE 'affirmed' END",
    "certainty": "CAST(CASE WHEN event_id % 11 = 5 THEN 0.55 ELSE 1 END AS DOUBLE)",
    "status": "CASE WHEN event_id % 13 = 6 THEN 'conflict' WHEN event_id % 8 = 1 THEN 'resolved' ELSE 'active' END",
    "text": f"concat({_pick(PREFIXES, 'event_id')}, {_pick(PHRASES, 'k')})",
    "evidence_id": "user_id * 100000 + session_no * 24 + CAST(floor(seconds / 3600) AS BIGINT) % 24",
    "other_evidence_id": "CASE WHEN event_id % 4 = 0 THEN user_id * 100000 + 90000 + k % 5 END",
    "supersedes": "CASE WHEN event_id % 5 = 2 THEN event_id - 10 END",
    "task": _pick(TASKS, "event_id"),
}
_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in STATEMENT.items())
STATEMENTS = f"""st AS (SELECT {_COLUMNS} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS session_no FROM events))"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements of a record: states with text, family, source, polarity, evidence and a lineage."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "seconds": F.unix_seconds(ts), "session_no": (F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long")})
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in STATEMENT.items()])


def quoted(pattern: str) -> str:
    """A pattern as an SQL string of the other engine, whose names of scripts differ."""
    return "'" + pattern.replace("\\p{IsHan}", "\\p{Han}").replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def named(column: str, rules: dict[str, str] | tuple) -> str:
    """A list of the names of the rules whose pattern the column has."""
    pairs = rules.items() if isinstance(rules, dict) else rules
    return "list_filter([" + ", ".join(f"CASE WHEN {matches(column, p)} THEN '{n}' END" for n, p in pairs) + "], lambda x: x IS NOT NULL)"
