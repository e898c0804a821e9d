"""Registered queries of places in transcripts: contexts of spans, claims of stopped drugs; each beside its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import claims, sessions
from threadline.plans.base import STATEMENTS, matches, named, quoted, register, statements, table

BEFORE = "(PARTITION BY {by} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SPAN = {"span_no": "turn", "span_start": "(turn * 7919 + conv_id * 131) % 4000 - 20", "span_end": "(turn * 7919 + conv_id * 131) % 4000 + 30 + turn % 7 * 40"}
_SPAN = ", ".join(f"{e} AS {n}" for n, e in SPAN.items())


@register(f"""WITH c AS (SELECT *, '[Turn=' || turn || '][Role=' || role || ']' || chr(10) AS header FROM conversations), p AS (SELECT *, CAST(coalesce(sum(length(header) + length(text) + 2) OVER {BEFORE.format(by='conv_id', at='turn')}, 0) AS BIGINT) AS header_start FROM c),
    b AS (SELECT conv_id, turn, role, header_start, header_start + length(header) AS content_start, header_start + length(header) + length(regexp_replace(text, '\\s+$', '')) AS content_end FROM p), s AS (SELECT conv_id, {_SPAN} FROM conversations)
    SELECT s.conv_id, span_no, span_start, span_end, b.turn AS block_turn, b.role AS block_role, header_start AS block_header_start, content_start AS block_content_start, content_end AS block_content_end, span_end > content_end AS crosses
    FROM s LEFT JOIN b ON b.conv_id = s.conv_id AND span_start >= header_start AND span_start < content_end""")
def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that each of a conversation's spans starts in, and whether it runs past it."""
    turns = table(spark, sf_dir, "conversations")
    blocks = sessions.placed_blocks(sessions.transcripts(turns, "conv_id", "turn", "role", "text"), ["conv_id"], "transcript", ("user", "assistant", "system"))
    out = sessions.span_contexts(turns.selectExpr("conv_id", *[f"{e} AS {n}" for n, e in SPAN.items()]), blocks, ["conv_id"])
    return out.drop("block_no", "block_event_time").withColumn("block_turn", F.col("block_turn").cast("long"))


SESSION = ["subject_id", "session_no"]
_CLAIM = f"{matches('t', fx.STOP_CLAIM)} AND NOT {matches('t', '[?？]')} AND {matches('t', fx.STOPPED)} AND len({named('t', fx.MEDICATIONS)}) = 1 AND len({named('t', fx.UNCONFIRMED)}) = 0"
_KINDS = f"list_filter({named('text', fx.CLAIM_KINDS)}, lambda k: k <> 'started' OR NOT list_contains({named('text', fx.CLAIM_KINDS)}, 'restarted'))"
_RECORD = "t"
for _pattern, _by in fx.STOP_WORDS:
    _RECORD = f"regexp_replace({_RECORD}, {quoted(_pattern)}, '{_by}', 'g')"


@register(f"""WITH {STATEMENTS}, h AS (SELECT *, '[Turn=' || state_id || '][Role=' || upper(source_type[1]) || source_type[2:] || ']' || chr(10) AS header FROM st),
    b AS (SELECT *, CAST(coalesce(sum(length(header) + length(text) + 2) OVER {BEFORE.format(by='subject_id, session_no', at='state_id')}, 0) AS BIGINT) + length(header) AS content_start FROM h),
    c AS (SELECT *, unnest(regexp_extract_all(text, '[^，,；;]+[，,；;]?')) AS clause, generate_subscripts(regexp_extract_all(text, '[^，,；;]+[，,；;]?'), 1) AS pos FROM b WHERE source_type = 'patient' AND len({named('text', fx.MEDICATIONS)}) = 1 AND NOT {matches('text', fx.CLAIM_CORRECTION)} AND len({_KINDS}) <= 1),
    p AS (SELECT *, trim(clause) AS t, content_start + CAST(coalesce(sum(length(clause)) OVER {BEFORE.format(by='state_id', at='pos')}, 0) AS BIGINT) + length(clause) - length(ltrim(clause)) AS claim_start FROM c),
    k AS (SELECT *, {named('t', fx.MEDICATIONS)}[1] AS drug FROM p WHERE {_CLAIM}), e AS (SELECT DISTINCT subject_id, session_no, unnest({named('t', fx.MEDICATIONS)}) AS drug FROM (SELECT *, text AS t FROM st WHERE state_id % 3 = 1) WHERE NOT {matches('t', '[?？]')} AND {matches('t', fx.STOPPED)} AND len({named('t', fx.UNCONFIRMED)}) = 0),
    m AS (SELECT subject_id, session_no, drug, min(claim_start) AS claim_start, arg_min(t, claim_start) AS t, arg_min(state_id, claim_start) AS turn FROM k ANTI JOIN e USING (subject_id, session_no, drug) GROUP BY 1, 2, 3)
    SELECT subject_id, session_no, 'medication:' || drug AS medication, 'stopped' AS status, CAST(turn AS VARCHAR) AS turn, claim_start, claim_start + length(t) AS claim_end, t AS claim, regexp_replace({_RECORD}, '^我', '患者') AS record FROM m""")
def completed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs that patients say they stopped and that a session's evidence (one statement in three) does not tell of."""
    rows = statements(spark, sf_dir)
    turns = rows.withColumns({"role": F.initcap("source_type"), "session": F.struct(*SESSION)})
    told = sessions.transcripts(turns, "session", "state_id", "role", "text").select("session.*", "transcript")
    return claims.missing_claims(claims.stop_claims(sessions.placed_blocks(told, SESSION, "transcript"), SESSION), rows.filter("state_id % 3 = 1"), SESSION).select(*SESSION, "medication", "status", "turn", "claim_start", "claim_end", "claim", "record")
