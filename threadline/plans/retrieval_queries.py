"""Registered queries of retrieval in one call, over a stored index of the statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import evidence_index as ei
from threadline.operators import selection
from threadline.operators import states as st
from threadline.operators.tables import by_key, materialize
from threadline.plans.base import register, statements
from threadline.plans.outcome_queries import GATE, kin_of
from threadline.plans.ranking_queries import DIVERSIFIED, INDEXED, LIMIT_SQL, SCHEDULE, SCORED, questions
from threadline.plans.state_queries import searchable


def indexed_record(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ei.Index]:
    """Statements, the questions about their subjects, and the index of the statements."""
    rows = statements(spark, sf_dir)
    states = searchable(rows).select("subject_id", "state_id", "family", "status", "polarity", "session_no", "seconds", "text", "searchable")
    return rows, materialize(questions(rows).withColumn("subject_id", F.col("query_id")), "questions"), ei.build_index(states)


@register(f"WITH RECURSIVE {GATE} SELECT query_id, state_id, pick, ['direct', 'related', 'facet', 'fill'][n] AS step FROM gate")
def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage gate over the blocks of the index that can matter; its choice is that over all states."""
    rows, asked, index = indexed_record(spark, sf_dir)
    return ei.gate(asked, materialize(kin_of(rows), "kin"), index)


def chosen_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gate's choice with each state's hits, the links to evidence, and the version before each state."""
    rows, asked, index = indexed_record(spark, sf_dir)
    related = materialize(kin_of(rows), "kin")
    read = ei.gate_reads(asked, related, index)
    picked = selection.coverage_gate(read, related).join(by_key(read.select("query_id", "state_id", "task", "lexical_hits", "value_hits")), ["query_id", "state_id"])
    return materialize(picked, "chosen"), st.links_of(rows), materialize(lineage_of(rows), "lineage")


def lineage_of(rows: DataFrame) -> DataFrame:
    return rows.select("state_id", F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id")).alias("other_id")).filter("other_id is not null")


LINEAGE = "lin AS (SELECT * FROM (SELECT state_id, lag(state_id) OVER (PARTITION BY subject_id, family ORDER BY state_id) AS other_id FROM st) WHERE other_id IS NOT NULL)"
CHAIN = f"""{GATE}, {LINEAGE}, ch AS (SELECT query_id, state_id, pick, task, len(hits) > 0 AS lexical, len(list_filter(terms, lambda t: contains(body, t))) > 0 AS direct_hit FROM gate)"""


@register(f"WITH RECURSIVE {CHAIN} SELECT query_id, state_id, CASE WHEN direct_hit THEN 'direct' WHEN state_id IN (SELECT state_id FROM lin) THEN 'bridge' ELSE 'support' END AS role FROM ch")
def evidence_chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of each state that a question may use."""
    chosen, _, lineage = chosen_states(spark, sf_dir)
    return ei.chain_nodes(chosen, lineage)


@register(f"""WITH RECURSIVE {CHAIN}, ed AS (SELECT a.query_id, lin.other_id AS from_id, a.state_id AS to_id, 'state_transition' AS type FROM ch a JOIN lin ON lin.state_id = a.state_id JOIN ch b ON b.query_id = a.query_id AND b.state_id = lin.other_id
        UNION SELECT a.query_id, a.state_id, b.state_id, 'same_evidence' FROM ch a JOIN links x ON x.state_id = a.state_id JOIN links y ON y.evidence_id = x.evidence_id AND y.state_id <> a.state_id JOIN ch b ON b.query_id = a.query_id AND b.state_id = y.state_id),
    rt AS (SELECT query_id, coalesce(arg_min(state_id, pick) FILTER (lexical), arg_min(state_id, pick)) AS root FROM ch GROUP BY 1)
    SELECT * FROM ed UNION ALL SELECT ch.query_id, root, ch.state_id, CASE WHEN task IN {fx.COMPLEX_TASKS} THEN 'supports_decision' ELSE 'supports_answer' END FROM ch JOIN rt ON rt.query_id = ch.query_id
    WHERE ch.state_id <> root AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.query_id = ch.query_id AND (ed.from_id = ch.state_id OR ed.to_id = ch.state_id))""")
def evidence_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds the states of a question's chain together."""
    return ei.chain_edges(*chosen_states(spark, sf_dir))


_SCORES, _ORDER = SCORED.split("    tr AS (")
_INDEX = INDEXED[INDEXED.index("raw AS (") :].replace("pr AS (SELECT st.state_id", "ipr AS (SELECT st.state_id").replace("FROM pr)", "FROM ipr)")
_TURNS = "held AS (" + SCHEDULE.split("held AS (", 1)[1]
_DIVERSE = "wt AS (" + DIVERSIFIED.split("wt AS (", 1)[1].replace("od.*", "dv.*").replace("FROM od JOIN", "FROM dv JOIN")
RETRIEVED = f"""{_SCORES}{_INDEX}, {GATE[len(INDEXED) + 1 :]},
    q1 AS (SELECT sc.* EXCLUDE (reasons), CASE WHEN g.state_id IS NULL THEN reasons ELSE list_append(reasons, 'evidence_index_gate') END AS reasons FROM sc LEFT JOIN gate g ON g.query_id = sc.query_id AND g.state_id = sc.state_id WHERE g.state_id IS NOT NULL OR len(reasons) > 0),
    lin AS (SELECT * FROM (SELECT state_id, lag(state_id) OVER (PARTITION BY subject_id, family ORDER BY state_id) AS other_id FROM st) WHERE other_id IS NOT NULL), ways AS (SELECT * FROM lin UNION ALL SELECT other_id, state_id FROM lin),
    beside AS (SELECT query_id, ways.other_id AS state_id, arg_min(score, q1.state_id) AS near FROM q1 JOIN ways ON ways.state_id = q1.state_id WHERE task = 'state_update' GROUP BY 1, 2),
    q2 AS (SELECT * FROM q1 UNION ALL BY NAME SELECT sc.* EXCLUDE (reasons, score, option_ids, mf), round(greatest(0.7, near - 1.25), 4)::DOUBLE AS score, CAST([] AS VARCHAR[]) AS option_ids, CAST([] AS VARCHAR[]) AS mf, ['version_chain_context'] AS reasons
        FROM sc JOIN beside ON beside.query_id = sc.query_id AND beside.state_id = sc.state_id WHERE NOT EXISTS (SELECT 1 FROM q1 WHERE q1.query_id = sc.query_id AND q1.state_id = sc.state_id)),
    tr AS ({_ORDER.replace('FROM sc WHERE len(reasons) > 0', 'FROM q2')}, {_TURNS},
    ek AS (SELECT state_id, string_agg(DISTINCT CAST(evidence_id AS VARCHAR), '|' ORDER BY CAST(evidence_id AS VARCHAR)) AS evidence_key FROM links GROUP BY 1),
    same AS (SELECT sd.*, concat_ws(chr(1), polarity, trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), evidence_key) AS same FROM sd LEFT JOIN ek USING (state_id)),
    gr AS (SELECT query_id, arg_min(state_id, schedule) AS state_id, arg_min(family, schedule) AS family, any_value(task) AS task, min(schedule) AS schedule, max(score) AS score, list(state_id ORDER BY schedule) AS members, list_sort(list_distinct(flatten(list(reasons)))) AS reasons, list_distinct(flatten(list(option_ids))) AS option_ids, list_distinct(flatten(list(mf))) AS mf FROM same GROUP BY query_id, same),
    gl AS (SELECT *, {LIMIT_SQL} AS most, count(*) OVER (PARTITION BY query_id) AS n_groups FROM gr),
    quota AS (SELECT DISTINCT query_id, state_id FROM (SELECT query_id, state_id, row_number() OVER (PARTITION BY query_id, o ORDER BY schedule) AS nth FROM (SELECT *, unnest(option_ids) AS o FROM gl WHERE task = 'multiple_choice')) WHERE nth <= 6),
    by_option AS (SELECT * FROM (SELECT gl.*, row_number() OVER (PARTITION BY query_id ORDER BY (query_id, state_id) IN (SELECT query_id, state_id FROM quota) DESC, schedule) AS nth FROM gl WHERE task = 'multiple_choice' AND n_groups > most) WHERE nth <= most),
    dv AS (SELECT query_id, state_id, schedule AS place, family, reasons, mf FROM gl WHERE task IN {fx.COMPLEX_TASKS} AND n_groups > most), {_DIVERSE},
    plain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY schedule) AS nth FROM gl WHERE n_groups <= most OR task <> 'multiple_choice' AND task NOT IN {fx.COMPLEX_TASKS}) WHERE nth <= most),
    diverse AS (SELECT query_id, state_id, row_number() OVER (PARTITION BY query_id ORDER BY step, CASE WHEN step BETWEEN 2 AND 4 THEN -weight END, CASE WHEN step BETWEEN 2 AND 4 THEN family END, place) AS pick FROM s2),
    picked AS (SELECT query_id, state_id, schedule AS at_place FROM plain UNION ALL SELECT query_id, state_id, schedule FROM by_option UNION ALL SELECT query_id, state_id, pick FROM diverse JOIN gl USING (query_id, state_id) WHERE pick <= most),
    proof AS (SELECT query_id, state_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY evidence_id) AS evidence_ids FROM (SELECT DISTINCT m.query_id, m.state_id, l.evidence_id FROM (SELECT query_id, state_id, unnest(members) AS member FROM gl) m JOIN links l ON l.state_id = m.member) GROUP BY 1, 2)"""


@register(f"""WITH RECURSIVE {RETRIEVED} SELECT p.query_id, row_number() OVER (PARTITION BY p.query_id ORDER BY at_place) AS rank, p.state_id, gl.score, array_to_string(gl.reasons, ',') AS reasons, array_to_string(members, ',') AS members, evidence_ids
    FROM picked p JOIN gl ON gl.query_id = p.query_id AND gl.state_id = p.state_id LEFT JOIN proof ON proof.query_id = p.query_id AND proof.state_id = p.state_id""")
def retrieved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question about a subject is answered from."""
    rows, asked, index = indexed_record(spark, sf_dir)
    return ei.retrieve(asked, materialize(kin_of(rows), "kin"), materialize(lineage_of(rows), "lineage"), materialize(st.links_of(rows), "links"), index)
