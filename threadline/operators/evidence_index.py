"""A stored index of a record's states, and retrieval for questions in one call.

States are kept in blocks of one subject, family and run of like texts (by the least hashes of their terms). A block tells
which runs of two and three characters its texts hold (hashed), which facets they can cover, how many states it has and which statuses: enough to
bound from above what any of its states could score for a question. The gate
scores the blocks of highest bound until they hold as many states as the question may use, and the worst of these is the score to
beat: a block whose bound is below it is never read. Blocks that may cover a facet that is still open, and those that
hold what is related to a direct hit, are read too, so that the gate's choice is that over all states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.functions.text import nfkc_lower
from threadline.operators import ranking, selection
from threadline.operators.retrieval import terms
from threadline.operators.tables import by_key, materialize

#: States of a block, on average.
BLOCK_STATES = 16
#: Facets that depend on the question or the status.
SPECIAL = ("direct_facts", "event_time", "option_evidence", "current_status", "previous_state")
#: Hashed runs of two and three characters; a block lists those that its texts hold.
BUCKETS = 1 << 16
#: States that are read first for each that a question may use; not all of them match.
SEEDS = 4
#: Texts of a block whose characters are read in one piece.
PIECE_STATES = 1024
BLOCK = ["subject_id", "family", "run"]


@dataclass(frozen=True)
class Index:
    """``states``: rows with their block's ``run``; ``blocks``: a row a block. Both are tables in the shared folder."""

    states: DataFrame
    blocks: DataFrame


def hashed(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def grams(text: Column) -> Column:
    """Hashes of the runs of two and of three characters of a text."""
    return F.array_distinct(F.concat(hashed(text, "(?s)(?=(..))"), hashed(text, "(?s)(?=(...))")))


def term_grams(term: Column) -> Column:
    """What a text that holds the term holds."""
    return F.array_distinct(F.when(F.length(term) > 2, hashed(term, "(?s)(?=(...))")).otherwise(hashed(term, "(?s)(?=(..))")))


def block_grams(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, grams): the distinct texts of a block are read as one, with a mark between them that no term holds; large blocks in pieces."""
    piece = F.pmod(F.xxhash64("state_id"), F.ceil(F.col("n_states") / PIECE_STATES))
    texts = by_key(rows).join(sizes.select(*BLOCK, "n_states"), BLOCK).groupBy(*BLOCK, "n_states", piece.alias("piece")).agg(F.collect_set("searchable").alias("texts"))
    read = texts.select(*BLOCK, "n_states", grams(F.array_join("texts", "\u0000")).alias("grams"))
    large = read.filter(F.col("n_states") > PIECE_STATES).select(*BLOCK, F.explode("grams").alias("gram")).groupBy(*BLOCK).agg(F.collect_set("gram").alias("grams"))
    return read.filter(F.col("n_states") <= PIECE_STATES).select(*BLOCK, "grams").unionByName(large)


def build_index(states: DataFrame, block_states: int = BLOCK_STATES) -> Index:
    """``states``: subject_id, state_id, family, status, polarity, session_no, seconds, text, searchable."""
    text = F.col("searchable")
    least = lambda seed: F.array_min(F.transform(terms(text), lambda t: F.xxhash64(F.lit(seed), t)))
    sizes = states.groupBy("subject_id", "family").agg(F.ceil(F.count("*") / block_states).alias("runs"))
    like = F.pmod(F.xxhash64(least(1), least(2), least(3), F.col("status")), F.col("runs")).cast("long")
    rows = materialize(states.join(sizes, ["subject_id", "family"]).withColumn("run", like).drop("runs"), "states")
    sets = lambda values, name: rows.select(*BLOCK, F.explode(values).alias(name)).groupBy(*BLOCK).agg(F.collect_set(name).alias(name))
    status = F.when(rules.has(text, fx.FACET_PATTERNS["current_status"]), F.array(F.lit("current_status"))).otherwise(F.array().cast("array<string>"))
    held = F.concat(F.array_except(rules.facets_of(F.col("family"), text), F.array(*map(F.lit, SPECIAL))), status)
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("n_states"), F.collect_set("status").alias("statuses"))
    return Index(rows, materialize(sizes.join(block_grams(rows, sizes), BLOCK, "left").join(sets(held, "held"), BLOCK, "left"), "blocks"))


def bounds(questions: DataFrame, index: Index) -> DataFrame:
    """(query_id, block, n_states, bound, may_match, facets): what the states of each block of a question's subject could score at most."""
    c = F.col
    text = F.concat_ws(" ", "question", "target", F.array_join("keywords", " "), F.array_join(F.transform("options", lambda o: o["text"]), " "))
    spread = questions.repartition(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "subject_id")
    asked = spread.select("query_id", F.col("subject_id"), "operator", "scopes", rules.coverage_facets(c("facets"), c("task"), c("question")).alias("required"),
        F.transform(ranking.query_terms(text), term_grams).alias("terms"), term_grams(nfkc_lower(c("target"))).alias("target"), F.transform("options", lambda o: F.transform(terms(o["text"]), term_grams)).alias("options"))
    # A question's few numbers go to its subject's blocks; the subject is the key. A block's many numbers are gone through once a question.
    asked = asked.withColumn("sought", F.array_distinct(F.concat(F.flatten("terms"), F.coalesce("target", F.array().cast("array<int>")), F.flatten(F.flatten("options")))))
    rows = by_key(asked).join(index.blocks, "subject_id").withColumn("present", F.array_intersect("sought", F.coalesce("grams", F.array().cast("array<int>"))))
    has = lambda x: F.size(F.array_except(x, "present")) == 0
    rows = rows.withColumns({"n_terms": F.size(F.filter("terms", has)), "n_options": F.size(F.filter("options", lambda o: F.exists(o, has))), "scope": F.exists("scopes", lambda s: F.substring(s, 1, 2) == c("family"))})
    active, other = F.array_contains("statuses", "active"), F.size(F.array_remove("statuses", "active")) > 0
    may_target = F.coalesce(has(c("target")), F.lit(False))
    special = {"direct_facts": (c("n_terms") > 0) | may_target, "event_time": F.lit(True), "option_evidence": c("n_options") > 0, "current_status": active, "previous_state": other}
    able = F.filter(F.array(*[F.when(test, F.lit(f)) for f, test in special.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("facets", F.array_intersect("required", F.concat(able, F.coalesce("held", F.array().cast("array<string>")))))
    bound = F.least(F.lit(24), "n_terms") * 5 + c("scope").cast("int") * 3 + c("n_options") * 5 + F.size("facets") * 1.25 + F.when(may_target, 6).otherwise(0) + (c("operator").isin("current", "latest") & active).cast("int") + ((c("operator") == "history") & (c("family") == "BC")).cast("int")
    return rows.select("query_id", *BLOCK, "n_states", F.round(bound + 0.001, 3).alias("bound"), ((c("n_terms") > 0) | c("scope") | (c("n_options") > 0)).alias("may_match"), "facets")


def read(questions: DataFrame, index: Index, blocks: DataFrame) -> DataFrame:
    """The gate's scores of the states of the given blocks (query_id and block)."""
    # What is worked out of a question comes last, so that it is not shuffled with each of the blocks.
    pairs = blocks.select("query_id", *BLOCK).join(by_key(index.states), BLOCK).join(by_key(ranking.with_terms(questions.drop("subject_id"))), "query_id")
    return ranking.index_score(pairs)


def gate_reads(questions: DataFrame, related: DataFrame, index: Index) -> DataFrame:
    """Scored (question, state) pairs from which the coverage gate chooses as it would from all pairs."""
    c = F.col
    most = max(x[0] for x in selection.GATE_LIMITS.values())
    known = materialize(bounds(questions, index), "bounds")
    before = W.partitionBy("query_id").orderBy(F.desc("bound"), "family", "run")
    ranked = known.filter("may_match").withColumn("before", F.coalesce(F.sum("n_states").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = materialize(read(questions, index, ranked.filter(c("before") < SEEDS * most)), "first")
    signal = (c("lexical_hits") > 0) | c("scope_hit") | (c("option_hits") > 0)
    worst = first.filter(signal).withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gate_score")))).filter(c("nth") == most).select("query_id", F.col("gate_score").alias("to_beat"))
    second = ranked.filter(c("before") >= SEEDS * most).join(worst, "query_id", "left").filter(c("to_beat").isNull() | (c("bound") >= c("to_beat")))
    scored = materialize(first.unionByName(read(questions, index, second)), "second")

    direct = selection.with_direct(scored)
    covering = direct.withColumn("facet", F.explode("gate_facets")).filter(selection.coverable(F.lit(False)))
    sure = covering.filter("relevant").select("query_id", "facet").distinct()
    # An open facet takes one of its first: as many as there are facets may be gone, and as many as are related.
    anchors, each = (max(x[i] for x in selection.GATE_LIMITS.values()) for i in (2, 3))
    spare = covering.filter("not direct").withColumn("nth", F.row_number().over(W.partitionBy("query_id", "facet").orderBy("place"))).filter(c("nth") == F.size("required") + anchors * each).select("query_id", "facet", F.col("gate_score").alias("to_beat"))
    unseen = known.join(scored.select("query_id", *BLOCK).distinct(), ["query_id", *BLOCK], "left_anti")
    open_blocks = unseen.filter("may_match").withColumn("facet", F.explode("facets")).join(sure, ["query_id", "facet"], "left_anti").join(spare, ["query_id", "facet"], "left").filter(c("to_beat").isNull() | (c("bound") >= c("to_beat"))).select("query_id", *BLOCK)
    kin = direct.filter("relevant").select("query_id", "state_id").join(related, "state_id").filter(c("nth") <= max(x[3] for x in selection.GATE_LIMITS.values()))
    kin = kin.select("query_id", c("other_id").alias("state_id")).join(by_key(index.states.select("state_id", *BLOCK)), "state_id").select("query_id", *BLOCK)
    third = open_blocks.union(kin.join(unseen, ["query_id", *BLOCK], "left_semi")).distinct()
    return materialize(scored.unionByName(read(questions, index, third)), "reads")


def gate(questions: DataFrame, related: DataFrame, index: Index) -> DataFrame:
    """The coverage gate of each question (with ``subject_id``) over what the index lets it read."""
    return selection.coverage_gate(gate_reads(questions, related, index), related)


# ---- chains --------------------------------------------------------------------------------------------------------


def chain_nodes(chosen: DataFrame, lineage: DataFrame) -> DataFrame:
    """(query_id, state_id, role): direct if the value has the question's words, bridge if a version stands before it, else support.

    ``chosen``: query_id, state_id, pick, task, lexical_hits, value_hits; ``lineage``: (state_id, other_id) with the version before.
    """
    rows = chosen.join(lineage.select("state_id", F.lit(True).alias("later")).distinct(), "state_id", "left")
    return rows.select("query_id", "state_id", F.when(F.col("value_hits") > 0, "direct").when(F.col("later"), "bridge").otherwise("support").alias("role"))


def chain_edges(chosen: DataFrame, links: DataFrame, lineage: DataFrame) -> DataFrame:
    """(query_id, from_id, to_id, type) between the chosen states of a question: versions, shared evidence, and from the root to each
    state that has neither. The root is the first chosen state with a word of the question, else the first. Both sides of
    every join are a question's chosen states, of which GATE_LIMITS allow few."""
    mine = chosen.select("query_id", "state_id")
    to = lineage.join(mine, "state_id").join(mine.select("query_id", F.col("state_id").alias("other_id")), ["query_id", "other_id"])
    versions = to.select("query_id", F.col("other_id").alias("from_id"), F.col("state_id").alias("to_id"), F.lit("state_transition").alias("type"))
    held = materialize(mine.join(links.select("state_id", "evidence_id"), "state_id"), "held")
    shared = held.join(held.select("query_id", "evidence_id", F.col("state_id").alias("to_id")), ["query_id", "evidence_id"]).filter("state_id <> to_id")
    edges = materialize(versions.union(shared.select("query_id", F.col("state_id").alias("from_id"), "to_id", F.lit("same_evidence"))).distinct(), "edges")
    root = chosen.groupBy("query_id").agg(F.coalesce(F.min_by(F.when(F.col("lexical_hits") > 0, F.col("state_id")), F.when(F.col("lexical_hits") > 0, F.col("pick"))), F.min_by("state_id", "pick")).alias("from_id"))
    ends = edges.select("query_id", F.col("from_id").alias("state_id")).union(edges.select("query_id", "to_id"))
    alone = chosen.join(ends, ["query_id", "state_id"], "left_anti").join(root, "query_id").filter("state_id <> from_id")
    kind = F.when(F.col("task").isin(*fx.COMPLEX_TASKS), "supports_decision").otherwise("supports_answer")
    return edges.union(alone.select("query_id", "from_id", F.col("state_id").alias("to_id"), kind))


# ---- retrieval -----------------------------------------------------------------------------------------------------


def united(scored: DataFrame, gated: DataFrame) -> DataFrame:
    """States that their own reasons or the gate let through; those of the gate stay whatever their score (fail-open)."""
    rows = scored.join(gated.select("query_id", "state_id", F.lit(True).alias("gated")), ["query_id", "state_id"], "left").filter(F.col("gated") | (F.size("reasons") > 0))
    return rows.withColumn("reasons", F.when(F.col("gated"), F.concat("reasons", F.array(F.lit("evidence_index_gate")))).otherwise(F.col("reasons"))).drop("gated")


def with_versions(qualified: DataFrame, scored: DataFrame, lineage: DataFrame) -> DataFrame:
    """For questions of an update also the versions next to a qualified one (``lineage``: state_id, other_id), at a lower score; of several the earliest state counts."""
    ways = lineage.select("state_id", "other_id").union(lineage.select("other_id", "state_id"))
    near = qualified.filter("task = 'state_update'").select("query_id", "state_id", "score").join(ways, "state_id").groupBy("query_id", F.col("other_id")).agg(F.min_by("score", "state_id").alias("near"))
    rows = scored.join(qualified.select("query_id", "state_id"), ["query_id", "state_id"], "left_anti").join(near.withColumnRenamed("other_id", "state_id"), ["query_id", "state_id"])
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"score": F.round(F.greatest(F.lit(0.7), F.col("near") - 1.25), 4), "reasons": F.array(F.lit("version_chain_context")), "matched_facets": none, "option_ids": none}).drop("near")
    return qualified.unionByName(rows)


def retrieve(questions: DataFrame, related: DataFrame, lineage: DataFrame, links: DataFrame, index: Index) -> DataFrame:
    """(query_id, rank, state_id, score, reasons, members, evidence_ids): the states that answer each question.

    Gate and scored states united, versions beside them, in the question's order with shared provenance spread out, states of
    equal content as one, and then the choice of the question's task: options by quota, complex questions by diversity, others
    from the front. ``evidence_ids``: of all members, in order.
    """
    pairs = index.states.join(by_key(ranking.with_parts(questions)), "subject_id")
    scored = materialize(ranking.score(pairs), "scored")
    qualified = materialize(united(scored, materialize(gate(questions, related, index), "gate")), "qualified")
    qualified = with_versions(qualified, scored, lineage)
    scheduled = materialize(ranking.provenance_schedule(ranking.ordered(qualified), links), "schedule")
    merged = ranking.coalesced(scheduled, links, extra=("option_ids", "matched_facets"))
    first = scheduled.select("query_id", "state_id", "family", "task", "facets", "scopes", F.size("options").alias("n_options"))
    rows = merged.join(by_key(first), ["query_id", "state_id"]).withColumn("limit", rules.candidate_limit(F.col("task"), F.col("n_options")))
    rows = materialize(rows.withColumn("n_groups", F.count("*").over(W.partitionBy("query_id"))), "groups")
    options = (F.col("task") == "multiple_choice") & (F.col("n_options") > 0)
    complex_task = F.col("task").isin(*fx.COMPLEX_TASKS)
    small = F.col("n_groups") <= F.col("limit")
    chosen = rows.filter(small | ~options & ~complex_task).withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("schedule"))).filter("nth <= limit").select("query_id", "state_id", F.col("schedule").alias("at"))
    by_option = ranking.quota_selection(rows.filter(~small & options), F.col("limit"), "schedule").select("query_id", "state_id", F.col("schedule").alias("at"))
    split = rows.filter(~small & complex_task).withColumn("reasons", F.split("reasons", ","))
    diverse = selection.diversified(split, max(v for k, v in fx.CANDIDATE_LIMITS.items() if k in fx.COMPLEX_TASKS), "schedule")
    diverse = diverse.join(rows.select("query_id", "state_id", "limit"), ["query_id", "state_id"]).filter("pick <= limit").select("query_id", "state_id", F.col("pick").alias("at"))
    picked = materialize(chosen.union(by_option).union(diverse), "picked").join(by_key(rows.select("query_id", "state_id", "score", "reasons", "members")), ["query_id", "state_id"])
    found = picked.select("query_id", F.col("state_id").alias("first"), F.explode(F.split("members", ",").cast("array<long>")).alias("state_id")).join(links, "state_id").groupBy("query_id", F.col("first").alias("state_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("evidence_id")), lambda x: x.cast("string")), ",").alias("evidence_ids"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("at")).cast("long")
    return picked.withColumn("rank", rank).join(found, ["query_id", "state_id"], "left").select("query_id", "rank", "state_id", "score", "reasons", "members", "evidence_ids")

