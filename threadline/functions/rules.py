"""Column functions over the fixed rules: topics, statuses, domains, cues, claims, answers, questions.

Each is a composition of built-in functions, so it runs inside generated code and needs no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions.text import compact, nfkc_lower

#: A border of ASCII words on either side; the engine's own takes other letters in.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A pattern of the fixed values as the engine here reads it: ASCII word borders and digits."""
    return pattern.replace(r"\b", BORDER)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def removed(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, java(pattern), by)


def which(text: Column, rules: Mapping[str, str] | Iterable[tuple[str, str]]) -> Column:
    """Names of the rules whose pattern the text has, in their order."""
    pairs = rules.items() if isinstance(rules, Mapping) else rules
    return F.filter(F.array(*[F.when(has(text, p), F.lit(n)) for n, p in pairs]), lambda x: x.isNotNull())


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often ``of`` reads it."""
    return F.transform(F.array(value), of)[0]


def medications(text: Column) -> Column:
    return F.transform(which(text, fx.MEDICATIONS), lambda n: F.concat(F.lit("medication:"), n))


def topics(text: Column) -> Column:
    """Drugs, then general topics; the topic of drugs in general only where none is named."""
    drugs = medications(text)
    return F.concat(drugs, F.filter(which(text, fx.TOPICS), lambda t: (t != "medication") | (F.size(drugs) == 0)))


def normal_topic(text: Column) -> Column:
    return removed(F.lower(text), fx.TOPIC_NOISE)


def topic_key(text: Column) -> Column:
    """The factor a fact is about: its drugs, else its topics, else what is left of the text."""
    drugs = medications(text)
    kind = F.lit("general")
    for name, pattern in reversed(list(fx.GLUCOSE_KINDS.items())):
        kind = F.when(has(text, pattern), name).otherwise(kind)
    general = F.array_join(F.transform(topics(text), lambda t: F.when(t == "glucose", F.concat(F.lit("glucose:"), kind)).otherwise(t)), ",")
    return F.when(F.size(drugs) > 0, F.array_join(drugs, ",")).when(general != "", general).otherwise(normal_topic(text))


def assertion(text: Column) -> Column:
    return compact(removed(removed(F.lower(text), fx.ASSERTION_WORDS), fx.ASSERTION_ENGLISH))


def quantity_signature(text: Column) -> Column:
    return F.array_join(F.transform(found(F.lower(text), fx.QUANTITY), lambda q: F.regexp_replace(q, r"\s+", "")), "|")


def status_signature(text: Column) -> Column:
    return F.array_join(which(F.lower(text), fx.STATUSES), "|")


def is_correction(text: Column) -> Column:
    return has(text, fx.CORRECTION)


def is_reconciliation(text: Column) -> Column:
    return has(text, fx.RECONCILIATION)


def are_opposite(a: Column, b: Column) -> Column:
    return has(a, fx.OPPOSITE) != has(b, fx.OPPOSITE)


def resolves(prior_polarity: Column, polarity: Column, text: Column) -> Column:
    return (F.coalesce(prior_polarity, F.lit("")) != "negated") & ((F.coalesce(polarity, F.lit("")) == "negated") | has(text, fx.RESOLVED))


def same_fact(text: Column, polarity: Column, prior: Column, prior_polarity: Column) -> Column:
    same = F.coalesce(polarity, F.lit("affirmed")) == F.coalesce(prior_polarity, F.lit("affirmed"))
    return same & (assertion(text) == assertion(prior)) & (quantity_signature(text) == quantity_signature(prior)) & (status_signature(text) == status_signature(prior))


def domains(family: Column, text: Column) -> Column:
    """Domain labels in their order of test; the family's own where no word tells."""
    hit = {n: has(text, p) for n, p in fx.DOMAINS.items()}
    labels = F.array(
        F.when(family.isin("CS", "LO") | hit["biological"], "biological"), F.when((family == "PA") | hit["psychological"], "psychological"),
        F.when(hit["behavioral"], "behavioral"), F.when(hit["social"], "social"), F.when(family == "CP", "care"),
    )
    kept = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.when(family == "BC", "social").otherwise("biological")))


def asserted(relation: Column, text: Column) -> Column:
    """Confidence of a relation whose cue the text has, else null."""
    out = F.lit(None).cast("double")
    for name, (pattern, confidence) in fx.ASSERTED.items():
        out = F.when((relation == name) & has(text, pattern), confidence).otherwise(out)
    return out


def cues(quote: Column) -> Column:
    return which(F.lower(quote), fx.CUES)


def protected_signature(text: Column) -> Column:
    low = nfkc_lower(text)
    drugs = F.array_sort(which(low, dict(list(fx.MEDICATIONS.items())[:5])))
    return F.concat_ws("#", *[F.array_join(found(low, p), ",") for p in fx.PROTECTED.values()], F.array_join(drugs, ","))


def aliases(text: Column) -> Column:
    """All words of every group of which the text holds one."""
    contains = lambda low, g: F.greatest(*[F.contains(low, F.lit(t.lower())) for t in g])
    groups = lambda low: F.concat(*[F.when(contains(low, g), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in fx.ALIASES])
    return F.array_distinct(once(F.lower(text), groups))


def canonical_drugs(text: Column) -> Column:
    for name, canonical in fx.CANONICAL_DRUGS:
        text = removed(text, rf"(?i)\b{name}\b", canonical)
    return F.trim(text)


def n_han(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{IsHan}"))


def n_latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def language(text: Column) -> Column:
    return F.when(n_han(text) > n_latin(text) * 0.3, "zh").otherwise("en")


def language_mismatch(text: Column, output: Column) -> Column:
    wanted, got = language(text), language(output)
    far = F.when(wanted == "zh", n_latin(output) > 8).otherwise(n_han(output) > 2)
    return (F.trim(output) != "") & (wanted != got) & far


def atomic(text: Column, source_type: Column) -> Column:
    """A statement in the third person, with drugs by their general names."""
    for brand, drug in fx.BRANDS:
        text = F.regexp_replace(text, f"(?i){brand}", drug)
    text = F.trim(text)
    zh = language(text) == "zh"
    subject = F.when(zh, F.when(source_type == "doctor", "医生").otherwise("患者")).otherwise(F.when(source_type == "doctor", "Doctor").otherwise("Patient"))
    headed = has(text, r"(?i)^(患者|医生|记录|Profile|Patient|Doctor)[:：]")
    chinese = F.when(has(text, "^(我|本人)"), F.concat(subject, F.regexp_replace(text, "^(我|本人)", ""))).when(has(text, "^(患者|医生)"), text).otherwise(F.concat(subject, text))
    english = F.when(has(text, r"(?i)^I\b"), F.concat(subject, F.substring(text, F.lit(2), F.length(text)))).when(has(text, r"(?i)^(Patient|Doctor)\b"), text).otherwise(F.concat(subject, F.lit(" "), text))
    return F.when(headed, F.regexp_replace(text, r"(?i)^(Profile|Patient|Doctor)[:：]\s*", "")).when(zh, chinese).otherwise(english)


def is_filler(text: Column, source_type: Column) -> Column:
    value = F.trim(F.regexp_replace(text, "[*_~`>#•·]", ""))
    doctor = (source_type == "doctor") | has(value, "(?i)^(?:医生|Doctor)")
    return has(value, fx.GREETING) | (doctor & has(value, fx.SUPPORTIVE) & ~has(value, fx.DURABLE))


def claim_guards(text: Column) -> Column:
    """Why a statement about a drug confirms nothing; empty if it does."""
    return which(text, fx.UNCONFIRMED)


def claim_kinds(text: Column) -> Column:
    kinds = which(text, fx.CLAIM_KINDS)
    return F.filter(kinds, lambda k: (k != "started") | ~F.array_contains(kinds, "restarted"))


def unsafe_claim(text: Column) -> Column:
    """Not one drug, a correction, or more than one kind of action."""
    return (F.size(medications(text)) != 1) | has(text, fx.CLAIM_CORRECTION) | (F.size(claim_kinds(text)) > 1)


def official_answer(text: Column) -> Column:
    """NFKC, lower case, without marks and white space."""
    marks = "".join("\\" + c if c.isascii() else c for c in dict.fromkeys(fx.OFFICIAL_MARKS))
    return F.regexp_replace(nfkc_lower(F.coalesce(text, F.lit(""))), rf"[{marks}\s]", "")


def plain_answer(text: Column) -> Column:
    """Lower case, ASCII marks and articles to blanks."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(removed(low, fx.ARTICLES, " "), r"\s+", " "))


def claim(text: Column) -> Column:
    return F.regexp_replace(nfkc_lower(F.coalesce(text, F.lit(""))), fx.CLAIM_MARKS, "")


def abstains(text: Column) -> Column:
    return plain_answer(text).isin(*fx.ABSTENTIONS)


def option_letters(text: Column) -> Column:
    upper = F.upper(text)
    return F.array_sort(F.array_distinct(F.concat(*[found(upper, p, 1) for p in fx.OPTION_PATTERNS])))


def parsed_options(question: Column) -> Column:
    """Lines such as ``A. text`` as structs of id and text."""
    pattern = r"(?:^|\n)\s*([A-Z])[.、)]\s*([^\n]+)"
    return F.zip_with(found(question, pattern, 1), found(question, pattern, 2), lambda i, t: F.struct(i.alias("id"), F.trim(t).alias("text")))


def diagnostic_tokens(text: Column) -> Column:
    """Distinct English words and pairs of Han characters."""
    low = nfkc_lower(text)
    return F.array_distinct(F.concat(found(low, r"[a-z][a-z0-9.+-]{1,}"), found(low, r"(?=(\p{IsHan}{2}))", 1)))


def strongest_scopes(scopes: Column) -> Column:
    """Of scopes as ``family=weight`` the strongest of each family, in the order of families; others go."""

    def best(held: Column, family: str) -> Column:
        out = F.lit(None).cast("string")
        for weight in sorted(fx.PRIORITY_WEIGHT.values()):
            out = F.when(F.array_contains(held, f"{family}={weight}"), f"{family}={weight}").otherwise(out)
        return out

    return once(scopes, lambda held: F.filter(F.array(*[best(held, f) for f in fx.FAMILIES]), lambda x: x.isNotNull()))


def _texts(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def question_scopes(question: Column, task: Column) -> Column:
    """family=weight of each family the question asks about, the strongest of its priorities, in the order of families."""
    named = [(p, [f"{family}={fx.PRIORITY_WEIGHT[priority]}" for family, priority in scopes]) for p, scopes, _ in fx.QUESTION_RULES]
    own = F.when(task == "state_update", _texts(["LO=3"])).otherwise(_texts([]))
    asked = lambda low: F.concat(*[F.when(has(low, p), _texts(scopes)).otherwise(_texts([])) for p, scopes in named], own)
    return strongest_scopes(once(nfkc_lower(question), asked))


def question_facets(question: Column, task: Column) -> Column:
    own = F.when(task == "state_update", _texts(["current_status", "longitudinal_change"])).when(task.isin(*fx.COMPLEX_TASKS), _texts(["direct_facts", "clinical_context", "longitudinal_change"])).otherwise(_texts([]))
    asked = lambda low: F.concat(*[F.when(has(low, p), _texts(facets)).otherwise(_texts([])) for p, _, facets in fx.QUESTION_RULES], own)
    return F.slice(F.array_distinct(once(nfkc_lower(question), asked)), 1, 24)


def temporal_operator(question: Column, task: Column) -> Column:
    def asked(low: Column) -> Column:
        out = F.lit("none")
        for name, pattern in reversed(fx.TEMPORAL_RULES):
            own = {"current": "state_update", "event_time": "temporal_localization"}.get(name)
            out = F.when(has(low, pattern) | (task == own if own else F.lit(False)), name).otherwise(out)
        return out

    return once(nfkc_lower(question), asked)


def answer_slot(question: Column, task: Column) -> Column:
    def asked(low: Column) -> Column:
        out = F.when(task == "entity_exact_match", "entity").otherwise("fact")
        for name, pattern in reversed(fx.SLOT_RULES):
            out = F.when(has(low, pattern), name).otherwise(out)
        for name, slot in fx.SLOT_OF_TASK.items():
            out = F.when(task == name, slot).otherwise(out)
        return out

    return once(nfkc_lower(question), asked)


def candidate_limit(task: Column, n_options: Column) -> Column:
    out = F.when(task == "multiple_choice", F.least(F.lit(24), F.greatest(F.lit(12), n_options * 4))).otherwise(12)
    for name, limit in fx.CANDIDATE_LIMITS.items():
        out = F.when(task == name, limit).otherwise(out)
    return out


def covers_facet(facet: str, family: Column, text: Column) -> Column:
    """Whether a record of a family can cover a facet: the family fits and the words are there."""
    return family.isin(*fx.FACET_FAMILIES[facet]) & has(text, fx.FACET_PATTERNS[facet]) if facet in fx.FACET_PATTERNS else family.isin(*fx.FACET_FAMILIES[facet])


def facets_of(family: Column, text: Column) -> Column:
    return F.filter(F.array(*[F.when(covers_facet(f, family, text), F.lit(f)) for f in fx.FACET_FAMILIES]), lambda x: x.isNotNull())


def required_facets(task: Column) -> Column:
    """By the task's name, whatever its case."""
    out = F.array(F.lit("direct_facts"))
    for name, facets in fx.REQUIRED_FACETS.items():
        out = F.when(F.lower(task) == name, F.array(*map(F.lit, facets))).otherwise(out)
    return out


def coverage_facets(facets: Column, task: Column, question: Column) -> Column:
    """What the statements for a question have to cover: its own facets, its task's, and those of a reason or a change; MOST_FACETS at most."""
    reasons = F.when(F.coalesce(question, F.lit("")).rlike(fx.REASON_QUESTION), F.array(*map(F.lit, fx.REASON_FACETS))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(facets, required_facets(task), reasons)), 1, fx.MOST_FACETS)


def desired_actions(task: Column, operator: Column, budget: int = 6) -> Column:
    """The route of a task class; beyond the budget the optional steps go first."""
    if budget < 3:
        raise ValueError("a route needs three steps: focus, verify, answer")
    trimmed = lambda *steps: F.array(*map(F.lit, steps if len(steps) <= budget else ("focus", *[s for s in steps if s not in ("focus", "verify", "answer")][: budget - 3], "verify", "answer")))
    timed = task.isin(*fx.TEMPORAL_TASKS) | (operator != "none")
    return F.when(task.isin(*fx.COMPLEX_TASKS), trimmed("focus", "trace", "connect", "evaluate", "verify", "answer")).when(timed, trimmed("focus", "trace", "verify", "answer")).otherwise(trimmed("focus", "verify", "answer"))


def routed_families(text: Column, source_type: Column) -> Column:
    """The families that a statement belongs to, by its words and who says it; a question states nothing, but for one that
    asks for confirmation."""
    is_ = {n: has(text, p) for n, p in fx.ROUTES.items()}
    patient = (source_type == "patient") | is_["subject"]
    agrees = patient & is_["agreement"]
    lives = (patient | is_["observed"] | is_["reported"]) & is_["experience"] & ~(is_["intent"] & ~agrees)
    status = is_["taking"] | (~is_["directive"] & is_["stopped"])
    found = F.filter(F.array(
        F.when(is_["background"], "BC"), F.when(lives, "PE"), F.when(patient & is_["appraisal"], "PA"), F.when(is_["judgment"] | status, "CS"), F.when(is_["care"] | agrees, "CP"), F.when(is_["change"], "LO"),
    ), lambda x: x.isNotNull())
    asked = F.when(patient & is_["confirming"], F.array(F.lit("PA"))).otherwise(F.array().cast("array<string>"))
    return F.when(is_["question"], asked).otherwise(found)


def keyword_phrases(question: Column) -> Column:
    """Phrases of one to four words, numbers with units and option texts of a question; runs of Han characters are one word each."""
    asked = F.coalesce(question, F.lit(""))

    def phrases_of(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
        runs = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(words) - i + 1)), lambda n: F.slice(words, i, n))))
        useful = F.filter(runs, lambda r: ~F.arrays_overlap(r, F.array(*map(F.lit, fx.FRAMING))) & ((F.size(r) > 1) | ~F.get(r, F.lit(0)).isin(*fx.STOP_TERMS)))
        return F.filter(F.transform(useful, lambda r: F.array_join(r, "")), lambda p: F.length(p) <= 20)

    def parts(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9-]{2,}|\p{IsHan}+|[0-9]+(?:[-–—~～][0-9]+)?(?:斤|公斤|kg|mg|%|mmol/l)?"), F.lit(0))
        numbers = F.regexp_extract_all(low, F.lit(r"[0-9]+(?:[-–—~～][0-9]+)?(?:斤|公斤|kg|mg|%|mmol/l)?"), F.lit(0))
        return F.concat(numbers, F.transform(parsed_options(asked), lambda o: o["text"]), once(words, phrases_of))

    base = F.lower(F.regexp_replace(asked, r"(?:^|\n)\s*[A-Z][.、)]\s*[^\n]+", " "))
    kept = F.filter(once(base, parts), lambda p: F.length(p).between(2, 40) & ~F.lower(p).isin(*fx.STOP_TERMS))
    return F.slice(F.array_distinct(kept), 1, 48)
