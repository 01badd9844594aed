"""Value semantics of claims: normal forms, scope keys, tag signatures, and whether values agree or conflict.

All functions build Columns; nothing here runs Python on executors.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the claim model.
APPROVAL_REQUIRED = ("approval", "approve", "freigabe", "review", "gated", "guarded", "allowlist")
APPROVAL_BYPASS = ("without approval", "without review", "ohne freigabe", "ohne review", "ungated", "direct write", "direct persist", "auto persist")
NEGATIONS = ("kein ", "keine ", "keinen ", "ohne ", "no ", "not ", "nicht ")
READ_ONLY = ("read only", "readonly", "nur lesend")
WRITE_ENABLED = ("write", "persist", "save", "create", "update", "patch", "delete")
READ_OPERATION = ("read", "query", "fetch", "load")
LIFECYCLE = {
    "review_status": ("review", "in review", "review status"),
    "approved_status": ("approved", "freigegeben", "released"),
    "draft_status": ("draft", "entwurf"),
    "archived_status": ("archived", "archive", "historisiert", "historic"),
}
SCOPES = {"tenant_scoped": ("tenant", "project scoped", "project specific", "projekt"), "global_scoped": ("global", "global read", "globaler read")}
REFERENCES = {"metamodel_reference": ("metamodel", "metamodell"), "documentation_reference": ("confluence", "wiki", "doku"), "implementation_reference": ("code", "service", "router")}
FACETS = ("read_path", "write_path", "lifecycle", "policy", "review_status", "approval_policy", "scope_policy")
DYNAMIC = ("phase_reference:", "question_reference:", "phase_order:", "phase_count:", "question_count:")
MEANINGFUL = ("approval_required", "approval_bypass", "read_only", "write_enabled", "read_operation", "review_status", "approved_status", "draft_status", "archived_status", "tenant_scoped", "global_scoped", "process_reference", "phase_reference", "question_reference")
STOP_MARKERS = (" is ", " sind ", " must ", " soll ", " should ", " with ", " mit ", " has ", " hat ", " contains ", " enthaelt ", " which ", " wobei ")
STOP_CHARS = (".", ";", ",", "(", ")", "[", "]")
PHASE = r"\b(?:phase|prozessphase|bsm phase)\s*[:#-]?\s*([a-z0-9][a-z0-9 _/-]{1,40})"
QUESTION = r"\b(?:question|frage)\s*[:#-]?\s*([a-z0-9][a-z0-9 _/-]{1,40})"
PHASE_ORDER = r"\b(?:phase order|order|reihenfolge)\s*[:=]?\s*(\d{1,3})\b"
PHASE_COUNT = (r"\b(\d{1,3})\s*(?:phases|phase|phasen)\b", r"\b(?:phase count|phasenzahl)\s*[:=]?\s*(\d{1,3})\b")
QUESTION_COUNT = (r"\b(\d{1,3})\s*(?:questions|fragen)\b", r"\b(?:question count|fragenzahl)\s*[:=]?\s*(\d{1,3})\b")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(value: Column, words) -> Column:
    return value.rlike("|".join(map(re.escape, words)))


def ends_with_any(value: Column, suffixes) -> Column:
    return value.rlike(rf"\.(?:{'|'.join(map(re.escape, suffixes))})\z")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def normalize_value(value: Column) -> Column:
    """Trimmed, lower-case, `_` and `-` as spaces, runs of white space as one."""
    return F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "_-", "  "), r"\s+", " ")


def scope_key(subject: Column) -> Column:
    """The package scope that a subject belongs to."""
    key = F.trim(F.coalesce(subject, F.lit("")))
    second = F.try_element_at(F.split(key, r"\."), F.lit(2))
    return (
        F.when(key == "", "General")
        .when(F.startswith(key, F.lit("EvidenceChain.")), "EvidenceChain")
        .when(F.startswith(key, F.lit("TemporalConsistency.")), "TemporalConsistency")
        .when(F.startswith(key, F.lit("BSM.phase.")), F.substring_index(key, ".", 3))
        .when(F.startswith(key, F.lit("BSM.process")), "BSM.process")
        .when(second.isin(*FACETS), F.substring_index(key, ".", 1))
        .otherwise(key)
    )


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _cut(text: Column, marks) -> Column:
    """The text before the first of the marks, in their order, that stands in it but not at its start."""
    mark = F.get(F.filter(F.array(*map(F.lit, marks)), lambda m: F.instr(text, m) > 1), 0)
    return F.when(mark.isNotNull(), F.call_function("substring_index", text, mark, F.lit(1))).otherwise(text)


def _reference(candidate: Column) -> Column:
    """A reference's name: what stands before a stop character or marker, as a slug; null if nothing is left."""
    name = let(candidate, lambda c: let(_cut(c, STOP_CHARS), lambda d: slug(_cut(d, STOP_MARKERS))))
    return F.nullif(name, F.lit(""))


def _reference_tag(prefix: str, own: Column, normalized: Column, pattern: str, predicate: Column) -> Column:
    found = F.nullif(F.regexp_extract(normalized, pattern, 1), F.lit(""))
    name = F.coalesce(own, _reference(F.coalesce(found, F.when(F.contains(predicate, F.lit(prefix)), normalized))))
    return F.concat(F.lit(f"{prefix}:"), name)


def _number_tag(prefix: str, normalized: Column, patterns, predicate: Column) -> Column:
    first = F.regexp_extract(normalized, r"\d{1,3}", 0)
    direct = F.when(F.contains(predicate, F.lit(prefix)) & (first != ""), first)
    groups = [F.regexp_extract(normalized, p, 1) for p in patterns]
    number = F.coalesce(direct, *(F.when(g != "", g) for g in groups))
    return F.concat(F.lit(f"{prefix}:"), number.cast("int").cast("string"))


def signature(subject: Column, predicate: Column, value: Column) -> Column:
    """Sorted tags of a claim's value, seen from its subject and predicate."""
    return let(normalize_value(value), lambda n: _signature(subject, predicate, n))


def _signature(subject: Column, predicate: Column, n: Column) -> Column:
    tag = lambda name, condition: F.when(condition, F.lit(name))
    writes = ends_with_any(subject, ("write_path", "policy", "approval_policy", "scope_policy")) | F.contains(predicate, F.lit("write")) | F.contains(predicate, F.lit("policy"))
    reads = F.endswith(subject, F.lit(".read_path")) | F.contains(predicate, F.lit("read"))
    cycles = ends_with_any(subject, ("lifecycle", "review_status")) | F.contains(predicate, F.lit("lifecycle")) | F.contains(predicate, F.lit("review_status"))
    process = (subject == "BSM.process") | F.startswith(subject, F.lit("BSM.process.")) | F.startswith(subject, F.lit("BSM.phase."))
    bypass = contains_any(n, APPROVAL_BYPASS)
    forbidden = bypass & contains_any(n, NEGATIONS)
    own_phase = F.when(F.startswith(subject, F.lit("BSM.phase.")), F.get(F.split(subject, r"\."), 2))
    own_question = F.when(F.contains(subject, F.lit(".question.")), F.substring_index(subject, ".question.", -1))
    phase = _reference_tag("phase_reference", own_phase, n, PHASE, predicate)
    question = _reference_tag("question_reference", own_question, n, QUESTION, predicate)
    tags = [
        tag("approval_required", writes & (contains_any(n, APPROVAL_REQUIRED) | forbidden)),
        tag("approval_bypass", writes & bypass & ~forbidden),
        tag("read_only", (writes | reads) & contains_any(n, READ_ONLY)),
        tag("write_enabled", writes & contains_any(n, WRITE_ENABLED)),
        tag("read_operation", reads & contains_any(n, READ_OPERATION)),
        *(tag(name, cycles & contains_any(n, words)) for name, words in LIFECYCLE.items()),
        *(tag(name, contains_any(n, words)) for name, words in SCOPES.items()),
        tag("process_reference", process),
        F.when(process, phase),
        tag("phase_reference", process & phase.isNotNull()),
        F.when(process, question),
        tag("question_reference", process & question.isNotNull()),
        F.when(process, _number_tag("phase_order", n, (PHASE_ORDER,), predicate)),
        F.when(process, _number_tag("phase_count", n, PHASE_COUNT, predicate)),
        F.when(process, _number_tag("question_count", n, QUESTION_COUNT, predicate)),
        *(tag(name, contains_any(n, words)) for name, words in REFERENCES.items()),
    ]
    return F.array_sort(F.array_compact(F.array(*tags)))


def meaningful(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.isin(*MEANINGFUL) | t.rlike("^(?:" + "|".join(DYNAMIC) + ")"))


def consensus_bucket(subject: Column, predicate: Column, value: Column) -> Column:
    return bucket_of(signature(subject, predicate, value), value)


def bucket_of(tags: Column, value: Column) -> Column:
    kept = F.array_join(meaningful(tags), "|")
    return F.when(kept != "", F.concat(F.lit("semantic:"), kept)).otherwise(F.concat(F.lit("text:"), normalize_value(value)))


def _direct(left: Column, right: Column) -> Column:
    """Whether two signatures contradict each other outright."""
    has = lambda tags, *names: reduce(lambda a, b: a & b, (F.array_contains(tags, n) for n in names))
    both_ways = lambda a, b: (has(left, a) & has(right, b)) | (has(left, b) & has(right, a))
    gated = has(left, "write_enabled", "approval_required") | has(right, "write_enabled", "approval_required")

    def apart(kind) -> Column:
        a, b = F.filter(left, kind), F.filter(right, kind)
        return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)

    starting = lambda p: lambda t: F.startswith(t, F.lit(p))
    return (
        both_ways("approval_required", "approval_bypass")
        | (both_ways("read_only", "write_enabled") & ~gated)
        | apart(lambda t: t.isin(*LIFECYCLE))
        | both_ways("tenant_scoped", "global_scoped")
        | any_of(apart(starting(p)) for p in DYNAMIC)
    )


def _overlap(left: Column, right: Column) -> Column:
    has = lambda tags, n: F.array_contains(tags, n)
    gated = lambda tags: has(tags, "approval_required") & has(tags, "write_enabled")
    return F.arrays_overlap(meaningful(left), meaningful(right)) | (has(left, "read_only") & gated(right)) | (has(right, "read_only") & gated(left))


def signatures_conflict(left: Column, right: Column, left_values: Column, right_values: Column) -> Column:
    """Whether two sets of values conflict, given their signatures (arrays of arrays of tags)."""
    pair = lambda test: F.exists(left, lambda a: F.exists(right, lambda b: test(a, b)))
    context = F.exists(left, lambda t: F.size(meaningful(t)) > 0) & F.exists(right, lambda t: F.size(meaningful(t)) > 0)
    return pair(_direct) | (~pair(_overlap) & (context | ~F.arrays_overlap(left_values, right_values)))


def values_aligned(left_tags: Column, right_tags: Column, left: Column, right: Column) -> Column:
    return ~_direct(left_tags, right_tags) & (_overlap(left_tags, right_tags) | (normalize_value(left) == normalize_value(right)))
