"""DuckDB expressions of the scalar library, for the oracles."""

from __future__ import annotations

from klarspan.functions import scoring, semantics as s


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def ends_any(x: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '.{w}')" for w in suffixes) + ")"


def norm(x: str) -> str:
    return rf"regexp_replace(translate(lower(trim(coalesce({x}, ''))), '_-', '  '), '\s+', ' ', 'g')"


def scope(x: str) -> str:
    facets = ", ".join(map(quoted, s.FACETS))
    return f"""CASE WHEN trim({x}) = '' THEN 'General' WHEN starts_with({x}, 'EvidenceChain.') THEN 'EvidenceChain' WHEN starts_with({x}, 'TemporalConsistency.') THEN 'TemporalConsistency'
  WHEN starts_with({x}, 'BSM.phase.') THEN array_to_string(string_split({x}, '.')[1:3], '.') WHEN starts_with({x}, 'BSM.process') THEN 'BSM.process'
  WHEN split_part({x}, '.', 2) IN ({facets}) THEN split_part({x}, '.', 1) ELSE {x} END"""


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _cut(x: str, marks) -> str:
    found = f"list_filter([{', '.join(map(quoted, marks))}], lambda m: instr({x}, m) > 1)"
    return f"CASE WHEN len({found}) > 0 THEN split_part({x}, {found}[1], 1) ELSE {x} END"


def _reference(x: str) -> str:
    return f"nullif({slug(_cut('(' + _cut(x, s.STOP_CHARS) + ')', s.STOP_MARKERS))}, '')"


def _reference_tag(prefix: str, own: str, n: str, pattern: str, p: str) -> str:
    found = f"regexp_extract({n}, {quoted(pattern)}, 1)"
    return f"'{prefix}:' || coalesce({own}, CASE WHEN {found} <> '' THEN {_reference(found)} WHEN contains({p}, '{prefix}') THEN {_reference(n)} END)"


def _number_tag(prefix: str, n: str, patterns, p: str) -> str:
    parts = [rf"CASE WHEN contains({p}, '{prefix}') THEN nullif(regexp_extract({n}, '\d{{1,3}}'), '') END"]
    parts += [f"nullif(regexp_extract({n}, {quoted(x)}, 1), '')" for x in patterns]
    return f"'{prefix}:' || CAST(CAST(coalesce({', '.join(parts)}) AS INT) AS VARCHAR)"


def signature(k: str, p: str, n: str) -> str:
    """Tags of a value whose normal form is the column n."""
    writes = f"({ends_any(k, ('write_path', 'policy', 'approval_policy', 'scope_policy'))} OR contains({p}, 'write') OR contains({p}, 'policy'))"
    reads = f"(ends_with({k}, '.read_path') OR contains({p}, 'read'))"
    cycles = f"({ends_any(k, ('lifecycle', 'review_status'))} OR contains({p}, 'lifecycle') OR contains({p}, 'review_status'))"
    process = f"({k} = 'BSM.process' OR starts_with({k}, 'BSM.process.') OR starts_with({k}, 'BSM.phase.'))"
    bypass = contains_any(n, s.APPROVAL_BYPASS)
    forbidden = f"({bypass} AND {contains_any(n, s.NEGATIONS)})"
    own_phase = f"CASE WHEN starts_with({k}, 'BSM.phase.') THEN split_part({k}, '.', 3) END"
    own_question = f"CASE WHEN contains({k}, '.question.') THEN string_split({k}, '.question.')[-1] END"
    phase, question = _reference_tag("phase_reference", own_phase, n, s.PHASE, p), _reference_tag("question_reference", own_question, n, s.QUESTION, p)
    tag = lambda name, c: f"CASE WHEN {c} THEN '{name}' END"
    tags = [
        tag("approval_required", f"{writes} AND ({contains_any(n, s.APPROVAL_REQUIRED)} OR {forbidden})"), tag("approval_bypass", f"{writes} AND {bypass} AND NOT {forbidden}"),
        tag("read_only", f"({writes} OR {reads}) AND {contains_any(n, s.READ_ONLY)}"), tag("write_enabled", f"{writes} AND {contains_any(n, s.WRITE_ENABLED)}"), tag("read_operation", f"{reads} AND {contains_any(n, s.READ_OPERATION)}"),
        *(tag(name, f"{cycles} AND {contains_any(n, w)}") for name, w in s.LIFECYCLE.items()), *(tag(name, contains_any(n, w)) for name, w in s.SCOPES.items()),
        tag("process_reference", process), f"CASE WHEN {process} THEN {phase} END", tag("phase_reference", f"{process} AND ({phase}) IS NOT NULL"), f"CASE WHEN {process} THEN {question} END", tag("question_reference", f"{process} AND ({question}) IS NOT NULL"),
        f"CASE WHEN {process} THEN {_number_tag('phase_order', n, (s.PHASE_ORDER,), p)} END", f"CASE WHEN {process} THEN {_number_tag('phase_count', n, s.PHASE_COUNT, p)} END", f"CASE WHEN {process} THEN {_number_tag('question_count', n, s.QUESTION_COUNT, p)} END",
        *(tag(name, contains_any(n, w)) for name, w in s.REFERENCES.items()),
    ]
    return f"list_sort(list_filter([{', '.join(tags)}], lambda x: x IS NOT NULL))"


def meaningful(tags: str) -> str:
    dynamic = " OR ".join(f"starts_with(x, '{p}')" for p in s.DYNAMIC)
    return f"list_filter({tags}, lambda x: x IN ({', '.join(map(quoted, s.MEANINGFUL))}) OR {dynamic})"


def bucket(tags: str, n: str) -> str:
    m = meaningful(tags)
    return f"CASE WHEN len({m}) > 0 THEN 'semantic:' || array_to_string({m}, '|') ELSE 'text:' || {n} END"


def _has(t: str, *names: str) -> str:
    return "(" + " AND ".join(f"list_contains({t}, '{x}')" for x in names) + ")"


def direct(a: str, b: str) -> str:
    both = lambda x, y: f"(({_has(a, x)} AND {_has(b, y)}) OR ({_has(a, y)} AND {_has(b, x)}))"
    gated = f"({_has(a, 'write_enabled', 'approval_required')} OR {_has(b, 'write_enabled', 'approval_required')})"

    def apart(test: str) -> str:
        l, r = (f"list_filter({t}, lambda x: {test})" for t in (a, b))
        return f"(len({l}) > 0 AND len({r}) > 0 AND NOT list_has_any({l}, {r}))"

    cycles = "x IN (" + ", ".join(map(quoted, s.LIFECYCLE)) + ")"
    starts = [apart(f"starts_with(x, '{p}')") for p in s.DYNAMIC]
    return f"({both('approval_required', 'approval_bypass')} OR ({both('read_only', 'write_enabled')} AND NOT {gated}) OR {apart(cycles)} OR {both('tenant_scoped', 'global_scoped')} OR {' OR '.join(starts)})"


def overlap(a: str, b: str) -> str:
    gated = lambda t: _has(t, "approval_required", "write_enabled")
    return f"(list_has_any({meaningful(a)}, {meaningful(b)}) OR ({_has(a, 'read_only')} AND {gated(b)}) OR ({_has(b, 'read_only')} AND {gated(a)}))"


def lookup(x: str, table: dict, otherwise) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def weight(descriptor: str) -> str:
    text = f"lower({descriptor})"
    steps = " + ".join(f"CASE WHEN {contains_any(text, w)} THEN {v} ELSE 0 END" for w, v in scoring.DESCRIPTOR_WEIGHT)
    weak = ", ".join(map(quoted, scoring.WEAK_STATUS))
    return f"""greatest(20, {lookup('source_type', scoring.SOURCE_WEIGHT, scoring.OTHER_SOURCE)} + {steps} - CASE WHEN {contains_any(text, scoring.GENERATED)} AND source_type <> 'metamodel' THEN 10 ELSE 0 END
  - CASE WHEN source_type = 'github_file' AND {contains_any(text, scoring.TEST_PATHS)} THEN 25 ELSE 0 END + {lookup('source_authority', scoring.AUTHORITY_WEIGHT, 0)} - CASE WHEN assertion_status IN ({weak}) THEN 25 ELSE 0 END)"""


PRIMARY = "(assertion_status NOT IN ('deprecated', 'secondary_only', 'not_ssot') AND source_authority <> 'historical' AND temporal NOT IN ('historic', 'historical') AND governance NOT IN ('historic', 'historical'))"
DESCRIPTOR = "source_type || ' ' || title || ' ' || path_hint || ' ' || governance || ' ' || temporal"


def ancestors(x: str) -> str:
    return f"[array_to_string(string_split({x}, '.')[1:i], '.') FOR i IN range(1, len(string_split({x}, '.')) + 1)]"


EXPLICIT = "truth_status = 'active' AND source_kind IN ('user_specification', 'user_acceptance')"
