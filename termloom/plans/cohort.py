"""Cohort questions: grammar for English and Spanish, validated plans, and their compilation
to one predicate over nested codings.

A leaf holds if ONE coding of a note has the concept, assertion, subject and status all at
once; `exclude` asks that none has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSERTIONS = ("present", "absent", "suspected", "historical", "planned")
SUBJECTS = ("patient", "family")
SEXES = ("female", "male", "other")
SETTINGS = ("primary-care", "outpatient", "inpatient", "emergency")
MAX_DEPTH, MAX_CHILDREN, MAX_LEAVES, MAX_PHRASE, MAX_IDS = 4, 10, 10, 160, 40


class PlanError(ValueError):
    """A question or plan that can't be accepted."""


@dataclass(frozen=True)
class Leaf:
    phrase: str
    assertion: str = "present"
    subject: str = "patient"
    exclude: bool = False
    name: str = ""


@dataclass(frozen=True)
class Group:
    kind: str  # all or any
    children: tuple
    exclude: bool = False


@dataclass(frozen=True)
class Filters:
    min_age: int | None = None
    max_age: int | None = None
    since_days: int | None = None
    sex: str | None = None
    setting: str | None = None


@dataclass(frozen=True)
class Plan:
    root: object | None
    filters: Filters = field(default_factory=Filters)


# ---- validation


def _whole(value, name: str, low: int, high: int):
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise PlanError(f"{name} must be a whole number from {low} to {high}")
    return value


def _one_of(value, name: str, allowed: tuple[str, ...]):
    if value is not None and (not isinstance(value, str) or value not in allowed):
        raise PlanError(f"{name} must be one of {', '.join(allowed)}")
    return value


def validate_filters(raw: dict) -> Filters:
    known = {"minAge", "maxAge", "sinceDays", "sex", "setting"}
    if not isinstance(raw, dict) or set(raw) - known:
        raise PlanError(f"filters may hold {', '.join(sorted(known))}")
    out = Filters(_whole(raw.get("minAge"), "minAge", 0, 120), _whole(raw.get("maxAge"), "maxAge", 0, 120), _whole(raw.get("sinceDays"), "sinceDays", 1, 3650), _one_of(raw.get("sex"), "sex", SEXES), _one_of(raw.get("setting"), "setting", SETTINGS))
    if out.min_age is not None and out.max_age is not None and out.min_age > out.max_age:
        raise PlanError("minAge is above maxAge")
    return out


def validate_plan(raw: dict) -> Plan:
    """A plan from plain dicts; leaves are named c1, c2, ... in order."""
    count = 0

    def node(x, depth: int):
        nonlocal count
        if not isinstance(x, dict) or depth > MAX_DEPTH:
            raise PlanError("a plan is nested objects, at most four deep")
        groups = [k for k in ("all", "any") if k in x]
        if groups and ("phrase" in x or len(groups) > 1):
            raise PlanError("a node is either one group or a leaf")
        exclude = x.get("exclude", False)
        if not isinstance(exclude, bool):
            raise PlanError("exclude must be true or false")
        if groups:
            children = x[groups[0]]
            if not isinstance(children, list) or not 1 <= len(children) <= MAX_CHILDREN:
                raise PlanError(f"a group has 1 to {MAX_CHILDREN} children")
            return Group(groups[0], tuple(node(c, depth + 1) for c in children), exclude)
        phrase = x.get("phrase")
        if not isinstance(phrase, str) or not phrase.strip() or len(phrase) > MAX_PHRASE:
            raise PlanError(f"a leaf has a phrase of up to {MAX_PHRASE} characters")
        count += 1
        if count > MAX_LEAVES:
            raise PlanError(f"a plan has at most {MAX_LEAVES} leaves")
        return Leaf(phrase.strip(), _one_of(x.get("assertion", "present"), "assertion", ASSERTIONS), _one_of(x.get("subject", "patient"), "subject", SUBJECTS), exclude, f"c{count}")

    root = {k: v for k, v in raw.items() if k != "filters"} if isinstance(raw, dict) else raw
    return Plan(node(root, 1) if root else None, validate_filters(raw.get("filters", {})))


def validate_ids(ids) -> list[str]:
    if not isinstance(ids, list) or not ids or any(not isinstance(x, str) or not re.fullmatch(r"\d{6,18}", x) for x in ids):
        raise PlanError("concept ids are strings of 6 to 18 digits")
    out = list(dict.fromkeys(ids))
    if len(out) > MAX_IDS:
        raise PlanError(f"at most {MAX_IDS} concept ids")
    return out


# ---- grammar

# The words of questions, English and Spanish.
COMMANDS = ("find", "show", "search", "retrieve", "buscar", "busca", "mostrar", "muestra")
NOUNS = ("notes", "records", "observations", "notas", "registros", "observaciones")
OPENERS = ("that mention", "that have", "talking about", "with", "about", "for", "from", "in", "con", "sobre", "de", "para", "en", "patients", "pacientes")
AND_WORDS, OR_WORDS = ("and", "but", "y", "e", "pero"), ("or", "o")
BEGINS_EXCLUSION = ("without", "excluding", "except", "sin", "excepto")
EXCLUDES = ("without", "excluding", "except", "exclude", "not with", "not", "no", "sin", "excepto")
LEADS = [  # what a condition begins with, and what that says; the first that fits
    (("documented absence of", "documented no", "ausencia documentada de"), {"assertion": "absent"}),
    (("suspected", "possible", "sospecha de"), {"assertion": "suspected"}),
    (("family history of", "a family history of", "antecedentes familiares de"), {"subject": "family"}),
    (("history of", "a history of", "past history of", "a past history of", "previous", "a previous", "historical", "antecedentes personales de", "antecedentes de"), {"assertion": "historical"}),
    (("planned", "scheduled", "programada", "planificada"), {"assertion": "planned"}),
]
PLANNED_ENDS = ("programada", "planificada", "prevista")
CONFIRMED, CONFIRMED_ENDS, LINKING = ("confirmed", "active", "current", "confirmada"), ("confirmada",), ("with", "about", "con", "sobre", "both", "ambos")
WOMEN, MEN = ("women", "female patients", "mujeres"), ("men", "male patients", "hombres")
SETTING_BEFORE = {"emergency": "emergency", "inpatient": "inpatient", "outpatient": "outpatient", "primary-care": "primary-care"}
SETTING_AFTER = {"urgencias": "emergency", "hospitalización": "inpatient", "atención primaria": "primary-care"}
# words that tell free prose from a command
PROSE = (
    "who", "that", "have", "has", "had", "having", "taking", "takes", "receiving", "treated", "diagnosed", "presenting", "requiring", "because", "with", "people", "patients",
    "que", "tienen", "tiene", "tomando", "toman", "reciben", "tratados", "diagnosticados", "con",
)


def _one_word_of(words) -> str:
    """Alternation, longer ones first; white space in them may be any."""
    return "|".join(r"\s+".join(map(re.escape, w.split())) for w in sorted(words, key=lambda w: (-len(w), w)))


def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.IGNORECASE)


def _starts(words) -> re.Pattern:
    return _pattern(rf"(?:{_one_word_of(words)})\s+")


_HEAD = rf"(?:{_one_word_of(COMMANDS)})\s+(?:me\s+)?(?:all\s+)?"
_COMMAND = _pattern(rf"{_HEAD}(?:clinical\s+)?(?:{_one_word_of(NOUNS)})\b\s*")
_STRUCTURED = _pattern(rf"{_HEAD}(?:(?:clinical|{_one_word_of(SETTING_BEFORE)})\s+)?(?:{_one_word_of(NOUNS)})\b")
_OPENER = _pattern(rf"(?:{_one_word_of(OPENERS)})\b\s*")
_PROSE = _pattern(rf"\b(?:{_one_word_of(PROSE)})\b")
_YEARS = r"(?:\s+(?:years\s+old|años))?"
#: What a question says beside its conditions: pattern, filters of a match, and what stays of it.
_FILTERS = [
    (_pattern(r"(?:\b(?:from|in|during|within|de|en|durante)\s+)?(?:\b(?:the|los)\s+)?\b(?:last|past|[uú]ltimos)\s+(\d{1,4})\s+(?:days?|d[ií]as?)\b"), lambda m: {"sinceDays": int(m[1])}, ""),
    (_pattern(rf"\b(?:aged|de)\s+(\d{{1,3}})\s+(?:to|a)\s+(\d{{1,3}}){_YEARS}\b"), lambda m: {"minAge": int(m[1]), "maxAge": int(m[2])}, ""),
    (_pattern(rf"\b(?:over|older\s+than|mayores\s+de|m[aá]s\s+de)\s+(\d{{1,3}}){_YEARS}\b"), lambda m: {"minAge": int(m[1]) + 1}, ""),
    (_pattern(rf"\b(?:{_one_word_of(WOMEN)})\b"), lambda m: {"sex": "female"}, ""),
    (_pattern(rf"\b(?:{_one_word_of(MEN)})\b"), lambda m: {"sex": "male"}, ""),
    (_pattern(rf"\b({_one_word_of(SETTING_BEFORE)})\s+(?=(?:notes|records)\b)"), lambda m: {"setting": SETTING_BEFORE[m[1].lower()]}, ""),
    (_pattern(rf"(?<=\bnotas)\s+de\s+({_one_word_of(SETTING_AFTER)})\b|(?<=\bregistros)\s+de\s+({_one_word_of(SETTING_AFTER)})\b"), lambda m: {"setting": SETTING_AFTER[" ".join((m[1] or m[2]).lower().split())]}, ""),
]
_WORD = _pattern(rf"[()]|\b(?:{_one_word_of(AND_WORDS + OR_WORDS)})\b")
_EXCLUSION = _pattern(rf"\s+(?=(?:{_one_word_of(BEGINS_EXCLUSION)})\s)")
_CONNECTED = _pattern(rf"(?:\b(?:{_one_word_of(AND_WORDS + OR_WORDS)})|\()$")


def _words(text: str) -> list[str]:
    """Parentheses, connectives and the conditions between them, in order."""
    out, at = [], 0
    for m in _WORD.finditer(text):
        out += [text[at : m.start()], m[0]]
        at = m.end()
    return [x for x in (w.strip() for w in [*out, text[at:]]) if x]


def parse_question(text: str) -> Plan:
    """Plan of a question. AND binds tighter than OR; `without` begins an excluded condition."""
    if not isinstance(text, str) or not text.strip():
        raise PlanError("the question is empty")
    rest = text.strip().rstrip("?.")
    found: dict = {}
    for pattern, values, stays in _FILTERS:
        for m in pattern.finditer(rest):
            found |= values(m)
        rest = pattern.sub(f"{stays} ", rest)
    rest = re.sub(r"\s+", " ", rest).strip()
    if m := _COMMAND.match(rest):
        rest = rest[m.end() :]
    while m := _OPENER.match(rest):
        rest = rest[m.end() :]
    filters = validate_filters(found)
    if not rest:
        if not found:
            raise PlanError("the question names no condition")
        return Plan(None, filters)
    rest = _EXCLUSION.sub(lambda m: " " if _CONNECTED.search(rest[: m.start()].rstrip()) else " and ", rest)
    return _numbered(Plan(_Grammar(_words(rest)).whole(), filters))


def parse_command(text: str) -> Plan | None:
    """The plan of a question that is a plain command on notes; None for freer prose."""
    if not isinstance(text, str) or not _STRUCTURED.match(text.strip()):
        return None
    try:
        plan = parse_question(text)
    except PlanError:
        return None
    return None if plan.root is None or any(_PROSE.search(x.phrase) for x in leaves(plan.root)) else plan


def _without(pattern: re.Pattern, text: str) -> tuple[str, bool]:
    m = pattern.match(text)
    return (text[m.end() :], True) if m else (text, False)


_EXCLUDE, _LEADS = _starts(EXCLUDES), [(_starts(words), values) for words, values in LEADS]
_CONFIRMED, _LINKING = _starts(CONFIRMED), _starts(LINKING)
_PLANNED_END, _CONFIRMED_END = (_pattern(rf"\s+(?:{_one_word_of(x)})$") for x in (PLANNED_ENDS, CONFIRMED_ENDS))


def condition(text: str) -> Leaf:
    """One condition: its phrase without the words that say how it is meant."""
    phrase, exclude = _without(_EXCLUDE, text)
    for lead, values in _LEADS:
        phrase, fits = _without(lead, phrase)
        if fits:
            break
    else:
        values = {"assertion": "planned"} if _PLANNED_END.search(phrase) else {}
        phrase = _PLANNED_END.sub("", phrase)
    phrase = _CONFIRMED_END.sub("", _without(_CONFIRMED, phrase)[0])
    phrase = _without(_LINKING, phrase)[0].strip()
    if not phrase or len(phrase) > MAX_PHRASE:
        raise PlanError("a condition is empty or too long")
    return Leaf(phrase, exclude=exclude, **values)


class _Grammar:
    """any_of := all_of (OR all_of)*; all_of := one (AND one)*; one := condition or (any_of)."""

    def __init__(self, words: list[str]):
        self.words = words

    def next_in(self, words) -> bool:
        return bool(self.words) and self.words[0].lower() in words

    def whole(self):
        root = self.any_of(1)
        if self.words:
            raise PlanError(f"unexpected {self.words[0]!r}")
        return root

    def joined(self, kind: str, part, words, depth: int):
        parts = [part(depth)]
        while self.next_in(words):
            self.words.pop(0)
            parts.append(part(depth))
        if len(parts) > MAX_CHILDREN:
            raise PlanError(f"a group has 1 to {MAX_CHILDREN} children")
        return parts[0] if len(parts) == 1 else Group(kind, tuple(parts))

    def any_of(self, depth: int):
        if depth > MAX_DEPTH:
            raise PlanError("a plan is at most four deep")
        return self.joined("any", self.all_of, OR_WORDS, depth)

    def all_of(self, depth: int):
        return self.joined("all", self.one, AND_WORDS, depth)

    def one(self, depth: int):
        if self.next_in(("(",)):
            self.words.pop(0)
            inner = self.any_of(depth + 1)
            if not self.next_in((")",)):
                raise PlanError("a parenthesis isn't closed")
            self.words.pop(0)
            return inner
        if not self.words or self.next_in((")", *AND_WORDS, *OR_WORDS)):
            raise PlanError("a condition is missing")
        return condition(self.words.pop(0))


def leaves(node) -> list[Leaf]:
    if node is None:
        return []
    return [node] if isinstance(node, Leaf) else [x for c in node.children for x in leaves(c)]


def _numbered(plan: Plan) -> Plan:
    names = iter(range(1, len(leaves(plan.root)) + 1))
    if len(leaves(plan.root)) > MAX_LEAVES:
        raise PlanError(f"a plan has at most {MAX_LEAVES} leaves")

    def walk(node):
        return replace(node, name=f"c{next(names)}") if isinstance(node, Leaf) else replace(node, children=tuple(map(walk, node.children)))

    return Plan(walk(plan.root), plan.filters)


# ---- compilation


def leaf_matches(leaf: Leaf, ids: list[str], descendants: bool = True):
    """Predicate on one coding."""
    wanted = F.array(*map(F.lit, ids))

    def one(c: Column) -> Column:
        concept = F.arrays_overlap(c["ancestor_ids"], wanted) if descendants else c["concept_id"].isin(*ids)
        base = concept & (c["subject"] == leaf.subject) & (c["status"] == "accepted")
        if leaf.assertion == "historical":
            return base & (c["assertion"] == "present") & (c["temporality"] == "historical")
        return base & (c["assertion"] == leaf.assertion)

    return one


def predicate(node, resolved: dict[str, list[str]], descendants: bool = True) -> Column:
    """A plan's condition on a note's codings; resolved: each leaf's concept ids."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Leaf):
        found = F.exists("codings", leaf_matches(node, validate_ids(resolved[node.name]), descendants))
    else:
        parts = [predicate(c, resolved, descendants) for c in node.children]
        found = parts[0]
        for more in parts[1:]:
            found = (found & more) if node.kind == "all" else (found | more)
    return ~found if node.exclude else found


def demographics(filters: Filters) -> Column:
    out = F.lit(True)
    for value, condition in ((filters.min_age, lambda v: F.col("age") >= v), (filters.max_age, lambda v: F.col("age") <= v), (filters.sex, lambda v: F.col("sex") == v), (filters.setting, lambda v: F.col("setting") == v)):
        if value is not None:
            out = out & condition(value)
    return out


def recent(since_days: int | None, now: datetime, frozen: datetime | None = None) -> Column:
    """occurred_at within so many times 24 hours, both ends included; with a frozen reference
    synthetic notes are measured from it and others from now."""
    if since_days is None:
        return F.lit(True)
    at = F.col("occurred_at")

    def within(reference: datetime) -> Column:
        end = F.lit(reference.isoformat(sep=" ")).cast("timestamp_ntz")
        return at.between(end - F.make_dt_interval(F.lit(since_days)), end)

    if frozen is None:
        return within(now)
    synthetic = F.coalesce("synthetic", F.lit(False))
    return (synthetic & within(frozen)) | (~synthetic & within(now))


def cohort(plan: Plan, resolved: dict[str, list[str]], now: datetime, tenant: str = "demo", frozen: datetime | None = None, descendants: bool = True) -> Column:
    """The whole condition on a note."""
    return (F.col("tenant_id") == tenant) & predicate(plan.root, resolved, descendants) & demographics(plan.filters) & recent(plan.filters.since_days, now, frozen)


def explain_matches(plan: Plan, resolved: dict[str, list[str]], descendants: bool = True) -> dict[str, Column]:
    """For each leaf, the codings that satisfy it."""
    return {x.name: F.filter("codings", leaf_matches(x, validate_ids(resolved[x.name]), descendants)) for x in leaves(plan.root)}
