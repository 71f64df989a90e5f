"""Anchoring of mentions to their notes, and lossless extraction windows.

These need order within one note, so they run per note: a note's text and mentions are one
row, and Python gets batches of such rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notes import plain_lines, sections_of

# Classes of sections by words of their titles, first hit wins.
SECTION_CLASSES = [
    ("family|familiar", "family_history"), ("present illness|hpi|enfermedad actual", "present_illness"), ("past medical|antecedentes personales", "history"),
    ("reason for|chief complaint|motivo de", "chief_complaint"), ("assessment|diagnos|evaluaci|impression", "active"), ("plan", "plan"),
]
# What makes a section or a line's beginning background, says that something goes on, or that it is over.
BACKGROUND_TITLE = re.compile("past medical|antecedentes personales|^(?:history|antecedentes)$", re.IGNORECASE)
BACKGROUND_LINE = re.compile("past medical history|antecedentes (?:personales|de)", re.IGNORECASE)
GOES_ON = re.compile(r"\b(?:currently|ongoing|active|persists|known|actualmente|activo|activa|persiste|conocid[oa])\b", re.IGNORECASE)
IS_OVER = re.compile(r"\b(?:resolved|subsided|ceased|cleared|resuelt[oa]|cedio|cede|desapareci[oó])\b", re.IGNORECASE)


def section_class(title: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", title or "") if not 0x300 <= ord(c) <= 0x36F).lower()
    return next((name for words, name in SECTION_CLASSES if re.search(words, plain)), plain)


MEANING = ("subject", "assertion", "temporality", "kind", "workflow")


def _occurrences(low: str, needle: str) -> list[tuple[int, int]]:
    found, at = [], low.find(needle) if needle else -1
    while at >= 0:
        found.append((at, at + len(needle)))
        at = low.find(needle, at + len(needle))
    return found


def _quoted(low: str, sentence: str, start: int, end: int) -> bool:
    """Whether an occurrence lies in the last copy of the sentence that begins before it."""
    at = low.rfind(sentence, 0, start + len(sentence))
    return at >= 0 and end <= at + len(sentence)


def anchor_note(text: str, mentions: list[dict]) -> list[dict]:
    """Each mention with start, end, evidence, and its state as far as the place supports it.

    Of the occurrences of its words that no earlier mention of the same meaning took, that lie in
    its window and in its quoted sentence where it has them, it takes the one it names, else one in
    a section of its class, else the first.
    """
    low, taken, sections, out = text.lower(), set(), sections_of(text), []
    for m in mentions:
        meaning = tuple(m.get(k) for k in MEANING)
        words, quote, window = (m.get("verbatim") or m.get("phrase") or "").strip().lower(), (m.get("sentence") or "").strip().lower(), m.get("window")
        free = []
        for start, end in _occurrences(low, words):
            inside = not window or (start >= window[0] and end <= window[1])
            if (start, end, meaning) not in taken and inside and (not quote or _quoted(low, quote, start, end)):
                free.append((start, end, next((s[0] for s in sections if s[1] <= start < s[3]), None)))
        named = [x for x in free if x[:2] == (m.get("start"), m.get("end"))]
        wanted = [x for x in free if section_class(x[2]) == section_class(m.get("section"))]
        best = next(iter(named or wanted or free), None)
        if best is None:
            out.append({**m, "start": None, "end": None, "evidence": "unanchored", "reasons": []})
            continue
        start, end, title = best
        taken.add((start, end, meaning))
        out.append({**m, **_state(text, m, start, end, title or ""), "start": start, "end": end, "evidence": "anchored"})
    return out


def _state(text: str, m: dict, start: int, end: int, title: str) -> dict:
    """temporality, clinical_status and reasons of a mention at its place."""
    begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    line = text[begin : stop if stop >= 0 else len(text)]
    background = bool(BACKGROUND_TITLE.search(title) or BACKGROUND_LINE.search(text[begin:start]))
    present, current = m.get("assertion") == "present", m.get("temporality") == "current"
    unstated = background and m.get("kind") == "condition" and m.get("subject") != "family" and present and current and not GOES_ON.search(line)
    resolved = m.get("clinical_status") == "resolved"
    unsupported = m.get("assertion") == "absent" and resolved and not IS_OVER.search(m.get("sentence") or line)
    presenting = m.get("kind") == "symptom" and present and m.get("temporality") == "historical" and resolved and section_class(title) == "chief_complaint"
    said = [(unstated, "background-activity-not-stated"), (unsupported, "absence-does-not-establish-resolved-history"), (presenting, "resolved-presenting-symptom-is-encounter-problem")]
    return {
        "temporality": "unknown" if unstated else "current" if presenting else m.get("temporality"),
        "clinical_status": "unknown" if unstated or unsupported else m.get("clinical_status"),
        "reasons": [reason for holds, reason in said if holds],
    }


FIELDS = ("phrase", "verbatim", "sentence", "section", "subject", "assertion", "temporality", "kind", "workflow", "clinical_status")


def anchored(notes: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """mentions (key, pos, phrase and any of FIELDS) with start, end, evidence, temporality,
    clinical_status and reasons, in notes (key, text)."""
    held = [c for c in FIELDS if c in mentions.columns]
    ordered = mentions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *held))).alias("m"))
    rows = notes.select(key, "text").join(ordered, key)
    names = [key, "pos", "phrase", "start", "end", "evidence", "temporality", "clinical_status", "reasons"]

    def run(batches):
        for frame in batches:
            out = []
            for note, text, found in zip(frame[key], frame["text"], frame["m"], strict=True):
                for m in anchor_note(plain_lines(text), [dict(x) if isinstance(x, dict) else x.asDict() for x in found]):
                    out.append((note, m["pos"], m.get("phrase"), m["start"], m["end"], m["evidence"], m.get("temporality"), m.get("clinical_status"), ",".join(m["reasons"])))
            yield pd.DataFrame(out, columns=names).astype({"start": "Int64", "end": "Int64"})

    kind = dict(notes.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, pos int, phrase string, start long, end long, evidence string, temporality string, clinical_status string, reasons string")


def extraction_windows(text: str, size: int) -> list[str]:
    """Pieces of about size characters that end at sentence or line ends where they can; together
    they are the text, and none is blank unless the text is."""
    out, at = [], 0
    while len(text) - at > size:
        cut = max((m.end() for m in re.finditer(r"[.!?]\s+|\n+|\s+", text[at : at + size])), default=size)
        best = max((m.end() for m in re.finditer(r"[.!?]\s+|\n+", text[at : at + size])), default=0)
        step = best or cut
        out.append(text[at : at + step])
        at += step
    out.append(text[at:])
    merged: list[str] = []
    for piece in out:
        if merged and (not piece.strip() or not merged[-1].strip()):
            merged[-1] += piece
        else:
            merged.append(piece)
    return [p for p in merged if p]


def window_rows(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, k, start, window of every text."""

    def run(batches):
        for frame in batches:
            out = []
            for name, value in zip(frame[key], frame[text], strict=True):
                start = 0
                for k, piece in enumerate(extraction_windows(value or "", size)):
                    out.append((name, k, start, piece))
                    start += len(piece)
            yield pd.DataFrame(out, columns=[key, "k", "start", "window"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, k int, start long, window string")
