"""Pieces of the SQL that queries are compared with."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from convlens import lexicon as L


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: Sequence[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE len(string_split_regex({strip(x)}, '\\s+')) END"


def any_of(low: str, ws: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(w)})" for w in ws) + ")"


def hits(low: str, ws: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, {quoted(w)}) AS INT)" for w in ws) + ")"


def cascade(low: str, categories: Mapping[str, Sequence[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(low, w)} THEN {quoted(c)}" for c, w in categories.items()) + " ELSE 'General' END"


def scored(low: str, categories: Mapping[str, Sequence[str]]) -> str:
    n = {c: hits(low, w) for c, w in categories.items()}
    best = "greatest(" + ", ".join(n.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN 'General' " + " ".join(f"WHEN {x} = {best} THEN {quoted(c)}" for c, x in n.items()) + " END"


def ratio(p: str, n: str) -> str:
    return f"CASE WHEN {p} + {n} > 0 THEN ({p} - {n}) / CAST({p} + {n} AS DOUBLE) ELSE 0.0::DOUBLE END"


def presence(low: str, positive: Sequence[str], negative: Sequence[str]) -> str:
    return ratio(hits(low, positive), hits(low, negative))


def counts(low: str, positive: Sequence[str], negative: Sequence[str]) -> str:
    of = lambda ws: "(" + " + ".join(f"(length({low}) - length(replace({low}, {quoted(w)}, ''))) // {len(w)}" for w in ws) + ")"
    return ratio(of(positive), of(negative))


def topics(low: str, found: Mapping[str, Sequence[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(low, w)} THEN {quoted(t)} END" for t, w in found.items()) + "], lambda x: x IS NOT NULL)[1:5]"


def flags(x: str, patterns: Mapping[str, str]) -> dict[str, str]:
    return {k: f"regexp_matches({x}, {quoted(p)})" for k, p in patterns.items()}


def language(x: str) -> tuple[str, str]:
    """The indicator rules; scripts are left to the test data's Latin texts."""
    n = {k: hits(f"lower({x})", w) for k, w in L.INDICATORS.items()}
    rules = [
        ("de", f"{n['de']} >= 3 AND {n['de']} > {n['es']} AND {n['de']} > {n['fr']}", f"least({n['de']} / 10.0, 0.9)"),
        ("fr", f"{n['fr']} >= 3 AND {n['fr']} > {n['es']}", f"least({n['fr']} / 10.0, 0.9)"),
        ("es", f"{n['es']} >= 3 AND {n['es']} > {n['en']} // 2", f"least({n['es']} / 10.0, 0.9)"),
        ("en", f"{n['en']} >= 5", f"least({n['en']} / 28.0, 0.95)"),
    ]
    code = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c, _ in rules) + " ELSE 'unknown' END"
    return code, "CAST(CASE " + " ".join(f"WHEN {c} THEN {x}" for _, c, x in rules) + " ELSE 0.0 END AS DOUBLE)"


def escaped(pattern: str) -> str:
    return re.escape(pattern)
