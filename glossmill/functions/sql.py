"""The same text functions as pieces of SQL, for the statements that results are checked against."""

from __future__ import annotations

from glossmill.functions import words


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def all_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))"


def tokens(t: str) -> str:
    return f"list_filter({all_tokens(t)}, lambda x: x NOT IN ({quoted(words.STOPWORDS)}))"


def singular(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 3 THEN {x} WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' "
        f"WHEN regexp_matches({x}, '(ses|xes|zes|ches|shes)$') THEN left({x}, length({x}) - 2) "
        f"WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def terms(t: str) -> str:
    return f"list_distinct(list_transform({tokens(t)}, lambda x: {singular('x')}))"


def is_superlative(x: str) -> str:
    return (
        f"({x} IN ({quoted(words.SUPERLATIVES)}) OR (NOT regexp_matches({x}, '({'|'.join(words.NOT_SUPERLATIVE)})$') "
        f"AND length({x}) >= 6 AND {x} LIKE '%est'))"
    )


def modifiers(t: str) -> str:
    measured = f"list_transform(regexp_extract_all({t}, '(?i)\\bhow\\s+({'|'.join(words.MEASURE_WORDS)})\\b', 1), lambda x: lower(x))"
    return f"list_concat(list_filter({tokens(t)}, lambda x: {is_superlative('x')}), {measured})"


def strip_instruction(t: str) -> str:
    bare = f"regexp_replace({t}, '(?i)\\b(tell|give|show)\\s+me\\b|\\bcan\\s+you\\s+(explain|describe|tell|show|give|list)\\b|\\bplease\\b', ' ', 'g')"
    lead = f"'(?i)^\\s*({'|'.join(words.INSTRUCTION_WORDS)})\\b'"
    rest = f"regexp_replace({bare}, {lead}, '')"
    return f"CASE WHEN regexp_matches({bare}, {lead}) AND len({tokens(rest)}) > 0 THEN {rest} ELSE {bare} END"


def question_terms(t: str) -> str:
    return f"list_filter(list_distinct({tokens(f'({strip_instruction(t)})')}), lambda x: NOT list_contains({modifiers(t)}, x))"


def joined(xs: str) -> str:
    """A list as one text, sorted, for comparing."""
    return f"array_to_string(list_sort({xs}), ' ')"
