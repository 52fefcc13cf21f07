"""SQL texts of the value tests, for the statements that the queries are compared with."""

from __future__ import annotations

from drayage.functions import shapes as S


def lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9&]+', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def letters(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z]', '', 'g')"


def is_label(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN true ELSE NOT regexp_matches({x}, '[0-9]') AND regexp_replace(upper({x}), '[^A-Z]', '', 'g') IN ({', '.join(map(lit, S.LABEL_WORDS))}) END"


def is_header(t: str) -> str:
    """Of a stripped text."""
    own = f"regexp_replace(upper({t}), '[^A-Z]', '', 'g')"
    return (
        f"(CASE WHEN {t} IS NULL OR {t} = '' THEN true ELSE ({is_label(t)}) OR regexp_matches({own}, '{'|'.join(S.HEADER_PARTS)}') OR regexp_matches({t}, '(?i)point\\s+of\\s+(origin|destination)') "
        f"OR (regexp_matches({t}, '(?i)sub[\\s-]*haul') AND NOT regexp_matches({t}, '(?i)[A-Za-z]{{4,}}\\s+(LLC|INC|CORP)') AND length({own}) <= 16) END)"
    )


def is_junk(t: str) -> str:
    """Of a stripped text."""
    words = f"regexp_extract_all({t}, '[A-Za-z]+')"
    return (
        f"(CASE WHEN {t} IS NULL OR {t} = '' THEN false ELSE {is_header(t)} OR length({letters(t)}) BETWEEN 1 AND 3 OR regexp_matches({t}, '{S.DATE_BOX}') OR regexp_matches({t}, '^[A-Z]{{2,4}}\\d+\\s+[A-Za-z]') "
        f"OR (len({words}) >= 3 AND len(list_filter({words}, lambda w: length(w) > 3)) = 0) OR (len({words}) >= 1 AND contains({t}, '/') AND NOT regexp_matches({t}, '{S.KNOWN_SLASHED}')) "
        f"OR (len({words}) >= 4 AND regexp_matches({t}, '\\d') AND NOT regexp_matches({t}, '{S.PLACE_WORDS}')) OR len(list_filter({words}, lambda w: length(w) <= 7 AND regexp_matches(w, '{S.CASE_FLIPS}'))) > 0 END)"
    )
