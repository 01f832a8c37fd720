"""Pieces of the queries' SQL."""

from __future__ import annotations

from weftwork.vocab import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(t: str) -> str:
    """A lower-cased token as normalize_token() makes it."""
    return (
        f"(CASE WHEN {t} IN ('can''t', 'cannot') THEN 'cant' WHEN {t} = 'won''t' THEN 'wont' WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'ing') AND length({t}) > 5 THEN (CASE WHEN substr({t}, length({t}) - 3, 1) = substr({t}, length({t}) - 4, 1) THEN left({t}, length({t}) - 4) ELSE left({t}, length({t}) - 3) END) "
        f"WHEN ends_with({t}, 's') AND length({t}) > 4 AND NOT ends_with({t}, 'ss') THEN left({t}, length({t}) - 1) ELSE {t} END)"
    )


def terms(source: str, key: str, text: str) -> str:
    """Rows (key, term), repeats included, of all tokens that are no stop words."""
    return (
        f"(SELECT * FROM (SELECT {key}, {norm('t')} AS term FROM (SELECT {key}, lower(unnest(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9!+#.]+'))) AS t FROM {source})) WHERE term <> '' AND term NOT IN ({STOP}))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


PAGE = "concat_ws('/', lang, source, doc_id::VARCHAR)"
TITLE = "coalesce(nullif(regexp_extract(coalesce(text, ''), '^([A-Za-z]+ [A-Za-z]+)', 1), ''), 'Document ' || doc_id)"


def packed(lines: str, limit: int, separator: str) -> str:
    """Greedy packing of a list of strings, as pack() does it."""
    n, s = len(separator.replace("\\n", "n")), "chr(10) || chr(10)" if separator == "\\n\\n" else f"'{separator}'"
    step = (
        f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform({lines}, lambda x: {{'done': []::VARCHAR[], 'open': x}})), "
        f"lambda a, x: CASE WHEN a.open <> '' AND length(a.open) + {n} + length(x.open) > {limit} THEN {{'done': list_append(a.done, a.open), 'open': x.open}} "
        f"ELSE {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || {s} || x.open END}} END)"
    )
    return f"list_filter(list_append(({step}).done, ({step}).open), lambda p: p <> '')"
