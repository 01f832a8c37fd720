"""Text expressions: trimming, keys, tokens, aliases. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.vocab import NOISE_TERMS, STOPWORDS

TOKEN = r"[A-Za-z0-9!+#.]+"
INTENT_TOKEN = r"[A-Za-z0-9!+#.']+"


#: What counts as white space: Unicode's property of that name.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; for use inside other expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(~blank(c), c) for c in cs])


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip_markdown(c: Column) -> Column:
    """Text without code, bold, italic and inline-link marks."""
    for pattern in (r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"\[([^\]]+)\]\([^)]+\)"):
        c = F.regexp_replace(c, pattern, "$1")
    return strip(c)


def spaced(c: Column) -> Column:
    """Underscores and hyphens as spaces, white space collapsed."""
    return collapse(F.translate(c, "_-", "  "))


def normalize_term(c: Column) -> Column:
    return spaced(strip_markdown(F.coalesce(c, F.lit(""))))


def anchor_text(c: Column) -> Column:
    return collapse(strip_markdown(F.coalesce(c, F.lit(""))))


def term_key(c: Column) -> Column:
    return casefold(spaced(anchor_text(c)))


def entity_key(c: Column) -> Column:
    return collapse(F.regexp_replace(casefold(normalize_term(c)), "[^a-z0-9!+ ]+", " "))


def singular_key(key: Column) -> Column:
    """A light singular of a key: -ies to -y, then -s, never -ss."""
    return (
        F.when(key.endswith("ies") & (F.length(key) > 4), F.concat(F.substring(key, F.lit(1), F.length(key) - 3), F.lit("y")))
        .when(key.endswith("s") & ~key.endswith("ss") & (F.length(key) > 4), F.substring(key, F.lit(1), F.length(key) - 1))
        .otherwise(key)
    )


def target_page(c: Column) -> Column:
    """A link target as page id: no slashes at the ends, no ``wiki/`` in front."""
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^/+|/+$", ""), "^wiki/", "")


def page_tail(page: Column) -> Column:
    return F.replace(F.regexp_extract(page, "([^/]*)$", 1), F.lit("_"), F.lit(" "))


def acronym(c: Column) -> Column:
    """Initials of two to six words, in capitals; null for other numbers of words and for stop words."""
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9!]+"), F.lit(0))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.size(words).between(2, 6) & ~F.lower(initials).isin(*STOPWORDS), initials)


def plural_alias(c: Column) -> Column:
    """The term and an s, for plain terms of four characters or more that don't end in s; else null."""
    return F.when(c.rlike(r"^[A-Za-z0-9 ]+$") & ~F.lower(c).endswith("s") & (F.length(c) >= 4), F.concat(c, F.lit("s")))


def brand_variants(c: Column, brand: str) -> Column:
    """Spellings of a term that begins with a brand name ending in ``!``: without it, and with a space behind."""
    if not brand:
        return F.array().cast("array<string>")
    bare, n = brand.rstrip("!"), len(brand)
    close = (F.length(c) > n) & ~F.substring(c, n + 1, 1).rlike(r"(?U)^\s")
    first = lambda to: F.concat(F.lit(to), F.substring(c, F.lit(n + 1), F.length(c)))
    every = F.array(F.replace(c, F.lit(brand), F.lit(bare)), F.when(close, first(f"{brand} ")), F.when(close, first(f"{bare} ")))
    return F.when(F.lower(c).startswith(brand), F.array_distinct(F.filter(F.transform(F.array_compact(every), normalize_term), lambda v: v != ""))).otherwise(F.array().cast("array<string>"))


def useful_term(c: Column) -> Column:
    """2 to 80 characters, one of them a letter, digit or ``!``; no year, place number, noise or stop word."""
    key = casefold(c)
    return (
        F.length(c).between(2, 80)
        & ~c.rlike(r"^\d{4}$")
        & ~key.rlike(r"^\d+(?:st|nd|rd|th) place$")
        & ~key.isin(*NOISE_TERMS, *STOPWORDS)
        & c.rlike(r"[A-Za-z0-9!]")
    )


def folded_token(c: Column) -> Column:
    """Lower case, no quotes at the ends."""
    return F.btrim(casefold(c), F.lit("'"))


def stem(t: Column) -> Column:
    """A folded token by simple stems of -ies, -ing and -s."""
    n = F.length(t)
    root = F.substring(t, F.lit(1), n - 3)
    doubled = (F.substring(root, -1, 1) == F.substring(root, -2, 1)) & (F.length(root) >= 2)
    return (
        F.when(t.isin("can't", "cannot"), "cant")
        .when(t == "won't", "wont")
        .when(t.endswith("ies") & (n > 4), F.concat(root, F.lit("y")))
        .when(t.endswith("ing") & (n > 5), F.when(doubled, F.substring(root, F.lit(1), F.length(root) - 1)).otherwise(root))
        .when(t.endswith("s") & (n > 4) & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def normalize_token(c: Column) -> Column:
    """Lower case, no quotes at the ends, simple stems; for use inside other expressions."""
    return let(folded_token(c), stem)


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Raw tokens, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def tokenize(c: Column) -> Column:
    """Normalised tokens that are no stop words, in order, repeats included."""
    return F.filter(F.transform(tokens(c), normalize_token), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def links_to_target(alias: Column, target: Column) -> Column:
    """An alias fits a target if they are equal, one holds the other (both four or longer), or one is the other's acronym."""
    a, t = casefold(normalize_term(alias)), casefold(normalize_term(target))
    inside = F.contains(t, a) | F.contains(a, t)
    short = F.coalesce(acronym(a) == F.upper(t), F.lit(False)) | F.coalesce(acronym(t) == F.upper(a), F.lit(False))
    return (a != "") & (t != "") & ((a == t) | F.when(inside, (F.length(a) >= 4) & (F.length(t) >= 4)).otherwise(short))


def path_prefixes(path: Column) -> Column:
    """All prefixes of a path at slashes, itself last: a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def context_window(text: Column, start: Column, end: Column, width: int = 160, whole: int = 320) -> Column:
    """What stands around a span, on one line; the beginning of the text where there is no span."""
    begin = F.greatest(start - width, F.lit(0))
    part = F.substring(text, (begin + 1).cast("int"), (F.least(end + width, F.length(text)) - begin).cast("int"))
    return collapse(F.when(start.isNull() | end.isNull(), F.substring(text, 1, whole)).otherwise(part))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
