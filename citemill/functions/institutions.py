"""Institutions named in an affiliation block. Expressions over one block; operators/resolve.py adds the registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import institution_values as V
from . import text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, instead of once for each place where it stands."""
    return F.get(F.transform(F.array(value), use), 0)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(text.squash(c), F.lit("[a-z0-9]+"), F.lit(0))


def _any(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, known)))


def narrative(block: Column) -> Column:
    """Prose that assigns several people: two 'is with' and two sentence breaks."""
    return (F.regexp_count(block, F.lit(r"(?i)\b(?:is|are)\s+(?:also\s+)?with\b")) >= 2) & (F.regexp_count(block, F.lit("[.;]")) >= 2)


def ror_ids(block: Column) -> Column:
    """ROR addresses, distinct in order of the five spellings: address, host, spaced address, spaced host, prefix."""
    spellings = (r"https?://(?:www\.)?ror\.org/[0-9a-z]{9}", r"\bror\.org/[0-9a-z]{9}\b", r"https?://(?:www\.)?ror\.org/\s*0(?:\s*[0-9a-z]){8}", r"\bror\.org/\s*0(?:\s*[0-9a-z]){8}", r"\bror(?:\s*id)?\s*[:#-]?\s*(0(?:\s*[0-9a-z]){8})\b")
    found = F.concat(*[F.regexp_extract_all(block, F.lit(f"(?i){p}"), F.lit(1 if "(0" in p else 0)) for p in spellings])
    tail = F.transform(found, lambda x: F.regexp_extract(F.regexp_replace(F.lower(x), r"\s+", ""), r"^(?:(?:https?://(?:www\.)?)?ror\.org/)?(0[0-9a-z]{8})$", 1))
    return F.array_distinct(F.transform(F.filter(tail, lambda x: x != ""), lambda x: F.concat(F.lit("https://ror.org/"), x)))


def grid_ids(block: Column) -> Column:
    found = F.regexp_extract_all(block, F.lit(r"(?i)\bgrid\s*\.\s*[a-z0-9]+\.[a-z0-9]+\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"\s+", "")))


def grid_candidates(grid: Column) -> Column:
    """A GRID id, and if its last part is long that part cut to 2, 1, 3 and 4 characters."""
    head, tail = F.regexp_extract(grid, r"^(grid\.[a-z0-9]+\.)([a-z0-9]+)$", 1), F.regexp_extract(grid, r"^(grid\.[a-z0-9]+\.)([a-z0-9]+)$", 2)
    cut = F.array(*[F.concat(head, F.left(tail, F.lit(n))) for n in (2, 1, 3, 4)])
    return F.when(F.length(tail) > 4, F.concat(F.array(grid), cut)).otherwise(F.array(grid))


def emails(block: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))


def email_domains(email: Column) -> Column:
    """The domain and its parents of two labels or more, longest first."""
    labels = F.split(F.lower(F.substring_index(email, "@", -1)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _geo_words(words: Column) -> Column:
    known = F.array(*map(F.lit, V.STATE_CODES + V.GEO))
    return F.size(F.filter(words, lambda w: F.array_contains(known, w) | w.rlike(r"^\d{5}(?:-\d{4})?$")))


def geo_only(c: Column) -> Column:
    """Whether a phrase is a place and nothing else (one other word is allowed in up to four)."""
    words = _words(c)
    n, geo = F.size(words), _geo_words(words)
    return (n > 0) & ((geo == n) | ((n <= 4) & (geo >= n - 1)))


def worth_matching(c: Column) -> Column:
    words = _words(c)
    single = F.array_contains(F.array(*map(F.lit, text.SHORT_NAMES)), F.get(words, 0))
    return (
        F.when((F.size(words) == 0) | text.squash(c).isin("and", "or") | geo_only(c), False)
        .when(_any(words, V.ANCHORS) | _any(words, V.ORG_SUFFIXES), True)
        .when(_any(words, V.UNITS), False)
        .when(F.size(words) == 1, single)
        .otherwise(True)
    )


def candidates(block: Column) -> Column:
    """What to look up: the whole block, its ;/| pieces, and their parts around 'and' where two or more name institutions."""
    label = text.institution_label
    pieces = F.filter(F.split(block, "[;|]+"), lambda p: F.trim(p) != "")

    def parts(piece: Column) -> Column:
        marked = F.filter(F.transform(F.split(label(piece), r"(?i)\band\b(?!\s+[A-Za-z]+'s\b)"), label), lambda x: _any(_words(x), V.MARKERS))
        return F.when(F.size(marked) >= 2, marked).otherwise(F.array().cast("array<string>"))

    rest = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(label(p)), parts(p))))
    return F.array_distinct(F.concat(F.array(label(block)), F.filter(rest, worth_matching)))


def systems(block: Column) -> Column:
    """University systems that a block mentions, in rule order."""
    plain = text.squash(text.institution_label(block))
    words = _words(text.institution_label(block))
    said = [F.when(reduce(lambda a, b: a | b, [F.contains(plain, F.lit(p)) for p in phrases]) | _any(words, tokens), name) for name, (phrases, tokens, _) in V.SYSTEMS.items()]
    return F.array_compact(F.array(*said))


def clauses(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "[;|,]+"), lambda x: F.trim(x)), lambda x: x != "")


def _phrase(c: Column, phrase: str) -> Column:
    return c.rlike(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])")


def _campus(parts: Column, aliases: dict[str, str]) -> Column:
    """The campus of the first clause that has one."""
    def one(clause: Column) -> Column:
        plain = text.squash(text.institution_label(clause))
        return F.coalesce(*[F.when(_phrase(plain, a), name) for a, name in aliases.items()])

    return F.get(F.array_compact(F.transform(parts, one)), 0)


def system_label(block: Column, context: Column) -> Column:
    """'System, Campus' of the first system mentioned (here or in context) whose campus a clause names; null if none."""
    here = systems(block)
    labels = []
    for name, (_, _, aliases) in V.SYSTEMS.items():
        campus = _campus(clauses(block), aliases)
        known = F.array_contains(here, name) | F.coalesce(F.array_contains(context, name), F.lit(False))
        labels.append(F.when(known & campus.isNotNull(), F.concat(F.lit(f"{name}, "), campus)))
    return F.coalesce(*labels)


STATE = "(?i)\\b(?:the\\s+)?un(?:i)?versity\\s+of\\s+(" + "|".join(sorted(V.STATES, key=lambda s: -len(s))) + ")\\b"


def _state(block: Column) -> Column:
    """Struct of state in 'University of {State}' ('' if none), the text after it, and its first clause normalised."""
    pattern = f"{STATE}([\\s\\S]*)"
    state, after = F.initcap(F.regexp_replace(F.regexp_extract(block, pattern, 1), r"\s+", " ")), F.regexp_extract(block, pattern, 2)
    first = text.squash(text.institution_label(F.split(after, "[,;|.]", 2)[0]))
    return F.struct(state.alias("state"), after.alias("after"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(first, "^-", "")), "^in ", "")).alias("first"))


def _kept(s: Column) -> Column:
    ends = F.coalesce(*[F.when(s["first"].startswith(p), name) for p, name in V.KEPT_SUFFIXES.items()])
    return F.when((s["state"] != "") & (s["first"] != "") & ends.isNotNull(), F.concat_ws(" ", F.lit("University of"), s["state"], ends))


def kept_state_label(block: Column) -> Column:
    """'University of {State} School of Medicine' and the like, or null."""
    return _let(_state(block), _kept)


def state_base(block: Column) -> Column:
    return _let(_state(block), lambda s: F.when(s["state"] != "", F.concat(F.lit("University of "), s["state"])))


def state_label(block: Column) -> Column:
    """A state university with its campus or school; null if what follows is not known to belong to it."""

    def label(s: Column) -> Column:
        base = F.concat(F.lit("University of "), s["state"])
        at = text.institution_label(F.regexp_extract(s["after"], r"(?i)^\s+at\s+([A-Za-z][A-Za-z .'\-]{1,80}?)(?=$|[,;|.])", 1))
        sure = reduce(lambda a, b: a | b, [s["first"].startswith(p) for p in V.SURE_SUFFIXES])
        campus = F.coalesce(*[F.when((F.lower(s["state"]) == st) & _phrase(s["first"], a), name) for st, aliases in V.STATE_CAMPUSES.items() for a, name in aliases.items()])
        rest = F.coalesce(_kept(s), F.when((s["first"] == "") | sure, base), F.when(campus.isNotNull(), F.concat_ws(", ", base, campus)))
        return F.when(s["state"] == "", None).when(at != "", F.concat_ws(", ", base, at)).otherwise(rest)

    return _let(_state(block), label)


_NAME = r"[A-Z][A-Za-z0-9'’&()./\-]*"
_SUFFIX = "|".join(re.escape(s) for s in V.LITERAL_SUFFIXES)
_END = r"(?=\s*(?:$|[,;|.]))"
LITERAL = rf"(?<![A-Za-z0-9])((?:The\s+)?{_NAME}(?:\s+{_NAME}){{0,12}}\s+(?:{_SUFFIX})){_END}"
LITERAL_OF = rf"(?<![A-Za-z0-9])((?:The\s+)?University\s+of\s+{_NAME}(?:\s+{_NAME}){{0,8}}){_END}"


def _literal_ok(label: Column) -> Column:
    words, plain = _words(label), text.squash(label)
    marker = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(m)) for m in V.MARKERS])
    suffix = _any(words, V.ORG_SUFFIXES)
    only = F.forall(words, lambda w: F.array_contains(F.array(*map(F.lit, V.ORG_SUFFIXES)), w))
    unit = plain.rlike(rf"^(?:{'|'.join(V.UNIT_PREFIXES)})\b")
    return (plain != "") & ~_any(words, V.BLOCKED_LABELS) & ~unit & ~geo_only(label) & (marker | suffix) & ~(suffix & only) & ~plain.isin(*V.NOT_ALONE)


def literal_labels(block: Column) -> Column:
    """Capitalised names that end like an institution, the known ones first; distinct by key."""
    plain = text.squash(text.institution_label(block))
    known = F.array_compact(F.array(*[F.when(_phrase(plain, n.lower()), n) for n in V.LITERALS]))
    found = F.concat(known, *[F.regexp_extract_all(block, F.lit(p), F.lit(1)) for p in (LITERAL, LITERAL_OF)])
    labels = F.transform(found, lambda x: F.trim(F.regexp_replace(text.institution_label(x), r"^(?i:the)\s+", "")))
    return distinct_by_key(F.filter(labels, _literal_ok))


def distinct_by_key(labels: Column) -> Column:
    """Labels with a key, the first of each key."""
    keyed = F.filter(labels, lambda x: text.institution_key(x) != "")
    keys = F.transform(keyed, text.institution_key)
    return F.filter(keyed, lambda x, i: F.array_position(keys, text.institution_key(x)) == i + 1)


def company_label(block: Column) -> Column:
    """The first clause, of two to six words none of them generic, if it has a company word or a place follows; or null."""
    parts = F.filter(F.transform(F.split(block, "[,;|]+"), text.institution_label), lambda x: x != "")
    first = F.get(parts, 0)
    words = _words(first)
    tail = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", ")
    tail_words = _words(tail)
    place = (F.size(tail_words) > 0) & (geo_only(tail) | (_geo_words(tail_words) >= F.greatest(F.lit(1), F.floor(F.size(tail_words) / 2))))
    unit = text.squash(first).rlike(rf"^(?:{'|'.join(V.UNIT_PREFIXES)})\b")
    fits = F.size(words).between(2, 6) & ~_any(words, V.BLOCKED_LABELS) & ~_any(words, text.GENERIC_WORDS) & ~unit & ~geo_only(first)
    return F.when(fits & (_any(words, V.COMPANY) | place), first)


def country(block: Column) -> Column:
    """The country, other than the United States, that the last clause names; '' if none. States' names and codes are no countries."""
    keys = {re.sub("^the ", "", n.lower().replace(".", "")): n for n in V.COUNTRIES} | V.COUNTRY_ALIASES
    names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    parts = F.filter(F.transform(F.split(block, "[,;|]+"), text.institution_label), lambda x: x != "")
    own = [*V.US_KEYS, *[s.lower() for s in V.STATES], *V.STATE_CODES]
    return F.coalesce(_let(text.country_key(F.get(F.reverse(parts), 0)), lambda key: F.when(~key.isin(*own) & ~key.rlike(r"\d"), names[key])), F.lit(""))


def with_country(labels: Column, block: Column) -> Column:
    """Labels with the block's country after those that do not end with it, distinct by key; unchanged without a country."""

    def named(where: Column) -> Column:
        clean = F.filter(F.transform(labels, text.institution_label), lambda x: x != "")
        ended = F.transform(clean, lambda x: F.when(F.endswith(text.country_key(x), text.country_key(where)), x).otherwise(F.concat_ws(", ", x, where)))
        return F.when(where == "", labels).otherwise(distinct_by_key(ended))

    return _let(country(block), named)
