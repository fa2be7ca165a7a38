"""Target names, and how an author's name matches one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


@dataclass(frozen=True)
class Target:
    surname: str
    given: str
    initials: str
    style: str  # full or initials
    orcid: str = ""


def _plain(word: str) -> str:
    return re.sub("[^a-z0-9]+", "", word.lower())


def initial_like(word: str) -> bool:
    """One letter, or up to four that are upper case, dotted, or two at most."""
    n = len(_plain(word))
    return n == 1 or 1 < n <= 4 and (word.isupper() or "." in word or n <= 2)


def parse_target(raw: str, orcid: str = "") -> Target:
    """A target from 'Surname, Given', 'Surname INITIALS', 'INITIALS Surname' or 'Given Surname'."""

    def built(surname: str, given: list[str]) -> Target | None:
        plain = [p for p in map(_plain, given) if p]
        if not surname or not plain:
            return None
        if all(map(initial_like, given)):
            return Target(surname, " ".join(plain), "".join(plain), "initials", orcid)
        return Target(surname, " ".join(plain), "".join(w[0] for w in re.findall("[a-z]+", " ".join(plain))), "full", orcid)

    before, comma, after = raw.strip().partition(",")
    if comma and (found := built(_plain(before), [w for w in re.split(r"[,\s]+", after) if w])):
        return found
    words = raw.split()
    if len(words) < 2:
        raise ValueError("Author name must include at least given name and surname")
    first_is_surname = all(map(initial_like, words[1:]))
    surname, given = (words[0], words[1:]) if first_is_surname else (words[-1], words[:-1])
    found = built(_plain(surname), given)
    if found is None:
        raise ValueError("Author name must include at least given name and surname")
    return found


def surname_keys(last_name: Column) -> Column:
    """Keys under which a surname can be found: all of it, and the last part of a compound."""
    parts = F.filter(F.split(F.lower(last_name), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_distinct(F.filter(F.array(text.token(last_name), F.when(F.size(parts) > 1, F.element_at(parts, -1))), lambda k: k.isNotNull() & (k != "")))


def match_method(author: dict[str, Column], target: dict[str, Column]) -> Column:
    """orcid, given, initials, or null: how author (last_name, fore_name, initials, orcid; surname_keys if known) matches target (surname, given, initials, style, orcid)."""
    identifier = F.coalesce(author["orcid"], F.lit(""))
    keys = author.get("surname_keys", surname_keys(F.coalesce(author["last_name"], F.lit(""))))
    fore = text.squash(F.coalesce(author["fore_name"], F.lit("")))
    own = F.struct(
        F.when(identifier == "", "").otherwise(text.orcid(identifier)).alias("orcid"),
        F.array_contains(keys, target["surname"]).alias("surname"),
        F.coalesce(F.nullif(text.token(author["initials"]), F.lit("")), text.initials(author["fore_name"]), F.lit("")).alias("short"),
        fore.alias("fore"),
        text.token(F.split_part(fore, F.lit(" "), F.lit(1))).alias("first"),
        text.token(F.split_part(target["given"], F.lit(" "), F.lit(1))).alias("wanted"),
    )

    def method(o: Column) -> Column:
        wanted = target["initials"]
        both = (o["short"] != "") & (wanted != "")
        has_given = (o["fore"] != "") & (target["given"] != "")
        return (
            F.when((target["orcid"] != "") & (o["orcid"] != ""), F.when(o["orcid"] == target["orcid"], "orcid"))
            .when(~o["surname"], None)
            .when(target["style"] == "initials", F.when(both & (o["short"].startswith(wanted) | wanted.startswith(o["short"])), "initials"))
            .when(has_given & (o["first"] != "") & (o["first"] == o["wanted"]), "given")
            .when(has_given & (F.length(o["first"]) > 1), None)
            .when(both & o["short"].startswith(F.left(wanted, F.lit(1))), "initials")
        )

    # the normal forms are used several times each, so they are computed in a struct of their own
    return F.get(F.transform(F.array(own), method), 0)
