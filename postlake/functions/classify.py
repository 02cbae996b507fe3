"""Role families and skill mentions, generated from the rule tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import any_phrase, as_column, let, normalize_for_matching
from postlake.rules.roles import ROLE_PATTERNS
from postlake.rules.skills import DEGREE_REACH, DEGREE_WORDS, MAJOR_LIKE, SKILLS


def role_family(title: Column | str, rules=ROLE_PATTERNS, other: str = "OTHER") -> Column:
    """First matching family of the ordered rules."""
    return let(normalize_for_matching(title), lambda key: role_family_of_key(key, rules, other))


def role_family_of_key(key: Column, rules=ROLE_PATTERNS, other: str = "OTHER") -> Column:
    return F.coalesce(*[F.when(key.rlike(p), family) for family, p in rules], F.lit(other))


def skill_pattern(name: str, pattern: str, majors=MAJOR_LIKE) -> str:
    """Whole pattern: word-like left and right boundaries, and for names that are also fields
    of study no degree word shortly before (a bounded look-behind).

    The name is tried first, as a look-ahead, so the look-behinds run only where it occurs.
    """
    study = ""
    if name in majors:
        study = rf"(?<!\b(?:{DEGREE_WORDS})\b[^.;]{{0,{DEGREE_REACH}}})"
    return rf"(?U)(?=(?:{pattern})(?![\w+#]))(?<![\w.+#]){study}"


#: The first letters of every word of a lower-cased text.
_WORD_STARTS = r"(?<![a-z0-9])[a-z0-9]{1,3}"


def _start(literal: str) -> str | None:
    """The first letters of a literal's first word, as ``_WORD_STARTS`` gives them; none if the word may go on behind the literal."""
    word = re.search("[a-z0-9]+", literal)
    return None if word is None or (len(word[0]) < 3 and word.end() == len(literal)) else word[0][:3]


def extract_skills(text: Column | str, skills=SKILLS, majors=MAJOR_LIKE) -> Column:
    """Skill names mentioned in ``text``, in dictionary order, without repeats.

    The text is cut into word starts once; their intersection with those of all literals is small, and only
    for the entries found there the substring test on the whole literal and then the pattern run. So a
    larger dictionary costs one look-up more per entry, not one more pass over the text. A literal of three
    letters or more must begin a word wherever the pattern matches; shorter ones are not looked up.
    """
    starts = sorted({start for _, _, literals in skills for literal in literals if (start := _start(literal))})
    seen = lambda t: F.array_intersect(F.regexp_extract_all(t, F.lit(_WORD_STARTS), F.lit(0)), F.array(*map(F.lit, starts)).cast("array<string>"))
    return let(F.lower(as_column(text)), lambda t: let(seen(t), lambda found: _mentioned(t, found, skills, majors)))


def _mentioned(text: Column, found: Column, skills, majors) -> Column:
    hits = [
        F.when(
            any_start(found, literals) & any_phrase(text, literals) & text.rlike(skill_pattern(name, pattern, majors)),
            name,
        )
        for name, pattern, literals in skills
    ]
    return F.when(
        text.isNotNull(), F.array_compact(F.array(*hits))
    ).otherwise(F.array().cast("array<string>"))


def any_start(found: Column, literals) -> Column:
    """True when one of the literals may occur, by the word starts found."""
    starts = {_start(literal) for literal in literals}
    if None in starts:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.array_contains(found, start) for start in sorted(starts)], F.lit(False))
