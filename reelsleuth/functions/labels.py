"""What disc labels say: season, disc, part, and the words to search for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\+?[0-9]{1,9}$"


def _words(label: Column, separators: str = "_.-") -> Column:
    """Words of a label in capitals, `S3D1` taken apart."""
    spaced = split_season_disc(F.translate(label, separators, " " * len(separators)))
    return F.filter(F.split(F.upper(spaced), r"\s+"), lambda w: w != "")


def split_season_disc(label: Column) -> Column:
    """`S3D1` as `S3 D1`, word by word."""
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("(?i)^S[0-9]+D[0-9]+$"), F.regexp_replace(F.upper(w), "^S([0-9]+)D([0-9]+)$", "S$1 D$2")).otherwise(w)), " ")


def _first(words: Column, found) -> Column:
    """The first non-null of `found(words, i)` in order of words."""
    each = F.transform(words, lambda w, i: found(words, w, i))
    return F.get(F.filter(each, lambda x: x.isNotNull()), 0)


def _number(word: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(word, pattern, 1), F.lit("")).try_cast("int")


def _next_number(words: Column, i: Column) -> Column:
    return F.when(F.get(words, i + 1).rlike(NUMBER), F.get(words, i + 1).cast("int"))


def disc_number(label: Column) -> Column:
    """`DISC 2`, `DISK 2`, `D 2` or `D2`."""
    return _first(_words(label), lambda ws, w, i: F.coalesce(F.when(w.isin("DISC", "DISK", "D"), _next_number(ws, i)), _number(w, "^D([0-9]{1,9})$")))


def season_number(label: Column) -> Column:
    """`SEASON 2`, `SERIES 2`, `SEASON2`, `S2` or `S2P1`."""
    return _first(_words(label), lambda ws, w, i: F.coalesce(F.when(w.isin("SEASON", "SERIES"), _next_number(ws, i)), _number(w, "^(?:SEASON|SERIES)([0-9]{1,9})$"), _number(w, "^S([0-9]{1,9})(?:P[0-9]+)?$")))


def part_number(label: Column) -> Column:
    """`PART 2`, `PT 2`, `S1P2`, or `P2` after a season."""
    words = F.filter(F.split(F.upper(F.translate(label, "_.-", "   ")), r"\s+"), lambda w: w != "")

    def found(ws, w, i):
        after = (i > 0) & F.get(ws, F.greatest(i - 1, F.lit(0))).rlike("^S[0-9]+(P[0-9]+)?$")
        return F.coalesce(F.when(w.isin("PART", "PT"), _next_number(ws, i)), _number(w, "^S[0-9]+P([0-9]{1,9})$"), F.when(after, _number(w, "^P([0-9]{1,9})$")))

    return _first(words, found)


def search_terms(query: Column) -> Column:
    """The query without trailing season and part tokens; one word stays."""
    plain = F.trim(F.regexp_replace(query, r"\s+", " "))
    return F.regexp_replace(plain, r"(?i)(?<=\S)( S[0-9]+(P[0-9]+)?( P[0-9]+)?)+$", "")


def split_camel(word: Column) -> Column:
    """`AttackOnTitan` as `Attack On Titan`; a single inner capital, as in McDonald, is left alone."""
    return F.when(F.regexp_count(word, F.lit(r"\p{Ll}\p{Lu}")) >= 2, F.regexp_replace(word, r"(\p{Ll})(?=\p{Lu})", "$1 ")).otherwise(word)


_SPELLED = "ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN"
_MARKER = "DISC|DISK|SEASON|VOL|VOLUME|SET|S"
#: Ends of a label that name a disc, season or volume, or only separate.
_TAIL = rf"(?i)(?:(?:^| )(?:(?:{_MARKER}) (?:[0-9]+|{_SPELLED})|{_MARKER}|(?:DISC|DISK|D|SEASON|VOL|VOLUME)[0-9]+|[-–—:]+))+$"


def query_from_label(label: Column) -> Column:
    """Words to search for: markers cut from the end, words in capitals lowered."""
    spaced = split_season_disc(F.translate(label, "_.", "  "))
    words = F.transform(F.split(spaced, " "), split_camel)
    kept = F.regexp_replace(F.array_join(words, " "), _TAIL, "")
    shout = lambda w: (F.length(w) > 1) & ~w.rlike(r"[\p{IsAlphabetic}&&[^A-Z]]")
    return F.trim(F.array_join(F.transform(F.split(kept, " "), lambda w: F.when(shout(w), F.lower(w)).otherwise(w)), " "))


def split_year(query: Column) -> tuple[Column, Column]:
    """(title, year) of `Title (1986)`, for years from 1880 to 2100; any other query is all title."""
    q = F.trim(query)
    year = F.nullif(F.regexp_extract(q, r"\(\s*([0-9]{4})\s*\)$", 1), F.lit("")).try_cast("int")
    year = F.when(year.between(1880, 2100), year)
    return F.when(year.isNotNull(), F.trim(F.regexp_replace(q, r"\([^()]*\)$", ""))).otherwise(q), year


def story_name(name: Column) -> Column:
    """The story that a numbered part belongs to: `Quest (2)`, or `Quest Part 2: More`."""
    t = F.rtrim(name)
    return F.when(t.rlike(r"\([0-9]+\)$"), F.rtrim(F.regexp_replace(t, r"\([0-9]+\)$", ""))).when(
        F.regexp_extract(t, r"^(.*?) Part ([0-9]*)", 2) != "", F.regexp_extract(t, r"^(.*?) Part [0-9]+", 1)
    )


def is_bonus(label: Column) -> Column:
    """Whether a word of the label says that the disc holds extras."""
    words = F.split(F.upper(label), "[^A-Z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("BONUS", "EXTRAS", "EXTRA", "SPECIAL", "SPECIALS", "FEATURES", "SUPPLEMENTS")]))


def is_placeholder(name: Column) -> Column:
    """`Episode 7`, a name that says nothing."""
    return name.rlike("^Episode .") & F.trim(F.substring(name, 9, 1000)).rlike("^[0-9]*$")


def title_name(file: Column) -> tuple[Column, Column]:
    """(label, index) of `Label_t07.mkv`; a blank label or another name gives nulls."""
    pattern = r"^(.*\S.*)_t([0-9]{1,9})\.mkv$"
    label = F.nullif(F.regexp_extract(file, pattern, 1), F.lit(""))
    return label, F.when(label.isNotNull(), F.regexp_extract(file, pattern, 2).try_cast("int"))
