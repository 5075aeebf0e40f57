"""Words, stems, trigrams and captions of transcripts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words shorter than this aren't tokens.
LEAST_TOKEN = 3
#: A transcript with fewer trigrams says nothing either way.
LEAST_PHRASES = 200
#: Words after a caption that may name an episode.
FOLLOWING = 16


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes, the short ones dropped, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}']+"), lambda w: F.length(w) >= LEAST_TOKEN)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def counted(words: Column) -> Column:
    """Array of struct(word, n) of the different words of an array, counted by the runs of the sorted array."""
    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda w, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != w), i)), lambda i: i.isNotNull())

        def made(es: Column) -> Column:  # bound, or each run would find all ends again
            return F.transform(es, lambda e, k: F.struct(F.get(s, e).alias("word"), (e - F.coalesce(F.when(k > 0, F.get(es, k - 1)), F.lit(-1))).cast("long").alias("n")))

        return F.element_at(F.transform(F.array(ends), made), 1)

    return F.element_at(F.transform(F.array(F.array_sort(words)), runs), 1)


def stem(word: Column) -> Column:
    """Drops a possessive, then the first of ing, ed, es and s that leaves four bytes or more, then a last e."""
    bare = F.regexp_replace(F.regexp_replace(word, "'s$", ""), "'+$", "")
    cut = bare
    for suffix in reversed(("ing", "ed", "es", "s")):
        fits = bare.endswith(suffix) & (F.octet_length(bare) > len(suffix) + 3)
        cut = F.when(fits, F.substr(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(cut)
    return F.when(cut.endswith("e") & (F.octet_length(cut) > 3), F.substr(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def phrase_words(text: Column) -> Column:
    """Words of a transcript: apostrophes vanish, whatever else isn't a letter or digit parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "['’]", ""), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def phrases(text: Column) -> Column:
    """Distinct word trigrams of a transcript; fewer than three words give none."""
    words = phrase_words(text)
    made = F.element_at(
        F.transform(
            F.array(words),
            lambda ws: F.when(F.size(ws) >= 3, F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.array_join(F.slice(ws, i, 3), " "))).otherwise(F.array().cast("array<string>")),
        ),
        1,
    )
    return F.array_distinct(made)


def caption_words(text: Column) -> Column:
    """Words as captions spell them: a bar is an i, apostrophes vanish, only ASCII letters are lowered."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.translate(F.regexp_replace(text, "['’]", ""), upper + "|", lower + "i"), r"[^\p{IsAlphabetic}\p{N}]+", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def cards(text: Column) -> Column:
    """Captions "episode N …" and "next episode …": array of struct(number, following, next), in order."""
    def found(ws: Column) -> Column:
        def at(i: Column) -> Column:
            number = F.when(F.get(ws, i + 1).rlike("^[0-9]{1,9}$"), F.get(ws, i + 1).cast("int"))
            start = i + 1 + F.when(number.isNotNull(), 1).otherwise(0)
            length = F.greatest(F.lit(0), F.least(F.lit(FOLLOWING), F.size(ws) - start))
            return F.struct(number.alias("number"), F.array_join(F.slice(ws, start + 1, length), " ").alias("following"), ((i > 0) & (F.get(ws, F.greatest(i - 1, F.lit(0))) == "next")).alias("next"))

        places = F.filter(F.when(F.size(ws) > 1, F.sequence(F.lit(0), F.size(ws) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.get(ws, i) == "episode")
        return F.filter(F.transform(places, at), lambda c: c["next"] | c["number"].isNotNull())

    return F.element_at(F.transform(F.array(caption_words(text)), found), 1)


def is_commentary(text: Column) -> Column:
    """Whether "commentary by" stands among the first 40 words."""
    return F.contains(F.concat(F.lit(" "), F.array_join(F.slice(caption_words(text), 1, 40), " "), F.lit(" ")), F.lit(" commentary by "))


def first_card(found: Column) -> Column:
    """The first caption of an episode's own, or else the first that announces the next."""
    return F.coalesce(F.get(F.filter(found, lambda c: ~c["next"]), 0), F.get(found, 0))


def dialogue_text(srt: Column) -> Column:
    """Spoken words of a subtitle file: no counters, timings, bracketed asides or music notes.

    Brackets nest within a line, and one that isn't closed swallows the rest of its line.
    """
    def spoken(line: Column) -> Column:
        chars = F.split(line, "")
        step = lambda s, c: F.struct(
            F.when(c.isin("[", "(", "<"), s["depth"] + 1).when(c.isin("]", ")", ">"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            F.when((s["depth"] == 0) & ~c.isin("[", "(", "<", "]", ")", ">", "♪", "♫", "#"), F.concat(s["kept"], c)).otherwise(s["kept"]).alias("kept"),
        )
        return F.trim(F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept")), step, lambda s: s["kept"]))

    lines = F.filter(F.transform(F.split(srt, r"\r\n|\r|\n"), F.trim), lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~x.contains("-->"))
    return F.array_join(F.filter(F.transform(lines, spoken), lambda x: x != ""), " ")


def clock_seconds(text: Column) -> Column:
    """`H:MM:SS`, `MM:SS` or `SS` in seconds; more parts or no number give 0."""
    parts = F.split(text, ":")
    sums = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when(F.size(parts) <= 3, sums).otherwise(F.lit(0).cast("long"))


def share(common: Column, a: Column, b: Column) -> Column:
    """Overlap of two sets as a share of the smaller; 0 if that is empty."""
    small = F.least(a, b)
    return F.when(small > 0, common / small).otherwise(F.lit(0.0))
