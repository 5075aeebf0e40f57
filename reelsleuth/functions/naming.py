"""Names of files and folders, codes and small formats."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# Platforms as reference lists name them, and the folder of each.
PLATFORMS = {
    "sony - playstation": "psx", "sony - playstation 2": "ps2", "sony - playstation 3": "ps3", "sony - playstation portable": "psp", "nintendo - gamecube": "gc", "nintendo - wii": "wii",
    "nintendo - wii u": "wiiu", "microsoft - xbox": "xbox", "microsoft - xbox 360": "xbox360", "sega - dreamcast": "dreamcast", "sega - saturn": "saturn", "sega - mega cd & sega cd": "segacd",
    "sega - mega-cd & sega cd": "segacd", "nec - pc engine cd & turbografx cd": "pcenginecd", "panasonic - 3do interactive multiplayer": "3do", "philips - cd-i": "cdimono1",
    "commodore - amiga cd32": "amigacd32", "commodore - amiga cd": "amigacd", "atari - jaguar cd interactive multimedia system": "atarijaguarcd", "snk - neo geo cd": "neogeocd",
    "bandai - playdia quick interactive system": "playdia", "fujitsu - fm towns series": "fmtowns", "vtech - v.flash & v.smile pro": "vsmile",
}
# Profile codes of drives, and the family of each.
PROFILES = {8: "CD-ROM", 9: "CD-R", 10: "CD-RW", 16: "DVD-ROM", 17: "DVD-R", 18: "DVD-RAM", 19: "DVD-RW", 20: "DVD-RW", 26: "DVD+RW", 27: "DVD+R", 43: "DVD+R DL", 64: "BD-ROM", 65: "BD-R", 66: "BD-R", 67: "BD-RE"}
# Kinds of extras, and the spellings of each.
EXTRAS = {
    "behindthescenes": "Behind The Scenes", "bts": "Behind The Scenes", "deletedscenes": "Deleted Scenes", "deletedscene": "Deleted Scenes", "deleted": "Deleted Scenes", "featurettes": "Featurettes",
    "featurette": "Featurettes", "interviews": "Interviews", "interview": "Interviews", "scenes": "Scenes", "scene": "Scenes", "shorts": "Shorts", "short": "Shorts", "trailers": "Trailers", "trailer": "Trailers",
    "other": "Other", "extra": "Other", "extras": "Other",
}


def platform_slug(platform: Column) -> Column:
    return F.try_element_at(_map(PLATFORMS), F.lower(F.trim(platform)))


def disc_profile(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PROFILES), code.cast("int")), F.lit("unknown"))


def disc_family(profile: Column) -> Column:
    return F.when(profile.startswith("CD"), "CD").when(profile.startswith("DVD"), "DVD").when(profile.startswith("BD"), "Blu-ray").otherwise("unknown")


def extra_kind(name: Column) -> Column:
    return F.try_element_at(_map(EXTRAS), F.lower(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", "")))


def episode_code(season: Column, number: Column, through: Column | None = None) -> Column:
    """`S01E04`, or `S01E04-E05`."""
    one = F.format_string("S%02dE%02d", season.cast("int"), number.cast("int"))
    return one if through is None else F.when(through.isNull(), one).otherwise(F.concat(one, F.format_string("-E%02d", through.cast("int"))))


def title_case(text: Column) -> Column:
    """The first letter of each word raised, the others left."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000))), " ")


def unsort(name: Column) -> Column:
    """`Last, First` as `First Last`."""
    return F.regexp_replace(name, "^(.*?), (.*)$", "$2 $1")


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def url_encode(text: Column) -> Column:
    """Percent-encoding of all bytes but letters, digits and -_.~ ; a blank is %20."""
    made = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        made = F.replace(made, F.lit(a), F.lit(b))
    return made


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, single dashes between, 48 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)


def stamp(seconds: Column) -> Column:
    """Seconds since 1970 as YYYYmmdd-HHMMSS in UTC, years beyond 9999 in full; whatever the session's time zone."""
    rest = F.pmod(seconds, F.lit(86400).cast("long"))
    day = F.date_from_unix_date(((seconds - rest) / 86400).cast("int"))
    year = F.year(day)
    years = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(years, two(F.month(day)), two(F.day(day)), F.lit("-"), two(F.floor(rest / 3600)), two(F.floor(rest % 3600 / 60)), two(rest % 60))


def hms(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long"))


def sanitise(name: Column) -> Column:
    """Slashes become dashes, other characters that file systems refuse blanks, and blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(name, "/\\", "--"), r'[:*?"<>|]', " "), r"\s+", " "))


def picard_safe(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|\p{Cntrl}]', "_")


def picard_folder(name: Column) -> Column:
    """picard_safe(), and a folder doesn't end with a dot."""
    return F.regexp_replace(picard_safe(F.trim(name)), r"\.$", "_")


def album_folder(artist: Column, year: Column, title: Column) -> Column:
    return picard_folder(F.concat_ws(" - ", artist, year, title))


def track_file(disc: Column, number: Column, artist: Column, title: Column) -> Column:
    return picard_safe(F.concat(F.format_string("%d-%02d", disc.cast("int"), number.cast("int")), F.lit(" - "), artist, F.lit(" - "), title, F.lit(".mp3")))


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if any were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def category_of(path: Column) -> Column:
    """The folder below ready/, or nothing."""
    rest = F.regexp_replace(path, "^ready/", "")
    return F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(rest)


def destination_path(root: Column, path: Column) -> Column:
    """Below the destination, without ready/ and the category."""
    return F.concat(root, F.lit("/"), F.regexp_replace(F.regexp_replace(path, "^ready/", ""), "^[^/]*/", ""))


def human_size(size: Column) -> Column:
    return F.when(size >= 1_000_000_000, F.format_string("%.2f GB", size / 1e9)).otherwise(F.format_string("%.0f MB", size / 1e6))


def serial(raw: Column) -> Column:
    """`SLUS_203.12` as `SLUS-20312`: three letters or more, an underscore, then four digits or more."""
    clean = F.regexp_replace(raw, "[^A-Za-z0-9_.]", "")
    digits = F.regexp_replace(F.regexp_replace(clean, "^[^_]*_", ""), "[^0-9]", "")
    return F.when(clean.rlike("^[A-Za-z]{3,}_") & (F.length(digits) >= 4), F.concat_ws("-", F.upper(F.substring_index(clean, "_", 1)), digits))


def synchsafe(n: Column) -> Column:
    """A number of 28 bits as four bytes of seven, in hexadecimal digits."""
    part = lambda k: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))), 2, "0")
    return F.concat(part(3), part(2), part(1), part(0))


def data_index(name: Column) -> Column:
    """7 of `Data0007`."""
    return F.nullif(F.regexp_extract(name, "^[Dd]ata([0-9]{4})$", 1), F.lit("")).try_cast("int")


#: Data blocks under one hash block, blocks of a file, and bytes of a block: fixed values of the package format.
GROUP, PER_FILE, BLOCK = 204, 204 * 203, 4096


def block_location(index: Column) -> tuple[Column, Column]:
    """(file, byte offset) of a data block: a file begins with a master hash block, a group with its own."""
    within = index % PER_FILE
    group = F.floor(within / GROUP)
    return F.floor(index / PER_FILE).cast("long"), ((2 + group * (GROUP + 1) + within % GROUP) * BLOCK).cast("long")


def tail_blocks(total: Column) -> Column:
    """Data blocks of a short last file of so many blocks."""
    rest = F.greatest(total - 1, F.lit(0))
    return (F.floor(rest / (GROUP + 1)) * GROUP + F.greatest(rest % (GROUP + 1) - 1, F.lit(0))).cast("long")
