"""Notes, paths, specifications and small files as text: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .naming import extra_kind, serial, url_encode

#: Sectors before this one hold volume descriptors; no file can lie there.
FIRST_FILE_SECTOR = 32
IMAGE_EXTENSIONS = ("iso", "bin", "cue")
#: Fixed value: the artist identifier that stands for various artists.
VARIOUS_ARTISTS = "89ad4ac3-39f7-470e-963a-56509c546377"


def glued_number(token: Column, words: list[str]) -> Column:
    """The number at the end of one of `words`, in any case: SEASON2 is 2. Null for other tokens."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.upper(token), f"^(?:{'|'.join(w.upper() for w in words)})([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("int")


def search_query(params: Column) -> Column:
    """A map of parameters as a query string: names in order, values in lower case and percent-encoded."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), url_encode(F.lower(e["value"])))), "&")


def hex_of(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def delta_note(minutes: Column) -> Column:
    """How far a runtime is off, in whole minutes, halves to even."""
    return F.when(minutes.isNull() | F.isnan(minutes.cast("double")), "no runtime published").otherwise(F.format_string("delta %s min", F.bround(minutes.cast("double"), 0).cast("long").cast("string")))


def film_folder(title: Column, year: Column) -> Column:
    return F.when(year.isNull(), title).otherwise(F.format_string("%s (%s)", title, year.cast("string")))


def feature_path(folder: Column, extension: Column) -> Column:
    return F.concat(F.lit("ready/movies/"), folder, F.lit("/"), folder, F.lit("."), extension)


def extra_path(folder: Column, category: Column, name: Column, extension: Column) -> Column:
    return F.concat(F.lit("ready/movies/"), folder, F.lit("/"), category, F.lit("/"), name, F.lit("."), extension)


def extra_spec(spec: Column) -> Column:
    """struct(title, category, name, error) of TITLE=Category/Name; the error says what is missing, the rest is null then."""
    title, rest = F.substring_index(spec, "=", 1), F.regexp_extract(spec, r"^[^=]*=(?s:(.*))$", 1)
    category, name = extra_kind(F.substring_index(rest, "/", 1)), F.trim(F.regexp_extract(rest, r"^[^/]*/(?s:(.*))$", 1))
    error = (
        F.when(~F.contains(spec, F.lit("=")), "expected TITLE=Category/Name").when(~F.contains(rest, F.lit("/")), "expected a category and a name")
        .when(category.isNull(), "not an extras folder").when((F.trim(title) == "") | (name == ""), "the title and the name must not be empty")
    )
    fine = error.isNull()
    return F.struct(F.when(fine, F.trim(title)).alias("title"), F.when(fine, category).alias("category"), F.when(fine, name).alias("name"), error.alias("error"))


def track_drop(spec: Column) -> Column:
    """struct(title, tracks, error) of TITLE=TRACK[,TRACK]; a leading raw/ of the title is dropped."""
    title = F.regexp_replace(F.trim(F.substring_index(spec, "=", 1)), "^(?:raw/)+", "")
    ids = F.transform(F.split(F.regexp_extract(spec, r"^[^=]*=(?s:(.*))$", 1), ","), lambda x: F.trim(x))
    error = (
        F.when(~F.contains(spec, F.lit("=")), "expected TITLE=TRACK").when(F.exists(ids, lambda x: ~F.rlike(x, F.lit(r"^\+?[0-9]+$"))), "tracks are numbers")
        .when(title == "", "expected TITLE=TRACK")
    )
    fine = error.isNull()
    return F.struct(F.when(fine, title).alias("title"), F.when(fine, F.transform(ids, lambda x: x.try_cast("int"))).alias("tracks"), error.alias("error"))


def game_serial(text: Column) -> Column:
    """struct(serial, platform) of a SYSTEM.CNF: the first line that names a boot file with a serial; BOOT2 is ps2, BOOT psx."""
    def one(line: Column) -> Column:
        key = F.upper(F.trim(F.substring_index(line, "=", 1)))
        value = F.trim(F.regexp_extract(line, r"=(.*)$", 1))
        raw = F.trim(F.substring_index(F.regexp_extract(value, r"([^\\/:]*)$", 1), ";", 1))
        platform = F.when(key == "BOOT2", "ps2").when(key == "BOOT", "psx")
        return F.struct(F.when(platform.isNotNull() & F.contains(line, F.lit("=")), serial(raw)).alias("serial"), platform.alias("platform"))

    return F.get(F.filter(F.transform(F.split(text, r"\r?\n"), one), lambda x: x["serial"].isNotNull()), 0)


def cue_line(line: Column, renames: Column) -> Column:
    """A FILE line with the name between its first and last quote renamed by a map; other lines and unknown names stay."""
    name = F.regexp_extract(line, r'^\s*FILE [^"]*"(.*)"[^"]*$', 1)
    new = F.try_element_at(renames, name)
    is_file = F.rlike(line, F.lit(r'^\s*FILE [^"]*".*"[^"]*$'))
    return F.when(is_file & new.isNotNull(), F.concat(F.regexp_extract(line, r'^(\s*FILE [^"]*").*"[^"]*$', 1), new, F.regexp_extract(line, r'("[^"]*)$', 1))).otherwise(line)


def retarget(cue: Column, renames: Column) -> Column:
    """A cue sheet with its files renamed, each line ended by CR LF; a last empty line is none."""
    lines = F.split(F.regexp_replace(cue, r"\r?\n\z", ""), r"\r?\n")
    return F.concat(F.array_join(F.transform(lines, lambda x: cue_line(x, renames)), "\r\n"), F.lit("\r\n"))


def shifted(sector: Column, shift: Column) -> Column:
    """A sector counted from another base; null where it would fall before the first that can hold a file."""
    return F.when(sector - shift >= FIRST_FILE_SECTOR, sector - shift)


def assigned_code(spec: Column) -> Column:
    """struct(title, season, episode) of TITLE=SxxEyy; null for other texts."""
    pattern = r"^([^=]+)=[Ss]([0-9]+)[Ee]([0-9]+)$"
    return F.when(F.rlike(spec, F.lit(pattern)), F.struct(F.trim(F.regexp_extract(spec, pattern, 1)).alias("title"), F.regexp_extract(spec, pattern, 2).cast("int").alias("season"), F.regexp_extract(spec, pattern, 3).cast("int").alias("episode")))


def is_image(path: Column) -> Column:
    return F.rlike(path, F.lit(rf"(?i)\.({'|'.join(IMAGE_EXTENSIONS)})$"))


def bin_number(path: Column) -> Column:
    """The number in "(Track NN)", the last of several; 0 without."""
    return F.coalesce(F.regexp_extract(path, r"^.*\(Track ([^)]*)", 1).try_cast("int"), F.lit(0))


def card_text(number: Column, is_next: Column) -> Column:
    """What a caption is, in words."""
    return F.when(number.isNull(), "preview of the next episode").when(is_next, F.concat(F.lit("preview of episode "), number.cast("string"))).otherwise(F.concat(F.lit("title card for episode "), number.cast("string")))


def tag_frames(release: Column, medium: Column, track: Column, encoder: str) -> Column:
    """Tag frames of a track in a fixed order as an array of struct(id, text); frames without a text are left out.

    `release` has title, artist, artist_sort, artist_id, date, genre, label, original, media; `medium` position, format, tracks;
    `track` title, artist, artist_sort, position, length_ms, isrc.
    """
    of = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    frames = [
        ("TIT2", track["title"]), ("TPE1", track["artist"]), ("TRCK", of(track["position"], medium["tracks"])), ("TALB", release["title"]), ("TPOS", of(medium["position"], release["media"])),
        ("TDRC", release["date"]), ("TCON", release["genre"]), ("TPE2", release["artist"]), ("TSO2", release["artist_sort"]), ("TSOP", track["artist_sort"]), ("TLEN", track["length_ms"].cast("string")),
        ("TPUB", release["label"]), ("TMED", medium["format"]), ("TDOR", release["original"]), ("TSRC", track["isrc"]), ("TCMP", F.when(is_compilation(release["artist_id"]), "1")), ("TSSE", F.lit(encoder)),
    ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("text")) for k, v in frames]), lambda f: f["text"].isNotNull())


def is_compilation(artist_id: Column) -> Column:
    return F.coalesce(artist_id == VARIOUS_ARTISTS, F.lit(False))
