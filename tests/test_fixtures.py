"""Scalar functions against the results that they must have."""

from __future__ import annotations

import pytest
from conftest import normal
from pyspark.sql import functions as F

from reelsleuth.functions import labels as L
from reelsleuth.functions import naming as N
from reelsleuth.functions import text as X

c = F.col
FIXTURES = {}


def fixture(key, schema, rows, results, made):
    """The first columns of `rows` go in, the last are what `made` columns must give."""
    FIXTURES[key] = (schema, rows, results, made)


fixture(
    "F03_label_parsers", "label string",
    [
        ("ESPN_30_FOR_30_DISC_1", None, 1, None, "espn 30 for 30"), ("THE_WIRE_S01_D3", 1, 3, None, "the wire s01"), ("FRIENDS_S05_DISC_3", 5, 3, None, "friends s05"), ("KPOP DEMON HUNTERS - DISC ONE", None, None, None, "kpop demon hunters"),
        ("MMPR_S3D1", 3, 1, None, "mmpr s3"), ("AttackOnTitan Season2 D1", 2, 1, None, "Attack On Titan"), ("FRIEREN S1P2 D1", 1, 1, 2, "frieren s1p2"), ("AttackOnTitan_S3_P1_D1", 3, 1, 1, "Attack On Titan s3 p1"), ("WONDER_WOMAN_3", None, None, None, "wonder woman 3"),
        ("ROCKY_II", None, None, None, "rocky ii"), ("STAR_WARS_P1_D1", None, 1, None, "star wars p1"), ("DISC_1", None, 1, None, ""), ("", None, None, None, ""), ("McDonald Series 4 Disk 12", 4, 12, None, "McDonald Series 4"),
    ],
    ["season", "disc", "part", "search"], lambda: dict(season=L.season_number(c("label")), disc=L.disc_number(c("label")), part=L.part_number(c("label")), search=L.query_from_label(c("label"))),
)
fixture("F07_camel_case", "word string", [("AttackOnTitan", "Attack On Titan"), ("McDonald", "McDonald"), ("plain", "plain"), ("aBcD", "a Bc D")], ["parted"], lambda: dict(parted=L.split_camel(c("word"))))
fixture("F11_search_terms", "query string", [("friends s05", "friends"), ("frieren s1p2", "frieren"), ("Attack On Titan s3 p1", "Attack On Titan"), ("s05", "s05"), ("mmpr s3", "mmpr"), ("star wars p1", "star wars p1")], ["terms"], lambda: dict(terms=L.search_terms(c("query"))))
fixture("F14_split_year", "query string", [("The Fly (1986)", "The Fly", 1986), ("The Fly", "The Fly", None), ("1984", "1984", None), ("Odd (1700)", "Odd (1700)", None), (" Twice (1) (2001) ", "Twice (1)", 2001)], ["title", "year"], lambda: dict(title=L.split_year(c("query"))[0], year=L.split_year(c("query"))[1]))
fixture("F15_story_name", "name string", [("Ninja Quest (2)", "Ninja Quest"), ("Green with Evil Part 2: Battle", "Green with Evil"), ("Alone", None), ("Part of It", None), ("One (two)", None)], ["story"], lambda: dict(story=L.story_name(c("name"))))
fixture("P10_bonus_label", "label string", [("MMPR_BONUS_D1", True), ("BONUSES_GALORE", False), ("Show Special Features", True), ("", False)], ["bonus"], lambda: dict(bonus=L.is_bonus(c("label"))))
fixture("P11_placeholder_name", "name string", [("Episode 7", True), ("Episode 7b", False), ("Episode", False), ("Episode  12 ", True), ("The Episode 4", False)], ["placeholder"], lambda: dict(placeholder=L.is_placeholder(c("name"))))
fixture("S80_title_name", "file string", [("Friends Season 6 Disc 1_t04.mkv", "Friends Season 6 Disc 1", 4), ("Disc_tx.mkv", None, None), ("_t03.mkv", None, None), ("A_t01_t12.mkv", "A_t01", 12), ("A_t01.m2ts", None, None)], ["label", "ix"], lambda: dict(label=L.title_name(c("file"))[0], ix=L.title_name(c("file"))[1]))
fixture("F16_title_case", "text string", [("new wave", "New Wave"), ("r&b soul", "R&b Soul"), ("McX", "McX"), ("", "")], ["cased"], lambda: dict(cased=N.title_case(c("text"))))
fixture("F18_unsort", "name string", [("Beatles, The", "The Beatles"), ("Prince", "Prince"), ("A, B, C", "B, C A")], ["plain"], lambda: dict(plain=N.unsort(c("name"))))
fixture("F23_slug", "text string", [("The Wire: Season 1!", "the-wire-season-1"), ("--", ""), ("Ünder Wäter", "nder-w-ter"), ("a" * 60, "a" * 48)], ["slug"], lambda: dict(slug=N.slug(c("text"))))
fixture("F28_safe_names", "name string", [("AC/DC: Live?", "AC-DC Live", "AC_DC_ Live_", "AC_DC_ Live_"), ("a  b.", "a b.", "a  b.", "a  b_"), ('x|y"z', "x y z", "x_y_z", "x_y_z")], ["plain", "safe", "folder"], lambda: dict(plain=N.sanitise(c("name")), safe=N.picard_safe(c("name")), folder=N.picard_folder(c("name"))))
fixture("F31_album_folder", "artist string, year string, title string", [("A", "1999", "T", "A - 1999 - T"), ("A", None, "T.", "A - T_")], ["folder"], lambda: dict(folder=N.album_folder(c("artist"), c("year"), c("title"))))
fixture("F32_track_file", "disc int, number int, artist string, title string", [(1, 2, "A", "T", "1-02 - A - T.mp3"), (2, 11, "A/B", "What?", "2-11 - A_B - What_.mp3")], ["file"], lambda: dict(file=N.track_file(c("disc"), c("number"), c("artist"), c("title"))))
fixture("F33_truncate", "text string", [("abcdef", "abc…"), ("abcd", "abcd"), ("", "")], ["short"], lambda: dict(short=N.truncated(c("text"), 4)))
fixture("F35_destination_path", "path string", [("ready/games/ps2/T.iso", "games", "/mnt/T/ps2/T.iso"), ("movies/A/B.mkv", "movies", "/mnt/T/A/B.mkv"), ("loose.bin", "loose.bin", "/mnt/T/loose.bin")], ["category", "target"], lambda: dict(category=N.category_of(c("path")), target=N.destination_path(F.lit("/mnt/T"), c("path"))))
fixture("F37_human_size", "size long", [(4116250624, "4.12 GB"), (999999999, "1000 MB"), (0, "0 MB"), (2048, "0 MB")], ["text"], lambda: dict(text=N.human_size(c("size"))))
fixture("F42_serial", "raw string", [("SLUS_203.12", "SLUS-20312"), ("scus_941.63;1", "SCUS-941631"), ("AB_1234", None), ("SLUS-20312", None), ("SLES_1.2", None)], ["serial"], lambda: dict(serial=N.serial(c("raw"))))
fixture("F50_data_index", "name string", [("Data0007", 7), ("data0123", 123), ("Data007", None), ("Data00x7", None), ("DATA0007", None)], ["ix"], lambda: dict(ix=N.data_index(c("name"))))
fixture("F51_block_location", "block long", [(0, 0, 8192), (203, 0, 839680), (204, 0, 847872), (41411, 0, 170455040), (41412, 1, 8192)], ["file", "place"], lambda: dict(file=N.block_location(c("block"))[0], place=N.block_location(c("block"))[1]))
fixture("F52_tail_blocks", "total long", [(0, 0), (1, 0), (2, 0), (3, 1), (206, 204), (207, 204), (208, 205)], ["data"], lambda: dict(data=N.tail_blocks(c("total"))))
fixture("F57_synchsafe", "n int", [(0, "00000000"), (127, "0000007F"), (128, "00000100"), (257, "00000201")], ["hex"], lambda: dict(hex=N.synchsafe(c("n"))))
fixture("S37_clock_seconds", "text string", [("1:02:03", 3723), ("45:10", 2710), ("59", 59), ("1:2:3:4", 0), ("x:10", 10)], ["seconds"], lambda: dict(seconds=X.clock_seconds(c("text"))))


@pytest.mark.parametrize("key", sorted(FIXTURES))
def test_fixture(spark, key):
    schema, rows, results, made = FIXTURES[key]
    columns = [x.split()[0] for x in schema.split(", ")]
    frame = spark.createDataFrame([r[: len(columns)] for r in rows], schema)
    got = frame.select(*columns, *[made()[r].alias(r) for r in results]).toPandas()
    import pandas as pd

    assert normal(got) == normal(pd.DataFrame(rows, columns=[*columns, *results], dtype=object))
