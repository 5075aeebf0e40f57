"""Sources over small files and captured answers."""

import json
import struct

import pytest

from pyspark.sql import functions as F

from reelsleuth.functions import text as X
from reelsleuth.operators import digest as D
from reelsleuth.operators import discids
from reelsleuth.sources import binaries, catalogues, config, datfiles, manifests
from reelsleuth.sources import text_formats as T

DAT = """<?xml version="1.0"?>
<datafile><header><name>Sony - PlayStation 2</name><version>2026-06-15</version></header>
<game name="One &amp; Only"><category>Games</category><rom name="One.iso" size="4116250624" crc="7723AB98" md5="2BE0D4A7730FDFF8D4EB2F95AC7A7BC8" sha1="f6a63934521febb2e0c83d78510dfe8e78bbf214"/></game>
<game name="Two"><rom name="Two.cue" size="x" crc="" md5="m1" sha1="s1"/><rom name="Two (Track 1).bin" size="2352" crc="c2" md5="m2" sha1="s2"/></game></datafile>"""


def test_datfiles(spark, tmp_path):
    (tmp_path / "a.dat").write_text(DAT)
    (tmp_path / "b.dat").write_text(DAT.replace("Sony - PlayStation 2", "Sony - PlayStation"))
    (tmp_path / "c.dat").write_text(DAT.replace("<name>Sony - PlayStation 2</name>", ""))
    (tmp_path / "note.txt").write_text("no list")
    rows = datfiles.read_datfiles(spark, str(tmp_path))
    got = rows.collect()
    assert len(got) == 6 and {r["platform"] for r in got} == {"Sony - PlayStation 2", "Sony - PlayStation"}
    one = next(r for r in got if r["rom"] == "One.iso")
    assert one["game"] == "One & Only" and one["crc32"] == "7723ab98" and one["size"] == 4116250624
    assert next(r for r in got if r["rom"] == "Two.cue")["size"] == 0 and next(r for r in got if r["rom"] == "Two.cue")["crc32"] is None
    files = spark.createDataFrame([(1, " S2 ", None, None), (2, None, "M1", "c2"), (3, "zz", "", "C2"), (4, None, None, None)], "f int, sha1 string, md5 string, crc32 string")
    found = D.lookup(files, rows, ["file", "game_ix", "rom_ix"], ["rom", "platform"]).orderBy("f").collect()
    assert [r["matched_on"] for r in found] == ["sha1", "md5", "crc32", None]
    assert [r["rom"] for r in found] == ["Two (Track 1).bin", "Two.cue", "Two (Track 1).bin", None] and found[0]["platform"] == "Sony - PlayStation 2"
    assert [r["confidence"] for r in found] == [3, 3, 3, 0]


def test_manifests(spark, tmp_path):
    job = {"id": "j1", "created_at": 1, "stage": "ripped", "selected_titles": [0], "titles": [{"index": 0, "estimated_bytes": 7}, {"index": 1, "estimated_bytes": 9}], "artifacts": [{"relative_path": "a.iso", "bytes": 5, "sha256": "x"}, {"relative_path": "b.iso", "bytes": 6, "sha256": "y"}]}
    for name, text in (("j1", json.dumps(job)), ("j2", "{broken"), ("j3", json.dumps({"stage": "ripped"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    jobs = manifests.read_jobs(spark, str(tmp_path)).cache()
    assert [tuple(r) for r in manifests.listing(jobs).collect()] == [("j1", "ripped", 2, 11, 7)]
    assert sorted(r["why"] for r in manifests.unreadable(jobs).collect()) == ["malformed", "no id"]
    moved = manifests.mark_filed(manifests.mark_filed(manifests.readable(jobs), "a.iso"), "a.iso").first()
    assert moved["reclaimed"] == ["a.iso"] and [a["relative_path"] for a in moved["artifacts"]] == ["b.iso"]
    manifests.save_snapshot(manifests.readable(jobs), str(tmp_path / "snapshot"))
    assert spark.read.json(str(tmp_path / "snapshot")).count() == 1


def answer(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "value string")


def test_catalogues(spark):
    tv = catalogues.tv_results(answer(spark, {"results": [{"id": 1, "name": "A", "first_air_date": ""}, {"name": "no id"}]})).collect()
    assert len(tv) == 1 and tv[0]["first_air_date"] is None
    films = catalogues.movie_results(answer(spark, {"results": [{"id": 1, "title": "A", "runtime": 0}, {"id": 2, "title": "B", "runtime": 90}]})).collect()
    assert [f["runtime_mins"] for f in films] == [None, 90]
    eps = catalogues.episodes(answer(spark, {"episodes": [{"episode_number": 1, "runtime": 0, "overview": " "}, {"name": "lost"}, {"episode_number": 2, "season_number": 4, "name": "N", "overview": "o"}]}), 3).collect()
    assert [(e["season"], e["number"], e["name"], e["runtime_mins"], e["overview"]) for e in eps] == [(3, 1, "", 0, None), (4, 2, "N", None, "o")]
    release = {
        "id": "r", "title": "T", "date": "1999-02-01", "status": "Official", "artist-credit": [{"name": "A", "joinphrase": " & "}, {"name": "B"}], "genres": [{"name": "new wave", "count": 2}, {"name": "rock", "count": 2}],
        "label-info": [{"catalog-number": "C1", "label": {"name": "L"}}], "release-group": {"id": "g", "primary-type": "Album"},
        "media": [{"position": 1, "discs": [{"id": "d1"}], "tracks": [{"id": "t", "position": 1, "title": "x", "recording": {"length": 1000, "isrcs": ["I"], "artist-credit": [{"name": "A"}]}}]}, {"position": 2, "discs": [], "tracks": [{"id": "u", "position": 1, "title": "y", "length": 5000}]}],
    }
    found = catalogues.releases(answer(spark, {"releases": [release, {"id": "", "title": "none"}]})).cache()
    r = found.collect()
    assert len(r) == 1 and (r[0]["artist"], r[0]["year"], r[0]["status"], r[0]["genre"], r[0]["label"]) == ("A & B", "1999", "official", "New Wave", "L")
    media = catalogues.media(found).cache()
    first = media.orderBy("position").first()
    assert first["tracks"][0]["length_ms"] == 1000 and first["tracks"][0]["isrc"] == "I"
    assert catalogues.medium_for_disc(media, "d1").first()["position"] == 1
    assert catalogues.medium_by_lengths(media, [4990], 20).first()["position"] == 2
    assert catalogues.medium_by_lengths(media, [3000], 5000).count() == 0  # both fit, so neither
    subs = {"data": [{"attributes": {"download_count": n, "from_trusted": t, "files": [{"file_id": i}] * k, "feature_details": {"season_number": 1, "episode_number": 1}}} for i, (n, t, k) in enumerate([(5, False, 1), (1, True, 1), (9, True, 2), (1, True, 1)])]}
    files = catalogues.subtitle_files(answer(spark, subs))
    assert files.count() == 3 and catalogues.best_subtitle(files).first()["file_id"] == 3
    probe = {"format": {"duration": "61.5", "size": "9"}, "chapters": [{}], "streams": [{"codec_type": "video", "width": 720, "height": 480, "display_aspect_ratio": "853:480"}, {"codec_type": "audio"}, {"codec_type": "audio"}]}
    m = catalogues.media_features(answer(spark, probe)).first()
    assert m["duration_secs"] == 61.5 and m["audio"] == 2 and abs(m["display_aspect"] - 853 / 480) < 1e-9 and m["chapters"] == 1
    tracks = catalogues.container_tracks(answer(spark, {"tracks": [{"id": 0, "type": "video", "codec": "h"}, {"id": 1, "type": "audio", "properties": {"language": "en"}}, {"id": 2, "type": "buttons"}, {"type": "audio"}]}))
    assert [(t["kind"], t["language"]) for t in tracks.orderBy("id").collect()] == [("video", ""), ("audio", "en"), ("other", "")]


def test_english_names(spark):
    rows = [(("椎名林檎", "Shiina, Ringo", [("Sheena Ringo", "en", True), ("R", "en", False)]), "椎名林檎"), (("椎名", "Shiina, Ringo", None), "椎名"), (("Prince", "Prince", None), "Prince")]
    df = spark.createDataFrame(rows, "artist struct<name: string, `sort-name`: string, aliases: array<struct<name: string, locale: string, primary: boolean>>>, credited string")
    assert [r[0] for r in df.select(catalogues.english_name(F.col("artist"), F.col("credited"))).collect()] == ["Sheena Ringo", "Ringo Shiina", "Prince"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(b"one\rtwo\r\n\nkey: a\nkey: b\n")
    lines = T.output_lines(spark, str(tmp_path / "log.txt"))
    assert [r["value"] for r in lines.orderBy("line_no").collect()] == ["one", "two", "key: a", "key: b"]
    assert [(r["key"], r["value"]) for r in T.metadata(lines).collect()] == [("key", "b")]
    made = spark.createDataFrame([(0, "[ 42%] LBA: 100/2000, errors: { SCSI: 1, C2: 2, Q: 3 }"), (1, '<rom name="a.bin" size="10" crc="AB" md5="CD" sha1="EF" />')], "line_no int, value string")
    p = T.progress(made).first()
    assert (p["percent"], p["lba"], p["last_lba"], p["c2"]) == (42, 100, 2000, 2)
    h = T.rom_hashes(made).first()
    assert (h["name"], h["size"], h["crc32"], h["sha1"]) == ("a.bin", 10, "ab", "ef")
    s = T.streams(spark.createDataFrame([(1, "dvd_subtitle,1\ndvd_subtitle,0"), (2, "dvd_subtitle,0\nsubrip,0")], "f int, csv string"), "f", "csv")
    assert {r["f"]: r["pos"] for r in T.chosen_stream(s, "f").collect()} == {1: 1, 2: 1}


def test_binaries(spark, tmp_path):
    raw = bytearray(0x2000)
    raw[:4] = b"CON "
    struct.pack_into(">I", raw, 0x344, 0x4000)
    struct.pack_into(">I", raw, 0x360, 0x545407E0)
    struct.pack_into(">I", raw, 0x354, 0x1ABA0DD5)
    raw[0x411 : 0x411 + 8] = "Prey".encode("utf-16-be")
    raw[0x379 + 0x19 : 0x379 + 0x1C] = bytes([0x10, 0xFB, 0xCC])
    (tmp_path / "p").write_bytes(bytes(raw))
    (tmp_path / "q").write_bytes(b"CON short")
    row = binaries.packages(binaries.read_files(spark, str(tmp_path))).collect()
    assert len(row) == 1 and (row[0]["kind"], row[0]["title_id"], row[0]["media_id"], row[0]["display_name"], row[0]["blocks"]) == ("Games on Demand", "545407E0", "1ABA0DD5", "Prey", 0x10FBCC)
    (tmp_path / "d").mkdir()
    body = struct.pack("<BIII", 1, 5, 6, 7) + struct.pack("<BII", 9, 0xFFFFFFFF, 0)
    (tmp_path / "d" / "x.bin").write_bytes(body * 2 + body[:15])
    got = binaries.pressings(binaries.read_files(spark, str(tmp_path / "d"))).collect()
    assert [(g["block"], g["confidence"], g["crc"]) for g in got] == [(0, 9, 4294967295), (1, 9, 4294967295)]
    assert binaries.images(binaries.read_files(spark, str(tmp_path / "d"))).count() == 1


def test_config():
    text = '[staging]\nroot = "/s"\n[[destination]]\nname = "a"\nroot = "smb://x"\nmedia = ["games"]\n[[destination]]\nname = "a"\nroot = "/m"\n[video]\nlanguages = ["en"]\n[video.keep_languages]\n"Amélie" = ["fr", "en"]\n[api]\ntmdb_token = "t"\n'
    c = config.load(text, {"REELSLEUTH_TMDB_TOKEN": "env"})
    assert c.api["tmdb_token"] == "env" and c.redacted().api["tmdb_token"] == "(set)"
    assert c.languages_for("AMÉLIE (2001)") == ["en", "fr"] and c.languages_for("Other") == ["en"]
    assert {level for _, level, _ in config.check(c)} == {"ok", "error"} and c.destinations[1].accepts("music") and not c.destinations[0].accepts("music")


def test_known_disc_identifiers(spark):
    offsets = [150, 15363, 32314, 46592, 63414, 80489]
    rows = [("d", i + 1, o - 150, 95462 - 150) for i, o in enumerate(offsets)]
    tracks = spark.createDataFrame(rows, "disc string, number long, start long, leadout long")
    assert discids.musicbrainz_id(tracks, "disc", "number", "start", "leadout").first()["musicbrainz"] == "49HHV7Eb8UKF3aQiNmu1GR8vKTY-"
    three = spark.createDataFrame([("e", i + 1, s, 50000) for i, s in enumerate([150, 16174, 34719])], "disc string, number long, start long, leadout long")
    assert discids.freedb_id(three, "disc", "start", "leadout").first()["freedb"].endswith("03")


def test_known_checksums(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 1, 0), ("b", 2, 0xFFFFFFFF)]
    df = spark.createDataFrame(rows, "track string, pos long, sample long")
    got = {r["track"]: (r["v1"], r["v2"]) for r in discids.checksums(df, ["track"], "pos", "sample", F.lit(False), F.lit(False)).collect()}
    assert got == {"a": (5, 5), "b": (0xFFFFFFFE, 0xFFFFFFFF)}


def test_known_digests(spark):
    d = D.digests(F.col("v"))
    row = spark.createDataFrame([("123456789",), ("abc",)], "v string").select("v", *[d[k].alias(k) for k in d]).collect()
    assert row[0]["crc32"] == "cbf43926" and row[1]["md5"] == "900150983cd24fb0d6963f7d28e17f72" and row[1]["sha256"].startswith("ba7816bf")


def test_transcripts_agree_across_spelling(spark):
    df = spark.createDataFrame([("I DON'T THINK ZEDD'S DONE WITH US, GUYS.", "I don’t think Zedd's done with us, guys!")], "a string, b string")
    row = df.select(X.phrases(F.col("a")).alias("a"), X.phrases(F.col("b")).alias("b")).first()
    assert sorted(row["a"]) == sorted(row["b"]) and len(row["a"]) == 6


def test_references_follow_the_numbering(spark):
    from reelsleuth.operators import seasons as S

    episodes = spark.createDataFrame([(1, 0, [1]), (1, 1, [2, 3]), (1, 2, [4])], "season int, pos int, numbers array<int>")
    found = S.mapped_references(episodes, spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b", "c"]), (1, 3, ["c", "d"])], "season int, number int, phrases array<string>"), "season")
    got = {r["pos"]: (sorted(r["phrases"]) if r["phrases"] else None, r["halves"]) for r in found.collect()}
    assert got == {0: (["a"], False), 1: (["b", "c", "d"], True), 2: (None, False)}


def test_ties_are_broken_by_cards_then_dialogue_then_disc_number(spark):
    from reelsleuth.operators import seasons as S

    means = spark.createDataFrame([(d, s, s + 1, 1.0 if d < 9 else float(s), 2) for d in (1, 2, 3, 4, 9) for s in range(4)], "disc int, start int, number int, mean double, k int")
    votes = spark.createDataFrame([(1, 0, 1, 1), (1, 2, 2, 0), (2, 1, 1, 0), (2, 2, 1, 1)], "disc int, start int, agree int, disagree int")
    speech = spark.createDataFrame([(1, 1, 0.9), (2, 3, 0.9), (2, 1, 0.5), (3, 1, 0.51), (3, 2, 0.50), (4, 0, 0.2)], "disc int, start int, score double")
    hints = spark.createDataFrame([(3, 2), (9, 2)], "disc int, hint int")
    got = {r["disc"]: (r["start"], r["decided_by"], r["tied"]) for r in S.choose_window(means, votes, speech, hints, "disc").collect()}
    # Disc 2: as many cards agree with a window that another contradicts. Disc 3: dialogue leads by too little. Disc 4: alone.
    assert got == {1: (2, "cards", 4), 2: (3, "dialogue", 4), 3: (2, "disc number", 4), 4: (0, "dialogue", 4), 9: (0, "runtime", 1)}


def test_one_item_is_selected(spark):
    from reelsleuth.operators import episodes as E

    items = spark.createDataFrame([("A1", "The Game"), ("B2", "Game Two"), ("C3", "a1 demo")], "id string, name string")
    assert [r["id"] for r in E.select_one(items, "a1", "id", "name").collect()] == ["A1"] and [r["id"] for r in E.select_one(items, "two", "id", "name").collect()] == ["B2"]
    for needle, said in (("game", "several"), ("zzz", "nothing")):
        with pytest.raises(LookupError, match=said):
            E.select_one(items, needle, "id", "name")
