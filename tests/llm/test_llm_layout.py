"""Packing, sharding, archives, the pipeline and the registered queries."""

import itertools
import zlib

import numpy as np
import pytest

from reelsleuth.llm import packing as B
from reelsleuth.llm import queries
from reelsleuth.llm import sharding as S
from reelsleuth.llm import warc as W

SF = "/root/testdata/sf0.001"


def test_packing_is_sound_and_tight():
    rng = np.random.default_rng(0)
    for caps in ((64,), (16, 64, 128), (10, 1000)):
        lengths = np.minimum(rng.geometric(0.03, 800), max(caps)).astype(np.int64)
        bins, offsets, capacity = B.pack(lengths, caps, 4)
        for b in np.unique(bins):
            at = bins == b
            order = np.argsort(offsets[at])
            ends = offsets[at][order] + lengths[at][order]
            assert (offsets[at][order][1:] == ends[:-1]).all() and offsets[at].min() == 0
            cap = set(capacity[at])
            assert len(cap) == 1 and ends[-1] <= (c := cap.pop()) and all(k < ends[-1] for k in caps if k < c)
        assert lengths.sum() / sum(capacity[bins == b][0] for b in np.unique(bins)) > 0.93


def test_packing_is_near_the_best_on_small_sets():
    rng = np.random.default_rng(1)
    caps, over = (8, 16), 1
    for _ in range(40):
        lengths = rng.integers(1, 9, 6)
        _, _, capacity = B.pack(lengths, caps, over)
        bins = B.pack(lengths, caps, over)[0]
        ours = sum(capacity[bins == b][0] + over for b in np.unique(bins))
        best = ours
        for split in itertools.product(range(3), repeat=6):
            totals = [t for t in np.bincount(split, weights=lengths, minlength=3) if t]
            if max(totals) <= 16:
                best = min(best, sum(min(c for c in caps if c >= t) + over for t in totals))
        assert ours <= 1.5 * best


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (2, None, 2), (3, "", 3), (None, "x", 4), (4, "tok " * 10_000, 5), (5, "a b c", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("size", __import__("pyspark").sql.functions.lit("clash"))


def test_packing_of_odd_rows(odd):
    got = B.best_fit(odd).toPandas()
    assert got.groupby(got.doc_id.fillna(-1)).n_tokens.sum().to_dict() == {-1: 2, 1: 8, 2: 1, 3: 1, 4: 10_001, 5: 4}
    assert (got.n_tokens <= 4096).all() and got[got.doc_id == 4].piece.tolist().__len__() == 3 and B.best_fit(odd.limit(0)).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = np.zeros((500, 8), np.int64)
    sizes[:, 0] = rng.integers(1, 10_000, 500)
    bins = S.differencing(sizes, 8)[:, 0]
    sums = np.bincount(bins, weights=sizes[:, 0], minlength=8)
    greedy = np.zeros(8)
    for x in sorted(sizes[:, 0], reverse=True):
        greedy[greedy.argmin()] += x
    assert np.ptp(sums) <= np.ptp(greedy)
    two = np.zeros((5, 2), np.int64)
    two[:, 0] = [8, 7, 6, 5, 4]
    assert abs(np.bincount(S.differencing(two, 2)[:, 0], weights=two[:, 0]) @ [1, -1]) == 2  # the classic example
    assert S.differencing(np.zeros((0, 4), np.int64), 4).shape == (0, 4)


def check_shards(docs, got, shards):
    assert len(got) == len(docs) and (got.law == "bytes").all() and got.shard.between(0, shards - 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards_of_odd_rows(odd):
    docs, got = odd.toPandas(), S.shard_by_bytes(odd).toPandas()
    check_shards(docs, got, 40)
    same = got[got.text_crc32 == zlib.crc32(b"a b c")]
    assert len(same) == 3 and same.shard.nunique() == 1 and got[got.doc_id == 2]["size"].tolist() == [16]
    assert S.shard_by_bytes(odd.limit(0)).count() == 0


def test_shards_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = S.shard_by_bytes(docs, 5).toPandas()
    check_shards(docs.toPandas(), got, 5)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.01 * sums.mean()


def test_many_tasks_are_combined_by_levels(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPS_PER_TASK", 5)
    monkeypatch.setattr(S, "FAN", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = S.shard_by_bytes(docs, 5).toPandas()
    check_shards(docs.toPandas(), got, 5)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.05 * sums.mean()


# --- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline\n\nhttp://x 1.1.1.1 2 text/html 5\n", b"", b"\x00\xff" * 50, b"plain"]
    raw = W.arc_head("n.arc", version)
    for k, b in enumerate(bodies):
        raw += W.arc_record(version, f"http://h/a b{k}é", "1.2.3.4", "20240102030405", "text/html", b, "n.arc", len(raw))
    got = list(W.parse_arc(raw))
    assert [r.body for r in got] == bodies and got[0].url == "http://h/a%20b0é" and got[0].date == "20240102030405"
    assert [r.body for r in W.parse_arc(raw[:-3])] == bodies[:-1]  # a truncated body isn't a record
    assert list(W.parse_arc(b"")) == []


def test_dates():
    assert W.arc_date("20240102030405") == "2024-01-02T03:04:05Z" and W.arc_date("199901") == "1999-01-01T00:00:00Z" and W.arc_date("nonsense") == "2000-01-01T00:00:00Z" and W.arc_date("20249999999999") == "2000-01-01T00:00:00Z"


def test_converted_records_are_reproducible_and_read_back():
    record = W.ArcRecord("http://h/", "1.1.1.1", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody", 0)
    made = W.converted(record, None)
    assert made == W.converted(record, None)
    (headers, block), = W.parse_warc(made)
    assert headers["warc-type"] == "response" and block == record.body and headers["warc-payload-digest"] == f"sha1:{W.digest_of(b'body')}"
    (headers, block), = W.parse_warc(W.converted(record, ("<urn:x>", "http://f/", "2024-01-01T00:00:00Z")))
    assert headers["warc-type"] == "revisit" and headers["warc-refers-to"] == "<urn:x>" and block.endswith(b"\r\n\r\n") and b"body" not in block
    plain = W.ArcRecord("dns:h", "", "20240102030405", "text/dns", b"answer", 0)
    assert next(W.parse_warc(W.converted(plain, None)))[0]["warc-type"] == "resource"


def test_archives_of_odd_pages(spark):
    rows = [(5, "u 1", "same"), (3, None, "same"), (9, "x", None), (2, "y", ""), (None, "z", "same"), (5, "u 1", "same"), (7, "long", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", __import__("pyspark").sql.functions.lit(0))
    got = W.archive_pages(pages).collect()
    assert len(got) == len(rows) and all(r["sound"] for r in got)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([("5", "revisit", 3, 4), ("5", "revisit", 3, 4), ("3", "response", None, 4), ("9", "revisit", 2, 0), ("2", "response", None, 0), ("None", "revisit", 3, 4), ("7", "response", None, 600_000)])
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_small_payloads_can_stay_whole(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in W.archive_pages(pages, least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# --- queries and pipeline


#: What the queries' contracts name, and whether each row of the table has one row.
CONTRACTS = {
    "op1_decontamination": ("doc_id item_id", False), "op2_simhash": ("doc_id fingerprint component_id", True), "op3_licenses": ("doc_id license start end coverage", False),
    "op4_minhash": ("doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", True), "op5_toxicity": ("doc_id held_out score predicted", True),
    "op6_warc": ("page_id payload_bytes payload_digest record_type refers_to", True), "op7_pii": ("doc_id n_email n_ip n_card n_phone base_sha256 spans", True),
    "op8_packing": ("doc_id piece n_tokens pack bin capacity", False), "op9_quality": ("doc_id tokens perplexity keep", True), "op10_sharding": ("doc_id size text_crc32 law shard slot grown_shard", True),
}


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_query(spark, duck, key):
    columns, each = CONTRACTS[key]
    ours = queries.QUERIES[key](spark, SF).toPandas()
    assert set(columns.split()) <= set(ours.columns)
    source = duck.sql(f"SELECT * FROM {'pages' if key == 'op6_warc' else 'documents'}").df()
    own = "page_id" if key == "op6_warc" else "doc_id"
    if each:
        assert sorted(ours[own]) == sorted(source[own])
    else:
        assert len(ours) and set(ours[own]) <= set(source[own])
    if key in queries.ORACLES:
        from conftest import normal

        assert normal(ours) == normal(duck.sql(queries.ORACLES[key]).df())


def test_pipeline_against_brute_force(spark):
    """Each stage's rows against what its rule says of its input, by plain loops where they can."""
    import re

    import corpus_pipeline as C
    from reelsleuth.llm import decontaminate, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    frames = {"documents": docs}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert sorted(docs.columns) == sorted(columns), name
        frames[name] = docs
        kept[name] = docs.toPandas().set_index("doc_id").text.fillna("")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge(frames["documents"], labels).toPandas()
    assert set(kept["quality"].index) == set(judged[judged.keep].doc_id)
    # Near copies: no two left of 0.85 and more, and each text that went has one like it, or a copy, that stayed or went too.
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept["quality"].items() if (w := t.lower().split())}
    like = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85} for i in sets}
    stayed = set(kept["near_duplicates"].index)
    assert sum(bool(like[i] & stayed) for i in stayed if i in sets) <= 0.05 * len(stayed)
    loose = {i for i in sets if i not in stayed and not any(j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 for j in sets)}
    assert len(loose) <= 1
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontaminate.leaks(frames["near_duplicates"], benchmark).select("doc_id").collect()}
    assert set(kept["decontamination"].index) == stayed - leaking
    for i, t in kept["personal_data"].items():
        before = kept["decontamination"][i]
        assert not pii.base_spans(t) and len(re.findall(r"<(?:EMAIL|IP|CARD|PHONE)>", t)) >= bool(pii.base_spans(before))
    packed = C.STAGES[-1][1](spark, docs, SF).toPandas()
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in kept["personal_data"].items()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == tokens
    assert (packed.groupby(["pack", "bin"]).n_tokens.sum() <= packed.groupby(["pack", "bin"]).capacity.first()).all()
    assert C.run(spark, SF).count() == len(packed)


def test_odd_rows_pass_all_stages(spark):
    """Null ids and texts, repeated rows, extra columns with clashing names, and an empty table."""
    import corpus_pipeline as C

    rows = [(1, "one two three four five six seven", "en", "a", 33, "x"), (1, "one two three four five six seven", "en", "a", 33, "x"), (2, None, None, None, None, None), (3, "", "de", "b", 0, "y"), (None, "no id here at all", "en", "c", 17, "z"), (4, "mail a@b.co " + "long " * 30_000, "fr", "d", 150012, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").withColumnRenamed("key", "node")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in C.STAGES[:-1]:
            now = stage(spark, now, SF).cache()
            assert now.columns == docs.columns and now.count() <= len(rows), name
        assert C.STAGES[-1][1](spark, now, SF).count() >= now.count()


def test_many_small_members_inflate_quickly():
    import gzip
    import time

    parts = [bytes([k % 251]) * (k % 700) for k in range(5000)]
    raw = b"".join(gzip.compress(p, 6) for p in parts)
    began = time.process_time()
    assert W.inflate(raw) == b"".join(parts)
    assert time.process_time() - began < 0.3
    assert W.inflate(raw[:-3]) == b"".join(parts) and W.inflate(raw + b"\0\0") == b"".join(parts) and W.inflate(b"plain") == b"plain"


def test_offsets_of_version_2_name_their_records(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * k) for k in range(5)], "page_id long, url string, html string").repartition(2, "page_id")
    W.write_arc(pages, str(tmp_path)).collect()
    seen = 0
    for f in sorted(tmp_path.glob("*.arc.gz")):
        data = W.inflate(f.read_bytes())
        for r in W.parse_arc(data):
            line = data[r.offset : data.index(b"\n", r.offset)].decode().split(" ")
            if len(line) == 10:
                assert line[7] == str(r.offset)
                seen += 1
    assert seen
