"""Decontamination, licenses, MinHash, toxicity, personal data and quality: brute force, held-out rows, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from reelsleuth.llm import decontaminate as C
from reelsleuth.llm import licenses as L
from reelsleuth.llm import minhash as M
from reelsleuth.llm import pii as P
from reelsleuth.llm import quality as Q
from reelsleuth.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=4000):
    return ["w" + "".join(chr(97 + int(d)) for d in str(rng.randrange(vocabulary))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, columns named like results."""
    rows = [(1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, 2), (3, "", "en", "b", 3), (4, " \n\t ", "de", "c", 4), (None, "no id here", "en", "d", 5), (5, "long " * 20_000, "fr", "e", 6), (6, "ß Ünïcode ☃ 漢字 text", "es", "f", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, spans int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (99, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


# --- decontamination


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([14, 30, 60, 12, 8, 20])]
    docs, truth = [], set()
    for d in range(60):
        body = words(rng, rng.randrange(5, 200))
        if d % 3 == 0:
            i, item = items[rng.randrange(len(items))]
            copy = list(item)
            if d % 2:  # a fifth of the words at most are replaced, the outer ones left
                for k in rng.sample(range(1, len(copy) - 1), max(0, len(copy) // 7)):
                    copy[k] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = copy
            if sum(a == b for a, b in zip(item, copy)) >= C.LEAST_EQUAL:
                truth.add((d, i))
        docs.append((d, " ".join(body)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items], "item_id long, text string"), truth


def test_leaks_are_found_and_clean_rows_left(leaky):
    docs, bench, truth = leaky
    assert {(r["doc_id"], r["item_id"]) for r in C.leaks(docs, bench).collect()} == truth
    kept = {r["doc_id"] for r in C.decontaminate(docs, bench).collect()}
    assert kept == set(range(60)) - {d for d, _ in truth}


def test_blocks_of_a_large_benchmark_change_nothing(leaky):
    docs, bench, truth = leaky
    assert {(r["doc_id"], r["item_id"]) for r in C.leaks(docs, bench, seeds_at_once=150).collect()} == truth


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "long " * 13), (None, "long " * 13), (2, None), (3, ""), (1, "long " * 13)], "item_id long, text string")
    got = C.leaks(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5, 1), (5, None)} and all(r["doc_token"] == 0 and r["equal_tokens"] == 13 for r in got)
    assert C.decontaminate(odd, bench).count() == 7 and C.decontaminate(odd, bench).columns == odd.columns
    assert C.leaks(odd, bench.limit(0)).count() == 0 and C.leaks(odd.limit(0), bench).count() == 0


def test_any_run_that_holds_the_share_is_a_leak(spark):
    """Of all alignments' runs the one with the most equal tokens counts, as by trying all."""
    rng = random.Random(11)
    plans = [[26, -13, 20], [13, -6, 8], [11, -9, 14], [12, -3, 4, -9, 12], [6, -1, 5, -9, 3], [10, -9, 10], [20, -2, 3, -3, 15]]
    plans += [[rng.randrange(1, 16) * (1 - 2 * (k % 2)) for k in range(7)] for _ in range(40)]
    items, docs, truth = [], [], {}
    for i, plan in enumerate(plans):
        item = words(rng, sum(map(abs, plan)), 400_000)
        agree = [n > 0 for n in plan for _ in range(abs(n))]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(["start"] + [w if ok else "changed" for w, ok in zip(item, agree)])))
        runs = [(sum(agree[a:b]), a - b, -a) for a in range(len(agree)) for b in range(a + 1, len(agree) + 1)]
        equal, minus, a = max(r for r in runs if 5 * r[0] >= -4 * r[1])
        if equal >= 11:
            truth[i] = (equal, -minus, 1 - a, -a)
    assert truth[0][:2] == (26, 26) and truth[1][:2] == (13, 13) and 5 not in truth
    got = C.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[2:] for r in got if r["doc_id"] == r["item_id"]} == truth


# --- licenses


def test_licenses_are_found_by_scanning_all_places():
    rng, index = random.Random(1), L.Index()
    for (name, i), text in zip(index.names, [t for texts in L.TEMPLATES.values() for t in texts]):
        body = " ".join(words(rng, 60)) + "\n" + text + "\n" + " ".join(words(rng, 40))
        found = L.scan_text(body, index)
        assert (found[0][0], found[0][4]) == (name, 1.0), (name, i, found)
        assert body[found[0][5] : found[0][6]] in text and found[0][5] >= body.index("\n")
        changed = text.split()
        if len(changed) > 12:
            changed[4] = "altered"
            del changed[8]
            again = L.scan_text(" ".join(changed), index)
            assert again and again[0][0] == name and 0.8 <= again[0][4] < 1


def test_each_of_many_adjacent_notices_is_found():
    rng, index = random.Random(2), L.Index()
    for step in (5, 8, 12, 13, 30):
        notice = "Released under the MIT License. "
        body = " ".join(words(rng, 9)) + ". " + "".join(notice + " ".join(words(rng, step - 5)) + "\n" for _ in range(50))
        found = L.scan_text(body, index)
        assert [m[5] for m in found] == [m.start() for m in re.finditer("Released", body)], step
        assert all(m[:2] == ("MIT", 0) and m[4] == 1.0 and body[m[5] : m[6]] == notice[:-2] for m in found)


def test_a_whole_notice_in_a_chain_of_parts_is_found():
    rng, index = random.Random(4), L.Index()
    whole = L.TEMPLATES["MIT"][2]
    part = " ".join(whole.split()[:4])
    body = " ".join(f"{part} {' '.join(words(rng, 4))}" for _ in range(30))
    for text in (f"{whole} {body}", f"{body} {whole}"):
        assert [m[:2] + m[4:5] for m in L.scan_text(text, index)] == [("MIT", 2, 1.0)]


def test_alignment_equals_the_whole_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(1, 5, 9), rng.integers(1, 5, 12)
        best, table = 0, np.zeros((10, 13))
        for i in range(9):
            for j in range(12):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
                best = max(best, table[i + 1, j + 1])
        equal, first, last = L.align(a, b, 0, band=30)
        assert 2 * equal >= best and (equal == 0) == (best == 0) and last >= first


def test_licenses_in_odd_rows(odd):
    assert L.scan_licenses(odd).count() == 0 and L.scan_licenses(odd.limit(0)).count() == 0


# --- MinHash


def jaccard(a, b):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_estimates_similarity(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        a = words(rng, rng.randrange(3, 400))
        b = a[: int(len(a) * k / 60)] + words(rng, int(len(a) * (1 - k / 60)))
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    from pyspark.sql import functions as F

    prints = df.select("k", "a", "b", M.minhash(F.col("a")).alias("x"), M.minhash(F.col("b")).alias("y"))
    got = prints.select("a", "b", M.likeness(F.col("x"), F.col("y")).alias("est")).collect()
    errors = np.array([r["est"] - jaccard(r["a"], r["b"]) for r in got])
    assert abs(errors.mean()) < 0.02 and errors.std() < 0.07


def test_edited_pairs_follow_the_falling_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**12), " ".join(words(rng, rng.randrange(0, 60))) + "ü☃" * (k % 3)) for k in range(200)]
    got = {r["doc_id"]: r for r in M.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)


def test_buckets_pass_rows_over_their_edges(spark):
    rows = spark.createDataFrame([(i * 7, str(i)) for i in range(300)], "doc_id long, text string")
    marked = M.with_next(rows, rows_each=10)
    buckets = marked.groupBy("bucket").count().count()
    assert buckets > 10 and marked.where("ghost").count() == buckets


def test_minhash_of_odd_rows(odd):
    got = M.edited_pairs(odd).toPandas()
    assert len(got) == 8 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    same = got[got.doc_id == 1]
    assert same.fingerprint.nunique() == 1 and len(same) == 2
    assert M.edited_pairs(odd.limit(0)).count() == 0 and len(M.edited_pairs(odd.limit(1)).collect()) == 1


# --- toxicity


def test_grammar_marks_scope():
    machine = T.grammar().arcs
    run = lambda text: [s for s in _run(machine, text)]
    assert run("I") == ["I"] and run("NI") == ["N", "In"] and run("NOOOI")[-1] == "I" and run("RI")[-1] == "Ir" and run("TOI")[-1] == "It" and run("TNI")[-1] == "In" and run("RNH")[-1] == "Hr"
    assert run("MH")[-1] == "S" and run("MOOOH")[-1] == "H" and run("TMH")[-1] == "St" and run("MNH")[-1] == "Sn" and run("RMH")[-1] == "Sr"


def test_clauses_are_scored_by_themselves():
    scorer = T.Scorer({"zorgl-": 2.0}, [1, 0, 0, 0, 0], 0.0)
    scorer.prepare()
    assert scorer.clauses("you zorglab, not a zorglab. He said zorglab! nothing here; zorglab") == pytest.approx([2.6, 0.6, 0.6, 2.0])
    assert scorer.clauses("I will kill you. You, I will kill; they kill") == pytest.approx([1.6, 1.6, 0.8]) and scorer.clauses("you: I kill") == pytest.approx([0.8])
    assert scorer.clauses(None) == [] and scorer.features("zorglab")[0] == 2 and scorer.features("")[0] == 0
    assert T.OUTPUTS["St"] > T.OUTPUTS["S"] > T.OUTPUTS["Sn"]


def test_ties_at_the_threshold_count_as_toxic(spark, monkeypatch):
    monkeypatch.setattr(T, "learn", lambda *_: T.Scorer({}, [0.0] * T.FEATURES, float(np.log(0.7 / 0.3))))
    got = T.score_toxicity(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), None).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got) and len({r["score"] for r in got}) == 1


def _run(machine, text):
    state = (0, 0, 0, 0)
    for symbol in text:
        state, out = machine[state, symbol]
        yield out


def test_held_out_rows_are_scored(spark):
    rng, rows, marks = random.Random(8), [], []
    ends = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"]
    for i in range(900):
        body = words(rng, 60)
        if i % 4 == 0:
            for _ in range(3):
                body[rng.randrange(60)] = "zorgl" + rng.choice(ends) + rng.choice(ends)
        rows.append((i, ". ".join(" ".join(body[k : k + 6]) for k in range(0, 60, 6))))
        marks.append((i, 1, int(i % 4 == 0)))
    got = T.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).toPandas()
    held = got[got.held_out]
    assert 200 < len(held) < 400 and ((held.predicted == 1) == (held.doc_id % 4 == 0)).mean() > 0.98


def test_toxicity_of_odd_rows(odd, labels):
    got = T.score_toxicity(odd, labels).toPandas()
    assert len(got) == 8 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert T.score_toxicity(odd, labels.limit(0)).count() == 8 and T.score_toxicity(odd.limit(0), labels).count() == 0


# --- personal data


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    pieces = ["a.b@c.d", "x@y", "@z.com", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", "text", "a@b.c.d@e.f", "12-34", "é@x.yz", "..a@b..c", "+1.2.3.4.5.6.7.8.9.0", "1.2.3.4.5.6.7.8"]
    patterns = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]

    def passes(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "", ","]) for _ in range(8))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(text) if passes(k, m.group()))
        assert P.base_spans(text) == want, text


def test_model_adds_what_patterns_miss():
    tagger = P.trained()
    texts, spans = P.labelled(400, 12345)
    base = [P.base_spans(t) for t in texts]
    added = P.add_spans(tagger, texts, base)
    missed = sum(len(set(s) - set(b)) for s, b in zip(spans, base))
    right = sum(len(set(a) & set(s)) for s, a in zip(spans, added))
    wrong = sum(len(set(a) - set(s)) for s, a in zip(spans, added))
    assert right > 0.7 * missed and wrong < 0.1 * right
    for b, a in zip(base, added):
        assert all(e <= s2 or s >= e2 for s, _, e in a for s2, _, e2 in b)


# Written apart from the generator that the model learns from: other words, other forms.
PROSE = "The committee met on Tuesday at noon and agreed that the second report would follow in March; nobody objected, although Mr Howard asked whether page 12 of annex 3.2 had been checked. "
FORMS = [
    ("jane.doe(at)example.com", 0), ("info [at] museum-berlin [dot] de", 0), ("press @ newspaper.co.uk", 0), ("r.smith (at) hospital (dot) org", 0), ("sales{at}widgets{dot}net", 0),
    ("192[.]168[.]10[.]25", 1), ("10 . 20 . 30 . 40", 1), ("172[dot]16[dot]0[dot]9", 1),
    ("4111.1111.1111.1111", 2), ("5500/0000/0000/0004", 2),
    ("(212) 555-0187", 3), ("0049 211 5684962", 3), ("212.555.0134", 3), ("(020) 795-4321", 3),
]


def test_forms_of_another_writer():
    tagger, found, wrong = P.trained(), 0, 0
    texts = [f"{PROSE}Write to or call {form} before the end of the month. {PROSE}" for form, _ in FORMS]
    for text, (form, kind), added in zip(texts, FORMS, P.add_spans(tagger, texts, [P.base_spans(t) for t in texts])):
        at = text.index(form)
        found += (at, kind, at + len(form)) in added
        wrong += sum(s >= at + len(form) or e <= at for s, _, e in added)
    assert found >= 0.7 * len(FORMS) and not wrong


def test_a_long_span_is_found_wherever_it_lies():
    tagger, form = P.trained(), "maria.hofmann (at) department-of-records (dot) city-archive (dot) org"
    texts = [("plain words go on and on here " * 40)[:n].rstrip() + " " + form + " and so on" for n in range(30, 700, 23)]
    for text, added in zip(texts, P.add_spans(tagger, texts, [[] for _ in texts])):
        at = text.index(form)
        assert (at, 0, at + len(form)) in added, at


def test_windows_agree_across_a_long_text():
    tagger = P.trained()
    filler = "plain words go on and on here " * 40
    text = filler + "call (555) 123-4567 now " + filler
    (found,) = P.add_spans(tagger, [text], [P.base_spans(text)])
    assert [text[s:e] for s, _, e in found] == ["(555) 123-4567"]


def test_pruned_decoding_is_the_best_path():
    tagger = P.trained()
    texts, _ = P.labelled(60, 77)
    for text in texts:
        code = P.codes(text)
        e = tagger.emissions(P.windows_at(code, np.array([0]), np.array([len(code)])))[: len(code), :, 0]
        tags = tagger.best_path(e[:, None])[:, 0]
        whole = [(int(b), int(tags[b] // 2)) for b in np.flatnonzero(tags % 2 == 1)]
        assert whole == sorted((s, k) for s, k, _ in P._decode(tagger, [e])[0])
        if whole:
            assert tagger.wins(e[..., None], np.array([True]))[0]


def test_gradients():
    tagger, rng = P.Tagger(), np.random.default_rng(0)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    x, y = rng.integers(1, 100, (8, 3)), np.zeros((8, 3), int)
    y[2], y[3] = 1, 2

    def loss():
        crf = tagger.loss_and_grad(x, y)[0]
        e = tagger.emissions(x).transpose(0, 2, 1).astype(np.float64)
        return crf - 0.5 / 3 * (np.take_along_axis(e, y[..., None], 2)[..., 0] - P._lse(e, 2)).sum()

    _, g = tagger.loss_and_grad(x, y)
    for k in ("uf", "xb", "out", "next", "cb", "own"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep = tagger.w[k][at]
        losses = []
        for d in (1e-3, -1e-3):
            tagger.w[k][at] = keep + d
            losses.append(loss())
        tagger.w[k][at] = keep
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[k][at], rel=0.03, abs=1e-3)


def test_personal_data_of_odd_rows(spark, odd):
    got = P.find_pii(odd).toPandas()
    assert len(got) == 8 and (got.spans == "").all() and (got.base_sha256 == hashlib.sha256(b"").hexdigest()).all()
    assert P.find_pii(odd.limit(0)).count() == 0
    text = "mail a@b.co or 10.0.0.1"
    row = P.redacted(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in row] == ["mail <EMAIL> or <IP>", None]


# --- quality


def test_what_is_cut_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from reelsleuth.llm.common import cut

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {x for x in blocks.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = held()
    frame = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    got = cut(frame)
    assert not held() - before
    assert sorted(map(tuple, got.collect())) == [(k, 100) for k in range(10)] == sorted(map(tuple, frame.collect()))


def test_symbols_name_words():
    import pyarrow as pa

    rng = random.Random(8)
    texts = [None, "", " \t", "one", "one ", " two  one\n", "long" * 600_000, "é\u00a0ü one"] + ["".join(rng.choice("ab é\n\x0b") for _ in range(rng.randrange(40))) for _ in range(300)] + ["one"]
    syms, sizes = Q.symbols(pa.array(texts))
    known, at = {}, 0
    for t, n in zip(texts, sizes):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        own = syms[at : at + n].tolist()
        at += n
        assert n == (len(want) + 1 if want else 0) and (not want or own[0] == 0)
        for w, x in zip(want, own[1:]):
            assert known.setdefault(w, x) == x and x
    assert at == len(syms) and len(set(known.values())) == len(known)
    part = pa.array(texts)[5:9]
    assert Q.symbols(part)[0].tolist() == syms[sizes[:5].sum() : sizes[:9].sum()].tolist()


def test_words_of_much_text_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=4_000)) for _ in range(500)] + [None, ""]  # 12 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "key"])
    want, _ = Q.symbols(batch.column("text"))
    tracemalloc.start()
    got, most = [], 0
    for syms, sizes, keys in Q.blocks(iter([batch]), "key"):
        assert len(syms) == sizes.sum() <= Q.BLOCK and len(sizes) == len(keys)
        got.append((syms, keys))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate([x for x, _ in got]), want) and np.concatenate([k for _, k in got]).tolist() == list(range(len(texts)))
    assert most < 80e6


def direct_losses(rows):
    """Loss of each text by interpolation, pair by pair, over dictionaries."""
    from collections import Counter

    chain = lambda t: ["", *t.split(), ""]
    out = {}
    for fold in (0, 1):
        pairs = Counter(p for t, f in rows if f != fold and t.split() for p in zip(chain(t), chain(t)[1:]))
        heads, ends = Counter(), Counter(w for _, w in pairs)
        kinds = {}
        for (v, _), n in pairs.items():
            heads[v] += n
            kinds.setdefault(v, []).append(n)
        few = lambda values: [sum(x == k for x in values) for k in range(1, 5)]
        d2, d1 = Q.discounts(*few(pairs.values())), Q.discounts(*few(ends.values()))
        left = sum(d1[min(n, 3)] for n in ends.values()) / len(pairs) / (len(ends) + 1)

        def low(w):
            return (max(ends[w] - d1[min(ends[w], 3)], 0) / len(pairs) if w in ends else 0) + left

        assert sum(low(w) for w in ends) + left == pytest.approx(1)

        def chance(v, w):
            if v not in heads:
                return low(w)
            n = pairs.get((v, w), 0)
            return (n - d2[min(n, 3)] if n else 0) / heads[v] + sum(d2[min(k, 3)] for k in kinds[v]) / heads[v] * low(w)

        for t, f in rows:
            if f == fold and t.split():
                out[t] = -sum(np.log(chance(*p)) for p in zip(chain(t), chain(t)[1:]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_perplexity_equals_brute_force(spark, monkeypatch, small):
    from pyspark.sql import functions as F

    if small:  # several shards, pieces of texts, and a filter that is full
        monkeypatch.setattr(Q, "SHARD_BYTES", 2000)
        monkeypatch.setattr(Q, "BLOCK", 16)
        monkeypatch.setattr(Q, "FILTER_BITS", 8)
        monkeypatch.setattr(Q, "HEAD_WORDS", 16)
    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [texts[1], texts[2], "new words only", "w1 " * 40, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("fold", Q.fold_of(F.col("text")))
    rows = [(r["text"], r["fold"]) for r in docs.collect()]
    got = {r["key"]: r for r in Q.fit(docs).losses(docs).collect()}
    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    want = direct_losses(rows)
    assert set(got) == {keys[t] for t in want}
    for t, loss in want.items():
        assert got[keys[t]]["loss"] == pytest.approx(loss, rel=1e-5) and got[keys[t]]["tokens"] == len(t.split()) + 1


def test_ties_at_the_thresholds_are_kept(spark):
    rows = [(i, "all alike here", "en") for i in range(5)] + [(9, "all alike here", None)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")).toPandas()
    assert got.keep.all() and got.smoothed.nunique() == 1


def test_junk_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(6)
    common = [f"w{k}" for k in range(300)]
    clean = lambda: " ".join(rng.choice(common) for _ in range(120))
    rows = [(i, clean(), "en") for i in range(900)] + [(1000 + i, " ".join(f"j{rng.randrange(10**9)}" for _ in range(120)), "en") for i in range(50)]
    marks = [(i, 1, 0) for i in range(0, 900, 2)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).toPandas()
    assert got[got.doc_id < 900].keep.mean() > 0.97 and not got[got.doc_id >= 1000].keep.any()


def test_quality_of_odd_rows(odd, labels):
    got = Q.judge(odd, labels).toPandas()
    assert len(got) == 8 and got[got.tokens == 0].perplexity.isna().all() and not got[got.tokens == 0].keep.any()
    none = Q.judge(odd, labels.limit(0)).toPandas()
    assert none[none.tokens > 0].keep.all() and Q.judge(odd.limit(0), labels).count() == 0
    assert Q.keep_good(odd, labels).columns == odd.columns


def test_leaks_lie_anywhere_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    rng = random.Random(9)
    item, docs = words(rng, 25), []
    for d in range(40):
        body = words(rng, 900)
        body[d * 21 : d * 21] = item
        docs.append((d, " ".join(body)))
    got = {r["doc_id"]: (r["equal_tokens"], r["doc_token"]) for r in C.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {d: (25, d * 21) for d in range(40)}
