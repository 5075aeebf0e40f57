"""Queries of text analytics: words, rarity, containment, trigrams, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.functions import text as X
from reelsleuth.operators import signals as S
from reelsleuth.operators import transcript as R

from .base import query, table

TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}'']+'), lambda w: length(w) >= 3)"


def duck_stem(w: str) -> str:
    """The stemmer in DuckDB's SQL, over a column `w`."""
    bare = f"regexp_replace(regexp_replace({w}, '''s$', ''), '''+$', '')"
    return (
        f"(SELECT CASE WHEN ends_with(c, 'e') AND strlen(c) > 3 THEN left(c, length(c) - 1) ELSE c END FROM (SELECT CASE "
        f"WHEN ends_with(b, 'ing') AND strlen(b) > 6 THEN left(b, length(b) - 3) WHEN ends_with(b, 'ed') AND strlen(b) > 5 THEN left(b, length(b) - 2) "
        f"WHEN ends_with(b, 'es') AND strlen(b) > 5 THEN left(b, length(b) - 2) WHEN ends_with(b, 's') AND strlen(b) > 4 THEN left(b, length(b) - 1) ELSE b END AS c "
        f"FROM (SELECT {bare} AS b)))"
    )


def duck_stems(name: str, source: str, key: str) -> str:
    """CTEs: {name}(id, stem, n) over a table's texts."""
    return (
        f"{name}_w AS (SELECT {key} AS id, unnest({TOK}) AS w FROM {source}), {name}_d AS (SELECT w, {duck_stem('w')} AS stem FROM (SELECT DISTINCT w FROM {name}_w)), "
        f"{name} AS (SELECT id, stem, count(*) AS n FROM {name}_w JOIN {name}_d USING (w) GROUP BY id, stem)"
    )


def duck_idf(name: str, rows: str) -> str:
    return f"{name} AS (SELECT stem, count(DISTINCT id) AS df, greatest(0.0, ln(((SELECT count(DISTINCT id) FROM {rows}) + 1.0) / (count(DISTINCT id) + 1.0))) AS idf FROM {rows} GROUP BY stem)"


@query("A01_word_counts", f"SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) GROUP BY ALL")
def word_counts(spark, sf_dir):
    """Counted within the row: no word is shuffled."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.counted(X.tokens(F.col("text")))).alias("w")).select("doc_id", "w.word", "w.n")


@query("U04_token_sets", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens FROM (SELECT doc_id, list_distinct({TOK}) AS t FROM documents)")
def token_sets(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").select("doc_id", X.token_set(F.col("text")).alias("t"))
    return sets.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


@query("F01_stem_terms", f"SELECT w AS word, {duck_stem('w')} AS stem FROM (SELECT DISTINCT unnest({TOK}) AS w FROM documents)")
def stem_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query("A03_stem_counts", f"WITH {duck_stems('s', 'conversations', 'conv_id')} SELECT id AS conv_id, stem, n FROM s")
def stem_counts(spark, sf_dir):
    return S.stems_of(table(spark, sf_dir, "conversations"), "conv_id", "text").withColumnRenamed("id", "conv_id")


@query("U03_stem_sets", f"WITH {duck_stems('s', 'conversations', 'conv_id')} SELECT id AS conv_id, count(*) AS n, md5(string_agg(stem, ' ' ORDER BY stem)) AS stems FROM s GROUP BY id")
def stem_sets(spark, sf_dir):
    rows = S.stems_of(table(spark, sf_dir, "conversations"), "conv_id", "text")
    grouped = rows.groupBy(F.col("id").alias("conv_id")).agg(F.array_sort(F.collect_set("stem")).alias("s"))
    return grouped.select("conv_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", " ")).alias("stems"))


@query("A02_idf_weights", f"WITH {duck_stems('r', 'benchmark', 'item_id')}, {duck_idf('i', 'r')} SELECT stem, df, round(idf, 9) AS idf FROM i")
def idf_weights(spark, sf_dir):
    return S.idf(S.stems_of(table(spark, sf_dir, "benchmark"), "item_id", "text")).select("stem", "df", F.round("idf", 9).alias("idf"))


@query(
    "T01_idf_lookup",
    f"WITH {duck_stems('c', 'conversations', 'conv_id')}, {duck_stems('r', 'benchmark', 'item_id')}, {duck_idf('i', 'r')} "
    "SELECT stem, round(coalesce(idf, ln((SELECT count(DISTINCT id) FROM r) + 1.0)), 9) AS weight FROM (SELECT DISTINCT stem FROM c) LEFT JOIN i USING (stem)",
)
def idf_lookup(spark, sf_dir):
    corpus = S.stems_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    asked = S.stems_of(table(spark, sf_dir, "conversations"), "conv_id", "text").select("stem").distinct()
    n = corpus.agg(F.countDistinct("id").alias("docs"))
    rows = asked.join(S.idf(corpus), "stem", "left").join(F.broadcast(n))
    return rows.select("stem", F.round(F.coalesce("idf", F.log(F.col("docs") + 1)), 9).alias("weight"))


@query(
    "T02_weighted_containment",
    f"WITH {duck_stems('t', 'conversations', 'conv_id')}, {duck_stems('r', 'benchmark', 'item_id')}, {duck_idf('i', 'r')}, w AS (SELECT id, stem, idf FROM r JOIN i USING (stem)), "
    "tot AS (SELECT id, sum(idf) AS total FROM w GROUP BY id) SELECT t.id AS title, w.id AS reference, round(sum(idf) / any_value(total), 8) AS score "
    "FROM t JOIN w USING (stem) JOIN tot ON tot.id = w.id WHERE total > 0 GROUP BY t.id, w.id",
)
def weighted_containment(spark, sf_dir):
    found = S.weighted_containment(S.stems_of(table(spark, sf_dir, "conversations"), "conv_id", "text"), S.stems_of(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.withColumn("score", F.round("score", 8))


@query(
    "T04_containment",
    f"WITH d AS (SELECT DISTINCT conv_id, unnest({TOK}) AS w FROM conversations), b AS (SELECT DISTINCT item_id, unnest({TOK}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id) "
    "SELECT conv_id, item_id, round(count(*) / any_value(n), 9) AS score FROM d JOIN b USING (w) JOIN n USING (item_id) GROUP BY conv_id, item_id",
)
def containment(spark, sf_dir):
    rows = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(X.tokens(F.col("text"))).alias("w")).distinct()
    refs = rows("benchmark", "item_id")
    n = refs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hit = rows("conversations", "conv_id").join(refs, "w").groupBy("conv_id", "item_id").agg(F.count(F.lit(1)).alias("hit"))
    return hit.join(n, "item_id").select("conv_id", "item_id", F.round(F.col("hit") / F.col("n"), 9).alias("score"))


@query(
    "T05_distinctive_fit",
    f"WITH {duck_stems('t', 'conversations', 'conv_id')}, {duck_stems('r', 'benchmark', 'item_id')}, {duck_idf('ri', 'r')}, {duck_idf('ti', 't')}, "
    "w AS (SELECT r.id, stem, idf FROM r JOIN ri USING (stem)), tot AS (SELECT id, sum(idf) AS total FROM w GROUP BY id), "
    "hit AS (SELECT t.id AS title, w.id AS reference, sum(w.idf * ti.idf * ln(1 + t.n)) AS hit FROM t JOIN ti USING (stem) JOIN w USING (stem) GROUP BY ALL), "
    "pairs AS (SELECT t.id AS title, tot.id AS reference, CASE WHEN total > 0 THEN coalesce(hit, 0) / total ELSE 0 END AS raw, hit FROM (SELECT DISTINCT id FROM t) t CROSS JOIN tot LEFT JOIN hit ON hit.title = t.id AND hit.reference = tot.id), "
    "z AS (SELECT title, reference, hit, raw, avg(raw) OVER p AS m, stddev_pop(raw) OVER p AS sd FROM pairs WINDOW p AS (PARTITION BY title)) "
    "SELECT title, reference, round(raw, 7) AS raw, round(CASE WHEN sd > 0 THEN (raw - m) / sd ELSE 0 END, 6) AS z FROM z WHERE hit IS NOT NULL",
)
def distinctive_fit(spark, sf_dir):
    found = S.distinctive_fit(S.stems_of(table(spark, sf_dir, "conversations"), "conv_id", "text"), S.stems_of(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.select("title", "reference", F.round("raw", 7).alias("raw"), F.round("z", 6).alias("z"))


PH = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[''’]', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def duck_phrases(name: str, source: str, key: str, where: str = "true") -> str:
    return (
        f"{name}_w AS (SELECT {key} AS id, {PH} AS ws FROM {source} WHERE {where}), "
        f"{name} AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS p FROM {name}_w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i))"
    )


@query("T06_trigrams", f"WITH {duck_phrases('p', 'documents', 'doc_id')}, n AS (SELECT id, count(*) AS n FROM p GROUP BY id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(n, 0) >= 200 AS usable FROM documents LEFT JOIN n ON n.id = doc_id")
def trigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(X.phrases(F.col("text"))).cast("long").alias("n"))
    return rows.withColumn("usable", F.col("n") >= X.LEAST_PHRASES)


_REF = "references_ AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY source)"
_OVER = (
    f"WITH {_REF}, {duck_phrases('t', 'documents', 'doc_id')}, r AS (SELECT t.* FROM t JOIN references_ ON id = doc_id), tn AS (SELECT id, count(*) AS n FROM t GROUP BY id), "
    "o AS (SELECT t.id AS title, r.id AS reference, count(*) AS common FROM t JOIN r USING (p) GROUP BY ALL), "
    "s AS (SELECT title, reference, a.n AS title_n, b.n AS reference_n, common, common / least(a.n, b.n) AS share FROM o JOIN tn a ON a.id = title JOIN tn b ON b.id = reference)"
)


def _titles_and_references(spark, sf_dir):
    """All documents as titles; the first document of each source as references."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("id")).select("id")
    titles = R.phrase_sets(docs, "doc_id", "text")
    return docs, titles, titles.join(first, "id", "left_semi")


@query("U02_trigram_overlap", f"{_OVER} SELECT title, reference, title_n, reference_n, common, round(share, 9) AS share FROM s")
def trigram_overlap(spark, sf_dir):
    _, titles, references = _titles_and_references(spark, sf_dir)
    return R.overlaps(titles, references).select("title", "reference", "title_n", "reference_n", "common", F.round("share", 9).alias("share"))


_CHECK = (
    "u AS (SELECT * FROM s WHERE title_n >= 200 AND reference_n >= 200), rv AS (SELECT q.title, q.proposed, max({{'a': u.share, 'b': u.reference}}) AS r FROM q JOIN u ON u.title = q.title AND u.reference <> q.proposed GROUP BY ALL), "
    "c AS (SELECT q.title, q.proposed, coalesce(u.share, 0) AS share, r.b AS rival, coalesce(r.a, 0) AS rival_share, coalesce(a.n, 0) < 200 OR coalesce(b.n, 0) < 200 AS no FROM q "
    "LEFT JOIN u ON u.title = q.title AND u.reference = q.proposed LEFT JOIN rv ON rv.title = q.title AND rv.proposed = q.proposed LEFT JOIN tn a ON a.id = q.title LEFT JOIN tn b ON b.id = q.proposed) "
    "SELECT title, proposed, CASE WHEN no THEN 'unchecked' WHEN share >= 0.25 AND share >= 3 * rival_share THEN 'confirmed' WHEN rival_share >= 0.25 AND rival_share >= 3 * share THEN 'contradicted' ELSE 'inconclusive' END AS verdict, "
    "round(share, 9) AS share, rival, round(rival_share, 9) AS rival_share FROM c"
).replace("{{", "{").replace("}}", "}")


@query("T07_transcript_verdict", f"{_OVER}, q AS (SELECT doc_id AS title, min(doc_id) OVER (PARTITION BY source) AS proposed FROM documents), {_CHECK}")
def transcript_verdict(spark, sf_dir):
    docs, titles, references = _titles_and_references(spark, sf_dir)
    first = docs.groupBy("source").agg(F.min("doc_id").alias("proposed"))
    proposed = docs.join(first, "source").select(F.col("doc_id").alias("title"), "proposed")
    return R.check(titles, references, proposed).withColumns({"share": F.round("share", 9), "rival_share": F.round("rival_share", 9)})


@query("T08_transcript_place", f"{_OVER}, q AS (SELECT title, arg_max(reference, {{'a': share, 'b': reference}}) AS proposed FROM s WHERE title_n >= 200 AND reference_n >= 200 GROUP BY title), {_CHECK}")
def transcript_place(spark, sf_dir):
    _, titles, references = _titles_and_references(spark, sf_dir)
    return R.place(titles, references).withColumns({"share": F.round("share", 9), "rival_share": F.round("rival_share", 9)})


@query(
    "C79_verdict_text",
    f"SELECT title, CASE verdict WHEN 'confirmed' THEN 'reference subtitles confirm it: ' || a || '% of its phrases match, against at most ' || b || '% for any other episode checked' WHEN 'contradicted' THEN 'reference subtitles CONTRADICT it: ' || a || '% of its phrases match, but ' || b || '% match another episode' "
    f"WHEN 'inconclusive' THEN 'reference subtitles are inconclusive: ' || a || '% of its phrases match, ' || b || '% for the closest other episode' ELSE 'no reference subtitle or no dialogue to check' END AS note FROM (SELECT *, round_even(share * 100, 0)::BIGINT AS a, round_even(rival_share * 100, 0)::BIGINT AS b FROM ({_OVER}, q AS (SELECT doc_id AS title, min(doc_id) OVER (PARTITION BY source) AS proposed FROM documents), {_CHECK}))",
)
def verdict_text(spark, sf_dir):
    rows = transcript_verdict(spark, sf_dir)
    return rows.select("title", R.describe(F.col("verdict"), F.col("share"), F.col("rival_share")).alias("note"))


@query("W20_head_bigram", f"SELECT doc_id, list_has_any(list_transform(range(1, least(len(ws), 40)), lambda i: ws[i] || ' ' || ws[i + 1]), ['of the', 'en la', 'und der', 'de la']) AS found FROM (SELECT doc_id, {PH} AS ws FROM documents)")
def head_bigram(spark, sf_dir):
    """Whether two words stand together among the first forty."""
    words = F.slice(X.phrase_words(F.col("text")), 1, 40)
    pairs = F.transform(F.slice(words, 2, 40), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return table(spark, sf_dir, "documents").select("doc_id", F.arrays_overlap(pairs, F.array(*[F.lit(x) for x in ("of the", "en la", "und der", "de la")])).alias("found"))


@query("U01_phrase_union", f"WITH {duck_phrases('p', 'conversations', 'conv_id')} SELECT id AS conv_id, count(*) AS n FROM p GROUP BY id")
def phrase_union(spark, sf_dir):
    """The union of a conversation's turns, as one set of trigrams."""
    rows = R.phrase_rows(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return rows.distinct().groupBy(F.col("id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))


_HALVES = (
    f"WITH {duck_phrases('t', 'conversations', 'conv_id * 1000 + turn')}, k AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), "
    "own AS (SELECT DISTINCT id, id // 1000 AS conv, p FROM t), half AS (SELECT DISTINCT conv, CASE WHEN id % 1000 * 2 <= last THEN 1 ELSE 2 END AS h, p FROM own JOIN k ON k.conv_id = conv), "
    "tn AS (SELECT id, count(*) AS n FROM own GROUP BY id), hn AS (SELECT conv, h, count(*) AS n FROM half GROUP BY ALL), "
    "c AS (SELECT id, conv, h, count(*) AS n FROM own JOIN half USING (conv, p) GROUP BY ALL), "
    "s AS (SELECT tn.id, coalesce(max(CASE WHEN h = 1 THEN c.n / least(tn.n, hn.n) END), 0) AS a, coalesce(max(CASE WHEN h = 2 THEN c.n / least(tn.n, hn.n) END), 0) AS b FROM tn LEFT JOIN c ON c.id = tn.id LEFT JOIN hn USING (conv, h) GROUP BY tn.id)"
)


@query(
    "T09_piece_of_two_parter",
    f"{_HALVES} SELECT id AS title, round(a, 9) AS first, round(b, 9) AS second, CASE WHEN a >= 0.25 AND b * 3 < a THEN 'part 1' WHEN b >= 0.25 AND a * 3 < b THEN 'part 2' ELSE 'whole' END AS one_sided, "
    "CASE WHEN a >= 0.25 AND a >= b + 0.15 THEN 'part 1' WHEN b >= 0.25 AND b >= a + 0.15 THEN 'part 2' ELSE 'whole' END AS separate FROM s",
)
def piece_of_two_parter(spark, sf_dir):
    """Each turn as a title, the halves of its conversation as references."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = R.phrase_rows(turns.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text").distinct().withColumn("conv_id", F.floor(F.col("id") / 1000))
    half = rows.join(last, "conv_id").select("conv_id", F.when(F.col("id") % 1000 * 2 <= F.col("last"), 1).otherwise(2).alias("h"), "phrase").distinct()
    common = rows.join(half, ["conv_id", "phrase"]).groupBy("id", "conv_id", "h").agg(F.count(F.lit(1)).alias("c"))
    both = common.join(R.sizes(rows).withColumnRenamed("n", "title_n"), "id").join(half.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("half_n")), ["conv_id", "h"])
    shares = both.withColumn("share", X.share(F.col("c"), F.col("title_n"), F.col("half_n")))
    side = lambda h: F.coalesce(F.max(F.when(F.col("h") == h, F.col("share"))), F.lit(0.0))
    found = R.sizes(rows).select("id").join(shares.groupBy("id").agg(side(1).alias("first"), side(2).alias("second")), "id", "left").fillna(0.0)
    a, b = F.col("first"), F.col("second")
    return found.select(F.col("id").alias("title"), F.round(a, 9).alias("first"), F.round(b, 9).alias("second"), R.piece(a, b).alias("one_sided"), R.piece_of_separate(a, b).alias("separate"))


#: Captions as recognised from pictures, with the traps of the format.
CAPTIONS = [
    (1, "EPISODE 4 The Long Road Home and then"), (2, "NEXT EPISODE: Don't Look Back"), (3, "in this episode we see"), (4, "Ep|sode 12, Winter’s End"), (5, "Commentary by the director and cast"),
    (6, "previously; next episode 7 Fire-Water"), (7, "episode"), (8, ""), (9, "Episode 3 One. EPISODE 3 One. next episode Two"), (10, "a commentary, by nobody"),
]
_CAPTIONS = "(VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in CAPTIONS) + ") AS v(id, text)"
_CW = "list_filter(regexp_split_to_array(regexp_replace(translate(regexp_replace(text, '[''’]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ|', 'abcdefghijklmnopqrstuvwxyzi'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +'), lambda w: w <> '')"


@query(
    "T11_cards",
    f"WITH w AS (SELECT id, {_CW} AS ws FROM {_CAPTIONS}), p AS (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w), q AS (SELECT id, ws, i, try_cast(ws[i + 1] AS INT) AS number, coalesce(ws[i - 1] = 'next', false) AS next FROM p WHERE ws[i] = 'episode') "
    "SELECT id, i::BIGINT AS place, number, next, array_to_string(ws[i + 1 + (number IS NOT NULL)::INT : i + 16 + (number IS NOT NULL)::INT], ' ') AS following FROM q WHERE next OR number IS NOT NULL",
)
def captions(spark, sf_dir):
    rows = spark.createDataFrame(CAPTIONS, "id int, text string")
    found = rows.select("id", X.caption_words(F.col("text")).alias("ws"), X.cards(F.col("text")).alias("cards"))
    each = found.select("id", "ws", F.posexplode("cards").alias("k", "c"))
    places = F.filter(F.transform("ws", lambda w, i: F.when((w == "episode") & (F.get(F.col("ws"), i + 1).rlike("^[0-9]+$") | (F.get(F.col("ws"), F.greatest(i - 1, F.lit(0))) == "next")), i + 1)), lambda x: x.isNotNull())
    return each.select("id", F.get(places, F.col("k")).cast("long").alias("place"), "c.number", "c.next", "c.following")


@query("P09_commentary", f"WITH w AS (SELECT id, {_CW} AS ws FROM {_CAPTIONS}) SELECT id, contains(' ' || array_to_string(ws[1:40], ' ') || ' ', ' commentary by ') AS commentary FROM w")
def commentary(spark, sf_dir):
    return spark.createDataFrame(CAPTIONS, "id int, text string").select("id", X.is_commentary(F.col("text")).alias("commentary"))


@query("T15_dialogue_flags", f"SELECT conv_id, turn, len(list_distinct({TOK})) AS words, len(list_distinct({TOK})) >= 20 AS has_dialogue, contains(' ' || array_to_string(({_CW})[1:40], ' ') || ' ', ' commentary by ') AS commentary FROM conversations")
def dialogue_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(X.token_set(F.col("text"))).cast("long").alias("words"), X.is_commentary(F.col("text")).alias("commentary"))
    return rows.select("conv_id", "turn", "words", (F.col("words") >= 20).alias("has_dialogue"), "commentary")
