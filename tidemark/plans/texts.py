"""Text pipeline, words, scoring shapes and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundaries, chunking, scoring
from ..operators import statistics as stat
from ..schema import POLARITY_BAND, WORD_THRESHOLD
from ..sources import html as web
from ..sources.adapters import chunk_scores, paragraphs, table, with_views
from ..sources.store import scratch
from .base import query, r, rounded, sql_boundaries, sql_sentences

_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
#: Short frequent words of the driver's invented English, as a stopword list.
STOPWORDS = frozenset("that this with have from they were been their which would there about will than".split())


@query("clean_paragraphs", with_views("paragraphs", sql=f" SELECT doc_id, pos, CASE WHEN length({_SQUEEZE.format('paragraph')}) >= 100 THEN {_SQUEEZE.format('paragraph')} ELSE '' END AS text FROM paragraphs"))
def clean_paragraphs(spark, sf):
    return paragraphs(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), tx.clean_paragraph("paragraph", 100).alias("text"))


_MODEL = ", " + sql_boundaries("paragraphs", "paragraph")


@query("abbreviation_scores", with_views("paragraphs", sql=_MODEL + f" SELECT t, CAST(k AS BIGINT) AS k, CAST(plain AS BIGINT) AS plain, {r('score', 'score')} FROM bd_ab"))
def abbreviation_scores(spark, sf):
    """Words that the model of sentence boundaries takes for abbreviations."""
    with boundaries.Counts(paragraphs(spark, sf), "paragraph") as c:
        return rounded(_settled(c.abbreviations().orderBy(F.col("score").desc(), "t").limit(boundaries.MOST)), "score")


@query("sentence_starters", with_views("paragraphs", sql=_MODEL + f" SELECT t, CAST(at_end AS BIGINT) AS at_end, CAST(n AS BIGINT) AS n, {r('ratio', 'ratio', 5)} FROM bd_st"))
def sentence_starters(spark, sf):
    with boundaries.Counts(paragraphs(spark, sf), "paragraph") as c:
        return rounded(_settled(boundaries.starters(c.pairs, c.words, c.n, c.with_abbreviations()).orderBy(F.col("ratio").desc(), "t").limit(boundaries.MOST)), "ratio", digits=5)


@query("abbreviation_collocations", with_views("paragraphs", sql=_MODEL + f" SELECT pt, t, CAST(n AS BIGINT) AS n, {r('ratio', 'ratio', 5)} FROM bd_co"))
def abbreviation_collocations(spark, sf):
    """Abbreviations, initials and numbers with the words that follow their dots more often than chance has it."""
    with boundaries.Counts(paragraphs(spark, sf), "paragraph") as c:
        return rounded(_settled(boundaries.collocations(c.pairs, c.words, c.n, c.with_abbreviations()).orderBy(F.col("ratio").desc(), "pt", "t").limit(boundaries.MOST)), "ratio", digits=5)


def _settled(df):
    """A model's table, at most boundaries.MOST rows, before its counts are let go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


_WHOLE = ", " + sql_boundaries("paragraphs", "paragraph", None)


@query("sentence_split", with_views("paragraphs", sql=f"{_WHOLE} SELECT doc_id, pos, unnest(range(len(x))) AS sentence_id, unnest(x) AS sentence FROM {sql_sentences('paragraphs', 'doc_id, pos', 'paragraph')}"))
def sentence_split(spark, sf):
    """Sentences by a model of all of the paragraphs' own abbreviations."""
    p, found = boundaries.split(paragraphs(spark, sf), "paragraph", lambda: scratch(spark, "boundaries"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode(found).alias("sentence_id", "sentence")).withColumn("sentence_id", F.col("sentence_id").cast("long"))


_N = "len(list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> ''))"
_PACK = (
    ", c AS (SELECT doc_id, pos, " + _SQUEEZE.format("paragraph") + " AS t FROM paragraphs WHERE length(" + _SQUEEZE.format("paragraph") + ") >= 100),"
    " s AS (SELECT doc_id, pos, unnest(range(len(x))) AS i, unnest(x) AS s FROM " + sql_sentences("c", "doc_id, pos", "t") + "),"
    " n AS (SELECT *, " + _N.format("s") + " AS n FROM s),"
    " g AS (SELECT doc_id, pos, i, s, n, n AS run, 0 AS chunk FROM n WHERE i = 0 UNION ALL"
    " SELECT n.doc_id, n.pos, n.i, n.s, n.n, CASE WHEN g.run + n.n <= 50 THEN g.run + n.n ELSE n.n END, CASE WHEN g.run + n.n <= 50 THEN g.chunk ELSE g.chunk + 1 END FROM g JOIN n ON n.doc_id = g.doc_id AND n.pos = g.pos AND n.i = g.i + 1),"
    " k AS (SELECT doc_id, pos, chunk, string_agg(s, ' ' ORDER BY i) AS t, sum(n) AS n, max(chunk) OVER (PARTITION BY doc_id, pos) AS top FROM g GROUP BY doc_id, pos, chunk),"
    " m AS (SELECT doc_id, pos, CASE WHEN chunk = top AND top > 0 AND n < 30 THEN chunk - 1 ELSE chunk END AS chunk_id, chunk, t FROM k)"
)


@query("packed_chunks", with_views("paragraphs", sql=_MODEL + _PACK + " SELECT doc_id, pos, CAST(chunk_id AS BIGINT) AS chunk_id, string_agg(t, ' ' ORDER BY chunk) AS chunk FROM m GROUP BY doc_id, pos, chunk_id").replace("WITH ", "WITH RECURSIVE ", 1))
def packed_chunks(spark, sf):
    """Greedy packing of whole sentences into at most 50 words."""
    every = paragraphs(spark, sf)
    known = boundaries.fit(every, "paragraph")
    p = every.select("doc_id", F.col("pos").cast("long").alias("pos"), tx.clean_paragraph("paragraph", 100).alias("t"))
    return p.where("t <> ''").select("doc_id", "pos", F.posexplode(tx.pack_sentences("t", 50, 30, known)).alias("chunk_id", "chunk")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("length_profile", with_views("paragraphs", sql=f" SELECT 'paragraph' AS kind, CAST(floor(least({_N.format('paragraph')}, 250) / 10) * 10 AS INTEGER) AS bin, count(*) AS n FROM paragraphs GROUP BY 2 UNION ALL SELECT 'document', CAST(floor(least({_N.format('text')}, 250) / 10) * 10 AS INTEGER), count(*) FROM documents GROUP BY 2"))
def length_profile(spark, sf):
    return chunking.length_profile(paragraphs(spark, sf), "paragraph", "paragraph").unionAll(chunking.length_profile(table(spark, sf, "documents"), "text", "document"))


@query("question_flags", "SELECT conv_id, turn, regexp_matches(trim(translate(p, '[]', '')), '^(Question|Q:)') OR (length(p) - length(replace(p, '[', '')) = 1 AND starts_with(p, '[') AND ends_with(p, ']')) AS is_question FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN turn % 4 = 0 THEN 'Question: ' || text ELSE '[' || text || ']' END ELSE text END AS p FROM conversations)")
def question_flags(spark, sf):
    p = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Question: "), "text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.is_question(p).alias("is_question"))


@query("clean_answers", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace('Speaker ' || CASE WHEN turn % 2 = 0 THEN 'A:' ELSE 'one two three four:' END || text || '...', '^(?i)[A-Z ]{1,15}:', ''), '…|\\.{3}', '', 'g')) AS text FROM conversations")
def clean_answers(spark, sf):
    head = F.when(F.col("turn") % 2 == 0, "A:").otherwise("one two three four:")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.clean_answer(F.concat(F.lit("Speaker "), head, "text", F.lit("..."))).alias("text"))


@query(
    "qa_split_position",
    with_views("paragraphs", sql=", p AS (SELECT doc_id, pos, CASE WHEN doc_id % 5 = 1 AND pos = 2 THEN 'My first question is on rates' WHEN doc_id % 3 = 1 AND pos = 3 THEN 'We stand ready to take your questions.' WHEN doc_id % 7 = 1 AND pos = 1 THEN 'Transcript of the questions asked, ECB' ELSE paragraph END AS t FROM paragraphs),"
    " g AS (SELECT doc_id, min(pos) FILTER (regexp_matches(t, 'My (first )?question .*')) AS p1, min(pos) FILTER (regexp_matches(t, '(I am[\\w\\s,]{10,30}questions\\.)|(We[\\w\\s,]*questions[\\w\\s]*\\.)|(\\s?Click here [\\w\\s,]*answers\\.)') AND pos > 2) AS p2, min(pos) FILTER (regexp_matches(t, 'Transcript of the questions.*ECB')) AS p3 FROM p GROUP BY doc_id)"
    " SELECT doc_id, CAST(coalesce(CASE WHEN p3 > 0 THEN p3 - 1 END, p2, p1 - 1, -1) AS INTEGER) AS sep FROM g"),
)
def qa_split_position(spark, sf):
    d = F.col("doc_id")
    t = F.when((d % 5 == 1) & (F.col("pos") == 2), "My first question is on rates").when((d % 3 == 1) & (F.col("pos") == 3), "We stand ready to take your questions.").when((d % 7 == 1) & (F.col("pos") == 1), "Transcript of the questions asked, ECB").otherwise(F.col("paragraph"))
    return web.split_position(paragraphs(spark, sf).select("doc_id", "pos", t.alias("text")), "doc_id")


@query("page_elements")
def page_elements(spark, sf):
    """Blocks and headings of the driver's pages, whose text stands in articles."""
    return web.elements(table(spark, sf, "pages"), "article", nested=False)


@query("page_transcripts")
def page_transcripts(spark, sf):
    return web.transcripts(table(spark, sf, "pages"), "article", nested=False)


@query("inline_marks", "SELECT page_id, regexp_replace(html, '(?is)<(?:b|strong|em)(?:\\s[^>]*)?>(.*?)</(?:b|strong|em)>', '[\\1]', 'g') AS html FROM pages")
def inline_marks(spark, sf):
    """Bold and emphasised parts in brackets, where such elements aren't nested."""
    return table(spark, sf, "pages").select("page_id", tx.inline_marks("html").alias("html"))


_WORDS = "string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
_STOP = "(" + ", ".join(f"'{s}'" for s in sorted(STOPWORDS)) + ")"
_COUNTS = f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_WORDS.format('text')}) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN {_STOP} GROUP BY ALL"


@query("word_counts", _COUNTS)
def word_counts(spark, sf):
    return stat.word_counts(table(spark, sf, "documents"), "text", ("lang",), STOPWORDS)


@query("relative_frequency", f"WITH c AS ({_COUNTS}), t AS (SELECT lang, count(*) AS texts FROM documents GROUP BY lang), b AS (SELECT word, sum(n) AS all_n FROM c GROUP BY word), a AS (SELECT sum(texts) AS all_texts FROM t) SELECT lang, word, n, {r('(n / texts) / (all_n / all_texts + 1e-6)', 'ratio')} FROM c JOIN b USING (word) JOIN t USING (lang), a WHERE n >= 20")
def relative_frequency(spark, sf):
    d = table(spark, sf, "documents")
    totals = d.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    return rounded(stat.relative_frequency(stat.word_counts(d, "text", ("lang",), STOPWORDS), totals, "lang", 20), "ratio")


@query(
    "word_polarity",
    f"WITH d AS (SELECT lang, text, CAST(n_chars % 201 AS DOUBLE) / CAST(100 AS DOUBLE) - 1 AS score FROM documents), s AS (SELECT lang, score > {WORD_THRESHOLD} AS hawk, text FROM d WHERE abs(score) > {WORD_THRESHOLD}),"
    f" c AS (SELECT lang, word, count(*) FILTER (hawk) AS h, count(*) FILTER (NOT hawk) AS d FROM (SELECT lang, hawk, unnest({_WORDS.format('text')}) AS word FROM s) WHERE length(word) >= 4 AND word NOT IN {_STOP} GROUP BY lang, word),"
    " p AS (SELECT lang, word, (h - d) / greatest(h + d, 1) AS polarity FROM c), w AS (SELECT word, (sum(h) - sum(d)) / greatest(sum(h) + sum(d), 1) AS whole FROM c GROUP BY word)"
    f" SELECT lang, word, {r('polarity', 'polarity')}, {r('polarity - whole', 'shift')}, CASE WHEN polarity - whole > {POLARITY_BAND} THEN 'hawkish' WHEN polarity - whole < -{POLARITY_BAND} THEN 'dovish' ELSE 'neutral' END AS side FROM p JOIN w USING (word)",
)
def word_polarity(spark, sf):
    d = table(spark, sf, "documents").select("lang", "text", ((F.col("n_chars") % 201).cast("double") / F.lit(100).cast("double") - 1).alias("score"))
    return rounded(stat.word_polarity(d, "lang", WORD_THRESHOLD, POLARITY_BAND, "text", STOPWORDS), "polarity", "shift")


_OUT = "list_transform(range(1, 5), lambda i: {'label': ['positive', 'negative', 'neutral', 'positive'][i], 'score': abs(CAST(embedding[i] AS DOUBLE))})"


def _outputs(spark, sf):
    labels = F.array(*map(F.lit, ("positive", "negative", "neutral", "positive")))
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", scoring.zipped(labels, scores).alias("output"))


@query("polarity_score", f"WITH o AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) + abs(CAST(embedding[4] AS DOUBLE)) AS p, abs(CAST(embedding[2] AS DOUBLE)) AS n FROM embeddings) SELECT vec_id, {r('CASE WHEN p + n < 0.01 THEN 0 ELSE p - n END', 'polarity')}, {r('CASE WHEN p + n < 0.01 THEN 0 ELSE (p - n) / nullif(p + n, 0) END', 'share')} FROM o")
def polarity_score(spark, sf):
    o = _outputs(spark, sf)
    return rounded(o.select("vec_id", scoring.polarity(F.col("output")).alias("polarity"), scoring.polarity(F.col("output"), True).alias("share")), "polarity", "share")


_SORTED = "WITH o AS (SELECT vec_id, unnest(['MP', 'EP', 'FS', 'OI']) AS label, unnest([abs(CAST(embedding[1] AS DOUBLE)), abs(CAST(embedding[2] AS DOUBLE)), abs(CAST(embedding[3] AS DOUBLE)), abs(CAST(embedding[4] AS DOUBLE))]) AS score FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k, max(score) OVER (PARTITION BY vec_id) AS top FROM o)"


def _topics(spark, sf):
    labels = F.array(*map(F.lit, ("MP", "EP", "FS", "OI")))
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    out = scoring.zipped(labels, scores)
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1)
    return table(spark, sf, "embeddings").select("vec_id", F.array_sort(out, order).alias("output"))


@query("multi_label_threshold", _SORTED + f" SELECT vec_id, label, {r('score', 'score')} FROM k WHERE (top >= 0.15 AND score >= 0.15) OR (top < 0.15 AND k = 1)")
def multi_label_threshold(spark, sf):
    return rounded(_topics(spark, sf).select("vec_id", F.inline(scoring.chosen_labels(F.col("output"), 0.15))), "score")


@query("top1_label", _SORTED + " SELECT vec_id, label FROM k WHERE k = 1")
def top1_label(spark, sf):
    return _topics(spark, sf).select("vec_id", F.get("output", 0)["label"].alias("label"))


_LS = ", t AS (SELECT chunk_rowid, topic_model, topic, topic_prob FROM chunk_scores)"


@query("topic_top1_models", with_views("chunk_scores", sql=_LS + ", k AS (SELECT chunk_rowid AS chunk, topic_model, topic, row_number() OVER (PARTITION BY chunk_rowid, topic_model ORDER BY topic_prob DESC, topic) AS k FROM t) SELECT a.chunk, a.topic AS facebook, b.topic AS moritz FROM k AS a JOIN k AS b ON a.chunk // 2 = b.chunk // 2 WHERE a.k = 1 AND b.k = 1 AND a.topic_model = 'facebook' AND b.topic_model = 'moritz'"))
def topic_top1_models(spark, sf):
    """Self-join of two models' best labels."""
    t = chunk_scores(spark, sf).select(F.col("chunk_rowid").alias("chunk"), "topic_model", "topic", "topic_prob")
    k = scoring.top_label(t, ("chunk", "topic_model")).withColumn("pair", F.floor(F.col("chunk") / 2))
    a = k.where("topic_model = 'facebook'").select("pair", "chunk", F.col("topic").alias("facebook"))
    b = k.where("topic_model = 'moritz'").select("pair", F.col("topic").alias("moritz"))
    return a.join(b, "pair").select("chunk", "facebook", "moritz")


def _ratings(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


_RAT = "WITH x AS (SELECT lang, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id))"


def _kappa_sql(by: str) -> str:
    keys, j = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    g = f" GROUP BY {by}" if by else ""
    gl = f" GROUP BY {by}, l" if by else " GROUP BY l"
    ul = f"USING ({by}, l)" if by else "USING (l)"
    return (
        _RAT + f", n AS (SELECT {keys}count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM x{g}), p AS (SELECT {keys}a AS l, count(*) AS na FROM x{gl}), q AS (SELECT {keys}b AS l, count(*) AS nb FROM x{gl}),"
        f" e AS (SELECT {keys}sum(na * nb) AS pe FROM p JOIN q {ul}{g}) SELECT {keys}n, {r('po', 'agreement')}, {r('(po - coalesce(pe, 0) / (n * n)) / nullif(1 - coalesce(pe, 0) / (n * n), 0)', 'kappa')} FROM n LEFT JOIN e {j}"
    )


@query("kappa", _kappa_sql(""))
def kappa(spark, sf):
    return rounded(stat.kappa(_ratings(spark, sf), "a", "b"), "agreement", "kappa")


@query("kappa_by_section", _kappa_sql("lang") + " WHERE n >= 20")
def kappa_by_section(spark, sf):
    return rounded(stat.kappa(_ratings(spark, sf), "a", "b", ("lang",), 20), "agreement", "kappa")


@query("confusion_matrix", _RAT + f", l AS (SELECT a AS l FROM x UNION SELECT b FROM x), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT p.l AS a, q.l AS b, coalesce(n, 0) AS n FROM l AS p CROSS JOIN l AS q LEFT JOIN c ON c.a = p.l AND c.b = q.l) SELECT a, b, n, {r('n / nullif(sum(n) OVER (PARTITION BY a), 0)', 'share')} FROM k")
def confusion_matrix(spark, sf):
    return rounded(stat.confusion(_ratings(spark, sf), "a", "b", True), "share")


_WORDS = "len(list_filter(w, lambda x: x IN ({})))"
_UP, _DOWN = _WORDS.format("'the', 'and', 'les'"), _WORDS.format("'that', 'une', 'der'")


@query("lexicon_sentiment", f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+'), lambda x: lower(x)) AS w FROM documents), c AS (SELECT doc_id, {_UP} / greatest(len(w), 1) AS p, {_DOWN} / greatest(len(w), 1) AS n FROM t) SELECT doc_id, {r('CASE WHEN p + n < 0.01 THEN 0 ELSE (p - n) / nullif(p + n, 0) END', 'polarity')} FROM c")
def lexicon_sentiment(spark, sf):
    """Batch scoring of texts through the pluggable scorer, and its polarity."""
    scored = scoring.score_texts(table(spark, sf, "documents").select("doc_id", "text"), "text", scoring.lexicon_scorer(("the", "and", "les"), ("that", "une", "der")), "lexicon")
    return rounded(scored.select("doc_id", scoring.polarity(F.col("output"), True).alias("polarity")), "polarity")


def _parity(prompt: str) -> str:
    """A stand-in for an endpoint: topic by a text's length."""
    import json

    parts = prompt.split("\n\nTEXT ")
    return json.dumps({"results": [{"topic": "even" if len(p) % 2 == 0 else "odd", "sentiment": round(len(p) % 21 / 10 - 1, 1)} for p in parts]})


_PROMPTS = "WITH n AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS rn FROM benchmark), b AS (SELECT rn // 10 AS batch, list(item_id ORDER BY rn) AS keys, string_agg('TEXT ' || (rn % 10 + 1) || ': ' || text, chr(10) || chr(10) ORDER BY rn) AS prompt FROM n GROUP BY 1), s AS (SELECT keys, string_split(prompt, chr(10) || chr(10) || 'TEXT ') AS parts FROM b), e AS (SELECT unnest(keys) AS key, unnest(parts) AS part FROM s)"


@query("endpoint_batches", _PROMPTS + " SELECT key, CASE WHEN length(part) % 2 = 0 THEN 'even' ELSE 'odd' END AS topic, CAST(round(length(part) % 21 / 10 - 1, 1) AS DOUBLE) AS sentiment FROM e")
def endpoint_batches(spark, sf):
    """Texts in prompts of ten, JSON replies matched by position."""
    b = scoring.prompt_batches(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text")
    return scoring.batch_replies(b, _parity)


@query("clean_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def clean_dates(spark, sf):
    """Two notations of a date, one result."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("raw"))
    return o.select("o_orderkey", tx.clean_date("raw").alias("date"))
