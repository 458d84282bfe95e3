"""The transcript store, its files and its pages: each query writes, reads back what was written, and is held against SQL
on the tables that the written rows came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundaries, chunking, scoring
from ..schema import CHUNK_LIMITS
from ..sources import files
from ..sources import html as web
from ..sources.adapters import market, paragraphs, table, with_views
from ..sources.store import Store, scratch, seeded_sample
from .base import query, r, rounded, sql_boundaries, sql_sentences

#: Meetings that documents are dealt to.
MEETINGS = 48
_LINES = "replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ')"


@query("psv_statements", f"SELECT doc_id AS statement_id, CAST(DATE '2000-01-01' + CAST(doc_id % 5000 AS INTEGER) AS DATE) AS date, md5({_LINES}) AS intro, CASE WHEN doc_id % 3 > 0 THEN md5(' ' || {_LINES} || '\"|\\ ') END AS qa FROM documents")
def psv_statements(spark, sf):
    """Documents as transcripts, written to a |-separated file and scanned again."""
    home = scratch(spark, "psv")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 5000).cast("int")).cast("string")
    text = F.coalesce("text", F.lit(""))
    qa = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" "), text, F.lit('"|\\ ')))
    files.write_transcripts(table(spark, sf, "documents").select(F.col("doc_id").alias("statement_id"), day.alias("date"), F.lit("u").alias("url"), text.alias("intro"), qa.alias("qa")), home)
    return files.read_transcripts(spark, home).select("statement_id", "date", F.md5(F.coalesce("intro", F.lit(""))).alias("intro"), F.md5("qa").alias("qa"))


@query("shocks_csv", with_views("market", sql=" SELECT date, mro AS pc1, stoxx50 AS \"STOXX50\", ois_1m AS \"MP_pm\", ois_3m AS \"CBI_pm\", ois_6m AS \"MP_median\", ois_1y AS \"CBI_median\" FROM market WHERE coalesce(mro, stoxx50, ois_1m, ois_3m, ois_6m, ois_1y) IS NOT NULL"))
def shocks_csv(spark, sf):
    """A panel as CSV in another order of columns and with one more, scanned by the schema's names."""
    home = scratch(spark, "shocks")
    m = market(spark, sf).select("stoxx50", F.lit("x").alias("note"), F.date_format("date", "d/M/yyyy").alias("date"), "mro", "ois_1y", "ois_1m", "ois_3m", "ois_6m")
    m.toDF("STOXX50", "note", "date", "pc1", "CBI_median", "MP_pm", "CBI_pm", "MP_median").write.csv(home, header=True)
    return files.read_shocks(spark, home)


_PANEL = "ois_1m, ois_3m, ois_6m, ois_1y, stoxx50"


@query("event_study_workbook", with_views("market", sql=f" SELECT date, ois_1m AS \"OIS_1M\", ois_3m AS \"OIS_3M\", ois_6m AS \"OIS_6M\", ois_1y AS \"OIS_1Y\", stoxx50 AS \"STOXX50\" FROM market WHERE coalesce({_PANEL}) IS NOT NULL"))
def event_study_workbook(spark, sf):
    """A panel as a sheet among others, with serial dates and columns that aren't wanted, scanned by the schema's names."""
    path = scratch(spark, "book") + ".xlsx"
    panel = market(spark, sf).select(F.datediff("date", F.lit("1899-12-30")).cast("string"), F.lit("x"), *[F.col(c.strip()).cast("string") for c in _PANEL.split(",")])
    rows = [list(x) for x in panel.collect()]  # a row a month
    files.write_workbook(spark, path, {"Notes": [["a"], ["b"]], "Press Conference Window": [["date", "note", "OIS_1M", "OIS_3M", "OIS_6M", "OIS_1Y", "STOXX50"], *rows]})
    return files.read_event_study(spark, path)


@query("money_market_workbook", with_views("market", sql=' SELECT date, mro AS "MRO", round(mro + 0.25, 6) AS "MRO announced", shadow AS "Wu-Xia shadow rate" FROM market WHERE coalesce(mro, shadow) IS NOT NULL'))
def money_market_workbook(spark, sf):
    """Rates as the sheet of another workbook, dates as text."""
    path = scratch(spark, "rates") + ".xlsx"
    panel = market(spark, sf).select(F.date_format("date", "d/M/yyyy"), F.lit("x"), *[c.cast("string") for c in (F.col("shadow"), F.round(F.col("mro") + 0.25, 6), F.col("mro"))])
    rows = [list(x) for x in panel.collect()]  # a row a month
    files.write_workbook(spark, path, {"MM": [["date", "note", "Wu-Xia shadow rate", "MRO announced", "MRO"], *rows], "More": [["a"]]})
    return files.read_money_market(spark, path)


@query("result_table", "SELECT lang AS \"Era\", source AS \"Feature\", count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN '*' ELSE '' END AS sig FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def result_table(spark, sf):
    """A result table as CSV, each row twice, read again: no stars as '', one row a feature and era."""
    home = scratch(spark, "table")
    g = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy("lang", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = g.selectExpr("lang AS Era", "source AS Feature", "source AS Base", "0 AS Lag", "0.5D AS r", "0.1D AS p", "CASE WHEN n % 2 = 0 THEN '*' END AS sig", "n", "'y' AS target")
    files.write_table(rows.unionAll(rows), home)
    return files.read_correlations(spark, home).select("Era", "Feature", F.col("n").cast("long").alias("n"), "sig")


def _filled(spark, sf) -> Store:
    """A store with documents as chunks: a document is one chunk of a size, of an introduction or a question time."""
    s = Store(spark, scratch(spark, "store"))
    s.create(confirm=True)
    day = F.date_add(F.lit("2000-01-01").cast("date"), (30 * F.col("id")).cast("int"))
    meetings = spark.range(MEETINGS).select(day.alias("date"), F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("url"))
    s.put_statements(meetings.limit(5))  # the next load replaces this one
    s.put_statements(meetings)
    d = F.col("doc_id")
    limit = F.element_at(F.array(*map(F.lit, CHUNK_LIMITS)), (d % 4 + 1).cast("int"))
    rows = table(spark, sf, "documents").select((d % MEETINGS + 1).alias("statement_id"), d.cast("int").alias("chunk_id"), limit.alias("chunk_limit"), F.coalesce("text", F.lit("")).alias("chunk"))
    s.put_chunks(rows.where("chunk_id % 3 = 0"), rows.where("chunk_id % 3 = 1").withColumn("is_question", F.col("chunk_id") % 5 == 0))
    s.put_chunks(None, rows.where("chunk_id % 3 = 2").withColumn("is_question", F.col("chunk_id") % 5 == 0))
    s.put_topic_labels({"A": "about a", "B": "about b"})
    s.put_topic_labels({"C": "about c"}, version=1)
    return s


_CHUNKS = (
    "c AS (SELECT doc_id AS chunk_id, CAST(DATE '2000-01-01' + CAST(30 * (doc_id % 48) AS INTEGER) AS DATE) AS date, doc_id % 48 + 1 AS statement_id, CASE WHEN doc_id % 3 = 0 THEN 'IS' ELSE 'QA' END AS part,"
    " doc_id % 3 > 0 AND doc_id % 5 = 0 AS is_question, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 200 ELSE 350 END AS chunk_limit, coalesce(text, '') AS chunk FROM documents)"
)


@query("store_statements", f"SELECT CAST(i + 1 AS BIGINT) AS statement_id, CAST(DATE '2000-01-01' + CAST(30 * i AS INTEGER) AS DATE) AS date, '/m/' || i AS url FROM range({MEETINGS}) AS t(i)")
def store_statements(spark, sf):
    """Statements with their keys; a load replaces the one before."""
    return _filled(spark, sf).statements().select("statement_id", "date", "url")


@query("store_chunks", f"WITH {_CHUNKS} SELECT statement_id, part, chunk_id, is_question, chunk_limit, md5(chunk) AS chunk FROM c")
def store_chunks(spark, sf):
    """Chunks of both parts, appended in two loads; one scan a limit, as many limits as the store names."""
    s = _filled(spark, sf)
    every = s.chunks(None)
    by_limit = [s.chunks(k) for k in CHUNK_LIMITS]
    keyed = by_limit[0]
    for df in by_limit[1:]:
        keyed = keyed.unionAll(df)
    rows = every.drop("chunk").join(keyed, "chunk_rowid").join(F.broadcast(s.limits()), "chunk_limit")  # four limits
    return rows.select("statement_id", F.when(F.col("part") == 0, "IS").otherwise("QA").alias("part"), F.col("chunk_id").cast("long").alias("chunk_id"), "is_question", "chunk_limit", F.md5("chunk").alias("chunk"))


@query("seeded_sample", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL ORDER BY md5(doc_id || ':42'), doc_id LIMIT 50")
def sampled_documents(spark, sf):
    """A sample of fixed size by a seed, the same on every run."""
    return seeded_sample(table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id"), "doc_id", 50)


#: The stored tables' columns and types, as the reference's tables have them, with the partitions' own.
_DDL = """
statements statement_id bigint, date date, url string
chunks chunk_rowid bigint, statement_id bigint, part int, chunk_id int, is_question boolean, chunk_limit int, chunk string
sentiment_models model_id int, name string
sentiments chunk_rowid bigint, model_id int, score double, chunk_limit int
topic_labels label_id int, name string, description string, version int
topics chunk_rowid bigint, label_id int, prob double, model_id int, chunk_limit int
topic_models model_id int, name string
"""
_COLUMNS = ", ".join(f"('{line.split(' ', 1)[0]}', {i}, {', '.join(map(repr, part.split(' ')))})" for line in _DDL.strip().split("\n") for i, part in enumerate(line.split(" ", 1)[1].split(", ")))


@query(
    "store_ddl",
    f"WITH c AS (SELECT * FROM (VALUES {_COLUMNS}) AS t(name, pos, field, type)), n AS (SELECT 'chunks' AS name, count(*) AS n FROM documents UNION ALL SELECT 'statements', count(DISTINCT doc_id % {MEETINGS}) FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'sentiments', count(*) FROM documents WHERE doc_id % 4 = 2)"
    " SELECT c.name, pos, field, type, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (name) WHERE c.name IN ('chunks', 'statements', 'sentiments', 'topics')",
)
def store_ddl(spark, sf):
    """Columns of the stored tables as their files have them, and how many rows came to be in them from the documents."""
    s = _filled(spark, sf)
    meetings = table(spark, sf, "documents").where("doc_id IS NOT NULL").select((F.col("doc_id") % MEETINGS).alias("m")).distinct()
    day = F.date_add(F.lit("2000-01-01").cast("date"), (30 * F.col("m")).cast("int"))
    s.put_statements(meetings.select(day.alias("date"), F.col("m").cast("string").alias("url")))
    s.replace_sentiments(s.chunks(200).select("chunk_rowid", F.lit(0.5).alias("score")), "finbert", 200)
    out = None
    for name in ("chunks", "statements", "sentiments", "topics"):
        df = s.read(name)
        fields = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema)])
        rows = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.inline(fields), "n")
        out = rows if out is None else out.unionAll(rows)
    return out


_COUNT = "len(list_filter(w, lambda x: x IN ({})))"
_UP, _DOWN = _COUNT.format("'the', 'and', 'les'"), _COUNT.format("'that', 'une', 'der'")
_SCORED = (
    "t AS (SELECT *, list_transform(regexp_extract_all(chunk, '\\p{L}+'), lambda x: lower(x)) AS w FROM c),"
    f" n AS (SELECT *, {_UP} / greatest(len(w), 1) AS p, {_DOWN} / greatest(len(w), 1) AS q FROM t), s AS (SELECT *, CASE WHEN p + q < 0.01 THEN 0 ELSE p - q END AS score FROM n)"
)


def _scores(spark, sf) -> Store:
    s = _filled(spark, sf)
    load = scoring.lexicon_scorer(("the", "and", "les"), ("that", "une", "der"))
    scoring.sentiment_job(s, "finbert", load, None, save=True)
    scoring.sentiment_job(s, "finbert", load, 200, save=True)  # a second run replaces the first
    return s


@query("store_sentiments", f"WITH {_CHUNKS}, {_SCORED} SELECT date, chunk_id, part, is_question, chunk_limit, {r('score', 'score')}, 'finbert' AS sentiment_model FROM s WHERE chunk_limit <> 50")
def store_sentiments(spark, sf):
    """The scoring job over all limits, then one limit's scores cleared: the star join of what is stored."""
    s = _scores(spark, sf)
    s.clear("sentiments", 50, 1)
    got = s.sentiment(None).select("date", F.col("chunk_id").cast("long").alias("chunk_id"), "part", "is_question", "chunk_limit", "score", "sentiment_model")
    return rounded(got, "score")


def _by_length():
    """A stand-in for a topic model: labels by a text's length."""
    return lambda texts: [[("A", 0.6), ("B", 0.5)] if len(t) % 2 == 0 else [("A", 0.1), ("B", 0.2)] for t in texts]


@query(
    "store_topics",
    f"WITH {_CHUNKS}, {_SCORED}, l AS (SELECT *, 'A' AS topic, 0.6 AS topic_prob FROM s WHERE length(chunk) % 2 = 0 UNION ALL SELECT *, 'B', CASE WHEN length(chunk) % 2 = 0 THEN 0.5 ELSE 0.2 END FROM s)"
    f" SELECT date, chunk_id, part, topic, CAST(topic_prob AS DOUBLE) AS topic_prob, 'moritz' AS topic_model, {r('score', 'score')} FROM l WHERE chunk_limit = 200",
)
def store_topics(spark, sf):
    """The labelling job: names are resolved against the label dimension, a row a label over the threshold."""
    s = _scores(spark, sf)
    for _ in range(2):
        scoring.label_job(s, "moritz", _by_length, 200)
    got = s.sentiment(200, with_label=True).select("date", F.col("chunk_id").cast("long").alias("chunk_id"), "part", "topic", "topic_prob", "topic_model", "score")
    return rounded(got, "score")


@query("store_labels", "SELECT * FROM (VALUES (1, 'A', 'about a', 0), (2, 'B', 'about b', 0), (101, 'C', 'about c', 1)) AS t(label_id, name, description, version)")
def store_labels(spark, sf):
    """The label dimension, a scan a version."""
    s = _filled(spark, sf)
    return s.topic_labels(0).withColumn("version", F.lit(0)).unionAll(s.topic_labels(1).withColumn("version", F.lit(1)))


_Q = "CASE WHEN turn % 4 = 0 THEN 'Question: ' || x WHEN turn % 2 = 1 THEN '[' || x || ']' ELSE 'ECB: Mr. J. R. Doe, e.g. ' || x || '...' END"
_TURNS = "p AS (SELECT conv_id, turn, " + _Q + " AS p FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\\t\\[\\]]', ' ', 'g') AS x FROM conversations))"


def _packing(limits: str, keep: str = "") -> str:
    """Chunks of the rows of c (statement_id, pos, t, lim, tail, least and kept columns), by recursion over sentences."""
    k = f", {keep}" if keep else ""
    nk = f", n.{keep}" if keep else ""
    return (
        f"l AS (SELECT * FROM (VALUES {limits}) AS v(lim, least, tail)),"
        f" s AS (SELECT statement_id, pos{k}, lim, tail, unnest(range(len(x))) AS i, unnest(x) AS s FROM {sql_sentences('(SELECT * FROM c, l WHERE length(t) >= least)', f'statement_id, pos{k}, lim, tail', 't')}),"
        " n AS (SELECT *, len(list_filter(string_split_regex(trim(s), '\\s+'), lambda w: w <> '')) AS n FROM s),"
        f" g AS (SELECT statement_id, pos{k}, lim, tail, i, s, n, n AS run, 0 AS part FROM n WHERE i = 0 UNION ALL"
        f" SELECT n.statement_id, n.pos{nk}, n.lim, n.tail, n.i, n.s, n.n, CASE WHEN g.run + n.n <= n.lim THEN g.run + n.n ELSE n.n END, CASE WHEN g.run + n.n <= n.lim THEN g.part ELSE g.part + 1 END"
        " FROM g JOIN n ON n.statement_id = g.statement_id AND n.pos = g.pos AND n.lim = g.lim AND n.i = g.i + 1),"
        f" k AS (SELECT statement_id, pos{k}, lim, tail, part, string_agg(s, ' ' ORDER BY i) AS t, sum(n) AS n, max(part) OVER (PARTITION BY statement_id, pos, lim) AS top FROM g GROUP BY statement_id, pos{k}, lim, tail, part),"
        f" m AS (SELECT statement_id, pos{k}, lim, part, CASE WHEN part = top AND top > 0 AND n < tail THEN part - 1 ELSE part END AS merged, t FROM k),"
        f" u AS (SELECT statement_id, pos{k}, lim, merged, string_agg(t, ' ' ORDER BY part) AS chunk FROM m GROUP BY statement_id, pos{k}, lim, merged),"
        " o AS (SELECT *, row_number() OVER (PARTITION BY statement_id, lim ORDER BY pos, merged) - 1 AS chunk_id FROM u)"
        f" SELECT statement_id{k}, chunk_id, chunk_id / nullif(max(chunk_id) OVER (PARTITION BY statement_id, lim), 0) AS chunk_percentile, lim AS chunk_limit, chunk FROM o"
    )


_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _wide(df):
    return df.withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("chunks_all_limits", with_views("paragraphs", sql=f", c AS (SELECT doc_id AS statement_id, pos, {_SQUEEZE.format('paragraph')} AS t FROM paragraphs), " + sql_boundaries("c", "t") + ", " + _packing("(1, 40, 0), (50, 100, 30), (200, 100, 30), (350, 100, 30)")).replace("WITH ", "WITH RECURSIVE ", 1))
def chunks_all_limits(spark, sf):
    """All four chunk sizes of every document's introduction in one pass, with positions."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("statement_id"), F.lit(None).cast("date").alias("date"), F.replace("text", F.lit("\n"), F.lit("\t")).alias("intro"))
    # counts of words are those of squeezed texts
    return _wide(chunking.intro_chunks(d, known=boundaries.fit(chunking.intro_paragraphs(d), "text")))


_CLEAN = "trim(regexp_replace(regexp_replace(trim(translate(p, '[]', '')), '^(?i)[A-Z ]{1,15}:', ''), '…|\\.{3}', '', 'g'))"
_IS_Q = "(regexp_matches(trim(translate(p, '[]', '')), '^(Question|Q:)') OR (length(p) - length(replace(p, '[', '')) = 1 AND starts_with(p, '[') AND ends_with(p, ']')))"


@query(
    "question_chunks",
    f"WITH RECURSIVE {_TURNS}, c AS (SELECT conv_id AS statement_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, {_IS_Q} AS is_question, {_SQUEEZE.format(_CLEAN)} AS t FROM p), {sql_boundaries('c', 't')}, "
    + _packing("(1, 40, 0), (50, 80, 30), (200, 80, 30), (350, 80, 30)", "is_question"),
)
def question_chunks(spark, sf):
    """Question times as tab-joined cells: paragraphs marked as questions or not, cleaned and packed to all sizes."""
    x = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\[\]]", " ")
    p = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Question: "), x)).when(F.col("turn") % 2 == 1, F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("ECB: Mr. J. R. Doe, e.g. "), x, F.lit("...")))
    cells = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("statement_id")).agg(F.array_sort(F.collect_list(F.struct("turn", p.alias("p")))).alias("rows"))
    s = cells.select("statement_id", F.lit(None).cast("date").alias("date"), F.array_join(F.transform("rows", lambda z: z["p"]), "\t").alias("qa"))
    return _wide(chunking.question_chunks(s, known=boundaries.fit(chunking.question_paragraphs(s), "text")))


@query(
    "transcript_cells",
    "SELECT doc_id, replace(coalesce(text, ''), '\"', '''''') AS intro, replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: length(replace(p, ' ', '')) >= 5 AND NOT regexp_matches(p, '(?i)Transcript of the questions.*President(of the ECB)?')), chr(9)), '\"', chr(39)) AS qa FROM documents",
)
def transcript_cells(spark, sf):
    """Quotes made plain in both cells; short paragraphs and headings left out of the question time."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", tx.normalise_quotes(t, "''").alias("intro"), tx.normalise_quotes(tx.qa_text(F.split(t, "\n")), "'").alias("qa"))


_ESCAPE = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
_PLAIN = "trim(regexp_replace(paragraph, '[^!-~]+', ' ', 'g'))"


def _plain():
    return F.trim(F.regexp_replace("paragraph", "[^!-~]+", " "))


def _pages(spark, sf):
    """A page a document: its lines as paragraphs, odd ones in bold, between a heading, a navigation and footnotes."""
    t = _plain()
    for a, b in _ESCAPE:
        t = F.replace(t, F.lit(a), F.lit(b))
    odd = F.col("pos") % 2 == 1
    p = F.concat(F.lit("<p>"), F.when(odd, F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t), F.lit("</p>"))
    # a page is a document's text: one cell
    rows = paragraphs(spark, sf).select("doc_id", "pos", p.alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda z: z["p"]), "\n")
    head, tail = "<html><body><nav><p>menu</p></nav><main><div class='title'><p>x</p></div><span><p>y</p></span><div class='section'><h2>Head</h2><em>aside</em>", "</div><div class='a footnotes'><p>z</p></div></main></body></html>"
    return rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit(head), body, F.lit(tail)).alias("html"))


_ELEMENTS = f"e AS (SELECT doc_id AS page_id, 0 AS pos, 'Head' AS text, 'Head' AS marked FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, pos + 1, t, CASE WHEN length(t) <= 1 THEN '' WHEN pos % 2 = 1 THEN '[' || t || ']' ELSE t END FROM (SELECT doc_id, pos, {_PLAIN} AS t FROM paragraphs))"


@query("scraped_elements", with_views("paragraphs", sql=f", {_ELEMENTS} SELECT page_id, pos, text, marked FROM e"))
def scraped_elements(spark, sf):
    """Blocks and headings two levels below a page's main part; skipped classes and other elements are left out."""
    return web.elements(_pages(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(
    "scraped_transcripts",
    with_views("paragraphs", sql=f", {_ELEMENTS}, g AS (SELECT page_id, min(pos) FILTER (regexp_matches(text, 'My (first )?question .*')) AS p1, min(pos) FILTER (regexp_matches(text, '(I am[\\w\\s,]{{10,30}}questions\\.)|(We[\\w\\s,]*questions[\\w\\s]*\\.)|(\\s?Click here [\\w\\s,]*answers\\.)') AND pos > 2) AS p2, min(pos) FILTER (regexp_matches(text, 'Transcript of the questions.*ECB')) AS p3 FROM e GROUP BY page_id),"
    " s AS (SELECT page_id, coalesce(CASE WHEN p3 > 0 THEN p3 - 1 END, p2, p1 - 1, -1) AS sep FROM g)"
    " SELECT page_id, replace(coalesce(string_agg(text, chr(9) ORDER BY pos) FILTER (sep < 0 OR pos <= sep), ''), '\"', '''''') AS intro, replace(coalesce(string_agg(marked, chr(9) ORDER BY pos) FILTER (sep >= 0 AND pos > sep AND length(replace(marked, ' ', '')) >= 5 AND NOT regexp_matches(marked, '(?i)Transcript of the questions.*President(of the ECB)?')), ''), '\"', chr(39)) AS qa FROM e JOIN s USING (page_id) GROUP BY page_id"),
)
def scraped_transcripts(spark, sf):
    """Introduction and question time of each page."""
    return web.transcripts(_pages(spark, sf))


@query("year_index", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'https://host/' || year(o_orderdate) || '/' || min(o_orderkey) || '.html' AS url FROM orders GROUP BY CAST(o_orderdate AS DATE), year(o_orderdate)")
def year_index(spark, sf):
    """Entries of year indexes, read from the last to the first; of one date's entries the one read last stays."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").groupBy(day.alias("date")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    link = lambda k: F.concat(F.lit("<dt isodate='"), F.col("date").cast("string"), F.lit("'>d</dt><dd><div class='title'><a href='"), F.year("date").cast("string"), F.lit("/"), F.col(k).cast("string"), F.lit(".html'>t</a></div></dd>"))
    # a year has 366 dates at most
    pages = o.groupBy(F.year("date").alias("year")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", F.concat(link("a"), link("b")).alias("x")))), lambda z: z["x"]), "").alias("body"))
    nested = "<dl><dt isodate='1990-01-01'>n</dt><dd><div class='title'><a href='n'>n</a></div></dd></dl>"
    return web.article_index(pages.select(F.concat(F.lit("<html><body>" + nested + "<div>"), "body", F.lit("</div></body></html>")).alias("html")), "https://host/")


_LABELS = "WITH o AS (SELECT vec_id, unnest(['MP', 'EP', 'FS', 'OI']) AS label, unnest([round(abs(CAST(embedding[i] AS DOUBLE)) + 1.234e-9, 2) FOR i IN [1, 2, 3, 4]]) AS score FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM o)"


@query("best_labels", _LABELS + " SELECT vec_id, label || ',' || CAST(score AS VARCHAR) AS best FROM k WHERE k = 1")
def best_labels(spark, sf):
    """'label,score' of each output's first label."""
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(F.abs(x.cast("double")) + F.lit(1.234e-9), 2))
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1)
    out = F.array_sort(scoring.zipped(F.array(*map(F.lit, ("MP", "EP", "FS", "OI"))), scores), order)
    return table(spark, sf, "embeddings").select("vec_id", scoring.best_label(out).alias("best"))
