"""Store, files, streams."""

import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.schema import EVENT_STUDY
from tidemark.sources import files, html
from tidemark.sources.store import Store, numbered, page_ranges, scratch, seeded_sample
from tidemark.streaming import jobs


def filled(spark, home):
    s = Store(spark, str(home))
    s.create(confirm=True)
    s.put_statements(spark.createDataFrame([(dt.date(2020, 1, 1), "a"), (dt.date(2020, 2, 1), "b")], "date date, url string"))
    qa = spark.createDataFrame([(1, 0, True, k, "why the rise?") for k in (50, 200)] + [(1, 1, False, 200, "that is why")], "statement_id long, chunk_id int, is_question boolean, chunk_limit int, chunk string")
    intro = spark.createDataFrame([(2, 0, 200, "the rise the fall")], "statement_id long, chunk_id int, chunk_limit int, chunk string")
    s.put_chunks(intro, qa)
    s.put_topic_labels({"A": "about a", "B": "about b"})
    return s


def test_jobs_are_idempotent(spark, tmp_path):
    s = filled(spark, tmp_path / "store")
    assert {r[0] for r in s.limits().collect()} == {50, 200} and s.chunks(200).count() == 3 and s.chunks(None).count() == 4
    load = scoring.lexicon_scorer(("the",), ("that",))
    for _ in range(2):  # a second run replaces the first
        scoring.sentiment_job(s, "finbert", load, 200, save=True)
        scoring.sentiment_job(s, "finbert", load, 50, save=True)
    assert s.sentiment(200).count() == 3 and s.sentiment(None).count() == 4
    topics = lambda: lambda texts: [[("A", 0.6), ("B", 0.5)] if "rise" in t else [("A", 0.1), ("B", 0.2)] for t in texts]
    for _ in range(2):
        scoring.label_job(s, "facebook", topics, 200)
    got = s.sentiment(200, with_label=True)
    assert got.count() == 5  # two chunks with two labels, one with its best
    assert {r.part for r in got.collect()} == {"IS", "QA"}
    s.clear("sentiments", 200, 1)
    assert s.sentiment(200).count() == 0
    assert "chunk_rowid" in s.ddl()["chunks"]


def test_create_wants_confirmation(spark, tmp_path):
    try:
        Store(spark, str(tmp_path)).create()
    except PermissionError:
        return
    raise AssertionError


def test_transcripts_round_trip(spark, tmp_path):
    rows = [(1, "2020-01-01", "u", "a\tb", "[q]\tans"), (2, "2020-02-01", "v", "c", None)]
    df = spark.createDataFrame(rows, "statement_id long, date string, url string, intro string, qa string")
    files.write_transcripts(df, str(tmp_path / "t"))
    got = files.read_transcripts(spark, str(tmp_path / "t")).orderBy("statement_id").collect()
    assert got[0].intro == "a\tb" and got[1].qa is None and got[0].date == dt.date(2020, 1, 1)


def workbook() -> bytes:
    rows = [["date", "OIS_1M", "other", "STOXX50"], ["1/2/2020", "0.5", "x", "1.25"], ["43863", "", "y", ""], ["2020-03-05", "2", "z", "-1"]]
    return files.workbook({"a & \"b\"": [["1"]], "Press Conference Window": rows})


def test_wide_workbook():
    names = [f"<{i}>" for i in range(60)]
    book = files.workbook({"s": [names, [str(i) for i in range(60)], []]})
    assert list(files.sheet_rows(book, "s")) == [{n: str(i) for i, n in enumerate(names)}, {}]
    assert list(files.sheet_rows(book, "s", (names[3], names[40], "none"))) == [{names[3]: "3", names[40]: "40"}, {}]


def test_fetched_pages(spark):
    import urllib.error

    def open_url(url, timeout):
        if "bad" in url:
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        return io.BytesIO(f"<p>{url} é".encode())

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "page_id long, url string")
    assert sorted(map(tuple, html.fetched(df, open_url).collect())) == [(1, "a", "<p>a é"), (3, "c", "<p>c é")]


def test_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    got = files.read_event_study(spark, str(tmp_path / "w.xlsx")).orderBy("date").collect()
    assert [r.date for r in got] == [dt.date(2020, 2, 1), dt.date(2020, 3, 5)]  # the row without values is gone
    assert got[0].OIS_1M == 0.5 and got[0].OIS_3M is None and got[0].__fields__ == EVENT_STUDY.names


def test_result_tables(spark, tmp_path):
    df = spark.createDataFrame([("Full", "f", "f", 0, 0.5, 0.1, None, 20, "y"), ("Full", "f", "f", 0, 0.5, 0.1, None, 20, "y")], "Era string, Feature string, Base string, Lag int, r double, p double, sig string, n int, target string")
    files.write_table(df, str(tmp_path / "c"))
    got = files.read_correlations(spark, str(tmp_path / "c")).collect()
    assert len(got) == 1 and got[0].sig == ""


def test_numbers_pages_samples(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [(r.k, r.rn) for r in numbered(df, "k").collect() if r.k != r.rn] == []
    got = page_ranges(df, "k", 400).orderBy("page").collect()
    assert [(r.first, r.last, r.n) for r in got] == [(0, 399, 400), (400, 799, 400), (800, 999, 200)]
    a, b = ({r.k for r in seeded_sample(df.repartition(n), "k", 50).collect()} for n in (1, 7))
    assert a == b and len(a) == 50


def test_endpoint_errors_keep_their_places(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id int, text string")

    def ask(prompt):
        if "t10" in prompt:
            raise TimeoutError
        return '{"results": [{"topic": "x", "sentiment": 0.5}]}'

    got = {r.key: r.topic for r in scoring.batch_replies(scoring.prompt_batches(df, "id", "text"), ask).collect()}
    assert len(got) == 25 and [k for k, v in got.items() if v == "x"] in ([0, 20], [20, 0])


def test_streamed_pairs(spark, tmp_path):
    rows = [(1, 0, False, 9.0), (1, 1, True, 1.0), (1, 2, False, 4.0), (1, 3, True, 5.0), (1, 4, False, 6.0), (1, 5, True, 0.0)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "conv_id long, turn int, is_question boolean, score double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("conv_id long, turn int, is_question boolean, score double").parquet(src)
    q = jobs.question_answer_pairs(stream).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.pair_id, r.q_score, r.a_score) for r in spark.table("pairs").collect()) == [(0, 1.0, 4.0), (1, 5.0, 6.0)]


def test_streamed_replacement(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0.5, 200, 1), (2, 0.1, 50, 1)], "chunk_rowid long, score double, chunk_limit int, model_id int").write.parquet(src)
    for i in range(2):
        stream = spark.readStream.schema("chunk_rowid long, score double, chunk_limit int, model_id int").parquet(src)
        jobs.replace_scores(stream, out, str(tmp_path / f"cp{i}")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2


def test_unclosed_elements(spark):
    """Implied ends, in pages that would nest without end."""
    many = "".join(f"<p>par {i} <b>bold" for i in range(3000))
    got = html.page_elements(f"<main><div>{many}</div></main>")
    assert len(got) == 3000 and got[0] == ("par 0  bold", "par 0 [bold]") and got[-1] == ("par 2999  bold", "par 2999 [bold]")
    plain = html.page_elements("<main><div>" + "<p>par" * 100_000 + "</div></main>")
    assert len(plain) == 100_000 and set(plain) == {("par", "par")}
    deep = html.page_elements("<main><div><p>" + "<i>x" * 5000 + "</p><ul><li>a<li>b<ol><li>c</ol><li>d</ul></div></main>")
    assert deep[0][1] == "" and deep[1] == ("a  b  c  d", "")
    dts = "".join(f"<dt isodate='2000-01-{i:02d}'>d<dd><div class='title'><a href='{i}'>t</a></div>" for i in range(1, 30))
    assert html.index_links(f"<div>{dts}</div>") == [(f"2000-01-{i:02d}", str(i)) for i in range(29, 0, -1)]


def versions(spark):
    from tidemark.sources.manifest import Versions

    schema = spark.createDataFrame([], "v int, k int").schema
    return Versions(spark, scratch(spark, "versions"), schema, ["k"])


def held(df):
    return sorted(map(tuple, df.collect()))


def test_readers_keep_their_version(spark):
    t = versions(spark)
    rows = lambda *x: spark.createDataFrame(list(x), "v int, k int")
    assert held(t.read()) == [] and t.latest()[0] == -1
    t.append(rows((1, 1), (2, 2)))
    before = t.read()
    t.append(rows((3, 1)))
    t.replace_part(rows((9, 1)), {"k": 1})
    assert held(t.read()) == [(2, 2), (9, 1)]
    t.replace_part(rows(), {"k": 2})  # nothing comes, what was there goes
    assert held(t.read()) == [(9, 1)]
    t.replace(rows((7, 7)))
    assert held(before) == [(1, 1), (2, 2)] and held(t.read()) == [(7, 7)]
    t.replace_part(None, {"k": 7})
    assert held(t.read()) == [] and held(before) == [(1, 1), (2, 2)]
    t.append(rows((5, 5)))
    assert t.vacuum() > 0 and held(t.read()) == [(5, 5)]


def test_failed_writes_leave_the_version(spark):
    t = versions(spark)
    t.append(spark.createDataFrame([(1, 1)], "v int, k int"))
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("int")).otherwise(1).alias("v"), F.lit(1).alias("k"))
    with pytest.raises(Exception, match="no"):
        t.replace(bad)
    assert held(t.read()) == [(1, 1)] and t.latest()[0] == 0


def test_a_dead_writers_version_does_not_count(spark, monkeypatch):
    from tidemark.sources import manifest

    monkeypatch.setattr(manifest, "WAIT", 0.3)
    t = versions(spark)
    rows = spark.createDataFrame([(1, 1)], "v int, k int")
    t.append(rows)
    p, fs = t._path("_versions", f"{1:012d}.json")
    fs.create(p, False).close()
    assert held(t.read()) == [(1, 1)]
    assert t.append(rows) == 2 and held(t.read()) == [(1, 1), (1, 1)]


def test_writers_at_once_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    t = versions(spark)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: t.append(spark.createDataFrame([(i, i % 2)], "v int, k int")), range(8)))
    assert held(t.read()) == [(i, i % 2) for i in range(8)] and t.latest()[0] == 7
