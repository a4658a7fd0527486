from lexmill.operators import html
from lexmill.sources import files
from lexmill.streaming import windows


def test_text_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a b\n a::c  b\n", encoding="utf-8")
    assert {r.word for r in files.wordset(spark, str(tmp_path / "w.txt")).collect()} == {"a", "b", "a::c"}
    assert sorted(r.words for r in files.expert_list(spark, str(tmp_path / "w.txt")).collect()) == [["a"], ["a", "c"], ["b"]]
    (tmp_path / "c.txt").write_text("# no\nx # y\n\nz\n", encoding="utf-8")
    assert [r.value for r in files.commented_lines(spark, str(tmp_path / "c.txt"), cut_comments=True).collect()] == ["x", "z"]
    (tmp_path / "t.txt").write_bytes(b"a\r\nb")
    assert files.whole_text(spark, str(tmp_path / "t.txt")).first().text == "a\r\nb"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "number long, status string")
    out = str(tmp_path / "store")
    files.save_new(rows, out, "number")
    files.save_new(rows, out, "number")
    assert sorted(r.number for r in spark.read.parquet(out).collect()) == [-2, 1]
    assert files.article(spark, out, 2).first().status == "bad"
    files.write_terms(spark.createDataFrame([("b",), ("a",)], ["term"]), str(tmp_path / "terms"), min_count=5)
    assert [r.value for r in spark.read.text(str(tmp_path / "terms")).collect()] == ["# min_count: 5", "", "a", "b"]
    previews = spark.createDataFrame([(1, "t"), (2, "u")], "number long, topic string")
    files.save_topics(previews, previews.limit(0), str(tmp_path / "topics"))
    assert files.topic_previews(spark, str(tmp_path / "topics"), "u").count() == 1


def test_pages(spark):
    page = '<html><head><title>x</title></head><body><h2 class="right-title">Текст научной работы на тему «О коде»</h2><div class="ad">no</div><p class="abstract">кратко<p>второй</p><a href="/article/n/z">s</a></body></html>'
    got = html.library_article(html.parse(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))).orderBy("page_id").collect()
    assert (got[0].status, got[0].title, got[0].abstract, got[0].similar) == ("ok", "О коде", "кратко", ["/article/n/z"])
    assert "no" not in got[0].paragraphs and got[1].status == "title_not_found"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(60)")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(source)
    windows.run_to_table(spark, source, sink, str(tmp_path / "check"))
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(sink).collect()}
    want = {(r.start, r.event_type): (r.n, r.total) for r in windows.tumbling_counts(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())
