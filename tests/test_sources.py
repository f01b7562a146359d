import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import graph, provenance
from chronoweave.sources import core_store, readers, sinks


def put(tmp_path, name, text, mode="w"):
    path = tmp_path / name
    if mode == "wb":
        path.write_bytes(text)
    else:
        path.write_text(text)
    return str(path)


def test_news_csv(spark, tmp_path):
    raw = b',Date,Article_title,Stock_symbol,Article\n0,2020-01-02 03:04:05 UTC,"A ""q"" title",NA,"two\nlines, here"\n1,2020,nan,None,\xff bad\n2,2020,only'
    got = readers.raw_news(spark, put(tmp_path, "n.csv", raw, "wb")).collect()
    assert [(r.row, r.title, r.ticker, r.body) for r in got] == [("0", 'A "q" title', "NA", "two\nlines, here"), ("1", "nan", "None", "� bad")]
    assert got[0].publisher == ""
    dated = readers.parsed_dates(spark.createDataFrame([("2020-01-02 03:04:05 UTC",), ("x",)], "date string")).collect()
    assert [r.ts for r in dated] == [dt.datetime(2020, 1, 2, 3, 4, 5)]


def test_article_files(spark, tmp_path):
    lines = put(tmp_path, "a.jsonl", '{"id": "1", "date": "d", "body": "b"}\n{"id": "2", "date": "d", "body": "c"}\n')
    assert {(r.id, r.ticker) for r in readers.articles(spark, lines).collect()} == {("1", ""), ("2", "")}
    array = put(tmp_path, "a.json", '[{"id": "1", "date": "d", "body": "b", "ticker": "T"}]')
    assert readers.articles(spark, array).first().ticker == "T"
    with pytest.raises(ValueError):
        readers.articles(spark, put(tmp_path, "b.jsonl", '{"id": "1"}\n'))
    for text in ('[{"x": 1}, {"x": 2}]', '{"x": 1}\n\n{"x": 2}\n'):
        assert [r.x for r in readers.json_any(spark, put(tmp_path, "j", text), "x int").collect()] == [1, 2]


def test_small_readers(spark, tmp_path):
    done = put(tmp_path, "done.jsonl", '{"id": "1", "n": 2}\n{"id": "2"}\n{"id": "3')
    assert {r.id for r in readers.done_ids(spark, done).collect()} == {"1", "2"}
    assert [r.name for r in readers.lines(spark, put(tmp_path, "l.txt", "NA\t3\n\nb\n")).collect()] == ["NA", "b"]
    got = readers.records(spark, put(tmp_path, "r.json", '{"0": {"ticker": "A", "title": "x"}, "1": {"ticker": "B", "title": "y"}}'), "ticker string, title string").collect()
    assert [(r.place, r.ticker) for r in got] == [(0, "A"), (1, "B")]
    text = "id,date,ticker,publisher,h,h_type,r,o,o_type,valid\n1,d,,,nan,COMP,Has,b,COMP,True\n2,d,,,a,COMP,Has,,COMP,true\n3,d,,,a,COMP,Has,b,COMP,False\n"
    rows = readers.usable(readers.mentions(spark, [put(tmp_path, "m1.csv", text), put(tmp_path, "m2.csv", text)]))
    assert [(r.id, r.h) for r in rows.collect()] == [("1", "nan")] * 2
    pack = put(tmp_path, "p.jsonl", '{"theme": 1, "members": [{"name": "a", "excess": 2.5}], "headlines": []}\n')
    assert readers.packs(spark, pack).first().members[0].excess == 2.5


def test_core_round_trip(spark, tmp_path):
    rows = [(f"2024-01-{1 + 7 * w:02d}", s, r, o) for w in range(4) for s, r, o in (("nan", "Has", "NA"), ("None", "Raise", "x y"), ("Zacks", "Has", "nan"))]
    rows += [rows[0]]
    frame = spark.createDataFrame([(k, dt.datetime.fromisoformat(d), s, r, o) for k, (d, s, r, o) in enumerate(rows)],
                                  "article int, ts timestamp_ntz, head string, relation string, tail string")
    entities = graph.entity_dictionary(frame).select("name", F.col("id").cast("int").alias("id"), F.lit("COMP").alias("type"))
    relations = spark.createDataFrame([("Has", 0), ("Raise", 1)], "name string, id int")
    coded = graph.encode(graph.assemble(frame), graph.entity_dictionary(frame)).join(
        relations.select(F.col("name").alias("rel"), "id"), "rel").select("subj", F.col("id").alias("rel"), "obj", "time", "weight")
    path = str(tmp_path / "core")
    core_store.store(entities, relations, graph.time_dictionary(graph.bucketed(frame)), coded, path)
    kg = core_store.TemporalGraph.load(spark, path)
    assert (kg.n_entities, kg.n_relations, kg.n_times) == (5, 2, 4)
    assert sorted(tuple(map(int, r)) for r in kg.edges.collect()) == sorted(tuple(map(int, r)) for r in coded.collect())
    assert {r.name for r in kg.entities.collect()} == {"nan", "NA", "None", "x y", "Zacks"}
    assert {(r.subj_name, r.obj_name, str(r.date)) for r in kg.named().collect()} >= {("nan", "NA", "2024-01-01")}
    assert all(r.ok for r in core_store.check(spark, path).collect())
    fewer = core_store.TemporalGraph.load(spark, path, drop_brands=True, drop_relations=("Raise",))
    assert fewer.edges.count() == 4 and fewer.n_entities == 5


def test_sinks(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("id"), (F.col("id") * 2).alias("v"))
    out = str(tmp_path / "out")
    assert sinks.resumable(spark, rows.where("v < 20"), out, lambda b: b, batch_rows=4) == 10
    assert sinks.resumable(spark, rows, out, lambda b: b, batch_rows=10) == 15
    assert spark.read.parquet(out).select("id").distinct().count() == 25
    new = sinks.upsert(rows, spark.createDataFrame([("3", 99)], "id string, v long"), "id")
    assert {r.v for r in new.where("id = '3'").collect()} == {99} and new.count() == 25
    for _ in range(2):
        sinks.append_csv(rows.limit(2), str(tmp_path / "c"))
        sinks.append_json(rows.limit(2), str(tmp_path / "j"))
    assert readers.csv(spark, str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.list_file(rows, "id", str(tmp_path / "l"))
    sinks.json_lines(rows.select(F.struct("id").alias("s")), str(tmp_path / "jl"))
    assert readers.lines(spark, str(tmp_path / "l")).count() == spark.read.json(str(tmp_path / "jl")).count() == 25


def test_window_edges_are_closed(spark):
    themes = spark.createDataFrame([(1, dt.date(2024, 2, 5))], "theme int, birth date")
    members = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "theme int, name string, excess double")
    days = ["2024-01-07", "2024-01-08", "2024-02-12", "2024-02-13"]
    rows = spark.createDataFrame([(k, dt.datetime.fromisoformat(d), "a", "b") for k, d in enumerate(days)], "article int, ts timestamp_ntz, head string, tail string")
    hits = provenance.member_hits(rows, themes, members)
    assert {(r.article, r.name) for r in hits.collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    row = provenance.cohesion(hits, themes, members).first()
    assert (row.n_binding, row.pair_coverage, row.mean_members) == (2, 1.0, 2.0)


def test_news_csv_keeps_every_text(spark, tmp_path):
    """White space at either end, line ends, quotes and NULs come back as they were; a blank text is a text."""
    from chronoweave.plans import source_queries

    texts = [" a", "a ", "\ta\t", "\na\n", "a\r\nb\r", " ", "\n", 'q"q', '"', "a,\n\"b\",\r\n", "\0", '\0"', 'x\0"y,z', "\\", "#c"]
    rows = [(k, t, None if k % 2 else t, "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.row): (r.title, r.body) for r in source_queries.news_csv(spark, str(tmp_path)).collect()}
    assert got == {k: (l or "", t) for k, t, l, _ in rows}
