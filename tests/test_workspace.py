import pytest
from pyspark.sql import functions as F

from gridwright import Workspace
from gridwright.operators import missing, rows
from gridwright.plans.report import build_report, workspace_report
from gridwright.sources import ingest, text_tables
from gridwright.streaming import FittedCleaning


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


# -- CSV


def test_csv_types_and_tokens(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        'i,f,b,t,mixed,gone,d,suffix,i\n1,1.5,True,x,1,NA,2020-01-01,1d,9\n2,-2e3,false,"a ""q"", b",x,,2020-01-02,2f,8\n'
        "N/A,inf,,null,2,NaN,2020-01-03,3,7\n",
    )
    df = text_tables.read_csv(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "t": "string", "mixed": "string", "gone": "double",
        "d": "string", "suffix": "string", "i.1": "bigint",
    }
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (1, 1.5, True, "x", "1", None, "2020-01-01", "1d", 9)
    assert got[1][3] == 'a "q", b' and got[2][0] is None and got[2][1] == float("inf") and got[2][3] is None


def test_csv_large_whole_numbers_become_decimal(spark, tmp_path):
    df = text_tables.read_csv(spark, write(tmp_path / "t.csv", "n\n1\n99999999999999999999\n"))
    assert dict(df.dtypes) == {"n": "double"}


def test_csv_latin1_fallback_per_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", "name,n\nZoë,1\n")
    write(folder / "b.csv", "name,n\nJosé,2\n", "latin-1")
    df = text_tables.read_csv(spark, str(folder))
    assert sorted(tuple(r) for r in df.collect()) == [("José", 2), ("Zoë", 1)]
    assert [f.rsplit("/", 1)[-1] for f in text_tables.invalid_files(spark, str(folder))] == ["b.csv"]


def test_csv_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        text_tables.read_csv(spark, write(tmp_path / "e.csv", ""))


def test_ingest_recognises_content(spark, tmp_path):
    write(tmp_path / "a.csv", "x\n1\n2\n")
    write(tmp_path / "b.csv", "x\n3\n2\n")
    found = ingest.file_signatures(spark, str(tmp_path / "*.csv"))
    manifest = str(tmp_path / "manifest")
    ingest.remember_files(found.where("name = 'a.csv'"), manifest)
    fresh = ingest.new_files(found, spark.read.parquet(manifest))
    assert [r["name"] for r in fresh.collect()] == ["b.csv"]
    assert {r["size"] for r in found.collect()} == {6}


def test_signature_follows_line_order_and_line_ends_but_not_the_parts_read(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(4000)]
    folder = tmp_path / "f"
    folder.mkdir()
    texts = {
        "same1": "\n".join(lines), "same2": "\n".join(lines), "turned": "\n".join(lines[::-1]), "ended": "\n".join(lines) + "\n",
        "dos": "\r\n".join(lines), "swapped": "\n".join([lines[1], lines[0], *lines[2:]]),
    }
    for name, content in texts.items():
        (folder / name).write_bytes(content.encode())
    digests = lambda: {r["name"]: r["digest"] for r in ingest.file_signatures(spark, str(folder)).collect()}
    whole = digests()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert digests() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert whole["same1"] == whole["same2"] and len(set(whole.values())) == len(texts) - 1


def test_csv_keeps_every_cell(spark, tmp_path):
    df = text_tables.read_csv(spark, write(tmp_path / "breaks.csv", 'a,b\n1,"line one\nline two"\n2,"say ""hi"""\n'))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "line one\nline two"), (2, 'say "hi"')]
    with pytest.raises(ValueError, match="more cells"):
        text_tables.read_csv(spark, write(tmp_path / "long.csv", "a,b\n1,x\n2,y,EXTRA\n"))
    with pytest.raises(ValueError, match="more cells"):
        text_tables.read_csv_text(spark, write(tmp_path / "long2.csv", "a,b\n1,x\n2,y,EXTRA\n"))
    short = text_tables.read_csv(spark, write(tmp_path / "short.csv", "a,b\n1,x\n2\n"))
    assert sorted(map(tuple, short.collect())) == [(1, "x"), (2, None)]
    folder = tmp_path / "orders"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,x\n")
    write(folder / "2.csv", "b,a\ny,2\n")
    write(folder / "3.csv", "a,c\n3,z\n")
    both = text_tables.read_csv(spark, str(folder)).select("a", "b", "c").orderBy("a")
    assert [tuple(r) for r in both.collect()] == [(1, "x", None), (2, "y", None), (3, None, "z")]


def test_forgotten_snapshots_are_deleted(spark, people, tmp_path):
    place = tmp_path / "work"
    work = Workspace(spark, str(place)).load(people, "people")
    work.save()
    work.save()
    assert len(list(place.rglob("*.parquet"))) > 0
    again = Workspace(spark, str(place))
    assert again.restore() and again.save(remember=False) is False
    assert not list(place.glob("*/current/*.parquet")) and again.current.count() == people.count()
    assert not Workspace(spark, str(place)).restore()


# -- workspace


def test_steps_undo_and_log(spark, people):
    work = Workspace(spark).load(people, "people")
    assert work.apply(lambda d: missing.fill_missing(d, "age"), "Fill age")
    assert not work.apply(lambda d: missing.fill_missing(d, "age"), "Fill age")
    assert work.apply(lambda d: rows.drop_missing_rows(d, "sex"), "Drop sex")
    assert work.steps == ["people", "Fill age", "Drop sex"] and work.stats()["rows"] == 5
    assert work.delta()["rows"] == -1 and work.delta()["missing"] < 0
    with pytest.raises(ValueError, match="0 rows"):
        work.apply(lambda d: d.where("false"), "Drop all")
    assert work.undo() and work.stats()["rows"] == 6
    assert work.reset() and work.stats()["missing"] == 12
    assert work.undo() and work.undo() and not work.undo()
    work.log("  ")
    work.log(work.steps[-1])
    assert work.steps[-1] == "Undo" and work.steps.count("") == 0


def test_history_depth_and_long_chains(spark):
    work = Workspace(spark).load(spark.range(5), "range")
    for i in range(15):
        work.apply(lambda d: d.withColumn("id", F.col("id") + 1), f"Step {i}", detect_no_change=False)
    assert len(work.history) == 12 and work.current.agg(F.min("id")).first()[0] == 15
    for _ in range(12):
        assert work.undo()
    assert work.current.agg(F.min("id")).first()[0] == 3


def test_pending_result(spark, people):
    work = Workspace(spark).load(people, "people")
    work.stage(lambda d: d.limit(2))
    assert work.stats()["rows"] == 6
    work.discard()
    with pytest.raises(ValueError):
        work.commit()
    work.stage(lambda d: d.where("id < 2"))
    assert work.commit() and work.stats()["rows"] == 2 and work.pending is None


def test_snapshot(spark, people, tmp_path):
    work = Workspace(spark, str(tmp_path / "w")).load(people, "people")
    assert not Workspace(spark, str(tmp_path / "w")).restore()
    work.apply(lambda d: d.where("id < 3"), "Cut")
    work.target = "sex"
    work.save()
    other = Workspace(spark, str(tmp_path / "w"))
    assert not other.restore(remember=False) and other.restore()
    assert other.stats()["rows"] == 3 and other.raw.count() == 6 and other.target == "sex"
    assert other.steps == ["Loaded saved progress"] and other.history == []
    other.apply(lambda d: d.where("id < 2"), "Cut more")
    other.save()
    assert Workspace(spark, str(tmp_path / "w")).restore()
    other.reset_workspace()
    assert other.current is None and not Workspace(spark, str(tmp_path / "w")).restore()


def test_recovery(spark, people):
    work = Workspace(spark).load(people, "people")
    assert work.check()
    work.apply(lambda d: d.where("id < 3"), "Cut")
    work.current = people.where("false")
    assert not work.check() and work.stats()["rows"] == 6
    work.current, work.history = people.where("false"), []
    assert not work.check() and work.steps[-1] == "Auto-recover: restored uploaded dataset"
    work.current, work.raw = people.where("false"), people.where("false")
    with pytest.raises(ValueError, match="could not be recovered"):
        work.check()


def test_load_path(spark, tmp_path):
    work = Workspace(spark).load_path(write(tmp_path / "T.CSV", "a,b\n1,x\n"))
    assert work.steps == ["Loaded dataset: T.CSV"] and work.current.columns == ["a", "b"]
    with pytest.raises(ValueError, match="empty"):
        Workspace(spark).apply(lambda d: d, "x")


def test_report(spark, people):
    text = build_report(people, people, ["one", "two"], "sex", {"F1": 0.5}, None, ["id"])
    for part in ("Target: **sex**", "- Raw rows: 6", "- Current missing: 12", "| none | 6 |", "- two", "## Baseline"):
        assert part in text
    assert "## Model" not in text and text.count("| 5.0 |") == 6
    work = Workspace(spark).load(people, "people")
    assert "(not selected)" in workspace_report(work)


# -- stream


def test_stream_gets_the_batch_values(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 500.0), (5, None)], "id long, v double")
    fitted = FittedCleaning.fit(batch, fill=["v"], clip=["v"], factor=1.0, flags=["v"])
    source = str(tmp_path / "in")
    batch.where("id < 4").write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(batch.schema).parquet(source)
    fitted.start(stream(), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    batch.where("id >= 4").write.mode("append").parquet(source)
    fitted.start(stream(), out, state).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in fitted.apply(batch).collect()) and len(got) == 5
    assert got[4] == (5, 2.5, 0) and got[3][1] < 500
