import struct

import pytest

from orbweave.operators.graph import Graph
from orbweave.plans.fixtures import successors
from orbweave.sources import edges as files
from orbweave.sources import reports


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_text(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# a comment\n0 1\n1\t2\n\n  3   4 \n")
    assert rows(files.read_text(spark, str(tmp_path / "g.txt"))) == [(0, 1), (1, 2), (3, 4)]
    (tmp_path / "bad.txt").write_text("0 1 2\n")
    with pytest.raises(Exception, match="not an edge"):
        files.read_text(spark, str(tmp_path / "bad.txt")).collect()


def test_binary(spark, tmp_path):
    pairs = [(43459, 0xFFFFFFFF), (1, 2), (1, 2)]
    one = tmp_path / "one.bin"
    one.write_bytes(b"".join(struct.pack("<2I", *p) for p in pairs))
    assert rows(files.read_binary(spark, str(one))) == sorted(pairs)
    assert rows(files.read_binary(spark, str(one), signed=True)) == [(1, 2), (1, 2), (43459, -1)]
    files.write_binary(spark.createDataFrame(pairs, "src long, dst long"), str(tmp_path / "many"))
    assert rows(files.read_binary(spark, str(tmp_path / "many"))) == sorted(pairs)
    one.write_bytes(b"\0" * 12)
    with pytest.raises(ValueError, match="whole number"):
        files.read_binary(spark, str(one))
    with pytest.raises(FileNotFoundError):
        files.read_binary(spark, str(tmp_path / "none.bin"))
    (tmp_path / "empty.bin").write_bytes(b"")
    assert files.read_binary(spark, str(tmp_path / "empty.bin")).count() == 0
    files.write_binary(spark.createDataFrame([(-5, 7)], "src long, dst long"), f"file://{tmp_path}/signed", signed=True)
    assert rows(files.read_binary(spark, str(tmp_path / "signed"), signed=True)) == [(-5, 7)]
    with pytest.raises(Exception, match="four bytes"):
        files.write_binary(spark.createDataFrame([(1 << 32, 7)], "src long, dst long"), str(tmp_path / "wide"))


def test_undirected(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "src long, dst long")
    assert rows(files.undirected(df)) == [(1, 2), (3, 3)]


def test_dot(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2) for k in range(4)], "id long, component long")
    lines = reports.component_dot(df)
    assert rows(lines)[0] == ("  0 [front=white, color=red]",)
    reports.write_lines(lines, str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == 4
    nine = spark.createDataFrame([(k, k) for k in range(9)], "id long, component long")
    with pytest.raises(ValueError, match="palette"):
        reports.component_dot(nine)
    cores = spark.createDataFrame([(1, 3), (2, 1)], "id long, core_value long")
    assert rows(reports.core_dot(cores, 2)) == [("  1 [front=white, color=red]",)]


def test_bench_average(spark, tmp_path):
    for name, times in (("a", (1, 3)), ("b", (5,))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "out.txt").write_text("".join(f"Total computing time: {t} (s)\n" for t in times) + "Loading time: 9 (s)\n")
    assert rows(reports.bench_average(spark, str(tmp_path))) == [("a", 2.0), ("b", 5.0)]


def test_successors_across_buckets(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (70_000, 30), (500_000, 40)], "o long, x long")
    assert rows(successors(df, "o", "x")) == [(10, 20), (20, 30), (30, 40)]


def test_graph_model(spark):
    g = Graph(spark.createDataFrame([(0, 1), (0, 1), (2, 1), (3, 3), (1, 0)], "src long, dst long"))
    assert rows(g.vertices) == [(0,), (1,), (2,), (3,)]
    assert rows(g.degrees) == [(0, 1, 2), (1, 3, 1), (2, 0, 1), (3, 0, 0)]
    assert rows(g.in_neighbors()) == [(0, "1"), (1, "0,0,2")]
    assert rows(g.high(2)) == [(1,)]
    assert rows(g.load_stats(2, 2)) == [(3, 1, 0, 1)]
    assert rows(g.partition_sizes(2)) == [(0, 2, 1), (1, 2, 3)]


def test_command_line(spark, tmp_path, capsys):
    from orbweave.__main__ import main

    (tmp_path / "g.txt").write_text("0 1\n1 2\n1 3\n2 3\n3 4\n")
    main(["sssp", "-g", str(tmp_path / "g.txt"), "-s", "0", "-o", str(tmp_path / "out")], spark)
    said = capsys.readouterr().out
    assert "Iteration: 1, global_active vertices: 2" in said
    assert "Total computing time: " in said and "Loading time: " in said and "low_master: 5" in said
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)]
    files.write_binary(spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long"), str(tmp_path / "g.bin"))
    main(["kcore", "-g", str(tmp_path / "g.bin"), "-k", "2", "-p", str(tmp_path / "dot")], spark)
    assert rows(spark.read.text(str(tmp_path / "dot"))) == [(f"  {k} [front=white, color=red]",) for k in (1, 2, 3)]
    main(["cc", "-g", str(tmp_path / "g.bin"), "-p", str(tmp_path / "dot2")], spark)
    assert rows(spark.read.text(str(tmp_path / "dot2")))[0] == ("  0 [front=white, color=red]",)
    with pytest.raises(SystemExit):
        main(["pagerank"], spark)
