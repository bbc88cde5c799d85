import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from textlabels.sources import csv_split as C
from textlabels.sources import tables as S

SCHEMA = "id int, text string, x string"
OPTIONS = {**S._CSV_READ, **S._TIMES}
NASTY = ('id,text,x\n1,"a\nb ""q"" c",5\n2,plain "mid" quote,6\n\n3,"",7\n4,,8\n5,"x\r\ny",9\r\n6,"tail ""\n\n""end",\n7, sp ," z "\n'
         '8,"abc"def,3\n9,"é\n\n\n,,\n"",""\n日本",\n10,"""\n""","\n"\n11,"a,\n1,b","\n12,"\n12,last,""""')


@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("size", [7, 9, 16, 23, 1000])
def test_borders_everywhere_give_what_one_task_reads(spark, tmp_path, split_bytes, size):
    path = write(tmp_path / "a.csv", NASTY)
    want = rows(S.read_table(spark, path, "csv", SCHEMA, splits=False))
    split_bytes(size)
    df = S.read_table(spark, path, "csv", SCHEMA)
    assert rows(df) == want and len(want) == 12
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1 or size == 1000


def test_random_files_at_random_borders(spark, tmp_path, split_bytes):
    rng = random.Random(4)
    written = []
    for k in range(4):                       # several files, one of them with a field longer than many splits
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if k == 2 else csv.QUOTE_MINIMAL)
        w.writerow(["id", "text", "x"])
        for i in range(25):
            text = "".join(rng.choice(['"', "\n", ",", "a", "é", " ", "b"]) for _ in range(rng.choice([3, 9, 40, 900 if k == 1 else 5])))
            written.append((100 * k + i, text, "end"))
            w.writerow(written[-1])
        write(tmp_path / f"{k}.csv", out.getvalue())
    want = sorted(written, key=repr)
    for size in (61, 1 << 20):
        split_bytes(size)
        assert rows(S.read_table(spark, str(tmp_path), "csv", SCHEMA)) == want


def test_one_file_is_read_by_as_many_tasks_as_it_has_splits(spark, tmp_path, split_bytes):
    path = write(tmp_path / "big.csv", "id,text,x\n" + "".join(f'{i},"line one\nline ""two"" {i}",x\n' for i in range(2000)))
    size = (tmp_path / "big.csv").stat().st_size
    split_bytes(4096)
    df = S.read_table(spark, path, "csv", SCHEMA)
    tasks = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= size // 4096 and max(t["count"] for t in tasks) < 3 * 2000 * 4096 / size
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "Scan csv" not in plan
    assert df.count() == 2000 and df.select("id").distinct().count() == 2000


def test_the_header_may_span_lines_and_splits(spark, tmp_path, split_bytes):
    path = write(tmp_path / "h.csv", 'id,"text\nof\nmany\nlines","x"\n1,a,b\n')
    for size in (5, 9, 1000):
        split_bytes(size)
        assert rows(S.read_table(spark, path, "csv", SCHEMA)) == [(1, "a", "b")]
        assert len(rows(S.read_table(spark, path, "csv", SCHEMA, header="false"))) == 2


def test_other_separators_empty_files_and_types(spark, tmp_path, split_bytes):
    split_bytes(12)
    path = write(tmp_path / "t.csv", "id;ts;d\n1;2020-01-02T03:04:05.123456Z;1.5\n2;;'a;\n''b'\n")
    df = S.read_table(spark, path, "csv", "id int, ts timestamp, d string", sep=";", quote="'", escape="'")
    assert [(r.id, r.ts is None, r.d) for r in df.orderBy("id").collect()] == [(1, False, "1.5"), (2, True, "a;\n'b")]
    assert rows(S.read_table(spark, write(tmp_path / "e.csv", ""), "csv", SCHEMA)) == []
    assert rows(S.read_table(spark, write(tmp_path / "o.csv", "id,text,x\n"), "csv", SCHEMA)) == []


def test_unknown_options_are_left_to_the_reader():
    assert C.can_split(OPTIONS) and C.can_split({**OPTIONS, "SEP": ";"})
    for change in ({"comment": "#"}, {"encoding": "latin1"}, {"escape": "\\"}, {"multiLine": "false"}, {"lineSep": "\r"}, {"quote": ""},
                   {"ignoreLeadingWhiteSpace": "true"}, {"mode": "DROPMALFORMED"}, {"sep": '"'}):
        assert not C.can_split({**OPTIONS, **change})


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"" ",', False, False),
    ('","', False, True), ('"a"b"c', False, False), ('","x"', False, False), ('', False, True), ('""', False, True), ('"",""",', True, False)])
def test_open_after(line, outside, inside):
    q = C.Quotes(b'"', b",")
    assert [q.open_after(line.encode(), s) for s in (False, True)] == [outside, inside]
