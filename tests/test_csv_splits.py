"""CSV files with line breaks in quotes: any split gives the rows of one task."""

from __future__ import annotations

import random

import pytest

from procsift.sources.csvsplits import read_broken_csv


def whole(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def split_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda n: [spark.conf.set(name, str(n)) for name in names]
    for n, v in before.items():
        spark.conf.set(n, v)


def table(seed, end, n=60):
    draw = random.Random(seed)
    values = ["plain", '"say ""hi"", twice"', f'"two{end}lines"', f'"{end}{end}"', '""', "", '"a,b"', f'"""{end}"""', "é ü"]
    lines = ["id,first,second,third"]
    lines += [f"{i}," + ",".join(draw.choice(values) for _ in range(3)) for i in range(n)]
    return lines


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_equals_one_task(spark, tmp_path, split_bytes, end):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for seed in (1, 2):
        text = end.join(table(seed, end)) + (end if seed == 1 else "")
        (folder / f"part{seed}.csv").write_bytes(text.encode())
    want = rows(whole(spark, str(folder)))
    assert len(want) == 120
    for size in (1 << 20, 97):
        split_bytes(size)
        if size < 100:
            assert spark.read.text(str(folder)).rdd.getNumPartitions() >= 13
        got = read_broken_csv(spark, str(folder))
        assert got.columns == ["id", "first", "second", "third"]
        assert rows(got) == want


def test_a_value_over_many_splits(spark, tmp_path, split_bytes):
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,"' + "line of text\n" * 300 + 'end"\n2,"x\ny"\n\n  \n3,z\n')
    split_bytes(64)
    assert rows(read_broken_csv(spark, str(path))) == rows(whole(spark, str(path)).where("a in ('1', '2', '3')"))


def test_what_quotes_do_not_tell_is_read_whole(spark, tmp_path):
    for i, text in enumerate(['a,b\n1,5" disk\n2,"x\ny"\n', 'a,b\n1,"x"y\n', 'a,b\r1,"x\ny"\r']):
        path = tmp_path / f"odd{i}.csv"
        path.write_bytes(text.encode())
        assert read_broken_csv(spark, str(path)) is None


def test_a_quote_that_never_closes(spark, tmp_path, split_bytes):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,x\n2,"never\nclosed\n')
    split_bytes(8)
    assert read_broken_csv(spark, str(path)) is None


def test_header_only_and_one_record(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text('"a\nb",c\n')
    got = read_broken_csv(spark, str(path))
    assert got.collect() == [] and got.columns == whole(spark, str(path)).columns
