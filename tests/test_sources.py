"""Sources: CSV files cut in ranges."""

import random

import pytest

from starling.sources import io, quoted_csv


@pytest.fixture
def small_ranges(spark):
    """Ranges of 3,000 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, name, rows, end, header='id,"te\nxt",lang'):
    with open(f"{folder}/{name}", "w", newline="") as out:
        out.write(header + end)
        for i, text, lang in rows:
            out.write(f'{i},"' + text.replace('"', '""') + f'",{lang}' + end)


def texts(seed, n, parts=("a", "b,", "\n", '"', "\n\n", "é", "xyz", " ", "")):
    rng = random.Random(seed)
    return [(str(seed * 10_000 + i), "x" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), rng.choice(["en", "", "de"])) for i in range(n)]


def test_equals_the_reader_of_whole_files(spark, small_ranges, tmp_path):
    for f in range(3):
        write(tmp_path, f"{f}.csv", texts(f, 400), "\n")
    path = f"file://{tmp_path}/*.csv"
    columns = ["id", "text", "lang"]
    assert quoted_csv._lines(spark, path).rdd.getNumPartitions() > 15  # several a file
    got = sorted(map(tuple, quoted_csv.read_quoted_csv(spark, path, columns).collect()), key=str)
    assert got == sorted(map(tuple, io.read_text_csv(spark, path, columns).collect()), key=str) and len(got) == 1200


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_ranges(spark, small_ranges, tmp_path, end):
    rows = texts(5, 300, ("a", "b,", end, '"', "é", "xyz"))
    rows[7] = ("7", ("long line" + end) * 3000 + '"', "en")  # ten ranges and more
    rows[9] = ("9", '""' * 5000, "de")
    write(tmp_path, "a.csv", rows, end, header='id,"' + ("t" + end) * 4000 + '",lang')  # so is the header
    with open(f"{tmp_path}/a.csv", "a", newline="") as out:
        out.write(end + end + "1,plain,")  # empty lines, an unquoted record, no last line end
    got = sorted(tuple(r) for r in quoted_csv.read_quoted_csv(spark, f"file://{tmp_path}/a.csv", ["id", "text", "lang"]).na.fill("").collect())
    assert got == sorted([*rows, ("1", "plain", "")])


def test_edges(spark, small_ranges, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,text\n")
    (tmp_path / "open.csv").write_text('id,text\n1,a\n2,"b\nc\n')
    (tmp_path / "short.csv").write_text('id,text\n3\n4,"",x\n')

    def read(name, header=True):
        return sorted(map(tuple, quoted_csv.read_quoted_csv(spark, f"file://{tmp_path}/{name}", ["id", "text"], header).collect()), key=str)

    assert read("none.csv") == [] == read("head.csv") and read("head.csv", header=False) == [("id", "text")]
    assert [r[0] for r in read("open.csv")] == ["1", "2"] and "b\nc" in read("open.csv")[1][1]
    whole = io.read_text_csv(spark, f"file://{tmp_path}/short.csv", ["id", "text"]).collect()  # fields that lack, fields too many
    assert read("short.csv") == sorted(map(tuple, whole), key=str) and [r[0] for r in whole] == ["3", "4"]
