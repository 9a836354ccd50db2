"""A CSV of unknown columns gets the narrowest types that hold all its values."""

import datetime

from acctrisk.sources import tables


def read(spark, tmp_path, text):
    (tmp_path / "scores.csv").write_text(text)
    return tables.read_scored(spark, str(tmp_path / "scores.csv"), fmt="csv")


def test_types_blanks_and_missing(spark, tmp_path):
    df = read(spark, tmp_path, (
        "obs,key,score,flag,day,code,nothing,dotted.name\n"
        "1,3000000000,0.25,TRUE,2001-02-28,A,,1\n"
        "0,NA,1e-3,F,NA,,NA,2\n"
        ",7,NA,,2000-01-01,NA,,3\n"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "bigint", "double", "boolean", "date", "string", "boolean", "int"]
    rows = df.collect()
    assert [r["obs"] for r in rows] == [1, 0, None] and [r["key"] for r in rows] == [3000000000, None, 7]
    assert [r["score"] for r in rows] == [0.25, 0.001, None] and [r["flag"] for r in rows] == [True, False, None]
    assert [r["day"] for r in rows] == [datetime.date(2001, 2, 28), None, datetime.date(2000, 1, 1)]
    assert [r["code"] for r in rows] == ["A", "", None] and [r["nothing"] for r in rows] == [None] * 3


def test_late_values_widen(spark, tmp_path):
    n = 5000
    lines = "".join(f"{i},{i},{i},2001-01-01\n" for i in range(n))
    df = read(spark, tmp_path, "a,b,c,d\n" + lines + "1.5,x,99999999999999999999,2001-02-30\n")
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string", "double", "string"]
    assert df.where("a = 1.5 and b = 'x' and d = '2001-02-30'").count() == 1 and df.count() == n + 1


def test_header_only(spark, tmp_path):
    df = read(spark, tmp_path, "a,b\n")
    assert df.columns == ["a", "b"] and df.count() == 0
