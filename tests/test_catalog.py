"""Every query against its SQL on the smallest tables, and operators on small frames."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siltworks import catalog, sources
from siltworks.functions import code as C
from siltworks.functions import text as T
from siltworks.operators import corpus, evaluate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: None if v is None or v != v else repr(round(float(v), 8) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([fix(v) for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert plain([tuple(r) for r in df.select(*cols).collect()]) == plain([[r[k] for k in order] for r in want.fetchall()])


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_cleaning(spark):
    assert one(spark, 'a /* x */ b // c\n"/* no */" d', T.remove_comments_safe) == 'a   b \n"/* no */" d'
    assert one(spark, "int  a=b ;\n{ }", T.normalize_whitespace) == "int a = b;{}"
    assert one(spark, "x /* open", T.remove_comments) == "x /* open" and one(spark, "x /* open", T.remove_comments_safe) == "x  "
    assert one(spark, '"' + "a\\\\" * 100_000 + '" z', T.remove_comments_safe).endswith("z")
    assert [one(spark, str(n), lambda c: T.format_bytes(c.cast("double"))) for n in (5, 2048, 3 * 1024**2)] == ["5.0 B", "2.0 KB", "3.0 MB"]


def test_long_texts_are_safe(spark):
    t = "word " * 40_000 + "f(int a) { return a; }"
    df = T.file_metrics(spark.createDataFrame([(t,)], "text string")).select("functions", "lines_total").first()
    assert df["lines_total"] == 1 and df["functions"] == 1
    s = spark.createDataFrame([(t, t)], "o string, p string").select(F.size(C.semantic_issues(F.col("o"), F.col("p")))).first()[0]
    assert s == 0


def test_tokens(spark):
    assert one(spark, "integer_var int point;", C.keychar_tokens) == [*"integer_var ", "int", *" po", "int", ";"]  # only the end of a keyword is checked
    assert one(spark, "int a", C.keychar_tokens) == ["int", " ", "a"]
    assert one(spark, "aé", lambda c: C.char_ids(C.char_tokens(c))) == [102, 0]
    assert [tuple(x) for x in one(spark, "ab", lambda c: C.spans(C.char_tokens(c)))] == [("a", 0, 1), ("b", 1, 2)]
    got = spark.createDataFrame([(1,)], "i int").select(*C.encoded(F.array(F.lit(3), F.lit(4)), 4)).first()
    assert got[0] == [3, 4, 0, 0] and got[1] == [1, 1, 0, 0]


def test_statistics():
    assert evaluate.student_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-5)
    assert evaluate.student_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)


def test_sources_and_offsets(spark, tmp_path):
    (tmp_path / "r1/src").mkdir(parents=True)
    (tmp_path / "r1/src/a.c").write_bytes(b"int a;\r\nb\x80\x00")
    (tmp_path / "r1/b.h").write_text("// x")
    (tmp_path / "r1/c.txt").write_text("no")
    rows = {(r["repo"], r["path"]): r["text"] for r in sources.source_files(spark, str(tmp_path)).collect()}
    assert rows == {("r1", "src/a.c"): "int a;\nb�", ("r1", "b.h"): "// x"}
    lines = spark.createDataFrame([(k, "é" * k) for k in range(20)], "k long, text string")
    got = {r["k"]: r["line_offset"] for r in corpus.offsets(lines, ["k"]).collect()}
    assert got == {k: sum(2 * j + 1 for j in range(k)) for k in range(20)}
    (tmp_path / "v.json").write_text('{"a": 0, "b": 1}')
    (tmp_path / "v.tsv").write_text("x\t1\ny\t2\n")
    assert {tuple(r) for r in sources.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1)}
    assert {tuple(r) for r in sources.vocabulary(spark, str(tmp_path / "v.tsv")).collect()} == {("x", 0), ("y", 1)}
