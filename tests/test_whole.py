"""Queries over whole texts and tables, against brute force."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks import catalog
from siltworks.functions import code as C
from siltworks.functions import text as T
from siltworks.operators import evaluate


def test_batches_read_whole_texts(spark, tmp_path):
    same = "a" * 200
    texts = [same + "b" * k + "\ufffd" * 6 for k in range(1, 9)] + ["x" * 1200] * 8
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["batch_id"]: r for r in catalog.batch_quality(spark, str(tmp_path)).collect()}
    assert got[0]["encoding_errors"] == 48 and got[0]["duplicate_ratio"] == 0 and got[0]["avg_sequence_length"] == 204.5
    assert got[1]["avg_sequence_length"] == 1200 and got[1]["duplicate_ratio"] == 0.875
    alerts = {(r["batch_id"], r["alert"]) for r in catalog.quality_alerts(spark, str(tmp_path)).collect()}
    assert alerts == {(0, "low_coverage"), (0, "encoding_errors"), (1, "high_length"), (1, "low_coverage"), (1, "duplicates")}


def test_text_statistics_without_lists_of_ids(spark):
    from siltworks.operators import monitor

    rng = random.Random(3)
    signs = [chr(k) for k in range(128)] + ["\x80", "é", "\u2028", "\ufffd", "\U0001f600"]
    texts = [None, "", "\x00", "\x7f", "?", "@", "é", "ü", "é€", "a\x00"] + ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(150)]
    rows = [(k % 7, rng.choice(texts)) for k in range(300)] + [(7, None), (8, ""), (9, "é"), (9, "ü"), (10, "".join(signs)), (11, None), (11, "b"), (None, "x")] + [(12 + k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "batch_id long, text string").withColumn("err", C.literal_count(F.col("text"), "\ufffd"))
    by_text = monitor.text_statistics(df, errors="err")
    by_ids = monitor.batch_statistics(df.where("batch_id IS NOT NULL").withColumn("ids", catalog.ids_of(F.col("text"))), errors="err")
    got = sorted(tuple(r) for r in by_text.where("batch_id IS NOT NULL").collect())
    assert got == sorted(tuple(r) for r in by_ids.collect()) and len(got) == 12 + len(texts)
    plan = by_text._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("array_distinct(") == 1


PYTHON = {
    "def f(a: int) -> int:\n    x = [a, 2]\n    x += 1\n    return not x\n": "FunctionDef Name Call Name OTHER Name OTHER OTHER Name OTHER Name Assign List Name OTHER Constant OTHER Name AugAssign Constant Return UnaryOp Name".split(),
    "class A:\n    pass\n": "ClassDef Constant OTHER Pass".split(),
    "async def g():\n    await h({1: 2})\n": "AsyncFunctionDef FunctionDef Name Call OTHER AnnAssign Await Name Call Dict Constant OTHER Constant OTHER OTHER".split(),
    "y = {i for i in (z)}": "Name Assign OTHER Name For Name Comprehension Call Name OTHER OTHER".split(),
    "if a in b: _ = B_C * 3": "If Name Compare Name OTHER OTHER Assign Constant BinOp Constant".split(),
    "not python at all": ["OTHER"] * 4,
}


def test_python_labels_over_documents(spark, tmp_path):
    from siltworks.operators.tokenizers import PYTHON_LABELS

    assert len(PYTHON_LABELS) == 47
    spark.createDataFrame(list(enumerate(PYTHON)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.python_labels(spark, str(tmp_path)).collect()}
    for k, want in enumerate(PYTHON.values()):
        assert [PYTHON_LABELS[x] for x in got[k]["labels"]] == want and got[k]["tokens"] == len(want) and got[k]["others"] == want.count("OTHER")


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def brute_mask(k, text, whole):
    ids = [ord(c) + 5 if ord(c) < 128 else 0 for c in text]
    words = [m.span() for m in re.finditer(r"[a-zA-Z_][a-zA-Z0-9_]*", text)]
    drawn = [w for n, w in enumerate(words) if uniform(k, n, "w") < 0.15]
    out = []
    for i, tok in enumerate(ids):
        hit = any(max(i, a) < min(i + 1, b) for a, b in drawn) if whole and words else tok > 4 and uniform(k, i, "a") < 0.15
        b, r = uniform(k, i, "b"), uniform(k, i, "c")
        new = tok if not hit or b >= 0.9 else 4 if b < 0.8 else int(r * 133)
        out.append((k, i, new, tok if hit or (whole and words and not drawn) else -100))
    return out


def test_masks_and_spans_over_documents(spark, tmp_path):
    texts = ["9abc int x_1 = é; " * 30, "\n12 -- é 3" * 20, "one", "", "é" * 50 + " word two", None] + [f"a{k} b" for k in range(6)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    for name, whole in (("mask_mlm", False), ("mask_wwm", True)):
        assert rows(name) == sorted(x for k, t in enumerate(texts) for x in brute_mask(k, t or "", whole))
    assert rows("token_spans") == sorted((k, c, i, i + 1) for k, t in enumerate(texts) for i, c in enumerate(t or ""))


def test_the_gate_reads_from_the_end(spark, tmp_path):
    rng = random.Random(5)
    names = "exec eval(|file|token|key|QUERY|xpath|select|Update|from|$_GET|$_get|$_|hashlib.|HASHLIB|crypto.cipher.|DOMDocument|include_once|\u212aey".split("|")
    texts = [None, "", "(", "="] + ["".join(rng.choice(rng.choice([names, list("(= \n\t\r\x0b\xa0é"), list("(=ab ")])) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    forward = re.compile(rf"(?ia)(?:{'|'.join(C.CALLED)})\s*\(|(?:{'|'.join(C.ASSIGNED)})\s*=|\$_(?:GET|POST|REQUEST|COOKIE)|hashlib\.|Crypto\.Cipher\.|(?:select|insert|update|delete)\s+from\s".replace("\\s", "[ \\t\\n\\x0b\\f\\r]"))
    want = [None if t is None else bool(forward.search(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert [r["m"] for r in df.select("k", C.may_be_vulnerable(F.col("text")).alias("m")).orderBy("k").collect()] == want and 300 < sum(map(bool, want)) < 2700
    spark.createDataFrame([(1, "ab", "")], "doc_id long, text string, html string").withColumn("page_id", F.col("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "documents.parquet")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "n", "m", "b", "t", 3, 1.0)], "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    plan = catalog.vuln_labels(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "substring(text" in plan and "split(text" not in plan  # ids of 64 characters, not of the whole text


def test_comment_lines_are_counted_in_whole_texts(spark):
    rng, signs = random.Random(4), ["//", "/*", "*/", "/", "*", "\n", "\n", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "\u2028", "\u3000", "a", "é", "\U0001f600"]
    texts = ["\n", "\n//", "//\n", "/*/", "*/", " */ \r\n", "// a */\n*/\n", "a */ b", "\u2028// x", "*/\u2028"] + ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(2000)]
    df = T.file_quality(spark.createDataFrame(list(enumerate(texts)), "k long, text string"))
    got = {r["k"]: (r["comment_ratio"], r["avg_line_length"]) for r in df.collect()}
    for k, t in enumerate(texts):
        lines = t.split("\n")
        notes = sum(x.startswith(("//", "/*")) or x.endswith("*/") for x in map(str.strip, lines))
        assert got[k] == (notes / len(lines), sum(map(len, lines)) / len(lines)), repr(t)
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_spans_of_characters_need_no_filtered_lists(spark, tmp_path):
    spark.createDataFrame([(0, "é\U0001f600a"), (1, ""), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.token_spans(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "a", 2, 3), (0, "é", 0, 1), (0, "\U0001f600", 1, 2)]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


def test_spans_of_long_texts(spark):
    words = [f"w{k % 1500}" for k in range(70_000)]
    ends = list(itertools.accumulate(map(len, words)))
    got = spark.createDataFrame([(words,)], "w array<string>").select(C.spans(F.col("w")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [(w, e - len(w), e) for w, e in zip(words, ends)]
    assert spark.createDataFrame([([],), (None,)], "w array<string>").select(C.spans(F.col("w"))).collect() == [([],), (None,)]


def test_bleu_reads_whole_turns(spark, tmp_path):
    a, b = "w " * 1500 + "x y z", "w " * 1500 + "p q r"
    spark.createDataFrame([(1, 0, a), (1, 1, b)], "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = math.exp(sum(math.log((1501 - n) / (1504 - n)) for n in range(1, 5)) / 4)
    assert [(r["id"], r["bleu"]) for r in catalog.bleu(spark, str(tmp_path)).collect()] == [(1001, pytest.approx(want, abs=1e-9))]


def test_bootstrap_makes_1000_draws(spark, tmp_path):
    lengths = [17 * k % 400 * 10 for k in range(40)]
    spark.createDataFrame([(k, "a" * n) for k, n in enumerate(lengths)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    means = [np.mean([lengths[int(uniform(d, k) * 40)] / 4000 for k in range(40)]) for d in range(1000)]
    got = catalog.bootstrap_ci(spark, str(tmp_path)).first()
    assert (got["lower"], got["upper"]) == tuple(pytest.approx(np.percentile(means, q), abs=1e-9) for q in (2.5, 97.5))


def test_monitor_adds_values_up_in_the_order_of_events(spark, tmp_path):
    import datetime
    import random

    rng, rows = random.Random(1), []
    for batch in range(300):  # every mean is 35 but for what adding up in floats leaves
        cents = [rng.randrange(7000) for _ in range(19)]
        cents.append(3500 * 20 - sum(cents))
        rows += [(batch * 64 + k, datetime.datetime(2024, 1, 1), rng.randrange(8), "a", c / 100, "") for k, c in enumerate(cents)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = set()
    for batch in range(300):
        total = 0.0
        for r in rows[batch * 20 : batch * 20 + 20]:
            total += r[4]
        want |= {batch} if total / 20 < 35 else set()
    got = {r["batch_id"] for r in catalog.monitor_alerts(spark, str(tmp_path)).collect() if r["alert"] == "low_length"}
    assert got == want and 0 < len(want) < 300


def test_encode_pad_of_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(0, None), (1, ""), (2, "a" * 200), (3, "é")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("encode_pad", "char_ids"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.collect()) == sorted(duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_small_inputs_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILES_A_TASK", 10)
    spark.createDataFrame([(k, f"n{k}", "m", f"b{k % 3}", "t", 3, 1.0) for k in range(95)], "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert catalog.QUERIES["keychar_spans"](spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_nothing_as_large_as_the_input_is_broadcast(spark, tmp_path):
    rows = [(k, f"n{k} x", "m", f"b{k % 3}", "t", 3, 1.0) for k in range(20)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = catalog.processed(spark, str(tmp_path)).select("doc_id", F.split("p", " ").alias("p"), F.split("o", " ").alias("r"))
    plan = evaluate.bleu(pairs, "doc_id", "p", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_bleu_keeps_every_pair(spark):
    rows = [(1, ["a", "b"], ["a", "b"]), (1, ["a", "b"], ["a", "b"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["z"], ["a"]), (5, ["a"], None)]
    got = sorted(tuple(r) for r in evaluate.bleu(spark.createDataFrame(rows, "id long, p array<string>, r array<string>"), "id", "p", "r").collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0), (4, pytest.approx(1e-10)), (5, pytest.approx(1e-10))]


def test_pieces_are_held_for_few_texts_at_once(spark):
    import pyarrow as pa
    import public_tokenizers
    import sentencepiece

    from siltworks.operators import tokenizers

    texts = ["a" * 400_000, None, "b" * 300_000, "c" * 900_000, "", "d é  x"]
    assert [(at, len(ts)) for at, ts in tokenizers._steps(pa.array(texts))] == [(0, 2), (2, 1), (3, 1), (4, 2)]
    texts = ["one  two é", None, "", "x = 1\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {k: sp.encode(t or "", out_type=str) for k, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in tokenizers.piece_spans(spark, docs).collect()}
    for k, p in want.items():
        assert [tuple(x) for x in got[k]["pieces"]] == tokenizers.find_spans(texts[k] or "", p) and got[k]["decoded"] == sp.decode(p)
    assert {r["doc_id"]: (r["n_pieces"], r["round_trip"]) for r in tokenizers.piece_tokens(spark, docs).collect()} == {k: (len(p), 2 * len(sp.decode(p)) >= len(texts[k] or "")) for k, p in want.items()}


def test_draws_compare_digits_as_numbers(spark):
    df = spark.range(2000).select("id", *[C.uniform_below(x, F.col("id"), F.lit("a")).alias(f"u{k}") for k, x in enumerate((0.15, 0.8, 0.9))])
    assert all((r["u0"], r["u1"], r["u2"]) == tuple(uniform(r["id"], "a") < x for x in (0.15, 0.8, 0.9)) for r in df.collect())
