"""Operators beside the catalogue's queries, on small frames and against plain Python."""

import json
import random
import re
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from siltworks import sources
from siltworks.functions import code as C
from siltworks.functions import text as T
from siltworks.operators import corpus, evaluate, monitor, validate
from siltworks.operators.tokenizers import find_spans, piece_spans
from siltworks.plans import arguments
from siltworks.sources import sinks
from siltworks.streaming import monitor as stream


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_function_count_is_the_patterns(spark):
    rnd = random.Random(2)
    parts = ["a", "b1", " ", "\n", "\n", "(", ")", "{", "}", "*", ") {", "(x)", ";", "int f", ")\n{", "\t", "if (", "f()", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    texts += ["int f(int a) {\n}\nstatic char *g ( void )\n{ if (x) { } }\n", "f(a { b) {", "ab\ncd(x) {", "(\nab(x) {", "", None]
    plain = re.compile(T.FUNCTION.replace("(?m)", ""), re.M | re.A)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.function_count(F.col("t")).alias("n")).collect()
    got = {r["k"]: r["n"] for r in rows}
    assert sum(v or 0 for v in got.values()) > 300
    assert [got[k] for k, t in enumerate(texts) if t is not None] == [len(plain.findall(t)) for t in texts if t is not None]


@pytest.mark.parametrize("text", ["word other words\n" * 60_000, "ab(\n" * 250_000, "int a " * 150_000 + ") {", "x\n" * 400_000 + "f(a) {"])
def test_function_count_is_linear(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(T.function_count(F.col("t")))
    df.first()
    at = time.perf_counter()
    df.first()
    assert time.perf_counter() - at < 5


def test_offsets_with_further_columns(spark):
    n = 400_000
    rows = spark.range(n).selectExpr("id AS k", "repeat('x', CAST(id % 7 AS int)) AS text", "CAST(id AS string) AS more", "id % 3 AS _p")
    wrong = corpus.offsets(rows, ["k"]).withColumn("want", F.floor(F.col("k") / 7) * 28 + F.expr("(k % 7) * (k % 7 + 1) / 2").cast("long")).where("line_offset <> want").count()
    assert wrong == 0 and corpus.offsets(rows, ["k"]).columns == ["k", "text", "more", "_p", "line_offset"]
    numbers = corpus.row_numbers(rows.where("k % 2 = 0"), ["k"], "no")
    assert numbers.where("no <> k / 2").count() == 0


def test_corpus_and_its_offsets(spark, tmp_path):
    texts = [f"line {k} é" * (k % 4) for k in range(200)] + ["\t", "\u00a0", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(5)
    sinks.write_corpus(docs, str(tmp_path / "corpus"), ["k"])
    sinks.write_offsets(docs, str(tmp_path / "index"), ["k"])
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "corpus").glob("part-*.txt")))
    kept = [(k, t) for k, t in enumerate(texts) if t.strip()]
    assert whole.decode().splitlines() == [t for _, t in kept]
    for r in spark.read.parquet(str(tmp_path / "index")).collect():
        assert whole[r["line_offset"] :].split(b"\n")[0].decode() == texts[r["k"]]
    (tmp_path / "lines.txt").write_text("a\n\t\n \u2003\nb\n")
    assert sorted(r["value"] for r in sources.lines(spark, str(tmp_path / "lines.txt")).collect()) == ["a", "b"]
    (tmp_path / "offsets.json").write_text(json.dumps({"line_offsets": [0, 5, 9]}))
    index = sources.offset_index(spark, str(tmp_path / "offsets.json"))
    assert sorted(map(tuple, sources.lines_at(index, spark.createDataFrame([(1,), (1,), (7,)], "line_no int")).collect())) == [(1, 5)]
    assert sorted(r["k"] for r in sources.head(docs, ["k"], "text").collect()) == [1, 2, 3, 5, 6, 7, 9]


def test_repositories(spark, tmp_path):
    for name, depth in (("r1", "."), ("r2", "deep/er")):
        at = tmp_path / depth / name
        at.mkdir(parents=True)
        subprocess.run(["git", "init", "-q", str(at)], check=True)
        subprocess.run(["git", "-C", str(at), "config", "remote.origin.url", f"https://x/{name}"], check=True)
        subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    found = sources.discovered_repositories(spark, str(tmp_path))
    assert [r["name"] for r in found.collect()] == ["r1"] and sources.discovered_repositories(spark, str(tmp_path), 5).count() == 2
    info = {r["name"]: r for r in sources.git_info(sources.discovered_repositories(spark, str(tmp_path), 5)).collect()}
    assert len(info["r1"]["commit_hash"]) == 40 and info["r2"]["remote_url"] == "https://x/r2"
    assert sources.git_info(spark.createDataFrame([("n", "/nowhere")], "name string, path string")).first()["commit_hash"] is None
    boms = spark.createDataFrame([("r1", "a", None, 1, "C", "", "old"), ("other", "a", "https://x/r2", 1, "C", "", "old"), ("none", "a", "u", 1, "C", "", "old")], sources.BOM)
    out = {r["name"]: r for r in sources.bom_updated(boms, spark.createDataFrame(list(info.values()))).collect()}
    assert (out["r1"]["commit_hash"], out["r1"]["url"]) == (info["r1"]["commit_hash"], "https://x/r1")
    assert out["other"]["commit_hash"] == info["r2"]["commit_hash"] and out["none"]["commit_hash"] == "old"
    answer = {"items": [{"name": n, "owner": {"login": "o"}, "html_url": f"u/{n}", "stargazers_count": s, "language": g, "description": None} for n, s, g in (("a", 5, "C"), ("b", 9, "C"), ("c", 7, "Go"))]}
    top = sources.top_repositories(spark, lambda language, n: json.dumps(answer), repositories=2)
    bom = sources.bom_projection(top, F.lit("h"))
    assert [(r["name"], r["author"], r["stars"]) for r in bom.orderBy(F.desc("stars")).collect()] == [("b", "o", 9), ("a", "o", 5)] and bom.columns == [f.split()[0] for f in sources.BOM.split(", ")]

    def broken(*_):
        raise OSError

    assert sources.top_repositories(spark, broken).count() == 0
    commits = sources.latest_commits(bom, lambda full: {"o/a": "123"}.get(full)).collect()
    assert {r["name"]: r["commit_hash"] for r in commits} == {"a": "123", "b": None}
    sinks.write_bom(bom, str(tmp_path / "bom"))
    ok, rejected = sources.bom(spark, str(tmp_path / "bom"))
    assert ok.count() == 2 and rejected.count() == 0


def test_writers(spark, tmp_path):
    sinks.write_vocabulary(spark.createDataFrame([("b", 1), ("a", 0), ('"', 2)], "token string, id int").repartition(3), str(tmp_path / "v"))
    assert json.loads(next((tmp_path / "v").glob("part-*.txt")).read_text()) == {"a": 0, "b": 1, '"': 2}
    assert {tuple(r) for r in sources.vocabulary(spark, str(tmp_path / "v")).collect()} == {("a", 0), ("b", 1), ('"', 2)}
    sinks.write_embeddings(spark.createDataFrame([(1, [0.5, 1.0])], "k int, e array<double>"), str(tmp_path / "e"), "k", "e")
    assert spark.read.json(str(tmp_path / "e")).first()["embedding"] == [0.5, 1.0]
    files = T.file_metrics(spark.createDataFrame([("r", "a.c", "int a;")], "repo string, path string, text string")).drop("text")
    sinks.write_repository_report(corpus.repository_report(files), str(tmp_path / "q"), files)
    assert spark.read.json(str(tmp_path / "q/files")).first()["repo"] == "r" and spark.read.json(str(tmp_path / "q/report")).first()["total_files"] == 1


def test_arguments():
    arguments.check_training("char", 1, 8, 1e-4)
    arguments.check_evaluation("vi", "spe", vocab_file="v", model_file="m")
    for bad in (lambda: arguments.check_training("spe", 1, 8, 1e-4), lambda: arguments.check_training("char", 0, 8, 1e-4), lambda: arguments.check_training("char", 1, 8, -1.0), lambda: arguments.check_evaluation("x", "char"), lambda: arguments.check_evaluation("mlm", "char", max_length=0), lambda: arguments.ModelConfig(128, hidden_size=770), lambda: C.tokenizer("words")):
        with pytest.raises(ValueError):
            bad()
    assert arguments.ModelConfig(128).parameters == 86_141_312
    assert arguments.ModelConfig(128).megabytes == 86_141_312 * 4 / 2**20
    assert C.tokenizer("char")[0] is C.char_tokens and len(C.keychar_vocabulary()) == 165 and C.char_vocabulary()["[MASK]"] == 4


def test_labels_and_contexts(spark):
    v = C.label_vector(F.array(*[F.lit(k) for k in range(6)]), 5, 9)
    assert spark.range(1).select(v, C.label_vector(F.array(F.lit(1)), 5, 9), C.repeated_label(F.array(F.lit(7), F.lit(2)), F.lit(1), 2)).first()[:] == ([9, 0, 1, 2, 9], [9, 1, 9, -100, -100], [1, -100])
    got = one(spark, "a b c d e f", lambda t: C.context(F.split(t, " ")))
    assert [(x["token"], x["before"], "".join(x["near"])) for x in got] == [("a", None, "abc"), ("b", "a", "abcd"), ("c", "b", "abcde"), ("d", "c", "bcdef"), ("e", "d", "cdef"), ("f", "e", "def")]
    other = C.LABELS.index("Other")
    assert one(spark, "é à", C.labels_or_other) == [other, other] and one(spark, "", C.labels_or_other) == []
    s = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in p])
    assert [tuple(x) for x in spark.range(1).select(C.overlapping(s((0, 2), (2, 4), (5, 6)), s((1, 2), (5, 9)))).first()[0]] == [(0, 2), (5, 6)]
    names = one(spark, "eval(a + b); strcpy(x); $_GET", C.detected)
    assert sorted(names) == sorted(["command_injection", "buffer_overflow", "xss", "dangerous_functions", "missing_input_validation"])
    assert one(spark, None, C.detected) == [] and one(spark, None, C.vulnerability_score) == 0
    v = C.char_vocabulary()
    assert one(spark, "aé", lambda t: C.detokenized(C.tokens_from(C.char_ids(C.char_tokens(t)), v))) == "a[UNK]"


def test_c_tokens(spark):
    text = '#define A(x) \\\n  x + 1\nL"a\\"b" u8"c" L\'d\' asm volatile { mov ax, 1; } int asm_x = 1 >>= 2; // no\n#if Z\n/* no */ x->y'
    assert one(spark, text, C.c_tokens) == ['L"a\\"b"', 'u8"c"', "L'd'", "int", "asm_x", "=", "1", ">>=", "2", ";", "x", "->", "y"]
    assert one(spark, "#define B \\\n" * 20_000 + "int a;", C.c_tokens) == []  # a directive of many lines
    assert one(spark, '"' + "a\\n" * 100_000 + '" b', C.c_tokens)[-1] == "b"


def test_every_detection_passes_the_gate(spark):
    samples = ["execute( 'a' + 'b'", "query = 'a' + b'", "popen (x+", "gets(a)", "innerHTML = a +", "file (../", "api_key = 'x'", "sha1(a)", "hashlib.md5", "Crypto.Cipher.DES", "marshal.loads(x)", "yaml.load(x)", "require_once($x", "select from t where a + b", "private_key='abcdef'", "mt_rand(", "readfile($x", "setcookie($x", "ldap_query($x", "xpath($x", "new DOMDocument(", "$_COOKIE", "session_start()"]
    texts = samples + [x.upper() for x in samples]
    t = F.col("t")
    ungated = C._total([*C.family_counts(t).values(), *[C.HEURISTICS[n][1] * c for n, c in C.heuristic_counts(t).items()], *C.context_checks(t).values()])
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", ungated.alias("a"), C.vulnerability_score(t).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["a"] > 0 for r in rows) > 40


def test_spans_of_pieces(spark):
    assert find_spans("a bc", ["\u2581a", "bc"]) == [("\u2581a", 0, 2), ("bc", 2, 4)]  # a piece that isn't there is taken to stand at the end of the one before
    assert find_spans("a bc", ["a", "bc"]) == [("a", 0, 1), ("bc", 2, 4)]
    r = piece_spans(spark, spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["decoded"] for x in r} == {1: "hello world", 2: ""}


def test_file_quality(spark):
    df = spark.createDataFrame([("// a\nint é;\n",), ("",), (None,)], "text string")
    assert [tuple(r)[1:] for r in T.file_quality(df).collect()] == [(13, 1 / 3, 10 / 3, "utf-8"), (0, 0.0, 0.0, "utf-8"), (0, 0.0, 0.0, "unknown")]
    out = sources.processed_files(spark.createDataFrame([("int a; // x\n" * 20,), (None,)], "text string")).collect()
    assert out[0]["cleaned"].startswith("int a;int a;") and out[1]["cleaned"] == "" and out[1]["critical_issues"] == 0


def test_validators(spark, tmp_path):
    rows = spark.createDataFrame([(1, [5, 6, 0]), (1, [7, 8, 9]), (2, [1] * 600), (2, [2])], "b int, input_ids array<int>")
    got = {(r["b"], r["check_name"]): r for r in validate.batch_checks(rows, "b", vocab_size=9).collect()}
    assert set(got) == {(1, "required_key_attention_mask"), (2, "required_key_attention_mask"), (1, "vocab_range"), (1, "batch_sequence_length"), (2, "input_ids_shape"), (2, "sequence_length")}
    assert validate.batch_checks(rows.drop("input_ids"), "b").count() == 4
    full = rows.withColumn("attention_mask", F.col("input_ids"))
    assert "required_key_attention_mask" not in {r["check_name"] for r in validate.batch_checks(full, "b").collect()}
    (tmp_path / "config.json").write_text("{}")
    found = [tuple(r)[:3] for r in validate.checkpoint_checks(spark, str(tmp_path), parameters=0).collect()]
    assert found == [("checkpoint_file_pytorch_model.bin", "warning", False), ("checkpoint_model_state", "error", False)]
    trips = spark.createDataFrame([(1, "ééab", "ab"), (2, "éééab", "ab")], "k int, t string, d string")
    assert [r["k"] for r in validate.round_trip_checks(trips, ["k"], "t", "d").collect()] == [2]
    report = validate.report(validate.batch_checks(rows, "b", vocab_size=9)).first()
    assert (report["total_checks"], report["passed"], report["info"], report["error"], report["warning"]) == (6, 0, 0, 4, 2) and "truncate" in report["recommendations"]


def test_composed_evaluations(spark):
    pairs = spark.createDataFrame([(1, "if (a) b", "if (a) b"), (2, "", "x")], "k int, p string, r string")
    tokens = spark.createDataFrame([(1, 1), (2, 1), (5, -100)], "prediction int, label int")
    r = evaluate.mlm_task(pairs, "k", "p", "r", tokens).first()
    assert (r["token_accuracy"], r["exact_match"], r["bleu_score"]) == (0.5, 0.5, pytest.approx(0.5)) and r["ast_similarity_lower"] < r["ast_similarity"] < r["ast_similarity_upper"]
    folds = spark.createDataFrame([(k % 3, float(k)) for k in range(9)], "f int, v double")
    c = evaluate.cross_validation(folds, "f", "v").first()
    assert (c["cv_mean"], c["cv_std"]) == (4.0, pytest.approx((2 / 3) ** 0.5)) and list(c["cv_scores"]) == [3.0, 4.0, 5.0]
    logits = spark.createDataFrame([(0, [[0.0, 2.0], [0.0, 4.0], [9.0, 0.0]], [1, 1, -100]), (0, [[1.0, 0.0]], [0])], "b int, x array<array<double>>, y array<int>")
    s = sorted((x["label"], x["prediction"], round(x["prob"], 6)) for x in evaluate.pooled_scores(logits, "x", "y").collect())
    assert s == [(0, 0, 0.268941), (1, 1, 0.952574)]
    assert tuple(evaluate.detection_batches(evaluate.pooled_scores(logits, "x", "y"), "b").first())[1:] == (1.0, 1.0, 1.0, 1.0, 1.0)


def batch_rows(first, last, errors=0):
    return [("e", k, float(k % 7), *[1.0] * (len(monitor.AVERAGED) - 2), float(errors)) for k in range(first, last)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    kind = "epoch string, batch_id long, " + ", ".join(f"{c} double" for c in ("avg_sequence_length", *[c for c in monitor.AVERAGED if c not in ("avg_sequence_length", "error_count")], "error_count")) + ", encoding_errors long"
    at = str(tmp_path / "in")
    for part in ((0, 60), (60, 130)):
        rows = [(*r, 0) for r in batch_rows(*part, errors=10)]
        random.Random(1).shuffle(rows)  # a trigger's rows come in any order
        df = spark.createDataFrame(rows, kind).repartition(3)
        df.write.mode("append").parquet(at)
        stream.run(spark.readStream.schema(df.schema).parquet(at), str(tmp_path / "state"), str(tmp_path / "out"))
    out = {r["batch_id"]: r for r in spark.read.schema(stream.OUT).parquet(str(tmp_path / "out")).collect()}
    assert len(out) == 130
    for k in (0, 9, 10, 59, 60, 99, 100, 129):
        window = [x % 7 for x in range(max(0, k - 99), k + 1)]
        assert out[k]["window_size"] == len(window) and out[k]["kept_errors"] == min(1000, 10 * (k + 1))
        assert out[k]["mean_avg_sequence_length"] == pytest.approx(sum(window) / len(window))
        new, old = [x % 7 for x in range(max(0, k - 9), k + 1)], [x % 7 for x in range(max(0, k - 19), k - 9)]
        d = sum(new) / len(new) - sum(old) / len(old) if old else 0
        assert out[k]["trend_sequence_length"] == ("insufficient_data" if k < 10 else "stable" if abs(d) < 0.01 else "increasing" if d > 0 else "decreasing")
    assert out[0]["alerts"] == "low_length,duplicates,errors"


def test_inverted_trend(spark):
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(12)], "g string, k int, v double")
    both = rows.select("k", monitor.trend("v", ["k"], ["g"]).alias("up"), monitor.trend("v", ["k"], ["g"], higher_is_better=False).alias("down")).orderBy("k").collect()
    assert [r["up"] for r in both] == ["insufficient_data"] * 10 + ["increasing"] * 2 and both[11]["down"] == "decreasing"


def test_report_text(spark):
    files = T.file_metrics(spark.createDataFrame([("r", "a.c", "int a; // x\n" * 200), ("r", "b.h", "/* y */")], "repo string, path string, text string"))
    report = corpus.repository_report(files).withColumn("duplicate_ratio", F.lit(0.125))
    text = report.select(corpus.report_text()).first()[0].split("\n")
    assert text[:2] == ["files: 2", "size: 2.4 KB"] and "duplicates: 12.50%" in text and "  1-10KB: 1 files (50.0%)" in text and text[-1] == "issues: low_comments,duplicates,no_includes"
    ext = F.create_map(F.lit(".h"), F.lit(1), F.lit(".c"), F.lit(3))
    assert spark.range(1).select(corpus.extension_text(ext, F.lit(4))).first()[0] == "  .c: 3 files (75.0%)\n  .h: 1 files (25.0%)"


def test_task_results_and_configuration(spark, tmp_path):
    b = spark.createDataFrame([(0, 2.3, 0.5, 8, 0.25), (1, 2.3, 1.0, 2, 0.75)], "batch int, loss double, accuracy double, samples int, f1 double")
    r = evaluate.task_results(b, "mlm").first()
    assert (r["average_loss"], r["average_accuracy"], r["num_samples"], round(r["average_perplexity"], 3)) == (2.3, 0.75, 10, 9.974)
    assert evaluate.task_results(b, "vi", metrics=("f1",)).first()["average_f1"] == 0.5 and evaluate.task_results(b.limit(0), "ast").first()["num_samples"] == 0
    assert [x["batch"] for x in evaluate.unfinished(b, b.where("batch = 0")).collect()] == [1]
    assert len(C.label_map()) == 36 and C.label_map()["Other"] == 35
    (tmp_path / "c.json").write_text('{"vocab_size": 128, "hidden_size": 64,\n "num_hidden_layers": 2, "num_attention_heads": 4, "intermediate_size": 128, "other": []}')
    config = sources.checked_config(sources.model_config(spark, str(tmp_path / "c.json")))
    assert (config.vocab_size, config.layers, config.max_positions) == (128, 2, 512)
    (tmp_path / "bad.json").write_text('{"vocab_size": 0}')
    with pytest.raises(ValueError):
        sources.checked_config(sources.model_config(spark, str(tmp_path / "bad.json")))
