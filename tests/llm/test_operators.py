"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns included."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import bpe, contentsort, jaccard, langid, lengthpack, licenses, linededup, rules, tokenpack, urlgraph

#: Further columns bear the names that the operators use themselves.
CLASH = "row norm h token words id n n_words kept rule base_failed lang_pred score start salt place cls bits comp label members n_tokens no bucket deal t c0 c1 _text _score _kept _dedup".split()
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
BASE = "the quick brown fox jumps over a lazy dog while seven wizards mix quartz jugs and vex big sphinx near " * 3
TEXTS = [
    None, "", "   \n\t ", "one", "two words", BASE, BASE, BASE + " tail", BASE.upper(), BASE.replace(" ", "  "), BASE.replace("fox", "cat"),
    "a b c a b c a b c\nsame\nsame\n\nSAME \n", "cc by cc by, all rights reserved\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "GNU General  Public--License é cc  by", "x" * 20_000, " ".join(f"w{k}" for k in range(5_000)), "naïve 日本語 😀 <|endoftext|> #$% it's", "\x1c\x0b a\u00a0b \u2003",
]


def frame(spark, texts, ids=None, langs=None):
    rows = [(k if ids is None else ids[k], t, langs[k] if langs else None, "s", 0, *CLASH) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*TEXTS, TEXTS[5]], [*range(len(TEXTS)), 5])  # the last row is repeated


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    tok = Tokenizer.from_file(path)
    for r in docs.select("doc_id", "text").join(bpe.digest_documents(spark, docs, path), "doc_id").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert bpe.digest_documents(spark, none, path).count() == 0
    got = {r["id"]: r for r in bpe.encode_documents(spark, docs, path).collect()}
    assert got[17]["ids"] == tok.encode(TEXTS[17], add_special_tokens=False).ids and got[17]["decoded"] == TEXTS[17]


def test_bpe_random_texts():
    import random

    from tokenizers import Tokenizer

    rnd, path = random.Random(3), bpe.default_vocabulary()
    texts = ["".join(rnd.choice(" \n\t'abcdeslvtrnio12.,-<|>éß日😀 ") for _ in range(rnd.randint(0, 50))) for _ in range(2000)]
    codec, tok = bpe.BytePairCodec(bpe.load_spec(path)), Tokenizer.from_file(path)
    assert list(codec.encode(texts)) == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_langid(spark, none):
    stems = {"en": "the and with from that this", "de": "der und mit von nicht eine", "fr": "les des dans avec pour une", "es": "los las para como una del"}
    texts, langs = [], []
    for k in range(320):
        g = sorted(stems)[k % 4]
        w = stems[g].split()
        texts.append(" ".join(w[(k * j + j * j) % 6] for j in range(3 + k % 40)))
        langs.append(g if k % 5 else None)
    df = frame(spark, [*texts, None, "", "123 ...", texts[0]], [*range(320), 320, 321, 322, 0], [*langs, "en", "en", None, langs[0]])
    got = langid.language_report(spark, df).collect()
    assert len(got) == 324 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 320} == {"und"}
    right = [r["lang_pred"] == sorted(stems)[r["doc_id"] % 4] for r in got if r["doc_id"] < 320 and r["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert langid.language_report(spark, none).count() == 0
    assert {r["lang_pred"] for r in langid.language_report(spark, frame(spark, ["abc"])).collect()} == {"und"}
    # the same ones are taken at any partitioning, as many of each language
    model, again = langid.train(spark, df, 40), langid.train(spark, df.repartition(7), 40)
    assert (model.family_w == again.family_w).all() and (model.pair_w == again.pair_w).all()
    out = langid.predict(spark, df, model)
    assert out.select("row.*").columns == df.columns and out.where("row.score <> 'score' OR row.lang_pred <> 'lang_pred'").count() == 0
    for r in out.collect():
        text = r["row"]["text"]
        if text and langid.LETTER.search(text):
            assert (r["lang_pred"], pytest.approx(r["score"], abs=1e-5)) == plain_prediction(model, langid.vector(text.encode()))


def plain_prediction(model, x):
    """Family by its classifier, then votes of the pairs inside it, one by one."""
    squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
    side = lambda w: squash(float(np.dot(x, w[:-1]) + w[-1]))
    own = [side(model.family_w[:, k]) for k in range(len(model.families))]
    f = max(range(len(own)), key=lambda k: own[k])
    names = model.languages[f]
    votes = dict.fromkeys(names, 0.0)
    for k, (g, a, b) in enumerate(model.pairs):
        if g == f:
            v = side(model.pair_w[:, k])
            votes[names[a]] += v
            votes[names[b]] += 1 - v
    best = max(names, key=lambda v: votes[v])
    return best, (own[f] if len(own) > 1 else 1.0) * (votes[best] / (len(names) - 1) if len(names) > 1 else 1.0)


def repeat_words(w):
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)})


def test_rules(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for r in docs.select("doc_id", "text").join(rules.quality_report(spark, docs, labels), "doc_id").collect():
        t = r["text"] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w))
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat_words(w) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert rules.quality_report(spark, none, labels).count() == 0
    assert rules.learn_list(spark, docs, labels.limit(0)) == []
    assert rules.judged(spark, docs, labels).select("row.*").columns == docs.columns
    # the sample is exact and the same at any partitioning
    many = frame(spark, [f"{' '.join(f'w{j * k % 83}' for j in range(60))}" for k in range(90)])
    every = spark.range(90).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS quality")
    some = sorted(r["doc_id"] for r in rules.labelled_sample(spark, many, every, 20))
    assert len(some) <= 20 and some == sorted(r["doc_id"] for r in rules.labelled_sample(spark, many.repartition(5).unionByName(many), every.repartition(3), 20))


def test_rules_judge_every_row_as_their_list_says(spark):
    texts = [f"{' '.join(f'w{j * (k + 1) % 211}' for j in range(70))}" + " $%&" * (5 * (k % 3 == 0)) + " #" * (k % 7 == 1) for k in range(150)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(150)], "doc_id long, quality int")
    learned = rules.learn_list(spark, df, labels)
    assert learned
    for r in rules.judged(spark, df, labels).collect():
        # Java's division is Python's; FEATURES are read as Python, with max for greatest
        x = {f: eval(e.replace("greatest", "max"), {"max": max}, r.asDict()) for f, e in rules.FEATURES.items()}  # noqa: S307
        fired = [k for k, rule in enumerate(learned, 1) if all((x[c.feature] > c.threshold) == c.above for c in rule)]
        want = 0 if r["base_failed"] or not fired else fired[0]
        assert r["rule"] == want and r["kept"] == (not r["base_failed"] and not fired)
        assert r["base_failed"] or r["kept"] == (r["row"]["doc_id"] % 3 != 0)  # a stray symbol rejects no text


def test_rules_learn_and_match_their_expression(spark):
    rnd = np.random.default_rng(0)
    x = {f: rnd.random(600) for f in rules.FEATURES}
    bad = (x["symbol_share"] > 0.7) | ((x["n_words"] <= 0.2) & (x["repeat_share"] > 0.4))
    learned = rules.learn(x, bad, np.arange(600) % 3 == 0)
    got = np.zeros(600, bool)
    for rule in learned:
        got |= rules._all(rule, x, 600)
    assert (got == bad).mean() > 0.95


def brute_places(w, phrase):
    p = phrase.split()
    return [k for k in range(len(w)) if w[k : k + len(p)] == p]


def brute_labels(text):
    """Templates of a text by trying every line and every run of words, less those that a rival beats at the same place."""
    split = lambda x: re.findall(licenses.WORD, ascii_lower(x or ""))
    t, found = text or "", []
    texts = {(label, k): x.split() for label, xs in licenses.TEMPLATES.items() for k, x in enumerate(xs)}
    w = split(t)
    for name, x in texts.items():
        size = len(set(x))
        for k, line in enumerate(t.split("\n")):
            if 5 * (n := len(set(split(line)) & set(x))) >= 4 * size:
                found.append((name, n, size, ("line", k)))
        best = max(((len(set(w[i : i + len(x)]) & set(x)), -i) for i in range(len(w)) if w[i] in x), default=(0, 0))
        if 5 * best[0] >= 4 * size:
            found.append((name, best[0], size, ("run", -best[1])))
    least = {name: -(-4 * len(set(x)) // 5) for name, x in texts.items()}
    rival = lambda a, b: a[0] != b[0] and len(set(texts[a]) & set(texts[b])) >= min(least[a], least[b])

    def beaten(m):
        for o in found:
            near = m[3] == o[3] if m[3][0] == "line" else o[3][0] == "run" and abs(m[3][1] - o[3][1]) < max(m[2], o[2])
            if near and rival(m[0], o[0]) and (o[1] * m[2], o[2]) > (m[1] * o[2], m[2]):
                return True
        return False

    return {m[0][0] for m in found if not beaten(m)}


MIT = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction."
WANTED = {
    "Licensed under CC BY 4.0.": {"cc-by"}, "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"}, "licensed under CC BY-SA 4.0": {"cc-by", "cc-by-sa"}, "This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0\nInternational License.": {"cc-by-sa"},
    MIT: {"mit"}, "Released under\nthe MIT License.": {"mit"}, "Licensed under the Apache License,\n# Version 2.0 (the": {"apache"}, "released under the big tent": set(), "Licensed under CC BY 4.0.\n" + "word " * 30 + "\nLicensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"},
}


def test_licenses(spark, docs, none):
    df = docs.unionByName(frame(spark, [*WANTED], [*range(500, 500 + len(WANTED))]))
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    got = licenses.scan(spark, df).collect()
    assert len(got) == len(text) + 1
    for r in got:
        t = text[r["doc_id"]]
        w = re.findall(licenses.WORD, ascii_lower(t or ""))
        at = [k for p in licenses.PHRASES for k in brute_places(w, p)]
        own = {label for p, label in licenses.PHRASES.items() if brute_places(w, p)}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(own)) and r["labels"] == ",".join(sorted(own | brute_labels(t))) and 0 <= r["score"] <= 1
        if t in WANTED:
            assert set(filter(None, r["labels"].split(","))) == WANTED[t]
    assert licenses.scan(spark, none).count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_line_runs(spark, none, most, tmp_path):
    texts = [f"common line\n {k}\nCommon Line \nrare{k % 4}\n" for k in range(12)] + [None, "", "\n\n", "common line", "x"]
    df = frame(spark, texts)
    path = str(tmp_path / "runs")
    for k in range(5):  # each batch by a new holder, which goes on from the manifest
        runs = linededup.LineRuns(spark, path)
        assert runs.step == k
        runs.add(df.where(F.col("doc_id") % 5 == k).select("text"))
        for name in list(runs.tables):
            spark.sql(f"DROP TABLE {name}")
    runs = linededup.LineRuns(spark, path)
    assert runs.state["settled"] and [len(x) for x in runs.state["levels"]] == [1, 0, 1]  # five runs in levels of two
    keys = [{ascii_lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")} - {""} for t in texts]
    gone = {x for k in keys for x in k if sum(x in y for y in keys) >= 10}
    out = {r["doc_id"]: r for r in linededup.without_lines(spark, df, runs.common(), max_broadcast=most).collect()}
    assert gone == {"common line"} and len(out) == len(texts)
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for x in lines if ascii_lower(x.strip(" \t\n\x0b\x0c\r")) not in gone]
        assert (out[k]["n_lines"], out[k]["n_dropped"], bytes(out[k]["kept"]).decode()) == (len(lines), len(lines) - len(left), "\n".join(left))
    empty = linededup.LineRuns(spark)
    empty.add(none.select("text"))
    assert linededup.without_lines(spark, none, empty.common()).count() == 0
    runs.drop()


def test_line_runs_of_a_filtered_frame_and_repeated_rows(spark, none):
    df = frame(spark, [f"shared\nown {k}" for k in range(30)], [k // 10 for k in range(30)])
    got = linededup.dedup_report(spark, df.where("doc_id = 1 OR text LIKE '% 2'")).collect()
    assert len(got) == 11 and {r["n_dropped"] for r in got} == {1}  # ten rows of one id and one more
    got = linededup.dedup_report(spark, df.where("doc_id = 1").limit(9)).collect()
    assert len(got) == 9 and {r["n_dropped"] for r in got} == {0}
    assert linededup.dedup_report(spark, none).count() == 0


def test_url_graph(spark):
    rows = [
        (1, "https://a.example.com/en/7x?q", '<a href="http://b.example.org/x">'), (2, "http://EXAMPLE.com/en/8#t", None), (3, "http://c.net/de/1", '<a href="http://a.example.com/">'), (4, "http://d.example.net/fr/1", ""),
        (5, None, ""), (6, "no scheme", ""), (7, "http://b.example.org/fr/", '<a href="http://c.net/de/">'), (8, "x://notexample.com", ""), (8, "x://notexample.com", ""), (9, "http://quiet.info/", "<a href='//a.example.com/en/7'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urlgraph.judge(spark, pages).collect()}
    assert len(got) == 9 and urlgraph.judge(spark, pages).count() == 10
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(1, 9)] == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("c.net", "/de/1", "net/de/"), ("d.example.net", "/fr/1", None), ("", "", None), ("", "", None), ("b.example.org", "/fr/", None), ("notexample.com", "", None),
    ]
    assert [got[k]["verdict"] for k in (1, 2, 3, 5, 6)] == ["allow", "block", "block", "allow", "allow"]
    assert [got[k]["verdict"] for k in range(1, 10)] == brute_verdicts(spark, pages, got)
    assert urlgraph.judge(spark, pages.limit(0)).count() == 0


def brute_verdicts(spark, pages, got):
    edges = [(r["src"], r["dst"], r["w"]) for r in urlgraph.host_edges(pages).collect()]
    rows = urlgraph.judge(spark, pages).collect()
    by_host = {}
    for r in rows:
        if r["host"]:
            by_host.setdefault(r["host"], []).append({"example.com/en/7": "allow"}.get(r["rule"], "block" if r["rule"] else None))
    nodes = sorted({*by_host, *[x for e in edges for x in e[:2]]})

    def rank(links, restart):
        out = {a: sum(w for x, _, w in links if x == a) for a, _, _ in links}
        now = dict(restart)
        for _ in range(400):
            new = {h: 0.15 * restart[h] for h in nodes}
            for a, b, w in links:
                new[b] += 0.85 * now[a] * w / out[a]
            now = new
        return now

    def lift(links, verdict):
        share = {h: by_host[h].count(verdict) / len(by_host[h]) if h in by_host else 0.0 for h in nodes}
        one, base = rank(links, {h: s / (sum(share.values()) or 1) for h, s in share.items()}), rank(links, dict.fromkeys(nodes, 1 / len(nodes)))
        return {h: one[h] / base[h] for h in nodes}

    trust, distrust = lift(edges, "allow"), lift([(b, a, w) for a, b, w in edges], "block")
    verdicts = []
    for k in sorted(got):
        r = got[k]
        if r["host"]:
            assert (r["trust_lift"], r["distrust_lift"]) == (pytest.approx(trust[r["host"]], abs=1e-4), pytest.approx(distrust[r["host"]], abs=1e-4))
        by_rule = None if r["rule"] is None else "allow" if r["rule"] == "example.com/en/7" else "block"
        verdicts.append(by_rule or ("block" if r["host"] and distrust[r["host"]] >= urlgraph.BLOCK_LIFT and distrust[r["host"]] > trust[r["host"]] else "allow"))
    return verdicts


def test_token_pack(spark, docs, none, tmp_path):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    packed = tokenpack.pack(spark, docs, path, P.PATTERN, 50256, width=64, window=3000).cache()
    encode = tokenpack.rank_encoder(open(path, encoding="ascii").read(), P.PATTERN)
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(encode([r["text"] or ""])[0])
    got = {}
    for r in tokenpack.unpacked(packed, 64).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    for d, lists in want.items():
        if len(lists) == 1:
            assert got.get(d, []) == lists[0]
        else:
            assert sorted(got[d]) == sorted(lists[0] + lists[1])
    tokenpack.write_packed(packed, str(tmp_path / "packed"))
    again = spark.read.parquet(str(tmp_path / "packed"))
    assert sorted(map(tuple, tokenpack.unpacked(again, 64).collect())) == sorted(map(tuple, tokenpack.unpacked(packed, 64).collect()))
    for r in packed.collect():
        cu, pos = r["cu_seqlens"], np.frombuffer(r["position_ids"], "<u2")
        assert cu[-1] == r["n_tokens"] <= 64 and all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(cu, cu[1:]))
    assert tokenpack.pack(spark, none, path, P.PATTERN, 50256).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        lengths = rnd.integers(1, 33, 60).tolist()
        room, bins = [], []
        for k in sorted(range(60), key=lambda k: (-lengths[k], k)):
            fits = [(r, b) for b, r in enumerate(room) if r >= lengths[k]]
            if not fits:
                room.append(32)
                bins.append([])
                fits = [(32, len(room) - 1)]
            b = min(fits)[1]
            room[b] -= lengths[k]
            bins[b].append(k)
        got = tokenpack.best_fit_decreasing(lengths, 32)
        assert sorted(sum(got, [])) == list(range(60)) and len(got) == len(bins) and sorted(sum(lengths[k] for k in b) for b in got) == sorted(sum(lengths[k] for k in b) for b in bins)


def test_length_buckets(spark, docs, none):
    x, n = [1, 3, 4, 9, 10, 20, 21], [5, 1, 7, 2, 8, 1, 3]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(x, n))
    for k in range(1, 8):
        best = min(cost([*s, 21]) for m in range(k) for s in combinations(x[:-1], m))
        assert cost(lengthpack.best_boundaries(x, n, k)) == best
    rnd = np.random.default_rng(4)
    for _ in range(60):  # many lengths, against all choices of up to three boundaries
        x = sorted(set(rnd.integers(0, 60, rnd.integers(1, 20)).tolist()))
        n = rnd.integers(1, 30, len(x)).tolist()
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(x, n))  # noqa: E731, B023
        for k in (1, 2, 3):
            assert cost(lengthpack.best_boundaries(x, n, k)) == min(cost([*s, x[-1]]) for m in range(k) for s in combinations(x[:-1], m))
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    encode = tokenpack.rank_encoder(open(path, encoding="ascii").read(), P.PATTERN)
    got = lengthpack.pack_texts(spark, docs, path, P.PATTERN, buckets=3, budget=1000).collect()
    assert len(got) == docs.count() and all(r["n_tokens"] <= r["boundary"] for r in got)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((r["doc_id"], len(encode([r["text"] or ""])[0])) for r in docs.collect())
    counts = {}
    for r in got:
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + 1
    points = sorted(counts)
    least = min(sum(counts[v] * (min(b for b in (*s, points[-1]) if b >= v) - v) for v in points) for m in range(3) for s in combinations(points[:-1], m))
    assert sum(r["boundary"] - r["n_tokens"] for r in got) == least
    by = {}
    for r in got:
        by.setdefault(r["batch"], []).append(r)
    for rows in by.values():
        assert len(rows) == rows[0]["batch_rows"] and sorted(r["place"] for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0]["boundary"] <= 1000
    assert lengthpack.pack_texts(spark, none, path, P.PATTERN).count() == 0
    assert lengthpack.pack_texts(spark, frame(spark, ["a b"] * 9, [None] * 9), path, P.PATTERN, budget=4).select("batch", "place").distinct().count() == 9


def test_content_sort(spark, docs, none, monkeypatch):
    def hold(df):
        rows = df.collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        got = contentsort.dedup_report(spark, df).collect()
        assert len(got) == len(rows)
        groups, kept = {}, {}
        for r in rows:
            groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
        by_id = {r["doc_id"]: norm(r["text"]) for r in rows}
        for r in got:
            ids = groups[by_id[r["doc_id"]]]
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(ids), len(ids), sha(by_id[r["doc_id"]]))
            kept[r["keep_id"]] = kept.get(r["keep_id"], 0) + r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1}

    hold(docs)
    monkeypatch.setattr(contentsort, "SMALL_GROUP", 3)
    hold(frame(spark, ["hot text"] * 60 + ["hot  text"] * 9 + [None, "", "x", "y", "y"], [*range(100, 169), 1, 2, 3, 4, 5]))
    same = contentsort.dedup_report(spark, frame(spark, ["hot text"] * 40 + ["z"] * 3, [7] * 40 + [None] * 3)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in same if r["kept"]) == [(0, 0, 3), (7, 7, 40)]
    monkeypatch.undo()
    assert contentsort.dedup_report(spark, none).count() == 0
    out = contentsort.exact_dedup(spark, docs)
    assert out.select("row.*").columns == docs.columns and out.where("row.h <> 'h' OR row.norm <> 'norm'").count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(ascii_lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    return [len(s) for s in sets], label


def test_jaccard(spark, docs, none, monkeypatch):
    import random

    rnd = random.Random(5)
    texts = list(TEXTS)
    passage = [f"p{k}" for k in range(30)]
    for g in range(6):
        base = [f"g{g}w{rnd.randint(0, 60)}" for _ in range(rnd.choice([12, 60, 150]))]
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = f"e{rnd.randint(0, 5)}"
            texts.append(" ".join((t + passage if rnd.random() < 0.3 else t)[rnd.randint(0, 2) :]))
    # a group of which few pairs link, but all nearly do: similarities from 0.75 to 0.83
    core = [f"c{k}" for k in range(140)]
    for k in range(40):
        texts.append(" ".join(core + [f"own{k}x{j}" for j in range(rnd.choice([14, 18, 22, 22, 22]))]))
    n, label = brute_components(texts)
    assert 1 < len({label[k] for k in range(len(texts) - 40, len(texts))}) < 40
    for tile in (2048, 7):
        monkeypatch.setattr(jaccard, "TILE", tile)
        got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark, frame(spark, texts)).collect()}
        assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in range(len(texts))] == list(zip(n, label))
    again = jaccard.near_duplicates(spark, docs).collect()
    assert len(again) == len(TEXTS) + 1
    assert jaccard.near_duplicates(spark, none).count() == 0
    # without ids, and one id for two texts
    other = " ".join(f"o{k}" for k in range(60))
    mixed = frame(spark, [BASE, BASE + " tail", BASE + " end", other, BASE, "", None], [None, 40, 41, 40, None, None, None])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in jaccard.near_duplicates(spark, mixed).collect())
    size = lambda t: brute_components([t])[0][0]
    assert got == sorted([(0, 40, size(BASE))] * 2 + [(40, 40, size(BASE + " tail")), (41, 40, size(BASE + " end")), (40, 40, 56), (0, 0, 0), (0, 0, 0)])


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in jaccard.connected(spark, edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 90, 95: 90, 90: 90}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    good = [f"{' '.join(f'word{(k * 7 + j * j) % 997}' for j in range(80))}" for k in range(12)]
    df = frame(spark, [*good, good[0], good[1] + " end", "short text", None, "1 2 3"], None, ["en"] * 17).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()) == list(range(12))
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, df.limit(0), str(tmp_path)).columns == df.columns
