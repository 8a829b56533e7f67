"""Operators whose results depend on all of a text or a graph."""

import pytest

from siltworks.llm import common, licenses, urlgraph

WRAPPED = {
    "mit": "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software)\n */",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.",
    "gpl": "This work is licensed under the GNU General\nPublic License version 3",
    "apache": "Licensed under the Apache License,\nVersion 2.0",
}


def test_licenses_wrapped_over_lines(spark):
    texts = [*WRAPPED.values(), "permission is hereby granted free of charge\n" + "other words here\n" * 20 + "to any person obtaining a copy of this software and files", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(spark, docs).collect()}
    for k, label in enumerate(WRAPPED):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1
    assert got[len(WRAPPED)]["labels"] == "" and got[len(WRAPPED) + 1]["labels"] == ""


def test_rules_say_what_the_contract_lists(spark):
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.text}" for r in urlgraph.RULES] == listed.split(", ")
    rows = [(k, u, None) for k, u in enumerate(["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://b.example.net/de/8", "http://example.net/de/9", "http://a.org/es/"])]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlgraph.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]


def test_ranks_converge_on_a_long_chain(spark):
    n = 12  # the last host of the chain is more than 8 links away from the blocked one
    link = lambda k: f'<a href="http://h{k}.test/">'
    rows = [(k, f"http://h{k}.test/", link(k + 1) if k < n - 1 else '<a href="//bad.com/en/">') for k in range(n)] + [(n, "http://bad.com/en/", None), (n + 1, "http://x.example.com/en/7", None)]
    got = {r["page_id"]: r for r in urlgraph.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hosts = n + 3  # the chain, bad.com, x.example.com and its parent
    for k in range(n):
        lift = 0.15 * 0.85 ** (n - k) / ((1 - 0.85 ** (n - k + 1)) / hosts)
        assert got[k]["distrust"] == pytest.approx(0.15 * 0.85 ** (n - k), abs=1e-9) and got[k]["trust"] == 0
        assert got[k]["distrust_lift"] == pytest.approx(lift, abs=1e-4) and got[k]["verdict"] == ("block" if lift >= urlgraph.BLOCK_LIFT else "allow")
    assert {got[k]["verdict"] for k in range(n)} == {"block", "allow"}


def test_staged_tables_go_with_their_scope(spark):
    import os

    at = lambda df: df._staged_path.removeprefix("file:")
    with common.scratch() as keep:
        gone = common.staged(spark, spark.range(3), "gone")
        kept = keep(common.staged(spark, spark.range(4), "kept", "zstd"))
        folder = common.folder(spark, "runs")
        spark.range(1).write.parquet(folder)
    assert not os.path.exists(at(gone)) and not os.path.exists(folder.removeprefix("file:")) and kept.count() == 4
    common.discard(spark, kept)
    assert not os.path.exists(at(kept))
