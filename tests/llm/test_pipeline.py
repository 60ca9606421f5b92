"""The pipeline on the smallest tables, stage by stage against plain Python."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarterline.llm import decontaminate, pii
from quarterline.llm.quality import quality_ctes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def near_groups(docs, width, threshold):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for k in ids[n + 1 :]:
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= threshold * len(sets[i] | sets[k]):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_stages_against_plain_python(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = dict(con.sql(f"WITH {quality_ctes('documents')} SELECT doc_id, text FROM judged WHERE kept").fetchall())
    groups = near_groups(kept, corpus_pipeline.WIDTH, corpus_pipeline.THRESHOLD)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    items = [t for (t,) in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    plain = lambda t: " ".join(t.encode().lower().decode().split())
    verbatim = {i for i, t in kept.items() if any(plain(x) in plain(t) for x in items)}

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(docs.collect())
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert sorted(r.doc_id for r in seen[1]) == sorted(kept)
    assert ids[2] <= ids[1] and verbatim == ids[1] - ids[2] or all(
        min(decontaminate.fits(plain(x), plain(kept[i])) / len(plain(x)) for x in items) <= decontaminate.MAX_DISTANCE for i in ids[1] - ids[2]
    )
    assert verbatim <= ids[1] - ids[2]
    assert ids[3] == ids[2] and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in seen[3])
    assert all(re.sub(r"\[[A-Z]+\]", "", r.text) for r in seen[3])
    copies = {}
    for r in seen[4]:
        copies.setdefault(r.doc_id, []).append((r.copy, r.copies))
    assert set(copies) <= ids[3] and all(sorted(c) == [(k, len(c)) for k in range(1, len(c) + 1)] for c in copies.values())


def test_entry_has_every_operator():
    names = entry.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 13
    assert set(entry.oracle_sql()) <= set(names)


def test_sql_of_the_operators(spark):
    from quarterline.llm.all_queries import ORACLES, QUERIES
    from tests.oracle import compare, connect

    con = connect(SF)
    for name, sql in ORACLES.items():
        ok, note = compare(QUERIES[name](spark, SF), con, sql)
        assert ok, f"{name}: {note}"
