"""The pipeline's stages, each on its own input, against brute force; and life without this subpackage."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from cutledger.llm.scratch import cut

from .common import docs, edge_docs, prose
from .test_near import brute

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, data):
    rest = spark.read.parquet(f"{data}/documents.parquet")
    columns = rest.columns
    for name, stage in P.STAGES:
        out = cut(stage(spark, rest, data), name)
        if name == "sentencepiece":
            assert out.count() == rest.count() and out.where("not same_text").count() == 0
            break
        assert out.columns == columns
        if name == "minhash_near_dedup":
            rows = sorted((r.doc_id, r.text) for r in rest.collect())
            label, _ = brute([t for _, t in rows], 5)
            assert sorted(r.doc_id for r in out.collect()) == [rows[i][0] for i, c in enumerate(label) if c == i]
        elif name == "pii":
            assert out.count() == rest.count()
        else:
            assert out.join(rest, "doc_id", "left_anti").count() == 0 and out.count() < rest.count()
        rest = out
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (3, "q r s t u v"), (3, "other words in this row"), (None, "lone text of six words here"), (4, ""), (5, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long")
    got = P.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f g"), (3, "q r s t u v"), (3, "other words in this row"), (None, "lone text of six words here"), (4, ""), (5, None)], key=str)


@pytest.mark.parametrize("name", ["quality_classifier", "benchmark_decontamination", "pii", "sentencepiece"])
def test_stages_on_edges(spark, data, name):
    """Nulls, empty and very long texts, repeats, an empty table, and columns with the names that operators use."""
    stage = dict(P.STAGES)[name]
    frame = edge_docs(spark).withColumnsRenamed({"n": "_row", "cls": "_id", "score": "_key"})
    out = stage(spark, frame, data)
    rows = out.collect()
    if name == "sentencepiece":
        assert len(rows) == 11 and all(r.parity and r.same_text for r in rows)
    else:
        assert out.columns == frame.columns
        key = lambda r: (str(r.doc_id), str(r.text))
        mine, before = Counter(map(key, rows)), Counter(map(key, frame.collect()))
        assert mine <= before and (name == "quality_classifier" or mine == before)
        # of repeated rows all stay or none
        assert all(n == before[k] for k, n in mine.items())
        assert all((r._row, r._id, r.text_key, r._key) == (1, 2, 3, 4.0) for r in rows)
    assert stage(spark, frame.limit(0), data).count() == 0


def test_a_planted_passage_goes_and_its_neighbours_stay(spark, data):
    item = max((r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()), key=len)
    words = item.split()
    rng = random.Random(3)
    near = [w if i % 9 else "zzz" for i, w in enumerate(words)]
    texts = [prose(60, rng), f"{prose(9, rng)} {item} {prose(9, rng)}", f"{prose(9, rng)} {' '.join(near)}", " ".join(words[:6]) + " " + prose(40, rng)]
    out = P.decontaminate(spark, docs(spark, texts), data)
    assert sorted(r.doc_id for r in out.collect()) == [0, 3]


def test_entry_works_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, ops, pipeline = out.stdout.split()
    assert int(n) > 50 and (ops, pipeline) == ("False", "False")
