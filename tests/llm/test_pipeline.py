"""The pipeline against a plain version, stage by stage, on a small table."""

import collections
import importlib.util
import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from provlake.llm import toxicity
from provlake.llm.queries import tokenizer_path

_spec = importlib.util.spec_from_file_location("brute", os.path.join(os.path.dirname(__file__), "brute.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_against_plain_versions(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id limit 120").fetchall()
    docs += [(900, docs[5][1] + " " + bench[0][1], "en", "src0", 1), (901, docs[5][1], "en", "src1", 1), (902, None, None, None, None), (903, "", "en", "src1", 0)]
    docs += [(1000 + i, f"zorg{i} is zorg{i} " + docs[i][1][:400], "en", "src2", 1) for i in range(30)]
    labels = [(d, 1, int(d >= 1000)) for d, *_ in docs if d not in (902, 903)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*docs)), strict=True))), tmp_path / "documents.parquet")
    pq.write_table(pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*labels)), strict=True))), tmp_path / "labels.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)
    monkeypatch.setattr(toxicity, "STEPS", 60)
    sf = f"file://{tmp_path}"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns

    def after(k):
        out = corpus_pipeline.STAGES[k][1](spark, now, sf)
        path = f"{sf}/stage{k}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    before = {d: t for d, t, *_ in docs}
    # the model is the one that the stage fits: it is a function of the tables
    model = toxicity.fit_toxicity(now, spark.read.parquet(f"{sf}/labels.parquet"))
    score, *_ = toxicity.score_texts(model, pa.array([before[d] for d in sorted(before)]))
    now = after(0)
    kept = {r.doc_id for r in now.collect()}
    assert now.columns == columns and kept == {d for d, s in zip(sorted(before), score, strict=True) if s < 0.5}
    classes = brute.near_dup([(d, before[d]) for d in kept], 5)
    now = after(1)
    kept = {r.doc_id for r in now.collect()}
    assert now.columns == columns and kept == {d for d, (_, _, k) in classes.items() if k}
    now = after(2)
    hit = {r[0] for r in brute.contamination([(d, before[d]) for d in kept], bench) if r[5]}
    kept = {r.doc_id for r in now.collect()}
    assert now.columns == columns and kept == set(classes) & kept and not kept & hit and len(kept) == len({d for d, (_, _, k) in classes.items() if k}) - len(hit)
    source = {r.doc_id: r.source for r in now.collect()}
    now = after(3)
    copies = collections.Counter(r.doc_id for r in now.collect())
    size = {d: len((before[d] or "").split()) for d in kept}
    assert now.columns == columns and set(copies) <= kept and max(copies.values()) <= 2
    total, taken = sum(size.values()), sum(size[d] * n for d, n in copies.items())
    assert abs(taken - 1.5 * total) <= sum(max(size[d] for d in kept if source[d] == s) for s in set(source.values()))
    out = sorted(after(4).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(tokenizer_path())
    at = 0
    assert [r.doc_id for r in out] == sorted(copies.elements())
    for r in out:
        ids = np.array([*tok.encode(before[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_rest_works_without_these_folders(tmp_path):
    for name in ("provlake", "tests", "__spark_entry__.py", "bench.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
