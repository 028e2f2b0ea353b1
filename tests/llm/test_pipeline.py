import inspect
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cytoplan.llm import common, near_dedup, queries, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.documents(spark, SF), []
    for _, f in corpus_pipeline.STAGES:
        docs = common.materialize(f(spark, docs, SF), "t")
        out.append(docs)
    return out


def test_stages(spark, stages):
    spm = pytest.importorskip("sentencepiece")
    docs = common.documents(spark, SF)
    toxic, near, cut, mixed, last = stages
    assert all(x.columns == COLUMNS for x in stages[:-1])
    flagged = {r.doc_id for r in toxicity.predict(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in toxic.collect()} == {r.doc_id for r in docs.collect()} - flagged
    kept = {r.doc_id for r in near_dedup.near_duplicates(toxic).filter("kept").collect()}
    assert {r.doc_id for r in near.collect()} == kept
    texts = {r.doc_id: r.text for r in near.collect()}
    for r in cut.collect():
        assert len(r.text) <= len(texts[r.doc_id]) and r.n_chars == len(r.text)
    text_of = {r.doc_id: r.text for r in cut.collect()}
    assert all(r.text == text_of[r.doc_id] for r in mixed.collect())
    lib = spm.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    rows = last.collect()
    assert len(rows) == mixed.count()
    for r in rows[:60]:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(text_of[r.doc_id], add_bos=True, add_eos=True)


def test_run_equals_its_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert "except" not in inspect.getsource(corpus_pipeline)


def test_entry_works_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    import shutil

    shutil.copytree(root / "cytoplan", tmp_path / "cytoplan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"}, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr[-800:]
