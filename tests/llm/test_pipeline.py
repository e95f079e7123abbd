import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(Path(__file__).resolve().parent), str(ROOT), str(ROOT / "tests")]
from helpers import documents, frame, sentence
from oracle import compare_rows, connect

import __spark_entry__ as registry
import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [n for n in registry.queries() if n.startswith("op") and n in registry.oracle_sql()]


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    assert compare_rows(registry.queries()[name](spark, SF_DIR), connect(SF_DIR), registry.oracle_sql()[name]) == ""


def test_all_queries_are_registered():
    names = registry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(12)
    rows = documents(90)
    item = sentence(rng, "xa", 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = sentence(rng, "xb", 150)
    plain = lambda i, t: (i, t, "xa", "s", len(t), None, None, None, None, None)
    rows += [plain(500, f"{sentence(rng, 'xa', 20)} {item.upper()} {sentence(rng, 'xa', 20)}"), plain(501, near), plain(502, near + " lo"),
             plain(503, sentence(rng, "xa", 30) + " write to a.b@c.org now")]
    docs = frame(spark, rows).coalesce(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in found] for name, found in kept.items()}
    odd = {90, 91, 92, 93}  # null, empty, blank, without letters
    language, near_dedup, leaks, pii = ids.values()
    assert set(language) == ({r[0] for r in rows} - odd) and language.count(0) == 3
    assert set(near_dedup) == set(language) - {502} and len(near_dedup) == len(set(near_dedup))
    assert set(leaks) == set(near_dedup) - {500} and len(pii) == len(leaks)
    text = next(r for r in kept["PII"] if r["doc_id"] == 503)
    assert text["text"].endswith("write to [EMAIL] now") and text["n_chars"] == len(text["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(pii)
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in {r["doc_id"]: r for r in pieces}.values())
    assert np.frombuffer(pieces[0]["ids"], "<u4").size == pieces[0]["length"]


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
    with pytest.raises(Exception):
        corpus_pipeline.STAGES[0][1](spark, docs.drop("text"), str(tmp_path))


def test_the_rest_imports_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("leverscope.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "infer_types" in e.queries() and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
