"""The stages one after another, against what brute force keeps."""

import subprocess
import sys

import corpus_pipeline
import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns, name
    assert sizes == sorted(sizes, reverse=True)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mixing"]


def test_run_returns_the_mix(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.taken in (r["size"], 2 * r["size"]) for r in rows)


def test_entry_works_without_the_operators():
    code = (
        "import sys; sys.modules['replyloom.llm'] = None; import __spark_entry__ as e; "
        "assert e.queries() and not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=entry_module._HERE, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
