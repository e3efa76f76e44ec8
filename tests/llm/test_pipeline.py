"""The pipeline end to end at the smallest scale, against plain versions of what its stages promise."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_pipeline(spark):
    import corpus_pipeline as cp

    from tracekit.llm.common import read, written
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    before = seen["quality_rules"]
    assert before and not any(brute.quality(t)[-1] for t in before.values())
    kept = {i: t for i, (_, gone, t) in brute.line_runs(list(before.items())).items() if t.split() or not gone}
    assert seen["line_dedup"] == kept
    assert set(seen["near_dedup"]) == {i for i, _, _, keep in brute.near(list(kept.items()), shingle=5) if keep}
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in brute.contamination(list(seen["near_dedup"].items()), bench) if not r[-1]}
    assert set(seen["decontamination"]) == clean
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()} == clean
    assert {r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()} == clean
