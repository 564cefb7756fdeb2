"""The pipeline's stages, each against a plain computation on its own input."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline as cp
from tessel.llm import pii
from tessel.llm.common import durable, table

sys.path.insert(0, str(Path(__file__).parent))
from test_shingle_join import components, shingles  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    tables = [docs]
    for name, stage in cp.STAGES:
        tables.append(durable(stage(spark, tables[-1], SF), name))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables[:-1]]
    start, clean, single, apart, masked = rows
    gone = set(start) - set(clean)
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(start) and sum(labels.get(i) == 1 for i in clean) <= 0.4 * sum(labels.values())
    groups = defaultdict(list)
    for i, r in clean.items():
        groups[r["text"]].append(i)
    assert set(single) == {max(g) for g in groups.values()}

    # all pairs of a similarity of 0.8 or more, and no others, are linked
    component = components({i: shingles(r["text"]) for i, r in single.items()})
    assert set(apart) == set(component.values()) and len(apart) < len(single)
    assert set(masked) == set(apart)
    for i, r in masked.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == apart[i]["text"] or "[" in r["text"]
    packed = tables[-1].collect()
    assert {r["doc_id"] for r in packed} == set(masked)
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) / 4096 * 1.02 + 2


def test_rows_that_repeat_or_lack_values(spark):
    rows = [(1, "same text here", "en", "a", 3), (1, "same text here", "en", "a", 3), (None, "same text here", None, None, None), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, "other words in this one", "en", "a", 9)]
    docs = durable(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "odd")
    for stage, want in ((cp.toxic_go, 6), (cp.exact_copies_go, 3), (cp.near_copies_go, 3), (cp.personal_data_masked, 6), (cp.packed, 6)):
        assert stage(spark, docs, SF).count() == want, stage


def test_empty_table_runs_through(spark):
    docs = durable(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "none")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
