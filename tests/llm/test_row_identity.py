"""Rows keep their identity when Spark splits the same files differently from one scan to the next, as after the loss of an executor."""

import itertools

import pytest

import corpus_pipeline as cp
from tessel.llm import common, exact_dedup, shingle_join, suffix_dedup, warc
from tessel.llm.common import durable, new_path, numbered, table

SF = "/root/testdata/sf0.001"
SIZE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def moving(spark, monkeypatch):
    """Each written table is followed by other splits."""
    sizes, before = itertools.cycle(["20k", "7k", "64m"]), spark.conf.get(SIZE)

    def write(df, *args, **kwargs):
        out = common.durable(df, *args, **kwargs)
        spark.conf.set(SIZE, next(sizes))
        return out

    for module in (cp, exact_dedup, shingle_join, suffix_dedup, warc):
        monkeypatch.setattr(module, "durable", write)
    yield
    spark.conf.set(SIZE, before)


@pytest.fixture
def docs(spark):
    return durable(table(spark, SF, "documents").repartition(7, "doc_id"), "seven")


def test_numbers(spark, docs):
    before, found = spark.conf.get(SIZE), []
    for frame in (docs, docs.where("doc_id % 3 > 0").select("doc_id", "text"), docs.groupBy("doc_id").count()):
        rows = numbered(frame, "row").select("doc_id", "row")
        for size in ("64m", "5k", "64k"):
            spark.conf.set(SIZE, size)
            found.append(sorted(map(tuple, rows.collect())))
        spark.conf.set(SIZE, before)
        assert found[-1] == found[-2] == found[-3] and len({r for _, r in found[-1]}) == frame.count()


def test_suffix_dedup(spark, docs, moving):
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    spark.conf.set(SIZE, "64m")
    with pytest.MonkeyPatch.context() as still:
        still.setattr(suffix_dedup, "durable", common.durable)
        still.setattr(exact_dedup, "durable", common.durable)
        assert got == sorted(map(tuple, suffix_dedup.remove_repeats(docs.coalesce(1)).collect()))
    assert sum(r[2] for r in got)


def test_pipeline_stages(spark, docs, moving):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    single = durable(cp.exact_copies_go(spark, docs, SF), "single")
    assert {r["doc_id"] for r in single.collect()} == {max(i for i in texts if texts[i] == t) for t in set(texts.values())}
    least = {r["doc_id"]: r["component_id"] for r in shingle_join.near_groups_by_similarity(single).collect()}
    assert {r["doc_id"] for r in cp.near_copies_go(spark, single, SF).collect()} == set(least.values())


def test_warc(spark, moving):
    inner = f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: 3{warc.END}abc{warc.END}"
    pages = [(i, f"http://a/{i}", f"{i} " * (40 * (i % 9)) + inner * (i % 4) + "end" * (i % 5)) for i in range(400)]
    path = new_path(spark, "warc-moving")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), path, min_revisit=10**9)
    got = [(r["url"], bytes(r["payload"]).decode()) for r in warc.read_warc(spark, path, keep_payload=True).collect()]
    assert sorted(got) == sorted((u, h) for _, u, h in pages)
