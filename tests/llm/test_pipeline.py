"""The pipeline against brute-force versions of its stages, on rows of the given tables and planted ones."""

import os

import pytest

import corpus_pipeline
from wardline.llm import quality
from wardline.llm.common import crc_share

from .test_decontam import plain as plain_contaminations
from .test_shingles import plain_kept, plain_pairs
from .test_substrings import plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with planted rows: copies, a benchmark item, a passage, a loop, null and empty texts."""
    out = str(tmp_path_factory.mktemp("tables"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").collect()
    good = max((r for r in some if r.n_chars > 2000 and r.lang == "en" and "$$$" not in r.text and "!!" not in r.text), key=lambda r: r.doc_id)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    planted = [
        (9001, good.text, "en", "src1", 0), (9002, good.text + " more", "en", None, 0), (9003, good.text[:900] + ". " + item, "en", "src1", 0),
        (9004, "Of " * 400, "en", "src2", 0), (9005, None, "en", "src2", 0), (9006, "", None, "src2", 0), (9001, good.text, "en", "src1", 0),
    ]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{out}/documents.parquet")
    return out


def test_each_stage_against_plain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = (before, [tuple(r) for r in docs.collect()])
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, now = after["quality"]
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(crc_share("doc_id", 4) != 2)
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    scores = [float(model.scores([(r[1] or "").encode()], {})[0]) for r in before]
    assert sorted(now, key=repr) == sorted((r for r, s in zip(before, scores) if s >= 0.7), key=repr)
    assert 9004 not in {r[0] for r in now} and 9001 in {r[0] for r in now}

    before, now = after["near_dedup"]
    rows = [(r[0], r[1]) for r in before]
    assert sorted(r[0] for r in now) == plain_kept(rows, plain_pairs(rows))
    assert not {9001, 9002} & {r[0] for r in now} and not set(now) - set(before)

    before, now = after["substring_dedup"]
    spans = {}
    for d, a, b in plain_spans([(r[0], r[1]) for r in before]):
        spans.setdefault(d, []).append((a, b))
    left = {r[0]: r for r in now}
    assert sorted(left) == sorted(r[0] for r in before) and len(spans) > 3
    for d, text, *others in before:
        cut, at = [], 0
        for a, b in sorted(spans.get(d, [])):
            cut.append(text[at:a])
            at = b
        cut = "".join(cut) + text[at:]
        assert left[d] == (d, cut, *others[:2], len(cut) if d in spans else others[2])

    before, now = after["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, *_ in plain_contaminations([(r[0], r[1]) for r in before], items)}
    assert sorted(now, key=repr) == sorted((r for r in before if r[0] not in bad), key=repr)
    assert 9003 not in {r[0] for r in now}

    before, now = after["mixing"]
    words = {r[0]: len(r[1].split()) for r in before}
    assert {(r[0], r[1]) for r in now} == set(words.items())
    assert all(0 <= r[4] <= 3 * r[1] for r in now)


def test_run_agrees_with_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, spark.read.parquet(f"{folder}/mixing").collect()))
    assert os.path.isdir(f"{folder}/quality")
