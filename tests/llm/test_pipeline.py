import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from minpairs.llm import classifier, minhash, packing  # noqa: E402

from . import test_exact, test_minhash, test_mixing  # noqa: E402
from .conftest import words  # noqa: E402
from .test_rules import good, junk  # noqa: E402

DOCS = [(k, junk(k) if k % 5 == 0 else good(k), ["en", "de", "fr"][k % 3], f"src{k % 4}") for k in range(160)]
DOCS += [(1000 + k, good(1 + k % 3).upper() if k % 2 else good(1 + k % 3), "en", "src0") for k in range(12)]
DOCS += [(2000 + k, t, "en", "src1") for k, t in enumerate(test_minhash.cloud(15, words(150, 77, 10**5), 4, 7))]


@pytest.fixture(scope="module")
def folder(spark, docs_of, labels_of, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs_of(DOCS).write.parquet(f"{d}/documents.parquet")
    labels_of([(k, int(k % 5 != 0)) for k in range(160)]).write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_stages_against_plain_versions(spark, folder, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    model = classifier.train_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_classifier":
            good_ids = {r["doc_id"] for r in classifier.classify(docs, model).collect() if r["predicted"]}
            want = [r for r in before if r[0] in good_ids]
            assert sum(r[0] % 5 == 0 and r[0] < 160 for r in want) <= 2 and len(want) >= 150  # junk goes, clean documents stay
        elif name == "exact_dedup":
            keep = {r[0] for r in test_exact.brute(before) if r[3]}
            want = [r for r in before if r[0] in keep]
            assert len(want) < len(before)
        elif name == "minhash_near_dedup":
            keep = {r[0] for r in test_minhash.brute(before, percent=80) if r[3]}
            want = [r for r in before if r[0] in keep]
            assert len(want) < len(before)
        elif name == "mix_sources":
            got = rows_of(out)
            assert set(got) <= set(before) and max(got.count(r) for r in set(got)) <= 2
            total = sum(len(r[1].split()) for r in before)
            assert abs(sum(len(r[1].split()) for r in got) - total) <= 0.1 * total
            want = got
        if name != "pack":
            assert out.columns == columns and rows_of(out) == sorted(want)
            docs, before = out, rows_of(out)
    want = packing.token_pieces(docs, __import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert out.agg(F.sum("length"), F.sum("ids_crc32")).first() == want.agg(F.sum("length"), F.sum("ids_crc32")).first()


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_odd_rows(spark, docs_of, labels_of, tmp_path, odd_rows):
    """Null, empty and blank texts, null and repeated ids, repeated rows, extra columns with names the stages use."""
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src1") for k, (i, t, *_) in enumerate(odd_rows)] + DOCS
    docs_of(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    labels_of([(k, int(k % 5 != 0)) for k in range(160)] + [(None, 1), (5, None), (6, 1), (6, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, [docs.count()]
    seen = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if name != "pack":
            assert docs.columns == columns and {(r["doc_id"], r["text"]) for r in docs.collect()} <= seen
            counts.append(docs.count())
        if name == "exact_dedup":
            norm = [test_exact.brute([(0, r["text"])])[0][4] for r in docs.where("doc_id is not null").collect()]
            assert len(norm) == len(set(norm))
        if name == "mix_sources":
            assert docs.where("text is null or trim(text) = ''").count() == 0
    assert counts[1] <= counts[0] and counts[3] <= counts[2] <= counts[1]
    from minpairs.llm import common

    before = spark._jvm.org.apache.hadoop.fs.Path(common.scratch_base(spark))
    listing = lambda: {x.getPath().getName() for x in before.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(before)}
    old = listing()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert not any(x.startswith("scope-") for x in listing()) and len(listing() - old) <= 4 + 4  # the stored stages, and the last one's own tables


def test_empty_tables(spark, docs_of, labels_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    labels_of([]).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_near_stage_takes_pairs_from_80_percent(spark, docs_of):
    rows = []
    for k in range(30):  # 96 shingles each; two changed words leave 86 of 106 (0.81), three 81 of 111 (0.73)
        w = words(100, 5000 + k, 10**6)
        other = list(w)
        for at in (20, 50, 80)[:2 + (k % 3 == 0)]:
            other[at] = f"z{k}y{at}"
        rows += [(2 * k, " ".join(w), "en", "src0"), (2 * k + 1, " ".join(other), "en", "src0")]
    want = {r[0] for r in test_minhash.brute(rows, percent=80) if r[3]}
    assert len(want) == 40 and all(r[3] for r in test_minhash.brute(rows))
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs_of(rows), "").collect()} == want


def test_bands_follow_the_threshold():
    assert minhash.banding(85) == (7, 36) and minhash.banding(80) == (6, 42)
    for percent in (50, 70, 80, 85, 90, 95):
        size, bands = minhash.banding(percent)
        assert size * bands <= minhash.REGISTERS and (1 - (percent / 100) ** size) ** bands <= 1e-5
