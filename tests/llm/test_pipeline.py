import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from fairlead.llm import quality
from fairlead.llm.shared import shared_dir, written

from .conftest import texts_of
from .test_mixing import source_targets
from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    folder, docs = shared_dir(spark, "pipeline-test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(cp.STAGES):
        out.append(docs := written(stage(spark, docs, SF), f"{folder}/{n}"))
    return out


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_keeps_what_is_predicted_good(spark, stages):
    good = {r["doc_id"] for r in quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(stages[1]) == Counter({k: n for k, n in rows(stages[0]).items() if k[0] in good}) and stages[1].columns == stages[0].columns


def test_exact_dedup_keeps_one_of_equal_texts(stages):
    groups = defaultdict(list)
    for i, t in texts_of(stages[1]):
        groups["".join(WORD.findall(t))].append((-len(t), i, t))
    assert rows(stages[2]) == Counter((min(own)[1], min(own)[2]) for own in groups.values())


def test_near_dedup_keeps_one_of_each_component(stages):
    want = {i for i, _, _, kept in near_brute(texts_of(stages[2]), 80) if kept}
    assert {r["doc_id"] for r in stages[3].collect()} == want and stages[3].count() == len(want)


def test_numbers_stay_when_files_are_split_otherwise(spark):
    path = f"{shared_dir(spark, 'numbers-test')}/docs"
    for n in (5, 40, 200):
        spark.range(n).selectExpr("id + %d AS doc_id" % n, "string(id) AS text", "'en' AS lang", "'a' AS source", "id AS n_chars").coalesce(1).write.mode("append").parquet(path)
    found = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        try:
            found.append(sorted(map(tuple, cp.numbered(spark.read.parquet(path)).collect())))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] and len({r[-1] for r in found[0]}) == 245


def test_mixing_meets_the_targets(stages):
    size, taken, source, text = Counter(), Counter(), {}, {}
    for r in stages[3].collect():
        size[r["source"]] += len(WORD.findall(r["text"]))
        source[r["doc_id"]], text[r["doc_id"]] = r["source"], r["text"]
    copies = Counter()
    for r in stages[4].collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r["source"] == source[r["doc_id"]] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(WORD.findall(r["text"]))
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    for s, target in source_targets(dict(size)).items():
        assert abs(taken[s] - target) <= 2.5


def test_packing_holds_every_id(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(e.ids) + 1 for e in slow.encode_batch([t for _, t in texts_of(stages[4])], add_special_tokens=False))
    assert sum(r["length"] for r in stages[5].collect()) == want


def test_odd_and_empty_tables_pass_every_stage(spark, odd, none):
    for docs in (odd.select(cp.COLUMNS), none.select(cp.COLUMNS)):
        folder = shared_dir(spark, "pipeline-odd")
        for n, (_, stage) in enumerate(cp.STAGES):
            docs = written(stage(spark, docs, SF), f"{folder}/{n}")
        docs.count()


@pytest.mark.parametrize("words", [0, cp.WORDS])
def test_rows_kept_are_those_of_their_numbers_within_the_bound_and_beyond(spark, monkeypatch, words):
    monkeypatch.setattr(cp, "WORDS", words)
    path = f"{shared_dir(spark, 'bits-test')}/docs"
    for n in (1, 63, 64, 65, 300):
        spark.range(n).selectExpr("id + %d AS doc_id" % (1000 * n), "string(id) AS text", "'en' AS lang", "'a' AS source", "id AS n_chars").coalesce(1).write.mode("append").parquet(path)
    docs = cp.numbered(spark.read.parquet(path))
    for rule in ("true", "false", "doc_id % 64 in (0, 62, 63)", "doc_id % 7 = 3"):
        want = sorted(r["doc_id"] for r in docs.where(rule).collect())
        assert sorted(r["doc_id"] for r in cp.only(docs, docs.where(rule).select("_row")).collect()) == want
