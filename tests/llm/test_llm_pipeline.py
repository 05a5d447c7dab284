"""The pipeline's stages against brute-force versions, each on what the one before kept."""

import random

import corpus_pipeline
import numpy as np
import pytest
from posegrid.llm import pii
from posegrid.llm.queries import queries, tokenizer_file
from pyspark.sql import functions as F

from test_llm_operators import brute_components, edited, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(21)
    passage = prose(rng, 90)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [*base, None, "", "12 34 !!", *[edited(rng, b, 1) for b in base[:4]], base[5], base[5]]
    texts += [f"{prose(rng, 30)} mail jane{i}@site.org or +1 (555) 123-4567 {prose(rng, 30)} {passage} {prose(rng, 30)}" for i in range(3)] + [prose(rng, 9000)]
    short = " ".join(f"word{rng.randrange(10)}" for _ in range(52))
    texts += [f"{prose(rng, 40)} {short} {prose(rng, 40)}" for _ in range(2)]
    rows = [(100 - i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/{i}")
        out.append((before, docs))
    return folder, out, short


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_schema(stages):
    for _, after in stages[1][:-1]:
        assert [f.simpleString() for f in after.schema] == [f.strip().replace(" ", ":").replace("long", "bigint") for f in COLUMNS.split(",")]


def test_language_stage(stages):
    before, after = map(by_id, stages[1][0])
    assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
    assert all(after[i] == before[i] for i in after)


def test_near_duplicate_stage(stages):
    before, after = map(by_id, stages[1][1])
    want = brute_components(list(before), [r["text"] for r in before.values()])
    assert set(after) == {i for i, (_, c) in want.items() if c == i} and len(after) < len(before)


def test_repeat_stage(stages):
    before, after = map(by_id, stages[1][2])
    n = corpus_pipeline.PASSAGE
    raws = {i: r["text"].encode() for i, r in sorted(before.items())}
    seen: dict = {}
    for i, r in raws.items():
        for k in range(len(r) - n + 1):
            seen.setdefault(r[k : k + n], (i, k))
    changed = 0
    for i, r in raws.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] != (i, k):
                gone[k : k + n] = True
        # a character goes only as a whole
        whole = [c for c, k in zip(before[i]["text"], np.cumsum([0] + [len(c.encode()) for c in before[i]["text"]]), strict=False) if not gone[k : k + len(c.encode())].all()]
        assert after[i]["text"] == "".join(whole) and after[i]["n_chars"] == len(whole)
        changed += bool(gone.any())
    assert set(after) == set(before) and changed == 3


def test_a_passage_of_fifty_words_stays_once(stages):
    words = stages[2].split()
    texts = [r["text"] for r in stages[1][2][1].collect()]
    assert len(words) == 52 and sum(stages[2] in t for t in texts) == 1
    assert not any(" ".join(words[k : k + 50]) in t for k in range(3) for t in texts if stages[2] not in t)


def test_personal_data_stage(stages):
    before, after = map(by_id, stages[1][3])
    assert set(after) == set(before)
    for i, r in before.items():
        assert after[i]["text"] == pii.mask(r["text"], pii.all_spans(r["text"])[1]) and after[i]["n_chars"] == len(after[i]["text"])
    assert sum("<email>" in r["text"] and "<phone>" in r["text"] for r in after.values()) == 3


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = by_id(stages[1][4][0]), stages[1][4][1].toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    assert after.groupby("doc_id")["length"].sum().to_dict() == {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in before.items()}
    assert after.groupby("sequence_id")["length"].sum().max() <= 4096


def test_run_applies_all_stages(spark, stages):
    folder, out, _ = stages
    got = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, out[-1][1].select(key).collect()))


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(22)
    texts = {k: prose(rng, 150) for k in ("repeated", "no id", "either", "same id")}
    other = prose(rng, 150)
    rows = [(5, texts["repeated"]), (5, texts["repeated"]), (None, texts["no id"]), (None, texts["no id"]), (None, texts["either"]), (7, edited(rng, texts["either"], 1)), (9, texts["same id"]), (9, other)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.drop_near_duplicates(spark, docs, "").write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    want = sorted([(5, texts["repeated"]), (None, texts["no id"]), (7, rows[5][1]), (9, texts["same id"]), (9, other)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    # nothing is left that stage three would take for a repeat
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.remove_repeats(spark, kept, "").collect()), key=str) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in queries() if n != "op7_neighbours"])
def test_queries_over_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(queries()))
def test_queries_return_a_row_for_each_document(spark, name):
    got = queries()[name](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    if name == "op7_neighbours":
        assert got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()[:] == (20, 20)
    elif name == "op8_paragraph_dedup":
        assert got.filter("kept").count() == got.select("component_doc", "component_start").distinct().count()
    else:
        assert got.select("doc_id").distinct().count() == docs
