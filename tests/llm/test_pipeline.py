"""The pipeline over a small corpus with planted cases, and the registered queries."""

import random
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from gridloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choices("abdeginorst", k=rng.randint(2, 9))) for _ in range(900)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(6)]
    docs, labels, fate = [], [], {}
    for i in range(400):
        body = rng.choices(words, k=rng.randint(30, 90))
        kind = i % 10
        if kind in (0, 1):
            for bad in ("zorkest", "blargum", "plonko"):
                body.insert(rng.randrange(len(body)), bad)
            fate[i] = "toxic"
        elif kind == 2 and i > 10:  # one word more than a document that stays
            body = [*next(t for j, t, *_ in docs if j == i - 6).split(), "more"]
            fate[i] = "copy"
        elif kind == 3:
            body[5:5] = items[i % 6][1].split()
            fate[i] = "leak"
        elif kind == 4:
            body.insert(3, "password=" + "".join(rng.choices("0123456789abcdef", k=17)) + "7")
            fate[i] = "secret"
        docs.append((i, " ".join(body), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(kind in (0, 1))))
    return docs, labels, items, fate


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items, _ = corpus()
    odd = [(1000, None, None, None, None), (1001, "", "en", None, 0)]
    spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_every_stage_does_its_part(spark, folder):
    docs, _, _, fate = corpus()
    texts = {i: t for i, t, *_ in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in frame.collect()}
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{folder}/{name}"
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        rows = frame.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        gone[name] = before - {r.doc_id for r in rows}
        before = {r.doc_id for r in rows}
    by = {kind: {i for i, f in fate.items() if f == kind} for kind in ("toxic", "copy", "leak", "secret")}
    assert gone["toxicity"] == by["toxic"]
    assert gone["ngram_join"] == {i for i in by["copy"] if i - 6 not in by["toxic"]}
    assert gone["decontamination"] == by["leak"] and not gone["secrets"]
    for r in rows:
        text = texts.get(r.doc_id, "" if r.doc_id == 1001 else None)
        want = re.sub("(?<=password=)[0-9a-f]{18}", "[REDACTED]", text) if text else text
        assert r.text == want
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, folder).toPandas()
    assert set(packed.doc_id) == before
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == len(packed)


SMALL = [n for n in queries.QUERIES if n in queries.SQL]


@pytest.mark.parametrize("name", SMALL)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = con.execute(queries.SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_contracts(spark, folder):
    """Columns and counts of the other queries."""
    columns = {
        "op1_ngram_join": "doc_id n_shingles component_id",
        "op4_toxicity": "doc_id held_out score predicted",
        "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    }
    found = {name: queries.QUERIES[name](spark, folder) for name in columns}
    for name, first in columns.items():
        assert set(first.split()) <= set(found[name].columns)
    for r in found["op4_toxicity"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5)


def test_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in driver.queries()
