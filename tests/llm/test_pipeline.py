"""The pipeline against brute force, and its contract."""

import re

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F

from thicket.llm import queries, simhash


def test_stages(spark, tables, tokenizers):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, tables).cache()
        if name != "encoding":
            assert docs.columns == columns
        a, b = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()}
        if name == "quality":
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
            clean = [i for i, r in labels.items() if r["quality"] and not r["toxic"] and i in a]
            assert np.mean([i in b for i in clean]) > 0.95
        elif name == "lines":
            assert all(b[i]["n_chars"] == len(b[i]["text"]) for i in b) and set(a) == set(b)
            c = duckdb.connect()
            import pandas as pd

            documents = pd.DataFrame({"doc_id": list(a), "text": list(a.values())})  # noqa: F841
            want = c.sql(queries.ORACLE_SQL["op8_line_dedup"].replace("FROM documents", "FROM documents")).fetchall()
            got = {(r["doc_id"], r["h"]) for r in docs.select("doc_id", F.sha2("text", 256).alias("h")).collect()}
            assert {(w[0], w[3]) for w in want} == got
        elif name == "near_copies":
            sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in a.items()}
            alike = lambda x, y: sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
            for i in a:
                near = [j for j in a if j < i and alike(i, j)]
                assert (i in b) == (not near) or near  # a chain may reach further
                if not near and i not in b:
                    raise AssertionError(i)
            assert not any(alike(i, j) for i in b for j in b if j < i)
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
            windows = set()
            for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
                w = words(r["text"])
                k = min(13, len(w))
                windows |= {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
            for i, t in a.items():
                w, hit = words(t), set()
                for p in range(len(w)):
                    if tuple(w[p : p + 13]) in windows:
                        hit.update(range(p, min(len(w), p + 13)))
                assert (i in b) == (not hit or 20 * len(hit) < len(w))
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
            for i, text in a.items():
                ids = t.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(b[i]["ids"], "<u4").tolist() == ids and b[i]["n_tokens"] == len(ids) and b[i]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_quality_on_held_out_labels(spark, tables):
    from thicket.llm import quality

    d = tables.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0)
    out = quality.select(quality.score(docs, quality.train(docs, labels.where("not held")), ["doc_id"])).join(labels.where("held"), "doc_id").collect()
    clean, bad = [r for r in out if r["quality"] and not r["toxic"]], [r for r in out if not r["quality"] or r["toxic"]]
    assert np.mean([r["selected"] for r in clean]) > 0.95 and np.mean([not r["selected"] for r in bad]) > 0.75


#: Names that the operators of the stages give to their results, and work with.
CLASHES = [
    "expected_grade", "top_probability", "selected", "n_lines", "n_dropped", "n_words", "n_hit", "spans", "items", "contaminated",
    "ids", "n_tokens", "decoded", "id", "h", "grade", "fp", "part", "root", "best", "wide", "same", "__text", "__t", "__id",
]


def test_odd_rows_and_clashing_names_pass_through(spark, docs, tables):
    odd = docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), *[F.concat(F.lit(c), F.xxhash64("text")).alias(c) for c in CLASHES])
    before = {(r["doc_id"], r["lang"], *[r[c] for c in CLASHES[:10]]) for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, tables)
        assert stage(spark, odd.where("false"), tables).count() == 0, name
        if name == "encoding":
            assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == odd.count()
            continue
        assert out.columns == odd.columns, name
        rows = out.collect()
        after = {(r["doc_id"], r["lang"], *[r[c] for c in CLASHES[:10]]) for r in rows}
        assert after <= before and len(rows) <= odd.count(), name


def test_run_is_its_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 50 and {"doc_id", "n_tokens", "ids", "decoded"} == set(out.columns)
