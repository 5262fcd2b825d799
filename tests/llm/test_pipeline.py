"""The pipeline against its stages done by hand, and the queries on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np

import corpus_pipeline
from gridloom.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.train(docs, toxicity.train_rows(spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if lexicon.score(r.text) < 0.7]
    seen, unique = set(), []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            unique.append((i, t))
    sets = []
    for i, t in unique:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(unique)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    names = pii.Pseudonyms()
    want = {i: names.replace(t or "")[0] for k, (i, t) in enumerate(unique) if find(k) == k}
    from tokenizers import Tokenizer

    from gridloom.llm.bpe import default_vocabulary

    tok = Tokenizer.from_file(default_vocabulary())
    pieces = set()
    for i, t in want.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        pieces |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == pieces


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_exact_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op9_exact_dedup"](spark, SF)
    want = con.sql(queries.ORACLE_SQL["op9_exact_dedup"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_held_out_language(spark):
    got = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.98 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    one = queries.QUERIES["op1_substring_dedup"](spark, SF).filter("n_removed = 0").collect()
    assert all(r.kept_sha256 == hashlib.sha256(b" ".join(docs[r.doc_id].encode().split())).hexdigest() for r in one)
    ten = queries.QUERIES["op10_suffix_array_dedup"](spark, SF).filter("n_removed = 0").collect()
    assert all(r.kept_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in ten)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, clashing names, nulls, blanks, ties, repeated rows and long white space go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = ("digest", "low", "component", "bucket", "rank", "length", "block", "toxic", "score", "_own_digest_")
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "\t "), (5, long), (5, long), (6, long), (7, long + " more"), (None, long), (None, "own text of a row without number"), (8, "mail a@b.org on 2020-01-02"), (9, "x" + " " * 1_200_000 + "y")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    wide = docs
    for c in more:
        wide = wide.withColumn(c, docs["doc_id"].cast("string"))
    spark.createDataFrame([(5, 1, 0), (5, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {"toxicity": 13, "exact_dedup": 8, "near_dedup": 11, "pii": 13}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, wide.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, wide, str(tmp_path))
        if name == "packing":
            assert out.select("doc_id").distinct().count() == 10
        else:
            assert empty.columns == out.columns == wide.columns
            assert out.count() == kept[name], name
    now = wide
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.filter("piece = 0").count() == 7


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
