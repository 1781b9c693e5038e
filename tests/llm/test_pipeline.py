"""The pipeline, stage by stage, against plain-Python versions; and every registered query against its SQL."""

import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import public_tokenizers
import sentencepiece as library
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from leadweave.llm import quality, secrets
from leadweave.llm.queries import ORACLE_SQL, QUERIES
from leadweave.session import settle
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and the end result; with awkward documents among the given ones."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(90_001, None, "en", None, None), (90_002, "", None, "src0", 0), (None, "password=abcdef123 is here", "en", "src0", 26),
           (90_003, "password=abcdef123 is here " + "some more words of a longer text " * 3, "en", "src0", 9)]
    docs = settle(given.unionByName(spark.createDataFrame(odd, given.schema)).withColumn("position", F.lit(1)))
    frames = [docs]
    for name, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, SF_DIR))
        frames.append(docs)
    return dict(zip([*STAGES, "end"], frames))


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}


def test_all_but_the_last_stage_return_documents(stages):
    assert len(STAGES) == 5
    for name in list(STAGES)[1:]:
        assert tuple(stages[name].columns) == pipeline.DOCUMENT


def test_rejected_documents_go(spark, stages):
    before, after = _texts(stages["quality"]), _texts(stages["near_duplicates"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.98 * len(good)
    assert sum(i in after for i in bad) <= 0.1 * len(bad)
    model = quality.trained(stages["quality"], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = stages["quality"].select("doc_id", model.score(quality.statistics(F.col("text"))).alias("s")).collect()
    assert {r["doc_id"] for r in scores if r["s"] >= 0.3 and r["doc_id"]} == {i for i in after if i}


def test_one_of_each_group_stays(stages):
    before, after = _texts(stages["near_duplicates"]), _texts(stages["secrets"])
    marks = {i: brute.fingerprint(t, pipeline.SHINGLE) for i, t in before.items()}
    groups = brute.components(marks, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= pipeline.DISTANCE)
    assert set(after) == {i for i, g in groups.items() if i == g}
    assert after.items() <= before.items()


def test_rows_that_share_an_id(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    given = [(1, a, "en", "s", 5), (2, a, "en", "s", 5), (2, b, "en", "s", 5),  # one of two texts under 2 is a copy
             (3, c, "en", "s", 5), (3, c, "en", "s", 5), (3, c, "fr", "s", 5),  # repeated rows
             (None, d, "en", "s", 5), (None, d, "en", "s", 5), (4, d, "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(given, schema).withColumns({c: F.lit(1) for c in ("row", "root", "fingerprint", "first")})
    rows = pipeline.without_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == [(0, d), (0, d), (1, a), (2, b), (3, c), (4, d)]


def test_a_large_group_of_near_copies_is_one(spark):
    words = [f"w{i % 40}" for i in range(4000)]
    given = [(i, " ".join([*words[:20], f"x{i}", *words[20:]]), "en", "s", 5) for i in range(150)]
    marks = {i: brute.fingerprint(text) for i, text, *_ in given}
    groups = brute.components(marks, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.without_near_duplicates(spark, docs, "").collect()}
    assert kept == set(groups.values()) and len(kept) < 20


def test_secrets_are_replaced(stages):
    before, after = _texts(stages["secrets"]), {r["doc_id"]: r for r in stages["mixing"].collect()}
    for i, text in before.items():
        spans = sorted(
            (m.start(), place, m.end(), rule.kind) for place, rule in enumerate(secrets.RULES)
            for m in rule.compiled().finditer(text or "") if len(m[rule.group]) >= rule.least
        )
        out, at = "", 0
        for start, _, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind}]"
            at = max(at, end)
        want = out + text[at:] if spans else text
        assert after[i]["text"] == want
        assert not spans or after[i]["n_chars"] == len(want)


def test_sources_meet_their_targets(stages):
    rows = stages["mixing"].collect()
    sizes, most = Counter(), Counter()
    for r in rows:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    want = brute.targets(dict(sizes), [3, 1, 2], 1.5, 2)
    taken, times = Counter(), Counter()
    for r in stages["tokens"].collect():
        taken[r["source"]] += len(brute.words(r["text"]))
        times[r["doc_id"], r["text"]] += 1
    assert max(times.values()) == 2
    for source, target in want.items():
        assert abs(taken[source] - target) <= most[source]


def test_encoded_rows(stages):
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECE_MODEL))
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in stages["tokens"].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages["end"].collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in stages["end"].collect())


def test_run_is_the_stages_in_order(spark):
    out = pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    named = {re.match(r"op(\d+)_", n)[1] for n in QUERIES if n != "pipeline"}
    assert named == {str(n) for n in range(1, 14)}
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE_SQL.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    engine = duckdb.connect()
    for given in ("documents", "embeddings", "benchmark"):
        engine.execute(f"CREATE VIEW {given} AS SELECT * FROM '{SF_DIR}/{given}.parquet'")

    def rows(frame):
        columns = sorted(frame.columns)
        values = frame[columns].astype(object)
        # A column of whole numbers with nulls comes as numbers of either kind.
        plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
        return columns, sorted(repr([plain(v) for v in row]) for row in values.itertuples(index=False, name=None))

    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(engine.execute(ORACLE_SQL[name]).df())


def test_digests_of_the_encoder(spark):
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = _texts(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    for r in QUERIES["op1_sentencepiece"](spark, SF_DIR).collect():
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(sp.decode(ids))
