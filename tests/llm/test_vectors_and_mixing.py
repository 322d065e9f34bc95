"""Vectors, mixing, components and the pipeline."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, epsilon_grid, langid, licenses, mixing, simhash


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    vecs = [*base.tolist(), *(base[:12] + rng.normal(size=(12, 8)) * 0.15).tolist(), *(base[:5] * 3).tolist(), base[0].tolist(), base[0].tolist()]
    odd = [None, [], [0.0] * 8, [math.nan] * 8, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    # ids that repeat, on equal, near and other vectors, and none
    vecs += [vecs[0], vecs[1], vecs[2], base[3].tolist(), (-base[4]).tolist(), (-base[4] * 2).tolist()]
    ids = [*range(len(vecs) - 6), None, 0, 0, 5, None, None]
    rows = [(i, v, 1, "k") for i, v in zip(ids, vecs, strict=True)] + [(1000 + i, v, 1, "k") for i, v in enumerate(odd)] + [(None, None, 1, "k"), (3, None, 1, "k")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, copies int, key string")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in epsilon_grid.near_vectors(table, 0.9).collect())
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    reach = np.linalg.matrix_power(near.astype(float) + np.eye(len(x)), len(x)) > 0
    least = lambda k: min((ids[j] for j in np.flatnonzero(reach[k]) if ids[j] is not None), default=-1)
    want = [(-1 if ids[k] is None else ids[k], int(near[k].sum()), least(k)) for k in range(len(x))]
    want += [(1000 + k, 0, 1000 + k) for k in range(len(odd))] + [(-1, 0, -1), (3, 0, 3)]
    assert got == sorted(want)
    assert epsilon_grid.near_vectors(table.where("false")).count() == 0


def test_vectors_whose_squares_overflow_or_vanish(spark):
    vecs = [[1e200, 0.0], [1e200, 1e199], [1e-170, 0.0], [5e-324, 0.0], [0.0, 1.0], [1.7e308, 1.7e308]]
    got = {r["id"]: r["n_links"] for r in epsilon_grid.near_vectors(spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<double>"), 0.9).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0, 5: 0}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_intervals_are_halved_and_skipped_without_loss(spark, monkeypatch, spread):
    monkeypatch.setattr(epsilon_grid, "LEAF", 16)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 12)), 25, axis=0) + rng.normal(size=(1500, 12)) * spread
    got = {r["id"]: (r["n_links"], r["component"]) for r in epsilon_grid.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        least = np.where(near, root[None, :], len(x)).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{k: 7 for k in range(200, 260)}}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, p double, tokens int, weight string")


@pytest.fixture
def docs(spark):
    rows = [(i, "word " * (i % 9 + 1) + ("@" if i % 5 == 0 else ""), ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], 0.0, 1, "w") for i in range(200)]
    return documents(spark, [*rows, (None, None, None, None, 0.0, 1, "w"), (7, "", "en", "a", 0.0, 1, "w"), (7, "", "en", "a", 0.0, 1, "w")])


def mixed(docs):
    d = docs.select("doc_id", "source", "lang", F.expr(mixing.TOPIC).alias("topic"), F.expr(mixing.TOKENS).cast("long").alias("tokens"))
    return d, mixing.calibrated(d, mixing.DIMS, F.col("tokens"))


def test_mixing_equals_sql_and_meets_its_targets(spark, docs):
    d, cells = mixed(docs)
    got = mixing.sample(d, cells, mixing.DIMS, "doc_id").toPandas()
    pdf = docs.toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("raw", pdf)
    con.sql("CREATE TABLE docs AS SELECT doc_id, text, lang, source FROM raw")
    want = con.sql(f"WITH {mixing.cells_sql('docs')} SELECT doc_id, round(p, 9) AS p, {mixing.DRAW_SQL} < p AS kept FROM {mixing.JOIN_SQL}").df()
    key = lambda t: sorted((-1 if x != x or x is None else int(x), round(float(p), 6), bool(k)) for x, p, k in zip(t["doc_id"].astype(float), t["p"], t["kept"], strict=True))
    assert len(got) == 203 and key(got) == key(want)
    c = cells.toPandas()
    total = c["tokens"].sum()
    for dim in mixing.DIMS:
        g = c.groupby(dim, dropna=False)[["tokens", "weight"]].sum()
        target = g["tokens"] ** mixing.TEMPERATURE
        assert np.allclose(g["weight"], target / target.sum() * total, rtol=1e-3)


def test_mixing_takes_given_targets_and_empty_tables(spark, docs):
    d, _ = mixed(docs)
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, target double")}
    c = mixing.calibrated(d, mixing.DIMS, F.col("tokens"), targets=targets, sweeps=30).toPandas().groupby("source", dropna=False)["weight"].sum()
    assert c["b"] / c["a"] == pytest.approx(3, rel=1e-3)
    e, cells = mixed(docs.where("false"))
    assert mixing.sample(e, cells, mixing.DIMS, "doc_id").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import random

    import tiktoken

    import corpus_pipeline
    import public_tokenizers
    from test_text_operators import jaccard_groups
    from voxloom.llm import bpe

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(150):
        w = rng.choices(words, k=60)
        if i % 6 == 0:
            w[3] = w[30] = "vile"
        rows.append([i, " ".join(w), "en", f"s{i % 3}", 0])
    for k in range(10):
        rows.append([200 + k, rows[6 * k + 1][1] + (" tail" if k % 2 else ""), "en", "s0", 0])
    rows[2][1] += ' token = "0123456789abcdef0123456789abcdef01234567"'
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        seen.append({r["doc_id"]: r for r in docs.collect()})
        if name != "byte-level bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_id = {r[0]: r[1] for r in rows}
    assert set(seen[0]) == {i for i in by_id if not (i < 150 and i % 6 == 0)}
    groups = jaccard_groups({i: by_id[i] for i in seen[0]})
    assert set(seen[1]) == {i for i, g in groups.items() if i == g}
    assert set(seen[2]) == set(seen[1]) and "0123456789abcdef" not in seen[2][2]["text"]
    assert all(seen[2][i]["text"] == by_id[i] for i in seen[2] if i != 2)
    assert set(seen[3]) <= set(seen[2]) and len(seen[3]) > 0
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: r["n_tokens"] for i, r in seen[4].items()} == {i: len(enc.encode_ordinary(r["text"])) for i, r in seen[3].items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars int, row int, topic string, p double, kept boolean, gone bigint, cell string"
    more = (1, "t", 0.5, False, 3, "c")
    odd = [(1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (None, "word " * 30_000, None, "s", None, *more), (None, "a b c d e f", "en", None, 11, *more), (5, "a b c d e f", "en", "s", 11, *more), (5, "a b c d e f", "en", "s", 11, *more)]
    for rows in (odd, []):
        folder = tmp_path / str(len(rows))
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(5, 1, 0), (None, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            docs = common.cut(stage(spark, docs, str(folder)))
            if name != "byte-level bpe":
                assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
            if name == "simhash near-dedup":
                # of 1 and 2, both without a shingle, one stays; rows of one id go together
                assert sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect()) == (["1", "5", "5", "None", "None"] if rows else [])
        assert docs.count() <= len(rows)


def test_near_duplicates_with_a_column_named_like_a_helper(spark):
    rows = [(k, "one two three four five six seven " * 3, 1) for k in range(3)] + [(7, "eight nine ten eleven twelve thirteen", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int").withColumn("gone", F.lit(2))
    left = simhash.keep_one_of_each(docs, simhash.near_duplicates(docs))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 7] and left.columns == docs.columns


def test_languages_of_a_table_with_columns_of_the_results(spark):
    field = langid.fit(["der die das und", "the and of it"] * 4, ["de", "en"] * 4)
    docs = spark.createDataFrame([(1, "der und die", 0.5, "x", 1), (2, None, 0.5, "x", 1)], "doc_id bigint, text string, score double, lang_pred string, found int")
    got = langid.identify(docs, field)
    assert got.columns == ["doc_id", "text", "found", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "de", 2: "und"}
    assert langid.identify(docs.where("false"), field).count() == 0


def test_a_language_of_long_texts_alone_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 4000)
    rows = [(k, "the and of it was for " * 4, "en") for k in range(20)] + [(100 + k, "der die das und nicht ist " * 400, "de") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    field = langid.train(docs)
    assert field.labels == ["de", "en"]
    asked = spark.createDataFrame([(1, "und das ist der"), (2, "it was for the")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, field).collect()} == {1: "de", 2: "en"}


def test_license_templates_from_a_table(spark, monkeypatch):
    rows = [("Own-1.0", "You may use this work for any purpose whatsoever."), ("Own-1.0", "You may use this work for any purpose whatsoever."), ("Own-1.0", "All uses of this thing are fine with us today."), (None, "No name here at all, none."), ("Empty", " .. "), ("Null", None)]
    templates = licenses.read_templates(spark.createDataFrame(rows, "name string, text string"))
    assert list(templates) == ["Own-1.0", "Own-1.0 (2)"]
    docs = spark.createDataFrame([(1, "x. You may use this work for any purpose whatsoever. y"), (2, "Released under the MIT License.")], "doc_id bigint, text string")
    found = licenses.scan(docs, templates).collect()
    assert [(r["id"], r["license"], r["coverage"]) for r in found] == [(1, "Own-1.0 (2)", 1.0)]
    monkeypatch.setattr(licenses, "TEMPLATE_CHARS", 10)
    with pytest.raises(ValueError, match="at most"):
        licenses.read_templates(spark.createDataFrame(rows, "name string, text string"))


def test_stages_send_texts_in_small_batches(spark):
    import corpus_pipeline as pipeline

    before = spark.conf.get(pipeline.ARROW_ROWS)
    docs = documents(spark, [(1, "a b c", "en", "a", 0.0, 1, "w")])
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(pipeline.ARROW_ROWS, given)
            assert pipeline.encode(spark, docs, "").count() == 1
            assert spark.conf.get(pipeline.ARROW_ROWS) == want
    finally:
        spark.conf.set(pipeline.ARROW_ROWS, before)
    assert [f.__name__ for _, f in pipeline.STAGES] == ["drop_toxic", "drop_near_duplicates", "mask_secrets", "mix_sources", "encode"]


def test_plans_of_a_sweep_do_not_double_with_each_dimension(spark, monkeypatch):
    plans, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")) or cut(d))
    cells = spark.createDataFrame([("a", "x", "p", 3), ("a", "y", "q", 5), ("b", "x", "q", 2), (None, "y", "p", 4)], "source string, lang string, topic string, tokens long")
    mixing.rake(cells, mixing.DIMS, sweeps=2)
    assert len(plans) == 3 + 2 * 4 and max(plans) == 1
