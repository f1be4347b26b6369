import corpus_pipeline

from tests.llm.conftest import prose
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_quality import brute as brute_counts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, make):
    """Each stage over what its predecessor kept, with its decisions checked against plain Python."""
    from linkloom.llm.shared import table, written

    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
        seen.append(docs)
    assert all(d.columns == COLUMNS for d in seen[:-1])
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    start, kept, lines, single, mix = rows(table(spark, SF, "documents")), *map(rows, seen[:4])
    failed = {i for i, t in start if brute_counts(t)[-1]}
    assert failed.isdisjoint(i for i, _ in kept) and len(kept) > 0.75 * (len(start) - len(failed))
    want = {i: t for i, t in brute_lines(kept).items() if t.strip()}
    assert dict(lines) == want
    assert {i for i, _ in single} <= {i for i, _ in lines}
    sizes = dict(single)
    assert all(sizes[i] == t for i, t in mix) and 1.4 < sum(len(t.split()) for _, t in mix) / sum(len(t.split()) for t in sizes.values()) < 1.6
    packed = seen[4].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_runs_on_an_empty_table(spark, make, tmp_path):
    make("x").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_agree_with_sql(spark):
    import duckdb

    from linkloom.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        columns = sorted(got.columns)
        want = c.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want)), name


def test_stages_lose_no_rows(spark, make, rnd):
    """Null ids, repeated rows, odd texts and clashing names, stage by stage."""
    from linkloom.llm.shared import written

    stage = dict(corpus_pipeline.STAGES)
    good, other, third = (prose(rnd, 90) for _ in range(3))
    near = good.replace(" ", "  ") + " end."
    docs = make((None, good), (2, good), (3, near), (4, other), (4, other), (5, None), (6, ""), (7, third), extra=True)
    for name in ("lines_report", "c", "d", "copies", "kept", "component_id", "n_words"):
        docs = docs.withColumn(name, docs["doc_id"] * 0)
    docs = written(docs, "given")
    rows = lambda d: sorted((r["doc_id"] or 0, r["text"] or "") for r in d.collect())
    assert rows(stage["quality rules"](spark, docs, SF)) == sorted([(0, good), (2, good), (3, near), (4, other), (4, other), (7, third)])
    assert rows(stage["near dedup"](spark, docs, SF)) == sorted([(2, good), (4, other), (5, ""), (6, ""), (7, third)])
    lines = stage["line dedup"](spark, docs, SF)
    assert lines.columns == docs.columns and {(i, t) for i, t in rows(lines)} >= {(0, good), (4, other), (5, ""), (6, ""), (7, third)}
    mix = stage["mixing"](spark, docs, SF)
    assert mix.columns == docs.columns and set(rows(mix)) <= set(rows(docs))
    packed = stage["packing"](spark, docs, SF).collect()
    assert sum(r["start"] == 0 for r in packed) == docs.count()
    for name in ("quality rules", "line dedup", "near dedup", "mixing"):
        assert stage[name](spark, docs.limit(0), SF).columns == docs.columns and stage[name](spark, docs.limit(0), SF).count() == 0


def test_near_dedup_finds_all_that_its_definition_links(spark, make, rnd):
    """Copies of 3 % changed words: every pair at 0.8 of five-word shingles or more, by brute force, leaves one document."""
    from tests.llm.test_minhash import brute, family

    texts = [t for _ in range(8) for rate in (0.0, 0.01, 0.03) for t in family(rnd, 5, rate)]
    docs = list(enumerate(texts))
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, make(*docs), SF).collect()}
    assert got == {i for i, (_, _, kept) in brute(docs, 5).items() if kept}
