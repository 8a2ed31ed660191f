import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import queries

from .data import ODD, SCHEMA, SF, table, texts


@pytest.fixture
def folder(spark, tmp_path):
    """A small data folder: copies, near copies, passages of the benchmark, toxic words and odd rows."""
    item = " ".join(f"q{k}" for k in range(30))
    docs = texts(12, 30) + ODD + [f"start {item} end", f"{' '.join(f'z{k}' for k in range(2000))} {item}"] + [f"nice words {k} badword badword" for k in range(40)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toxic = [k for k, d in enumerate(docs) if d and "badword" in d]
    rows = [(k, 1, int(k in toxic)) for k in range(len(docs))]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, toxic


def test_stages(spark, folder):
    path, docs, toxic = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    results = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, path)
        rows = now.collect()
        results.append({r["doc_id"]: r for r in rows})
        assert len(results[-1]) == len(rows)
        if k < 4:
            assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            now = spark.createDataFrame(rows, SCHEMA)
    clean = [k for k in range(len(docs)) if k not in toxic]
    assert set(results[0]) == set(clean)
    ids = {docs[k]: k for k in reversed(clean)}
    assert all(docs[k] in ("", None, "   \n") or ids[docs[k]] == k for k in results[1])  # of exact copies, the least id
    assert set(results[2]) == set(results[1]) and all(r["n_chars"] == len(r["text"]) for r in results[2].values())
    start, long = (next(k for k, d in enumerate(docs) if d and d.startswith(x)) for x in ("start q0", "z0"))
    assert start in results[1] and start not in results[3] and (long in results[3]) == (long in results[2])
    assert all(r["round_trip"] for r in results[4].values()) and set(results[4]) == set(results[3])


def test_near_copies_by_five_words(spark):
    """Scattered changes: similarity 0.82 on two words, 0.59 on five; 0.90 on five with one change."""
    words = [f"v{k}" for k in range(100)]
    changed = [f"c{k}" if k % 20 == 10 else w for k, w in enumerate(words)]
    once = [f"o{k}" if k == 50 else w for k, w in enumerate(words)]
    left = corpus_pipeline.drop_near_duplicates(spark, table(spark, [" ".join(x) for x in (words, changed, once)]), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1]


def test_rows_without_words_stay(spark):
    """Repeated rows are one document, but each row without words is one of its own."""
    rows = [(None, None), (None, None), (None, ""), (1, ""), (1, ""), (1, " "), (2, "a b c"), (2, "a b c"), (None, "d e"), (None, "d e")]
    left = corpus_pipeline.drop_near_duplicates(spark, table(spark, [t for _, t in rows], [i for i, _ in rows]), SF)
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert got == sorted([*rows[:6], rows[6], rows[8]], key=repr)


def test_passages_are_cut(spark, folder):
    """A long document that quotes an item stays without the passage."""
    path, docs, _ = folder
    left = {r["doc_id"]: r for r in corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    long = next(k for k, d in enumerate(docs) if d and d.startswith("z0"))
    assert left[long]["text"] == docs[long][: docs[long].index("q0")] and left[long]["n_chars"] == len(left[long]["text"])
    assert all(r["text"] == docs[k] for k, r in left.items() if k != long)


#: Names of the operators' results and helpers, and some that need quoting.
CLASHING = "text_key first words n_words n_hits score predicted held_out kept component_id contaminated __row __key __id rid a.b Label".split()


def test_clashing_columns(spark, folder):
    """Other columns, whatever their names, come through the stages as they were and change nothing."""
    path, docs, _ = folder
    plain = now = spark.read.parquet(f"{path}/documents.parquet")
    for k, name in enumerate(CLASHING):
        now = now.withColumn(name, F.concat(F.lit(f"{k}:"), "doc_id"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        wide, plain = stage(spark, now, path), stage(spark, plain, path)
        columns, got = now.columns, wide.collect()
        rows = plain.collect()
        assert sorted(map(repr, (r[:2] for r in wide.select(*[f"`{c}`" for c in plain.columns]).collect()))) == sorted(map(repr, (r[:2] for r in rows)))
        if k < 4:
            assert wide.columns == columns
            assert all(r[c] == f"{j}:{r['doc_id']}" for r in got for j, c in enumerate(CLASHING))
            now, plain = spark.createDataFrame(got, now.schema), spark.createDataFrame(rows, SCHEMA)


def test_run_of_empty_tables(spark, folder, tmp_path):
    """No documents, with labels and benchmark or without: no rows, and the columns of the last stage."""
    path, _, _ = folder
    for name, full in (("some", True), ("none", False)):
        table(spark, []).withColumn("a.b", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            rows = spark.read.parquet(f"{path}/{other}.parquet")
            (rows if full else rows.limit(0)).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "ids", "n_tokens", "score", "round_trip"] and not out.collect()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_repository_without_this_part(tmp_path):
    """The entry module works where the corpus part has been deleted."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'tidewire.llm' or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')] and e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("os").path.dirname(corpus_pipeline.__file__))
