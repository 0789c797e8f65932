import random

import pytest

import corpus_pipeline as P
from tests.llm import test_decontam, test_line_dedup, test_near_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(8), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, labels = [], []
    shared, items = [" ".join(word() for _ in range(8)) for _ in range(3)], [(q, " ".join(word() for _ in range(25))) for q in range(5)]
    for i in range(400):
        lines = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 5))]
        toxic = rng.random() < 0.3
        if toxic:
            lines[0] += " " + rng.choice(["vile", "rotten"])
        if rng.random() < 0.2:
            lines.insert(0, rng.choice(shared))
        if rng.random() < 0.05:
            lines.append(rng.choice(items)[1])
        if rows and rng.random() < 0.1:
            lines = rng.choice(rows)[1].split("\n")
            lines[-1] += " " + word()
            toxic = any(w in " ".join(lines) for w in ("vile", "rotten"))
        rows.append((i, "\n".join(lines), "en", "s", sum(map(len, lines))))
        labels.append((i, 1, int(toxic)))
    rows += [(900, "", "en", "s", 0), (901, None, None, None, None)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        if name == "packing":
            break
        assert docs.columns == columns
        docs = P.written(docs, name)
        rows = docs.collect()
        kept[name] = got = sorted((r.doc_id, r.text or "") for r in rows)
        texts = {i: t or "" for i, t in before}
        if name == "toxicity":
            want = [(i, t) for i, t in sorted(texts.items()) if "vile" not in t and "rotten" not in t]
        elif name == "line_dedup":
            want = sorted((i, t) for i, t, _, _ in test_line_dedup.brute(before))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            want = sorted((i, texts[i]) for i, c, _ in test_near_dedup.brute(before) if i == c)
        else:
            leaked = {x[0] for x in test_decontam.brute(before, items)}
            want = sorted((i, t) for i, t in texts.items() if i not in leaked)
        assert got == want, name
        assert 0 < len(got) and (len(got) < len(before) or name == "line_dedup"), name
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {i for i, _ in kept["decontamination"]}


def test_run(spark, folder):
    assert P.run(spark, folder).count() > 100 and P.ORACLE_SQL is None and len(P.STAGES) == 5


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, label int, id long, h1 string, node int, __gone int, __id string, __words int, band long, score double, predicted int, word binary"


def odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "h", 3, 4, "x", 5, 6, 0.5, 1, b"w") for i, t in rows], CLASHING)
    spark.createDataFrame([(i, 1, int(i == 4)) for i in range(5)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [(1, "x")]).limit(0)
    for name, stage in P.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns), name


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns that operators use themselves."""
    line = "a line that is in three documents"
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    rows = [(None, None), (None, "alone"), (1, None), (2, ""), (3, line), (3, line), (5, f"{line}\nown words of five"), (6, f"{line}\nown words of six"), (7, long), (7, "again seven"), (8, long)]
    docs, folder = odd_tables(spark, tmp_path, rows), str(tmp_path)
    want = {
        "toxicity": rows,
        "line_dedup": [(None, ""), (None, "alone"), (1, ""), (2, ""), (3, ""), (3, ""), (5, "own words of five"), (6, f"{line}\nown words of six"), (7, long), (7, "again seven"), (8, long)],
        "near_dedup": [(None, ""), (None, "alone"), (1, ""), (5, "own words of five"), (6, f"{line}\nown words of six"), (7, long), (7, "again seven")],
    }
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, folder), name)
        got = docs.collect()
        assert [f"{c} {t}" for c, t in docs.dtypes] == [x.replace(" long", " bigint") for x in CLASHING.split(", ")], name
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want.get(name, want["near_dedup"]), key=str), name
        assert all((r.label, r.id, r.h1, r["__gone"], r.score) == (1, 2, "h", 4, 0.5) for r in got)
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, folder).collect()} == {None, 1, 5, 6, 7}
