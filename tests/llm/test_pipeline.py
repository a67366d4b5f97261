"""The pipeline: contracts of the stages, and every row against brute force."""

import random

import corpus_pipeline as c
import pytest

import test_simhash as plain
from harborline.llm import decontamination, secret_scan, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with toxic texts, copies, leaks and secrets."""
    rng = random.Random(11)
    common = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(common, k=n))
    items = [(i, text(30)) for i in range(5)]
    docs = []
    for key in range(900):
        words = text(rng.randint(20, 200)).split()
        if key % 7 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "foul"])
        docs.append([key, " ".join(words), "en", f"s{key % 3}", 0])
    for key in (10, 20, 30):
        docs.append([1000 + key, docs[key][1] + " ", "en", "s0", 0])
    docs[40][1] += " " + items[2][1]
    docs[50][1] += " token=abcdefgh1234 rest"
    labels = [(key, 1, int(key % 7 == 0)) for key in range(900)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == names
        out[name] = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(out["toxicity"]) == {r.doc_id for r in scores.where("predicted = 0").collect()}
    toxic = {k for k in range(900) if k % 7 == 0}
    assert len(set(out["toxicity"]) & toxic) < 0.1 * len(toxic) and len(set(rows) - toxic - set(out["toxicity"])) < 30
    before = sorted(out["toxicity"])
    marks = [plain.mark(rows[k].text) for k in before]
    roots = plain.classes(marks)
    least = {}
    for key, root in zip(before, roots):
        least[root] = min(least.get(root, key), key)
    assert set(out["simhash_dedup"]) == set(least.values()) and not {1010, 1020, 1030} & set(out["simhash_dedup"])
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {
        k for k in out["simhash_dedup"] for t in items
        if len(decontamination.shingles(rows[k].text, 5) & decontamination.shingles(t, 5)) >= 0.8 * len(decontamination.shingles(t, 5))
    }
    assert set(out["decontamination"]) == set(out["simhash_dedup"]) - leaks and (40 in leaks or 40 not in out["simhash_dedup"])
    for key, text in out["secret_scan"].items():
        assert text == secret_scan.redact(rows[key].text, secret_scan.all_spans(rows[key].text))
    assert set(out["secret_scan"]) == set(out["decontamination"])
    assert 50 not in out["secret_scan"] or secret_scan.REDACTED in out["secret_scan"][50]
    final = c.run(spark, folder).collect()
    assert {r.doc_id for r in final} == set(out["secret_scan"])
    assert sum(r.words for r in final) == sum(len(t.split()) for t in out["secret_scan"].values())


def test_registered():
    import __spark_entry__ as contract

    names = list(contract.queries())
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert c.ORACLE_SQL is None and len(c.STAGES) == 5
