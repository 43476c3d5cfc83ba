"""The corpus pipeline, stage by stage, against plain versions of what each is for."""

import re

import numpy as np

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    """Clean documents stay, poor ones, copies, near copies and toxic ones go, and the tokens meet their targets."""
    rng = np.random.default_rng(3)
    parts = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    prose = lambda n: [" ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(12)) + "." for _ in range(n)]
    rows, labels, kind = [], [], {}
    for i in range(150):
        lines = prose(8)
        kind[i] = ("clean", "toxic")[i % 5 == 4]
        if kind[i] == "toxic":
            lines = [x.replace(" ", f" {w} ", 1) for x, w in zip(lines, rng.choice(["scum", "moron", "trash"], len(lines)), strict=True)]
        rows.append((i, "\n".join(lines)))
        if i < 100:
            labels.append((i, 1, int(kind[i] == "toxic")))
    text = dict(rows)
    more = {200: text[0], 201: text[1].replace(" ", "  ", 3), 202: text[2] + " end", 203: " ".join(text[5].split()[:-3]), 204: "short", 205: "spam spam spam " * 60, 206: None, 207: "", 208: text[3].upper()}
    rows += list(more.items())
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows] + [(None, "\n".join(prose(8)), None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), schema.replace("bigint", "long")
    ids, words = [], lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < 4:
            assert out.columns == [c.split()[0] for c in columns.split(", ")], name
            out.write.parquet(f"{tmp_path}/{k}")
            kept = spark.read.parquet(f"{tmp_path}/{k}")
            ids.append({r[0] for r in kept.select("doc_id").collect()})
        else:
            last = out.select("doc_id", "n_samples").collect()
    clean = {i for i, k in kind.items() if k == "clean"}
    toxic = set(kind) - clean
    assert ids[0] == set(kind) | {200, 201, 202, 203, None}
    assert ids[1] == ids[0] - {200, 201}
    assert ids[2] == ids[1] - {202, 203}
    assert clean | {None} <= ids[3] and len(ids[3] & toxic) <= 2
    total = lambda some: sum(len(words(text[i])) for i in some if i is not None)
    assert total(ids[3] & clean) == total(clean) and total(ids[3] & toxic) < 0.1 * total(toxic)
    assert {r[0] for r in last} == ids[3] and all(r[1] > 0 for r in last)


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
