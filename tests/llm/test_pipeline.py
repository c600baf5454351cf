import random
from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from boxrates.llm.pieces import load
from boxrates.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def corpus():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    rows, labels = [], []
    for i in range(240):
        text = [draw.choice(words) for _ in range(draw.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            text.insert(3, draw.choice(["blorg", "snarf"]))
        rows.append((i, " ".join(text), "en", f"s{i % 4}" if i % 4 else None))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + n, r[1].upper(), "en", "s1") for n, r in enumerate(clean[:20])]  # exact copies
    rows += [(2000 + n, r[1] + " end", "en", "s2") for n, r in enumerate(clean[30:50])]  # near copies
    rows += [(3000, None, None, None), (3001, "", "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows], labels


def stages(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus()
    out = stages(spark, tmp_path, rows, labels)
    columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    assert all(df.columns == columns for name, df in out.items() if name != "packing")
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in out.items()}
    clean = {i for i, *_ in rows if i >= 1000 or i % 5}
    assert set(ids["toxicity"]) == clean
    dropped = [r[0] for r in rows if r[0] in clean and r[0] < 1000][:20]
    assert set(ids["exact_dedup"]) == clean - set(dropped) - {3000}
    near = set(ids["near_dedup"])
    assert len(ids["near_dedup"]) == len(near) and near == set(ids["exact_dedup"]) - set(range(2000, 2020))
    texts = [r.text for r in out["mixing"].select("text").collect()]
    tokenizer = load(public_tokenizers.path("word_bpe_49k.json"))
    held = out["packing"].collect()
    assert sum(r.length for r in held) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    ends = defaultdict(int)
    for r in sorted(held, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_empty_tables(spark, tmp_path):
    out = stages(spark, tmp_path, [], [])
    assert all(df.count() == 0 for df in out.values())


def test_registered_queries():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None
