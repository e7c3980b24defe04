import random
from collections import Counter

import corpus_pipeline
from tallybrook.llm.lines import LineDedup
from tallybrook.llm.mixing import Mix
from tallybrook.llm.simhash import SimHash
from tallybrook.llm.toxicity import Toxicity
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_simhash import brute as plain_groups
from tests.llm.test_simhash import plain as plain_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng, part = random.Random(8), ["ra", "to", "mi", "en", "sol", "ka", "ber", "li"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(300):
        ws = [word() for _ in range(rng.randint(20, 90))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(6):
                ws[rng.randrange(len(ws))] = "idiot"
        text = " ".join(ws) + ("\nThis is a line of boiler plate that many share" if rng.random() < 0.5 else "")
        docs.append((i, text, "en", rng.choice("aaabc"), len(text)))
        labels.append((i, 1, toxic))
    docs += [(1000 + i, docs[i % 7][1], "en", "a", 5) for i in range(40)] + [(2000, None, None, None, None), (None, "ra to mi", "en", "b", 8)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_one_after_another(spark, tmp_path):
    sf = corpus(spark, f"file://{tmp_path}")
    docs, last = spark.read.parquet(f"{sf}/documents.parquet"), None
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{sf}/out-{k}")
        docs = spark.read.parquet(f"{sf}/out-{k}")
        after = docs.collect()
        if name == "toxicity":
            kept = {r.doc_id for r in after}
            assert not any(truth.get(i) for i in kept) and all(r.doc_id in kept for r in before if truth.get(r.doc_id) == 0)
        elif name == "line_dedup":
            want = plain_lines([(r.doc_id, r.text) for r in before])
            assert Counter((r.doc_id, r.text or "") for r in after) == Counter((i, t) for i, _, _, t in want)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "near_dedup":
            low = lambda i: -1 if i is None else i
            want = {i for i, g in plain_groups([(low(r.doc_id), plain_print(r.text)) for r in before]).items() if i == g}
            assert Counter(low(r.doc_id) for r in after) == Counter(want)
        elif name == "mixing":
            want = Counter()
            for r in Mix().apply(spark.read.parquet(f"{sf}/out-{k - 1}")).collect():
                want[r.doc_id] += r.repeats
            assert Counter(r.doc_id for r in after) == +want
        last = after
    run = corpus_pipeline.run(spark, sf).collect()
    assert Counter(map(str, run)) == Counter(map(str, last)) and len(run) > 100


def test_operators_keep_repeated_rows(spark):
    rows = [(1, "same text here now", "en", "a", 18)] * 2 + [(2, "same text here now", "en", "a", 18), (1, "another text altogether", "en", "a", 3)]
    kept = SimHash().keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "another text altogether"), (1, "same text here now")]


def test_empty(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (Toxicity().apply(empty, labels), LineDedup().apply(empty), SimHash().keep_one(empty), Mix().repeated(empty)):
        assert out.count() == 0 and out.columns == empty.columns
