"""The whole pipeline against a plain rewriting of its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_brute
from test_suffix import brute as leak_brute
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestone.llm import langid
from lodestone.llm.queries import VOCABULARY


def language(model, text):
    raw = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total, weight = 0.0, 0
    for i in range(0, len(raw), langid.WINDOW):
        w = np.zeros((1, langid.WINDOW), np.uint8)
        piece = raw[i : i + langid.WINDOW]
        w[0, : len(piece)] = np.frombuffer(piece, np.uint8)
        total = total + model.probabilities(w)[0] * len(piece)
        weight += len(piece)
    p = total / weight
    return model.labels[int(p.argmax())], float(p.max())


def cut(rows, k=20):
    seen, out = set(), []
    for d, t in sorted(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            if x in seen:
                gone[a : a + k] = [True] * k
            seen.add(x)
        out.append((d, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t))
    return out


def test_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train_on(docs, "text", "lang", F.col("doc_id"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = {d: language(model, t) for d, t in rows}
    rows = [(d, t) for d, t in rows if judged[d][0] != "und" and judged[d][1] >= P.MIN_SCORE]
    kept = near_brute(rows, 5)
    rows = cut([(d, t) for d, t in rows if kept[d][2]])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {x[0] for x in leak_brute(rows, items) if x[5]}
    t = Tokenizer.from_file(VOCABULARY)
    want = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in rows if d not in hit}
    got = {r["doc_id"]: r["input_ids"] for r in P.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark, sf, odd_docs, no_docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, no_docs.select(cols), sf).columns == cols and stage(spark, no_docs.select(cols), sf).count() == 0, name
        assert stage(spark, odd_docs.select(cols), sf).count() <= odd_docs.count()
    assert P.STAGES[2][1](spark, odd_docs.select(cols).where("doc_id > 1"), sf).where("text is null").count() == 1
    assert P.STAGES[-1][1](spark, odd_docs.select(cols), sf).count() == odd_docs.count()


def test_clashing_columns_and_odd_names(spark, sf, odd_docs):
    """Extra columns with the operators' own names, and names that need quoting, come through every stage with their rows."""
    own = ["kept_text", "component_id", "contaminated", "carried", "row", "no_text", "_key", "score", "a.b", "h"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat_ws("|", F.lit(c), "doc_id").alias(c) for c in own))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "|".join([c, *([str(r["doc_id"])] if r["doc_id"] is not None else [])]) for r in rows for c in own), name


def test_nothing_is_left_behind(spark, sf):
    from lodestone.llm import common

    before = common.tables_written(spark)
    out = P.run(spark, sf)
    assert common.tables_written(spark) == before + 1 and out.count() > 0
    common.release_tables(spark, last=False)
    assert common.tables_written(spark) == 0
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    assert not len(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)) and not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestone_blocks")]


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "bpe"]
    with pytest.raises(TypeError):
        P.run()


def test_repeated_rows_and_null_ids(spark, sf):
    item = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    once, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, once), (1, once), (1, once), (2, other), (None, other), (None, item), (3, item), (1, "short"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], cols).repartition(3)

    def left(stage, docs):
        return sorted(((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in stage(spark, docs, sf).collect()), key=str)

    def expect(*rows):
        return sorted(((d, t, "en", len(t or "")) for d, t in rows), key=str)

    assert left(P.near_dedup, docs) == expect((1, once), (2, other), (3, item), (1, "short"), (None, None))
    assert left(P.substring_dedup, docs) == expect((1, once), (1, ""), (1, ""), (2, ""), (None, other), (None, item), (3, ""), (1, "short"), (None, None))
    assert left(P.decontaminate, docs) == expect(*(r for r in rows if r[1] != item))
    assert (None, None) not in [r[:2] for r in left(P.language_id, docs)]
