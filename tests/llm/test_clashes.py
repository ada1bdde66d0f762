"""Columns of the caller's that are called like the operators' own."""

import random

from opsframe.llm import decontaminate, mixing, neardup, toxicity


def rows(names, n=60):
    rng = random.Random(1)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(["red", "blue", "apple", "runs", "seven", "door"]) + str(rng.randrange(40)) for _ in range(30))
        out.append((i, text if i % 9 else None, "en", f"s{i % 3}", 0, *["mine"] * len(names)))
    out += out[:3]
    return out, "doc_id long, text string, lang string, source string, n_chars int" + "".join(f", `{n}` string" for n in names)


def kept(df, names):
    found = df.collect()
    assert all(r[n] == "mine" for r in found for n in names)
    return len(found)


def test_mixing(spark):
    names = ["_mix_key", "_MIX_row", "_mix_share", "_mix_count", "_mix_copy", "_mix_source", "_mix_digest"]
    data, schema = rows(names)
    docs = spark.createDataFrame(data, schema)
    assert mixing.repeats(docs).columns == docs.columns
    plain, short = rows([])
    assert kept(mixing.repeats(docs), names) == mixing.repeats(spark.createDataFrame(plain, short)).count() > 0


def test_toxicity(spark):
    data, schema = rows(["_toxicity"])
    docs = spark.createDataFrame(data, schema)
    out = toxicity.clean(docs, toxicity.Model({}, -5.0))
    assert out.columns == docs.columns and kept(out, ["_toxicity"]) == len(data)


def test_near_duplicates(spark):
    data, schema = rows(["_kept_id", "_kept_node", "_node"])
    docs = spark.createDataFrame(data, schema)
    out = neardup.one_per_class(docs)
    assert out.columns == docs.columns and kept(out, ["_kept_id", "_node"]) > 0


def test_leaks(spark):
    data, schema = rows(["_leaked", "_digest"])
    docs = spark.createDataFrame(data, schema)
    items = spark.createDataFrame([(1, data[1][1])], "item_id long, text string")
    out = decontaminate.without_leaks(docs, items)
    assert out.columns == docs.columns and kept(out, ["_leaked", "_digest"]) == len(data) - 2


def test_repeated_rows_do_not_add_to_the_training_sample(spark):
    docs = spark.createDataFrame([(5, "same text")] * 500 + [(7, "b")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (7, 0), (9, 1)], "doc_id long, toxic int")
    found = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic").collect()
    assert len(found) == len({r["id"] for r in found}) <= 2
