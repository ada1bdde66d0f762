import random

from opsframe.llm.decontaminate import NAME, NUMBER, UNIT, WORD, Tokens, leak_pairs, without_leaks
from opsframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, item_id string, hash int"
ITEMS = "item_id long, text string, place int"


def test_kinds():
    tokens = Tokens()
    _, _, kind = tokens.of('Then Anna paid $3.50 for 20 kg, "five" -- Of flour? Yes THE End.')
    assert kind.tolist() == [WORD, NAME, WORD, NUMBER, WORD, NUMBER, UNIT, NUMBER, NAME, WORD, WORD, WORD, NAME]
    assert [len(x) for x in tokens.of("")] == [0, 0, 0]


ITEM = "At noon the farmer Anna sells 12 apples to the baker Bruno and keeps 30 apples for her own mother Carla at home."


def cases():
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice(["tor", "mel", "kan", "ris", "ud", "pa"]) for _ in range(n))
    swap = ITEM.replace("Anna", "Maria").replace("12", "7").replace("30", "55").replace("Bruno", "Otto")
    mixed = ITEM.replace("12 apples", "7 apples").replace("30 apples", "12 apples")
    # one benchmark value (twice 5) that became two values is another question
    double = "she puts 5 red balls and 5 blue balls into a"
    rows = [
        (0, noise(50) + " " + ITEM + " " + noise(50), {1}),
        (1, noise(5000) + " " + swap, {1}),
        (2, mixed, {1}),
        (3, noise(400), set()),
        (4, double.replace("5", "8"), {2}),
        (5, double.replace("5 red", "8 red").replace("5 blue", "9 blue"), set()),
        (6, ITEM[:40], set()),
        (7, None, set()), (8, "", set()), (9, "few words", set()),
        (10, "He said quite short words only", {3}),
        (11, ITEM.upper().replace(" ", " !! "), {1}),  # a whole copy is one in any case
    ]
    items = [(1, ITEM, 0), (2, double, 0), (3, "quite short words only", 0), (4, "ok", 0), (5, None, 0), (6, "", None)]
    return rows, items


def test_leaks(spark):
    rows, items = cases()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in rows] * 2, DOCS).repartition(3)
    bench = spark.createDataFrame(items, ITEMS)
    got = {}
    for r in leak_pairs(docs, bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert r["changed"] == (r["doc_id"] in (1, 2, 4))
    assert got == {d: want for d, _, want in rows if want}
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([d for d, _, want in rows if not want] * 2)
    assert leak_pairs(docs.limit(0), bench).count() == 0
    assert leak_pairs(docs, bench.limit(0)).count() == 0


def test_query_finds_copied_items(spark):
    """Against plain containment: every document that holds a whole item is found, and no other text is near one."""
    sf = "/root/testdata/sf0.01"
    norm = lambda t: " ".join(w.strip(".,!?*#$%&|\"").lower() for w in t.split() if w.strip(".,!?*#$%&|\""))
    docs = {r["doc_id"]: f" {norm(r['text'])} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in text}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_templates"](spark, sf).collect()}
    assert want and want <= got
    for d, i in got - want:
        words = items[i].split()
        runs = {" ".join(words[k : k + 8]) for k in range(len(words) - 7)}
        assert sum(run in docs[d] for run in runs) >= 2, (d, i)


def test_whole_copies_in_any_case_place_and_length(spark):
    rows, items = cases()
    items += [
        (11, "Each farmer sells 12 apples to a baker at noon today.", 0),  # ten words: all windows are needed
        (12, "12 kg 30 kg Anna Bruno 7 8 9 km", 0), (13, "Blue heron", 0),
    ]
    rows = [(d, t, {1} if d == 11 else want) for d, t, want in rows]  # an upper-cased copy is a copy
    rows += [
        (20, "so we said " + items[-3][1], {11}), (21, "so we said " + items[-3][1].replace("12", "15"), {11}),
        (22, ITEM.lower(), {1}), (23, "tor mel 12 kg 30 kg Anna Bruno 7 8 9 km pa", {12}), (24, "a BLUE heron.", {13}),
        (25, "blue herons and a heron", set()),
    ]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in rows], DOCS).repartition(3)
    got = {}
    for r in leak_pairs(docs, spark.createDataFrame(items, ITEMS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert r["changed"] == (r["doc_id"] in (1, 2, 4, 21))
    assert got == {d: want for d, _, want in rows if want}


def test_several_exchanged_copies_of_an_item_in_one_text(spark):
    rng = random.Random(9)
    item = "put 5 tor 17 mel kan 80 ris ud pa into it"
    copy = lambda: item.replace("5", str(rng.randint(100, 999))).replace("17", str(rng.randint(100, 999))).replace("80", str(rng.randint(100, 999)))
    rows = [(i, " and so on ".join(copy() for _ in range(2 + i % 4)), "x", 1) for i in range(40)]
    rows += [(100 + i % 5, copy(), "x", 1) for i in range(20)]  # four texts that share an id
    rows += [(200, item.replace("17 mel", "17 new mel").replace("80", "81"), "x", 1)]  # words put in: too few windows are left
    got = leak_pairs(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(1, item, 0)], ITEMS)).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(40), *range(100, 105)]
    assert all(r["changed"] and r["windows"] == 5 for r in got)
