from pyspark.sql import functions as F

from notegraph.llm.decontaminate import Templates, contamination, remove_contaminated

ITEM = "a train leaves the old station at 9:30 and Maria rides it for 120 km before she meets Peter at noon"
OTHER = "each farmer in the wide valley keeps two brown goats and a very loud rooster near the barn"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_templates_match_reparameterised_items(spark, docs_of):
    changed = ITEM.replace("9:30", "7:45").replace("Maria", "Anna").replace("120 km", "35 miles").replace("Peter", "Tom")
    broken = ITEM.replace("Maria", "Anna").replace("Peter", "Anna")
    rows = [(1, "some words first " + ITEM + " and more after"), (2, "xx " + changed), (3, "xx " + broken), (4, None), (5, ""), (6, OTHER[:40]), (7, "prose " * 40), (1, "some words first " + ITEM + " and more after"), (8, "é " * 60000)]
    docs = docs_of(rows)
    b = bench(spark, [(10, ITEM), (11, OTHER), (12, None), (13, "too short"), (14, "")])
    got = {(r.doc_id, r.item_id): r.exact for r in contamination(docs, b).collect()}
    assert got == {(1, 10): True, (2, 10): False}
    left = remove_contaminated(docs, b)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 8]
    odd = docs.withColumn("row_key", F.lit("x")).withColumn("_ROW_KEY", F.lit("y")).withColumn("item_id", F.lit("z"))
    kept = remove_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.where("row_key = 'x' and item_id = 'z'").count() == 6


def test_items_of_one_template(spark, docs_of):
    text = "Tom has {} apples in his basket. He sells {} of them to the baker. How many apples are left for Tom?"
    items = [(1, text.format(3, 3)), (2, text.format(3, 5)), (3, text.format(9, 4)), (4, text.format(8, 8))]
    rows = [(n, "before it " + t + " after") for n, t in items]
    changed = text.replace("Tom", "Mary Ann").replace("He", "She").replace("his", "her")
    rows += [(5, changed.format("1 000", 7).replace("her", "his")), (6, text.lower().format(3, 5)), (7, text.format(3, 5).replace(" ", "\n")), (8, text.replace("left for Tom", "left for Anna").format(6, 1)), (9, text.replace("to the baker", "to the young baker").format(9, 4))]
    got = {}
    for r in contamination(docs_of(rows), bench(spark, items)).collect():
        got.setdefault(r.doc_id, set()).add((r.item_id, r.exact, r.n_items))
    assert got[1] == {(1, True, 1)} and got[2] == {(2, True, 1)} and got[3] == {(3, True, 1)} and got[4] == {(4, True, 1)}
    assert got[5] == {(2, False, 2)} and got[6] == {(2, True, 1)} and got[7] == {(2, True, 1)} and 8 not in got
    assert {i for i, *_ in got[9]} == {2} or {i for i, *_ in got[9]} == {3}


def test_dense_and_very_short_items(spark, docs_of):
    b = bench(spark, [(1, "12 + 30 = 42, 17 + 5 = 22, 1 + 1 = 2"), (2, "Paris?"), (3, "Anna Bob")])
    docs = docs_of([(1, "so 12 + 30 = 42, 17 + 5 = 22, 1 + 1 = 2 it is"), (2, "13 + 30 = 43, 17 + 5 = 22, 1 + 1 = 2"), (3, "paris"), (4, "in Paris they say"), (5, "Paris"), (6, "London")])
    assert {(r.doc_id, r.item_id) for r in contamination(docs, b).collect()} == {(1, 1), (3, 2), (5, 2)}


def test_recall_of_reparameterised_benchmark_items(spark, docs_of):
    """Every capitalised word renamed, sentence starts too, and numbers put in."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    texts = [(r.item_id, re.sub(r"(\w+) (\w+)\.", r"\1 17 \2 in 250 days.", r.text, count=2)) for r in rows]
    changed = []
    for i, t in texts:
        names = {}
        renamed = re.sub(r"[A-Z]\w*", lambda m: names.setdefault(m[0], f"N{chr(97 + len(names) // 26)}{chr(97 + len(names) % 26)}x"), t)
        changed.append((i, "word before. " + renamed.replace("17", "9").replace("250", "1,375") + " and after"))
    got = {(r.doc_id, r.item_id) for r in contamination(docs_of(changed), bench(spark, texts)).collect()}
    found = sum((i, i) in got for i, _ in texts)
    assert found >= 0.9 * len(texts), found
    assert len(got) <= found + 1


def test_short_items_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "he said the quick red fox jumps and left"), (2, "nothing here")])
    b = bench(spark, [(1, "The quick red fox jumps")])
    assert [(r.doc_id, r.item_id) for r in contamination(docs, b).collect()] == [(1, 1)]
    assert contamination(docs, bench(spark, [])).count() == 0
    assert contamination(docs_of([]), b).count() == 0
    assert [(r.doc_id, r.item_id) for r in contamination(docs, b, Templates(max_broadcast_rows=0)).collect()] == [(1, 1)]


def test_against_brute_force(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    items = {r.item_id: norm(r.text) for r in b.collect()}
    whole = set()
    for r in docs.select("doc_id", "text").collect():
        words = " " + " ".join(norm(r.text)) + " "
        whole |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in words}
    got = {(r.doc_id, r.item_id) for r in contamination(docs, b).collect()}
    assert len(whole) > 20 and whole <= got
    assert len(got - whole) <= 3
