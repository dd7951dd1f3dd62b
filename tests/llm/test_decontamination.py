import random

import pytest
from pyspark.sql import functions as F

from wattline.llm.catalog import QUERIES
from wattline.llm.decontamination import Finder, contaminated, cut, decontaminate, edit_budget, myers, normalise

from .conftest import DOCS, SMALL


def best_match(item, text, budget):
    """Smallest edit distance of the item to any part of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = None
    for end, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        if row[-1] <= budget and (best is None or row[-1] < best[0]):
            best = row[-1], end
    return best


def test_distance_and_pieces():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        budget = rng.randint(0, 60)
        assert myers(item, text, budget) == best_match(item, text, budget)
        pieces = cut(item, budget)
        assert "".join(p for _, p in pieces) == item and len(pieces) == min(budget + 1, len(item))


def test_finder_misses_no_edited_item():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abcde ") for _ in range(rng.randint(20, 120)))
        text = list(item)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "xy"])
        text = "".join(rng.choice("abcde ") for _ in range(50)) + "".join(text) + "".join(rng.choice("abcde ") for _ in range(50))
        want = best_match(item, text, edit_budget(len(item)))
        assert [m[1] for m in Finder([(7, item)]).matches(text)] == ([want[0]] if want else [])


@pytest.mark.parametrize("block", [10**6, 60])
def test_odd_rows(spark, odd_docs, odd_rows, no_docs, block):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = odd_docs.unionByName(spark.createDataFrame([(50, f"Some text. THE QUICK, brown fox jumps over the lazy dog near the river bank!! And more", None, None, 0), (51, "before " + item.replace("lazy", "lasy") + " after", None, None, 0), (52, item[:30], None, None, 0)], DOCS))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "!!"), (None, item), (5, "cat sat"), (6, "at sat")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, r.distance) for r in contaminated(docs.withColumn("item_id", F.lit("clash")), items, block_chars=block).collect())
    assert got == [(1, 5, 0), (2, 5, 0), (2, 5, 0), (50, 1, 0), (51, 1, 1)]
    left = sorted((r.doc_id for r in decontaminate(docs, items, block_chars=block).collect()), key=str)
    assert left == sorted((i for i in [r[0] for r in odd_rows] + [52] if i not in (1, 2)), key=str)
    assert contaminated(no_docs, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10**6, 60])
def test_items_of_one_id_and_of_none(spark, block):
    """Every text of a repeated or null item id is searched, whatever the block size; the id gives one row, the best."""
    one, two, three = "the quick brown fox jumps over the lazy dog", "a second passage about rivers and their banks", "some unnamed passage that is in the benchmark"
    texts = [one, two, f"{one.replace('lazy', 'lasy')} and {two}", three, "nothing of them at all", two]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)] + [(5, two, None, None, 0)], DOCS)
    items = spark.createDataFrame([(1, one), (1, two), (None, three), (None, "another one without any id at all"), (2**60 + 1, one)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in contaminated(docs, items, block_chars=block, unnamed=True).collect())
    assert got == [(0, 1, 0), (0, 2**60 + 1, 0), (1, 1, 0), (2, 1, 0), (2, 2**60 + 1, 1), (3, 0, 0), (5, 1, 0), (5, 1, 0)]
    assert [r.doc_id for r in decontaminate(docs, items, block_chars=block).collect()] == [4]


def test_query_against_all_items(spark):
    items = {r.item_id: normalise(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = {r.doc_id: normalise(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op9_pigeonhole_decontamination"](spark, SMALL).collect()}
    assert {pair for pair, d in got.items() if d == 0} == {(d, i) for d, t in texts.items() for i, p in items.items() if p and p in t}
    for (d, i), n in got.items():
        assert best_match(items[i], texts[d], edit_budget(len(items[i])))[0] == n
