import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattline.llm.catalog import QUERIES
from wattline.llm.spelling import counted_words, rotations, spelling_groups

from .conftest import LONG, SMALL


def brute_words(rows, one_in):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """The same by comparing every word with all words of nearly its length."""
    by_length, out = {}, {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def answer(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_near_words_and_chains(spark):
    words = {"colour": 90, "color": 100, "colors": 40, "colouur": 3, "colouuur": 4, "coloor": 7, "xxcolour": 3, "aaaaa": 9, "aaaaaa": 20, "aaaaaaa": 41, "baaaa": 9, "étésà": 8, "etesa": 3, "étesà": 4, "zebra": 5, "zebrb": 10, "zebrc": 10, "abcde": 3, "bcdea": 3}
    got = answer(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert got["aaaaa"][:2] == ("aaaaaa", "aaaaaaa") and got["zebra"][0] == "zebrb" and got["zebrb"][0] is None


def test_random_words(spark):
    import random

    rnd = random.Random(3)
    words = {"".join(rnd.choice("abÿ") for _ in range(rnd.randint(5, 7))): rnd.choice([3, 4, 6, 8, 12, 30, 70]) for _ in range(500)}
    assert answer(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_a_long_chain_of_forms(spark):
    words = {"abcde" + "xy" * (i // 2) + "x" * (i % 2): 3 * 2**i for i in range(20)}
    got = answer(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words) and {v[1] for v in got.values()} == {max(words, key=len)}


def test_prefix_runs_are_bounded_by_the_alphabet(spark):
    words = [("a" * 5 + chr(ord("a") + i), 3) for i in range(26)] + [("a" * 5, 3)]
    runs = rotations(spark.createDataFrame(words, "word string, n long")).groupBy("prefix").count()
    assert runs.agg(F.max("count")).first()[0] == 27


@pytest.mark.parametrize("one_in", [None, 2, 97])
def test_odd_rows(spark, odd_docs, odd_rows, no_docs, one_in):
    table = odd_docs.withColumns({"word": F.lit("clash"), "n": F.lit(1), "root": F.lit(2)})
    want = brute_words([("null" if r[0] is None else r[0], r[1]) for r in odd_rows], one_in)
    assert {r.word: r.n for r in counted_words(table, one_in).collect()} == want and (one_in or "thetion" in want) and LONG
    assert counted_words(no_docs, one_in).count() == 0
    assert spelling_groups(counted_words(no_docs, one_in)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(brute_words(rows, 97))
    got = QUERIES["op13_permuterm_spelling"](spark, SMALL)
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(want) > 100 and any(v[0] for v in want.values()) and answer(got) == want
