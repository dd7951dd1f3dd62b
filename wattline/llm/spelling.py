"""Spelling variants: words one edit apart, found by permuterm rotations.

A word with its end mark, ``w$``, has one rotation per code point and one that ends in the mark. The rotation that ends in a code
point c is ``K c``: all words that differ from w by another code point in c's place have a rotation with the same prefix K,
and the word without c has the rotation K itself. So replacements and indels at one place meet as rotations that share
the prefix K, which skips the edited code point. All rotations are shuffled and sorted by K and every run of equal prefixes is scanned
once. A run holds at most one word per code point and the word without it, so its size is bounded by the alphabet, not by the
data. A code point inside a run of equal ones (``oo``) could be taken out at several places; only the last place
counts for indels, so every pair of near words meets exactly once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import attach, stash
from wattline.llm.registry import register, table

RUN = "[a-zÀ-ÿ]+"
#: One document in so many has a code point of a word deleted (per word), so that there are variants to find. None: words as they are.
DELETE_ONE_IN = 97
#: Distinct words that a task counts before it hands the counts on.
MOST_HELD = 200_000
#: The end mark; no word holds it.
MARK = "$"


def counted_words(docs: DataFrame, delete_one_in: int | None = None, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of whole texts and how often they occur, at least ``shortest`` code points and ``least`` times.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case. With ``delete_one_in``, h = crc32 of
    ``<id>:<word>`` decides: where it divides h, the word loses the code point h % length (from 0) in that document; a null id
    is written as ``null``. Null and empty texts have no words; repeated rows count again; an empty table gives no rows.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(RUN).findall
        total: dict[str, int] = defaultdict(int)
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                if not text:
                    continue
                ahead = zlib.crc32(f"{key}:".encode("utf-8", "surrogatepass"))
                for word, n in Counter(find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    if len(word) < shortest:
                        continue
                    if delete_one_in:
                        h = zlib.crc32(word.encode(), ahead)
                        if h % delete_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    total[word] += n
                if len(total) > MOST_HELD:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, alone, word, n): every rotation of ``word$``, cut before the code point that an edit may touch.

    ``skipped``: that code point; null for the whole rotation, as which the word stands for all words with one more
    code point there. ``alone``: it is the last of its run of equal code points.
    """
    places = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    head, tail, c = F.expr("left(word, at)"), F.expr("substr(word, at + 2)"), F.expr("substr(word, at + 1, 1)")
    whole = F.struct(F.concat(F.expr("substr(word, at + 1)"), F.lit(MARK), head).alias("prefix"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("alone"))
    cut = F.struct(F.concat(tail, F.lit(MARK), head).alias("prefix"), c.alias("skipped"), (c != F.expr("substr(word, at + 2, 1)")).alias("alone"))
    both = places.select("word", "n", F.explode(F.when(F.col("at") < F.length("word"), F.array(whole, cut)).otherwise(F.array(whole))).alias("r"))
    return both.select("r.prefix", "r.skipped", "r.alone", "word", "n")


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, near): how many of the other ``words`` (word, n; distinct) are one edit away, and the most frequent of them.

    ``near`` is struct(rank, word) with rank = -n; of equally frequent ones it is the smallest in code-point order. Words
    without a near one do not appear.
    """
    run = Window.partitionBy("prefix")
    order = run.orderBy(F.col("skipped").isNull(), F.desc("n"), "word")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("rank"), F.col("word").alias("word"))
    whole = F.col("skipped").isNull()
    scan = rotations(words).select(
        "word",
        "n",
        "skipped",
        "alone",
        F.row_number().over(order).alias("at"),
        F.sum(F.when(~whole, 1)).over(every).alias("cuts"),
        F.sum(F.when(~whole & F.col("alone"), 1)).over(every).alias("indels"),
        F.first(F.when(~whole, me)).over(every).alias("first"),
        F.lead(F.when(~whole, me)).over(order).alias("following"),
        F.max(F.when(whole, me)).over(every).alias("shorter"),
        F.min(F.when(~whole & F.col("alone"), me)).over(every).alias("longer"),
    )
    has_shorter = F.col("alone") & F.col("shorter").isNotNull()
    n_near = F.when(whole, F.coalesce("indels", F.lit(0))).otherwise(F.col("cuts") - 1 + F.when(has_shorter, 1).otherwise(0))
    other = F.when(F.col("at") == 1, F.col("following")).otherwise(F.col("first"))
    near = F.when(whole, F.col("longer")).otherwise(F.least(other, F.when(has_shorter, F.col("shorter"))))
    met = scan.select("word", n_near.alias("n_near"), near.alias("near")).where("n_near > 0")
    return met.groupBy("word").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("near").alias("near"))


def spelling_groups(words: DataFrame, times: int = 2, most_rounds: int = 40) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words).

    form: the near word (one code point inserted, deleted or replaced) of largest n, the smallest in code-point order of equal
    ones, if that n is at least ``times`` (2 or more) the word's own; else null. root: the last word when forms are followed; the
    word itself without one. n at least doubles along a chain, so chains are short, and their length is
    halved per round of joins; every round is written to the shared folder. An empty table gives no rows.
    """
    words = stash(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_counts(words)
    known = words.join(near, "word", "left")
    fits = -F.col("near.rank") >= F.lit(times) * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near.word")).alias("form"), F.when(fits, -F.col("near.rank")).alias("form_n"))
    known = stash(known, "forms")
    link = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(most_rounds):
        ahead = link.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        link = stash(attach(link, ahead, ["root"], F.col("word")).select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if link.where("moved").isEmpty():
            return known.join(link.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        link = link.drop("moved")
    raise RuntimeError(f"spelling_groups: not settled after {most_rounds} rounds")


@register("op13_permuterm_spelling")
def op13_permuterm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(counted_words(table(spark, sf_dir, "documents"), DELETE_ONE_IN))
