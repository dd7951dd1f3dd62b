"""Exact n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row per document and a column per word n-gram (64-bit hash). Two documents link when
intersection / union >= percent / 100, that is when they differ in at most
k = floor((100 - percent) * (size_a + size_b) / (100 + percent)) n-grams.

1. Column blocks. The columns are dealt into m > k blocks by hash. A pair that differs in every block is below the
   size-derived bound and is never formed; a pair that may link agrees in whole blocks. m depends on the size class of a
   document, and a document takes part in its own class and in the next larger one, so that any two sizes that may
   link meet in one class. Equal blocks are found by a range shuffle on (block digest, document), which parts even the
   most frequent digest among tasks. m leaves a linked pair several agreeing blocks, so documents are tied only if
   they may agree in that many. Pairs are counted within rare digests; of a frequent digest, only documents that have as
   many frequent ones as a link asks for are tied, to the smallest of them.
2. Row blocks. Documents so tied form families. The distinct n-gram sets of a family are cut into row blocks; each pair
   of row blocks is one small product of 0/1 matrices. Overlap counts are added up over tiles of columns; after each
   tile, pairs that can no longer reach the bound of their sizes are discarded, and the product ends when none is left.
   A task returns links that span what it joined, never all pairs.
3. Components of the links, with equal sets as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import attach, components, discard, in_batches, small_frames, stash, words
from wattline.llm.registry import register, table

#: Distinct sets per row block, and columns per tile of a product.
ROW_BLOCK = 1024
COLUMN_TILE = 2048
#: Hash values of ids that travel to all tasks to leave out texts no product needs (8 bytes each, so many at most). Where
#: most values are taken it leaves out none; the join that follows decides.
ID_HASHES = 1 << 20
#: N-grams per row block, which bounds the memory of a product of long texts.
BLOCK_NGRAMS = 1_000_000
#: Documents of a rare digest at most, within which agreeing blocks are counted pair by pair.
FEW = 16

#: Low bits of a tag, for the number of digests to share.
NEED_BITS = 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text; with fewer words, of the whole sequence."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, found)), np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def budget(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return (100 - percent) * total // (100 + percent)


def size_class(n: int, percent: int) -> int:
    """Classes grow so that two sizes that may link (smaller * 100 >= larger * percent) lie in one class or two neighbours."""
    return int(np.searchsorted(_class_starts(percent), n, side="right")) - 1


_starts: dict[int, np.ndarray] = {}


def _class_starts(percent: int) -> np.ndarray:
    if percent not in _starts:
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * 100 // percent + 1)
        _starts[percent] = np.array(edges)
    return _starts[percent]


def spare(k: int) -> int:
    """Blocks beyond budget + 1: a linked pair agrees in so many and one more."""
    return 1 + k // 8


def block_digests(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the column blocks of a set, in its own size class and the next larger one, and a tag for each.

    m = k + 1 + spare blocks (k: the budget of the class) leave spare + 1 agreeing ones at least. Empty blocks say
    nothing and are left out, unless more than ``spare`` of a set's blocks are empty: two such sets may agree in empty blocks
    alone. A tag holds the class and how many digests a linked set must share: for two sets, the larger of their
    numbers (spare + 1 less the blocks left out; 1 where none is left out though many are empty).
    """
    starts = _class_starts(percent)
    own = size_class(len(shingles), percent)
    out, tags = [], []
    with np.errstate(over="ignore"):
        mixed = _mix(shingles + _U(0x632BE59BD9B4E019))
        for c in (own, own + 1):
            k = budget(2 * int(starts[c + 1] - 1), percent)
            m = k + 1 + spare(k)
            block = ((shingles >> _U(7)) % _U(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, block, mixed)
            filled = np.bincount(block, minlength=m)
            empty = int((filled == 0).sum())
            keep, need = (np.flatnonzero(filled > 0), spare(k) + 1 - empty) if empty <= spare(k) else (np.arange(m), 1)
            salt = np.array(c, np.uint64) * _U(0x9E3779B97F4A7C15)
            out.append(_mix(_mix(total[keep] + filled[keep].astype(np.uint64)) + salt + keep.astype(np.uint64)))
            tags.append(np.full(len(keep), (c << NEED_BITS) + min(need, (1 << NEED_BITS) - 1), np.int32))
    return np.concatenate(out).view(np.int64), np.concatenate(tags)


class Forest:
    """Union-find over a few documents, smallest index as root."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs (into ``left``, into ``right``; i < j within ``left`` where right is None) of linked sets."""
    if len(left) == 2 and right is None or right is not None and len(left) == len(right) == 1:
        a, b = left[0], left[1] if right is None else right[0]
        low, high = sorted((len(a), len(b)))
        if low * 100 >= high * percent:
            both = len(np.intersect1d(a, b, assume_unique=True))
            if (100 + percent) * both >= percent * (low + high):
                yield 0, 1 if right is None else 0
        return
    every = left if right is None else left + right
    sizes = np.array([len(s) for s in every])
    columns, back = np.unique(np.concatenate(every), return_inverse=True)
    shared = np.bincount(back) > 1  # a column of one document adds to no overlap
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(every)), sizes)[shared[back]]
    col = place[back[shared[back]]]
    n_cols, n_left = int(shared.sum()), len(left)
    a_size, b_size = sizes[:n_left], sizes if right is None else sizes[n_left:]
    need = -(-percent * (a_size[:, None] + b_size[None, :]) // (100 + percent))
    alive = np.minimum(a_size[:, None], b_size[None, :]) >= need
    if right is None:
        alive &= np.arange(n_left)[:, None] < np.arange(n_left)[None, :]
    overlap = np.zeros(need.shape, np.int64)
    rest = np.bincount(row, minlength=len(every))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    edges = np.searchsorted(col, np.arange(0, n_cols + COLUMN_TILE, COLUMN_TILE))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        ahead = np.minimum(rest[:n_left, None], (rest if right is None else rest[n_left:])[None, :])
        alive &= overlap + ahead >= need
        if not alive.any():
            return
        tile = np.zeros((len(every), COLUMN_TILE), np.float32)
        tile[row[a:b], col[a:b] - k * COLUMN_TILE] = 1
        overlap += (tile[:n_left] @ (tile if right is None else tile[n_left:]).T).astype(np.int64)
        rest = rest - np.bincount(row[a:b], minlength=len(every))
    for i, j in zip(*np.nonzero(alive & (overlap >= need)), strict=True):
        yield int(i), int(j)


def _ties(keyed: DataFrame) -> DataFrame:
    """(u, v): documents that may link, tied so that no two of them are left apart.

    ``keyed``: (doc, own, own_tag, next, next_tag). The digests are sorted over all partitions, ties by document. Two linked sets share at
    least as many digests of a class as their tags ask for (``need``). A digest is rare if it has ``FEW`` documents at most
    and no partition's end may cut it, else frequent. Let f be the frequent digests a document has in the class. Linked
    sets that share s rare digests share min(f, f') frequent ones at most, so s >= need - min(f, f'); these are
    found by counting pairs. Linked sets that share none have need frequent digests each, at least one of them in
    common; so of each frequent digest those documents are tied to the smallest of them.
    """
    # all digests of a class have one tag, which stands beside them once
    by_class = keyed.select("doc", F.stack(F.lit(2), "own_tag", "own", "next_tag", "next").alias("tag", "keys"))
    rows = by_class.select(F.explode("keys").alias("key"), "doc", "tag")
    placed = rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc")

    def tie(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = waiting = running = None  # the partition's first digest; rows of a batch's last one; a frequent one that goes on
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            key = frame["key"].to_numpy()
            first = key[0] if first is None else first
            whole = int(np.searchsorted(key, key[-1]))  # rows before the last digest, of which more may follow
            if len(frame) - whole > FEW:  # a frequent digest is passed on as it comes
                whole = len(frame)
            waiting = frame.iloc[whole:] if whole < len(frame) else None
            if whole:
                yield from _tie_batch(frame.iloc[:whole], (first, running))
                running = key[whole - 1]
        if waiting is not None:
            yield from _tie_batch(waiting, (first, waiting["key"].iloc[-1]))

    mask = F.lit((1 << NEED_BITS) - 1)
    found = placed.mapInPandas(tie, "u long, v long, key long, tag int").groupBy("u", "v", "key", F.shiftright("tag", NEED_BITS).alias("class"))
    found = stash(found.agg(F.count("*").alias("n"), F.max(F.col("tag").bitwiseAND(mask)).alias("need")), "ties")
    frequent = found.where("v is null").select(F.col("u").alias("doc"), "key", "class", "need")
    f = stash(frequent.groupBy("doc", "class").agg(F.count("*").alias("f")), "frequent")
    able = stash(frequent.join(f, ["doc", "class"]).where("f >= need").select("doc", "key"), "able")
    stars = attach(able, able.groupBy("key").agg(F.min("doc").alias("v")), ["key"], F.col("doc"), "inner").select(F.col("doc").alias("u"), "v")
    pairs = found.where("v is not null").join(f.select(F.col("doc").alias("u"), "class", F.col("f").alias("fu")), ["u", "class"], "left")
    pairs = pairs.join(f.select(F.col("doc").alias("v"), "class", F.col("f").alias("fv")), ["v", "class"], "left")
    enough = F.col("n") >= F.col("need") - F.least(F.coalesce("fu", F.lit(0)), F.coalesce("fv", F.lit(0)))
    return pairs.where(enough).select("u", "v").unionByName(stars).where("u <> v").distinct()


def _tie_batch(frame: pd.DataFrame, cut: tuple) -> Iterator[pd.DataFrame]:
    """Pairs (u, v) within the rare digests of a batch of sorted rows, and rows (u, key) of the others; ``cut``: digests that are frequent anyway."""
    key, doc, tag = frame["key"].to_numpy(), frame["doc"].to_numpy(), frame["tag"].to_numpy()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(at, len(key)))
    large = size > FEW
    for k in cut:
        if k is not None:
            large |= key[at] == k
    hot = np.repeat(large, size)
    if hot.any():
        yield _tie_frame(doc[hot], None, key[hot], tag[hot])
    place = np.arange(len(key)) - np.repeat(at, size)
    for lag in range(1, FEW):
        j = np.flatnonzero((place >= lag) & ~hot)
        if not j.size:
            break
        i = j - lag
        # the tags of one digest are of one class
        yield _tie_frame(np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j]), None, np.maximum(tag[i], tag[j]))


def _tie_frame(u, v, key, tag) -> pd.DataFrame:
    none = pd.array([None] * len(u), "Int64")
    return pd.DataFrame({"u": u, "v": none if v is None else v, "key": none if key is None else key, "tag": tag})


def _row_block_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that span the linked sets of each family. ``sets``: (family, blocks, doc, shingles); ``blocks``: row blocks of the family."""
    rows = sets.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    parts = rows.select("family", "low", "high", "own", "doc", "shingles").repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "own", "doc")

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(key, held):
            docs = [d for _, d, _ in held]
            left = [np.frombuffer(s, np.uint64) for o, _, s in held if o == key[1]]
            right = None if key[1] == key[2] else [np.frombuffer(s, np.uint64) for o, _, s in held if o == key[2]]
            if len(held) < 2 or (right is not None and not (left and right)):
                return []
            forest, shift = Forest(len(held)), 0 if right is None else len(left)
            return [(docs[i], docs[j + shift]) for i, j in linked_pairs(left, right, percent) if forest.join(i, j + shift)]

        key, held, out = None, [], []
        for frame in frames:
            for family, low, high, own, doc, s in frame.itertuples(index=False, name=None):
                if (family, low, high) != key:
                    out += solve(key, held) if held else []
                    key, held = (family, low, high), []
                held.append((own, doc, s))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        if held:
            yield pd.DataFrame(solve(key, held), columns=["u", "v"], dtype="int64")

    return parts.mapInPandas(product, "u long, v long")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its n-gram set and the smallest id reachable by links.

    ``id_col`` must be a whole number. Texts without words, and null texts, have an empty set and link with nothing.
    Rows that share an id are one document in the link graph, with the links of all their texts; each row is returned with
    its own set size. A row without an id links with nothing and has a null component. An empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    with small_frames(docs.sparkSession):
        facts, found = _linked(rows, width, percent)
    out = facts.select("doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").cast(docs.schema[id_col].dataType).alias("component_id"))


def _linked(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Facts (doc, n, d1, d2) of every row (doc, text), and the components (node, component) of the links; all Python work is done on return."""
    none = np.zeros(0, np.int64), np.zeros(1, np.int32)

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, "text", 4_000_000):
            size, digests, held = [], [], {"own": [], "own_tag": [], "next": [], "next_tag": []}
            for t in frame["text"]:
                s = shingle_set(t, width)
                size.append(len(s))
                digests.append(set_digest(s))
                keys, tags = block_digests(s, percent) if len(s) else none
                first = int((tags == tags[0]).sum())
                for name, x in zip(held, (keys[:first], tags[0], keys[first:], tags[-1]), strict=True):
                    held[name].append(x)
            yield pd.DataFrame({"doc": frame["doc"].astype("Int64"), "n": size, "d1": [d for d, _ in digests], "d2": [d for _, d in digests], **held})

    keyed = stash(rows.mapInPandas(blocks, "doc long, n long, d1 long, d2 long, own array<long>, own_tag int, next array<long>, next_tag int"), "blocks")
    ties = stash(_ties(keyed.where(F.col("doc").isNotNull() & (F.col("n") > 0))), "ties")
    facts = stash(keyed.select("doc", "n", "d1", "d2"), "facts")
    discard(keyed)
    known = facts.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    families = components(ties, "u", "v").select(F.col("node").alias("doc"), F.col("component").alias("family"))
    # one row per distinct set of a family; texts are read again only where a family has several
    member = stash(known.join(families, "doc"), "members")
    heads = stash(member.groupBy("family", "d1", "d2").agg(F.min("doc").alias("head"), F.max("n").alias("n")), "heads")
    same = attach(member.drop("n"), heads.drop("n"), ["family", "d1", "d2"], F.col("doc"), "inner").select(F.col("doc").alias("u"), F.col("head").alias("v"))
    blocks_of = F.greatest(F.ceil(F.col("c") / ROW_BLOCK), F.ceil(F.col("total") / BLOCK_NGRAMS)).cast("int")
    several = heads.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1").select("family", blocks_of.alias("blocks"))
    wanted = stash(attach(heads.drop("n"), several, ["family"], F.col("head"), "inner").withColumnRenamed("head", "doc"), "wanted")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, "text", 4_000_000):
            found = [shingle_set(t, width) for t in frame["text"]]
            meant = [set_digest(s) == d for s, d in zip(found, zip(frame["d1"], frame["d2"], strict=True), strict=True)]
            out = frame[["family", "blocks", "doc"]].assign(shingles=[s.tobytes() for s in found])
            yield out[meant]

    id_hash = F.pmod(F.xxhash64("doc"), F.lit(ID_HASHES)).alias("h")
    near = rows.withColumn("h", id_hash).join(F.broadcast(wanted.select(id_hash).distinct()), "h", "left_semi").drop("h")
    texts = near.join(wanted, "doc").select("family", "blocks", "doc", "d1", "d2", "text")
    links = _row_block_links(texts.mapInPandas(sets, "family long, blocks int, doc long, shingles binary"), percent)
    return facts, components(same.unionByName(links), "u", "v")


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_number``, the same whenever it is read: by place in its files if it is read from Parquet files, else
    by place in a written copy."""
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return stash(docs.withColumn("_row_number", F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    index = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _index long")
    number = F.shiftleft("_index", 40).bitwiseOR(F.col("_at"))
    return placed.join(F.broadcast(index), "_file").select(*docs.columns, number.alias("_row_number"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows: that with the smallest id, a null id last, of equal ids any.

    Every row is decided on its own text: ids may repeat or be null. Rows without words all stay.
    """
    rows = numbered_rows(docs)
    found = stash(jaccard_components(rows, width, percent, "_row_number", text_col).select("_row_number", "component_id"), "groups")
    # only rows of groups of several are looked at; those that go are fewer than those that stay
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    member = attach(found, several, ["component_id"], F.col("_row_number"), "inner")
    ids = rows.select("_row_number", F.col(id_col).alias("_id"))
    member = stash(member.join(ids, "_row_number"), "members")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row_number"))
    kept = member.groupBy("component_id").agg(first.alias("f")).select("f._row_number")
    gone = member.select("_row_number").join(kept, "_row_number", "left_anti")
    return rows.join(gone, "_row_number", "left_anti").select(docs.columns)


@register("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
