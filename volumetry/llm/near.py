"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles; bands of MinHash values find the rest.

A text is the set of its runs of ``WORDS`` words (fewer words are one run). Texts of one set collapse
first. Every set has a SimHash fingerprint of 64 bits, a bit being 1 if over half its hashes have it. ``simhash.links`` finds
the fingerprints of few differing bits over its index of byte positions; their sets link if their exact similarity is
``LEAST`` or more, and the classes made so go into what follows as one. ``BANDS`` keys of ``ROWS`` minima each list the sets: two sets of similarity s share a list with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.99997 at 0.8 and more above. A pair that shares a list is
a candidate, and links if its exact similarity is ``LEAST`` or more. The fingerprints alone are no index for
this: at 0.8 they differ in 9.7 bits on average and up to about 19, beyond the bits that ``simhash`` links.

Scale: a candidate pair moves its two texts once, to the task that compares them. Each list has one centre, and first every set is compared with the centre that it meets in most of its
lists, which joins the sets of a large group of copies. Lists that still hold several classes follow: their
rows of other classes than the centre's are compared with it, and in a list of up to ``FEW`` rows all pairs of different
classes are candidates; a longer one is cut into blocks of about ``BLOCK`` rows, every two blocks are compared
by sketches (a byte of each minimum) in one task, and each row names its ``TRIES`` likeliest partners of other
classes there, so a list of m rows gives m candidates times a small number and not m squared. A list in which a row
has more likely partners than that is gone through once more, whole: the sets of two blocks meet in one task, which compares
every likely pair of different classes exactly and gives back links only, so a set moves once for each block it meets and
not for each pair; a pair that shares several such lists is compared in one of them. Only sets in a
candidate pair or such a list are written and moved: bits of the hashes of their ids, of bounded size, are sent to the tasks that read
the texts, so what is shuffled for a comparison grows with the candidates and not with all texts.

Rules: a text without words, or null, is an empty set, and empty sets are equal. Case of ASCII letters
doesn't count. Null ids and repeated rows are as in ``simhash.one_each``. All columns of the input stay as
they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm import simhash
from volumetry.llm.batches import add_columns, unused
from volumetry.llm.graph import components
from volumetry.session import cut_lineage

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
SEED = 42
FEW = 16  # rows of a list that are paired inside one row
BLOCK = 2048  # rows of a list that one group takes from either side
TRIES = 4  # partners that a row names in a group; lists with more are compared whole
HELD = 1 << 20  # shingles of a list that one group takes from either side, when their sets are compared
LIKELY = 0.6  # share of equal bytes of two sketches from which on a pair is a candidate; 0.8 with 4 standard errors below
SLOTS = 1 << 24  # bits at most by which texts of no candidate pair are kept from being moved
SPARSE = 16  # slots for each side of a candidate pair
CHUNK = 4096  # shingles whose values are held for all minima at once
_draw = np.random.default_rng(SEED)
TIMES = _draw.integers(0, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
PLUS = _draw.integers(0, 2**63, BANDS * ROWS, dtype="u8")


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of words of a text in UTF-8, in order."""
    tokens = (data or b"").lower().split()  # both know ASCII letters and white space only
    if not tokens:
        return np.zeros(0, "u8")
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), "int64", len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist())], "u8"))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    low = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(found), CHUNK):
        low = np.minimum(low, (found[at:at + CHUNK, None] * TIMES + PLUS).min(axis=0))
    return low


def bands(low: np.ndarray) -> list[int]:
    """One key for each band of minima."""
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(np.ascontiguousarray(low.reshape(BANDS, ROWS)))]


def fingerprint(found: np.ndarray) -> int:
    """The signed SimHash of a set; zero of an empty one."""
    counts = np.zeros(64, "int64")
    for at in range(0, len(found), CHUNK):
        counts += np.unpackbits(found[at:at + CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<i8")[0])


def keyed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Adds the key of a text's set, its size, its fingerprint, its bands and its sketch (none of an empty set)."""
    def run(texts: list) -> list[pa.Array]:
        sets = [shingles(t) for t in texts]
        lows = [minima(s) if len(s) else None for s in sets]
        return [pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - 2**63 for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.array([[] if low is None else bands(low) for low in lows], pa.list_(pa.int64())),
                pa.array([None if low is None else (low >> np.uint64(32)).astype("u1").view("i8") for low in lows], pa.list_(pa.int64()))]

    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
              T.StructField("sketch", T.ArrayType(T.LongType()))]
    return add_columns(df, text, fields, run, keep, binary=True)


def alike(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs whose sketches have a share of ``LIKELY`` equal bytes or more."""
    side = lambda k, s: made.select(F.col("key").alias(k), F.col("sketch").alias(s))
    both = pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v")

    def different(x):
        for shift in (4, 2, 1):  # the lowest bit of a byte becomes one if any bit of it is
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with("_a", "_b", lambda a, b: different(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    return both.where(BANDS * ROWS - apart >= LIKELY * BANDS * ROWS).select("u", "v")


def sieved(texts: DataFrame, sides: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id and mark may be in ``sides`` (as ``i`` and ``m``): all that are, and about one of ``SPARSE``
    others while ``sides`` has up to ``SLOTS / SPARSE`` rows, more beyond. Sent to the tasks are bits of slots, no rows."""
    slots = min(SLOTS, max(64, SPARSE * sides.count()))
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(slots))
    place = lambda s: (F.shiftrightunsigned(s, 6).alias("_word"), s.bitwiseAND(63).cast("int").alias("_bit"))
    bits = sides.select(*place(slot("i", "m"))).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    told = texts.select("*", *place(slot("id", "mark"))).join(F.broadcast(bits), "_word")
    return told.where(F.getbit("_bits", "_bit") == 1).select(texts.columns)


def with_texts(sides: DataFrame, texts: DataFrame, made: DataFrame) -> DataFrame:
    """The rows of ``sides`` with the text of their ``key``. ``texts`` has ``id``, ``mark`` and ``text`` of all rows,
    which may repeat, ``made`` the ``_row`` of one of them for each key."""
    place = made.select("key", F.col("_row.id").alias("i"), F.col("_row.mark").alias("m"))
    sides = cut_lineage(sides.join(place, "key"), "sides")
    texts = sieved(texts, sides)
    return texts.join(sides, texts["id"].eqNullSafe(sides["i"]) & (texts["mark"] == sides["m"]))


def shared(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of ``LEAST`` or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= LEAST * (len(a) + len(b) - common)


def similar(pairs: DataFrame, texts: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of keys whose sets have a similarity of ``LEAST`` or more."""
    some = with_texts(pairs.select(F.explode(F.array("u", "v")).alias("key"), "u", "v"), texts, made)
    side = lambda k: F.min(F.when(F.col("key") == F.col(k), F.col("text")))  # noqa: E731 - rows may repeat
    both = some.groupBy("u", "v").agg(side("u").alias("a"), side("v").alias("b"))

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(*(batch.column(c).cast(pa.binary()) for c in ("a", "b"))):
                keep.append(shared(shingles(a.as_py()), shingles(b.as_py())))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(both.mapInArrow(run, "u long, v long"), "links")


def close(texts: DataFrame, made: DataFrame) -> DataFrame:
    """Links ``(u, v)`` by SimHash: every set is compared with the first of its own fingerprint, and these firsts with
    those of linked fingerprints."""
    firsts = made.where("n > 0").groupBy("fp").agg(F.min("key").alias("first"))
    firsts = cut_lineage(firsts, "fingerprints")
    same = made.join(firsts, "fp").where("key != first").select(F.least("key", "first").alias("u"), F.greatest("key", "first").alias("v"))
    end = lambda k: firsts.select(F.col("fp").alias(f"_{k}"), F.col("first").alias(k))
    tied = simhash.links(firsts.select("fp")).toDF("_a", "_b").join(end("a"), "_a").join(end("b"), "_b")
    tied = tied.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return similar(cut_lineage(same.union(tied).distinct(), "pairs"), texts, made)


class Group:
    """Rows of two blocks of a list: which of them may be similar."""

    def __init__(self, rows: pd.DataFrame):
        self.key, self.n, self.root = (rows[c].to_numpy(copy=True) for c in ("key", "n", "root"))
        self.data = np.stack(rows["sketch"].to_list()).astype("i8").view("u1")
        classes, index, sizes = np.unique(self.root, return_inverse=True, return_counts=True)
        self.outside = index != sizes.argmax()  # rows of the largest class are partners only, as a pair of two classes has a row outside it

    def partners(self, i: int) -> np.ndarray:
        """Rows of other classes that may be similar to row ``i``, the likeliest first."""
        other = np.flatnonzero((self.root != self.root[i]) & (np.minimum(self.n, self.n[i]) >= LEAST * np.maximum(self.n, self.n[i])))
        same = (self.data[other] == self.data[i]).sum(axis=1)
        ok = same >= LIKELY * BANDS * ROWS
        return other[ok][np.argsort(-same[ok], kind="stable")]


def likely(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs of a group: each row's likeliest partners of other classes. If a row has more of them than it
    names, a row that is ``cut`` gives the name of the list."""
    rows = rows.drop_duplicates("key")
    group, out, cut = Group(rows), [], False
    for i in np.flatnonzero(group.outside):
        found = group.partners(i)
        cut |= len(found) > TRIES
        out += [(min(group.key[i], group.key[j]), max(group.key[i], group.key[j]), False) for j in found[:TRIES].tolist()]
    if cut:
        out.append((rows["at"].iloc[0],) * 2 + (True,))
    return pd.DataFrame(out, columns=["u", "v", "cut"]).astype({"u": "int64", "v": "int64", "cut": "bool"})


def compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the similar rows of a group: every row is compared with its likely partners of other classes, a
    pair in the first list that both are in."""
    rows = rows.drop_duplicates("key")
    group, out = Group(rows), []
    at, apart = rows["at"].iloc[0], np.bool_(rows["i"].iloc[0] != rows["j"].iloc[0])
    block, lists = rows["b"].to_numpy(), np.stack(rows["lists"].to_list())
    lists = np.where(lists < at, lists, 0)
    sets = [np.frombuffer(x, "u8") for x in rows["found"]]
    sizes = np.array([len(x) for x in sets])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    sets, own = np.split(place, np.cumsum(sizes)[:-1]), np.zeros(len(names), bool)
    for i in np.flatnonzero(group.outside).tolist():
        other = group.partners(i)
        # two rows outside meet once, rows of one block in a group of that block alone
        other = other[((other > i) | ~group.outside[other]) & ((block[other] != block[i]) | ~apart)]
        other = other[~((lists[other] == lists[i]) & (lists[i] != 0)).any(axis=1)]
        if not len(other):
            continue
        own[sets[i]] = True
        common = np.add.reduceat(own[np.concatenate([sets[j] for j in other])].astype("int64"), np.cumsum(sizes[other]) - sizes[other])
        own[sets[i]] = False
        other = other[common >= LEAST * (sizes[i] + sizes[other] - common)]
        classes, first = np.unique(group.root[other], return_index=True)
        out += [(min(group.key[i], group.key[j]), max(group.key[i], group.key[j])) for j in other[first]]
        group.root[np.isin(group.root, classes)] = group.root[i]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def in_cells(rows: DataFrame) -> DataFrame:
    """The rows of lists cut into ``blocks``, once for every two blocks ``i`` and ``j`` that have theirs, ``b``."""
    cut = rows.withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return cells.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "blocks")


def candidates(open_: DataFrame, long: bool) -> DataFrame:
    """Pairs of keys of different classes that share a list with several; ``open_`` has ``at, key, n, root,
    sketch`` and the rows ``m`` of the list. For long lists, rows that are ``cut`` name the lists with more pairs."""
    if not long:
        rows = open_.where(F.col("m") <= FEW).groupBy("at").agg(F.sort_array(F.collect_set(F.struct("key", "n", "root"))).alias("rows"))
        near = lambda x, y: (x["root"] != y["root"]) & (F.least(x["n"], y["n"]) >= LEAST * F.greatest(x["n"], y["n"]))
        later = lambda x, i: F.filter(F.slice("rows", i + 2, FEW), lambda y: near(x, y))
        ties = F.flatten(F.transform("rows", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["key"].alias("u"), y["key"].alias("v")))))
        return rows.select(F.explode(ties).alias("l")).select("l.u", "l.v")
    cells = in_cells(open_.where(F.col("m") > FEW).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    cells = cells.select("at", "i", "j", "key", "n", "root", "sketch")
    return cells.groupBy("at", "i", "j").applyInPandas(likely, "u long, v long, cut boolean")


def whole(lists: DataFrame, texts: DataFrame, made: DataFrame) -> DataFrame:
    """Links that connect the similar keys of lists whose pairs are too many to be moved; ``lists`` has ``at, key, n, root``.
    The sets of two blocks meet in one task."""
    def run(found: list) -> list[pa.Array]:
        return [pa.array([shingles(t).tobytes() for t in found], pa.binary())]

    keys = lists.groupBy("key").agg(F.collect_set("at").alias("_in"))  # at most one of each band
    some = with_texts(keys.select("key"), texts, made).groupBy("key").agg(F.min("text").alias("text"))
    rows = add_columns(some, "text", [T.StructField("found", T.BinaryType())], run, ["key"], binary=True)
    own = F.transform("bands", lambda x: F.when(F.array_contains("_in", x), x).otherwise(0)).alias("lists")
    rows = rows.join(keys.join(made, "key").select("key", "sketch", own), "key")
    rows = cut_lineage(rows, "sets")
    sizes = lists.groupBy("at").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / HELD)).cast("int").alias("blocks"))
    cells = in_cells(lists.select("at", "key", "n", "root").join(sizes, "at")).join(rows, "key")
    return cut_lineage(cells.groupBy("at", "i", "j").applyInPandas(compared, "u long, v long"), "links")


def with_classes(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists with the class of their key."""
    return listed.select("at", "key", "n", "m").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def links(texts: DataFrame, made: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect the similar keys that share a list."""
    listed = made.select("key", "n", F.explode("bands").alias("at"))
    centres = listed.groupBy("at").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "n")).alias("c")).where("m > 1")
    listed = cut_lineage(listed.join(centres.select("at", "m", F.col("c.key").alias("c"), F.col("c.n").alias("cn")), "at"), "lists")
    near = F.least("n", "cn") >= LEAST * F.greatest("n", "cn")
    pair = [F.least("key", "c").alias("u"), F.greatest("key", "c").alias("v")]
    stars = cut_lineage(listed.where("key != c").where(near).groupBy("key", "c").agg(F.count(F.lit(1)).alias("lists")), "stars")
    near_links = close(texts, made)
    early = cut_lineage(components(near_links), "classes")
    early = early.select(F.col("node").alias("key"), "root"), early.select(F.col("node").alias("c"), F.col("root").alias("other"))
    # sets that SimHash has put into one class need no second comparison
    tried = stars.join(early[0], "key", "left").join(early[1], "c", "left").where(F.coalesce("root", "key") != F.coalesce("other", "c"))
    tried = tried.groupBy("key").agg(F.max(F.struct("lists", "c")).alias("best")).select("key", "best.c").select(*pair).distinct()
    tried = cut_lineage(tried, "pairs")
    found = near_links.union(similar(alike(tried, made), texts, made))
    roots = cut_lineage(components(found), "classes").withColumnsRenamed({"node": "key"})
    classed = cut_lineage(with_classes(listed, roots), "classed")
    mixed = classed.groupBy("at").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("at")
    open_ = classed.join(mixed, "at")
    named = cut_lineage(candidates(open_.join(made.select("key", "sketch"), "key"), True), "named")
    centres = roots.select(F.col("key").alias("c"), F.col("root").alias("other"))
    apart = stars.join(roots, "key", "left").join(centres, "c", "left").where(F.coalesce("root", "key") != F.coalesce("other", "c")).select(*pair)
    new = named.where("not cut").select("u", "v").union(candidates(open_, False)).union(apart)
    new = cut_lineage(new.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    found = found.union(similar(alike(new, made), texts, made))
    # rows of these lists have likely partners that they did not name
    more = cut_lineage(named.where("cut").select(F.col("u").alias("at")).distinct(), "cut")
    if more.isEmpty():
        return found
    roots = cut_lineage(components(found), "classes").withColumnsRenamed({"node": "key"})
    return found.union(whole(cut_lineage(with_classes(listed.join(more, "at"), roots), "classed"), texts, made))


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, chosen as by ``simhash.one_each``: the smallest id,
    then the smallest hash of the text. Columns and their order stay."""
    mark = unused(docs, "mark")
    named = docs.withColumn(mark, F.coalesce(F.xxhash64(text), F.lit(0)))
    row = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(mark).alias("mark"))
    made = cut_lineage(keyed(named.select(row.alias("_row"), F.col(text).alias("_text")), "_text", ["_row"]), "shingles")
    firsts = made.groupBy("key").agg(F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch")))
    firsts = cut_lineage(firsts, "sets")
    found = components(links(named.select(F.col(doc_id).alias("id"), F.col(mark).alias("mark"), F.col(text).alias("text")), firsts))
    classed = firsts.join(found.withColumnsRenamed({"node": "key"}), "key", "left").select("_row", F.coalesce("root", "key").alias("root"))
    chosen = classed.groupBy("root").agg(F.min("_row").alias("_row")).select("_row")
    twice = made.groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    chosen = cut_lineage(chosen.join(twice, "_row").select(F.col("_row.id").alias("_id"), F.col("_row.mark").alias("_of"), (F.col("copies") > 1).alias("_twice")), "chosen")
    same = lambda part: named[doc_id].eqNullSafe(part["_id"]) & (named[mark] == part["_of"])
    once, more = chosen.where("not _twice"), chosen.where("_twice")
    # only rows that are there several times are moved to be one
    return named.join(once, same(once), "left_semi").select(docs.columns).unionByName(
        named.join(more, same(more), "left_semi").dropDuplicates([doc_id, mark]).select(docs.columns))
