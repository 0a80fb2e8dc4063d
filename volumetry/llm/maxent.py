"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words are white-space tokens, A-Z in lower case; every text ends with one more token. A token's
probability is that of its class given the words before it times that of the token in its class.

Known words and buckets grow with the root of the number of training tokens (``sizes``); ``KNOWN`` and ``BITS`` are the
least. Classes: ``CLASSES`` groups of the known words (the commonest, of a count of ``LEAST`` or more), by the common words they follow (k-means on
counts), and one for all other words. The class has a softmax over hashed features: the word before,
the one before that (a skip), and both together. Weights are trained by gradient steps in shards over
all their training texts, then averaged over the shards by their tokens (``ROUNDS`` times). Shards and the order in them go by
hashes of the rows and the number of tokens, so files and partitions of the input don't change the model. Inside a class,
the words are leaves of a tree of ``FAN`` children a node (Huffman's, so common words are near its root), and every node has a
softmax of its own over its children, trained in the same steps: hashed features of the node with the word before and
with the class before, and a weight for each child, which starts at the child's share. Other words share the mass of their
class by count plus one half; one more share is for all words never seen.

The probabilities of all words add up to one for every context.

Scale: all counts and gradients cover every training text and are summed up by shuffles. Training texts are cut into words
once and stored as numbers. Sent to the tasks are the known words and the weights (buckets x classes), which grow with the root of
the corpus; a shard has 64 tokens a bucket or more, so the gradients that are shuffled grow in proportion to the corpus. Other words
are looked up by a join, after each text has added up its own. Classes and contexts are the shape of the model, no limit on words.

Rules: null is an empty text, which has the end token only. Rows that agree in id and text get the same
result, each its own row. Without training texts every count is 0 and the model is uniform.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetry.llm.batches import pieces
from volumetry.session import cut_lineage

KNOWN = 65_536  # known words at least, if there are as many
WORDS_A_ROOT = 8  # known words for each unit of the root of the training tokens
LEAST = 3  # count of a known word at least; rarer ones show what unseen words look like
CLASSES = 15
FAN = CLASSES + 1  # children of a node of a tree of words
CONTEXTS = 24  # commonest words that tell classes apart
BITS = 14  # of a bucket's number, at least
TREE_BITS = 1  # more than that for features of the nodes of trees
BUCKETS_A_ROOT = 2
SHARD = 2_000_000  # training tokens of a shard, at least
ROUNDS = 1
BATCH = 8192
SAFE = 60.0  # logits up to this have sums of exponentials that float32 holds in full, and so have rows whose sum is above exp of minus that
SHORT = 8  # tokens that share a row of weights up to which reduceat adds one after the other
RATE = 0.5
WORD_RATE = 2.0  # times that for the nodes of trees
WORD_POWER = 0.75  # of the tokens of a batch that share a row of theirs, which its step is divided by
OTHER = 0  # class of all other words
TAILS = 251  # kinds of other words as features, by their last two bytes
HELD_WORDS = 300_000  # distinct words that a task counts before it sends them on
TEXT_BYTES = 2 << 20  # of the texts whose tokens a task holds at once
ROWS = 1024  # rows of weights that are sent as one value
CELLS = 1 << 22  # counts that a task holds at once
LINE = 64  # bytes of a cache line
END = b""


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Where each text begins among the tokens of all, their places among the different words, and those words."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # ASCII letters and white space only
    blank = pc.equal(text, "")
    found = pc.ascii_split_whitespace(pc.if_else(blank, text, pc.binary_join_element_wise(text, "", " ")))  # what is behind the last blank is END
    coded = found.flatten().dictionary_encode()
    return found.offsets.to_numpy()[:-1].astype("int64"), coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())


def sizes(n: int) -> tuple[int, int]:
    """Known words at most, and bits of a bucket's number, for ``n`` training tokens."""
    root = math.sqrt(max(n, 1))
    return max(KNOWN, math.ceil(WORDS_A_ROOT * root)), max(BITS, math.ceil(math.log2(BUCKETS_A_ROOT * root)))


def softmax_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shift, the exponentials of what is above it and their sum for each row. Values that float32 takes as they are need
    no shift; else it is the largest of the row. Rows are short, so halves are folded."""
    if x.size and x.max() < SAFE:
        e = np.exp(x)
        total = e @ np.ones(x.shape[1], x.dtype)
        if total.min() > np.exp(-SAFE):
            return np.zeros(len(x), x.dtype), e, total
    top = x
    while top.shape[1] > 1:
        half = (top.shape[1] + 1) // 2
        top = np.maximum(top[:, :half], top[:, -half:])
    e = np.exp(x - top)
    return top[:, 0], e, e @ np.ones(x.shape[1], x.dtype)


def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one column."""
    top, _, total = softmax_parts(x)
    return x[np.arange(len(x)), at] - top - np.log(total)


@dataclass
class Model:
    ids: dict[bytes, int]  # known words from 1 on; 0 and words from len + 1 on are other words
    classes: np.ndarray  # class of each id
    counts: np.ndarray  # count of each known id
    n: int
    v: int
    other_n: int
    other_v: int
    bits: int
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    route: np.ndarray | None = None  # level x id: node on the way to the id, -1 beyond its last
    turn: np.ndarray | None = None  # level x id: child to take there
    tree: np.ndarray | None = None  # buckets of node features, then nodes, x children

    def numbers(self, words: list[bytes] | pa.BinaryArray) -> np.ndarray:
        """Ids; an other word becomes a number by its last bytes, above all ids."""
        words = pa.array(words, pa.binary())
        out = np.fromiter(map(self.ids.get, listed(words), repeat(0)), "int64", len(words))
        return np.where(out == 0, last_bytes(words) % TAILS + len(self.ids) + 1, out)

    def classed(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids <= len(self.ids), self.classes[np.minimum(ids, len(self.ids))], OTHER)

    def features(self, ids: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Buckets of the features before each token; texts begin at ``begins``."""
        one, two = np.zeros_like(ids), np.zeros_like(ids)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[begins] = two[begins] = 0
        later = begins[begins + 1 < len(ids)] + 1
        two[later] = 0
        one, two = one.astype("uint32"), two.astype("uint32")
        return [mix(one, 1, self.bits), mix(two, 2, self.bits), mix(one * 70_001 + two, 3, self.bits)]

    @staticmethod
    def before(classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = np.empty_like(classes)
        out[1:] = classes[:-1]
        out[begins] = OTHER
        return out

    def logits(self, features: list[np.ndarray]) -> np.ndarray:
        return self.bias + summed(self.weights, features)

    def ways(self, ids: np.ndarray, one: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The nodes passed on the way to known ids in their trees: places of their tokens, rows of ``tree`` and the
        children taken. ``one`` and ``group`` are the id and the class before each token."""
        at = np.flatnonzero(ids <= len(self.ids))
        passed = [(at[:0], np.zeros(0, "int32"), np.zeros(0, "int8"))]
        for route, turn in zip(self.route, self.turn):  # a way that has ended has no later level
            node = route.take(ids[at])
            going = node >= 0
            at = at[going]
            passed.append((at, node[going], turn.take(ids[at])))
        at, node, turn = map(np.concatenate, zip(*passed))
        bits, short = self.bits + TREE_BITS, node.astype("uint32")  # a bucket is made of the last 32 bits
        rows = [mix(short * 1_000_003 + one.astype("uint32")[at], 4, bits), mix(short * FAN + group.astype("uint32")[at], 5, bits),
                (1 << bits) + node.astype("int64")]
        return at, rows, turn

    @property
    def inside(self) -> np.ndarray:
        """Class before x id: log probability within the class, with no word known before. To look at; scores don't need it."""
        ids = np.arange(len(self.ids) + 1)
        out = np.zeros((CLASSES + 1, len(ids)), "float32")
        for g in range(CLASSES + 1):
            at, rows, turn = self.ways(ids, np.zeros_like(ids), np.full_like(ids, g))
            if len(at):
                out[g] = np.bincount(at, log_share(summed(self.tree, rows), turn), len(ids))
        return out

    def learn(self, features: list[np.ndarray], target: np.ndarray, rate: float) -> None:
        """One gradient step on the classes of a batch."""
        grad = self.bias + summed(self.weights, features)
        self.bias -= rate * descent(self.weights, features, grad, target, rate).mean(axis=0)

    def learn_words(self, rows: list[np.ndarray], turn: np.ndarray, rate: float) -> None:
        """One gradient step on the nodes that a batch passes."""
        if len(turn):
            descent(self.tree, rows, summed(self.tree, rows), turn, rate, WORD_POWER)


def mix(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of 32-bit numbers, whose products keep their last 32 bits."""
    return (x * 0x9E3779B1 + (salt * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - bits)).astype("int64")


def summed(table: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    out = table.take(features[0], axis=0)
    for f in features[1:]:
        out += table.take(f, axis=0)
    return out


def whole_rows(table: np.ndarray) -> np.ndarray:
    """Each row of a table as one value, which is copied at once."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1])))[:, 0]


def rows_at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return whole_rows(table).take(at).view(table.dtype).reshape(-1, table.shape[1])


def lined_up(table: np.ndarray) -> np.ndarray:
    """A copy that begins at a cache line, so that a row of sixteen floats is in one line instead of two."""
    raw = np.empty(table.nbytes + LINE, "u1")
    start = -raw.ctypes.data % LINE
    out = raw[start:start + table.nbytes].view(table.dtype).reshape(table.shape)
    out[...] = table
    return out


def move(table: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Takes ``by`` from rows that are all different, as many at a time as caches hold."""
    rows = whole_rows(table)
    for start in range(0, len(at), ROWS):
        some = at[start:start + ROWS]
        new = rows_at(table, some)
        new -= by[start:start + ROWS]
        rows[some] = whole_rows(new)


def segment_sums(grad: np.ndarray, by: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``by`` of each segment and the order of the segments they come in. Short segments are added up
    row by row for all of them at once, in the order of ``reduceat``, which goes through the others."""
    kind = np.minimum(sizes, SHORT + 1).astype("u1")
    order = np.argsort(kind, kind="stable")
    several, *ends = np.searchsorted(kind[order], np.arange(2, SHORT + 2)).tolist()
    short = cuts[order[:ends[-1]]]
    total = rows_at(grad, by[short])
    rest = rows_at(grad, by[short[several:] + 1])
    for k, start in enumerate(ends[:-1], 2):
        rest[start - several:] += rows_at(grad, by[short[start:] + k])
    total[several:] += rest
    if ends[-1] < len(order):
        long = sizes[order[ends[-1]:]]
        more = np.add.reduceat(rows_at(grad, by[np.repeat(sizes > SHORT, sizes)]), np.cumsum(long) - long, axis=0)
        total = np.concatenate([total, more])
    return total, order


def in_order(f: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``top`` in their order and the place of each, equal ones by place: number and place are sorted as one."""
    low = (len(f) - 1).bit_length()
    kind = np.uint32 if low + (top - 1).bit_length() <= 32 else np.uint64
    key = f.astype(kind) << kind(low) | np.arange(len(f), dtype=kind)
    key.sort()
    return key >> kind(low), (key & kind((1 << low) - 1)).astype("int64")


def descent(table: np.ndarray, features: list[np.ndarray], logits: np.ndarray, target: np.ndarray, rate: float, power: float = 0.5) -> np.ndarray:
    """Moves the rows that are features of a batch against their gradient, which comes back for each token."""
    _, grad, total = softmax_parts(logits)
    grad /= total[:, None]
    grad.ravel()[np.arange(0, grad.size, grad.shape[1]) + target] -= 1
    for f in features:
        at, by = in_order(f, len(table))
        new = np.ones(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=new[1:-1])
        cuts = np.flatnonzero(new)
        cuts, sizes = cuts[:-1], np.diff(cuts)
        total, order = segment_sums(grad, by, cuts, sizes)
        move(table, at[cuts[order]].astype("int64"), total * (rate / 4 / sizes[order] ** power).astype(grad.dtype)[:, None])
    return grad


def trees(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``route`` and ``turn`` of a model, and log shares of the children of every node (far below all for none)."""
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    shares: list[np.ndarray] = []
    nodes = 0
    for g in range(1, CLASSES + 1):
        mine = np.flatnonzero(classes == g)
        mine = mine[mine > 0]
        if len(mine) < 2:
            continue
        mass = (counts[mine] + 0.5).tolist()
        heap = [(m, i) for i, m in enumerate(mass)]
        heapq.heapify(heap)
        parent, place = [0] * len(mass), [0] * len(mass)
        take = (len(mass) - 2) % (FAN - 1) + 2  # the first node takes what leaves all others full
        while len(heap) > 1:
            inner = len(mass)
            total = 0.0
            for k in range(take):
                m, item = heapq.heappop(heap)
                parent[item], place[item] = inner, k
                total += m
            mass.append(total)
            parent.append(inner)
            place.append(0)
            heapq.heappush(heap, (total, inner))
            take = FAN
        up, child, root = np.array(parent), np.array(place), len(mass) - 1
        depth = np.zeros(len(mass), "int64")
        for item in range(root - 1, len(mine) - 1, -1):  # a node is made before its parent
            depth[item] = depth[up[item]] + 1
        own = np.full((len(mass) - len(mine), FAN), -1e9)
        own[up[:root] - len(mine), child[:root]] = np.log(np.array(mass[:root]) / np.array(mass)[up[:root]])
        shares.append(own)
        item, word = np.arange(len(mine)), mine
        while len(item):
            levels.append((depth[up[item]], word, up[item] - len(mine) + nodes, child[item]))
            item, word = up[item][up[item] != root], word[up[item] != root]
        nodes += len(own)
    top = 1 + max((int(level[0].max()) for level in levels), default=-1)
    route, turn = np.full((top, len(classes)), -1, "int32"), np.zeros((top, len(classes)), "int8")
    for level, word, node, child in levels:
        route[level, word], turn[level, word] = node, child
    return route, turn, np.vstack(shares) if shares else np.zeros((0, FAN))


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.BinaryArray]]:
    for batch in batches:
        for piece in pieces(batch, "text", TEXT_BYTES):
            yield piece, *tokens(piece.column("text"))


def listed(words: pa.BinaryArray) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def last_bytes(words: pa.BinaryArray) -> np.ndarray:
    """The last two bytes of each word as a number."""
    padded = pc.binary_join_element_wise(b"\0\0", words, b"").buffers()
    ends, raw = np.frombuffer(padded[1], "<i4")[1:len(words) + 1], np.frombuffer(padded[2], "u1").astype("int64")
    return raw[ends - 2] * 256 + raw[ends - 1]


def tallied(of: np.ndarray, codes: np.ndarray, words: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """The different words of every text and how often each is there, from the text and the word of each token."""
    key, n = np.unique(of * len(words) + codes, return_counts=True)
    return key // len(words), words.take(pa.array(key % len(words))), n


def unknown(known: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The places of other words in each text."""
    at = np.flatnonzero(~known)
    cuts = np.searchsorted(at, begins)
    return [at[a:b] - begin for a, b, begin in zip(cuts, [*cuts[1:], len(at)], begins)]


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)`` over all training texts; stored."""
    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for _, _, codes, words in texts(batches):
            for word, c in zip(listed(words), np.bincount(codes).tolist()):
                held[word] += c
            if len(held) > HELD_WORDS:
                yield out()
                held = Counter()
        yield out()

    counted = train.select("text").mapInArrow(run, "word binary, c long")
    return cut_lineage(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")


def clusters(follow: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Groups rows by their shares of the columns, k-means from spread starting rows."""
    share = np.sqrt((follow + 0.1) / (follow + 0.1).sum(axis=1, keepdims=True))
    start = [0]
    for _ in range(min(k, len(share)) - 1):
        near = np.max(share[:2048] @ share[start].T, axis=1)
        start.append(int(np.argmin(near)))
    centre = share[start]
    for _ in range(12):
        group = np.argmax(share @ centre.T, axis=1)
        for g in range(len(centre)):
            mine = group == g
            if mine.any():
                c = (share[mine] * weight[mine, None]).sum(axis=0)
                centre[g] = c / np.linalg.norm(c)
    return np.argmax(share @ centre.T, axis=1)


def numbered(train: DataFrame, model: Model) -> DataFrame:
    """``(mark, ids)`` of every training text: a hash of the row and the numbers of its tokens; stored."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece, begins, codes, words in texts(batches):
            ids = sent.value.numbers(words)[codes]
            ends = np.append(begins[1:], len(ids)) * 4
            raw = ids.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([piece.column("mark"), pa.array([raw[a:b] for a, b in zip((begins * 4).tolist(), ends.tolist())], pa.binary())],
                                             names=["mark", "ids"])

    marked = train.select(F.xxhash64(*(c for c in train.columns if c in ("doc_id", "text"))).alias("mark"), "text")
    out = cut_lineage(marked.mapInArrow(run, "mark long, ids binary"), "numbered")
    sent.unpersist()
    return out


def stored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the texts of a batch and where each begins, in pieces."""
    for piece in pieces(batch, "ids", 2 * TEXT_BYTES):
        raw = piece.column("ids").to_pylist()
        yield np.frombuffer(b"".join(raw), "<i4").astype("int64"), np.cumsum([0, *(len(r) // 4 for r in raw[:-1])])


def prepare(train: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """Known words, their classes and the totals; and the numbered training texts."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word")).first()
    known, bits = sizes(n)
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "word").limit(known).toArrow().to_pydict()  # the root of the corpus
    words, c = top["word"], np.array(top["c"], "float64")
    ids = {w: i for i, w in enumerate(words, 1)}
    model = Model(ids, np.zeros(len(words) + 1, "int64"), np.append(0.0, c), int(n), int(v), int(n - c.sum()), int(v - len(words)), bits,
                  np.zeros((1 << bits, CLASSES + 1), "float32"), np.zeros(CLASSES + 1, "float32"))
    rows = numbered(train, model)
    if len(words):
        follow = np.zeros((len(words) + 1, CONTEXTS + 1))
        at, k = pairs(rows, model)
        follow.ravel()[at] = k
        model.classes[1:] = 1 + clusters(follow[1:], np.sqrt(c), CLASSES)
    mass = np.bincount(model.classes[1:], weights=c, minlength=CLASSES + 1)
    mass[OTHER] += model.other_n
    model.bias = np.log((mass + 1) / (mass + 1).sum()).astype("float32")
    model.route, model.turn, shares = trees(model.classes, model.counts)
    model.tree = np.vstack([np.zeros((1 << bits + TREE_BITS, FAN)), shares]).astype("float32")
    return model, rows


def pairs(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (known word, common word before it) over all numbered training texts, as places and counts; at most
    the known words x ``CONTEXTS`` numbers."""
    width = len(model.ids) + 1

    def run(batches):
        cells = width * (CONTEXTS + 1)
        total, held, waiting = np.zeros(cells if cells <= CELLS else 0, "int64"), [], 0

        def out(at, n):
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

        for batch in batches:
            for ids, begins in stored(batch):
                one = Model.before(np.where(ids <= CONTEXTS, ids, 0), begins)
                places = (ids * (CONTEXTS + 1) + one)[ids < width]
                if len(total):
                    total += np.bincount(places, minlength=cells)
                    continue
                held.append(places)
                waiting += len(places)
                if waiting > CELLS:  # more cells than a task holds: counts of the places met so far
                    yield out(*np.unique(np.concatenate(held), return_counts=True))
                    held, waiting = [], 0
        at = np.flatnonzero(total)
        yield out(at, total[at])
        if held:
            yield out(*np.unique(np.concatenate(held), return_counts=True))

    found = rows.select("ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return found.column("at").to_numpy(), found.column("n").to_numpy()


def descend(rows: DataFrame, model: Model, rounds: int) -> None:
    """Gradient steps in every shard from the same weights, then one average by tokens."""
    shards = max(1, model.n // max(SHARD, 64 << model.bits))
    dealt = rows.select(F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int").alias("shard"), "mark", "ids")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "mark", "ids")
    for number in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches, number=number, sent=sent):
            old = sent.value
            own, seen, shard = None, 0, None

            def out():
                moved = np.vstack([own.weights - old.weights, own.bias - old.bias, own.tree - old.tree])
                for at in range(0, len(moved), ROWS):
                    if moved[at:at + ROWS].any():
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([shard], pa.int32()), pa.array([seen], pa.int64()),
                                                          pa.array([moved[at:at + ROWS].tobytes()], pa.binary())], names=["at", "shard", "seen", "moved"])

            for batch in batches:
                names = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if shard != names[a]:  # a task may hold several shards, one after the other
                        if own is not None:
                            yield from out()
                        own, seen, shard = Model(**{**vars(old), "weights": lined_up(old.weights), "bias": old.bias.copy(), "tree": lined_up(old.tree)}), 0, names[a]
                    for ids, begins in stored(batch.slice(a, b - a)):
                        target, features = own.classed(ids), own.features(ids, begins)
                        one, group = own.before(ids, begins), own.before(target, begins)
                        for start in range(0, len(ids), BATCH):
                            part = slice(start, start + BATCH)
                            rate = RATE / (1 + number) / (1 + seen / 2e6) ** 0.5
                            own.learn([f[part] for f in features], target[part], rate)
                            _, ways, turn = own.ways(ids[part], one[part], group[part])
                            own.learn_words(ways, turn, WORD_RATE * rate)
                            seen += len(target[part])
            if own is not None:
                yield from out()

        moved = dealt.mapInArrow(run, "at long, shard int, seen long, moved binary")
        found = moved.groupBy("at").applyInArrow(averaged, "at long, step binary").toArrow()  # the weights once
        sent.unpersist()
        whole = np.vstack([model.weights, model.bias, model.tree])
        for at, step in zip(found.column("at").to_pylist(), found.column("step").to_pylist()):
            whole[at:at + ROWS] += np.frombuffer(step, "<f4").reshape(-1, CLASSES + 1)
        n = len(model.weights)
        model.weights, model.bias, model.tree = whole[:n], whole[n], whole[n + 1:]


def averaged(rows: pa.Table) -> pa.Table:
    """The steps of ``ROWS`` rows of weights, each averaged over the shards that moved it."""
    total, weight = 0.0, 0.0
    for i in np.argsort(rows.column("shard").to_numpy(), kind="stable").tolist():
        step, seen = np.frombuffer(rows.column("moved")[i].as_py(), "<f4").reshape(-1, CLASSES + 1).astype("float64"), rows.column("seen")[i].as_py()
        total, weight = total + step * seen, weight + step.any(axis=1) * float(seen)
    step = (total / np.where(weight > 0, weight, 1.0)[:, None]).astype("<f4")
    return pa.table({"at": rows.column("at").slice(0, 1), "step": pa.array([step.tobytes()], pa.binary())})


def train_model(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    model, rows = prepare(train, counts)
    if model.n:
        descend(rows, model, rounds)
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_tokens, n_known, base_score, score`` of ``(doc_id, text)`` rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n, v = model.n, model.v
    other = np.log(model.other_n + 0.5 * (model.other_v + 1))
    ln10 = float(np.log(10))
    # empty classes have no words: their share of the softmax goes to the others
    empty = [g for g in range(1, CLASSES + 1) if not (model.classes[1:] == g).any()]
    keys = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), F.col("text"))

    def run(batches):
        m = sent.value
        width = len(m.ids) + 1
        for piece, begins, codes, words in texts(batches):
            ids = m.numbers(words)[codes]
            classes, features = m.classed(ids), m.features(ids, begins)
            one, group = m.before(ids, begins), m.before(classes, begins)
            known = ids < width
            value = np.empty(len(ids))
            for start in range(0, len(ids), BATCH):
                part = slice(start, start + BATCH)
                logits = m.logits([f[part] for f in features])
                logits[:, empty] = -np.inf
                value[part] = log_share(logits, classes[part])
                at, ways, turn = m.ways(ids[part], one[part], group[part])
                if len(at):
                    value[part] += np.bincount(at, log_share(summed(m.tree, ways), turn), len(ids[part]))
            # an other word's own share, (c + 1/2) over the mass of its class, is added where its count is joined
            value[~known] -= other
            base = np.where(known, np.log10(m.counts[np.where(known, ids, 0)] + 0.5), 0.0)
            doc_score, doc_base = np.add.reduceat(value, begins) / ln10, np.add.reduceat(base, begins)
            sizes = np.diff(np.append(begins, len(ids)))
            doc_known = np.add.reduceat(known.astype("int64"), begins)
            of = np.repeat(np.arange(len(begins)), list(map(len, unknown(known, begins))))
            of, others, tf = tallied(of, codes[~known], words)
            columns = [piece.column(c) for c in ("doc_id", "text_hash")]
            totals = [pa.array(sizes, pa.int64()), pa.array(doc_known, pa.int64()), pa.array(doc_base, pa.float64()), pa.array(doc_score, pa.float64())]
            columns = [pa.concat_arrays([c.take(pa.array(of)), c]) for c in columns]
            columns += [pa.concat_arrays([others, pa.nulls(len(begins), pa.binary())]), pa.array(np.append(tf, np.zeros(len(begins), "int64")))]
            columns += [pa.concat_arrays([pa.nulls(len(of), c.type), c]) for c in totals]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "word", "tf", "n_tokens", "known", "base", "model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, word binary, tf long, n_tokens long, known long, base double, model double"
    # one row for each other word of a text, beside one row of its totals under a name that is no word
    name = F.encode(F.concat(F.lit(" "), F.col("text_hash").cast("string"), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")
    rows = keys.mapInArrow(run, schema).withColumn("word", F.coalesce("word", name))
    # no other word is commoner than the rarest known one; a known word among them does no harm
    rare = counts.where(F.col("c") <= float(model.counts[-1])) if model.ids else counts
    met = rows.join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.col("tf") * F.log10(F.col("c") + 0.5)
    whole = met.groupBy("doc_id", "text_hash").agg(
        F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("_rows"), F.max("known").alias("known"), F.max("base").alias("base"),
        F.max("model").alias("model"), F.sum(share).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare"))
    # rows that agree in id and text were added up together
    scale = F.log10(F.lit(n + 0.5 * (v + 1)))
    rest = F.col("rest") / F.col("_rows")
    return whole.select(
        "doc_id", "text_hash", "n_tokens", (F.col("known") + (F.col("rare") / F.col("_rows")).cast("long")).alias("n_known"),
        (F.col("base") + rest - F.col("n_tokens") * scale).alias("base_score"), (F.col("model") + rest).alias("score"),
        F.explode_outer(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy")).drop("_copy")


def fit_and_score(train: DataFrame, docs: DataFrame) -> tuple[Model, DataFrame]:
    counts = word_counts(train)
    model = train_model(train, counts)
    return model, score(docs, model, counts)
