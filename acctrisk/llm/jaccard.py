"""Texts whose shingle sets overlap, found with signature trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm import words
from acctrisk.llm.common import NO_ID, bitset, flush, groups, in_bitset, stored
from acctrisk.llm.components import components, roots

WIDTH, PERCENT = 5, 80
#: A shingle is common if it is in so many neighbouring texts with so many shingles together;
#: ``2**BITS`` bits remember the common ones.
COMMON, NEAR, BITS = 4, 1 << 20, 24
#: Sets of a leaf of a signature tree, children of a node, and sets of a tree.
LEAF, FANOUT, TREE = 16, 8, 512
#: Candidate pairs for each set of a tree that are verified at once.
FEW = 2

SETS = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64())])
POSTINGS = pa.schema([("token", pa.int64()), ("set_id", pa.int64())])
GROUPED = pa.schema([("token", pa.int64()), ("set_id", pa.int64()), ("sets", pa.int64()), ("members", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])


def _sets(batch: pa.RecordBatch, width: int, tables: tuple):
    """Row number and shingle set of every text of a batch that has words."""
    for i, own in enumerate(words.words_of(batch.column("text"), tables)):
        if len(own):
            yield i, words.shingles(own, width)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def common_shingles(docs: DataFrame, width: int = WIDTH) -> bytes:
    """The shingles that many neighbouring texts hold, as a bit set of fixed size. All texts are counted.

    They only come last in the order of :func:`prefix`; results are the same whatever it holds.
    """
    def count(batches):
        tables, own, size = words.powers(), [], 0
        for batch in batches:
            for _, tokens in _sets(batch, width, tables):
                own.append(tokens)
                size += len(tokens)
                if size >= NEAR:
                    yield often(own)
                    own, size = [], 0
        if own:
            yield often(own)

    def often(own):
        tokens, n = np.unique(np.concatenate(own), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n >= COMMON].view(np.int64))], names=["token"])

    return bitset(docs.select("text").mapInArrow(count, "token long"), "token", BITS)


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set, uncommon ones first, and which of them are common.

    Two sets that are similar enough share at least one token of their prefixes: the overlap is at
    least ``percent`` of the larger set, so that not all of the first ``size - overlap + 1`` can miss.
    """
    often = in_bitset(common, tokens)
    order = np.argsort(often, kind="stable")  # tokens ascend already
    first = order[:len(tokens) - -(-len(tokens) * percent // 100) + 1]
    return tokens[first], often[first]


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``set_id`` (equal sets have equal ones; missing without words) and ``size``; stored."""
    def sets(batches):
        tables = words.powers()
        for batch in batches:
            ids, sizes = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for i, own in _sets(batch, width, tables):
                ids[i], sizes[i] = set_id(own), len(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes)], schema=SETS)

    return stored(docs.mapInArrow(sets, "doc_id long, set_id long, size long"), "sets")


def postings(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """``token``, ``set_id`` and ``often`` for the prefixes of all sets."""
    def posts(batches):
        tables, held = words.powers(), np.frombuffer(common.value, np.uint64)
        out = [[], [], []]
        for batch in batches:
            seen = set()
            for _, own in _sets(batch, width, tables):
                sid = set_id(own)
                if sid in seen:
                    continue
                seen.add(sid)
                first, often = prefix(own, held, percent)
                for column, values in zip(out, (first.view(np.int64), np.full(len(first), sid), often)):
                    column.append(values)
                if sum(map(len, out[0])) > 1 << 16:
                    yield flush(out, schema)
        if out[0]:
            yield flush(out, schema)

    schema = pa.schema([*POSTINGS, ("often", pa.bool_())])
    return docs.mapInArrow(posts, "token long, set_id long, often boolean")


def _mark(ids: np.ndarray) -> np.ndarray:
    return words.mixed(ids.view(np.uint64))


def shared_tokens(batches):
    """Of postings sorted by token and set, those of tokens that two sets or more hold, once each.

    ``members`` tells groups apart by the sets in them. Postings of common tokens (with a ``part``)
    are only made distinct here: their sets are spread. A run may span batches: what is left of the
    last one is held until its end; uncommon tokens make short runs.
    """
    held = None
    out = [[], [], [], []]

    def emit(token, ids, often):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
        token, ids, often = token[new], ids[new], often[new]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(token)))
        members = np.add.reduceat(_mark(ids), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)
        sets = np.where(often, 0, np.repeat(lengths, lengths))
        for column, values in zip(out, (token, ids, sets, np.repeat(members, lengths))):
            column.append(values[sets != 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, ids, often = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "set_id", "often"))
        if held is not None:
            token, ids, often = (np.concatenate(x) for x in zip(held, (token, ids, often)))
        last = len(token) if often[-1] else int(np.searchsorted(token, token[-1]))
        held = token[last:], ids[last:], often[last:]
        emit(token[:last], ids[:last], often[:last])
        if out[0]:
            yield flush(out, GROUPED)
    if held is not None and len(held[0]):
        emit(*held)
        yield flush(out, GROUPED)


def token_groups(docs: DataFrame, sets: DataFrame, width: int, percent: int, common) -> DataFrame:
    """``token``, ``set_id``, ``size`` and ``sets`` of the groups of sets that share a prefix token; stored.

    Uncommon tokens are sorted and compared with their neighbours. Common ones can have very many
    sets: their postings are spread, and counted by Spark with partial sums. Groups with the same
    members are the same work, so one of them stays. In groups of one tree, sets without another of
    a similar size go.
    """
    schema = "token long, set_id long, sets long, members long"
    part = F.when(F.col("often"), F.pmod(F.xxhash64("set_id"), F.lit(64))).otherwise(-1)
    rows = postings(docs, width, percent, common).withColumn("part", part)
    found = stored(rows.repartition("part", "token").sortWithinPartitions("token", "set_id").mapInArrow(shared_tokens, schema), "groups")
    often = found.where("sets = 0").select("token", "set_id").distinct()
    sums = often.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("m"))
    sums = sums.where("sets > 1").select("token", "sets", F.xxhash64("m", F.lit("often")).alias("members"))
    found = stored(found.where("sets > 0").unionByName(often.join(sums, "token").select("token", "set_id", "sets", "members")), "groups")
    one = found.groupBy("members", "sets").agg(F.min("token").alias("token")).select("token").distinct()
    sizes = sets.where("set_id is not null").groupBy("set_id").agg(F.min("size").alias("size"))
    sized = found.join(one, "token").select("token", "set_id", "sets").join(sizes, "set_id")
    own = sized.where(F.col("sets") <= TREE)  # so that no window is large
    by_size = Window.partitionBy("token").orderBy("size", "set_id")
    less, more = F.lag("size").over(by_size), F.lead("size").over(by_size)
    near = F.coalesce(less * 100 >= F.col("size") * percent, F.lit(False)) | F.coalesce(F.col("size") * 100 >= more * percent, F.lit(False))
    own = own.withColumn("near", near).where("near").drop("near")
    return stored(own.unionByName(sized.where(F.col("sets") > TREE)), "groups")


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of a set's tokens, with two to four bits for each."""
    bits = max(256, 1 << int(2 * len(tokens) - 1).bit_length())
    held = np.zeros(bits, np.uint8)
    held[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def made_from(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int, make, kind: str) -> DataFrame:
    """``set_id`` and ``make`` of its tokens for the sets with a ``set_id`` in ``wanted``; stored.

    One text stands for a set. The texts are found by a bit set of their ids, so that none is
    shuffled. It lets a few others pass; a set may then be made by a second task, or not be wanted,
    which both change no result.
    """
    texts = (
        sets.join(wanted.select("set_id").distinct(), "set_id", "left_semi")
        .groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    )
    ids = docs.sparkSession.sparkContext.broadcast(bitset(texts.select(F.xxhash64("doc_id").alias("mark")), "mark", BITS))
    schema = pa.schema([("set_id", pa.int64()), (kind, pa.binary())])

    def rows(batches):
        tables, held, seen = words.powers(), np.frombuffer(ids.value, np.uint64), set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitset(held, batch.column("mark").to_numpy().view(np.uint64))))
            out, size = [], 0
            for _, own in _sets(batch, width, tables):
                sid = set_id(own)
                if sid not in seen:
                    seen.add(sid)
                    out.append((sid, make(own)))
                    size += len(out[-1][1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return stored(docs.withColumn("mark", F.xxhash64("doc_id")).mapInArrow(rows, f"set_id long, {kind} binary"), kind)


def enough(overlap, a, b, percent: int):
    """Whether an overlap of sets of these sizes (at most) reaches the threshold."""
    return 100 * overlap >= percent * (a + b - overlap)


class Tree:
    """A signature tree: every node has the OR of the bitmaps below it and the range of their sizes.

    ``excess`` is how many more tokens than bits a set below the node has at most: an overlap has no
    more tokens than common bits and excess.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        order = np.lexsort([*bitmaps[:, ::-1].T[:4], sizes])
        self.rows, self.sizes, self.bitmaps = order, sizes[order], bitmaps[order]
        self.excess = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        cuts, low, high, held, excess = np.arange(0, len(order), LEAF), self.sizes, self.sizes, self.bitmaps, self.excess
        self.levels = []  # leaves first; the columns of each: smallest and largest size, bitmap, excess
        while True:
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            held, excess = np.bitwise_or.reduceat(held, cuts, axis=0), np.maximum.reduceat(excess, cuts)
            self.levels.append((low, high, held, excess))
            if len(cuts) == 1:
                break
            cuts = np.arange(0, len(cuts), FANOUT)

    def at(self, level: int):
        return (self.sizes, self.sizes, self.bitmaps, self.excess) if level < 0 else self.levels[level]

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the parent in ``node`` and the child, for all children."""
        per, most = (LEAF, len(self.sizes)) if level == 0 else (FANOUT, len(self.levels[level - 1][0]))
        child = node[:, None] * per + np.arange(per)
        parent = np.repeat(np.arange(len(node)), per).reshape(child.shape)
        real = child < most
        return parent[real], child[real]


def may_overlap(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The largest possible overlap of node pairs, or 0 where it can't reach the threshold."""
    out = np.zeros(len(i), np.int64)
    for s in range(0, len(i), 4096):  # bounded memory
        x, y = i[s:s + 4096], j[s:s + 4096]
        bits = np.bitwise_count(a[2][x] & b[2][y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(a[1][x], b[1][y]), bits + np.minimum(a[3][x], b[3][y]))
        # Larger sets need more overlap: the smallest sizes that hold the overlap decide.
        ok = enough(most, np.maximum(a[0][x], most), np.maximum(b[0][y], most), percent)
        out[s:s + 4096] = np.where(ok, most, 0)
    return out


def dual_traversal(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two trees (or one tree twice) that may be similar, and their largest possible overlap."""
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        most = may_overlap(a.at(level_a), b.at(level_b), i, j, percent)
        i, j, most = i[most > 0], j[most > 0], most[most > 0]
        if level_a < 0 and level_b < 0:
            break
        if level_a >= level_b:  # open the higher nodes
            parent, i = a.children(level_a, i)
            j, level_a = j[parent], level_a - 1
        else:
            parent, j = b.children(level_b, j)
            i, level_b = i[parent], level_b - 1
        if a is b and level_a == level_b:
            i, j = i[i <= j], j[i <= j]
    if a is b:
        i, j, most = i[i < j], j[i < j], most[i < j]
    return a.rows[i], b.rows[j], most


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of fewer bits: a token's bit is its hash modulo their number."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, width), axis=1)


def candidates(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that may be similar, and an estimate of their similarity.

    There is a tree for each width of bitmaps. Widths grow with the sizes, so that only neighbouring
    widths can hold similar sets; the wider bitmaps are folded for that.
    """
    widths = np.array([len(b) for b in bitmaps])
    found, trees = [], {}
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        trees[int(width)] = rows, np.frombuffer(b"".join(bitmaps[r] for r in rows), np.uint64).reshape(len(rows), -1)
    for width, (rows, held) in trees.items():
        own = Tree(sizes[rows], held)
        i, j, most = dual_traversal(own, own, percent)
        found.append((rows[i], rows[j], most))
        if 2 * width in trees:
            wide, bits = trees[2 * width]
            i, j, most = dual_traversal(own, Tree(sizes[wide], _folded(bits, width // 8)), percent)
            found.append((rows[i], wide[j], most))
    i, j, most = (np.concatenate(x) for x in zip(*found))
    return i, j, most / (sizes[i] + sizes[j] - most)


def _spanning(i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Which pairs join all rows that the pairs join, by each part's best pair, again and again."""
    taken, label = np.zeros(len(i), bool), np.arange(n)
    while True:
        apart = np.flatnonzero(label[i] != label[j])
        if not len(apart):
            return taken
        ends = np.concatenate([label[i[apart]], label[j[apart]]])
        both, value = np.tile(apart, 2), np.tile(score[apart], 2)
        order = np.lexsort([both, -value, ends])
        best = both[order[np.append(True, ends[order][1:] != ends[order][:-1])]]
        taken[best] = True
        nodes, least = roots(label[i[best]], label[j[best]])
        join = np.arange(n)
        join[nodes] = least
        label = join[label]


def tree_pairs(grouped: DataFrame, signed: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``a``, ``b`` of sets by signature trees over every group, and ``open`` groups.

    Without ``labels``, a tree gives all its candidates if they are at most :data:`FEW` for each set.
    Else it gives those that span them, the most similar ones first, and the group stays open: a row
    with its token as ``a``. With labels, it gives all pairs across different labels. A group of more
    than :data:`TREE` sets has several trees, dealt anew for every token, and stays open; pairs across
    its trees are looked for only with labels.
    """
    rows = grouped.join(signed.select("set_id", "bitmap"), "set_id")
    rows = rows.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")) if labels is not None else rows.withColumn("label", F.col("set_id"))
    trees = F.ceil(F.col("sets") / TREE).cast("int")
    rows = rows.withColumns({"tree": F.pmod(F.xxhash64("set_id", "token"), trees).cast("int"), "trees": trees})
    if labels is None:
        rows = rows.withColumns({"x": F.col("tree"), "y": F.col("tree")})
    else:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), trees - 1))).withColumns(
            {"x": F.least("tree", "other"), "y": F.greatest("tree", "other")})
    keys = ["token", "x", "y"]
    dealt = rows.select(*keys, "tree", "trees", "set_id", "label", "size", "bitmap").repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "set_id")
    across = labels is not None

    def pairs(batches):
        out = [[], [], []]
        for run in groups(batches, keys):
            ids, tree, label = (run.column(c).to_numpy() for c in ("set_id", "tree", "label"))
            open_ = not across and run.column("trees")[0].as_py() > 1
            a = b = ids[:0]
            if len(ids) > 1 and not (across and (label == label[0]).all()):
                i, j, score = candidates(run.column("size").to_numpy(), run.column("bitmap").to_pylist(), percent)
                if across:
                    own = label[i] != label[j]
                    if run.column("x")[0] != run.column("y")[0]:
                        own &= tree[i] != tree[j]
                    i, j = i[own], j[own]
                elif len(i) > FEW * len(ids):
                    own, open_ = _spanning(i, j, score, len(ids)), True
                    i, j = i[own], j[own]
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            if open_:
                token = run.column("token").to_numpy()[:1]
                a, b = np.append(a, token), np.append(b, token)
            for column, values in zip(out, (a, b, np.arange(len(a)) == (len(a) - 1 if open_ else -1))):
                column.append(values)
            if sum(map(len, out[0])) > 1 << 16:
                yield flush(out, PAIRS)
        if out[0]:
            yield flush(out, PAIRS)

    return dealt.mapInArrow(pairs, "a long, b long, open boolean").distinct()


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by the tokens of the sets that are in a pair; stored."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))
    made = made_from(docs, sets, wanted, width, lambda tokens: tokens.tobytes(), "tokens")
    one = made.select(F.col("set_id").alias("a"), F.col("tokens").alias("one"))
    two = made.select(F.col("set_id").alias("b"), F.col("tokens").alias("two"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("one"), batch.column("two")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                keep.append(enough(int((both[1:] == both[:-1]).sum()), len(s), len(t), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.join(one, "a").join(two, "b").mapInArrow(check, "a long, b long"), "links")


def similar_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``.

    A text's words are its runs of non-blanks with ASCII letters in lower case; its set has the
    distinct shingles of ``width`` words, or its whole sequence if it has fewer. Texts without words,
    and missing ones, have an empty set and link with nothing. Two texts link when their intersection
    is at least ``percent`` per cent of their union; ``component_id`` is the smallest id that links
    reach. Rows with equal sets are one node; a missing id is an id below all others (and is reported
    as missing); other columns are ignored; an empty table gives an empty result. Shingles and sets
    are told apart by 64-bit hashes.

    Sets that share a token of their prefixes meet in a group, and trees over the group prune the
    pairs that can't be similar. Of groups with many candidates only spanning pairs are verified at
    first. Then only pairs across different components are left to look at in them, so that a large
    group of near copies, which is one component by then, costs no pair any more. No link between
    components is lost.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(own, width))
    sets = shingle_sets(own, width)
    grouped = token_groups(own, sets, width, percent, common)
    signed = made_from(own, sets, grouped, width, signature, "bitmap")
    found = stored(tree_pairs(grouped, signed, percent), "pairs")
    first = found.where("not open").select("a", "b")
    links = verified(first, own, sets, width, percent)
    labels = stored(components(links).select(F.col("node").alias("set_id"), F.col("component").alias("label")), "labels")
    left = grouped.join(found.where("open").select(F.col("a").alias("token")).distinct(), "token", "left_semi")
    label = F.coalesce("label", "set_id")
    mixed = left.join(labels, "set_id", "left").groupBy("token").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high")
    rest = tree_pairs(left.join(mixed.select("token"), "token", "left_semi"), signed, percent, labels).select("a", "b")
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, own, sets, width, percent))
    labels = components(links).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    rows = sets.join(labels, "set_id", "left").withColumn("group", F.coalesce("label", "set_id"))
    rows = stored(rows.select("doc_id", "size", "group"), "members")
    least = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(least, "group", "left").withColumn("least", F.coalesce("least", "doc_id")).select(
        named("doc_id").alias("doc_id"), F.col("size").alias("n_shingles"), named("least").alias("component_id"))


def drop_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows that repeat that id all stay. A row without id counts as one with an id of its own, below
    ``-2**62`` and made from its text: rows without id and of equal texts stay or go together.
    """
    own = F.coalesce(F.col(id).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2))
    numbered = docs.withColumn("__own", own)
    found = similar_texts(numbered, "__own", text, width, percent)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return numbered.join(gone.select(F.col("doc_id").alias("__gone")), F.col("__own") == F.col("__gone"), "left_anti").drop("__own")
