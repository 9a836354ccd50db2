"""Phrases whose words stand together more often than their parts let expect."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm import runs
from acctrisk.llm.automata import Automaton, composed, prefix_sums, united
from acctrisk.llm.common import bitset, groups, in_bitset, stored
from acctrisk.llm.words import BASE, WEIGHTS, mixed, unmixed

#: Words of the longest phrase. Hashes that a task adds up, and phrases, before it gives them away.
LONGEST, HELD_HASHES, HELD_PHRASES = 5, 1 << 20, 1 << 19
#: Bytes of words, their hashes and counts that a task adds up before it gives them away.
HELD_BYTES = 1 << 26
#: Words of the longest phrases that are counted by hash first.
FILTERED = LONGEST
#: Rows of a prefix range, rows that a range is chosen by, and most ranges. More rows make longer ranges.
RANGE_ROWS, SAMPLE_ROWS, MOST_RANGES = 20_000, 50, 4096
#: Signs of a word that a range may be named by.
BOUND_SIGNS = 64
# ASCII signs that end a piece, and those that part words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True
_WORD = ~(_ENDS | _BLANKS)


class Words:
    """The words of a slice of texts: hashes that hold the language, and which follow each other in a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data = data
        self.starts, self.ends = runs.bounds(_WORD[data], offsets)
        row = np.searchsorted(offsets, self.starts, "right") - 1
        self.names, lang = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = lang[row]
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.names], np.uint64)
        self.hashes = mixed(runs.hashes(data, self.starts, self.ends) ^ self.seeds[self.lang])
        piece = np.cumsum(_ENDS[data])[self.starts] + row if len(row) else row
        #: Whether a word and the next one stand in the same piece.
        self.joined = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])

    def grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each of some places on."""
        sums = np.full(len(at), size, np.uint64)
        for j in range(size):
            sums += self.hashes[at + j] * WEIGHTS[j]
        return mixed(sums)

    def possible(self, filters: list, size: int) -> np.ndarray:
        """Places from which ``size`` words of a piece follow that may be frequent, and all shorter parts of them, too.

        ``filters`` hold what is frequent of one word, two words and so on; beyond them only the parts decide.
        """
        held = in_bitset(filters[0], self.hashes)
        for k in range(2, size + 1):
            at = np.flatnonzero(self.joined[:max(len(held) - 1, 0)] & held[:-1] & held[1:])
            if k <= len(filters):
                at = at[in_bitset(filters[k - 1], self.grams(at, k))]
            held = np.zeros(len(held), bool)
            held[at] = True
        return held


def _slices(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, data, offsets in runs.slices(batch.column("text")):
            yield Words(data, offsets, langs[first:first + len(offsets) - 1])


class _Sums:
    """Counts of 64-bit hashes with the hashes they were made of, given away when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, found: np.ndarray, before: np.ndarray):
        self.parts.append(_run_sums(found, before, np.ones(len(found), np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > 4 * HELD_HASHES:
            self.merge()
            if self.size > HELD_HASHES:
                yield self.give()

    def merge(self):
        self.parts = [_run_sums(*[np.concatenate(c) for c in zip(*self.parts)])]
        self.size = len(self.parts[0][0])

    def give(self) -> pa.RecordBatch:
        if self.parts:
            self.merge()
        keys, before, counts = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        order = np.argsort(before)  # rows of one beginning together take less room when they are compressed
        return pa.RecordBatch.from_arrays([pa.array(x[order].view(np.int64)) for x in (keys, before, counts)], names=["h", "p", "n"])


class _Texts:
    """Counts of words as text with their hashes, given away when there are many words or bytes."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[pa.Table] = []  # columns ``lang``, a number, ``word``, ``h`` and ``n``
        self.size = self.bytes = 0

    def add(self, words: Words):
        coded = runs.strings(words.data, words.starts, words.ends).dictionary_encode()
        texts = coded.dictionary
        place, first, n = np.unique(words.lang * max(len(texts), 1) + coded.indices.to_numpy(), return_index=True, return_counts=True)
        lang, text = np.divmod(place, max(len(texts), 1))
        langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in words.names.tolist()], np.int64)
        self._hold(pa.table({"lang": langs[lang], "word": texts.take(pa.array(text)), "h": words.hashes[first].view(np.int64), "n": n}))
        if self.size > 2 * HELD_HASHES or self.bytes > 2 * HELD_BYTES:
            self.merge()
            if self.size > HELD_HASHES or self.bytes > HELD_BYTES:
                yield self.give()

    def _hold(self, part: pa.Table):
        self.parts.append(part)
        self.size += part.num_rows
        self.bytes += part.nbytes

    def merge(self):
        rows = pa.concat_tables(self.parts).group_by(["lang", "word"], use_threads=False).aggregate([("h", "min"), ("n", "sum")])
        self.parts, self.size, self.bytes = [], 0, 0
        self._hold(rows.select(["lang", "word", "h_min", "n_sum"]).rename_columns(["lang", "word", "h", "n"]))

    def give(self) -> pa.RecordBatch:
        schema = pa.schema({"lang": pa.string(), "h": pa.int64(), "word": pa.string(), "n": pa.int64()})
        if not self.parts:
            return pa.RecordBatch.from_pylist([], schema)
        self.merge()
        rows = self.parts[0].combine_chunks()
        lang, word, h, n = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
        names = pa.array(list(self.langs), pa.string())
        self.__init__()
        return pa.RecordBatch.from_arrays([names.take(lang), h, word.cast(pa.string()), n], schema=schema)


def _run_sums(keys: np.ndarray, before: np.ndarray, counts: np.ndarray) -> tuple:
    """Keys in ascending order with the sums of their counts; a key has a row for each run of one value of ``before``."""
    order = np.argsort(keys)
    keys, before = keys[order], before[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    return keys[first], before[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def _bits(found: DataFrame) -> np.ndarray:
    """A set of bits that holds the hashes of ``found`` and few others."""
    bits = min(max((64 * found.count()).bit_length(), 20), 27)  # 16 MB at most; fuller sets let more through
    return np.frombuffer(bitset(found, "h", bits), np.uint64)


def frequent_grams(counts: DataFrame, least: int) -> DataFrame:
    """All hashes with at least ``least`` occurrences: ``h``, ``n``, and the least (``p``) and largest (``q``) hash of the words before the last."""
    sums = counts.repartition("h").groupBy("h").agg(F.sum("n").alias("n"), F.min("p").alias("p"), F.max("p").alias("q"))
    return stored(sums.where(F.col("n") >= least), "frequent")


def frequent_words(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All hashes of words with at least ``least`` occurrences, and the number of words (``n``) of each ``lang``.

    Columns of the hashes: ``h``, ``n``, ``texts``, the number of words that share it, and ``lang`` and ``word`` of one of them.
    """
    sums = counts.repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    whole = F.when(F.col("word").isNull(), F.col("lang")).alias("whole")
    each = sums.groupBy("h", whole).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("lang").alias("lang"), F.min("word").alias("word"))
    found = stored(each.where((F.col("n") >= least) | F.col("whole").isNotNull()), "frequent")
    return found.where("whole is null").drop("whole"), found.where("whole is not null").select("lang", "n")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``h``, ``word`` and ``n``: counts of a task's words, with their hashes, and without a word those of a whole language."""
    def count(batches):
        sums, totals = _Texts(), {}
        for words in _slices(batches):
            yield from sums.add(words)
            for name, seed, n in zip(words.names, words.seeds.view(np.int64).tolist(), np.bincount(words.lang, minlength=len(words.names)).tolist()):
                totals[name, seed] = totals.get((name, seed), 0) + n
        yield sums.give()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in totals], pa.string()), pa.array([h for _, h in totals], pa.int64()),
                                          pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "h", "word", "n"])

    return docs.mapInArrow(count, "lang string, h long, word string, n long")


def gram_counts(docs: DataFrame, filters: list, size: int) -> DataFrame:
    """Counts of hashed phrases of ``size`` words whose parts are all frequent (``h``, ``n``).

    ``p`` is the hash of the words before the last one. It and ``h`` determine the hash of the last word.
    """
    def count(batches):
        sums, own = _Sums(), [f.value for f in filters]
        for words in _slices(batches):
            at = np.flatnonzero(words.possible(own, size))
            yield from sums.add(words.grams(at, size), words.grams(at, size - 1) if size > 2 else words.hashes[at])
        yield sums.give()

    return docs.mapInArrow(count, "h long, p long, n long")


def last_words(found: DataFrame, size: int) -> DataFrame:
    """The hash of the last word (``last``) of frequent phrases of ``size`` words, from those of the phrase and of the words before."""
    back = np.uint64(pow(int(WEIGHTS[size - 1]), -1, 1 << 64))

    def part(batches):
        for batch in batches:
            h, p = [batch.column(c).to_numpy().view(np.uint64) for c in ("h", "p")]
            sums = p * WEIGHTS[0] + np.uint64(1) if size == 2 else unmixed(p)
            last = (unmixed(h) - sums - np.uint64(1)) * back
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last.view(np.int64))], names=["h", "p", "n", "last"])

    return found.select("h", "p", "n").mapInArrow(part, "h long, p long, n long, last long")


def level_phrases(levels: list[DataFrame]) -> DataFrame:
    """``lang``, ``words`` and ``n``: each frequent phrase once, ``n`` times without a frequent word behind that lengthens it.

    A phrase is the one of all but its last word, by the hash ``p``, and its last word: two joins a level.
    """
    rows = levels[0].select("h", "lang", F.array("word").alias("words"), "n")
    parts = []
    ends = levels[0].select(F.col("h").alias("last"), "word")
    for size, found in enumerate([*levels[1:], None], 2):
        if found is None:
            parts.append(rows.select("lang", "words", "n"))
            break
        more = found.groupBy(F.col("p").alias("h")).agg(F.sum("n").alias("more"))
        own = F.col("n") - F.coalesce("more", F.lit(0))
        parts.append(rows.join(more, "h", "left").select("lang", "words", own.alias("n")).where("n > 0"))
        begun = rows.select(F.col("h").alias("p"), "lang", "words")
        longer = last_words(found, size).join(begun, "p").join(ends, "last")
        rows = stored(longer.select("h", "lang", F.concat("words", F.array("word")).alias("words"), "n"), "phrases")
    return reduce(DataFrame.union, parts).sortWithinPartitions("lang", "words")


def one_phrase_each(levels: list[DataFrame]) -> bool:
    """Whether no two words or phrases share the hash of a frequent one.

    Words were counted as text, so that those of one hash are known, and a phrase of frequent hash must have
    the same words before its last one wherever it stands, by a hash that was checked before.
    """
    return all(x.isEmpty() for x in (levels[0].where("texts > 1"), *[f.where("p <> q") for f in levels[1:]]))


def shard_phrases(docs: DataFrame, filters: list) -> DataFrame:
    """``lang``, ``words`` and ``n``: from each frequent word on, up to five words of which all parts may be frequent.

    Only for tables where hashes are shared (:func:`one_phrase_each`): every task gives away all phrases it has.
    What a task holds is given away in ascending order, equal phrases added up. Beginnings of these
    phrases are all phrases that can be frequent, and every occurrence of such is counted once.
    """
    def count(batches):
        held, own = _Phrases(), [f.value for f in filters]
        for words in _slices(batches):
            held.add(words, own)
            if held.full():
                yield held.give()
        yield held.give()

    return docs.mapInArrow(count, "lang string, words array<string>, n long")


class _Phrases:
    """Counts of phrases as numbers of their words, two to a 64-bit key, until they are given away as text."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.langs: dict[str, int] = {}
        self.parts: list[np.ndarray] = []  # three rows of keys and one of counts
        self.size = 0

    def add(self, words: Words, filters: list) -> None:
        held = words.possible(filters, 1)
        at = np.flatnonzero(held)
        if not len(at):
            return
        coded = runs.strings(words.data, words.starts[at], words.ends[at]).dictionary_encode()
        names = np.array([self.words.setdefault(w, len(self.words) + 1) for w in coded.dictionary.to_pylist()])
        langs = np.array([self.langs.setdefault(x, len(self.langs) + 1) for x in words.names.tolist()])
        code = np.zeros(len(held) + LONGEST, np.int64)
        code[at] = names[coded.indices.to_numpy()]
        size = sum(words.possible(filters, k)[at].astype(np.int64) for k in range(1, LONGEST + 1))
        first, *more = [np.where(size > k, code[at + k], 0) for k in range(LONGEST)]
        columns = [langs[words.lang[at]], first, *more]
        keys = [columns[i] << 31 | columns[i + 1] for i in range(0, LONGEST + 1, 2)]
        self.parts.append(_summed(np.stack([*keys, np.ones(len(at), np.int64)])))
        self.size += self.parts[-1].shape[1]
        if self.size > 2 * HELD_PHRASES:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_summed(np.concatenate(self.parts, axis=1))]
            self.size = self.parts[0].shape[1]

    def full(self) -> bool:
        return len(self.parts) == 1 and self.size > HELD_PHRASES or len(self.words) > 2 * HELD_PHRASES

    def give(self) -> pa.RecordBatch:
        self._merge()
        weighted = []
        if self.parts:
            names, langs = [None, *self.words], [None, *self.langs]
            columns = [c.tolist() for key in self.parts[0][:-1] for c in (key >> 31, key & (1 << 31) - 1)]
            for n, lang, *codes in zip(self.parts[0][-1].tolist(), *columns):
                weighted.append(((langs[lang], *[names[c] for c in codes if c]), n))
            weighted.sort()
        self.__init__()
        return _rows(weighted)


def _summed(table: np.ndarray) -> np.ndarray:
    """The distinct columns of keys, with the sums of their counts in the last row."""
    order = np.lexsort(table[:-1])
    keys = table[:-1, order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return np.vstack([keys[:, first], np.add.reduceat(table[-1, order], first)])


def _rows(weighted: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p, _ in weighted], pa.string()), pa.array([p[1:] for p, _ in weighted], pa.list_(pa.string())),
        pa.array([n for _, n in weighted], pa.int64())], names=["lang", "words", "n"])


def _read(batch: pa.RecordBatch, weight: str) -> list[tuple]:
    return [((lang, *words), n) for lang, words, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "words", weight)])]


def prefix_ranges(rows: DataFrame, range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Phrases that part all rows into ranges of about ``range_rows``, chosen from a sample."""
    total = rows.count()
    number = min(max(-(-total // range_rows), 1), MOST_RANGES)
    if number == 1:
        return []
    share = min(1.0, SAMPLE_ROWS * number / total)
    cut = F.transform("words", lambda w: F.substring(w, 1, BOUND_SIGNS))
    sample = sorted((r.lang, *r.words) for r in rows.sample(share, seed=8).select("lang", cut.alias("words")).collect())
    return sorted(set(sample[i * len(sample) // number] for i in range(1, number) if sample))


def united_counts(shards: DataFrame, least: int) -> DataFrame:
    """``lang``, ``words`` and ``f`` of all beginnings that occur at least ``least`` times in all.

    Sorted rows of a shard become an automaton per prefix range. The automata of a range are united
    by summing, and the sums along its paths are the counts of the beginnings. A beginning that
    spans a bound of ranges has a part of its count in each of them; these few are added at the end.
    """
    spark = shards.sparkSession
    cuts = spark.sparkContext.broadcast(prefix_ranges(shards))

    def build(batches):
        for batch in batches:
            held, at = [], None
            for phrase, n in _read(batch, "n"):
                to = bisect_right(cuts.value, phrase)
                if held and (to != at or phrase < held[-1][0]):  # a batch may hold the end of one shard and the start of another
                    yield _blob(at, held)
                    held = []
                held.append((phrase, n))
                at = to
            if held:
                yield _blob(at, held)

    def unite(batches):
        for group in groups(batches, ["range"]):
            at = group.column("range")[0].as_py()
            bounds = cuts.value[max(at - 1, 0):at + 1] if cuts.value else []
            parts = [Automaton.load(a) for a in group.column("automaton").to_pylist()]
            sums = [(p, f) for p, f in prefix_sums(united(parts))
                    if len(p) > 1 and (f >= least or any(p == b[:len(p)] for b in bounds))]
            yield _rows(sums).rename_columns(["lang", "words", "f"])

    tasks = min(len(cuts.value) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4)
    parts = shards.mapInArrow(build, "range int, automaton binary").repartition(tasks, "range").sortWithinPartitions("range")
    counts = parts.mapInArrow(unite, "lang string, words array<string>, f long")
    return counts.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _blob(at: int, weighted: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([Automaton(weighted).dump()], pa.binary())], names=["range", "automaton"])


def part_counts(counts: DataFrame) -> DataFrame:
    """For each phrase of two words or more: ``along``, the counts of its beginnings, and ``same``.

    ``same`` tells that a phrase of one more word begins with it and has its count. Phrases are dealt
    by prefix range; a beginning of a range's first phrase is sent there, too. In a range, the phrases
    asked for are composed with the counts, so that a part is looked up on the way and never joined.
    """
    spark = counts.sparkSession
    cuts = spark.sparkContext.broadcast(prefix_ranges(counts, RANGE_ROWS // 10))

    def deal(batches):
        bounds = cuts.value
        spans: dict[tuple, list[int]] = {}
        for i, b in enumerate(bounds, 1):
            for k in range(2, len(b) + 1):
                spans.setdefault(b[:k], []).append(i)
        for batch in batches:
            to, rows = [], []
            for i, (phrase, _) in enumerate(_read(batch, "f")):
                for at in sorted({bisect_right(bounds, phrase), *spans.get(phrase, ())}):
                    to.append(at)
                    rows.append(i)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *taken.columns], names=["range", "lang", "words", "f"])

    def compose(batches):
        for group in groups(batches, ["range"]):
            weighted = sorted(_read(group, "f"))
            found = list(composed(Automaton((p, 1) for p, _ in weighted if len(p) > 2), Automaton(weighted)))
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p, _, _ in found], pa.string()), pa.array([p[1:] for p, _, _ in found], pa.list_(pa.string())),
                pa.array([a[1:] for _, a, _ in found], pa.list_(pa.int64())), pa.array([s for _, _, s in found], pa.bool_())],
                names=["lang", "words", "along", "same"])

    tasks = min(len(cuts.value) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4)
    dealt = counts.select("lang", "words", "f").mapInArrow(deal, "range int, lang string, words array<string>, f long")
    return dealt.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(
        compose, "lang string, words array<string>, along array<long>, same boolean")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases have two to five words of one piece and occur at least ``least`` times. Words are counted as text,
    phrases by hash, level by level, each with the hash of the words before its last one. Where that
    shows that a frequent hash has one phrase only, the phrases are put together from it; where two share a
    hash, all that may be frequent is counted as text. Phrases inside a longer one with the same count go.

    A missing language is ``und``, also next to a language of that name. Missing and empty texts have
    no words, texts and words of any length are read whole, repeated rows count as often as they
    stand, and an empty table gives an empty result. Ids are not used; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found, totals = frequent_words(word_counts(rows), least)
    levels, filters = [found], [spark.sparkContext.broadcast(_bits(found))]
    for size in range(2, FILTERED + 1):
        levels.append(frequent_grams(gram_counts(rows, filters, size), least))
        filters.append(spark.sparkContext.broadcast(_bits(levels[-1])))
    shards = level_phrases(levels) if one_phrase_each(levels) else shard_phrases(rows, filters)
    counts = stored(united_counts(stored(shards, "shards"), least), "counts")
    ahead = part_counts(counts).select("lang", "words", F.col("along").alias("ls"), F.lit(None).cast("array<long>").alias("rs"), "same")
    turned = part_counts(counts.withColumn("words", F.reverse("words")))
    behind = turned.select("lang", F.reverse("words").alias("words"), F.lit(None).cast("array<long>").alias("ls"), F.col("along").alias("rs"), "same")
    both = ahead.union(behind).groupBy("lang", "words").agg(F.max("ls").alias("ls"), F.max("rs").alias("rs"), F.max("same").alias("same"))
    cut = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> struct(
        (1000 * cast(element_at(ls, -1) as decimal(20, 0)) * cast(n as decimal(20, 0)))
            div (cast(ls[k - 1] as decimal(19, 0)) * cast(rs[size(words) - k - 1] as decimal(19, 0))) as score,
        k, ls[k - 1] as l, rs[size(words) - k - 1] as r)))""")
    scored = both.where("not same").join(totals, "lang").select(
        "lang", "words", F.element_at("ls", -1).alias("a"), "n", cut.alias("cut"))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
