"""Encoding and decoding of texts with merge-type SentencePiece vocabularies."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from acctrisk.llm.common import worker_cache

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Bytes of text that are encoded and returned at once.
SLICE = 1 << 22
#: Words whose ids a worker keeps, and the longest of them. More words only cost time.
KEPT_WORDS, KEPT_LENGTH = 1 << 19, 48
#: Characters of a word whose agenda is a plain list; a place behind all scores.
SHORT, LAST = 32, 1 << 60
#: Short words whose agendas are rows of one table: more than that at once, and most in a table.
FEW, TABLE = 64, 1 << 13
# Kinds of pieces and the number of merge-type models in a model file.
NORMAL, BYTE, MERGE_TYPE = 1, 6, 2
#: No place in the order of scores.
NONE = np.iinfo(np.int32).max


class Encoder:
    """Ids of whole texts by an agenda of adjacent symbol pairs.

    A text starts as its characters. All adjacent pairs that form a piece stand in an agenda, ordered
    by the piece's score and then from left to right. The first pair is merged, and the pairs of the
    new symbol with its neighbours enter; an entry whose symbols have been merged away is passed over.
    What is no piece in the end becomes bytes. No piece holds a space behind another sign, so words
    never merge with each other and each distinct word is merged once.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = formats.ModelProto()
        with open(path, "rb") as file:  # on every machine: an installed library's data
            model.ParseFromString(file.read())
        spec = model.trainer_spec
        if spec.model_type != MERGE_TYPE or not spec.byte_fallback:
            raise ValueError("only merge-type vocabularies with byte pieces can be encoded here")
        if model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only vocabularies that keep spaces and put one in front can be encoded here")
        if any(p.type not in (NORMAL, BYTE, 2, 3) for p in model.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces can't be encoded here")
        scores = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {s: k for k, s in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
        self.size = len(model.pieces)
        self.number = {piece: i for piece, (_, i) in scores.items()}
        for piece in scores:  # characters that are no piece but stand in one
            for c in piece:
                self.number.setdefault(c, self.size + len(self.number))
        self.signs = {i: c for c, i in self.number.items() if i >= self.size}
        #: For a pair of symbols: the place of its piece in the order of scores, and the piece.
        self.rank, self.merged = {}, {}
        for piece, (score, i) in scores.items():
            for k in range(1, len(piece)):
                a, b = self.number.get(piece[:k]), self.number.get(piece[k:])
                if a is not None and b is not None:
                    self.rank[a, b], self.merged[a, b] = order[score], i
        # The same for many words at once: pairs as numbers in ascending order, and the symbol of a character.
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        self.chars = self.size + len(self.number)  # from here on, characters that stand in no piece
        self.width = self.chars + 0x110000
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        by_key = np.argsort(keys)
        self.pairs = np.append(keys[by_key], 1 << 62)
        self.ranks = np.append(np.array(list(self.rank.values()), np.int32)[by_key], NONE)
        self.made = np.array(list(self.merged.values()), np.int64)[by_key]
        self.symbol = np.arange(self.chars, self.width)
        for c, i in self.number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        inner = any(SPACE in piece.lstrip(SPACE) for piece in scores)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not inner else r"(?s).+").findall
        self.end = self.library.eos_id()
        self.kept: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by the agenda: a list for a short word, a heap for a long one."""
        symbols = [self.number.get(c, c) for c in word]
        return self._spelled(self._short(symbols) if len(symbols) <= SHORT else self._long(symbols))

    def _spelled(self, symbols: list) -> list[int]:
        """Symbols that are pieces, and the bytes of the others."""
        ids = []
        for s in symbols:
            if isinstance(s, int) and s < self.size:
                ids.append(s)
            else:
                ids += [self.bytes[b] for b in self.signs.get(s, s).encode("utf-8")]
        return ids

    def _short(self, symbols: list) -> list:
        rank, merged = self.rank.get, self.merged
        agenda = [rank(pair, LAST) for pair in zip(symbols, symbols[1:])]
        while agenda and (first := min(agenda)) < LAST:
            i = agenda.index(first)
            symbols[i] = merged[symbols[i], symbols[i + 1]]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank((symbols[i - 1], symbols[i]), LAST)
            if i < len(agenda):
                agenda[i] = rank((symbols[i], symbols[i + 1]), LAST)
        return symbols

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Agendas of many short words are rows of tables, and a step merges a pair in each row."""
        out: list = [None] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        if len(short) <= FEW:
            short = []
        for at in range(0, len(short), TABLE):
            some = short[at:at + TABLE]
            for i, ids in zip(some, self._table([words[i] for i in some])):
                out[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, out)]

    def _table(self, words: list[str]) -> list[list[int]]:
        """Ids of short words, ascending by length."""
        sizes = np.array([len(w) for w in words])
        n, most = len(words), int(sizes[-1])
        symbols = np.full((n, most), -1, np.int64)
        signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols[np.arange(most) < sizes[:, None]] = self.symbol[signs]
        rank = self._ranks(symbols[:, :-1], symbols[:, 1:])
        done: list = [None] * n
        rows = np.arange(n)
        while len(rows):
            width = symbols.shape[1]
            at = np.arange(len(rows))
            first = rank.argmin(axis=1) if width > 1 else at
            left = rank[at, first] < NONE if width > 1 else np.zeros(len(rows), bool)
            for r, ids in zip(rows[~left].tolist(), symbols[~left].tolist()):
                ids = ids[:sizes[r]]
                if max(ids, default=0) >= self.size:
                    ids = self._spelled([chr(s - self.chars) if s >= self.chars else s for s in ids])
                done[r] = ids
            if not left.all():
                rows, first, symbols, rank = rows[left], first[left], symbols[left], rank[left]
                at = np.arange(len(rows))
            if not len(rows):
                break
            sizes[rows] -= 1
            symbols[at, first] = self.made[np.searchsorted(self.pairs, symbols[at, first] * self.width + symbols[at, first + 1])]
            kept = np.ones(symbols.shape, bool)  # what stands behind the pair moves up by one place
            kept[at, first + 1] = False
            symbols = symbols[kept].reshape(len(rows), width - 1)
            kept = kept[:, 1:]
            rank = rank[kept].reshape(len(rows), width - 2)
            for beside in (first - 1, first):
                some = np.flatnonzero((beside >= 0) & (beside < width - 2))
                x = beside[some]
                rank[some, x] = self._ranks(symbols[some, x], symbols[some, x + 1])
        return done

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of pairs of symbols in the order of scores."""
        keys = a * self.width + b
        place = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[place] == keys, self.ranks[place], NONE)

    def _long(self, symbols: list) -> list:
        rank, merged, n = self.rank.get, self.merged, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank((a, b), LAST), i, i + 1, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        agenda = [entry for entry in agenda if entry[0] < LAST]
        heapify(agenda)
        while agenda:
            _, i, j, a, b = heappop(agenda)
            if symbols[i] != a or symbols[j] != b:  # one of them is merged, in another place
                continue
            symbols[i], symbols[j] = merged[a, b], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (first := rank((symbols[x], symbols[y]), LAST)) < LAST:
                    heappush(agenda, (first, x, y, symbols[x], symbols[y]))
        return [s for s in symbols if s is not None]

    def batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text without an end, and whether the library finds the same for all its new words."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        kept, split = self.kept, [self.words(t) for t in self.library.normalize(texts)]
        new = list({w for words in split for w in words if w not in kept})
        own = self.merge_all(new)
        # The library puts a space in front of what it gets unless that is empty; every word begins with one.
        theirs = self.library.encode([w[1:] for w in new], num_threads=1)
        wrong = {w for w, a, b in zip(new, own, theirs) if a != b and w != SPACE}
        kept.update((w, array("i", ids).tobytes()) for w, ids in zip(new, own))
        ids = [np.frombuffer(b"".join([kept[w] for w in words]), np.int32) for words in split]
        agrees = [wrong.isdisjoint(words) for words in split] if wrong else [True] * len(texts)
        for w in new:
            if len(w) > KEPT_LENGTH or w in wrong:
                del kept[w]
        return ids, agrees


def encoder(path: str) -> Encoder:
    """The encoder of a model file, one per process."""
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = Encoder(path)
    return cache["pieces", path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most :data:`SLICE` bytes, or one row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield at, to
        at = to


def encode_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Ids of every text with an end id, and the text that the library decodes from them.

    Columns: the id, ``ids``, ``decoded``, and ``agrees``: false where the library encodes a word of
    the text in another way than the agenda. Each distinct word that a batch brings is given to both
    before its ids are used. Nothing is shuffled, and a task holds one Arrow batch.

    A missing or empty text has the end id only and decodes to an empty text. Texts of any length are
    encoded whole; a word of any length is merged in one agenda, in time ``n log n``. Missing and
    repeated ids have a row per input row; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    path = model or default_path()
    kind = dict(docs.dtypes)[id]

    def encode(batches):
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for at, to in _slices(texts):
                ids, agrees = own.batch([t or "" for t in texts.slice(at, to - at).to_pylist()])
                ends = np.array([own.end], np.int32)
                whole = [np.concatenate([x, ends]) for x in ids]
                decoded = own.library.decode([x.tolist() for x in whole])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(offsets, np.concatenate(whole)),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["id", "ids", "decoded", "agrees"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string, agrees boolean").withColumnRenamed("id", id)
