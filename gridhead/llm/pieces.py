"""Byte-pair pieces of a SentencePiece model for whole texts, and back.

A batch's distinct words are indexed by a suffix array. Every piece of the vocabulary finds its occurrences by
binary search; they are the edges of the words' position graphs. Sorted by where they end, the edges are relaxed
for all words at once: an edge holds if its piece may follow the piece before it, and then it is the only one that
ends there.

That is exact for byte-pair encoding. No merge crosses the border of two neighbouring pieces of an encoding, so a
sequence is the encoding if and only if each two neighbours, encoded alone, stay as they are (`_may_follow`).
Pieces never run over the start of a word, so words are encoded apart and each distinct word once.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhead.llm.common import blocks, others, quoted, valid

#: Fixed value: what the model writes for a blank.
BLANK = "▁"
#: Words whose encodings a task keeps at most; bytes of one index at most (a longer word is one of its own).
KEPT_WORDS = 250_000
INDEX_BYTES = 1 << 18
#: Code points that are cut into words at once.
CHARS = 1_000_000
_SEPARATOR, _ZERO = 0xFF, 0xFE  # bytes that UTF-8 never uses: between words, and for U+0000
_WORD = regex.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_NEVER = np.int64(1 << 40)


class Model:
    """The vocabulary, ranked by when its pieces are merged."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.ids = {p: i for i, p in self.text.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError(f"{path}: pieces that run over the start of a word")
        self.size = size
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        score = {i: sp.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: When a piece comes into being; characters are there from the start. One entry more, for characters without a piece.
        self.rank = np.full(size + 1, -1, np.int64)
        self.left, self.right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        merges, usable = {}, []
        for i, p in self.text.items():
            if len(p) > 1:
                self.rank[i] = order[score[i]]
                for k in range(1, len(p)):
                    if p[:k] in self.ids and p[k:] in self.ids:
                        merges[self.ids[p[:k]], self.ids[p[k:]]] = i
        self.order = {i: order[s] for i, s in score.items()}
        for i, p in self.text.items():
            whole, parts = self._merged(p, merges)
            if whole:
                usable.append(i)
                self.left[i], self.right[i] = parts
        keys = sorted((a * (size + 1) + b, c) for (a, b), c in merges.items())
        self.pair = np.array([k for k, _ in keys], np.int64)
        self.made = self.rank[np.array([c for _, c in keys], np.int64)]
        coded = [self.text[i].replace("\0", "￾").encode() for i in usable]
        self.usable, self.length = np.array(usable, np.int64), np.array([len(c) for c in coded], np.int64)
        self.width = int(self.length.max())
        self.bytes = np.zeros((len(coded), self.width), np.uint8)
        for row, c in zip(self.bytes, coded, strict=True):
            row[: len(c)] = np.frombuffer(c, np.uint8)
        head = self.bytes[:, :8].astype(np.uint64)
        pad = np.uint64(0xFF) * (np.arange(8) >= self.length[:, None])
        #: The least and the largest first eight bytes of a text that begins with the piece.
        self.least = sum(head[:, k] << np.uint64(56 - 8 * k) for k in range(8))
        self.most = sum((head[:, k] | pad[:, k]) << np.uint64(56 - 8 * k) for k in range(8))
        self.surface = [b""] * size
        for i, p in self.text.items():
            self.surface[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        self.cache_key, self.cache_value = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _merged(self, piece: str, merges: dict) -> tuple[bool, tuple[int, int]]:
        """Whether a piece's own text is encoded as that piece, and by which last merge (-1, -1 for a character)."""
        parts = [self.ids.get(c, -1) for c in piece]
        last = (-1, -1)
        while len(parts) > 1:
            _, k = min(((self.order[m], k) for k, two in enumerate(itertools.pairwise(parts)) if (m := merges.get(two)) is not None), default=(0, -1))
            if k < 0:
                return False, last
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [merges[last]]
        return parts[0] >= 0, last

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b stay apart when their texts are encoded together.

        Goes back in time: the piece that came into being last is undone, and what then stood at the border must not
        have merged before. Equal ranks merge from the left, so ties count against b only.
        """
        good, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER)
        while len(at):
            key = a * (self.size + 1) + b
            found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossed = (self.pair[found] == key) & (self.made[found] < limit)
            good[at[crossed]] = False
            undo_a = self.rank[a] > self.rank[b]
            live = ~crossed & np.where(undo_a, self.left[a] >= 0, self.left[b] >= 0)
            limit = np.where(undo_a, self.rank[a], self.rank[b] + 1)[live]
            a, b = np.where(undo_a, self.right[a], a)[live], np.where(undo_a, b, self.left[b])[live]
            at = at[live]
        return good

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_walk`, remembered."""
        key = a * (self.size + 1) + b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.cache_key) - 1)
        new = np.flatnonzero(self.cache_key[slot] != key)
        out = self.cache_value[slot]
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            value = self._walk(some // (self.size + 1), some % (self.size + 1))
            out[new] = value[back]
            slots = (some * 0x9E3779B1 >> 7) & (len(self.cache_key) - 1)
            self.cache_key[slots], self.cache_value[slots] = some, value
            kept = self.cache_key[slots] == some  # two new keys of one slot: the last one's value must be its own
            self.cache_value[slots[kept]] = value[kept]
        return out

    def suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in the order of their first `width` bytes (at least), and the first eight bytes of each as a number.

        Ranks by eight bytes are doubled until they cover the width; the order of equal prefixes is left open.
        """
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        head = sum(padded[k : len(text) + k] << np.uint64(56 - 8 * k) for k in range(8))
        order = np.argsort(head)
        rank, covered = np.empty(len(text), np.int64), 8
        rank[order] = np.cumsum(np.diff(head[order], prepend=head[order[:1]]) != 0)
        while covered < self.width:
            key = rank * (len(text) + 1)
            key[:-covered] += rank[covered:] + 1
            order = np.argsort(key)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            covered *= 2
        return order, head[order]

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and index (in `usable`) of every occurrence of every usable piece."""
        order, heads = self.suffixes(text)
        low, high = np.searchsorted(heads, self.least), np.searchsorted(heads, self.most, "right")
        # pieces of more than eight bytes: on within the range of their first eight
        long = np.flatnonzero((self.length > 8) & (low < high))
        if len(long):
            padded = np.concatenate([text, np.zeros(self.width, np.uint8)])
            wide = np.arange(8, self.width)
            inside, bytes_ = wide < self.length[long][:, None], self.bytes[long][:, 8:]
            rows = np.arange(len(long))

            def bound(low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
                low, high = low.copy(), high.copy()
                while (go := low < high).any():
                    mid = (low + high) >> 1
                    here = padded[order[np.minimum(mid, len(order) - 1)][:, None] + wide]
                    differ = (here != bytes_) & inside
                    first = differ.argmax(1)
                    less = np.where(differ[rows, first], here[rows, first] < bytes_[rows, first], after)
                    low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
                return low

            low[long], high[long] = bound(low[long], high[long], False), bound(low[long], high[long], True)
        n = high - low
        return order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of the words (blanks already written as `BLANK`), end to end, and how many each word has."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        text = np.frombuffer(b"\xff".join([*coded, b""]), np.uint8).copy()
        text[text == 0] = _ZERO
        begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])[:-1])).astype(np.int64)
        ends = begins + np.array([len(c) for c in coded])
        start, piece = self.occurrences(text)
        stop, piece = start + self.length[piece], self.usable[piece]
        # characters without a piece are edges of their own
        heads = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _SEPARATOR))
        word_at = np.repeat(np.arange(len(words), dtype=np.int32), ends - begins + 1)
        tails = np.append(heads[1:], len(text) - 1)
        tails = np.minimum(tails, ends[word_at[heads]])
        single = np.zeros(len(text) + 1, bool)
        size_at = np.zeros(len(text) + 1, np.int64)
        size_at[heads] = tails - heads
        single[start[stop - start == size_at[start]]] = True
        lone = ~single[heads]
        start = np.concatenate([start, heads[lone]])
        stop, piece = np.concatenate([stop, tails[lone]]), np.concatenate([piece, np.full(lone.sum(), self.size)])
        first = begins[word_at[start]]
        reach = stop - first
        order = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach, kind="stable")
        start, stop, piece, reach, opening = start[order], stop[order], piece[order], reach[order], (start == first)[order]
        cuts = np.flatnonzero(np.diff(reach)) + 1
        last, back = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        for a, b in zip([0, *cuts], [*cuts, len(start)], strict=True):
            s, p = start[a:b], piece[a:b]
            before = last[s]
            ok = opening[a:b].copy()
            ask = np.flatnonzero(~ok & (before >= 0))
            ok[ask] = self.may_follow(before[ask], p[ask])
            last[stop[a:b][ok]], back[stop[a:b][ok]] = p[ok], s[ok]
        out_word, out_id, at, who = [], [], ends, np.arange(len(words))
        while len(at):
            out_word.append(who)
            out_id.append(np.stack([last[at], back[at], at]))
            at = back[at]
            more = at > begins[who]
            at, who = at[more], who[more]
        who, (ids, begin, end) = np.concatenate(out_word)[::-1], np.concatenate(out_id, 1)[:, ::-1]
        order = np.argsort(who, kind="stable")
        who, ids, begin, end = who[order], ids[order], begin[order], end[order]
        plain = np.where(text == _ZERO, 0, text)
        n = np.where(ids == self.size, end - begin, 1)
        spread = np.repeat(np.arange(len(ids)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        full = np.where(ids[spread] == self.size, self.byte[plain[np.minimum(begin[spread] + step, len(plain) - 1)]], ids[spread])
        return full.astype(np.int32), np.bincount(who[spread], minlength=len(words))


@functools.cache
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes texts; keeps the words it has met."""

    def __init__(self, path: str):
        self.model = model(path)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        found, batch, size = [], [], 0
        for w in new:
            batch.append(w)
            size += 2 * len(w)
            if size >= INDEX_BYTES:
                found.append(self.model.encode_words(batch))
                batch, size = [], 0
        if batch:
            found.append(self.model.encode_words(batch))
        self.ids = np.concatenate([self.ids, *(f[0] for f in found)])
        self.sizes = np.concatenate([self.sizes, *(f[1] for f in found)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of the texts, end to end, and how many each text has."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        seen = len(self.words)
        code = defaultdict(itertools.count(seen).__next__, self.words)
        codes = [np.fromiter(map(code.__getitem__, found), np.int64, len(found)) for found in (_WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts)]
        self.words = dict(code)
        self._learn(list(itertools.islice(self.words, seen, None)))
        begins = np.cumsum(self.sizes) - self.sizes
        every = np.concatenate([*codes, np.zeros(0, np.int64)])
        n = self.sizes[every]
        ids = self.ids[np.repeat(begins[every] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate(([0], np.cumsum(n)))
        edges = total[np.concatenate(([0], np.cumsum([len(c) for c in codes]).astype(np.int64)))]
        return ids, np.diff(edges)


def decode(ids: np.ndarray, path: str) -> str:
    """The text of piece ids: pieces joined, blanks put back, the first blank taken off, byte pieces read as UTF-8."""
    text = b"".join(map(model(path).surface.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
    return text.removeprefix(" ")


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` without its text, with `ids` (array<int>) and `n_pieces` of the whole text, and `round_trip`: whether decoding gives the text again.

    A null or empty text has no pieces; a very long one is encoded whole. A U+2581 in a text is decoded as a blank, as the
    model cannot tell them apart; `round_trip` compares with that in mind. Equal texts have equal pieces; other columns
    stay as they are, but for columns of the three names (in whatever case), which are replaced. Ids are of no account: they
    may repeat or be null. Bytes that are no valid UTF-8 are read as U+FFFD. An empty table gives an empty result.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    rest = others(docs, text, *(f.name for f in made))
    names = [f"c{i}" for i in range(len(rest))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for cut in blocks(pc.fill_null(pc.utf8_length(b.column(len(rest))), 0).to_pylist(), CHARS):
                part = b.slice(cut.start, cut.stop - cut.start)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                ids, n = encoder.encode(texts)
                edges = np.concatenate(([0], np.cumsum(n)))
                same = [decode(ids[a:z], path) == t.replace(BLANK, " ") for a, z, t in zip(edges[:-1], edges[1:], texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(n.astype(np.int32)), pa.array(same)], names=[*names, *(f.name for f in made)])

    # under plain names, as Spark's own call cannot take dots
    rows = docs.select(*quoted(*rest), valid(text)).toDF(*names, "text")
    found = rows.mapInArrow(encode, T.StructType([*rows.schema.fields[:-1], *made]))
    return found.toDF(*rest, *(f.name for f in made))


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `text`, decoded from its piece ids (null ids: null)."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else decode(np.asarray(i, np.int64), path) for i in column], dtype=object)

    return encoded.withColumn("text", texts(F.col(ids)))
