"""SentencePiece encoding and decoding of the kind BPE, by vectorised rounds of merges.

A run of texts becomes one flat array of symbols. Words (which no piece crosses) are folded to
different ones; each round finds the best rank among the pairs of each word by a segmented
minimum, merges all places of that rank at once, the leftmost first where two overlap, and
compacts the arrays. Words without a pair leave; the rounds end when none is left.

Merging all places of a rank at once gives what merging one after another gives, unless a merge
brings about a pair that is as good or better. Then the round stops there, in that word.

A round of short words costs what their symbols are. Words of many symbols see many ranks, so they
are merged by lists of places, one for each rank, and a round costs only the places that it merges.
"""

from __future__ import annotations

from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.text import column_bytes, row_runs

#: Stands for a blank in pieces. Fixed value.
BLANK = "▁"
#: Kinds of pieces in a model's file. Fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_NEVER = np.int32(2**31 - 1)
#: Words of more symbols are merged by lists of places.
_LONG_WORD = 256


class Pieces:
    """The pieces of a model, and the merges that they allow.

    path: a model of the kind BPE with byte fallback and without a normalisation of its own, whose
    pieces are normal, unknown, control or byte pieces; others are refused, as they'd be encoded otherwise."""

    def __init__(self, path: str | None = None, model=None):
        from sentencepiece import sentencepiece_model_pb2

        if model is None:
            model = sentencepiece_model_pb2.ModelProto()
            with open(path, "rb") as f:
                model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a BPE model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError(f"{path}: normalises texts")
        kinds = [p.type for p in model.pieces]
        if not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: has unused or user-defined pieces")
        self.prefix = rules.add_dummy_prefix
        self.size = len(kinds)
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i

        # What pieces decode to.
        said = {NORMAL: lambda p: p.piece.replace(BLANK, " ").encode(), BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode()}
        self.told = [said[p.type](p) for p in model.pieces]
        self.lengths = np.array([len(p.piece) if p.type == NORMAL else 1 for p in model.pieces], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.starts_blank = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.told_at = np.concatenate([[0], np.cumsum([len(x) for x in self.told])])
        self.told_bytes = np.frombuffer(b"".join(self.told), np.uint8)

        # Symbols: pieces, then characters that only stand inside of pieces, and one for all the others.
        inside = sorted({c for p in ids for c in p} - {*ids})
        symbols = ids | {c: self.size + k for k, c in enumerate(inside)}
        self.other = self.size + len(inside)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs, unsafe = {}, set()
        for piece, i in ids.items():
            mine = rank[model.pieces[i].score]
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (mine, i)
                    for part in (a, b):
                        if part < self.size and rank[model.pieces[part].score] >= mine and len(model.pieces[part].piece) > 1:
                            unsafe.add(rank[model.pieces[part].score])
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        told = np.array([*pairs.values(), (_NEVER, -1)], np.int32)  # the last, at -1, is for no pair
        self.best, self.become = told[[*order, -1]].T.copy()
        self._table(keys[order])
        self.unsafe = np.zeros(len(scores) + 1, bool)
        self.unsafe[[*unsafe]] = True
        self.words = all(BLANK not in p.lstrip(BLANK) for p in ids)  # else a piece may cross from word to word

    def _table(self, keys: np.ndarray) -> None:
        """A table of hashed keys, each at its place or one of the next few."""
        bits = int(len(keys) * 4 + 2).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_pair = np.full(self.mask + 65, -1, np.int64), np.zeros(self.mask + 65, np.int32)
        place = self._place(keys)
        self.probes = 0
        for k, (key, at) in enumerate(zip(keys.tolist(), place.tolist())):
            n = 0
            while self.slot_key[at + n] >= 0:
                n += 1
            self.slot_key[at + n], self.slot_pair[at + n] = key, k
            self.probes = max(self.probes, n)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair among the merges, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self._place(keys)
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n in range(self.probes + 1):
            here = self.slot_key[at[open_] + n]
            same = here == keys[open_]
            found[open_[same]] = self.slot_pair[at[open_[same]] + n]
            open_ = open_[~same & (here >= 0)]
            if not len(open_):
                break
        return found

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.best[self.pair_of(left, right)]

    def _taken(self, hit, follows, word, rank, new, symbol, left, right, right2) -> np.ndarray:
        """Which of the pairs at the places `hit`, in order, are merged in a round: each second one of
        overlapping ones (follows: a pair begins where the one before it ends), and of each word
        those up to the first that brings about a pair as good as `rank` or better.

        new: what the pairs become. symbol, left, right, right2: symbols, and the places before a pair, of its
        second symbol and behind it; -1 for none."""
        chain = np.flatnonzero(~follows)
        take = (np.arange(len(hit)) - np.repeat(chain, np.diff(np.concatenate([chain, [len(hit)]])))) % 2 == 0
        look = np.flatnonzero(take & self.unsafe[rank])
        if len(look):
            stop = np.zeros(len(hit), bool)
            behind = look[right2[look] >= 0]
            stop[behind] |= self.rank_of(new[behind], symbol[right2[behind]]) <= rank[behind]
            before = look[left[look] >= 0]
            taken = np.flatnonzero(take)
            last = taken[np.maximum(np.searchsorted(taken, before) - 1, 0)]
            merged = (last < before) & (right[last] == left[before])  # what stands before has just been merged
            beside = np.where(merged, new[last], symbol[left[before]])
            stop[before] |= self.rank_of(beside, new[before]) <= rank[before]
            if stop.any():
                begins = np.flatnonzero(np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]]))
                so_far = np.cumsum(stop) - stop
                take &= so_far == np.repeat(so_far[begins], np.diff(np.concatenate([begins, [len(hit)]])))
        return take

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of words when nothing can be merged: (symbols, first). Word i has the symbols
        first[i] to first[i + 1] and is not empty."""
        size = np.diff(first)
        n_words, word = len(size), np.repeat(np.arange(len(size)), size)
        long = size > _LONG_WORD
        of_long = np.repeat(long, size)
        done = [self._by_rounds(symbols[~of_long], word[~of_long])]
        if long.any():
            done.append(self._by_places(symbols[of_long], word[of_long]))
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])

    def _by_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, symbols) of merged words, those of a word in order. A word needs as many rounds as it sees ranks."""
        pair = np.full(len(symbols), -1, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.pair_of(symbols[inner], symbols[inner + 1])
        done = [(word[:0], symbols[:0])]
        while len(symbols):
            rank = self.best[pair]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(word)]]))
            least = np.minimum.reduceat(rank, starts)
            over = least == _NEVER
            if over.any():  # words without a pair leave
                gone = np.repeat(over, sizes)
                done.append((word[gone], symbols[gone]))
                stay = ~gone
                symbols, word, pair, rank = symbols[stay], word[stay], pair[stay], rank[stay]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            new = self.become[pair[hit]]
            left = np.where((hit > 0) & (word[hit - 1] == word[hit]), hit - 1, -1)
            behind = np.minimum(hit + 2, len(word) - 1)
            right2 = np.where((hit + 2 < len(word)) & (word[behind] == word[hit]), behind, -1)
            follows = np.concatenate([[False], (hit[1:] == hit[:-1] + 1) & (word[hit[1:]] == word[hit[:-1]])])
            take = self._taken(hit, follows, word, rank[hit], new, symbols, left, hit + 1, right2)
            at = hit[take]
            symbols[at] = new[take]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            now = np.cumsum(stay)[at] - 1  # where the merged symbols stand
            symbols, word, pair = symbols[stay], word[stay], pair[stay]
            again = np.unique(np.concatenate([now, now - 1]))
            again = again[again >= 0]
            pair[again] = -1
            again = again[again < len(symbols) - 1]
            again = again[word[again] == word[again + 1]]
            pair[again] = self.pair_of(symbols[again], symbols[again + 1])
        word, symbols = (np.concatenate(x) for x in zip(*done))
        return word, symbols

    def _by_places(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, by a list of places for each rank; symbols that are merged away are passed over."""
        n = len(symbols)
        same = word[1:] == word[:-1]
        after = np.concatenate([np.where(same, np.arange(1, n), -1), [-1]])
        before = np.concatenate([[-1], np.where(same, np.arange(n - 1), -1)])
        pair, alive = np.full(n, -1, np.int64), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank < _NEVER], rank[rank < _NEVER]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            begins = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(at) else at
            for r, some in zip(rank[begins].tolist(), np.split(at, begins[1:])):
                if r not in places:
                    places[r] = []
                    heappush(ranks, r)
                places[r].append(some)

        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.pair_of(symbols[inner], symbols[after[inner]])
        add(inner, self.best[pair[inner]])
        while ranks:
            r = heappop(ranks)
            hit = np.unique(np.concatenate(places.pop(r)))
            hit = hit[self.best[pair[hit]] == r]
            if not len(hit):
                continue
            second = after[hit]
            new, right2 = self.become[pair[hit]], after[second]
            follows = np.concatenate([[False], hit[1:] == second[:-1]])
            take = self._taken(hit, follows, word, np.full(len(hit), r), new, symbols, before[hit], second, right2)
            at, gone, behind = hit[take], second[take], right2[take]
            add(hit[~take], np.full(len(hit) - len(at), r))
            symbols[at], alive[gone], pair[gone], after[at] = new[take], False, -1, behind
            before[behind[behind >= 0]] = at[behind >= 0]
            again = np.unique(np.concatenate([at, before[at]]))
            again = again[again >= 0]
            pair[again] = -1
            again = again[after[again] >= 0]
            pair[again] = self.pair_of(symbols[again], symbols[after[again]])
            add(again, self.best[pair[again]])
        return word[alive], symbols[alive]

    def _words(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """(words, first): the words of normalised texts; text i has the words first[i] to first[i + 1]."""
        data, offsets = column_bytes(texts)
        start = np.zeros(len(data) + 1, bool)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.words and len(data) >= 3:
            blank = np.zeros(len(data), bool)
            a, b, c = BLANK.encode()
            blank[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            after = np.zeros(len(data), bool)
            after[3:] = blank[:-3]
            start[:-1] |= blank & ~after  # the first blank of some, but a run of them stays one
        at = np.flatnonzero(start)
        cuts = np.concatenate([at, [len(data)]]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        return words, np.searchsorted(at, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has the ids first[i] to first[i + 1]. A null text has none."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), " ", BLANK)
        if self.prefix:
            plain = pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), plain, pa.scalar("", pa.large_string())))
        words, first_word = self._words(plain)
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        folded = words.dictionary_encode()
        unique, which = folded.dictionary, folded.indices.to_numpy()
        raw, at = column_bytes(unique)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(pc.utf8_length(unique).to_numpy())]).astype(np.int64)
        made, first = self.merge(self.of_char[chars], first)
        if (made >= self.size).any():
            made, first = self._as_bytes(made, first, chars)
        size = np.diff(first)[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1][which], size)
        return made[place], ends[first_word]

    def _as_bytes(self, made: np.ndarray, first: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the pieces of their character's bytes."""
        strange = np.flatnonzero(made >= self.size)
        length = np.ones(self.other + 1, np.int64)
        length[: self.size] = self.lengths
        c = chars[np.concatenate([[0], np.cumsum(length[made])])[:-1][strange]]
        size = np.ones(len(made), np.int64)
        size[strange] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(made, size)
        raw = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(made >= self.size, size)] = self.byte_ids[raw]
        return out, at[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of ids; bytes that are not UTF-8 become U+FFFD each."""
        size = np.diff(self.told_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.told_at[:-1][ids], size)
        data, at = self.told_bytes[place], ends[first]
        if self.prefix:  # the blank that encoding put before a text
            led = np.flatnonzero(np.diff(first) > 0)
            led = led[self.starts_blank[ids[first[:-1][led]]]]
            stay = np.ones(len(data), bool)
            stay[at[:-1][led]] = False
            lost = np.zeros(len(at), np.int64)
            lost[led + 1] = 1
            data, at = data[stay], at - np.cumsum(lost)
        try:
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            return made.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([self._decode_one(ids[a:b]) for a, b in zip(first[:-1], first[1:])], pa.large_string())

    def _decode_one(self, ids: np.ndarray) -> str:
        out, held = [], b""

        def close(raw: bytes) -> str:
            text = ""
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        text, raw = text + raw[:n].decode(), raw[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text, raw = text + "�", raw[1:]
            return text

        for k, i in enumerate(ids.tolist()):
            if self.is_byte[i]:
                held += self.told[i]
                continue
            out += [close(held), self.told[i].decode()[bool(self.prefix and k == 0 and self.starts_blank[i]) :]]
            held = b""
        return "".join(out) + close(held)


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def _encode_batches(batches, path, also_decode):
    model = _model(path)
    for batch in batches:
        texts = batch.column("text")
        for low, high in row_runs(column_bytes(texts)[1]):
            ids, first = model.encode(texts[low:high])
            made = [batch.column("doc")[low:high], pa.array(np.diff(first), pa.int64()), _lists(ids, first)]
            names = ["doc", "n_tokens", "ids"]
            if also_decode:
                made, names = [*made, model.decode(ids, first).cast(pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(made, names)


def _decode_batches(batches, path):
    model = _model(path)
    for batch in batches:
        lists = batch.column("ids")
        lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type))
        ids, first = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, model.decode(ids.astype(np.int64), first).cast(pa.string())], [*batch.schema.names, "decoded"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))


def _out(texts: DataFrame, decoded: bool):
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return texts.select("doc", null("long", "n_tokens"), null("array<int>", "ids"), *([null("string", "decoded")] if decoded else [])).schema


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (all columns in a struct `doc`) with n_tokens and ids (array<int>). path: a model file that
    every executor has (see Pieces for the kinds that it takes).

    A null or empty text has no ids. Repeated rows come out repeated, no rows give no rows. Texts are
    encoded whole, some 4 MB of them at a time, or one where it is longer."""
    texts = _texts(docs)
    return texts.mapInArrow(partial(_encode_batches, path=path, also_decode=False), _out(texts, False))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids) with decoded, the ids' text. Null ids decode to an empty text."""
    out = encoded.withColumn("decoded", F.lit(None).cast("string")).schema
    return encoded.mapInArrow(partial(_decode_batches, path=path), out)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """What decode(encode(docs)) gives, in one pass: a task needs one Python worker, not two."""
    texts = _texts(docs)
    return texts.mapInArrow(partial(_encode_batches, path=path, also_decode=True), _out(texts, True))


def joined(ids: Column) -> Column:
    """Decimal ids with commas between them."""
    return F.array_join(ids.cast("array<string>"), ",")
