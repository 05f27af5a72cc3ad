"""Piece encoding with seeded merge-dropout, and exact decoding.

Texts are cut into the pieces of a given model by byte-pair merging: candidate merges wait
in an agenda, the best one is done first, and neighbours of what it makes are added. A
candidate that comes up is skipped at the dropout rate; it stays skipped unless its parts are
formed anew. What is skipped is drawn anew for each occurrence of a word, by a hash of the
seed, the document and the word's place in it, so that a word has many segmentations within a
run. Another seed gives another segmentation, the same seed always the same one, on any
machine. Without dropout the ids are those of the model's own library.

The hash of each candidate of each occurrence tells if it is skipped, in long words and short
ones alike. How many candidates are merged before each skipped one decides what a word becomes,
so tables by word, and by word and these numbers, serve occurrences that skip the same. Words
and ways that no table has are merged together, thousands a step.

Decoding joins the pieces' bytes and gives back every text exactly: white space is kept,
characters that the model does not know are spelled in bytes, and so is the model's own sign
for a space where it occurs in a text.

Rows: a null or empty text has no pieces and decodes to the empty text. Long words are cut
as a whole. Repeated rows all stay; an empty table gives no rows. The query's document is its
text, so equal texts are cut alike there; ``encode_documents`` adds the doc_id where there is
one. Only doc_id and text are read by the query; ``encode_documents`` keeps all other columns,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import string
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from adtally.llm.common import importable, mixed, new_name, small_batches, table

#: The model's sign for a space, and how a text's own such sign is told from it.
SPACE, OWN_SIGN = "▁", "\0▁"
#: Words end before a space and before signs that no piece joins to a letter; a line feed is
#: a word, since no piece holds one.
WORDS = re.compile(r" *[^ \n\x01]+|\n| +")
WHOLE_WORDS = re.compile(r" *[^ \n]+|\n| +")
#: Set where a word is cut, if the text has no such character of its own.
CUT = "\x01"
#: Letters and digits after which a sign may begin a word.
BEFORE_SIGNS = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Segmentations kept per worker and table, and the length up to which words are kept.
WORD_CACHE, SHORT = 100_000, 48
#: Characters of texts that are cut together, and words that are merged together.
BLOCK_CHARS, BLOCK_WORDS = 400_000, 4096
#: The meeting at which a word or way goes to its table.
MEETINGS = 8
#: The value of a place without a candidate, and the symbol of one that was merged away.
NO_VALUE, GONE = np.iinfo(np.int32).max, -1
MASK = 2**64 - 1
#: The step between the hashes of a text's words (odd), and the factors of a candidate's hash.
NEXT_WORD = np.uint64(0x9E3779B97F4A7C15)
FIRST_FACTOR, SECOND_FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Pieces:
    """A model's vocabulary, ready for merging and decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} joins words")
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_.append(piece.replace(SPACE, " ").encode())
        if len(set(self.byte_ids)) < 256:
            raise ValueError("the model cannot spell bytes")
        # Signs that no piece joins to a letter or digit before them: words end there.
        joined = re.compile(f"[{BEFORE_SIGNS}](.)", re.DOTALL)
        after = {c for piece in self.ids for c in joined.findall(piece)}
        after |= {b for piece in self.ids for a, b in zip(piece, piece[1:]) if a.isalpha()}
        signs = "".join(sorted(set(string.punctuation) - after))
        self.seam = re.compile(f"[{re.escape(signs)}](?<=[{BEFORE_SIGNS}].)") if signs else None
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Symbols as numbers, and the pairs of them that are pieces, in order.

        A symbol's number is that of its piece, or of its character above all pieces; a space's
        stands for the sign, and the sign's for a text's own one.
        """
        n = self.n_pieces = len(self.bytes_)
        self.symbols = np.arange(n, n + sys.maxunicode + 1)
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.symbols[ord(piece)] = i
        self.symbols[ord(" ")] = self.ids.get(SPACE, n + ord(" "))
        self.border = n + sys.maxunicode + 1  # stands beside a word's ends; in no pair
        ranks = np.unique([-score for score in self.score.values()], return_inverse=True)[1]
        pairs = []
        for (piece, i), rank in zip(self.ids.items(), ranks.tolist()):
            for k in range(1, len(piece)):
                a, b = self._symbol(piece[:k]), self._symbol(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a * (self.border + 1) + b, rank, i))
        pairs.append((np.iinfo(np.int64).max, 0, 0))  # so that every search ends at a pair
        self.pair_keys, pair_ranks, self.pair_pieces = np.array(sorted(pairs)).T.copy()
        self.pair_values = pair_ranks.astype(np.int32) << 6

    def _symbol(self, text: str) -> int | None:
        if len(text) == 1:
            return int(self.symbols[ord(" " if text == SPACE else text)])
        return self.ids.get(text)

    def _candidates(
        self, a: np.ndarray, b: np.ndarray, places: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Values of the pairs, the least of which is merged first, and where the pairs are."""
        keys = a * (self.border + 1) + b
        at = np.searchsorted(self.pair_keys, keys)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_values[at] | places.astype(np.int32), NO_VALUE), at

    def merge_all(self, words: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        """The ids of each word under its own key: those of ``merge_keyed``, many at a time."""
        out = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lens > SHORT).tolist():
            out[i] = array("i", self.merge_keyed(words[i], dropout, int(keys[i]))).tobytes()
        order = np.argsort(lens, kind="stable")
        order = order[np.searchsorted(lens[order], 1) : np.searchsorted(lens[order], SHORT, "right")]
        low = 0
        while low < len(order):
            longest = lens[order[low]] * 5 // 4 + 1  # like lengths, so that little is empty
            high = low + np.searchsorted(lens[order[low : low + BLOCK_WORDS]], longest, "right")
            some = order[low:high]
            own = [words[i] for i in some.tolist()]
            ids, counts = self._merge_block(own, lens[some], keys[some], int(dropout * 2**64))
            data, ends = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, start, end in zip(some.tolist(), [0, *ends], ends):
                out[i] = data[start:end]
            low = high
        return out

    def _merge_block(
        self, words: list[str], lens: np.ndarray, keys: np.ndarray, limit: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has. Arrays hold a row a place, a column a word."""
        width, height = len(words), int(lens.max())
        ends = np.cumsum(lens)
        cells = (np.arange(ends[-1]) - np.repeat(ends - lens, lens)) * width
        cells += np.repeat(np.arange(width), lens)
        symbols = np.full((height + 1) * width, self.border)
        text = "".join(words).encode("utf-32-le", "surrogatepass")
        symbols[cells] = self.symbols[np.frombuffer(text, "<u4")]
        places = np.repeat(np.arange(height + 1), width)
        after, before = places + 1, places - 1
        before[:width] = height  # a border
        values, pairs = self._candidates(symbols, np.roll(symbols, -width), places)
        live = np.arange(width)
        while True:
            best = values.reshape(height + 1, width).take(live, axis=1).min(axis=0)
            some = best != NO_VALUE
            live, a = live[some], (best[some] & 63).astype(np.int64)
            if not len(live):
                break
            here = a * width + live
            b = after[here]
            there = b * width + live
            c = after[there]
            skip = skips(keys[live], (a << 42 | b << 21 | c).view(np.uint64), limit)
            values[here[skip]] = NO_VALUE
            kept = ~skip
            a, c, here, there, column = a[kept], c[kept], here[kept], there[kept], live[kept]
            made = self.pair_pieces[pairs[here]]
            symbols[here], symbols[there], values[there] = made, GONE, NO_VALUE
            after[here] = c
            beyond = c * width + column
            before[beyond] = a
            values[here], pairs[here] = self._candidates(made, symbols[beyond], a)
            left = before[here]
            at = left * width + column
            values[at], pairs[at] = self._candidates(symbols[at], made, left)
        by_word = symbols.reshape(height + 1, width).T
        stays = (by_word != GONE) & (by_word != self.border)
        return self._spelled(by_word[stays], stays.sum(axis=1))

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, in bytes if they are no pieces, and how many each word has."""
        strange = symbols >= self.n_pieces
        if not strange.any():
            return symbols, counts
        codes = (symbols[strange] - self.n_pieces).tolist()
        spelled = [(SPACE if c == ord(" ") else chr(c)).encode("utf-8") for c in codes]
        sizes = np.ones(len(symbols), np.int64)
        sizes[strange] = list(map(len, spelled))
        owner = np.repeat(np.repeat(np.arange(len(counts)), counts), sizes)
        ids = np.repeat(symbols, sizes)
        ids[np.repeat(strange, sizes)] = [self.byte_ids[b] for b in b"".join(spelled)]
        return ids, np.bincount(owner, minlength=len(counts))

    def merge(self, word: str, dropout: float, seed: int) -> list[int]:
        """The ids of one word, spaces first; a candidate's hash tells if it is skipped."""
        return self.merge_keyed(word, dropout, xxhash.xxh64_intdigest(word, seed))

    def merge_keyed(self, word: str, dropout: float, key: int) -> list[int]:
        limit = int(dropout * 2**64)
        if len(word) <= SHORT:
            return self.walk(word, (), key, limit)[1]

        def skipped(a: int, b: int, c: int) -> bool:
            h = (key ^ (a << 42 | b << 21 | c)) * FIRST_FACTOR & MASK
            h = (h ^ h >> 32) * SECOND_FACTOR & MASK
            return h ^ h >> 32 < limit

        return self._merge(word, skipped if limit else None)

    def walk(
        self, word: str, gaps: tuple[int, ...], key: int = 0, limit: int = 0
    ) -> tuple[list[int], list[int]]:
        """The ids if so many candidates are merged before each skipped one, all after the last.

        Also tells, as numbers, the candidates that are merged after the last skipped one. With
        a ``limit``, their hashes under ``key`` tell which ones are skipped. The agenda of a
        short word is a list of its neighbours' scores, whose best is looked for.
        """
        symbols = _symbols(word)
        get, none = self.score.get, -math.inf
        scores = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        starts = list(range(len(symbols) + 1))
        ends, codes, run = list(gaps[::-1]), [], 0
        skip = ends.pop() if ends else -1
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            if run == skip:
                scores[i], run = none, 0
                skip = ends.pop() if ends else -1
                continue
            run += 1
            if skip < 0:
                code = starts[i] << 42 | starts[i + 1] << 21 | starts[i + 2]
                if limit:
                    h = (key ^ code) * FIRST_FACTOR & MASK
                    h = (h ^ h >> 32) * SECOND_FACTOR & MASK
                    if h ^ h >> 32 < limit:
                        scores[i] = none
                        continue
                codes.append(code)
            made = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], starts[i + 1], scores[i]
            if i:
                scores[i - 1] = get(symbols[i - 1] + made, none)
            if i < len(scores):
                scores[i] = get(made + symbols[i + 1], none)
        return codes, self._ids(symbols)

    def _merge(self, word: str, skipped: Callable[[int, int, int], bool] | None) -> list[int]:
        symbols = _symbols(word)
        end = len(symbols)
        left = list(range(-1, end - 1))  # where the symbol before this one begins
        stop = list(range(1, end + 1))  # where this one ends, and the next begins
        score, agenda = self.score, []

        def offer(a: int, b: int) -> None:
            found = score.get(symbols[a] + symbols[b])
            if found is not None:
                agenda.append((-found, a, b, stop[b]))

        for a in range(end - 1):
            offer(a, a + 1)
        heapq.heapify(agenda)
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            # Stale, if either part has been merged since.
            if not symbols[a] or not symbols[b] or stop[a] != b or stop[b] != c:
                continue
            if skipped and skipped(a, b, c):
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            stop[a] = c
            if c < end:
                left[c] = a
            for x, y in ((left[a], a), (a, c)):
                if 0 <= x and y < end:
                    found = score.get(symbols[x] + symbols[y])
                    if found is not None:
                        heapq.heappush(agenda, (-found, x, y, stop[y]))
        return self._ids(filter(None, symbols))

    def _ids(self, symbols: Iterable[str]) -> list[int]:
        out: list[int] = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is None:
                spelled = SPACE if symbol == OWN_SIGN else symbol
                out.extend(map(self.byte_ids.__getitem__, spelled.encode()))
            else:
                out.append(found)
        return out

    def decode(self, ids) -> str:
        """The text that ``ids`` spell, without the space put before it."""
        data = b"".join(map(self.bytes_.__getitem__, ids))
        return data.decode("utf-8", "replace").removeprefix(" ")


def _symbols(word: str) -> list[str]:
    symbols = list(word.replace(" ", SPACE))
    if SPACE in word:
        symbols = [OWN_SIGN if c == SPACE else s for c, s in zip(word, symbols)]
    return symbols


def skips(keys: np.ndarray, codes: np.ndarray, limit: int) -> np.ndarray:
    """Which candidates their hashes skip: that of ``merge_keyed``, over arrays."""
    h = (keys ^ codes) * np.uint64(FIRST_FACTOR)
    h = (h ^ h >> np.uint64(32)) * np.uint64(SECOND_FACTOR)
    if limit > MASK:
        return np.ones(len(h), bool)
    return h ^ h >> np.uint64(32) < np.uint64(limit)


#: The number of what is in no table.
ALONE = 0


class Segmentations:
    """Numbered segmentations of words: their ids, and the candidates merged on the way.

    A key is a word that skips none, or a word and its numbers of merges before each skipped
    candidate; the candidates are those after the last skipped one.
    """

    def __init__(self):
        self.number: dict[str | tuple, int] = {}
        self.ids: list[bytes] = []
        self.counts, self.starts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.codes, self.held = np.zeros(8192, np.uint64), 0
        self.add("", (), b"")  # ALONE

    def add(self, key: str | tuple, codes, ids: bytes) -> int:
        k, end = len(self.ids), self.held + len(codes)
        if k == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(k, np.int64)])
            self.starts = np.concatenate([self.starts, np.zeros(k, np.int64)])
        if end > len(self.codes):
            more = np.zeros(max(len(self.codes), len(codes)), np.uint64)
            self.codes = np.concatenate([self.codes, more])
        self.codes[self.held : end] = codes
        self.counts[k], self.starts[k], self.held = len(codes), self.held, end
        self.ids.append(ids)
        self.number[key] = k
        return k

    def candidates(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k] + self.counts[k]]


class Encoder:
    """Encodes texts under one seed; most segmentations recur and come from bounded tables.

    There is one for words and one for their ways; when one is full it becomes the former one,
    from which what is met again moves on. What is met for the first times is merged on its own,
    with the same hashes and thus the same result, and goes to a table at the ``MEETINGS``th.
    """

    def __init__(self, model_path: str, dropout: float, seed: int):
        self.pieces, self.dropout, self.seed = Pieces(model_path), dropout, seed
        self.forget()

    def forget(self) -> None:
        self.words, self.ways = Segmentations(), Segmentations()
        self.old_words, self.old_ways = Segmentations(), Segmentations()
        self.met: dict[int, int] = {}  # how often what is in no table was met, by its hash

    def _learn(self, now: Segmentations, old: Segmentations, key: str | tuple) -> int:
        """The key's number in a table, or ``ALONE`` if it is to be merged on its own."""
        k = old.number.get(key)
        if k is not None:
            return now.add(key, old.candidates(k), old.ids[k])
        word, gaps = (key, ()) if type(key) is str else (key[0], key[1:])
        if self.dropout > 0:
            if len(word) > SHORT:
                return ALONE
            mark = hash(key)
            times = self.met.get(mark, 0) + 1
            if times < MEETINGS:
                self.met[mark] = times
                return ALONE
        codes, ids = self.pieces.walk(word, gaps)
        return now.add(key, codes, array("i", ids).tobytes())

    def _words(self, text: str) -> list[str]:
        if CUT in text:
            return WHOLE_WORDS.findall(" " + text)
        if self.pieces.seam:
            return WORDS.findall(" " + self.pieces.seam.sub(rf"{CUT}\g<0>", text))
        return WORDS.findall(" " + text)

    def __call__(self, text: str | None, doc_id: object = None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.many([text], [doc_id])[0]

    def many(self, texts: list[str | None], doc_ids: list) -> list[bytes]:
        """The ids of each text, by itself; texts are cut together up to a bounded length."""
        out, low, chars = [], 0, 0
        for high, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars >= BLOCK_CHARS or high == len(texts):
                out += self._block(texts[low:high], doc_ids[low:high])
                low, chars = high, 0
        return out

    def _block(self, texts: list[str | None], doc_ids: list) -> list[bytes]:
        if len(self.words.ids) > WORD_CACHE:
            self.words, self.old_words = Segmentations(), self.words
        if len(self.ways.ids) > WORD_CACHE:
            self.ways, self.old_ways = Segmentations(), self.ways
        if len(self.met) > 4 * WORD_CACHE:
            self.met.clear()
        words, ends, keys = [], [0], []
        for text, doc_id in zip(texts, doc_ids):
            if text:
                words += self._words(text)
                if self.dropout > 0:
                    keys.append(self._keys(text, doc_id, len(words) - ends[-1]))
            ends.append(len(words))
        known = self.words.number
        numbers = list(map(known.get, words))
        if None in numbers:
            late = {
                word: self._learn(self.words, self.old_words, word)
                for word in set(words).difference(known)
            }
            numbers = [late[w] if k is None else k for w, k in zip(words, numbers)]
        out = list(map(self.words.ids.__getitem__, numbers))
        if keys:
            self._skip(words, np.array(numbers), np.concatenate(keys), out)
        return [b"".join(out[low:high]) for low, high in zip(ends, ends[1:])]

    def _keys(self, text: str, doc_id, n_words: int) -> np.ndarray:
        """A key for each word's place."""
        key = self.seed & MASK
        if doc_id is not None:
            key = xxhash.xxh64_intdigest(str(doc_id), key)
        key = np.uint64(xxhash.xxh64_intdigest(text, key))
        return mixed(key + NEXT_WORD * np.arange(1, n_words + 1, dtype=np.uint64))

    def _skip(self, words: list[str], numbers: np.ndarray, keys: np.ndarray, out: list) -> None:
        """Puts the segmentations into ``out`` of all words that skip some candidate.

        Every candidate of every occurrence is hashed. An occurrence's first one that is skipped
        leads to another way, whose further candidates are hashed in the next round.
        """
        all_keys, alone = keys, np.flatnonzero(numbers == ALONE).tolist()
        limit = int(self.dropout * 2**64)
        held, at, paths = self.words, np.arange(len(words)), words
        while len(at):
            counts = held.counts[numbers]
            before = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(at)), counts)
            places = np.arange(len(owner)) + np.repeat(held.starts[numbers] - before, counts)
            hit = np.flatnonzero(skips(keys[owner], held.codes[places], limit))
            own = owner[hit]
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            some, hit = own[first], hit[first]
            at, keys, further, numbers = at[some], keys[some], [], []
            known, ids = self.ways.number, self.ways.ids
            gaps = (hit - before[some]).tolist()
            for i, j, gap in zip(at.tolist(), some.tolist(), gaps):
                path = paths[j]
                path = (path, gap) if type(path) is str else (*path, gap)
                k = known.get(path)
                if k is None:
                    k = self._learn(self.ways, self.old_ways, path)
                numbers.append(k)
                if k == ALONE:
                    alone.append(i)
                else:
                    out[i] = ids[k]
                further.append(path)
            held, paths, numbers = self.ways, further, np.array(numbers, np.int64)
        made = self.pieces.merge_all([words[i] for i in alone], all_keys[alone], self.dropout)
        for i, ids in zip(alone, made):
            out[i] = ids


_encoders: dict[tuple, Encoder] = {}


def encoder(model_path: str, dropout: float, seed: int) -> Encoder:
    """One per worker, model and seed."""
    key = (model_path, dropout, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode_documents(
    docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, into: str = "pieces"
) -> DataFrame:
    """``docs`` with their ids as an array column, named anew if the name is taken.

    Documents are told apart by text and, if there is such a column, doc_id. A map over the
    rows, without a shuffle. ``seed`` is that of a pass over the data: the next pass takes
    another one to see other segmentations.
    """
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    field = StructField(new_name(docs.columns, into), ArrayType(IntegerType()))
    schema = StructType([*docs.schema.fields, field])
    names = [c.lower() for c in docs.columns]
    text_at = names.index("text")
    id_at = names.index("doc_id") if "doc_id" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path, dropout, seed)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(text_at).to_pylist()
                own = [None] * len(texts) if id_at is None else part.column(id_at).to_pylist()
                ids = encode.many(texts, own)
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                made = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, made], names=[*batch.schema.names, field.name]
                )
        encode.forget()  # the worker goes on to other work

    return docs.mapInArrow(run, schema)


ROUND_TRIP = (
    "doc_id BIGINT, n_pieces BIGINT, pieces_crc32 BIGINT, decoded_sha256 STRING, lossless BOOLEAN"
)


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """What each text is cut into, and the digest of what its pieces decode to."""

    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path, dropout, seed)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                doc_ids, texts = (c.slice(low, 512) for c in batch.columns)
                texts = texts.to_pylist()
                made = encode.many(texts, [None] * len(texts))
                back = [encode.pieces.decode(np.frombuffer(ids, "<i4").tolist()) for ids in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array([len(ids) // 4 for ids in made], pa.int64()),
                        pa.array(map(zlib.crc32, made), pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                        pa.array([x == (text or "") for x, text in zip(back, texts)]),
                    ],
                    names=["doc_id", "n_pieces", "pieces_crc32", "decoded_sha256", "lossless"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, ROUND_TRIP)


#: Rate and seed of the registered query and of the pipeline's stage.
DROPOUT, SEED = 0.1, 20240201


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut with dropout, and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), model_path(), DROPOUT, SEED)
