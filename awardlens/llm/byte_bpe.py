"""Byte-level BPE encoding and decoding by replaying the merges over a vocabulary of words."""

import base64
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, runs, shared_file, texts_of


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.split(b"\n")[:-1])}


def read_tokens(data: bytes) -> dict[int, bytes]:
    """Rank -> token bytes."""
    return {rank: token for token, rank in read_ranks(data).items()}


class MergeReplay:
    """Encodes many words at once by applying the merges in rank order.

    All words lie in one array of symbols. An inverted index leads from the rank of a token
    pair to the places where the pair stands; each rank is applied at all its places, and
    only the two neighbours of a place are looked at again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.whole = {token: np.array([rank], "<i4").tobytes() for token, rank in ranks.items()}
        # joins[a][b]: rank of what the tokens a and b make together. The last dictionary
        # is that of the mark between words, which joins with nothing.
        self.end = max(ranks.values()) + 1
        self.joins: list[dict[int, int]] = [{} for _ in range(self.end + 1)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                one, other = ranks.get(token[:cut]), ranks.get(token[cut:])
                if one is not None and other is not None:
                    self.joins[one][other] = rank
        # The same for single bytes, as arrays. No UTF-8 text has the byte 255: it is the mark.
        self.single = np.array([ranks.get(bytes([b]), self.end) for b in range(256)], np.int32)
        self.single[255] = self.end
        self.of_bytes = np.full((256, 256), -1, np.int32)
        for a in range(255):
            for b in range(255):
                self.of_bytes[a, b] = ranks.get(bytes([a, b]), -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers; words are UTF-8 and not empty."""
        found = list(map(self.whole.get, words))  # a word that is a token needs no merges
        rest = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if rest:
            replayed = iter(self._replay(rest))
            found = [next(replayed) if ids is None else ids for ids in found]
        return found

    def _replay(self, words: list[bytes]) -> list[bytes]:
        end, joins = self.end, self.joins
        data = np.frombuffer(b"\xff".join(words) + b"\xff\xff", np.uint8)[:-1]
        symbols = self.single[data].tolist()
        size = len(symbols)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        pairs = self.of_bytes[data[:-1], data[1:]]
        standing = [*pairs.tolist(), -1]  # rank of the pair that starts at a place
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        first = np.flatnonzero(np.diff(pairs[at], prepend=-1))
        stands, bounds = at.tolist(), [*first.tolist(), len(at)]
        places: dict[int, list[int]] = {
            rank: stands[a:b]
            for rank, a, b in zip(pairs[at[first]].tolist(), bounds, bounds[1:], strict=False)
        }
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            here = places.pop(rank)
            if len(here) > 1:
                here.sort()
            later: list[int] = []
            stopped = -1  # places before this one belong to a word with an earlier merge to do
            beyond = joins[rank]
            for at in here:
                if standing[at] != rank:
                    continue
                if at < stopped:
                    later.append(at)
                    continue
                follow, before = right[at], left[at]
                after = right[follow]
                symbols[at], right[at], left[after], standing[follow] = rank, after, at, -1
                symbols[follow] = -1
                one = joins[symbols[before]].get(rank, -1)
                other = beyond.get(symbols[after], -1)
                standing[before], standing[at] = one, other
                if one >= 0:
                    if one in places:
                        places[one].append(before)
                    else:
                        places[one] = [before]
                        heapq.heappush(queue, one)
                if other >= 0:
                    if other in places:
                        places[other].append(at)
                    else:
                        places[other] = [at]
                        heapq.heappush(queue, other)
                if 0 <= one < rank or 0 <= other < rank:
                    stopped = at
                    while symbols[stopped] != end:
                        stopped = right[stopped]
            if later:
                if rank in places:
                    places[rank].extend(later)
                else:
                    places[rank] = later
                    heapq.heappush(queue, rank)
        ids = np.array(symbols, "<i4")
        ids = ids[ids >= 0]
        ends = np.flatnonzero(ids == end)
        blob, begin = ids.tobytes(), 0
        out = []
        for stop in (4 * ends).tolist():
            out.append(blob[begin:stop])
            begin = stop + 4
        return out


def _slices(words: Iterable[str], size: int = 300_000) -> Iterator[list[str]]:
    words = iter(words)
    while part := list(islice(words, size)):
        yield part


class Memory:
    """Key -> value for at most two generations of about ``limit`` keys."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def absent(self, keys: set) -> list:
        """The keys that are not remembered; those that are can be looked up in ``young``."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        out = []
        for key in keys.difference(self.young):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.young[key] = value
        return out


#: Ids are decoded in runs of about so many.
DECODED_IDS = 250_000

#: A space beside other white space, with which it may be one word (``\s+(?!\S)``).
_SPACE_IN_WORD = re.compile(r" (?:\s|(?<=\s ))")


class CorpusEncoder:
    """Texts to ids: finds the words, replays the merges over those not met yet.

    Only words of white space have a space that is not their first character. So texts
    whose spaces have no white space of any kind beside them are cut at their spaces, and
    the pieces, most of them well known, are looked up whole; other texts go word by word.
    """

    def __init__(self, data: bytes, pattern: str):
        self.replay = MergeReplay(read_ranks(data))
        self.find = regex.compile(pattern)
        self.words, self.pieces = Memory(250_000), Memory(250_000)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids by word, for all of these words at least."""
        for part in _slices(self.words.absent(words), 50_000):
            encoded = self.replay.encode([word.encode() for word in part])
            self.words.young.update(zip(part, encoded, strict=True))
        return self.words.young

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; the new words of all are replayed at once."""
        cut = [None if _SPACE_IN_WORD.search(text) else text.split(" ") for text in texts]
        met = set().union(*filter(None, cut))
        new = {piece: self.find.findall(" " + piece) for piece in self.pieces.absent(met)}
        firsts = [self.find.findall(parts[0]) if parts else () for parts in cut]
        pieces = self.pieces.young
        # Most pieces are one word. It is remembered as the piece alone, not as a word besides.
        for part in _slices((piece for piece, words in new.items() if len(words) == 1), 50_000):
            encoded = self.replay.encode([new[piece][0].encode() for piece in part])
            pieces.update(zip(part, encoded, strict=True))
        several = {piece: words for piece, words in new.items() if len(words) != 1}
        known = self._learn(set().union(*several.values(), *firsts))
        for piece, words in several.items():
            pieces[piece] = b"".join(map(known.__getitem__, words))
        return [
            self._by_word(text)
            if parts is None
            else b"".join(map(known.__getitem__, first)) + b"".join(map(pieces.__getitem__, islice(parts, 1, None)))
            for text, parts, first in zip(texts, cut, firsts, strict=True)
        ]

    def _by_word(self, text: str) -> bytes:
        if len(text) < 1_000_000:
            found = [self.find.findall(text)]
        else:
            found = _slices(match.group() for match in self.find.finditer(text))
        return b"".join([b"".join(map(self._learn(set(words)).__getitem__, words)) for words in found])


def _ids_column(ids: list[bytes]) -> pa.Array:
    values = pa.Array.from_buffers(
        pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))]
    )
    ends = [0]
    for part in ids:
        ends.append(ends[-1] + len(part) // 4)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text, as the rank file has them.

    The corpus lies in Spark's input partitions and stays there: each task replays the
    merges over the distinct words of its share, a run of texts at a time, and remembers a
    bounded number of words. A word's ids don't depend on the share, so nothing is shuffled
    and a lost task is simply run again. The worker keeps these words for its next task.
    Memory: one run of texts (4 MB or one text).

    Null and empty texts have no ids. Repeated rows give a row each; a null ``doc_id`` stays
    null; an empty table gives no rows; other columns are ignored.
    """
    data = shared_file(docs.sparkSession, vocabulary)

    def encoded(batches):
        key = "encoder", zlib.crc32(data.value), pattern
        encoder = resident("byte_bpe", key, lambda: CorpusEncoder(data.value, pattern))
        for batch in runs(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_column(ids)], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def _runs_of_ids(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``DECODED_IDS`` ids, one row at least."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(ids_col))
        start, size = 0, 0
        for row, length in enumerate(pc.list_value_length(ids).to_pylist()):
            size += length or 0
            if size >= DECODED_IDS:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``ids_col`` replaced by ``decoded``, the bytes of its tokens.

    Null ids give null, no ids give no bytes, an id without a token is an error.
    """
    data = shared_file(rows.sparkSession, vocabulary)
    others = [field for field in rows.schema.fields if field.name != ids_col]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in others)

    def decoded(batches):
        key = "tokens", zlib.crc32(data.value)
        token = resident("byte_bpe", key, lambda: read_tokens(data.value)).__getitem__
        for batch in _runs_of_ids(batches, ids_col):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            texts = [None if not row.is_valid else b"".join(map(token, row.values.to_numpy(zero_copy_only=False).tolist())) for row in ids]
            kept = [batch.column(batch.schema.get_field_index(field.name)) for field in others]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.binary())], [*(field.name for field in others), "decoded"]
            )

    return rows.mapInArrow(decoded, f"{schema}, decoded binary")


def ids_text(ids: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
