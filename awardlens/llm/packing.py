"""Packing of tokenized documents into windows by sum of squares."""

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WordCache, resident, shared_file, texts_of

# The word pattern of the vocabulary, and the byte alphabet it is written in.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space to the Python string methods, but not to the vocabulary's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks that need no Unicode rules: printable ASCII and the letters of Latin-1.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


#: Words, and chunks of words, that a worker remembers in either of two generations.
KNOWN_WORDS = 300_000


class WordTokenizer:
    """Ids of texts under a vocabulary whose words never reach across white space.

    So a text is encoded chunk by chunk, and each chunk once as long as it is remembered.
    Chunks of plain letters go straight to the vocabulary's merges; all others, and texts
    with separators that Python and the vocabulary split differently, take the full way.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(data.decode())
        self.merges = self.full.model
        self.words = regex.compile(WORDS)
        spare = iter(range(256, 512))
        self.known = WordCache(self._word, KNOWN_WORDS)
        self.alphabet = {b: chr(b if b in PRINTABLE else next(spare)) for b in range(256)}
        self.chunks = WordCache(self._chunk, KNOWN_WORDS)

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.known.__getitem__, self.words.findall(chunk.lower())))
        return np.array(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.alphabet.get, word.encode()))
        return b"".join([token.id.to_bytes(4, "little") for token in self.merges.tokenize(spelled)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()  # so that fewer chunks differ
        except UnicodeEncodeError:
            if not unicodedata.is_normalized("NFC", text):
                return self._all(text)
        if SEPARATORS.search(text):
            return self._all(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def _all(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class SumOfSquares:
    """Windows being filled online: the level array counts the open windows by fill.

    A piece goes to the level that leaves the smallest sum of squared counts; a new window
    is level 0. Ties go to the fullest window. Pieces of open windows are held back, at
    most ``window`` ids each, so that the last open windows can still be joined up.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple) -> list | None:
        """Put ``(doc_id, start, ids, total)`` into a window; the window, once it is full."""
        size, end = len(piece[2]) // 4, self.window
        if size == end:
            return [piece]
        # Moving a window from level h to h + size changes the sum of squares by
        # 2 (counts[h + size] - counts[h]) + 2; the ends of the array lack one of the terms.
        left, right = self.counts[: end - size + 1], self.counts[size:]
        change = 2 * (right - left) + 2
        change[-1] = 1 - 2 * left[-1]
        usable = left > 0
        change[0] = 2 * right[0] + 1 if size < end else 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        level = int(len(change) - 1 - np.argmin(change[::-1]))
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append(piece)
        if level + size == end:
            return pieces
        self.counts[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        return None

    def close(self) -> list[list]:
        """Join the open windows: cut the pieces of the emptiest to fill the fullest.

        What is left at the end is laid out in sequences whose lengths are powers of two,
        the largest first: those need no padding.
        """
        rest = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.counts[:] = {}, 0
        loose = [piece for _, pieces in rest for piece in pieces]  # the emptiest windows first
        closed, total = [], sum(len(piece[2]) // 4 for piece in loose)
        whole = total // self.window
        for level, pieces in reversed(rest[len(rest) - whole :] if whole else []):
            del loose[len(loose) - len(pieces) :]
            closed.append((pieces, self.window - level))
        left = total - whole * self.window
        closed += [([], 1 << bit) for bit in reversed(range(left.bit_length())) if left >> bit & 1]
        for pieces, room in closed:
            while room:
                doc, start, ids, full = loose.pop()
                taken = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * taken], full))
                if 4 * taken < len(ids):
                    loose.append((doc, start + taken, ids[4 * taken :], full))
                room -= taken
        return [pieces for pieces, _ in closed]


SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long,"
    " token_ids binary"
)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Lay all documents out in sequences of at most ``window`` tokens, with no padding.

    Each document's ids are followed by ``end_id``. Full windows of a long document stand
    alone; what remains of it is placed by sum of squares. Returns one row per piece:
    ``doc_id``, ``start`` and ``length`` (in the document's ids), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence), ``token_ids`` (little-endian unsigned
    32-bit). Each task packs the rows it reads, so nothing is shuffled, no key is hot, and
    a task that is run again gives its sequences again. A sequence shorter than ``window``
    has a power of two as its length; a task makes at most ``log2(window)`` of those.

    Null and empty texts are one ``end_id``. Repeated rows are packed each. A null
    ``doc_id`` stays null. An empty table gives no rows. Other columns are ignored.
    """
    data = shared_file(docs.sparkSession, vocabulary)

    def packed(batches):
        # What a worker has learnt of words serves its next tasks too.
        tokenizer = resident("packing", zlib.crc32(data.value), lambda: WordTokenizer(data.value))
        packer = SumOfSquares(window)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(pieces) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, total, sequence, offset, ids))
                offset += len(ids) // 4
            sequence += 1

        def flush():
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [part.split()[0] for part in SCHEMA.split(",")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py()) + end
                total, cut = len(ids) // 4, 4 * window
                for at in range(0, len(ids), cut):
                    if full := packer.place((doc, at // 4, ids[at : at + cut], total)):
                        emit(full)
                if len(rows) >= 2000:
                    yield flush()
        for pieces in packer.close():
            emit(pieces)
        yield flush()

    return texts_of(docs).mapInArrow(packed, SCHEMA)
