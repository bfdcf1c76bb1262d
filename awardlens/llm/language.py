"""Language identification by compression."""

import math
import re
import zlib
from collections.abc import Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_sample, keep_rows, resident, ship, texts_of

UNKNOWN = "und"
LEVEL = 5
#: Texts are compressed in blocks of this many bytes, so that all of a long text is judged
#: by the dictionary and not by what came before in the text itself.
BLOCK = 2000
#: How fast the score falls with the relative size of the second language.
SHARPNESS = 60.0
#: A margin below this, relative to the smaller size, is too narrow, whatever was learnt.
MIN_MARGIN = 0.002
#: One document in so many is kept out of the dictionaries: cuts are learnt from its text.
APART = 5
#: Of what all but this share of a language's own texts reach, a text must have so much.
LOW_SHARE, PART = 0.02, 1 / 3
#: Fewer texts of a language and length class than this teach no cuts.
LEAST_TEXTS = 20
#: Texts to learn cuts from are measured at these lengths (bytes) and whole.
LENGTHS = (30, 60, 120, 250, 500, 1000)

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, everything but letters as one space."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


class Model(dict):
    """Dictionary content by language, and ``cuts``: by language and length class (margin, gain)."""

    def __init__(self, dictionaries: Mapping[str, bytes] = (), cuts: Mapping | None = None):
        super().__init__(dictionaries)
        self.cuts = dict(cuts or {})


def _compressor(**options) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **options
    )


class CompressionClassifier:
    """One raw-content dictionary per language; the smallest encoding wins."""

    def __init__(self, dictionaries: Mapping[str, bytes]):
        self.languages = sorted(dictionaries)
        self.cuts = getattr(dictionaries, "cuts", {})
        self.plain, self.compressors = _compressor(), []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(
                dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=LEVEL)
            self.compressors.append(_compressor(dict_data=content))

    def measure(self, data: bytes) -> tuple[list[int], int, int]:
        """Sizes by language, the size without a dictionary, and the class of its length.

        The class goes by what a block holds and not by its letters, which may repeat: the
        size without a dictionary, a block on average, up to the next power of two.
        """
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(block)) for block in blocks) for c in self.compressors]
        plain = sum(len(self.plain.compress(block)) for block in blocks)
        return sizes, plain, (plain // len(blocks)).bit_length()

    def cut(self, language: str, length_class: int) -> tuple[float, float | None]:
        """That of the class, or of the next smaller one that taught any: odd texts may hold more
        than any text of the language does."""
        for known in range(length_class, -1, -1):
            if (language, known) in self.cuts:
                return self.cuts[language, known]
        return 0.0, None

    def classify(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether it is accepted."""
        data = letters(text).encode()
        if not data or not self.languages:
            return UNKNOWN, 0.0, False
        sizes, plain, length_class = self.measure(data)
        least = min(sizes)
        weights = [math.exp(-SHARPNESS * (size / least - 1)) for size in sizes]
        language = self.languages[sizes.index(least)]
        margin, gain = margin_and_gain(sizes, plain)
        min_margin, min_gain = self.cut(language, length_class)
        accepted = margin >= max(min_margin, MIN_MARGIN) and (min_gain is None or gain >= min_gain)
        return language, 1.0 / sum(weights), accepted


def margin_and_gain(sizes: list[int], plain: int) -> tuple[float, float]:
    """How far the second size is above the least, and how far that is below the plain one."""
    least = min(sizes)
    second = sorted(sizes)[1] if len(sizes) > 1 else 2 * least
    return (second - least) / least, 1 - least / plain


def learn_cuts(docs: DataFrame, model: Model) -> dict[tuple[str, int], tuple[float, float | None]]:
    """What texts of each language and length class reach, from ``lang`` and ``piece`` of ``docs``.

    Pieces are measured at several lengths, in tasks; those told rightly count. One row per
    language and class comes to the driver. Where even a language's own texts gain nothing
    from its dictionary, no gain is asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        judge = classifier(shared.value)
        for batch in batches:
            rows = []
            for lang, piece in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                data = piece.encode()
                for length in (*(n for n in LENGTHS if n < len(data)), len(data)):
                    sizes, plain, length_class = judge.measure(data[:length])
                    if judge.languages[sizes.index(min(sizes))] == lang:
                        rows.append((lang, length_class, *margin_and_gain(sizes, plain)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), ["lang", "class", "margin", "gain"])

    rows = docs.select("lang", "piece").mapInArrow(measured, "lang string, class int, margin double, gain double")
    low = lambda name: F.percentile_approx(name, LOW_SHARE, 1000)
    found = rows.groupBy("lang", "class").agg(F.count(F.lit(1)), low("margin"), low("gain")).collect()
    return {
        (lang, of): (PART * margin, PART * gain if gain > 0 else None)
        for lang, of, n, margin, gain in found
        if n >= LEAST_TEXTS
    }


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    per_language: int = 1500,
    piece_chars: int = 500,
    dictionary_bytes: int = 262_144,
) -> Model:
    """A dictionary per language from at most ``per_language`` documents of each, and cuts.

    Each document gives a piece of ``piece_chars`` letters from a place its hash picks, and
    a dictionary ends at ``dictionary_bytes``. One document in ``APART`` gives up to ``BLOCK``
    letters for the cuts of margin and gain instead (``learn_cuts``); of a language with fewer
    all teach its dictionary. These bounds hold at any size of ``docs``, and so does what
    comes to the driver. Rows without language, text or letters teach nothing, nor
    do languages beyond the 1,000 with the most rows. Equal rows teach once.
    """
    rows = docs.select("doc_id", F.col(lang_col).cast("string").alias("lang"), "text")
    rows = rows.where(F.col("text").isNotNull())
    ship(docs.sparkSession)
    columns = ["lang", "piece", "apart", "sample mark", "sample draw"]

    def pieces(batches):
        for batch in batches:
            texts = [letters(text) for text in batch.column("text").to_pylist()]
            cut, apart = [], []
            for text in texts:
                mark = zlib.crc32(text.encode())
                size = BLOCK if mark % APART == 0 else piece_chars
                start = mark // APART % (max(0, len(text) - size) + 1)
                cut.append(text[start : start + size])
                apart.append(mark % APART == 0)
            marks = [batch.column(name) for name in columns[3:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(cut, pa.string()), pa.array(apart, pa.bool_()), *marks], columns
            )

    schema = "lang string, piece string, apart boolean, `sample mark` long, `sample draw` double"
    sample = bounded_sample(
        rows, "lang", per_language, shape=lambda drawn: drawn.mapInArrow(pieces, schema)
    )
    sample = staged(sample.where("piece <> ''"), "pieces")
    found: dict[str, list] = {}
    for row in sample.where("NOT apart").collect():
        found.setdefault(row.lang, []).append((zlib.crc32(row.piece.encode()), row.piece))
    lone = sample.groupBy("lang").agg(F.every("apart").alias("lone")).where("lone").select("lang")
    for row in sample.join(lone, "lang", "left_semi").collect():
        found.setdefault(row.lang, []).append((zlib.crc32(row.piece.encode()), row.piece[:piece_chars]))
    model = Model(
        (language, " ".join(piece for _, piece in sorted(of)).encode()[:dictionary_bytes])
        for language, of in found.items()
    )
    if model:
        model.cuts = learn_cuts(sample.where("apart").join(lone, "lang", "left_anti"), model)
    return model


def classifier(dictionaries: Mapping[str, bytes]) -> CompressionClassifier:
    """The prepared dictionaries, kept by the worker process."""
    marks = sorted((name, zlib.crc32(content)) for name, content in dictionaries.items())
    key = repr((marks, sorted(getattr(dictionaries, "cuts", {}).items())))
    return resident("language", key, lambda: CompressionClassifier(dictionaries))


def identify(docs: DataFrame, dictionaries: Mapping[str, bytes]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``accepted`` of every whole text.

    The text's letters are compressed with each language's dictionary and the smallest
    result names the language (ties: the first by name). ``score`` is that language's share
    of the weights. ``accepted`` is false where the runner-up is within ``MIN_MARGIN``, and where
    margin or gain (what the dictionary saves) are less than a third of what nearly all of that
    language's own texts of such a length reach, as in texts of languages that were not learnt.

    A text that is null, empty or without letters, or any text if nothing was learned, is
    ``und`` with score 0, not accepted. Long texts go block by block. Rows are independent:
    repeated rows give a row each, a null ``doc_id`` stays null, an empty table gives no
    rows, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def identified(batches):
        judge = classifier(model.value)
        for batch in batches:
            found = [judge.classify(text) for text in batch.column(1).to_pylist()]
            languages, scores, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(languages, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return texts_of(docs).mapInArrow(
        identified, "doc_id long, lang_pred string, score double, accepted boolean"
    )


def keep_identified(docs: DataFrame, dictionaries: Mapping[str, bytes]) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with enough margin."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def accept(texts):
        judge = classifier(model.value)
        return [judge.classify(text)[2] for text in texts]

    return keep_rows(docs, accept)
