"""Language identification by compression.

Each language gets a few zstandard raw-content dictionaries, cut from a bounded
sample of labelled texts. A text is encoded, piece by piece over its whole
length, with every language's dictionaries; the language with the smallest
total wins. The relative margin to the runner-up is the score, and a narrow
margin marks the answer as rejected.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import map_texts

SAMPLE_DOCS = 400            # labelled documents per language, at most (fit only)
SAMPLE_BYTES = 3_000         # of each of them
DICTIONARIES = 4             # per language
DICTIONARY_BYTES = 100_000
MAX_LANGUAGES = 500          # distinct labels that a model may have
PIECE = 1_500                # bytes encoded at once; every piece of the text counts
SHORT = 1_500                 # up to here all dictionaries are used, for finer totals
MARGIN = 0.02
LEVEL, MIN_MATCH = 3, 3      # with optimal parsing: short common letter groups count too
UNDETERMINED = "und"

_letter = regex.compile(r"\p{L}").search


def fit(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> dict[str, list[bytes]]:
    """Language -> raw dictionaries (languages with more documents first), from at most SAMPLE_DOCS documents a language.

    The sample is bounded by parameters, whatever the table's size: a count per
    language sets a hash threshold, so that only about three times the wanted rows are
    ranked. More than MAX_LANGUAGES labels raise ValueError: none is left out. Null texts, null or empty labels and texts without a letter teach nothing.
    """
    df = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                         F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("h"))
    df = df.where(F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("lang") != UNDETERMINED)
                  & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labelled languages; the model would leave some out")
    if not sizes:
        return {}
    limits = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items())
                            for v in (lang, min(1 << 30, 3 * SAMPLE_DOCS * (1 << 30) // n + 1))])
    near = df.where(F.col("h") < F.element_at(limits, F.col("lang")))
    piece = F.struct("h", F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    top = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(piece)), 1, SAMPLE_DOCS).alias("rows"))
    model = {}
    rows = top.collect()  # at most MAX_LANGUAGES x SAMPLE_DOCS x SAMPLE_BYTES characters
    for row in sorted(rows, key=lambda r: (-sizes[r["lang"]], r["lang"])):
        texts = [r["text"].encode("utf-8", "surrogatepass") for r in row["rows"]]
        model[row["lang"]] = [b"\n".join(texts[k::DICTIONARIES])[-DICTIONARY_BYTES:] for k in range(DICTIONARIES)]
    return model


class Encoder:
    """The compressors of one model, built once per Python worker."""

    def __init__(self, model: dict[str, list[bytes]]):
        import zstandard as zstd
        self.langs = list(model)
        self.encode = [[self._encoder(zstd, raw) for raw in model[lang] if raw] for lang in self.langs]

    @staticmethod
    def _encoder(zstd, raw: bytes):
        how = zstd.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), source_size=PIECE, strategy=zstd.STRATEGY_BTOPT, min_match=MIN_MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstd.ZstdCompressor(dict_data=d, compression_params=how).compress

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); ``und`` and 0 for null, letterless text or an empty model."""
        if not text or not self.langs or not _letter(text):
            return UNDETERMINED, 0.0
        raw = (text.lower() if text.isupper() else text).encode("utf-8", "surrogatepass")
        pieces = [raw] if len(raw) <= PIECE else [raw[k:k + PIECE] for k in range(0, len(raw), PIECE)]
        sizes = []
        for encoders in self.encode:
            if len(raw) <= SHORT:
                total = sum(len(e(raw)) for e in encoders) / len(encoders)
            else:  # one dictionary a piece, in turn
                total = sum(len(encoders[k % len(encoders)](p)) for k, p in enumerate(pieces))
            sizes.append(total)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = 1.0 if not rest else (min(rest) - sizes[best]) / min(rest)
        return self.langs[best], max(0.0, min(1.0, margin))


_ENCODERS: dict[int, Encoder] = {}


def identify(docs: DataFrame, model: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row.

    ``lang_pred`` is the language of the smallest encoding (equal sizes: the
    one with more labelled documents). ``rejected`` is true when the margin is narrower than
    ``margin`` or nothing could be said (null, empty or letterless text: ``und``, 0).
    The model travels to each task as one broadcast of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(texts: list) -> dict:
        key = id(shared.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        out = [_ENCODERS[key].classify(t) for t in texts]
        return {"lang_pred": pa.array([x for x, _ in out], pa.string()),
                "score": pa.array([s for _, s in out], pa.float64()),
                "rejected": pa.array([s < margin for _, s in out], pa.bool_())}

    return map_texts(docs, "lang_pred string, score double, rejected boolean", columns, id_col, text_col)


def held_out(doc_id: Column) -> Column:
    """Documents kept for measuring: crc32 of the id's text leaves remainder 1 by 3 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
