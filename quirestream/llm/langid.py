"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled text. A text
belongs to the language whose dictionary compresses it to the fewest bytes; where the
best two differ by too little, the prediction is rejected. Long texts are compressed in
pieces, since the dictionary matters at the start of a frame, and the sizes are summed:
every piece counts.

Labelled rows: at most ``MAX_DOCS`` documents a language (those with the smallest hash
of their id) and ``MAX_BYTES`` bytes of dictionary are used, so the model has a fixed
size however many labels there are. A language with less labelled text keeps a smaller
dictionary, and the sizes it gives are multiplied by a factor of at most 1: what a
dictionary of that size costs the largest languages on labelled texts of their own, but
not so low that labelled texts of other languages would come near it. The labelled
texts for that are left out of the dictionaries that they are measured with.

Defined results: null text or no letter in it gives ``und``, score 0, rejected; ties go
to the first language in code-point order; languages without any labelled letter are
not learned; with none learned everything is ``und``; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.llm.naming import free
from quirestream.llm.sampling import smallest_hashes
from quirestream.llm.staging import small_batches

#: Bound of the labelled sample: documents a language, characters of a document, bytes of a dictionary.
MAX_DOCS, DOC_CHARS, MAX_BYTES = 400, 4000, 96_000
#: Characters of a piece; texts of up to this many are compressed with the stronger level.
PIECE, SHORT = 3000, 300
LEVEL, SHORT_LEVEL = 3, 12
#: Rejected where the second language needs less than this more, as a share of the best size.
MIN_MARGIN = 0.004
#: For the factors: every so many-th document of a language is measured, so many in all, and this share of them may come near another.
EVERY, MEASURED, NEAR = 10, 400, 0.01

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}']+")
_AGAIN = regex.compile(r"(?<![^ ])([^ ]+)(?: \1)+(?![^ ])")


def clean(text: str) -> str:
    """Lower-cased letters; all else is one space. A word that follows itself counts
    once: it would compress against itself, whatever the dictionary."""
    return _AGAIN.sub(r"\1", _OTHER.sub(" ", text.lower()).strip())


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", where: Column | None = None) -> dict[str, list[str]]:
    """The bounded sample of labelled rows, by language."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.col(text_col).alias("t"))
    ids = smallest_hashes(rows.select("i", "l"), "l", "i", MAX_DOCS)
    picked = {(r.l, r.i): r.rank for r in ids.collect()}  # MAX_DOCS a language
    wanted = docs.sparkSession.createDataFrame([(i,) for _, i in picked], f"i {docs.schema[id_col].dataType.simpleString()}") if picked else None
    out: dict[str, list[tuple[int, str]]] = {}
    if wanted is not None:
        for r in rows.join(F.broadcast(wanted.distinct()), "i", "left_semi").select("i", "l", F.substring("t", 1, DOC_CHARS).alias("t")).toLocalIterator():
            if (r.l, r.i) in picked:
                out.setdefault(r.l, []).append((picked[r.l, r.i], r.t))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


class Model:
    """Dictionaries by language; picklable, the compressors are made where it is used."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self._learn(texts)
        self._fit(texts)

    def _learn(self, texts: dict[str, list[str]]) -> None:
        self.words: dict[str, bytes] = {}
        for lang in sorted(texts):
            # zstandard reaches the end of a dictionary most cheaply: the first documents go last
            data = b" ".join(c.encode() for t in reversed(texts[lang]) if (c := clean(t)))
            if data:
                self.words[lang] = b" " + data[-MAX_BYTES:] + b" "
        self.langs = list(self.words)
        self.factors = np.ones(len(self.langs))

    def _fit(self, texts: dict[str, list[str]]) -> None:
        """Factors of the languages whose dictionaries are smaller than the largest."""
        most = max(map(len, self.words.values()), default=0)
        small = [k for k, lang in enumerate(self.langs) if len(self.words[lang]) < most]
        if not small:
            return
        each = max(2, MEASURED // len(self.langs))
        out = {lang: [t for t in texts[lang][EVERY - 1 :: EVERY] if clean(t)][:each] for lang in self.langs}
        probe = object.__new__(Model)
        probe._learn({lang: [t for i, t in enumerate(texts[lang]) if i % EVERY != EVERY - 1] for lang in self.langs})
        if probe.langs != self.langs or not any(out.values()):
            return
        sizes = {lang: np.array([probe.ready().sizes(t) for t in out[lang]]) for lang in self.langs if out[lang]}
        largest = sorted(sizes, key=lambda lang: -len(probe.words[lang]))[:3]
        for k in small:
            lang, size = self.langs[k], len(self.words[self.langs[k]])
            cut = object.__new__(Model)
            cut.words = {x: probe.words[x][-size:] for x in largest}
            cut.langs, cut.factors = list(largest), np.ones(len(largest))
            cost = [s[self.langs.index(x)] / cut.ready().sizes(t)[j] for j, x in enumerate(largest) if x != lang for s, t in zip(sizes[x], out[x], strict=True)]
            near = [np.delete(s, k).min() / s[k] for x, rows in sizes.items() if x != lang for s in rows if len(s) > 1]
            if cost and near:
                self.factors[k] = min(1.0, max(float(np.median(cost)), (1 + MIN_MARGIN) * float(np.quantile(near, 1 - NEAR))))

    def _compressors(self, level: int) -> list[zstd.ZstdCompressor]:
        made = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(self.words[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters.from_level(level, dict_size=len(self.words[lang]), format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3 if level > LEVEL else 4)
            d.precompute_compress(compression_params=params)
            made.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        return made

    def ready(self) -> Model:
        if not hasattr(self, "_long"):
            self._long, self._short = self._compressors(LEVEL), self._compressors(SHORT_LEVEL)
        return self

    def __getstate__(self) -> dict:
        return {"words": self.words, "langs": self.langs, "factors": self.factors}

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the whole text with each language's dictionary, times its factor."""
        t = clean(text)
        use = self._short if len(t) <= SHORT else self._long
        out = np.zeros(len(self.langs))
        for i in range(0, len(t), PIECE):
            piece = f" {t[i : i + PIECE]} ".encode()
            out += [len(c.compress(piece)) for c in use]
        return out * self.factors

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """lang_pred, score, margin and rejected of each text."""
        self.ready()
        rows = []
        for t in texts:
            if t is None or not isinstance(t, str) or not self.langs or not _LETTER.search(t):
                rows.append(("und", 0.0, 0.0, True))
                continue
            s = self.sizes(t)
            order = np.argsort(s, kind="stable")
            best = s[order[0]]
            margin = float((s[order[1]] - best) / best) if len(s) > 1 else 1.0
            score = float(1 / np.exp(-np.minimum((s - best) / best * 40, 50)).sum())
            rows.append((self.langs[order[0]], score, margin, margin < MIN_MARGIN))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])


def train(docs: DataFrame, **columns) -> Model:
    return Model(sample(docs, **columns))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``language``: lang_pred, score, margin, rejected; where
    a column has that name, the result's gets a ``_``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield shared.value.predict(b)

    return docs.withColumn(free(docs.columns, "language")[0], udf(F.col(text_col)))
