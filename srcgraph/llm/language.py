"""Language identification by prediction by partial matching.

Per language, byte contexts of up to three bytes form a tree with symbol
counts. A symbol's code length under frozen counts follows escape method C: a
context of total t with q distinct symbols codes a known symbol as count/(t+q)
and escapes to the next shorter context with q/(t+q), down to a uniform code.
A text's language is that of the least total code length.

Code lengths of all (context, symbol) pairs are tabulated once; scoring a text
is one table lookup per byte. Letters A-Z are folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ._store import without
from ._tok import FOLD, row_groups, string_bytes

ORDER = 3
#: Labelled rows per language that a model is fitted on, about.
TRAIN_ROWS = 1500
#: A context of three bytes has a place in the tree from so many occurrences.
LEAST_CONTEXT = 4
UNKNOWN = "und"


def _grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each byte with the three before it as one 32-bit number; texts begin after blanks."""
    data, offsets = string_bytes(texts)
    for lo, hi in row_groups(offsets):
        n = offsets[hi] - offsets[lo]
        lengths = np.diff(offsets[lo : hi + 1])
        pad = np.full(n + ORDER * (hi - lo), 0x20, dtype=np.uint8)
        at = np.arange(n) + ORDER * (np.repeat(np.arange(hi - lo), lengths) + 1)
        pad[at] = FOLD[data[offsets[lo] : offsets[hi]]]
        wide = pad.astype(np.uint32)
        yield (wide[at - 3] << np.uint32(24)) | (wide[at - 2] << np.uint32(16)) | (wide[at - 1] << np.uint32(8)) | wide[at]


def _count(batches):
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            rows = pa.array([i for i, x in enumerate(langs) if x == lang])
            for grams in _grams(batch.column(1).take(rows)):
                values, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Tabulated code lengths in bits: cost[state * symbols + symbol, language]."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least_context: int = LEAST_CONTEXT):
        self.langs = sorted(counts)
        grams = np.concatenate([g for g, _ in counts.values()]) if counts else np.zeros(0, dtype=np.int64)
        used = np.unique(np.concatenate([(grams >> s) & 255 for s in (0, 8, 16, 24)])) if len(grams) else np.array([0x20])
        #: Bytes seen in training, then one symbol for all others.
        self.symbol = np.full(256, len(used), dtype=np.int64)
        self.symbol[used] = np.arange(len(used))
        size = self.size = len(used) + 1
        # Contexts of two bytes are all states; those of three bytes that occur often enough in some language follow.
        contexts, total = np.unique(grams >> 8, return_inverse=True)
        if len(grams):
            weight = np.bincount(total, weights=np.concatenate([n for _, n in counts.values()]))
            contexts = contexts[weight >= least_context]
        deep = self._code(contexts, 3)
        self.state = np.tile(np.arange(size * size), size).astype(np.int32)
        self.state[deep] = size * size + np.arange(len(deep))
        self.cost = np.zeros(((size * size + len(deep)) * size, max(1, len(self.langs))), dtype=np.float32)
        for column, lang in enumerate(self.langs):
            self.cost[:, column] = self._tabulate(*counts[lang], deep)

    def _code(self, values: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        for k in reversed(range(length)):
            out = out * self.size + self.symbol[(values >> (8 * k)) & 255]
        return out

    def _tabulate(self, grams: np.ndarray, n: np.ndarray, deep: np.ndarray) -> np.ndarray:
        size = self.size
        codes = self._code(grams, 4)
        cost = np.full(size, np.log2(256.0))
        for order in range(3):
            table = np.bincount(codes % size ** (order + 1), weights=n, minlength=size ** (order + 1)).reshape(-1, size)
            cost = self._blend(table, np.tile(cost.reshape(-1, size), (table.shape[0] // cost.reshape(-1, size).shape[0], 1)))
        place = np.full(size**3, -1, dtype=np.int64)
        place[deep] = np.arange(len(deep))
        row = place[codes // size]
        known = row >= 0
        table = np.zeros((len(deep), size))
        np.add.at(table, (row[known], codes[known] % size), n[known])
        return np.concatenate([cost, self._blend(table, cost[deep % (size * size)])]).astype(np.float32).ravel()

    @staticmethod
    def _blend(table: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, distinct = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        both = np.maximum(total + distinct, 1)
        with np.errstate(divide="ignore"):
            return np.where(table > 0, -np.log2(table / both), np.where(total > 0, -np.log2(distinct / both), 0.0) + shorter)

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text under each language."""
        data, offsets = string_bytes(texts)
        out = np.zeros((len(texts), self.cost.shape[1]))
        blank = int(self.symbol[0x20])
        for lo, hi in row_groups(offsets):
            n = int(offsets[hi] - offsets[lo])
            if n == 0:
                continue
            at = offsets[lo : hi + 1] - offsets[lo]
            code = self.symbol[FOLD[data[offsets[lo] : offsets[hi]]]]
            before = np.full((ORDER, n), blank, dtype=np.int64)
            inside = np.arange(n) - np.repeat(at[:-1], np.diff(at))
            for k in range(1, ORDER + 1):
                before[k - 1, k:] = np.where(inside[k:] >= k, code[:-k], blank)
            state = self.state[(before[2] * self.size + before[1]) * self.size + before[0]].astype(np.int64)
            cost = self.cost[state * self.size + code]
            full = np.flatnonzero(np.diff(at))
            out[lo + full] = np.add.reduceat(cost, at[full], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of every language that labels a row of docs.

    About `train_rows` rows per language, the least by a hash of their identifier,
    are counted on the executors; only their distinct byte contexts reach the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["_lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("n")).collect()}
    grid = 1 << 40
    bound = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(grid, -(-grid * train_rows // n))))]) if sizes else None
    if bound is None:
        return Model({})
    taken = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(grid)) < bound[F.col(lang_col)])
    counted = taken.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = rows["lang"].to_pylist()
    grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    names = np.array(names, dtype=object)
    return Model({lang: (grams[names == lang], n[names == lang].astype(np.float64)) for lang in sorted(sizes) if (names == lang).any()})


def _letters(texts: pa.Array) -> np.ndarray:
    """True for texts with a letter; only those without a-z are looked at one by one."""
    data, offsets = string_bytes(texts)
    out = np.zeros(len(texts), dtype=bool)
    for lo, hi in row_groups(offsets):
        folded = FOLD[data[offsets[lo] : offsets[hi]]]
        letters = np.flatnonzero((folded >= 0x61) & (folded <= 0x7A))
        at = np.searchsorted(letters, offsets[lo : hi + 1] - offsets[lo])
        out[lo:hi] = at[1:] > at[:-1]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with lang_pred and score.

    score is the chosen language's share of probability, from 0 to 1. A text
    that is null, empty or has no letters is "und" with score 0, as is every
    text when the model has no language. Ties go to the first name in order.
    Texts of any length are scored whole, chunk by chunk; repeated rows each get
    their prediction, and an empty table gives an empty result. Columns of the
    added names are replaced.
    """
    docs = without(docs, "lang_pred", "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    where = names.index(text_col)
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())

    def score(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(where)
            n = len(texts)
            known = _letters(texts) if m.langs else np.zeros(n, dtype=bool)
            bits = m.bits(texts)
            best = bits.argmin(axis=1) if n else np.zeros(0, dtype=int)
            gap = np.clip(bits - bits[np.arange(n), best][:, None], 0, 1000)
            share = np.where(known, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
            lang = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(share, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def keep_identified(docs: DataFrame, least_score: float = 0.5, **columns: str) -> DataFrame:
    """The rows and columns of docs whose language is identified with at least that score; fits on docs itself.

    Without a labelled row nothing can be judged, and all rows stay.
    """
    model = fit(docs, **columns)
    if not model.langs:
        return docs
    # Own names, so that columns of docs named like predictions stay.
    hidden = {c: f"__sg_{c}" for c in ("lang_pred", "score")}
    scored = predict(docs.withColumnsRenamed(hidden), model, columns.get("text_col", "text"))
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in hidden.items()}).select(*docs.columns)
