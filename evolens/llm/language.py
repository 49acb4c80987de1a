"""Language identification by prediction by partial matching.

Every language has a context tree over the bytes of lower-cased text, with contexts of up to ORDER bytes. A byte costs
its code length in the longest context that the tree knows; where it was never seen there, an escape is paid (symbols
seen / (occurrences + symbols seen)), what was seen is excluded, and the next shorter context is asked, down to equal
shares of the 256 bytes. Statistics are frozen after training, so that the cost of a byte depends on the ORDER bytes
before it alone: all costs are worked out once, as a table of (context, byte, language), and a text's code lengths are
exact sums of its entries. The language with the shortest code wins, ties go to the smaller name.

Training takes whole texts of a bounded sample: about `sample` documents of each language, by hash of their id. The
table is bounded by that sample. Texts that are null or have no letter are `und` with score 0, as is every text where
nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.words import slices, text_bytes

ORDER = 3
UNDETERMINED = "und"
SEGMENT = 1 << 20


def id_remainder(column, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def label_sample(docs: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> DataFrame:
    """About `rows` rows of each label (all, if fewer), by hash of the id: no sort, and no group meets in one task."""
    shares = docs.groupBy(label).count().withColumn("_share", F.lit(rows) / F.col("count")).drop("count")
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 30)) / F.lit(1 << 30)
    return docs.join(F.broadcast(shares), label).where(spot < F.col("_share")).drop("_share")


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.cast(column, pa.large_string()))


def _before(symbols: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The symbol `back` places earlier in the same text, else 0."""
    shifted = np.zeros_like(symbols)
    shifted[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
    for k in range(back):
        at = starts + k
        shifted[at[at < len(symbols)]] = 0
    return shifted


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every run of ORDER + 1 bytes; runs at the beginning of a text are filled up with zero bytes."""
    for batch in slices(batches):
        languages = batch.column("lang").to_pylist()
        lowered = _lower(batch.column("text"))
        for language in sorted(set(languages)):
            rows = [i for i, x in enumerate(languages) if x == language]
            data, offsets = text_bytes(lowered.take(pa.array(rows)))
            runs = data.astype(np.int64)
            for back in range(1, ORDER + 1):
                runs |= _before(data, offsets[:-1], back).astype(np.int64) << (8 * back)
            run, n = np.unique(runs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(run)), pa.array(run), pa.array(n)], ["lang", "run", "n"])


class Model:
    """Code lengths of every byte in every known context, for all languages."""

    def __init__(self, counted: list[tuple[str, int, int]]):
        self.languages = sorted({row[0] for row in counted})
        if not counted:
            return
        which = {x: k for k, x in enumerate(self.languages)}
        language = np.array([which[row[0]] for row in counted])
        run = np.array([row[1] for row in counted], dtype=np.int64)
        n = np.array([row[2] for row in counted], dtype=np.float64)
        codes = np.stack([(run >> (8 * k)) & 255 for k in range(ORDER, -1, -1)], axis=1)
        self.symbol = np.zeros(256, dtype=np.int32)
        seen = np.unique(codes)
        seen = seen[seen > 0]
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = a = len(seen) + 1
        codes = self.symbol[codes]
        row_of: list[np.ndarray] = []
        keys_of: list[np.ndarray] = []
        first = 0
        for length in range(ORDER + 1):
            key = np.zeros(len(codes), dtype=np.int64)
            for k in range(ORDER - length, ORDER):
                key = key * a + codes[:, k]
            keys, place = np.unique(key, return_inverse=True)
            counts = np.zeros((len(self.languages), len(keys), a), dtype=np.float64)
            np.add.at(counts, (language, place, codes[:, ORDER]), n)
            keys_of.append(keys)
            row_of.append(first + np.arange(len(keys)))
            first += len(keys)
            self._add_costs(length, keys, counts, keys_of)
        self.table = np.concatenate(self._costs).reshape(-1, len(self.languages))
        del self._costs, self._levels
        longest = np.zeros(1, dtype=np.int32)
        for length in range(1, ORDER + 1):
            longest = np.tile(longest, a) if length > 1 else np.zeros(a, dtype=np.int32)
            longest[keys_of[length]] = row_of[length]
        self.longest = longest

    def _add_costs(self, length: int, keys: np.ndarray, counts: np.ndarray, keys_of: list[np.ndarray]) -> None:
        if length == 0:
            self._levels, self._costs = [], []
        self._levels.append(counts)
        a, languages = self.size, len(self.languages)
        for low in range(0, len(keys), 2048):
            part = keys[low : low + 2048]
            cost = np.zeros((len(part), a, languages), dtype=np.float32)
            for x in range(languages):
                open_ = np.ones((len(part), a), dtype=bool)
                paid = np.zeros((len(part), 1))
                for shorter in range(length, -1, -1):
                    suffix = part % a**shorter
                    place = np.searchsorted(keys_of[shorter], suffix)
                    seen = self._levels[shorter][x][place] * open_
                    total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
                    known = total > 0
                    with np.errstate(divide="ignore", invalid="ignore"):
                        share = np.where(seen > 0, paid - np.log2(seen / (total + kinds)), 0)
                        paid = np.where(known, paid - np.log2(kinds / (total + kinds)), paid)
                    cost[:, :, x] += share
                    open_ &= ~(seen > 0)
                left = 256 - a + open_.sum(1, keepdims=True)
                cost[:, :, x] += np.where(open_, paid + np.log2(left), 0)
            self._costs.append(cost.reshape(-1, languages))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        totals = np.zeros((len(offsets) - 1, len(self.languages)))
        cuts = np.unique(np.concatenate((offsets, np.arange(0, len(data), SEGMENT))))
        for low in range(0, len(data), SEGMENT):
            high = min(len(data), low + SEGMENT)
            base = max(0, low - ORDER)
            symbols = self.symbol[data[base:high]]
            starts = offsets[:-1][(offsets[:-1] >= base - ORDER) & (offsets[:-1] < high)] - base
            context = np.zeros(len(symbols), dtype=np.int32)
            for back in range(ORDER, 0, -1):
                context = context * self.size + _before_inside(symbols, starts, back)
            cell = self.longest[context].astype(np.int64) * self.size + symbols
            bits = self.table[cell[low - base :]]
            at = cuts[np.searchsorted(cuts, low) : np.searchsorted(cuts, high)]
            np.add.at(totals, np.searchsorted(offsets, at, side="right") - 1, np.add.reduceat(bits, at - low, axis=0, dtype=np.float64))
        return totals


def _before_inside(symbols: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    shifted = np.zeros_like(symbols)
    shifted[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
    for k in range(back):
        at = starts + k
        shifted[at[(at >= 0) & (at < len(symbols))]] = 0
    return shifted


def train(docs: DataFrame, sample: int = 800) -> Model:
    """A model of the texts (`text`) of each language (`lang`); rows without either are left out."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = label_sample(usable, "lang", sample).select("lang", "text").mapInArrow(_counted, "lang string, run bigint, n bigint")
    rows = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    return Model(list(zip(*(rows.column(c).to_pylist() for c in ("lang", "run", "n")))))


def identify(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """`keep` columns, prediction and score (share of the best language, if all were equally likely before) of every row.

    Repeated rows are scored each. names: of the two results, unlike those in `keep`.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            lowered = _lower(batch.column("text"))
            letters = pc.fill_null(pc.match_substring_regex(lowered, r"\pL"), False).to_pylist()
            found, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            if model.languages:
                bits = model.code_lengths(*text_bytes(lowered))
                best = bits.argmin(1)
                for i, ok in enumerate(letters):
                    if ok:
                        found[i] = model.languages[best[i]]
                        scores[i] = 1 / sum(2.0 ** max(-1000.0, bits[i, best[i]] - b) for b in bits[i])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*keep, *names],
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)




def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose language could be determined."""
    mark = "_" * (1 + max(len(c) for c in docs.columns))
    found = identify(docs, model, tuple(docs.columns), (mark + "lang", mark + "score"))
    return found.where(F.col(mark + "lang") != UNDETERMINED).select(*docs.columns)
