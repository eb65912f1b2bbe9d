"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of its labelled text. A text is cut
from left to right into phrases, each the longest that stands somewhere in the sample (a letter that
the sample lacks is a phrase of its own). The fewer phrases, the closer the language: phrases times
the bits that name a place in the sample, log2 of its length, per symbol of the text, estimate the
cross entropy. The language with the least wins, ties to the smaller name. The score is one minus
the ratio of the least to the next: 0 for a tie, near 1 for a clear case, 1 if one language is known.

Texts are seen as letters, case folded by lower-casing, and runs of anything else as one blank. A
text that is null or has no letter is `und` with score 0; so is every text if nothing was learned.
Whole texts are parsed: in chunks side by side, each then parsed again from the state that the chunk
before it ended in, until the two parses meet, which gives exactly the parse from the beginning.

Learned from: documents whose crc32(doc_id as text) modulo FOLDS isn't 0 and whose label isn't null. The
sample of a language is whole texts of a bounded number of rows (sample_rows) of a bounded length
(longest): those whose ids have the least hashes. Where a language has fewer of these, its shortest longer
text counts among them. Of several texts of one id the shortest counts, of equally short ones the least; a
null id is never learned from. More than most_languages different labels are an error: they are no languages.

Repeated rows count once in the sample and come out alike. An empty table teaches nothing and gives no
rows. Very long texts are parsed whole, TOGETHER symbols or one text at a time. identify() leaves other
columns out; identified() passes them in a struct, so their names never clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm import shared

FOLDS = 5
#: Defaults of the sample's bounds: rows of a language, code points of a row, languages.
SAMPLE_ROWS, LONGEST, MOST_LANGUAGES = 30, 3_000, 200
CHUNK, TOGETHER = 256, 1 << 19
UNKNOWN = "und"
STARTS, STATE = np.int32(-(2**31)), np.int32(2**31 - 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton that accepts all substrings of `text`."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    return go


class Model:
    """An automaton per language as a table, and the symbols that stand for letters."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        number = {c: k + 2 for k, c in enumerate(letters)}  # 0: blank, 1: a letter that no sample has
        self.pad = len(letters) + 2
        self.width = self.pad + 1
        self.symbol = np.zeros(0x110000, np.int16)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                self.symbol[code] = number.get(low if len(low) == 1 else low[0], 1)
        self.tables, self.bits = [], []
        for name in self.languages:
            text = self.symbols(samples[name])
            self.tables.append(self._table(suffix_automaton(text.tolist())))
            self.bits.append(math.log2(len(text) + 2))

    def symbols(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) else s

    def _table(self, go: list[dict[int, int]]) -> np.ndarray:
        """Place after each state and symbol, places being states times width; the sign says that a phrase starts."""
        w = self.width
        root = np.full(w, STARTS, np.int32)
        for c, to in go[0].items():
            root[c] |= to * w
        table = np.tile(root, (len(go), 1))
        for k, out in enumerate(go[1:], 1):
            for c, to in out.items():
                table[k, c] = to * w
        table[:, self.pad] = np.arange(len(go), dtype=np.int32) * w
        return table.ravel()

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per symbol of each text (a row) in each language (a column)."""
        parts = [self.symbols(t) for t in texts]
        size = np.array([len(p) for p in parts])
        lanes = np.maximum(1, -(-size // CHUNK))
        firsts = np.cumsum(lanes) - lanes
        flat = np.full(int(lanes.sum()) * CHUNK, self.pad, np.int64)
        for p, k in zip(parts, firsts, strict=True):
            flat[k * CHUNK : k * CHUNK + len(p)] = p
        columns = np.ascontiguousarray(flat.reshape(-1, CHUNK).T)
        out = np.empty((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.add.reduceat(phrases(columns, firsts, table), firsts) * self.bits[k] / np.maximum(size, 1)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and bits per symbol in that language (NaN if und)."""
        n = len(texts)
        known = np.array([any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t)) for t in texts], bool) & bool(self.languages)
        names, score, bits = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan)
        at = np.flatnonzero(known)
        begin = 0
        while begin < len(at):
            end, size = begin, 0
            while end < len(at) and (size == 0 or size + len(texts[at[end]]) <= TOGETHER):
                size += len(texts[at[end]])
                end += 1
            rows = at[begin:end]
            e = self.entropies([texts[i] for i in rows])
            order = np.argsort(e, axis=1, kind="stable")
            least = e[np.arange(len(rows)), order[:, 0]]
            second = e[np.arange(len(rows)), order[:, 1]] if e.shape[1] > 1 else np.full(len(rows), np.inf)
            bits[rows], score[rows] = least, 1 - least / second
            for i, k in zip(rows, order[:, 0], strict=True):
                names[i] = self.languages[k]
            begin = end
        return names, score, bits


def phrases(columns: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases that start in each lane (a column of symbols). firsts: the lanes where texts begin; others
    go on where the lane before ends."""
    n = columns.shape[1]
    place, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for symbols in columns:
        step = table.take(symbols + place)
        count += step < 0
        place = step & STATE
    begun, ended = np.zeros(n, np.int32), place
    first = np.zeros(n, bool)
    first[firsts] = True
    while True:
        due = np.where(first, np.int32(0), np.roll(ended, 1))
        live = np.flatnonzero(due != begun)
        if not len(live):
            return count
        new, old, more = due[live], begun[live], np.zeros(len(live), np.int64)
        begun[live] = new
        for symbols in columns:
            s = symbols[live]
            a, b = table.take(s + new), table.take(s + old)
            more += (a < 0).astype(np.int64) - (b < 0)
            new, old = a & STATE, b & STATE
            apart = new != old
            if not apart.all():
                met = ~apart
                count[live[met]] += more[met]
                live, new, old, more = live[apart], new[apart], old[apart], more[apart]
                if not len(live):
                    break
        count[live] += more
        ended[live] = new


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS, longest: int = LONGEST, most_languages: int = MOST_LANGUAGES,
) -> dict[str, str]:
    """Sample text per language. Whole texts come to the driver, sample_rows of up to `longest` code points of a
    language, or its shortest longer one among them."""
    n_chars = F.length(text_col)
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (n_chars > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), n_chars.alias("n_chars"), F.xxhash64(F.col(id_col).cast("string")).alias("hash"))
    short = F.col("n_chars") <= longest
    told = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("id"))).alias("n"), F.min(F.when(~short, F.col("n_chars"))).alias("next"))
    told = told.limit(most_languages + 1).collect()
    if len(told) > most_languages:
        raise ValueError(f"more than {most_languages} different labels: raise most_languages if these are languages")
    # a few times as many ids as are wanted have a hash below the share that they make up; only these are ranked
    bounds = [(r["lang"], 4.0 * sample_rows / max(1, r["n"]), longest if r["n"] >= sample_rows else r["next"] or longest) for r in told]
    of_lang = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, share double, most int"))  # a row per language
    few = rows.join(of_lang, "lang").where((F.shiftrightunsigned("hash", 11) / float(2**53) < F.col("share")) & (F.col("n_chars") <= F.col("most")))
    order = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = few.select("id", "lang", "hash", "most").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).select("id", "lang", "n", "most")
    text = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    same = text.join(F.broadcast(chosen), ["id", "lang"]).where((F.length("text") > 0) & (F.length("text") <= F.col("most")))
    best = same.groupBy("lang", "n").agg(F.min(F.struct(F.length("text").alias("n_chars"), "text")).alias("best")).select("lang", "n", "best.text").collect()
    samples: dict[str, str] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["n"])):
        samples[r["lang"]] = f"{samples[r['lang']]} {r['text']}" if r["lang"] in samples else r["text"]
    return {k: s for k, s in samples.items() if any(map(str.isalpha, s))}


@functools.lru_cache(1)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, bits (per symbol, in that language; null if und), without a shuffle."""
    known = tuple(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        for batch in batches:
            names, score, bits = model.predict(shared.texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits))], names=[id_col, "lang_pred", "score", "bits"])

    shared.batched(docs.sparkSession)
    two = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits double")


def identified(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of `docs`) and found (lang_pred, score, bits) of each document, without a shuffle.
    Rows pass through Python as they are, batch by batch, so nothing is held back for them."""
    known = tuple(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        for batch in batches:
            names, score, bits = model.predict([t or "" for t in batch.column("row").field(text_col).to_pylist()])
            found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits))], names=["lang_pred", "score", "bits"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "found"])

    shared.batched(docs.sparkSession)
    row = docs.select(F.struct("*").alias("row"))
    out = T.StructType([*row.schema.fields, T.StructField("found", T.StructType.fromDDL("lang_pred string, score double, bits double"))])
    return row.mapInArrow(run, out)
