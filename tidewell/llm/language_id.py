"""Language identification by interpolated Kneser-Ney character models.

One model of order four for each language, over lower-case letters and a blank
for everything else. The models of all languages share tables: for each order the
sorted hashes of the n-grams that any language has, and beside each hash the
interpolated log-probability in every language; for n-grams that none has, the
back-off weights of the contexts. The language of the least cross-entropy a
symbol wins. A rejection bound on that entropy is taken from documents of the
sample that the models were not trained on, or where there are none, from the
number of letters; it is wider for short texts, by the root of their length.

Training reads a sample of at most TRAIN_DOCS documents and TRAIN_CHARS characters
of each language, those of the smallest hash of the id, whole texts. The languages are few, so the sample
and the tables fit the driver and are sent to the tasks.

Defined results: a null text or one without a letter is `und` with score 0;
repeated rows give repeated rows; ids may be of any type, a null one stays null and
counts as empty text in the hold-out rule; an empty table gives an empty table, and with nothing
to learn from every row is `und`; columns other than the id, text and language
are neither read nor returned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import dotted, is_held_out, map_arrow, ship, slices

#: Documents of each language that are read for training, and the share of them kept for the bound.
TRAIN_DOCS = 500
#: Characters of a language's documents that are read for training, at most; whole documents alone count.
TRAIN_CHARS = 16 << 20
BOUND_SHARE = 5
ORDER = 4
#: Symbols of the documents that the bound is taken from; shorter texts, whose entropy says less, get a wider margin.
LEAST_SYMBOLS = 40
#: Nats above the largest entropy of the kept documents from which a text is rejected.
MARGIN = 1.0
#: Characters of a text that are handled at once; a longer text is summed over pieces, each with its context before it.
PIECE = 1 << 18
_GAP = "\n" * ORDER
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUT = "held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def symbol_table() -> np.ndarray:
    """Code point of the basic plane -> itself for a letter, 0 for anything else."""
    return np.array([c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(1 << 16)], np.uint64)


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each text before a gap; end of each text). Letters beyond the basic plane are folded."""
    joined = _GAP + _GAP.join(texts) + _GAP
    low = joined.lower()
    if len(low) != len(joined):  # a letter may become two
        parts = [t.lower() for t in texts]
        low = _GAP + _GAP.join(parts) + _GAP
        lengths = [len(p) for p in parts]
    else:
        lengths = [len(t) for t in texts]
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes >= 1 << 16
    out = table[np.where(wide, 0, codes)]
    for i in np.flatnonzero(wide):
        c = int(codes[i])
        out[i] = (c & 0xFFFF or 1) if unicodedata.category(chr(c))[0] == "L" else 0
    return out, np.cumsum(np.asarray(lengths, np.int64) + len(_GAP))


def grams(sym: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at symbols n-1 and later, 16 bits a symbol."""
    key = sym[n - 1 :].copy()
    for k in range(1, n):
        key |= sym[n - 1 - k : len(sym) - k] << np.uint64(16 * k)
    return key


class Table:
    """Sorted hashes with a row of values each; a directory by their leading bits makes a look-up a few steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys * _MIX
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none. The product with an odd number loses nothing, so no two keys meet."""
        h = keys * _MIX
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        for _ in range(self.steps):
            place = at[open_]
            hit = self.hashes[place] == h[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return out


class Models:
    """The models of all languages."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order, table = sorted(texts), order, symbol_table()
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            sym, ends = symbols(texts[lang], table)
            inside = np.zeros(len(sym), bool)
            at = len(_GAP)
            for end in ends:
                inside[at:end] = True
                at = int(end) + len(_GAP)
            by_order = [np.unique(grams(sym, order)[inside[order - 1 :]], return_counts=True)]
            for n in range(order - 1, 0, -1):  # lower orders count the symbols that come before
                by_order.insert(0, np.unique(by_order[0][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True))
            counts.append(by_order)
        self.grams: list[Table] = []
        self.contexts: list[Table | None] = []
        size = max(1, len(np.unique(np.concatenate([c[0][0] for c in counts])))) if counts else 1
        self.floor = -np.log(size + 1.0)
        lower = None
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
            heads = np.unique(keys >> np.uint64(16))
            values = np.zeros((len(keys), len(self.langs)))
            weights = np.zeros((len(heads), len(self.langs)))
            below = np.full((len(keys), len(self.langs)), self.floor) if lower is None else lower.values[lower.find(keys & np.uint64((1 << (16 * (n - 1))) - 1))]
            for j, by_order in enumerate(counts):
                own, c = by_order[n - 1]
                once, twice = int((c == 1).sum()), int((c == 2).sum())
                discount = once / (once + 2 * twice) if once and twice else 0.5
                head, where = np.unique(own >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(where, c), np.bincount(where)
                left = discount * kinds / total
                mine = np.zeros(len(keys))
                mine[np.searchsorted(keys, own)] = (c - discount) / total[where]
                spare = np.ones(len(heads))
                spare[np.searchsorted(heads, head)] = left
                weights[:, j] = np.log(spare)
                values[:, j] = np.log(mine + spare[np.searchsorted(heads, keys >> np.uint64(16))] * np.exp(below[:, j]))
            lower = Table(keys, values)
            self.grams.append(lower)
            self.contexts.append(Table(heads, weights))

    def logs(self, sym: np.ndarray) -> np.ndarray:
        """Log-probabilities (symbols from order-1 on, languages)."""
        return self._logs([grams(sym, n)[self.order - n :] for n in range(1, self.order + 1)], self.order)

    def _logs(self, keys: list[np.ndarray], n: int) -> np.ndarray:
        if n == 0:
            raise AssertionError
        found = self.grams[n - 1].find(keys[n - 1])
        out = self.grams[n - 1].values[found]
        lost = np.flatnonzero(found < 0)
        if len(lost):
            part = [k[lost] for k in keys[: n - 1]]
            below = self._logs(part, n - 1) if n > 1 else np.full((len(lost), len(self.langs)), self.floor, np.float32)
            head = self.contexts[n - 1].find(keys[n - 1][lost] >> np.uint64(16))
            out[lost] = below + np.where(head[:, None] >= 0, self.contexts[n - 1].values[head], 0)
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean nats a symbol in each language, symbols, letters) of each text."""
        if sum(map(len, texts)) <= PIECE:
            nats, n, letters = self._sums(texts, [0] * len(texts), table)
        else:
            nats, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owners, parts, leads in self._pieces(texts):
                for total, more in zip((nats, n, letters), self._sums(parts, leads, table), strict=True):
                    np.add.at(total, owners, more)
        return nats / np.maximum(n, 1)[:, None], n, letters

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """(text, piece, characters of it that are context only), PIECE characters or a little more at a time."""
        owners, parts, leads, size = [], [], [], 0
        for i, t in enumerate(texts):
            low = t.lower() if len(t) > PIECE else t
            for at in range(0, max(1, len(low)), PIECE):
                leads.append(min(at, self.order - 1))
                parts.append(low[at - leads[-1] : at + PIECE])
                owners.append(i)
                size += len(parts[-1])
                if size >= PIECE:
                    yield owners, parts, leads
                    owners, parts, leads, size = [], [], [], 0
        if owners:
            yield owners, parts, leads

    def _sums(self, texts: list[str], leads: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats in each language, symbols, letters) of each text after its first `leads` characters."""
        sym, ends = symbols(texts, table)
        starts = np.concatenate(([0], ends[:-1])) + len(_GAP) + np.asarray(leads, np.int64)
        logs = self.logs(sym)
        edges = np.empty(2 * len(texts), np.int64)
        edges[::2], edges[1::2] = starts, ends
        edges -= self.order - 1
        padded = np.vstack([logs, np.zeros((1, logs.shape[1]), logs.dtype)])
        sums = np.add.reduceat(padded.astype(np.float64), edges, axis=0)[::2]
        n = ends - starts
        sums[n == 0] = 0
        letters = np.add.reduceat(np.append(sym != 0, False).astype(np.int64), np.stack([starts, ends], 1).ravel())[::2]
        letters[n == 0] = 0
        return -sums, n, letters


class Identifier:
    """Models, the bound above which a text is rejected, and the scale of the scores."""

    def __init__(self, texts: dict[str, list[str]]):
        kept = {lang: t[::BOUND_SHARE] if len(t) > 2 * BOUND_SHARE else [] for lang, t in texts.items()}
        learnt = {lang: [x for i, x in enumerate(t) if not kept[lang] or i % BOUND_SHARE] for lang, t in texts.items()}
        self.models, table = Models(learnt), symbol_table()
        # Where no long documents are kept: a uniform draw of the letters of the language that has most, and the blank.
        most = max((len({c for x in t for c in x.lower() if c.isalpha()}) for t in learnt.values()), default=0) + 1
        self.bound, self.scale = float(np.log(most)) + MARGIN, 20.0
        if any(kept.values()):
            h, n, letters = self.models.entropies([x for t in kept.values() for x in t], table)
            wanted = np.repeat(np.arange(len(kept)), [len(kept[x]) for x in self.models.langs]) if list(kept) == self.models.langs else np.concatenate([[self.models.langs.index(x)] * len(t) for x, t in kept.items()]).astype(int)
            long = (n >= LEAST_SYMBOLS) & (letters > 0)
            if long.any():
                self.bound = float(h[long].min(axis=1).max()) + MARGIN
            # The scale of the largest likelihood of the kept documents' languages.
            best = -np.inf
            for scale in (5.0, 10.0, 20.0, 40.0):
                z = -scale * h
                fit = float((z[np.arange(len(z)), wanted] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1)).mean())
                if fit > best + 1e-9:
                    best, self.scale = fit, scale

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, entropy, rejected) of each text."""
        h, n, letters = self.models.entropies([t or "" for t in texts], table)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp(-self.scale * (h - least[:, None])).sum(axis=1)
        none = letters == 0
        score[none] = 0
        wider = MARGIN * (np.sqrt(LEAST_SYMBOLS / np.clip(n, 1, LEAST_SYMBOLS)) - 1)
        rejected = none | (least > self.bound + wider)
        return ["und" if none[i] else self.models.langs[b] for i, b in enumerate(best)], score, least, rejected


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict[str, list[str]]:
    """At most `per_language` learnable texts of each language, by the smallest hash of the id.

    A first pass counts, so that the second keeps little more than is wanted
    before it ranks.
    """
    rows = docs.select(dotted(id_column).alias("doc_id"), dotted(text_column).cast("string").alias("text"), dotted(lang_column).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * per_language / n + 20.0 / n))).otherwise(share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    near = rows.where(hashed < share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    so_far = F.sum(F.length("text").cast("long")).over(Window.partitionBy("lang").orderBy("rank"))
    near = near.withColumn("chars", so_far).where(F.col("chars") <= TRAIN_CHARS).drop("chars")
    out: dict[str, list[str]] = {}
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: t for lang, t in sorted(out.items()) if any(c.isalpha() for x in t for c in x)}


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier, table = shared.value, symbol_table()
        for batch in slices(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            if identifier is None:
                langs, score, h, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                langs, score, h, rejected = identifier.predict(texts, table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(score), pa.array(h), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"])

    return run


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Language, score and rejection of each document; learns from docs itself."""
    texts = sample(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)
    shared = docs.sparkSession.sparkContext.broadcast(Identifier(texts) if texts else None)
    rows = docs.select(dotted(id_column).alias("doc_id"), is_held_out(id_column).alias("held_out"), dotted(text_column).cast("string").alias("text"))
    return map_arrow(rows, _predict(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def accepted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents that are not rejected, with all their columns; with nothing to learn from, all.

    Python sees the texts alone and returns a flag, so rows stay in the JVM.
    """
    texts = sample(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)
    if not texts:
        return docs
    shared = ship(docs.sparkSession).sparkContext.broadcast(Identifier(texts))

    def keep(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier, table = shared.value, symbol_table()
        for column in columns:
            parts = slices([pa.RecordBatch.from_arrays([column], ["text"])], most=512 << 10)
            flags = [~identifier.predict(part.column("text").to_pylist(), table)[3] for part in parts]
            yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))

    flag = F.arrow_udf(keep, "boolean", F.ArrowUDFType.SCALAR_ITER)
    return docs.where(flag(dotted(text_column).cast("string")))
