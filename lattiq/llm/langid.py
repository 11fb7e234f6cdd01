"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that followed.
A byte that was seen in a context costs its share of count / (total + kinds); one that was not costs the
escape, kinds / (total + kinds), and goes on in the context that is one byte shorter, down to 1/256 for a byte
that was never seen at all (method C, frozen statistics). A text's code length in each language is the exact
sum over its bytes; the shortest wins.

For scoring, the trees of all languages are laid out as one table a context length: grams with their code
lengths in every language, and contexts with their escapes. A gram is found by a multiplied hash in a table of
2^20 places, and by binary search where places collide.

The trees are fitted on at most about TRAIN_DOCS documents a language (those whose hashes are smallest); that
bound is the parameter train_docs.

Defined cases: a null text, or one without any letter, is "und" with score 0; without any language learned
from, everything is; languages that tie go by name; rows that repeat are scored alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, byte_batches, only
from .quality import fold

ORDER, TRAIN_DOCS, FOLDS, HELD_OUT = 3, 2000, 4, 2
#: What stands before a text, so that its first bytes have contexts.
LEAD = b"\n" * ORDER
SLOTS = 20
_LETTER = re.compile(r"[^\W\d_]")


def grams(raw: bytes) -> np.ndarray:
    """The ORDER + 1 bytes up to each byte of raw as one unsigned 32-bit integer; LEAD is expected before raw."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


@dataclass
class Level:
    """Grams of one context length: sorted keys, code lengths (bits) by language; contexts and their escapes."""

    keys: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray
    slot_keys: np.ndarray = field(default=None)
    slot_rows: np.ndarray = field(default=None)

    def find(self, g: np.ndarray) -> np.ndarray:
        """Rows of grams, -1 for unknown ones."""
        if self.slot_keys is None:
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            return np.where(self.keys[at] == g, at, -1)
        slot = (g * np.uint32(2654435769)) >> np.uint32(32 - SLOTS)
        rows = self.slot_rows[slot]
        miss = np.flatnonzero(self.slot_keys[slot] != g)
        if len(miss):
            m = g[miss]
            at = np.minimum(np.searchsorted(self.keys, m), len(self.keys) - 1)
            rows[miss] = np.where(self.keys[at] == m, at, -1)
        return rows


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it, a column a language."""
        out = np.empty((len(g), len(self.languages)), np.float32)
        self._fill(out, g, np.arange(len(g)), ORDER)
        return out

    def _fill(self, out: np.ndarray, g: np.ndarray, rows: np.ndarray, k: int) -> None:
        if k < 0:
            out[rows] += 8.0
            return
        level = self.levels[k]
        at = level.find(g)
        known = at >= 0
        if k == ORDER:
            np.take(level.cost, np.maximum(at, 0), axis=0, out=out)
            out[~known] = 0
        else:
            out[rows[known]] += level.cost[at[known]]
        miss = np.flatnonzero(~known)
        if len(miss):
            m = g[miss]
            ctx = m >> np.uint32(8)
            c = np.minimum(np.searchsorted(level.contexts, ctx), len(level.contexts) - 1)
            out[rows[miss]] += np.where((level.contexts[c] == ctx)[:, None], level.escape[c], 0)
            self._fill(out, m & np.uint32((1 << 8 * k) - 1), rows[miss], k - 1)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's grams and their counts."""
    languages = sorted(counts)
    levels: list[Level] = []
    for k in range(ORDER + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = []
        for name in languages:
            g, inv = np.unique(counts[name][0].astype(np.uint64) & mask, return_inverse=True)
            own.append((g.astype(np.uint32), np.bincount(inv, weights=counts[name][1])))
        keys = np.unique(np.concatenate([g for g, _ in own]))
        contexts = np.unique(keys >> np.uint32(8))
        cost, escape = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        where = np.searchsorted(contexts, keys >> np.uint32(8))
        for j, (g, n) in enumerate(own):
            ctx = np.searchsorted(contexts, g >> np.uint32(8))
            total, kinds = np.bincount(ctx, n, len(contexts)), np.bincount(ctx, minlength=len(contexts))
            known = kinds > 0
            escape[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
            have = np.zeros(len(keys), bool)
            at = np.searchsorted(keys, g)
            have[at] = True
            cost[at, j] = -np.log2(n / (total[ctx] + kinds[ctx]))
            rest = np.flatnonzero(~have)
            if k and len(rest):
                below = levels[k - 1]
                shorter = keys[rest] & np.uint32((1 << 8 * k) - 1)
                cost[rest, j] = escape[where[rest], j] + below.cost[np.searchsorted(below.keys, shorter), j]
            else:
                cost[rest, j] = escape[where[rest], j] + 8.0
        levels.append(Level(keys, cost, contexts, escape))
    top = levels[-1]
    slots = (top.keys * np.uint32(2654435769)) >> np.uint32(32 - SLOTS)
    weight = np.zeros(len(top.keys))
    for name in languages:
        weight[np.searchsorted(top.keys, counts[name][0])] += counts[name][1]
    order = np.argsort(weight, kind="stable")  # the most frequent gram of a place comes last and stays
    top.slot_keys = np.zeros(1 << SLOTS, np.uint32)
    top.slot_rows = np.zeros(1 << SLOTS, np.int32)
    empty = np.ones(1 << SLOTS, bool)
    empty[slots] = False
    top.slot_keys[slots[order]], top.slot_rows[slots[order]] = top.keys[order], order
    # a place without a gram holds a key that hashes elsewhere, so that nothing is found there: 0, at place 0 itself 1
    top.slot_keys[empty] = 0
    if empty[0]:
        top.slot_keys[0] = 1
    return Model(languages, levels)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on rows of docs (doc_id, text, lang) outside the held-out fold whose text and lang are known."""
    spark = docs.sparkSession
    rows = only(docs, doc_id="long", text="string", lang="string").where("text is not null and lang is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    share = spark.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 12).cast("double") / F.lit(float(1 << 52))
    rows = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(b: pa.RecordBatch):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(text.encode())
        for lang, texts in by.items():
            g, n = np.unique(np.concatenate([grams(LEAD + t) for t in texts]), return_counts=True)
            yield [pa.array([lang] * len(g)), g.astype(np.int64), n.astype(np.int64)]

    table = arrow_map(rows, count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (x["gram"].to_numpy().astype(np.uint32), x["n"].to_numpy(np.float64)) for k, x in table.groupby("lang")}
    return build(counts) if counts else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte (of the best language) of each row of docs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train_docs a language

    def run(b: pa.RecordBatch):
        m = held.value
        ids, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in byte_batches(texts, 500_000):
            out: list[tuple] = []
            known = [k for k in range(lo, hi) if texts[k] and _LETTER.search(texts[k])] if m else []
            best = {}
            if known:
                raw = [texts[k].encode() for k in known]
                g = np.concatenate([grams(LEAD + x) for x in raw])
                sizes = np.array([len(x) for x in raw])
                total = np.add.reduceat(m.bits(g), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                order = np.argmin(total, axis=1)
                low = total[np.arange(len(order)), order]
                odds = np.exp2(np.clip(low[:, None] - total, -1000, 0)).sum(axis=1)
                best = {k: (m.languages[o], float(1 / z), float(s / n)) for k, o, z, s, n in zip(known, order, odds, low, sizes)}
            for k in range(lo, hi):
                out.append(best.get(k, ("und", 0.0, None)))
            yield [ids.slice(lo, hi - lo), [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]]

    scored = arrow_map(only(docs, doc_id="long", text="string"), run, schema)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def predict(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Train on docs and identify every row of it."""
    return identify(docs, train(docs, train_docs))
