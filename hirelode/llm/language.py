"""Language of a text by prediction by partial matching.

For each language a context tree over bytes gives the chance of the next byte from
the longest known context, escaping to shorter ones (method C: a context of ``n``
sightings and ``q`` different followers escapes with chance ``q / (n + q)``; no
exclusion).  Statistics are frozen after learning, so the cost in bits of every
(context, byte) is a number known beforehand: all escapes are resolved into one
table, and the exact code length of a text is a sum of table entries.  The
shortest code length names the language.

Bytes are read in lower case, digits as one symbol and white space as one; every
other byte value is a symbol of its own.  Only contexts that were seen are stored: for
each language and order the sorted keys of (context, symbol) and of contexts, so order
and alphabet do not depend on the number of languages.  The sample is bounded instead:
at most ``PER_LANG`` rows of each language (by hash of the id), of at most
``SAMPLE_BYTES`` together after the first, and never held-out rows.  The model grows
with the number of languages, and holds at most ``ORDER + 1`` keys a byte of the sample.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without learning rows every text is ``und``; ties go to the name first in order;
the score is the share of the named language when code lengths are read as chances
(of at most ``EVIDENCE`` bytes, so that long texts do not all round to 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .common import held_out, if_small, store_summary

PER_LANG = 1500
SAMPLE_BYTES = 16_000_000
SYMBOLS = 256
ORDER = 3
EVIDENCE = 64
PAD = 0     # white space, and what stands before a text


def _fold(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin-1 capitals (two bytes in UTF-8)."""
    low = grams.FOLD[raw]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 32
    return low


def _symbols() -> np.ndarray:
    """Symbol of every byte: its own but for digits and white space (the byte 0 counts as 1)."""
    own = np.arange(256, dtype=np.uint8)
    own[0] = 1
    own[48:58] = 48
    own[grams.SPACE] = PAD
    return own


def _codes(raw: np.ndarray, offsets: np.ndarray, own: np.ndarray, size: int, order: int):
    """Pieces of (text number, code of each byte with its context)."""
    n = len(offsets) - 1
    for a in range(0, max(len(raw), 0), grams.PIECE):
        b = min(len(raw), a + grams.PIECE)
        head = max(0, a - 1)
        sym = own[_fold(raw[head:b])][a - head:].astype(np.int64)
        text = np.searchsorted(offsets, np.arange(a, b), side="right") - 1 if n > 1 else np.zeros(b - a, np.int64)
        back = np.arange(a, b) - offsets[text]
        before = own[_fold(raw[max(0, a - order - 1):a])].astype(np.int64)
        whole = np.concatenate([np.full(order + 1, PAD), before, sym])
        base = len(whole) - len(sym)
        code = np.zeros(b - a, dtype=np.int64)
        for k in range(order, -1, -1):
            s = whole[base - k:len(whole) - k]
            code = code * size + np.where(back >= k, s, PAD)
        yield text, code


def _code_lengths(counts: np.ndarray, size: int, order: int) -> np.ndarray:
    """Bits of every (context, symbol) of one language as a whole table, for small alphabets; ``counts`` by code of order + 1 symbols."""
    by_order = [counts.reshape((size,) * (order + 1)).astype(float)]
    for _ in range(order):
        by_order.append(by_order[-1].sum(axis=0))
    cost = np.full(size, np.log2(size))
    for seen in reversed(by_order):
        seen = seen.reshape(-1, size)
        n, q = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        shorter = np.broadcast_to(cost.reshape(1, -1, size), (len(seen) // max(1, cost.size // size), cost.size // size, size)).reshape(-1, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            longer = np.where(seen > 0, -np.log2(seen / (n + q)), -np.log2(q / (n + q)) + shorter)
        cost = np.where(n > 0, longer, shorter)
    return cost.reshape(-1).astype(np.float32)


def _tree(code: np.ndarray, counts: np.ndarray, size: int, order: int) -> list[tuple[np.ndarray, ...]]:
    """From the longest order to 0: sorted keys of seen (context, symbol) with their bits, and of contexts with the bits of an escape."""
    out = []
    for k in range(order, -1, -1):
        key, at = np.unique(code % np.int64(size ** (k + 1)), return_inverse=True)
        seen = np.bincount(at, weights=counts, minlength=len(key))
        context, of, q = np.unique(key // size, return_inverse=True, return_counts=True)
        n = np.bincount(of, weights=seen, minlength=len(context))
        out.append((key, -np.log2(seen / (n + q)[of]), context, -np.log2(q / (n + q))))
        code, counts = key, seen
    return out


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every wanted key, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _bits(tree: list[tuple[np.ndarray, ...]], code: np.ndarray, size: int) -> np.ndarray:
    """Bits of every code: of the longest seen context that has the symbol, and of the escapes on the way."""
    out = np.zeros(len(code))
    left = np.arange(len(code))
    for k, (key, bits, context, escape) in zip(range(len(tree) - 1, -1, -1), tree, strict=True):
        short = code[left] % np.int64(size ** (k + 1))
        at, there = _look(key, short)
        out[left[there]] += bits[at[there]]
        left, short = left[~there], short[~there]
        at, there = _look(context, short // size)
        out[left[there]] += escape[at[there]]
    out[left] += np.log2(size)
    return out


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> dict | None:
    """The trees of every language; None without learning rows."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = known.select("doc_id", "lang", F.octet_length("text").cast("long").alias("__size"))
    # the first rows by hash lie in a hash range of twice their share, so no task sorts a whole language
    counts = store_summary(known.groupBy("lang").agg(F.count(F.lit(1)).alias("__c")))
    share = F.lit(2.0 * per_lang) / F.col("__c")
    early = F.xxhash64("doc_id").cast("double") / float(1 << 63) < 2.0 * share - 1.0
    ranked = sizes.join(if_small(counts), "lang").where((share >= 1.0) | early).drop("__c").withColumn(
        "__n", F.row_number().over(first)).where(F.col("__n") <= per_lang)
    upto = F.sum("__size").over(Window.partitionBy("lang").orderBy("__n"))
    chosen = ranked.withColumn("__upto", upto).where((F.col("__n") == 1) | (F.col("__upto") <= SAMPLE_BYTES)).select("doc_id", "lang").distinct()
    langs = [r["lang"] for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    # at most per_lang ids a language: the stated bound of the sample
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    own = _symbols()
    number = {lang: i for i, lang in enumerate(langs)}

    def contexts(batches):
        for b in batches:
            raw, offsets = grams.text_bytes(b.column("text"))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])
            for text, code in _codes(raw, offsets, own, SYMBOLS, ORDER):
                key, n = np.unique(lang[text] * np.int64(SYMBOLS ** (ORDER + 1)) + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["k", "n"])

    # the different contexts of the sample, which is bounded
    found = sample.mapInArrow(contexts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    key, n = found.column("k").to_numpy(), found.column("n").to_numpy()
    lang, code = key // SYMBOLS ** (ORDER + 1), key % SYMBOLS ** (ORDER + 1)
    # a language whose sample holds no byte knows no context: every symbol costs the same
    trees = [_tree(code[lang == i], n[lang == i], SYMBOLS, ORDER) if (lang == i).any() else [] for i in range(len(langs))]
    return {"langs": langs, "own": own, "size": SYMBOLS, "order": ORDER, "trees": trees}


def code_lengths(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every text under every language, and its bytes."""
    raw, offsets = grams.text_bytes(column)
    bits = np.zeros((len(column), len(model["langs"])))
    for a, b in grams.batch_slices(offsets):
        part, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        for text, code in _codes(part, own, model["own"], model["size"], model["order"]):
            different, at = np.unique(code, return_inverse=True)
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for i, tree in enumerate(model["trees"]):
                bits[a + text[begin], i] += np.add.reduceat(_bits(tree, different, model["size"])[at], begin)
    return bits, np.diff(offsets)


def predict(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # bound of the broadcast: the contexts of the sample

    def name(batches):
        m = shared.value
        langs = np.array(m["langs"], dtype=object)
        for b in batches:
            bits, size = code_lengths(b.column(b.num_columns - 1), m)
            lettered = np.array(b.column(b.num_columns - 2).to_pylist(), dtype=bool)
            best = bits.argmin(1)
            gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(size, 1))[:, None]
            score = 1 / np.exp2(-gap).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(np.where(lettered, langs[best], "und"), pa.string()), pa.array(np.where(lettered, score, 0.0))],
                [*kept, "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*kept, lettered.alias("__lettered"), F.col("text").alias("__text")).mapInArrow(name, schema)
