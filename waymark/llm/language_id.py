"""Operator 1: hierarchical language identification.

The language family is predicted first, then one-versus-one linear support vector machines separate the languages of that
family. Families come from a fixed table of close relatives; a language that the table lacks joins the family ``other``.

Features are relative frequencies of byte n-grams (2 to 4 bytes of the lower-cased text, anything that is not a letter
being one space), hashed to fixed slots, so scoring is one pass over the bytes with a table lookup for each gram and takes whole
texts of any length. Only the text is an input of a prediction.

Fitting uses a bounded sample: ``sample_per_lang`` labelled rows of each language, drawn by a hash of the row over all partitions.
The driver gets sparse feature counts of that sample, never texts.

Cases. A null text or one without a letter is ``und`` with score 0. Rows with a null doc_id are not learned from. Without any training row every text is ``und``.
With a single learned language each text with a letter gets it. Rows are kept as they are, repeated ones too; on a clash of
column names the new columns get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import kernel as K
from waymark.llm.common import crc_of_id, draw, draw_bound, free_name

# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}

#: Bytes of a gram, and slots of each order.
ORDERS, SLOTS = (2, 3, 4), 1 << 13
WIDTH = len(ORDERS) * SLOTS

LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order: the slots of all grams, and their rows."""
    x = LETTER[data]
    # capital letters of Latin-1 in UTF-8: C3 80..9E to C3 A0..BE
    if len(x) > 1:
        capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)) + 1
        x[capital] += 32
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    gap = x == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1] & (row[1:] == row[:-1])
    x, row = x[keep].astype(np.uint32), row[keep]
    slots, rows = [], []
    for o, n in enumerate(ORDERS):
        m = len(x) - n + 1
        if m <= 0:
            slots.append(np.zeros(0, np.int64))
            rows.append(np.zeros(0, np.int64))
            continue
        g = np.zeros(m, np.uint32)
        for j in range(n):
            g = (g << np.uint32(8)) | x[j : m + j]
        g = (g * np.uint32(2654435761)) >> np.uint32(32 - 13)
        whole = row[:m] == row[n - 1 :]
        slots.append(g[whole].astype(np.int64) + o * SLOTS)
        rows.append(row[:m][whole])
    return slots, rows


@dataclass
class Model:
    """``names`` of the languages; ``pairs`` of (level, a, b): columns of ``weights`` that are positive for a."""

    names: list[str]
    family: list[int]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray


def margins(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's margin for each pair."""
    n = len(at) - 1
    out = np.zeros((n, len(model.pairs)))
    total = np.zeros(n)
    for slots, rows in zip(*grams(data, at), strict=True):
        if len(slots):
            begin = K.heads(rows)
            at_rows = rows[begin]
            total[at_rows] += np.diff(np.append(begin, len(rows)))
            for p in range(len(model.pairs)):
                out[at_rows, p] += np.add.reduceat(model.weights[p][slots], begin)
    return out / np.maximum(total, 1)[:, None] + model.bias


def decide(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row (an index) and its score: the family's probability times the language's within it."""
    n = len(margin)
    p = 1 / (1 + np.exp(-np.clip(margin * model.scale, -30, 30)))

    def level(members: list[int], which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        vote, sure, least = np.zeros((n, len(members))), np.zeros((n, len(members))), np.ones((n, len(members)))
        for x in which:
            a, b = members.index(model.pairs[x][1]), members.index(model.pairs[x][2])
            for own, prob in ((a, p[:, x]), (b, 1 - p[:, x])):
                vote[:, own] += prob > 0.5
                sure[:, own] += prob
                least[:, own] = np.minimum(least[:, own], prob)
        best = np.argmax(vote + sure / (len(members) + 1), axis=1)
        return np.array(members)[best], least[np.arange(n), best]

    families = sorted(set(model.family))
    family, sure = level(families, [x for x, q in enumerate(model.pairs) if q[0] == 0])
    lang = np.zeros(n, int)
    for f in families:
        members = [i for i, g in enumerate(model.family) if g == f]
        own, prob = level(members, [x for x, q in enumerate(model.pairs) if q[0] == 1 and q[1] in members])
        here = family == f
        lang[here] = own[here]
        sure[here] *= prob[here]
    return lang, sure


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 50.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent over sparse rows; the bias is a constant feature."""
    w, bias = np.zeros(WIDTH), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def training_rows(docs: DataFrame, usable: Column, sample_per_lang: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, slots, frequencies) of the sample."""
    known = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, draw_bound(1.3 * sample_per_lang, n))))
    own = draw("doc_id", seed=17)
    drawn = known.where(own < share[F.col("lang")]).select("lang", own.alias("draw"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # a row that is repeated very often counts once in a task
        for batch in batches:
            for i, j, data, at in K.slices(batch.column(3)):
                slots, rows = grams(data, at)
                slots, rows = np.concatenate(slots), np.concatenate(rows)
                order = np.argsort(rows, kind="stable")
                slots, edge = slots[order], np.searchsorted(rows[order], np.arange(j - i + 1))
                for r in range(j - i):
                    key = (batch.column(2)[i + r].as_py(), at[r + 1] - at[r])
                    if key in seen:
                        continue
                    seen.add(key)
                    own = np.bincount(slots[edge[r] : edge[r + 1]], minlength=WIDTH)
                    full = np.flatnonzero(own)
                    if len(full):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + r, 1), batch.column(1).slice(i + r, 1), K.ragged(full.astype(np.int32), np.array([len(full)]), pa.int32()), K.ragged((own[full] / own.sum()).astype(np.float32), np.array([len(full)]), pa.float32())], ["lang", "draw", "at", "share"])

    found = drawn.mapInArrow(run, "lang string, draw long, at array<int>, share array<float>").toArrow()
    out: list[tuple[str, np.ndarray, np.ndarray]] = []
    order = sorted(range(found.num_rows), key=lambda i: (found["lang"][i].as_py(), found["draw"][i].as_py(), len(found["at"][i])))
    left = dict.fromkeys(counts, sample_per_lang)
    for i in order:
        lang = found["lang"][i].as_py()
        if left[lang]:
            left[lang] -= 1
            out.append((lang, found["at"][i].values.to_numpy(), found["share"][i].values.to_numpy().astype(float)))
    return out


def fit(docs: DataFrame, usable: Column, sample_per_lang: int = 400) -> Model:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that are ``usable``, at most ``sample_per_lang`` of each language."""
    rows = training_rows(docs, usable, sample_per_lang)
    names = sorted({r[0] for r in rows})
    known = {lang: f for f, members in FAMILIES.items() for lang in members}
    kinds = sorted({known.get(x, "other") for x in names})
    family = [kinds.index(known.get(x, "other")) for x in names]
    mean = np.zeros(WIDTH)
    for _, at, v in rows:
        mean[at] += v / len(rows)
    weight = 1 / np.sqrt(mean + 1e-6)
    scaled = [(at, v * weight[at]) for _, at, v in rows]
    lang = np.array([names.index(r[0]) for r in rows], int)
    group = np.array([family[i] for i in lang], int)
    pairs = [(0, a, b) for a, b in combinations(sorted(set(family)), 2)]
    pairs += [(1, a, b) for f in sorted(set(family)) for a, b in combinations([i for i, g in enumerate(family) if g == f], 2)]
    weights, bias, scale = [], [], []
    for depth, a, b in pairs:
        of = lang if depth else group
        pick = np.flatnonzero((of == a) | (of == b))
        own = [scaled[i] for i in pick]
        sign = np.where(of[pick] == a, 1.0, -1.0)
        w, c = svm(own, sign)
        margin = np.array([w[at] @ v + c for at, v in own])
        weights.append(w * weight)
        bias.append(c)
        scale.append(4 / max(float(np.median(np.abs(margin))), 1e-9))
    return Model(names, family, pairs, np.array(weights).reshape(len(pairs), WIDTH), np.array(bias), np.array(scale))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    lang_name, score_name = free_name(docs, "lang_pred"), free_name(docs, "score")
    lettered = free_name(docs, "lettered")
    seen = docs.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    at_text = next(i for i, c in enumerate(seen.columns) if c.lower() == "text")
    names_out = [*docs.columns, lang_name, score_name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns
            lang, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            if model.names:
                for i, j, data, at in K.slices(cols[at_text]):
                    lang[i:j], score[i:j] = decide(model, margins(model, data, at))
            has = cols[-1].to_numpy(zero_copy_only=False) & bool(model.names)
            names = np.array([*model.names, "und"], object)
            pred = names[np.where(has, lang, len(model.names))]
            yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(pred, pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0))], names_out)

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return seen.mapInArrow(run, schema)


def held_out(docs: DataFrame, folds: int = 5) -> Column:
    return F.coalesce(crc_of_id(docs["doc_id"]) % folds == 0, F.lit(False))
