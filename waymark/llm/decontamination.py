"""Operator 2: benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

The items are indexed by word; every training passage is a query. A posting's impact is its BM25 weight divided by the item's
own total, so a score is the share of the item's BM25 mass that the passage covers, and one threshold serves items of any
length. Items are classed by the octave of their number of words, each class with an index and passages of its own: windows of
twice the octave's end at steps of it. So each item that a text holds lies whole in one passage, whole texts are searched, and an
item's passages depend on its own length alone.

A first test sums the block maxima of many passages at once, at most BOUNDS sums (the pivot test of WAND for a whole block of
items); what passes is searched by block-max WAND and all items at or above the threshold are retrieved. Each is verified: of the
5-word shingles of its question (the first words) and of its answer (the rest) at least ``overlap`` must be in the passage. A
short part has few shingles, and one word that differs or has something glued to it breaks them all; so an item is also held when
``overlap`` of its words lie in runs of RUN words that the passage holds and half of its answer's words are in the passage.

Document frequencies and the mean length are counted over all items first, so an item's matches and scores do not depend on its shard.
The items are read in shards of at most SHARD_ITEMS; SHARDS_A_PASS shards at a time are broadcast to the tasks, the documents are
never shuffled or joined.

Cases. Null or empty texts and items match nothing. A part of fewer than five words is one shingle. Equal items are all reported.
Repeated rows are each searched. An empty benchmark gives no match. Other columns are passed through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import kernel as K
from waymark.llm.common import Scratch

K1, B = 1.2, 0.75
#: Items of an index shard, and of a block of its postings.
SHARD_ITEMS, BLOCK = 2_000, 4
#: Shards that are searched in one pass over the documents: what a task holds.
SHARDS_A_PASS = 16
#: Sums of block maxima that are held at once.
BOUNDS = 1 << 22
#: Words of a run: with three, any one edited word leaves at least 0.8 of an item of 15 words or more.
RUN = 3


@dataclass
class Index:
    ids: list[int]
    vocab: np.ndarray  # word hashes, ascending
    begin: np.ndarray  # postings of word v: begin[v] to begin[v + 1], by item
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # greatest impact of each word
    block_begin: np.ndarray  # the same by block of items
    block: np.ndarray
    block_most: np.ndarray
    length: int  # the most words an item of this class may have
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # of each item: (k, shingles) of question and answer
    runs: list[tuple[int, np.ndarray, np.ndarray]]  # of each item: (k, its runs of k words in order, words of the answer)


def part_shingles(words: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    k = min(k, len(words))
    return k, np.unique(K.shingles(words, np.zeros(len(words), np.int64), k)[0]) if k else np.zeros(0, K.U)


@dataclass
class Shard:
    """The classes of a shard's items: an index each, and the place of each of the shard's words in its vocabulary, else -1."""

    vocab: np.ndarray
    classes: list[tuple[Index, np.ndarray]]


def build_shard(items: list[tuple[int, str]], corpus: tuple[int, float, dict[int, int]] | None = None) -> Shard | None:
    """The indexes of one shard; None if no item has a word."""
    octaves: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        if n := len(K.Words(*K.buffers(pa.array([item[1] or ""])))):
            octaves.setdefault(n.bit_length(), []).append(item)
    if not octaves:
        return None
    found = [build(own, corpus=corpus) for _, own in sorted(octaves.items())]
    vocab = np.unique(np.concatenate([x.vocab for x in found]))
    classes = []
    for x in found:
        place = np.full(len(vocab), -1)
        place[np.searchsorted(vocab, x.vocab)] = np.arange(len(x.vocab))
        classes.append((x, place))
    return Shard(vocab, classes)


def build(items: list[tuple[int, str]], k: int = 5, answer_share: float = 0.25, corpus: tuple[int, float, dict[int, int]] | None = None) -> Index | None:
    """The index of items of one class; None if no item has a word. ``corpus``: number of all items, their mean length, and in how many each word is; without it, of these."""
    ids, bags, parts, runs, length = [], [], [], [], 0
    for item_id, text in items:
        data, at = K.buffers(pa.array([text or ""]))
        h = K.Words(data, at).hash
        if not len(h):
            continue
        cut = len(h) - max(1, round(answer_share * len(h))) if len(h) > 1 else 1
        ids.append(item_id)
        bags.append(np.unique(h, return_counts=True))
        parts.append((part_shingles(h[:cut], k), part_shingles(h[cut:], k)))
        runs.append((min(RUN, len(h)), K.shingles(h, np.zeros(len(h), np.int64), min(RUN, len(h)))[0], h[cut:]))
        length = max(length, (1 << len(h).bit_length()) - 1)
    if not ids:
        return None
    vocab, df = np.unique(np.concatenate([w for w, _ in bags]), return_counts=True)
    sizes = np.array([c.sum() for _, c in bags])
    many, mean = len(ids), sizes.mean()
    if corpus:
        many, mean = corpus[:2]
        df = np.array([corpus[2][x] for x in vocab.view(np.int64).tolist()])
    idf = np.log(1 + (many - df + 0.5) / (df + 0.5))
    word, item, impact = [], [], []
    for i, (w, c) in enumerate(bags):
        v = np.searchsorted(vocab, w)
        x = idf[v] * c * (K1 + 1) / (c + K1 * (1 - B + B * sizes[i] / mean))
        word.append(v)
        item.append(np.full(len(v), i))
        impact.append(x / x.sum())
    word, item, impact = np.concatenate(word), np.concatenate(item), np.concatenate(impact)
    order = np.lexsort((item, word))
    word, item, impact = word[order], item[order], impact[order]
    begin = np.searchsorted(word, np.arange(len(vocab) + 1))
    head = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK))))
    return Index(ids, vocab, begin, item, impact, np.maximum.reduceat(impact, begin[:-1]), np.searchsorted(word[head], np.arange(len(vocab) + 1)), item[head] // BLOCK, np.maximum.reduceat(impact, head), length, parts, runs)


def block_max_wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least ``threshold`` for the distinct words ``terms``."""
    lists = [[int(index.begin[t]), int(index.begin[t + 1]), int(t)] for t in terms]
    item, impact, found = index.item, index.impact, []

    def advance(cursor: list[int], to: int) -> None:
        cursor[0] += int(np.searchsorted(item[cursor[0] : cursor[1]], to))

    while lists := [c for c in lists if c[0] < c[1]]:
        lists.sort(key=lambda c: item[c[0]])
        bound, pivot = 0.0, -1
        for p, c in enumerate(lists):
            bound += index.most[c[2]]
            if bound >= threshold:
                pivot = p
                break
        if pivot < 0:
            return found
        at = int(item[lists[pivot][0]])
        while pivot + 1 < len(lists) and item[lists[pivot + 1][0]] == at:
            pivot += 1
        block, bound = at // BLOCK, 0.0
        for c in lists[: pivot + 1]:
            lo, hi = index.block_begin[c[2]], index.block_begin[c[2] + 1]
            x = lo + np.searchsorted(index.block[lo:hi], block)
            if x < hi and index.block[x] == block:
                bound += index.block_most[x]
        if bound < threshold:
            # no item of this block can reach it with the words up to the pivot
            to = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                to = min(to, int(item[lists[pivot + 1][0]]))
            for c in lists[: pivot + 1]:
                advance(c, to)
        elif item[lists[0][0]] == at:
            score = float(sum(impact[c[0]] for c in lists[: pivot + 1]))
            if score >= threshold:
                found.append((at, score))
            for c in lists[: pivot + 1]:
                c[0] += 1
        else:
            for c in lists[:pivot]:
                if item[c[0]] < at:
                    advance(c, at)
    return found


def share_in(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """The share of a part's shingles that the passage ``words`` holds; an empty part is held by any."""
    k, own = part
    if not k:
        return 1.0
    return float(np.isin(own, K.shingles(words, np.zeros(len(words), np.int64), k)[0]).mean()) if len(words) >= k else 0.0


def in_runs(item: tuple[int, np.ndarray, np.ndarray], words: np.ndarray) -> float:
    """The share of an item's words that lie in runs which the passage ``words`` holds; 0 if it lacks over half of the answer's words."""
    k, own, answer = item
    if len(words) < k or (len(answer) and 2 * np.isin(answer, words).sum() < len(answer)):
        return 0.0
    held = np.isin(own, K.shingles(words, np.zeros(len(words), np.int64), k)[0])
    inside = np.zeros(len(own) + k - 1, bool)
    for j in range(k):
        inside[j : j + len(own)] |= held
    return float(inside.mean())


def search(shard: Shard, w: K.Words, at: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item's id, score, question's share, answer's share) of all verified matches of some rows, best passage each."""
    v = np.minimum(np.searchsorted(shard.vocab, w.hash), len(shard.vocab) - 1)
    hit = np.flatnonzero(shard.vocab[v] == w.hash)
    out = []
    for index, place in shard.classes:
        own = place[v[hit]]
        out += search_class(index, w, at, hit[own >= 0], own[own >= 0], threshold, overlap)
    return out


def search_class(index: Index, w: K.Words, at: np.ndarray, hit: np.ndarray, term: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """The matches of one class; ``hit`` are the words that its items have, ``term`` their numbers in its vocabulary."""
    if not len(hit):
        return []
    edge = np.searchsorted(w.row, np.arange(len(at)))
    n_words = np.diff(edge)
    last = np.maximum(-(-n_words // index.length) - 2, 0)  # each row's last passage
    base = np.concatenate(([0], np.cumsum(last + 1)))
    row, place = w.row[hit], hit - edge[w.row[hit]]
    second = np.minimum(place // index.length, last[row])
    first = np.maximum(place // index.length - 1, 0)
    terms, passage = K.distinct(np.concatenate([term] * 2).astype(np.int64), base[np.concatenate([row, row])] + np.concatenate([np.minimum(first, last[row]), second]))
    blocks = int(index.block.max()) + 1
    heads = K.heads(passage)
    ends = np.append(heads, len(passage))
    some = []
    for g in range(0, len(heads), group := max(1, BOUNDS // blocks)):
        # block maxima of a group of passages
        own, many = terms[ends[g] : ends[min(g + group, len(heads))]], min(group, len(heads) - g)
        size = index.block_begin[own + 1] - index.block_begin[own]
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        post = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(index.block_begin[own], size)
        local = np.repeat(np.arange(many), np.diff(ends[g : g + many + 1]))
        bound = np.bincount(np.repeat(local, size) * blocks + index.block[post], weights=index.block_most[post], minlength=many * blocks).reshape(-1, blocks)
        some += (g + np.flatnonzero((bound >= threshold).any(axis=1))).tolist()
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for x in some:
        p = passage[heads[x]]
        r = int(np.searchsorted(base, p, side="right") - 1)
        for i, score in block_max_wand(index, terms[heads[x] : ends[x + 1]], threshold):
            lo = edge[r] + (p - base[r]) * index.length
            words = w.hash[lo : edge[r + 1] if p - base[r] == last[r] else min(lo + 2 * index.length, edge[r + 1])]
            question, answer = (share_in(part, words) for part in index.parts[i])
            if (question >= overlap and answer >= overlap) or in_runs(index.runs[i], words) >= overlap:
                best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (score, question, answer))
    return [(r, index.ids[i], *x) for (r, i), x in sorted(best.items())]


def statistics(items: DataFrame) -> DataFrame:
    """``(word, items, words)``: in how many items each word is; the row without a word has the number of items that have words, and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in K.slices(batch.column(0)):
                w = K.Words(data, at)
                word, row = K.distinct(w.hash, w.row)
                sizes = np.bincount(w.row, minlength=1)
                sizes = sizes[sizes > 0]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.ones(len(word), np.int64))], ["word", "words"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(sizes.astype(np.int64))], ["word", "words"])

    return items.select("text").mapInArrow(run, "word long, words long").groupBy("word").agg(F.count("*").alias("items"), F.sum("words").alias("words"))


def shards(benchmark: DataFrame) -> Iterator[Shard]:
    """The indexes of the items, by shards of bounded size; document frequencies and mean length are those of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = max(1, -(-items.count() // (SHARD_ITEMS // 2)))
    with Scratch(benchmark.sparkSession) as scratch:
        table = scratch.store(statistics(items), "words")
        many, total = (table.where("word is null").select("items", "words").first() or (0, 0))[:2]
        for s in range(n):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == s) if n > 1 else items
            rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            for at in range(0, len(rows), SHARD_ITEMS):
                part = rows[at : at + SHARD_ITEMS]
                words = np.unique(K.Words(*K.buffers(pa.array([t for _, t in part], pa.string()))).hash).view(np.int64)
                known = F.broadcast(benchmark.sparkSession.createDataFrame(pa.table({"own": words})))  # the words of a bounded shard
                found = table.join(known, F.col("word") == F.col("own")).select("word", "items").toArrow()
                frequency = dict(zip(found["word"].to_pylist(), found["items"].to_pylist(), strict=True))
                if many and (shard := build_shard(part, (many, total / many, frequency))):
                    yield shard


def passes(benchmark: DataFrame) -> Iterator[Broadcast[list[Shard]]]:
    """The shards that go through the documents together, broadcast: at most SHARDS_A_PASS times SHARD_ITEMS items."""
    every = shards(benchmark)
    while own := list(itertools.islice(every, SHARDS_A_PASS)):
        yield benchmark.sparkSession.sparkContext.broadcast(own)


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of every document and item that it holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for shared in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast[list[Shard]] = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, data, at in K.slices(batch.column(1)):
                    w = K.Words(data, at)
                    for shard in shared.value:
                        if found := search(shard, w, at, threshold, overlap):
                            rows, items, *rest = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + r for r in rows])), pa.array(items, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at_text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    for shared in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast[list[Shard]] = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, at in K.slices(batch.column(at_text)):
                    w = K.Words(data, at)
                    for shard in shared.value:
                        clean[[i + f[0] for f in search(shard, w, at, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
