"""Held-out passages in training text: BM25 index of the items with block-max bounds, then exact overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make an overlap.
OVERLAP = 8
#: Words of a passage; passages of a document overlap by OVERLAP - 1 words, so no overlap is cut.
PASSAGE = 48
#: Items of an index block, whose highest impact per term bounds the scores in it.
BLOCK = 16
#: Items and distinct words that an index may hold; it is broadcast and refused beyond.
MAX_ITEMS, MAX_TERMS = 20_000, 200_000
K1, B = 1.2, 0.75

# What is not speech in a subtitle file.
_TAGS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|﻿")
_NOT_SPEECH = re.compile(r"^(?:[^\S\n]*\d+[^\S\n]*|.*-->.*|[^\S\n]*WEBVTT.*)$", re.M)
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)")
_SPEAKER = re.compile(r"^[^\S\n]*(?:[-–—][^\S\n]*)?[A-ZÀ-ÖØ-ÞŒŸ][A-ZÀ-ÖØ-ÞŒŸ0-9 .'’\-]*:", re.M)
_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def speech_words(text: str | None) -> list[str]:
    """Words of a subtitle file's speech, running on across lines and cues; none for null or empty text."""
    if not text:
        return []
    t = _TAGS.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = _SOUND.sub(" ", _NOT_SPEECH.sub("", t))
    return _WORD.findall(_SPEAKER.sub(" ", t).lower())


@dataclass(frozen=True)
class ItemIndex:
    """Inverted index of test items: sparse postings by term, and the highest impact of each term in each block of BLOCK items.

    Impacts are BM25 contributions divided by the least score of a passage that holds OVERLAP words of the item in a row, so
    that 1 is the threshold of every item. Size: 16 bytes a posting and 16 a block posting; nothing is dense.
    """

    ids: np.ndarray  # item ids
    vocab: dict[str, int]
    start: np.ndarray  # int64 [terms + 1]: postings of each term, by item
    item: np.ndarray  # int32 [postings]
    impact: np.ndarray  # float32 [postings]
    key: np.ndarray  # int64 [postings]: term and item as one ascending number
    block_start: np.ndarray  # the same for blocks, with the highest impact in each
    block: np.ndarray
    block_max: np.ndarray
    block_key: np.ndarray
    top: np.ndarray  # float32 [terms]: highest impact of all
    grams: dict[tuple, list[int]]  # run of OVERLAP term numbers -> items that hold it

    @staticmethod
    def build(items: list[tuple[int, str | None]]) -> ItemIndex:
        """Items without id or with fewer than OVERLAP words cannot be met and are left out."""
        docs = [(i, words_of(_TAGS.sub("", t or ""))) for i, t in items if i is not None]
        docs = sorted((i, w) for i, w in docs if len(w) >= OVERLAP)
        if len(docs) > MAX_ITEMS:
            raise ValueError(f"{len(docs)} items; the index holds at most {MAX_ITEMS}")
        vocab = {w: k for k, w in enumerate(sorted({w for _, ws in docs for w in ws}))}
        if len(vocab) > MAX_TERMS:
            raise ValueError(f"{len(vocab)} distinct words; the index holds at most {MAX_TERMS}")
        df = Counter(w for _, ws in docs for w in set(ws))
        mean = sum(len(ws) for _, ws in docs) / max(1, len(docs))
        posts, grams = [], {}
        for j, (_, ws) in enumerate(docs):
            own = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                own[vocab[w]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            t = [vocab[w] for w in ws]
            runs = {tuple(t[i : i + OVERLAP]) for i in range(len(t) - OVERLAP + 1)}
            least = min(sum(own[k] for k in set(r)) for r in runs)
            posts += [(k, j, v / least) for k, v in own.items()]
            for r in runs:
                grams.setdefault(r, []).append(j)
        posts.sort()
        term, item, impact = (np.array([p[c] for p in posts], kind) for c, kind in ((0, np.int64), (1, np.int32), (2, np.float32)))
        starts = np.searchsorted(term, np.arange(len(vocab) + 1))
        heads = np.flatnonzero(np.diff(term * (len(docs) + BLOCK) + item // BLOCK, prepend=-1)) if len(term) else np.empty(0, np.int64)
        highest = np.maximum.reduceat(impact, heads) if len(heads) else impact
        top = np.maximum.reduceat(impact, starts[:-1]) if len(vocab) else impact
        ids = np.array([i for i, _ in docs], np.int64)
        width, block = len(docs) + BLOCK, item[heads] // BLOCK
        block_starts = np.searchsorted(term[heads], np.arange(len(vocab) + 1))
        return ItemIndex(ids, vocab, starts, item, impact, term * width + item, block_starts, block, highest, term[heads] * width + block, top, grams)

    def search(self, docs: list[list[str]]) -> list[tuple[int, int]]:
        """(document number, item number) of every overlap; block-max WAND over many passages at once.

        A passage without OVERLAP index words in a row has no overlap. In the others, terms are taken by their highest impact:
        those below the pivot cannot reach the threshold together, so only blocks with a term from the pivot on are looked at.
        Of these, a block is skipped if its terms' highest impacts there stay under the threshold; in the blocks left every
        item that reaches the threshold is retrieved, and its overlap verified.
        """
        if not len(self.ids):
            return []
        number = self.vocab.get
        terms = [np.array([number(w, -1) for w in d], np.int32) for d in docs]
        step, spans = PASSAGE - OVERLAP + 1, []
        for n, t in enumerate(terms):
            if len(t) >= OVERLAP:
                sums = np.concatenate([[0], np.cumsum(t >= 0)])
                ends = np.flatnonzero(sums[OVERLAP:] - sums[:-OVERLAP] == OVERLAP)  # runs of OVERLAP index words start here
                spans += [(n, s * step) for s in np.unique(ends // step).tolist()]
        found: set[tuple[int, int]] = set()
        runs: dict[int, dict[int, list[int]]] = {}
        for at in range(0, len(spans), 2048):
            part = spans[at : at + 2048]
            for p, item in self._retrieve(terms, part):
                n, s = part[p]
                if n not in runs:
                    runs[n] = self._runs(terms[n])
                if any(s <= i <= s + PASSAGE - OVERLAP for i in runs[n].get(item, ())):
                    found.add((n, item))
        return sorted(found)

    def _retrieve(self, terms: list[np.ndarray], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(passage, item) of every item that reaches the threshold in a passage."""
        m = np.full((len(spans), PASSAGE), -1, np.int64)
        for r, (n, s) in enumerate(spans):
            t = terms[n][s : s + PASSAGE]
            m[r, : len(t)] = t
        m.sort(axis=1)
        m[:, 1:][m[:, 1:] == m[:, :-1]] = -1  # a term counts once a passage
        top = np.where(m >= 0, self.top[m], 0)
        order = np.argsort(top, axis=1)
        row = np.arange(len(m))[:, None]
        m = m[row, order]
        pivot = (np.cumsum(top[row, order], axis=1) >= 1 - 1e-4) & (m >= 0)
        blocks = -(-len(self.ids) // BLOCK)
        p, k = np.nonzero(pivot)
        i, at = _ranges(self.block_start[m[p, k]], self.block_start[m[p, k] + 1])
        pairs = np.unique(p[i] * blocks + self.block[at])
        # the block's bound: highest impacts there of all terms of the passage
        p, b = pairs // blocks, pairs % blocks
        bound = np.zeros(len(p))
        for c in range(PASSAGE):
            lo, hi = self._within(m[p, c], b, b, self.block_key)
            bound += np.where(hi > lo, self.block_max[np.minimum(lo, len(self.block_max) - 1)], 0)
        p, b = p[bound >= 1 - 1e-4], b[bound >= 1 - 1e-4]
        first = (b * BLOCK)[:, None]
        i, at = _ranges(*self._within(m[p], first, first + BLOCK - 1, self.key))
        score = np.bincount((i // PASSAGE) * BLOCK + self.item[at] % BLOCK, self.impact[at], len(p) * BLOCK)
        hit = np.flatnonzero(score >= 1 - 1e-4)
        return list(zip(p[hit // BLOCK].tolist(), (b[hit // BLOCK] * BLOCK + hit % BLOCK).tolist()))

    def _within(self, t: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, among the keys of each term t, of the numbers low..high; the same place twice if there is none."""
        width = len(self.ids) + BLOCK
        lo = np.searchsorted(keys, (t * width + low).ravel())
        hi = np.searchsorted(keys, (t * width + high).ravel(), side="right")
        return lo, np.where((t >= 0).ravel(), hi, lo)

    def _runs(self, t: np.ndarray) -> dict[int, list[int]]:
        """item -> places in a document where OVERLAP words of that item stand in a row."""
        sums = np.concatenate([[0], np.cumsum(t >= 0)])
        out: dict[int, list[int]] = {}
        words = t.tolist()
        for i in np.flatnonzero(sums[OVERLAP:] - sums[:-OVERLAP] == OVERLAP).tolist():
            for item in self.grams.get(tuple(words[i : i + OVERLAP]), ()):
                out.setdefault(item, []).append(i)
        return out


def _usable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f[[bool(t) and len(words_of(_TAGS.sub("", t))) >= OVERLAP for t in f["item_text"]]]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for all places of the ranges lo..hi."""
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def leaks(docs: DataFrame, items: DataFrame, batch: int = 512) -> DataFrame:
    """(doc_id, item_id) of every document whose speech holds OVERLAP consecutive words of an item.

    The items (a bounded set, see MAX_ITEMS) are indexed on the driver and broadcast; the corpus is read once, whole texts,
    without a shuffle. Documents with null id are left out; null or empty texts have no overlap; a repeated row gives its
    pairs once for each copy of the row only if ids repeat across batches, so pairs are made distinct at the end.
    """
    spark = docs.sparkSession
    # only items of OVERLAP words and more can be met; they are told apart before the bound is asked, so that none is cut off
    usable = items.where("item_id IS NOT NULL").select("item_id", "item_text").mapInPandas(_usable, "item_id long, item_text string")
    rows = usable.limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"over {MAX_ITEMS} items; the index holds at most {MAX_ITEMS}")
    index = spark.sparkContext.broadcast(ItemIndex.build([(r[0], r[1]) for r in rows]))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx = index.value
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                ids = part["doc_id"].to_numpy()
                hits = idx.search([speech_words(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": [ids[n] for n, _ in hits], "item_id": [idx.ids[j] for _, j in hits]}, dtype="int64")

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long").distinct()
