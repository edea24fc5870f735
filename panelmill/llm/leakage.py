"""Evaluation passages in a corpus: latent semantic retrieval, then alignment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.text import Ids, skeleton, words
from panelmill.sources.tables import durable

BLOCK = 16  # words; a passage of the corpus is two neighbouring blocks
PASSAGE, STRIDE = 24, 8  # words of a query passage, and from one to the next
SEED, PAD = 5, 64  # consecutive words of an item that are searched for exactly; words between two items
ZONE, REACH = 128, 64  # words of an item that share one alignment window, and how far it reaches beyond them
SHARED = 3  # items that share a first sentence, for it to count as an instruction
OUT, IN = 5, 6  # words by which the end of an alignment may move outwards and inwards


class Items:
    """The held-out items of one pass as arrays: vocabulary, words of each item, query passages."""

    def __init__(self, rows: list, dull: set[tuple[str, ...]]):
        self.ids = [r["item_id"] for r in rows]
        texts = [[skeleton(w) for w in words(strip_opening(r["text"], dull))] for r in rows]
        answers = [[skeleton(w) for w in words(r["answer"] or "")] for r in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts + answers for w in t}))}
        self.words = [np.array([self.vocabulary[w] for w in t], np.int32) for t in texts]
        self.answers = [[self.vocabulary[w] for w in a] for a in answers]
        self.passages, self.owner, self.start = [], [], []
        for k, w in enumerate(self.words):
            for s in range(0, max(1, len(w) - PASSAGE + STRIDE), STRIDE):
                if len(w) and (s == 0 or len(w) - s >= BLOCK):
                    self.passages.append(w[s : s + PASSAGE])
                    self.owner.append(k)
                    self.start.append(s)
        self.owner, self.start = np.array(self.owner, int), np.array(self.start, int)
        self.padded = np.full((len(self.passages), PASSAGE), -2, np.int32)
        for k, p in enumerate(self.passages):
            self.padded[k, : len(p)] = p


def first_sentence(text: str) -> tuple[str, ...]:
    return tuple(words((text or "").split(".", 1)[0]))


def strip_opening(text: str | None, dull: set[tuple[str, ...]]) -> str:
    """The text without a first sentence that many items share (an instruction to the reader)."""
    text = text or ""
    return text.split(".", 1)[1] if "." in text and first_sentence(text) in dull else text


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents, each padded to whole blocks with -1; document of each block; first block of each document."""
    n = pdf["words"].map(len).to_numpy()
    blocks = np.maximum(1, -(-n // BLOCK))
    first = np.concatenate([[0], blocks.cumsum()[:-1]]).astype(np.int64)
    flat = np.full(int(blocks.sum()) * BLOCK, -1, np.int32)
    if n.sum():
        at = np.repeat(first * BLOCK - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        flat[at] = np.concatenate(pdf["words"].to_numpy())
    return flat, np.repeat(np.arange(len(pdf)), blocks), first


def _project(flat: np.ndarray, table: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Sum of the table's rows over each block; the last row of table stands for other words."""
    out = np.empty((len(flat) // BLOCK, table.shape[1]), np.float32)
    for lo in range(0, len(out), chunk):
        part = table[flat[lo * BLOCK : (lo + chunk) * BLOCK]]
        out[lo : lo + chunk] = part.reshape(-1, BLOCK, table.shape[1]).sum(1)
    return out


def passage_counts(tokens: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Blocks that hold each word of the vocabulary, and blocks in all, over the whole corpus."""

    def count(batches):
        total, blocks = np.zeros(size, np.int64), 0
        for pdf in batches:
            if len(pdf):
                flat = _flat(pdf)[0].reshape(-1, BLOCK)
                blocks += len(flat)
                s = np.sort(flat, axis=1)
                new = np.ones(s.shape, bool)
                new[:, 1:] = s[:, 1:] != s[:, :-1]
                total += np.bincount(s[new & (s >= 0)], minlength=size)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": np.append(k, -1), "n": np.append(total[k], blocks)})

    got = tokens.select("words").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size, np.int64)
    df[got["k"][got["k"] >= 0]] = got["n"][got["k"] >= 0]
    return df, int(got["n"][got["k"] < 0].sum())


def latent_basis(tokens: DataFrame, idf: np.ndarray, rank: int, share: float, seed: int) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of corpus blocks, by a randomised range finder.

    Each task multiplies its blocks with a seeded Gaussian test matrix and back, and sends
    words x (rank + 10) sums; the small eigenproblem (Nyström) is solved on the driver.
    share is the part of the documents that the basis is fitted on, by a hash of doc_id.
    """
    size = len(idf)
    test = np.random.default_rng(seed).standard_normal((size, rank + 10))
    table = np.vstack([test * idf[:, None], np.zeros((1, rank + 10))]).astype(np.float32)

    def sketch(batches):
        z = np.zeros((size + 1, rank + 10), np.float32)
        for pdf in batches:
            if len(pdf):
                flat = _flat(pdf)[0]
                y = np.repeat(_project(flat, table), BLOCK, axis=0)
                order = np.argsort(flat, kind="stable")
                s = flat[order]
                start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                z[s[start]] += np.add.reduceat(y[order], start, axis=0)
        z = z[:size] * idf[:, None].astype(np.float32)
        used = np.flatnonzero(np.abs(z).sum(1))
        yield pd.DataFrame({"k": used, "v": pd.Series(list(z[used]), dtype=object)})

    chosen = tokens.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = chosen.select("words").mapInPandas(sketch, "k long, v array<float>")
    sums = rows.select("k", F.posexplode("v").alias("j", "x")).groupBy("k", "j").agg(F.sum("x").alias("x")).toPandas()
    z = np.zeros((size, rank + 10))
    z[sums["k"], sums["j"]] = sums["x"]
    core = test.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value.max(), 1e-12) * 1e-7
    if not keep.any():
        return np.zeros((size, 1))
    left = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)[0]
    return left[:, :rank]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of a with the row of b: words of a and of b that it spans, and words that agree."""
    a0, a1, b0, b1, same = align_ends(a, b)
    return a1 - a0, b1 - b0, same


def align_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of a with the row of b: start and end in a, start and end in b, words that agree.

    Longest common subsequence with a price: an agreeing word counts 2, a changed, added
    or lost one -3. Negative numbers never agree.
    """
    count, m = b.shape
    one, price = np.int64(2) << 40, np.int64(3) << 40
    hit = one + (np.int64(1) << 28)
    column = np.arange(m + 1, dtype=np.int64)
    slope = price * column
    prev = np.broadcast_to(column, (count, m + 1)).copy()
    best, end = np.zeros(count, np.int64), np.zeros((count, 2), np.int64)
    for i in range(1, a.shape[1] + 1):
        w = a[:, i - 1 : i]
        cur = np.empty_like(prev)
        cur[:, 0] = np.int64(i) << 14
        cur[:, 1:] = np.maximum(prev[:, :-1] + np.where((w == b) & (w >= 0), hit, -price), prev[:, 1:] - price)
        fresh = (np.int64(i) << 14) + column
        cur = np.where(cur < (1 << 40), fresh, cur)
        cur = np.maximum.accumulate(cur + slope, axis=1) - slope
        cur = np.where(cur < (1 << 40), fresh, cur)
        j = cur.argmax(1)
        top = cur[np.arange(count), j]
        more = top > best
        best = np.where(more, top, best)
        end[more] = np.stack([np.full(count, i), j], 1)[more]
        prev = cur
    mask = (np.int64(1) << 14) - 1
    return (best >> 14) & mask, end[:, 0], best & mask, end[:, 1], (best >> 28) & ((np.int64(1) << 12) - 1)


def _side(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways to move one end (word i of a, word j of b) outwards or inwards: words of a, of b and agreeing words that each adds; impossible ways add minus 99."""
    r = np.arange(len(a))
    at = lambda x, k: np.where((k >= 0) & (k < x.shape[1]), x[r, np.clip(k, 0, x.shape[1] - 1)], -3)
    da, db, dm = [0], [0], [np.zeros(len(a), np.int64)]
    for shift in (0, 1, -1):
        total, possible = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(OUT):
            w, v = at(a, i + step * (k + (shift < 0))), at(b, j + step * (k + (shift > 0)))
            possible &= (w >= 0) & (v > -3)
            total = total + ((w == v) & (w >= 0))
            da.append(k + 1 + (shift < 0))
            db.append(k + 1 + (shift > 0))
            dm.append(np.where(possible, total, -99))
    total = np.zeros(len(a), np.int64)
    for k in range(IN):
        total = total - (at(a, i - step * (k + 1)) == at(b, j - step * (k + 1)))
        da.append(-k - 1)
        db.append(-k - 1)
        dm.append(total)
    return np.array(da), np.array(db), np.stack(dm, 1)


def stretch(a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, ...], least: int, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of a and agreeing words of the stretch with most agreeing words that holds `least` words and the part `agree`, near the ends of an alignment; 0 where there is none.

    The price of align() trims a changed word that has fewer than two agreeing words outside,
    and carries an alignment over changed words to chance matches; here either end moves up
    to OUT words outwards (one added or lost word among them) or IN inwards, and changed
    words count as part of the stretch. Negative numbers of a are padding; -3 of b is no word.
    """
    a0, a1, b0, b1, same = ends
    la, lb, lm = _side(a, b, a0 - 1, b0 - 1, -1)
    ra, rb, rm = _side(a, b, a1, b1, 1)
    span = (a1 - a0)[:, None, None] + la[:, None] + ra
    other = (b1 - b0)[:, None, None] + lb[:, None] + rb
    hit = same[:, None, None] + lm[:, :, None] + rm[:, None, :]
    ok = (span >= least) & (hit >= agree * np.maximum(span, other))
    best = np.where(ok, hit * 1024 - span, -1).reshape(len(a), -1).argmax(1)
    r = np.arange(len(a))
    good = ok.reshape(len(a), -1)[r, best]
    return np.where(good, span.reshape(len(a), -1)[r, best], 0), np.where(good, hit.reshape(len(a), -1)[r, best], 0)


class Seeds:
    """Exact search for items: places where SEED consecutive words of an item stand in a document.

    A stretch of 20 words with three changed, added or lost words (more than one in eight) still
    holds five consecutive words unchanged, so no such leak is passed over.
    """

    def __init__(self, items: list[np.ndarray]):
        gap = [-2] * PAD
        self.words = np.array([*gap, *[w for x in items for w in (*x, *gap)]], np.int32)
        owner = np.concatenate([np.full(PAD, -1), *[np.full(len(x) + PAD, k) for k, x in enumerate(items)]])
        key, ok = self.keys(self.words)
        at = np.flatnonzero(ok)
        at = at[np.argsort(key[at], kind="stable")]
        self.key, self.at, self.owner = key[at], at, owner
        self.first = PAD + np.cumsum([0, *[len(x) + PAD for x in items]])[:-1] if items else np.zeros(0, int)

    @staticmethod
    def keys(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the SEED words from each place on, and whether all of them are words of the items."""
        n = max(0, len(flat) - SEED + 1)
        key, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(SEED):
            ok &= flat[k : k + n] >= 0
            key = key * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n].astype(np.uint64) + np.uint64(1)
        return key, ok

    def find(self, flat: np.ndarray, first: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, item, zone of the item), distinct: blocks where a seed begins that lies in `least` words of which the part 0.8 is in step with the item's, up to three words off.

        first and end bound the document of each block, in words of flat.
        """
        key, ok = self.keys(flat)
        p = np.flatnonzero(ok)
        p = p[p + SEED <= end[p // BLOCK]]
        lo, hi = (np.searchsorted(self.key, key[p], side) for side in ("left", "right"))
        many = hi - lo
        p, lo, many = p[many > 0], lo[many > 0], many[many > 0]
        p, q = np.repeat(p, many), self.at[np.repeat(lo - many.cumsum() + many, many) + np.arange(many.sum())]
        # of seeds that follow each other in a block the first stands for all: moved back to it, no stretch loses a word in step
        new = (p % BLOCK == 0) | (flat[p - 1] != self.words[q - 1])
        p, q = p[new], q[new]
        around, off = np.arange(SEED - least, least), 3
        wide = np.arange(around[0] - off, around[-1] + off + 1)
        keep = np.zeros(len(p), bool)
        for s in range(0, len(p), 4096):
            at = p[s : s + 4096, None] + wide
            b = p[s : s + 4096, None] // BLOCK
            text = np.where((at >= first[b]) & (at < end[b]), flat[np.clip(at, 0, len(flat) - 1)], -1)
            item = self.words[np.clip(q[s : s + 4096, None] + around, 0, len(self.words) - 1)]
            same = np.zeros(item.shape, bool)
            for k in range(2 * off + 1):
                same |= item == text[:, k : k + item.shape[1]]
            run = np.pad(same.cumsum(1, dtype=np.int16), ((0, 0), (1, 0)))
            keep[s : s + 4096] = (run[:, least:] - run[:, : run.shape[1] - least]).max(1) >= 0.8 * least
        owner = self.owner[q[keep]]
        found = np.unique(np.stack([p[keep] // BLOCK, owner, (q[keep] - self.first[owner]) // ZONE]), axis=1)
        return found[0], found[1], found[2]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of a with the row of b; negative numbers never agree."""
    prev = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        hit = (a[:, i : i + 1] == b) & (b >= 0)
        cur = prev.copy()
        cur[:, 1:] = np.maximum(prev[:, 1:], np.where(hit, prev[:, :-1] + 1, 0))
        prev = np.maximum.accumulate(cur, axis=1)
    return prev[:, -1].astype(int)


def quick_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`common_subsequence` for rows of a of at most 24 words, one bit a word: all rows advance by one word of b at a time."""
    m = a.shape[1]
    bits = (2.0 ** np.arange(m)).astype(np.float32)
    match = ((b[:, :, None] == a[:, None, :]) & (b >= 0)[:, :, None]).astype(np.float32) @ bits
    match = match.astype(np.uint64)
    v = np.full(len(a), (1 << m) - 1, np.uint64)
    for j in range(b.shape[1]):
        u = v & match[:, j]
        v = (v + u) | (v - u)
    return m - np.bitwise_count(v & np.uint64((1 << m) - 1)).astype(int)


def covered(rows: pd.DataFrame) -> pd.DataFrame:
    """Alignments (d, k, a0, span, agreeing, cosine) as one row per d and k: words of the item that they cover together, and the agreeing ones of them (in proportion where alignments overlap)."""
    rows = rows.sort_values(["d", "k", "a0", "span"])
    out: dict[tuple[int, int], list[float]] = {}
    for d, k, a0, span, agreeing, cosine in zip(*(rows[c].to_numpy() for c in ("d", "k", "a0", "span", "agreeing", "cosine"))):
        state = out.setdefault((d, k), [0, 0.0, -1, 0.0])
        new = max(0, a0 + span - max(a0, state[2]))
        state[0] += new
        state[1] += agreeing * new / max(span, 1)
        state[2] = max(state[2], a0 + span)
        state[3] = max(state[3], cosine)
    return pd.DataFrame([(d, k, int(v[0]), round(v[1]), v[3]) for (d, k), v in out.items()], columns=["d", "k", "span", "agreeing", "cosine"])


class Search:
    """Search of one pass of items in batches of documents (doc_id, words as numbers of the items' vocabulary)."""

    def __init__(self, held: Items, table: np.ndarray, cosine: float, least: int, agree: float, agree_long: float):
        self.table, self.cosine, self.least, self.agree, self.agree_long = table, cosine, least, agree, agree_long
        self.ids, self.owner, self.start, self.padded = np.array(held.ids), held.owner, held.start, held.padded
        self.answers = [np.array(a, np.int32) for a in held.answers]
        query = np.stack([table[p].sum(0) for p in held.passages]) if held.passages else np.zeros((0, table.shape[1]), np.float32)
        norm = np.linalg.norm(query, axis=1, keepdims=True)
        self.query = np.ascontiguousarray((query / np.where(norm > 0, norm, 1)).T)
        self.seeds = Seeds(held.words)
        self.passages_of = [np.flatnonzero(held.owner == k) for k in range(len(held.words))]
        self.width = min(ZONE + 2 * REACH, max((len(w) for w in held.words), default=0))

    def window(self, item: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the item around its zone (-2 beyond its ends), and the place of the first of them."""
        lo = np.maximum(zone * ZONE - REACH, 0)
        at = self.seeds.first[item] + lo
        w = at[:, None] + np.arange(self.width)
        inside = self.seeds.owner[np.clip(w, 0, len(self.seeds.words) - 1)] == item[:, None]
        return np.where(inside & (w < len(self.seeds.words)), self.seeds.words[np.clip(w, 0, len(self.seeds.words) - 1)], -2), lo

    def __call__(self, batches):
        for pdf in batches:
            if len(pdf) and self.query.shape[1]:
                found = self.batch(pdf)
                if len(found):
                    yield found

    def candidates(self, flat, owner_doc, first, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, item, zone, cosine): places by cosine in the latent space and by exact seeds, once each."""
        vec = _project(flat, self.table)
        vec[:-1] += np.where((owner_doc[1:] == owner_doc[:-1])[:, None], vec[1:], 0)
        n = np.linalg.norm(vec, axis=1, keepdims=True)
        vec /= np.where(n > 0, n, 1)
        hits = [np.zeros((3, 0), np.int64)]
        for lo in range(0, len(vec), 256):
            score = (vec[lo : lo + 256] @ self.query).ravel()
            at = np.flatnonzero(score >= self.cosine)
            hits.append(np.stack([lo + at // self.query.shape[1], at % self.query.shape[1], (score[at] * 1e6).astype(np.int64)]))
        block, passage, score = np.concatenate(hits, axis=1)
        # 20 words of a leak share 17 at least with some passage and its window widened by half a block; up to three of them may be changed
        ext = np.concatenate([np.full(BLOCK // 2, -1, np.int32), flat, np.full(3 * BLOCK, -1, np.int32)])
        keep = np.zeros(len(block), bool)
        for lo in range(0, len(block), 2048):
            b = block[lo : lo + 2048]
            at = (b * BLOCK)[:, None] + np.arange(-BLOCK // 2, 2 * BLOCK + BLOCK // 2)
            window = np.where((at >= first[b][:, None]) & (at < end[b][:, None]), ext[at + BLOCK // 2], -1)
            p = self.padded[passage[lo : lo + 2048]]
            likely = np.flatnonzero((p[:, :, None] == window[:, None, :]).any(2).sum(1) >= 0.65 * self.least)
            keep[lo + likely] = quick_subsequence(p[likely], window[likely]) >= 0.65 * self.least
        block, passage, score = block[keep], passage[keep], score[keep]
        seed_block, seed_item, seed_zone = self.seeds.find(flat, first, end, self.least)
        seed_score = np.array([(vec[b] @ self.query[:, self.passages_of[k]]).max() * 1e6 for b, k in zip(seed_block, seed_item)], np.int64)
        item, zone = np.append(self.owner[passage], seed_item), np.append(self.start[passage] // ZONE, seed_zone)
        block, score = np.append(block, seed_block), np.append(score, seed_score)
        if not len(block):
            return block, item, zone, score
        order = np.lexsort([-score, block, zone, item])
        block, item, zone, score = block[order], item[order], zone[order], score[order]
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (item[1:] != item[:-1]) | (zone[1:] != zone[:-1])
        return block[new], item[new], zone[new], score[new]

    def batch(self, pdf: pd.DataFrame) -> pd.DataFrame:
        flat, owner_doc, start = _flat(pdf)
        first = start[owner_doc] * BLOCK
        end = first + pdf["words"].map(len).to_numpy()[owner_doc]
        block, item, zone, score = self.candidates(flat, owner_doc, first, end)
        if not len(block):
            return pd.DataFrame()
        # of candidate blocks in a row, the second of each three is aligned for all: its segment holds two blocks to either side
        joined = np.zeros(len(block), bool)
        joined[1:] = (item[1:] == item[:-1]) & (zone[1:] == zone[:-1]) & (block[1:] == block[:-1] + 1) & (owner_doc[block[1:]] == owner_doc[block[:-1]])
        run = np.arange(len(block)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(block))))
        lead = run % 3 == 0
        group = np.cumsum(lead) - 1
        size = np.bincount(group)
        top = np.zeros(len(size), np.int64)
        np.maximum.at(top, group, score)
        at_block, k, z = block[lead] + (size > 1), item[lead], zone[lead]
        ext = np.concatenate([np.full(2 * BLOCK, -3, np.int32), flat, np.full(4 * BLOCK, -3, np.int32)])
        rows, weak = [pd.DataFrame({c: np.zeros(0) for c in ("d", "k", "a0", "span", "agreeing", "cosine")})], []
        for lo in range(0, len(k), 1024):
            b, kk, best = at_block[lo : lo + 1024], k[lo : lo + 1024], top[lo : lo + 1024] / 1e6
            at = (b * BLOCK)[:, None] + np.arange(-2 * BLOCK, 4 * BLOCK)
            segment = np.where((at >= first[b][:, None]) & (at < end[b][:, None]), ext[at + 2 * BLOCK], -3)
            words_, offset = self.window(kk, z[lo : lo + 1024])
            ends = align_ends(words_, segment)
            spans, other, same = ends[1] - ends[0], ends[3] - ends[2], ends[4].copy()
            short = same >= self.agree * np.maximum(spans, other)
            long = (spans >= 1.2 * self.least) & (same >= self.agree_long * np.maximum(spans, 0.8 * other))
            ok = (spans >= self.least) & (short | long)
            near = np.flatnonzero(~ok & (spans >= self.least - 2 * OUT) & (same >= self.agree * self.least - 2 * OUT))
            if len(near):
                spans[near], same[near] = stretch(words_[near], segment[near], tuple(x[near] for x in ends), self.least, self.agree)
                ok[near] = spans[near] > 0
            rows.append(pd.DataFrame({"d": owner_doc[b[ok]], "k": kk[ok], "a0": (ends[0] + offset)[ok], "span": spans[ok], "agreeing": same[ok], "cosine": best[ok]}))
            rest = np.flatnonzero(~ok & (best >= self.cosine) & np.array([len(self.answers[x]) > 0 for x in kk], bool))
            weak += [(owner_doc[b[i]], kk[i], words_[i], segment[i], best[i]) for i in rest if self.answered(pdf, owner_doc[b[i]], kk[i])]
        found = covered(pd.concat(rows)).assign(kind="passage")
        if weak:
            found = pd.concat([found, self.paraphrases(weak, {(d, k) for d, k in zip(found["d"], found["k"])})])
        if not len(found):
            return found
        near = [self.answered(pdf, d, k) for d, k in zip(found["d"].astype(int), found["k"].astype(int))]
        at = found["d"].to_numpy(int)
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "item_id": self.ids[found["k"].to_numpy(int)], "span": found["span"].to_numpy(), "agreeing": found["agreeing"].to_numpy(), "cosine": found["cosine"].to_numpy(), "answer_near": near, "kind": found["kind"].to_numpy()})

    def answered(self, pdf: pd.DataFrame, d: int, k: int) -> bool:
        """Whether the words of the item's answer follow each other in the document."""
        a, w = self.answers[k], pdf["words"].iloc[d]
        if not len(a) or len(w) < len(a):
            return False
        at = np.flatnonzero(w[: len(w) - len(a) + 1] == a[0])
        return any((w[i : i + len(a)] == a).all() for i in at)

    def paraphrases(self, weak: list, known: set) -> pd.DataFrame:
        """Of near passages that no alignment accepts: those of documents that hold the answer and, in the same order, two thirds of the words of a passage length."""
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for lo in range(0, len(weak), 1024):
            part = weak[lo : lo + 1024]
            n = common_subsequence(np.stack([w[2] for w in part]), np.stack([w[3] for w in part])[:, 2 * BLOCK - 8 : 4 * BLOCK + 8])
            for (d, k, _, _, score), m in zip(part, n):
                if m >= PASSAGE * 2 / 3 and (d, k) not in known:
                    best[d, k] = max(best.get((d, k), (0, 0.0)), (int(m), float(score)))
        return pd.DataFrame([(d, k, m, m, c, "paraphrase") for (d, k), (m, c) in best.items()], columns=["d", "k", "span", "agreeing", "cosine", "kind"])


SCHEMA = "doc_id bigint, item_id bigint, span int, agreeing int, cosine double, answer_near boolean, kind string"


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, rank: int = 64, cosine: float = 0.72, least: int = 20, agree: float = 0.875, agree_long: float = 0.83, fit_blocks: int = 60_000, items_per_pass: int = 1000, seed: int = 3) -> DataFrame:
    """Documents with passages of held-out items: doc_id, item_id, span (item words), agreeing, cosine, answer_near, kind.

    items has item_id, text and answer. A leak is a stretch of at least `least` words of the
    item of which the part `agree` stands, in order, in the document, after taking away
    markup, invisible characters, case and look-alike letters. A stretch of 1.2 * least
    words or more needs agree_long on the whole, as it then holds a shorter one that reaches
    agree, and may hold more added words. span and agreeing cover all stretches of the item in the
    document together. A first sentence that three items or more share counts as an instruction to the
    reader and is left out; what follows it is searched like any other text.
    answer_near tells whether the words of the answer follow each other in the document. kind is
    'passage' for the above, or 'paraphrase' for a document that is near a passage in the latent space, holds the
    answer, and two thirds of a passage's words in its order, but no such stretch.
    Null or blank texts on either side give nothing; one row per document and item.

    Steps: words of all documents as numbers of the items' vocabulary (written once);
    passage frequencies over the whole corpus; latent basis by a distributed randomised
    SVD of the TF-IDF blocks, fitted on about fit_blocks blocks (hash sample; all statistics and
    the search cover every document); cosine search of every passage of every
    document and count of common words; beside it an exact search for five consecutive
    words of an item, which also finds short leaks that the words around them hide from
    the cosine; alignment, whose ends then move so that changed words there count. Items are the query set and are
    taken in passes of items_per_pass, so what is sent to the tasks is bounded; the
    corpus is never shuffled.
    """
    rows = items.select("item_id", "text", "answer").where("text is not null").distinct().orderBy("item_id").collect()
    openings = Counter(first_sentence(r["text"]) for r in rows)
    dull = {s for s, n in openings.items() if n >= SHARED and len(s) > 4}
    out = None
    for lo in range(0, len(rows), items_per_pass):
        part = _one_pass(docs, doc, text, Items(rows[lo : lo + items_per_pass], dull), rank, cosine, least, agree, agree_long, fit_blocks, seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return out


def _one_pass(docs, doc, text, held: Items, rank, cosine, least, agree, agree_long, fit_blocks, seed) -> DataFrame:
    vocabulary, size = held.vocabulary, len(held.vocabulary)

    def number(batches):
        ids = Ids(vocabulary)
        for pdf in batches:
            found = [np.fromiter(map(ids.__getitem__, words(t)), np.int32) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": found})

    full = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    tokens = durable(full.mapInPandas(number, "doc_id bigint, words array<int>"), "words")
    df, blocks = passage_counts(tokens, size)
    idf = np.log((blocks + 1) / (df + 1))
    basis = latent_basis(tokens, idf, rank, min(1.0, fit_blocks / max(blocks, 1)), seed)
    table = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    found = tokens.mapInPandas(Search(held, table, cosine, least, agree, agree_long), SCHEMA)
    # one document in several rows of the corpus: its best row, a passage before a paraphrase
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("kind") == "passage").alias("p"), "span", "agreeing", "cosine", "answer_near", "kind")).alias("r")).select("doc_id", "item_id", *[f"r.{c}" for c in ("span", "agreeing", "cosine", "answer_near", "kind")])
