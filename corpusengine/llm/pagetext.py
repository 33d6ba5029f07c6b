"""Main text of pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is a vector: the sum of hashed embeddings of its tag path, the mean of hashed
embeddings of its words, and a few measures. A bidirectional LSTM in numpy reads the sequence, so that each label depends on the
whole page. Pages of known labels to learn from are laid out by ``layouts``; nothing is learned from the pages extracted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layouts
from .blocks import Page, leaves
from .words import mix, tokenise

PATH_SLOTS, WORD_SLOTS, DIM, MEASURES, HIDDEN = 1 << 12, 1 << 12, 10, 5, 14
#: Pages laid out to learn from and passes over them.
PAGES, EPOCHS, BATCH, RATE, WORD_DECAY, SEED = 900, 14, 32, 0.01, 3e-4, 7
#: Characters of html, and steps of the recurrence times pages, that are labelled at once.
READ_CHARS, CELLS = 2_000_000, 200_000


@dataclass
class Blocks:
    """Slots and measures of the blocks of several pages; ``first[p]:first[p + 1]`` are those of page p.

    ``path`` and ``sign`` are the slots of path tokens as they open and end, of which ``path_at`` stand before a block.
    """

    path: np.ndarray
    sign: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_first: np.ndarray
    measures: np.ndarray
    first: np.ndarray


def described(pages: list[Page]) -> Blocks:
    every = [b for p in pages for b in p.blocks]
    paths, words = tokenise([" ".join(p.tokens) for p in pages]), tokenise([b[2] for b in every])
    slot = lambda h, n: (mix(h) % np.uint64(n)).astype(np.int64)
    n = np.diff(words.first)
    sizes = [len(p.blocks) for p in pages]
    place = np.concatenate([np.linspace(0, 1, k) for k in sizes if k]) if every else np.zeros(0)
    marks = np.array([sum(map(b[2].count, ".,;:!?")) / len(b[2]) for b in every])
    depth = np.array([b[1] for b in every])
    measures = np.stack([np.minimum(np.log1p(n) / 4, 1.5), np.array([b[3] for b in every]), np.minimum(marks * 10, 1), place, np.minimum(depth / 10, 3)], 1) if every else np.zeros((0, MEASURES))
    at = np.array([b[0] for b in every], np.int64) + np.repeat(paths.first[:-1], sizes)
    sign = np.array([s for p in pages for s in p.signs], np.float64)
    return Blocks(slot(paths.hash, PATH_SLOTS), sign, at, slot(words.hash, WORD_SLOTS), words.first, measures.astype(np.float32), np.cumsum([0, *sizes]))


def _sums(table: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(table[slots], first[some])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings of path and word slots, an LSTM for each direction as (input + HIDDEN + 1, 4 * HIDDEN), and a logistic layer."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = 2 * DIM + MEASURES
        # words and names that were never seen say nothing
        self.paths, self.words = (np.zeros((n, DIM), np.float32) for n in (PATH_SLOTS, WORD_SLOTS))
        self.lstm = [rng.normal(0, (size + HIDDEN) ** -0.5, (size + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        for w in self.lstm:
            w[-1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.out = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN + 1).astype(np.float32)

    def inputs(self, b: Blocks) -> np.ndarray:
        words = _sums(self.words, b.word, b.word_first) / np.maximum(np.diff(b.word_first), 1)[:, None]
        return np.hstack([self.above(b), words, b.measures])

    def above(self, b: Blocks) -> np.ndarray:
        """The sum of the embeddings of the tokens above each block: of all events before it, as those of ended elements cancel out."""
        upto = np.zeros((len(b.path) + 1, DIM))
        np.cumsum(self.paths[b.path] * b.sign[:, None], axis=0, out=upto[1:])
        return upto[b.path_at].astype(np.float32)

    def run(self, w: np.ndarray, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN) of a padded batch; past the end of a page the state stands still."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, cache = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        fed = x @ w[: x.shape[2]] + w[-1]
        for t in range(len(x)):
            z = fed[t] + h @ w[x.shape[2] : -1]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            if keep:
                cache.append((h, c, i, f, o, g, th, m))
            h, c = h2, c2
            states[t] = h
        return states, cache

    def _padded(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and reversed batches, which steps are live, and where each block stands in the batch."""
        sizes = np.diff(first)
        step, page = np.arange(len(x)) - np.repeat(first[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes)
        back = np.repeat(sizes, sizes) - 1 - step
        ahead = np.zeros((max(sizes.max(initial=0), 1), len(sizes), x.shape[1]), np.float32)
        astern = np.zeros_like(ahead)
        ahead[step, page], astern[back, page] = x, x
        live = np.arange(len(ahead))[:, None] < sizes[None, :]
        return ahead, astern, live, np.stack([step, back, page])

    def probabilities(self, b: Blocks) -> np.ndarray:
        """That each block belongs to the main text."""
        x, sizes, out = self.inputs(b), np.diff(b.first), np.zeros(b.first[-1])
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(order):  # pages of like lengths together, so that padding stays small
            end = begin + 1
            while end < len(order) and sizes[order[end]] * (end + 1 - begin) <= CELLS:
                end += 1
            some = order[begin:end]
            at = np.concatenate([np.arange(b.first[p], b.first[p + 1]) for p in some])
            if len(at):
                ahead, astern, live, where = self._padded(x[at], np.concatenate([[0], np.cumsum(sizes[some])]))
                hf, hb = self.run(self.lstm[0], ahead, live)[0], self.run(self.lstm[1], astern, live)[0]
                both = np.hstack([hf[where[0], where[2]], hb[where[1], where[2]]])
                out[at] = _sigmoid(both @ self.out[:-1] + self.out[-1])
            begin = end
        return out

    def fit(self, pages: list[Page], labels: list[np.ndarray], seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        weights = [*self.lstm, self.out, self.paths, self.words]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in weights]
        size, step = 2 * DIM + MEASURES, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for begin in range(0, len(order), BATCH):
                some = order[begin : begin + BATCH]
                b, y = described([pages[i] for i in some]), np.concatenate([labels[i] for i in some])
                ahead, astern, live, where = self._padded(self.inputs(b), b.first)
                (hf, cf), (hb, cb) = self.run(self.lstm[0], ahead, live, True), self.run(self.lstm[1], astern, live, True)
                both = np.hstack([hf[where[0], where[2]], hb[where[1], where[2]]])
                d = ((_sigmoid(both @ self.out[:-1] + self.out[-1]) - y) / len(y)).astype(np.float32)
                grads = [np.zeros_like(p) for p in weights]
                grads[4] += WORD_DECAY * self.words
                grads[2] = np.append(both.T @ d, d.sum()).astype(np.float32)
                dboth, dx = np.outer(d, self.out[:-1]), np.zeros((len(y), size), np.float32)
                for k, (x, cache, at) in enumerate(((ahead, cf, where[0]), (astern, cb, where[1]))):
                    dh = np.zeros((*x.shape[:2], HIDDEN), np.float32)
                    dh[at, where[2]] = dboth[:, k * HIDDEN : (k + 1) * HIDDEN]
                    dx += self._back(k, x, cache, dh, grads)[at, where[2]]
                later = np.zeros((len(b.path) + 1, DIM))
                np.add.at(later, b.path_at, dx[:, :DIM])
                later = np.cumsum(later[::-1], axis=0)[::-1][1:]  # of the blocks after each event
                np.add.at(grads[3], b.path, (later * b.sign[:, None]).astype(np.float32))
                sizes = np.diff(b.word_first)
                np.add.at(grads[4], b.word, np.repeat(dx[:, DIM : 2 * DIM] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
                step += 1
                for value, grad, (m, v) in zip(weights, grads, moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self

    def _back(self, k: int, x: np.ndarray, cache: list, dh: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
        w, dx = self.lstm[k], np.zeros_like(x)
        carry_h = carry_c = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, th, m = cache[t]
            g_h = dh[t] + carry_h
            own = np.where(m, g_h, 0)
            g_c = carry_c + own * o * (1 - th * th)
            live_c = np.where(m, g_c, 0)
            dz = np.hstack([live_c * g * i * (1 - i), live_c * c * f * (1 - f), own * th * o * (1 - o), live_c * i * (1 - g * g)])
            grads[k][: x.shape[2]] += x[t].T @ dz
            grads[k][x.shape[2] : -1] += h.T @ dz
            grads[k][-1] += dz.sum(0)
            dx[t] = dz @ w[: x.shape[2]].T
            carry_h = np.where(m, dz @ w[x.shape[2] : -1].T, g_h)
            carry_c = np.where(m, live_c * f, g_c)
        return dx


def trained(pages: int = PAGES, seed: int = SEED) -> Labeller:
    found, labels = laid_out(pages, seed)
    return Labeller(seed).fit(found, labels, seed)


def laid_out(n: int, seed: int) -> tuple[list[Page], list[np.ndarray]]:
    """Blocks of n invented pages, and for each block 1 if it is main text."""
    parsed = [leaves(html) for html in layouts.pages(n, seed)]
    labels = [np.array([b[2].startswith(layouts.MARK) for b in page.blocks], np.float32) for page in parsed]
    return [Page(page.tokens, page.signs, [(at, depth, text.removeprefix(layouts.MARK), linked) for at, depth, text, linked in page.blocks]) for page in parsed], labels


def texts(model: Labeller, htmls: list[str | None]) -> list[str]:
    """The blocks labelled as main text, a line each."""
    pages = [leaves(h) for h in htmls]
    b = described(pages)
    keep = model.probabilities(b) >= 0.5
    return ["\n".join(block[2] for block, k in zip(p.blocks, keep[at:], strict=False) if k) for p, at in zip(pages, b.first[:-1].tolist(), strict=True)]


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without main text, have the text "". Null ids and urls and repeated rows are
    kept. Pages of any length are read whole, and only by the task that holds them. Other columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())  # below 1 MB, whatever the input

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["html"].fillna("").str.len().to_numpy(np.int64)
            part = np.cumsum(lengths) // READ_CHARS
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
                rows = frame.iloc[at]
                found = texts(model.value, rows["html"].tolist())
                yield pd.DataFrame({"page_id": rows["page_id"].to_numpy(), "url": rows["url"].to_numpy(), "text": found, "n_chars": [len(t) for t in found]})

    # ids as text: pandas would turn longs with nulls among them into floats
    out = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
