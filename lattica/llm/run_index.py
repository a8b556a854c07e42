"""A run-length index of many texts: a Burrows-Wheeler transform of bounded context, kept as runs.

The texts stand one after another, each with an end mark, as one circular text. Its rows are sorted by
their first `width` symbols, their context; rows of one context may stand in any order, so they are ordered by
the symbol before them, and a run is what a context has of one symbol. Copies of a passage add to the length of
runs, not to their number. What is kept: the runs, the number of rows before each (by which a backward step goes from
a context and a symbol to the context of both), and, as the sample at the last run of each context, the
smallest document that has it. The sorted rows themselves are not kept.
"""

from __future__ import annotations

import numpy as np


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """(rank of each key among the distinct ones, their number)."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), np.int64)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


def context_ranks(symbols: np.ndarray, width: int, alphabet: int) -> tuple[np.ndarray, int]:
    """(rank of the width symbols from each place on, in the circular text; number of distinct ones), by doubling."""
    bits = max(1, int(alphabet - 1).bit_length())
    h = min(width, 62 // bits)
    key = np.zeros(len(symbols), np.int64)
    for i in range(h):
        key = key << bits | np.roll(symbols, -i)
    rank, n = _dense(key)
    while h < width and n < len(symbols):
        step = min(h, width - h)
        rank, n = _dense(rank * n + np.roll(rank, -step))
        h += step
    return rank, n


class RunIndex:
    """Index of texts (bytes one after another, with their sizes), each with a document number."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, width: int):
        used = np.flatnonzero(np.bincount(text, minlength=256))
        self.width, self.code = width, np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)  # 0 is the end mark
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(len(text) + len(sizes), np.int64)
        symbols[ranges(ends - sizes, sizes)] = self.code[text]
        rank, self.contexts = context_ranks(symbols, width, len(used) + 1)
        # runs, by context and then symbol
        letters = len(used) + 1
        rows = np.sort(rank * letters + np.roll(symbols, 1))
        head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
        context, self.symbol = np.divmod(rows[head], letters)
        self.first_run = np.searchsorted(context, np.arange(self.contexts))
        # the rows before a run, counted by symbol and then context, are where its backward step leads
        by_symbol = np.argsort(self.symbol.astype(np.uint16), kind="stable")
        self.rows_before = np.append(0, np.cumsum(np.diff(np.append(head, len(rows)))[by_symbol]))
        self.runs = (self.symbol * self.contexts + context)[by_symbol]
        self.start = np.append(0, np.cumsum(np.bincount(rank, minlength=self.contexts)))
        self.leads_to = np.empty(len(head), np.int64)
        self.leads_to[by_symbol] = np.searchsorted(self.start, self.rows_before[:-1], "right") - 1
        self.least = np.full(self.contexts, np.iinfo(np.int64).max)
        np.minimum.at(self.least, rank, np.repeat(docs, sizes + 1))
        self.ends = rank[ends]

    def stream(self, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Matching statistics of the indexed texts, streamed backwards from their end marks, all texts a symbol at a time.

        After j symbols the match is min(j, width) long. Returns for each place where it
        reaches the width the smallest document that has those symbols; -1 elsewhere.
        """
        out = np.full(len(text), -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        last, context = (np.cumsum(sizes) - 1)[order], self.ends[order]
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max()) if len(sizes) else 0), "left")
        for j, n in enumerate(live.tolist()):  # the texts longer than j
            at = last[:n] - j
            symbol, run = self.code[text[at]], self.first_run[context[:n]]
            while len(miss := np.flatnonzero(self.symbol[run] != symbol)):  # most contexts have one run
                run[miss] += 1
            context = self.leads_to[run]
            if j >= self.width - 1:
                out[at] = self.least[context]
        return out

    def find(self, pattern: bytes) -> tuple[int, int | None]:
        """(places, smallest document) of any pattern of at most width bytes, by backward search over runs."""
        if len(pattern) > self.width:
            raise ValueError("longer than the index's contexts")
        lo, hi = 0, self.contexts
        for c in reversed(pattern):
            symbol = int(self.code[c])
            if not symbol:
                return 0, None
            a, b = (int(self.rows_before[np.searchsorted(self.runs, symbol * self.contexts + x)]) for x in (lo, hi))
            if a == b:
                return 0, None
            lo, hi = int(np.searchsorted(self.start, a, "right")) - 1, int(np.searchsorted(self.start, b, "left"))
        return int(self.start[hi] - self.start[lo]), int(self.least[lo:hi].min()) if hi > lo else None
