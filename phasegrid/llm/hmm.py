"""Scaled forward and backward recursions of a hidden Markov model over many sequences at once.

Sequences are laid out by time, longest first, so that one step is a few array
operations over all sequences that are still running.  A long sequence is cut into
segments: what a segment does to a distribution of states is found from every single
state, the segments are joined by these, and then each is an ordinary chain that
starts from a known distribution and ends in a known outlook.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from phasegrid.llm.common import bounded_slices

SEGMENT = 8192          # longer sequences are cut
BATCH = 400_000         # symbols whose states are held at once


@dataclass
class Counts:
    """Expected numbers of first states, of transitions and of states by symbol."""

    first: np.ndarray
    moves: np.ndarray
    symbols: np.ndarray


class Chains:
    """Runs of symbols by time: ``at`` and ``size`` in ``codes``; ``enter`` and ``leave`` are rows a chain or None."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.steps = int(self.size[0]) if len(size) else 0
        self.running = len(size) - np.searchsorted(self.size[::-1], np.arange(self.steps), "right")    # chains longer than t
        self.offset = np.concatenate([[0], np.cumsum(self.running)])
        self.rank = (np.arange(int(self.offset[-1])) - np.repeat(self.offset[:-1], self.running)).astype(np.int32)
        self.codes = codes[at[self.order][self.rank] + np.repeat(np.arange(self.steps), self.running)]

    def forward(self, emit: np.ndarray, moves: np.ndarray, enter: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Log likelihoods, state distributions by place (if kept) and after the last symbol; chains in given order."""
        seen = emit[self.codes]
        scale = np.empty(len(self.codes))
        last = np.empty((len(self.size), emit.shape[1]))
        ones = np.ones(emit.shape[1])       # a product with it is the quicker row sum
        now = enter[self.order]
        for t in range(self.steps):
            a, b = self.offset[t], self.offset[t + 1]
            here = seen[a:b]
            here *= now[:b - a] if t == 0 else last[:b - a] @ moves
            np.matmul(here, ones, out=scale[a:b])
            np.multiply(here, (1 / scale[a:b])[:, None], out=last[:b - a])
            if keep:
                here[:] = last[:b - a]
        logs, ends = np.empty(len(self.size)), np.empty_like(last)
        logs[self.order] = np.bincount(self.rank, np.log(scale), len(self.size))
        ends[self.order] = last
        return logs, seen if keep else None, ends

    def backward(self, emit: np.ndarray, moves: np.ndarray, states: np.ndarray, leave: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Turns ``states`` into posteriors, adds moves inside chains to ``total``; posteriors of the first places, in given order."""
        leave_now = leave[self.order]
        ahead = leave_now.copy()
        turned = np.ascontiguousarray(moves.T)
        ones = np.ones(emit.shape[1])
        for t in range(self.steps - 1, -1, -1):
            a, b = self.offset[t], self.offset[t + 1]
            more = int(self.running[t + 1]) if t + 1 < self.steps else 0
            here = states[a:b]
            if more:
                told = emit[self.codes[self.offset[t + 1]:self.offset[t + 2]]] * ahead[:more]
                back = told @ turned
                post = here[:more] * back
                weight = (1 / (post @ ones))[:, None]      # outlooks are kept so that they weigh 1 under the distribution
                told *= weight
                total += moves * (here[:more].T @ told)
                np.multiply(back, weight, out=ahead[:more])
                np.multiply(post, weight, out=here[:more])
            ended = here[more:]
            ended *= leave_now[more:b - a]
            ended *= (1 / (ended @ ones))[:, None]
        first = np.empty((len(self.size), emit.shape[1]))
        first[self.order] = states[:len(self.size)]
        return first


def _segments(size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start and size of all segments in order."""
    parts = np.maximum(-(-size // limit), 1)
    of = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return of, number * limit, np.minimum(size[of] - number * limit, limit)


def sequences(codes: np.ndarray, size: np.ndarray, emit: np.ndarray, first: np.ndarray, moves: np.ndarray,
              count: bool) -> tuple[np.ndarray, Counts | None]:
    """Exact log likelihood of each sequence (``size`` symbols of ``codes`` in turn, one at least), and expected counts.

    ``emit``: probability of a symbol by state, positive.
    """
    k = len(first)
    out = Counts(np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))) if count else None
    order = np.argsort(size, kind="stable")     # sequences of like size run side by side
    at, size = (np.cumsum(size) - size)[order], size[order]
    logs = np.zeros(len(size))
    for a, b in bounded_slices(size, 4 * BATCH):
        of, start, length = _segments(size[a:b], SEGMENT)
        begin = at[a:b][of] + start
        enter, leave = np.tile(first, (len(of), 1)), np.ones((len(of), k))
        before = np.zeros((len(of), k))
        cut = np.flatnonzero((np.bincount(of) > 1)[of])
        if len(cut):
            _join(codes, of, begin, length, cut, emit, first, moves, enter, leave, before)
        for c, d in bounded_slices(length, BATCH):
            chains = Chains(codes, begin[c:d], length[c:d])
            part, states, _ = chains.forward(emit, moves, enter[c:d], count)
            np.add.at(logs, a + of[c:d], part)
            if not count:
                continue
            head = chains.backward(emit, moves, states, leave[c:d], out.moves)
            new = start[c:d] == 0
            out.first += head[new].sum(0)
            inner = ~new
            if inner.any():
                out.moves += moves * (before[c:d][inner].T @ (head[inner] / enter[c:d][inner]))
            for s in range(k):
                out.symbols[:, s] += np.bincount(chains.codes, states[:, s], len(emit))
    given = np.empty_like(logs)
    given[order] = logs
    return given, out


def _join(codes, of, begin, length, cut, emit, first, moves, enter, leave, before) -> None:
    """States that enter, and outlooks that leave, each segment of cut sequences."""
    k = len(first)
    through = np.empty((len(cut), k, k))        # from each single state before the first symbol to the last place
    scale = np.empty((len(cut), k))
    for c, d in bounded_slices(length[cut] * k, BATCH):
        some = np.repeat(cut[c:d], k)
        logs, _, ends = Chains(codes, begin[some], length[some]).forward(emit, moves, np.tile(np.eye(k), (d - c, 1)), False)
        through[c:d], scale[c:d] = ends.reshape(-1, k, k), logs.reshape(-1, k)
    weight = np.exp(scale - scale.max(1, keepdims=True))[:, :, None] * through
    for i, s in enumerate(cut.tolist()):
        if i and of[cut[i - 1]] == of[s]:
            ended = enter[cut[i - 1]] @ weight[i - 1]
            before[s] = ended / ended.sum()
            enter[s] = before[s] @ moves
    for i in range(len(cut) - 2, -1, -1):
        s, after = cut[i], cut[i + 1]
        if of[s] == of[after]:
            outlook = moves @ (weight[i + 1] @ leave[after])
            leave[s] = outlook / outlook.sum()
