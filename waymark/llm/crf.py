"""Linear-chain conditional random fields of two states, for many chains at once.

A chain is a row of a rectangle (chains x steps). Every step has one number, the score of state 1
over state 0; a 2 x 2 matrix scores moves between states. Steps behind a chain's end are masked.
"""

from __future__ import annotations

import numpy as np


def marginals(emission: np.ndarray, length: np.ndarray, moves: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: (probability of state 1, expected moves 2 x 2, log partition) of each chain; a chain's moves count `times` times."""
    n, steps = emission.shape
    forward = np.zeros((n, steps, 2))
    backward = np.zeros((n, steps, 2))
    forward[:, 0, 1] = emission[:, 0]
    for t in range(1, steps):
        for s in (0, 1):
            forward[:, t, s] = np.logaddexp(forward[:, t - 1, 0] + moves[0, s], forward[:, t - 1, 1] + moves[1, s]) + s * emission[:, t]
    for t in range(steps - 2, -1, -1):
        inside = t + 1 < length
        for s in (0, 1):
            ahead = np.logaddexp(moves[s, 0] + backward[:, t + 1, 0], moves[s, 1] + emission[:, t + 1] + backward[:, t + 1, 1])
            backward[:, t, s] = np.where(inside, ahead, 0.0)
    last = np.maximum(length - 1, 0)
    total = np.logaddexp(*forward[np.arange(n), last].T)
    both = forward + backward
    on = np.exp(both[:, :, 1] - np.logaddexp(both[:, :, 0], both[:, :, 1]))
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            x = forward[:, :-1, a] + moves[a, b] + b * emission[:, 1:] + backward[:, 1:, b] - total[:, None]
            each = np.exp(np.where(np.arange(1, steps) < length[:, None], x, -np.inf)).sum(1)
            expected[a, b] = each.sum() if times is None else each @ times
    return np.where(np.arange(steps) < length[:, None], on, 0.0), expected, total


def viterbi(emission: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best states of each chain; ties go to state 0."""
    n, steps = emission.shape
    best = np.stack([np.zeros(n), emission[:, 0]], 1)
    came = np.zeros((n, steps, 2), np.int8)
    ends = np.zeros((n, 2)) + best
    for t in range(1, steps):
        new = np.empty((n, 2))
        for s in (0, 1):
            zero, one = best[:, 0] + moves[0, s], best[:, 1] + moves[1, s]
            came[:, t, s] = one > zero
            new[:, s] = np.maximum(zero, one) + s * emission[:, t]
        best = new
        ends = np.where((t < length)[:, None], best, ends)
    states = np.zeros((n, steps), np.int8)
    now = (ends[:, 1] > ends[:, 0]).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        states[:, t] = np.where(t < length, now, 0)
        now = np.where(t < length, came[np.arange(n), t, now], now).astype(np.int8)
    return states


def fit(active: list[np.ndarray], state: np.ndarray, length: np.ndarray, size: int, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3, offset: float = 0.0, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size) and moves of the likeliest field, by full-batch ascent with per-weight steps (Adagrad).

    active: for each kind of feature the (chains x steps) index of the one that holds; state: the
    known states. offset is added to every emission. A chain counts `times` times (once, if not given).
    """
    n, steps = state.shape
    times = np.ones(n) if times is None else times.astype(float)
    mask = np.arange(steps) < length[:, None]
    weight, moves = np.zeros(size), np.zeros((2, 2))
    seen_w, seen_m = np.full(size, 1e-6), np.full((2, 2), 1e-6)
    pairs = mask[:, 1:]
    known = np.array([[((state[:, :-1] == a) & (state[:, 1:] == b) & pairs).sum(1) @ times for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(rounds):
        emission = offset + sum(weight[a] for a in active)
        on, expected, _ = marginals(emission, length, moves, times)
        error = (np.where(mask, state - on, 0.0) * times[:, None]).ravel()
        gradient = sum(np.bincount(a.ravel(), error, size) for a in active) - decay * weight
        seen_w += gradient**2
        weight += rate * gradient / np.sqrt(seen_w)
        change = known - expected - decay * moves
        seen_m += change**2
        moves += rate * change / np.sqrt(seen_m)
    return weight, moves


def order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of values that lie end to end: first value of each run, longest run first, and how many runs have a step t (down to 0)."""
    by = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max(initial=0) + 1)
    return (np.cumsum(lengths) - lengths)[by], np.searchsorted(-lengths[by], -steps, side="left")


def whole_marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each step; each run is one chain, however long. Only log odds are carried."""
    first, alive = order(lengths)
    ahead, back = np.zeros(len(emission)), np.zeros(len(emission))
    turn = lambda x, m: np.logaddexp(m[0, 1], x + m[1, 1]) - np.logaddexp(m[0, 0], x + m[1, 0])
    now = np.zeros(0)
    for t in range(len(alive) - 1):
        at = first[: alive[t]] + t
        now = emission[at] + (turn(now[: alive[t]], moves) if t else 0.0)
        ahead[at] = now
    for t in range(len(alive) - 3, -1, -1):  # a run's last step has 0
        at = first[: alive[t + 1]] + t
        back[at] = turn(emission[at + 1] + back[at + 1], moves.T)
    return np.exp(-np.logaddexp(0.0, -ahead - back))


def whole_viterbi(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best state of each step; each run is one chain, however long. Ties go to state 0."""
    first, alive = order(lengths)
    came = np.zeros((len(emission), 2), np.int8)
    lead, states = np.zeros(len(emission)), np.zeros(len(emission), np.int8)
    now = np.zeros(0)
    for t in range(len(alive) - 1):
        at = first[: alive[t]] + t
        if t:
            zero, one = moves[0], now[: alive[t], None] + moves[1]
            came[at] = one > zero
            now = np.maximum(zero, one)
            now = now[:, 1] - now[:, 0] + emission[at]
        else:
            now = emission[at]
        lead[at] = now
    for t in range(len(alive) - 2, -1, -1):
        at, on = first[: alive[t]] + t, alive[t + 1]
        states[at[on:]] = lead[at[on:]] > 0  # last steps
        states[at[:on]] = came[at[:on] + 1, states[at[:on] + 1]]
    return states


def rectangle(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut runs of values that lie end to end into chains of at most `most` steps.

    Returns (owner of each chain, its first value, its length).
    """
    chains = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), chains)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
    first = np.repeat(np.cumsum(lengths) - lengths, chains) + nth * most
    return owner, first, np.minimum(most, lengths[owner] - nth * most)
