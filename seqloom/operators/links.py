"""Suffix-link construction for one bounded sequence.

The helper grows the automaton one state at a time: state ``i`` inherits
the suffix context of state ``i - 1`` and needs the links of every earlier state,
so the loop is sequential inside a sequence and Spark runs it for many sequences
in parallel.  Longer sequences go through ``rounds.py``, which has no such loop.
"""

from __future__ import annotations

import numpy as np

from ..functions.distance import rough_metric, row_metric

MEASURED = 4096  # frames whose distances to each other a task keeps
CROWD = 512  # forward targets of a state beyond which only those that may matter are measured


def link_symbols(items) -> dict[str, list]:
    """Links of a symbol sequence: two items match when they are equal."""
    codes: dict = {}
    label = [-1] + [codes.setdefault(x, len(codes)) for x in items]
    goto: list[dict] = [{} for _ in label]

    def hit(k, i):
        t = goto[k].get(label[i])
        return None if t is None else (0.0, t)

    def link(k, i):
        goto[k][label[i]] = i

    out = _grow(label, hit, link, exhaustive=False)
    out["trn"] = [list(g.values()) for g in goto]
    return out


def link_frames(frames, threshold: float, metric="euclidean", exhaustive=False) -> dict[str, list]:
    """Links of a frame sequence: two frames match when closer than ``threshold``."""
    x = _frames(frames)
    return _link(len(x), threshold, row_metric(metric, x), exhaustive, rough_metric(metric, x))[0]


def sweep_frames(frames, thresholds, metric="euclidean", exhaustive=False):
    """``(members, links)`` of runs of ascending thresholds whose links are the same.

    Every automaton reports the least distance that failed; the next one is linked only for
    a threshold beyond it.  Distances of a frame to the earlier ones are measured once per
    sweep in sequences of at most ``MEASURED`` frames, and where they are asked for in longer ones.
    """
    x = _frames(frames)
    measure, rough = row_metric(metric, x), rough_metric(metric, x)
    known: list = [None] * len(x)

    def remembered(i, rows):
        if known[i] is None:
            known[i] = measure(i, np.arange(i))
        return known[i][rows]

    distances = remembered if len(x) <= MEASURED else measure
    members, links, reach = [], None, -np.inf
    for t in thresholds:
        if links is not None and t > reach:
            yield members, links
            members, links = [], None
        if links is None:
            links, reach = _link(len(x), t, distances, exhaustive, rough)
        members.append(t)
    if members:
        yield members, links


def _frames(frames) -> np.ndarray:
    x = np.asarray(frames, dtype=float)
    return x[:, None] if x.ndim == 1 else x


class _Crowd:
    """Many forward targets of a state with their rough frames side by side, added as they come."""

    def __init__(self, frames):
        self.frames, self.n = frames, 0
        self.states = np.empty(2 * CROWD, dtype=np.int64)
        self.rows = np.empty((2 * CROWD, frames.shape[1]), dtype=frames.dtype)

    def rival(self, i, targets, threshold, margin):
        """The targets that may be closer to item ``i`` than the threshold, or the closest of all, in order."""
        if len(targets) > len(self.states):
            self.states = np.resize(self.states, 2 * len(targets))
            self.rows = np.resize(self.rows, (2 * len(targets), self.rows.shape[1]))
        new = np.array(targets[self.n :], dtype=np.int64)
        self.states[self.n : len(targets)], self.rows[self.n : len(targets)] = new, self.frames[new - 1]
        self.n = len(targets)
        apart = 1.0 - self.rows[: self.n] @ self.frames[i - 1]
        least = np.fmin.reduce(apart, initial=np.inf)
        return self.states[: self.n][apart <= max(threshold, least) + 2 * margin]


def _link(n, threshold, distances, exhaustive, rough=None):
    """Links, and the largest threshold that gives the same ones.

    Distances to the few targets of a state are all measured; of many (``rough``, see
    ``rough_metric``) those that the threshold or the least distance may depend on.
    """
    trn: list[list[int]] = [[] for _ in range(n + 1)]
    reach, crowds = np.inf, {}

    def hit(k, i):
        nonlocal reach
        targets = trn[k]
        if rough is not None and len(targets) > CROWD:
            if k not in crowds:
                crowds[k] = _Crowd(rough[0])
            targets = crowds[k].rival(i, targets, threshold, rough[1])
        d = distances(i - 1, np.asarray(targets, dtype=np.int64) - 1)
        near = np.flatnonzero(d < threshold)
        if near.size == 0:
            reach = np.fmin(reach, np.fmin.reduce(d, initial=np.inf))
            return None
        j = near[np.argmin(d[near])]
        return float(d[j]), int(targets[j])

    def link(k, i):
        trn[k].append(i)

    out = _grow([-1] * (n + 1), hit, link, exhaustive)
    out["trn"] = trn
    return out, reach


def _grow(label, hit, link, exhaustive):
    n = len(label) - 1
    sfx, lrs = [-1] + [0] * n, [0] * (n + 1)
    word, word_end = [0] * (n + 1), [0] * (n + 1)
    twin: dict = {}
    fresh, start = 0, 0
    for i in range(1, n + 1):
        if add_state(i, fresh, label, sfx, lrs, twin, hit, link, exhaustive):
            fresh += 1
        if lrs[i] < i - start:  # the running word cannot take state i
            start = i - 1
        word[i] = start
        if lrs[i] == 0:
            start = i
    for i in range(n, 0, -1):
        word_end[i] = i if i == n or word[i + 1] != word[i] else word_end[i + 1]
    return {"sfx": sfx, "lrs": lrs, "label": label, "word": word, "word_end": word_end}


def add_state(i, fresh, label, sfx, lrs, twin, hit, link, exhaustive=False) -> bool:
    """Link state ``i`` and say whether it opens a new cluster (numbered ``fresh``).

    ``hit(k, i)`` is the nearest forward target of ``k`` that matches item ``i``, as
    (distance, state), and ``link(k, i)`` adds a forward link.  ``twin`` maps (suffix
    target, length, label before the repeat) to the earliest such state.  The containers
    may be lists or any mappings.
    """
    link(i - 1, i)
    k, below, best = sfx[i - 1], i - 1, None
    while k >= 0:
        found = hit(k, i)
        if found is None:
            link(k, i)
            below = k
        else:
            if best is None or found[0] < best[0]:
                best = found
            if not exhaustive:
                break
        k = sfx[k]
    if best is None:
        sfx[i], lrs[i], label[i] = 0, 0, fresh
        return True
    s = best[1]
    label[i] = label[s]
    size = 1 + _shared(sfx, lrs, below, s - 1)
    s2 = twin.get((s, size, label[i - size]))
    sfx[i], lrs[i] = (s, size) if s2 is None else (s2, size + 1)
    seen = (sfx[i], lrs[i], label[i - lrs[i]])
    if twin.get(seen) is None:
        twin[seen] = i
    return False


def _shared(sfx, lrs, a, b):
    """Length of the repeated suffix that states ``a`` and ``b`` have in common."""
    if b == sfx[a]:
        return lrs[a]
    while b != 0 and sfx[b] != sfx[a]:
        b = sfx[b]
    return min(lrs[a], lrs[b])
