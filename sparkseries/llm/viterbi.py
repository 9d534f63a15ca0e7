"""Best paths of many sequences at once."""

from __future__ import annotations

import numpy as np


def best_paths(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best label of each row of ``scores``.

    ``scores`` holds the sequences one after the other, ``lengths`` their lengths (over 0), and
    ``change[a, b]`` is added where label b follows a. Of equal paths the smaller labels win. All
    sequences advance together, the longest first, so that a step costs what is still open.
    """
    labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begin = (np.concatenate(([0], np.cumsum(lengths)[:-1])))[order]
    length = lengths[order]
    longest = int(length[0])
    still = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # open at each step
    came = np.zeros((len(scores), labels), np.uint8)
    value = scores[begin].astype(np.float32)
    best = value.argmax(1) if longest == 1 else None
    final = np.zeros(len(length), np.int64)
    for t in range(1, longest):
        n = still[t]
        if n < still[t - 1]:
            final[n:still[t - 1]] = value[n:still[t - 1]].argmax(1)
        steps = value[:n, :, None] + change[None]
        source = steps.argmax(1)
        at = begin[:n] + t
        came[at] = source
        value = np.take_along_axis(steps, source[:, None, :], 1)[:, 0, :] + scores[at]
    n = still[longest - 1]
    final[:n] = value[:n].argmax(1) if best is None else best[:n]
    out = np.zeros(len(scores), np.uint8)
    now = final.copy()
    for t in range(longest - 1, -1, -1):
        n = still[t]
        at = begin[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = came[at, now[:n]]
    return out
