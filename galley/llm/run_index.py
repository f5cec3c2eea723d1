"""A run-length index of many short byte strings: a run-compressed Burrows-Wheeler transform.

The rows of the transform are the suffixes of all strings, in the order of their bytes to the
end of the string, ties in the order of the strings. It is kept as runs: where a run starts,
its byte, where its first row maps to, and the suffix sampled at both of its ends.
Matching statistics of other strings are streamed from their ends: a step that agrees with the run
maps the row, one that does not jumps to the nearest run end with the byte, whose
sample tells how much of the match stays.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of 9 bits in a first key


class RunIndex:
    def __init__(self, data: np.ndarray, length: np.ndarray, value: np.ndarray, depth: int):
        """Strings one after the other; `value` is a number of each string, `depth` the match length asked for.

        Strings may be as long as they like, but the sort takes log2 of the longest rounds.
        """
        count = len(length)
        size = len(data) + count  # every string ends with an empty suffix
        ends = np.cumsum(length + 1)  # one past the empty suffix
        text = np.zeros(size, dtype=np.int64)
        body = np.ones(size, dtype=bool)
        body[ends - 1] = False
        text[body] = data.astype(np.int64) + 1
        owner = np.repeat(np.arange(count), length + 1)
        left = ends[owner] - 1 - np.arange(size)  # bytes to the end of the string
        self.text, self.owner, self.left, self.depth = text, owner, left, depth

        rank = np.zeros(size, dtype=np.int64)
        for k in range(PACK):
            inside = left > k
            step = np.zeros(size, dtype=np.int64)
            step[: size - k] = text[k:] if k else text
            rank = (rank << 9) | np.where(inside, step, 0)
        _, rank = np.unique(rank, return_inverse=True)
        self.ranks: dict[int, np.ndarray] = {PACK: rank}
        width, longest = PACK, int(length.max()) if count else 0
        while width < longest:
            rank = self._wider(rank, width)
            width *= 2
            self.ranks[width] = rank
        order = np.argsort(rank, kind="stable")
        row_of = np.empty(size, dtype=np.int64)
        row_of[order] = np.arange(size)
        last = np.where((order > 0) & (left[np.maximum(order, 1) - 1] > 0), text[np.maximum(order, 1) - 1], 0)
        fresh = np.r_[True, last[1:] != last[:-1]] if size else np.zeros(0, bool)
        self.run_start = np.flatnonzero(fresh)
        self.run_byte = last[self.run_start]
        run_end = np.r_[self.run_start[1:], size] - 1 if size else self.run_start
        self.first_sample, self.last_sample = order[self.run_start], order[run_end]
        # The row before which the rows of each byte begin, and the place of each run among the runs of its byte.
        run_length = run_end - self.run_start + 1
        by_byte = np.argsort(self.run_byte, kind="stable")
        self.run_target = np.empty(len(by_byte), dtype=np.int64)
        # Rows that start with a byte come in the order of the rows that hold it.
        self.run_target[by_byte] = np.cumsum(run_length[by_byte]) - run_length[by_byte]
        self.by_byte, self.byte_key = by_byte, self.run_byte[by_byte] * (len(by_byte) + 1) + by_byte
        self.size = size

        # Intervals of rows that share `depth` bytes, and the least value in each.
        whole = left[order] >= depth
        same = np.zeros(size, dtype=bool)
        if size:
            same[1:] = whole[1:] & whole[:-1] & self._equal(order[1:], order[:-1])
        starts = np.flatnonzero(~same)
        self.interval = np.cumsum(~same) - 1
        self.least = np.minimum.reduceat(value[owner[order]], starts) if size else value[:0]
        self.row_of = row_of[ends - 1] if count else row_of  # rows of the empty suffixes

    def _wider(self, rank: np.ndarray, width: int) -> np.ndarray:
        beyond = np.full(len(rank), -1, dtype=np.int64)
        beyond[: len(rank) - width] = np.where(self.left[: len(rank) - width] >= width, rank[width:], -1)
        _, out = np.unique(rank * (len(rank) + 1) + beyond + 1, return_inverse=True)
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which suffixes share the first `depth` bytes; both have as many."""
        width = max((w for w in self.ranks if w <= self.depth), default=PACK)
        rank, shift = self.ranks[width], self.depth - width
        same = rank[a] == rank[b]
        at = 0
        while at < shift:
            at = min(at + width, shift)
            same &= rank[np.minimum(a + at, self.size_of - 1)] == rank[np.minimum(b + at, self.size_of - 1)]
        return same

    @property
    def size_of(self) -> int:
        return len(self.text)

    def _common(self, a: np.ndarray, data: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that indexed suffixes share with places of other data, up to `most`."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            live = live[(out[live] < most[live]) & (self.left[a[live]] > out[live])]
            live = live[self.text[a[live] + out[live]] == data[at[live] + out[live]].astype(np.int64) + 1]
            out[live] += 1
        return out

    def stream(self, data: np.ndarray, length: np.ndarray, own: bool):
        """Yields, from the last byte of the strings to their first, (strings, places, match lengths, rows).

        `own`: the strings are the indexed ones in their order, so each starts at its own empty suffix.
        """
        ends = np.cumsum(length)
        lanes = np.flatnonzero(length)
        row = self.row_of[lanes].copy() if own else np.zeros(len(lanes), dtype=np.int64)
        spot = np.cumsum(length + 1)[lanes] - 1 if own else np.zeros(len(lanes), dtype=np.int64)  # an indexed suffix of the match
        match = np.zeros(len(lanes), dtype=np.int64)
        for step in range(int(length.max()) if len(length) else 0):
            keep = length[lanes] > step
            lanes, row, spot, match = lanes[keep], row[keep], spot[keep], match[keep]
            place = ends[lanes] - 1 - step
            byte = data[place].astype(np.int64) + 1
            run = np.searchsorted(self.run_start, row, "right") - 1
            agree = self.run_byte[run] == byte
            if not agree.all():
                off = np.flatnonzero(~agree)
                row[off], spot[off], match[off], run[off] = self._jump(run[off], byte[off], match[off], data, place[off])
            gone = match < 0  # the byte does not occur at all
            row = np.where(gone, 0, self.run_target[run] + row - self.run_start[run])
            spot = np.where(gone, 0, spot - 1)
            match = np.where(gone, 0, match + 1)
            yield lanes, place, match, row

    def _jump(self, run, byte, match, data, place):
        """The nearest run end with the byte on either side, whichever keeps more of the match."""
        key = byte * (len(self.by_byte) + 1) + run
        at = np.searchsorted(self.byte_key, key)
        n = len(self.by_byte)
        best = np.full(len(run), -1, dtype=np.int64)
        row, spot, to = np.zeros_like(best), np.zeros_like(best), np.zeros_like(best)
        for k, lower in ((at - 1, True), (at, False)):
            ok = (k >= 0) & (k < n)
            target = self.by_byte[np.clip(k, 0, max(n - 1, 0))]
            ok &= self.run_byte[target] == byte
            suffix = self.last_sample[target] if lower else self.first_sample[target]
            kept = np.where(ok, self._common(suffix, data, np.minimum(place + 1, len(data)), match * ok), -1)
            better = kept > best
            end = np.r_[self.run_start[1:], self.size][target] - 1 if lower else self.run_start[target]
            row, spot, to = np.where(better, end, row), np.where(better, suffix, spot), np.where(better, target, to)
            best = np.where(better, kept, best)
        return row, spot, best, to

    def least_of(self, row: np.ndarray) -> np.ndarray:
        """The least value among the strings that share `depth` bytes with the suffix of a row."""
        return self.least[self.interval[row]]
