"""Associative scans over the transition functions of a small automaton, in numpy.

A letter of the input acts on the automaton's states as a function. The functions that the letters generate form a
finite monoid, so each is a small integer, composition is one table look-up, and a prefix scan over integers gives the
state before every position without visiting the positions one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Automaton:
    """``step[c][s]``: the state after letter ``c`` in state ``s``."""

    def __init__(self, step: np.ndarray, limit: int = 20000) -> None:
        letters, states = step.shape
        identity = tuple(range(states))
        number = {identity: 0}
        functions = [identity]
        generators = [tuple(int(x) for x in row) for row in step]
        k = 0
        while k < len(functions):
            for g in generators:
                made = tuple(g[s] for s in functions[k])
                if made not in number:
                    number[made] = len(functions)
                    functions.append(made)
            k += 1
            if len(functions) > limit:
                raise ValueError("the transition monoid is too large")
        self.table = np.array(functions, np.uint8)
        self.letter = np.array([number[g] for g in generators], np.int32)
        n = len(functions)
        self.size = n
        #: then[a * n + b]: first function a, then function b
        self.then = np.empty(n * n, np.int32)
        for b in range(n):
            made = self.table[b][self.table]
            self.then[np.arange(n) * n + b] = [number[tuple(int(x) for x in row)] for row in made]

    def states_before(self, letters: np.ndarray, start: int = 0, block: int = 0) -> tuple[np.ndarray, int]:
        """The state before each letter and the function of the whole input."""
        n = len(letters)
        if n == 0:
            return np.zeros(0, np.uint8), 0
        block = block or max(8, min(256, int(n**0.5)))
        rows = -(-n // block)
        padded = np.zeros(rows * block, np.int32)
        padded[:n] = self.letter[letters]
        grid = np.ascontiguousarray(padded.reshape(rows, block).T)
        before = np.empty_like(grid)
        before[0] = 0
        acc = grid[0].copy()
        for t in range(1, block):
            before[t] = acc
            acc = self.then[acc * self.size + grid[t]]
        lead = np.empty(rows, np.int32)
        done = 0
        for r, f in enumerate(acc.tolist()):
            lead[r] = done
            done = int(self.then[done * self.size + f])
        entry = self.table[lead, start]
        return self.table[before, entry[None, :]].T.reshape(-1)[:n], done


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each value begins and ends; null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
