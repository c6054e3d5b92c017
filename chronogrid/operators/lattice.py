"""A map's quadtree nodes, and sums over a level's nodes as convolutions on their lattice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CACHED_BYTES = 1 << 27


def smooth(n: int) -> int:
    """The least size of at least n without prime factors above 5, for fast transforms."""
    best = 1 << (n - 1).bit_length() if n > 1 else 1
    five = 1
    while five < best:
        three = five
        while three < best:
            left = -(-n // three)
            best = min(best, three << (left - 1).bit_length() if left > 1 else three)
            three *= 3
        five *= 5
    return best


def box_of(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    return int(x.min()), int(x.max()), int(y.min()), int(y.max())


class Axis:
    """One axis of a level: the nodes of h cells that hold the cells lo..hi, and the places of cells in a node."""

    def __init__(self, lo: int, hi: int, h: int) -> None:
        cells = np.arange(lo, hi + 1)
        self.lo, self.first, self.count = lo, lo // h, hi // h - lo // h + 1
        self.places, self.place = np.unique(cells % h, return_inverse=True)
        self.node = cells // h - self.first
        self.size = smooth(2 * self.count - 1)
        step = np.arange(self.size)
        step[step >= self.count] -= self.size
        #: by place and step, the offset of a cell from a node's first cell
        self.offset = self.places[:, None] + np.clip(step, 1 - self.count, self.count - 1) * h


class Lattice:
    """A level of a map: cells of one place in their nodes are one node apart, so their sums are one convolution.

    All places' transforms hold a few numbers for each cell of the map's own box, whatever the square around it.
    """

    def __init__(self, box: tuple[int, int, int, int], h: int) -> None:
        self.h, self.x, self.y = h, Axis(box[0], box[1], h), Axis(box[2], box[3], h)

    @property
    def size(self) -> tuple[int, int]:
        return self.x.size, self.y.size

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of cells from nodes' first cells, to be broadcast over place x, place y, step x, step y."""
        return self.x.offset[:, None, :, None], self.y.offset[None, :, None, :]

    def distance(self, off: float = 0.0) -> np.ndarray:
        """Of cells' centres, moved by `off`, from nodes' centres."""
        dx, dy = (o + (0.5 - self.h / 2 + off) for o in self.offsets())
        return np.sqrt(dx**2 + dy**2)

    def spectrum(self, kernel: np.ndarray) -> np.ndarray:
        return np.fft.rfft2(kernel)

    def transformed(self, values: np.ndarray) -> np.ndarray:
        return np.fft.rfft2(values, self.size)

    def at(self, total: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sums of the cells x, y."""
        i, j = x - self.x.lo, y - self.y.lo
        return np.fft.irfft2(total, self.size)[self.x.place[i], self.y.place[j], self.x.node[i], self.y.node[j]]


class Cache:
    """Results by key, kept up to a number of bytes."""

    def __init__(self) -> None:
        self.kept, self.bytes = {}, 0

    def get(self, key: tuple, make: Callable[[], np.ndarray | None]) -> np.ndarray | None:
        if key in self.kept:
            return self.kept[key]
        found = make()
        size = 0 if found is None else found.nbytes
        if self.bytes + size <= CACHED_BYTES:
            self.kept[key] = found
            self.bytes += size
        return found


def pyramid(x: np.ndarray, y: np.ndarray, values: np.ndarray, power: int) -> list[tuple[int, int, np.ndarray]]:
    """For each level, the root's first: the first nx and ny that hold cells, and sums of values from there on."""
    x0, x1, y0, y1 = box_of(x, y)
    m = np.zeros((x1 - x0 + 1, y1 - y0 + 1))
    np.add.at(m, (x - x0, y - y0), values)
    levels = [(x0, y0, m)]
    for _ in range(power):
        front = (x0 % 2, y0 % 2)
        m = np.pad(m, [(f, (f + n) % 2) for f, n in zip(front, m.shape, strict=True)])
        m = m[::2, ::2] + m[1::2, ::2] + m[::2, 1::2] + m[1::2, 1::2]
        x0, y0 = x0 // 2, y0 // 2
        levels.insert(0, (x0, y0, m))
    return levels


def adaptive_nodes(x: np.ndarray, y: np.ndarray, values: np.ndarray, power: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, nx, ny, value) of the nodes that cover a map.

    From the root on, a node whose value exceeds the threshold is replaced by its children; a leaf stays.
    Nodes without a cell are left out.
    """
    sums, here = pyramid(x, y, values, power), pyramid(x, y, np.ones(len(x)), power)
    now = np.ones(sums[0][2].shape, bool)
    for level, ((x0, y0, m), (_, _, cells)) in enumerate(zip(sums, here, strict=True)):
        high = m > threshold if level < power else np.zeros_like(now)
        nx, ny = np.nonzero(now & ~high & (cells > 0))
        yield level, nx + x0, ny + y0, m[nx, ny]
        if level < power:
            xc, yc, child = sums[level + 1]
            i, j = xc - 2 * x0, yc - 2 * y0
            now = np.repeat(np.repeat(now & high, 2, 0), 2, 1)[i : i + child.shape[0], j : j + child.shape[1]]
