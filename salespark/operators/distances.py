"""Sums of distances to many weighted points: near cells point by point, far cells through Chebyshev nodes.

The distance between two cells that do not touch is a smooth function of both points, so a polynomial through ORDER nodes
per dimension gives it to about eight digits. Cells twice as large take over as the distance grows, so that the work
grows with the number of cells and not with its square.
"""

from __future__ import annotations

from itertools import product

import numpy as np

ORDER = 8
_NODES = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))


def basis(at: np.ndarray) -> np.ndarray:
    """The nodes' polynomials at points of the cube from -1 to 1, one row per point."""
    out = np.ones((len(at), 1))
    degrees = np.arange(1, ORDER)
    of_nodes = np.cos(degrees[:, None] * np.arccos(_NODES))
    for d in range(at.shape[1]):
        one = 1 / ORDER + 2 / ORDER * np.cos(np.arccos(np.clip(at[:, d], -1, 1))[:, None] * degrees) @ of_nodes
        out = (out[:, :, None] * one[:, None, :]).reshape(len(at), -1)
    return out


def _grid(dimensions: int) -> np.ndarray:
    return np.stack(np.meshgrid(*[_NODES] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)


def _between(offset: tuple[int, ...]) -> np.ndarray:
    """Distances from the nodes of a cell to those of another, `offset` cells before it, for an edge of 1."""
    dimensions = len(offset)
    squared = np.zeros([1] * 2 * dimensions)
    for d, cells in enumerate(offset):
        shape = [ORDER if axis in (d, d + dimensions) else 1 for axis in range(2 * dimensions)]
        squared = squared + ((cells + (_NODES[:, None] - _NODES) / 2) ** 2).reshape(shape)
    return np.sqrt(squared).reshape(ORDER**dimensions, -1)


def _keys(cells: np.ndarray, least: np.ndarray, widths: np.ndarray) -> np.ndarray:
    return (cells - least) @ np.cumprod([1, *widths[:-1]])


def far_sums(cells: np.ndarray, sources: np.ndarray, moments: np.ndarray, edge: float) -> np.ndarray:
    """Per cell: at its nodes, the summed distances to the points of all source cells that do not touch it.

    Cells are whole numbers per dimension, `edge` long; a source's moments are its points' weights shared out to its nodes
    (`basis(points).T @ weights`). Sources are among the cells.
    """
    dimensions = cells.shape[1]
    grid = _grid(dimensions)
    halves = {bits: basis((grid + 2 * np.array(bits) - 1) / 2) for bits in product((0, 1), repeat=dimensions)}
    levels = []
    while True:
        levels.append([cells, sources, moments, np.zeros((len(cells), len(grid)))])
        if (cells.max(axis=0) - cells.min(axis=0) <= 1).all():  # all touch
            break
        parents, place = np.unique(sources // 2, axis=0, return_inverse=True)
        gathered = np.zeros((len(parents), len(grid)))
        for bits, half in halves.items():
            these = (sources % 2 == bits).all(axis=1)
            gathered[place[these]] += moments[these] @ half  # at most one child per parent and corner
        cells, sources, moments = np.unique(cells // 2, axis=0), parents, gathered
    for offset in product(range(-3, 4), repeat=dimensions):
        if max(map(abs, offset)) < 2:
            continue
        between = None
        for level, (cells, sources, moments, sums) in enumerate(levels[:-1]):
            least, widths = cells.min(axis=0) - 3, cells.max(axis=0) - cells.min(axis=0) + 7
            known, wanted = _keys(sources, least, widths), _keys(cells - offset, least, widths)
            order = np.argsort(known)
            at = order[np.minimum(np.searchsorted(known, wanted, sorter=order), len(known) - 1)]
            met = (known[at] == wanted) & (abs(cells // 2 - (cells - offset) // 2) <= 1).all(axis=1)
            if met.any():
                if between is None:
                    between = _between(offset)
                sums[met] += (moments[at[met]] @ between.T) * (edge * 2**level)
    for (cells, _, _, sums), (parents, _, _, above) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        least, widths = parents.min(axis=0), parents.max(axis=0) - parents.min(axis=0) + 1
        known = _keys(parents, least, widths)
        order = np.argsort(known)
        place = order[np.searchsorted(known, _keys(cells // 2, least, widths), sorter=order)]
        for bits, half in halves.items():
            these = (cells % 2 == bits).all(axis=1)
            sums[these] += above[place[these]] @ half.T
    return levels[0][3]


def near_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Per row of x: the summed distances to y, for each column of weights. Rows are taken so few that `most` distances are held."""
    rows = max(1, most // max(1, len(y)))
    along = np.ascontiguousarray(y.T)
    out = np.zeros((len(x), weights.shape[1]))
    for start in range(0, len(x), rows):
        part = x[start : start + rows]
        far = np.zeros((len(part), len(y)))
        for d, other in enumerate(along):
            apart = part[:, d, None] - other
            apart *= apart
            far += apart
        out[start : start + rows] = np.sqrt(far, out=far) @ weights
    return out
