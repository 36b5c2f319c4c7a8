"""Markov clustering of blocks of a sparse graph in memory. Blocks that no edge links never exchange flow, so each is clustered by itself."""

from __future__ import annotations

import numpy as np

#: Blocks of at most this many nodes are squared as dense matrices, several at a time.
DENSE = 256
#: Products, or entries of dense matrices, that are held at once.
AT_ONCE = 1 << 21
#: Rows of a product are summed as whole rows where these have at most so many entries for each product.
WIDE = 32


def _top(w: np.ndarray, keep: int, least: float) -> np.ndarray:
    """Which entries of the last axis stay: the greatest, and of the ``keep`` greatest those of at least ``least``; ties: lower index."""
    stay = w >= least
    if w.shape[-1] > keep:
        bar = -np.partition(-w, keep - 1, axis=-1)[..., keep - 1, None]
        above, tie = w > bar, w == bar
        stay &= above | (tie & (np.cumsum(tie, axis=-1) <= keep - above.sum(axis=-1, keepdims=True)))
    np.put_along_axis(stay, w.argmax(axis=-1)[..., None], True, axis=-1)
    return stay & (w > 0)


def _settled(w: np.ndarray, power: float, keep: int, least: float) -> np.ndarray:
    """Rows raised to ``power``, pruned and normalised."""
    w = w**power if power != 1 else w
    w = w / np.maximum(w.sum(axis=-1, keepdims=True), 1e-30)
    w = np.where(_top(w, keep, least), w, 0)
    return w / np.maximum(w.sum(axis=-1, keepdims=True), 1e-30)


def _chaos(w: np.ndarray) -> np.ndarray:
    return w.max(axis=-1) - (w * w).sum(axis=-1)


def _dense(m: np.ndarray, inflation: float, keep: int, least: float, max_rounds: int, still: float) -> np.ndarray:
    """The flow of the blocks ``m`` (blocks, j, i); each stops when it stands still."""
    m = _settled(m, 1, keep, least)
    live = np.arange(len(m))
    for _ in range(max_rounds):
        m[live] = _settled(m[live] @ m[live], inflation, keep, least)
        live = live[_chaos(m[live]).max(axis=-1) >= still]
        if not len(live):
            break
    return m


def _ragged(row: np.ndarray, col: np.ndarray, w: np.ndarray, rows: int, power: float, keep: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Entries in order of (row, col), settled, and the greatest chaos of a row."""
    first = np.searchsorted(row, np.arange(rows))
    w = np.power(w.astype(np.float32), np.float32(power))
    w = w / np.maximum(np.add.reduceat(w, first), 1e-30)[row]
    stay = (w >= least) | (w == np.maximum.reduceat(w, first)[row])
    row, col, w = row[stay], col[stay], w[stay]
    # Only rows that are too long yet, or whose greatest is below the least, are ranked.
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    ranked = (count > keep) | (np.maximum.reduceat(w, first[:-1]) < least)
    if ranked.any():
        at = np.nonzero(ranked[row])[0]
        number = np.cumsum(ranked) - 1
        r, pos = number[row[at]], at - first[row[at]]
        full = np.zeros((int(ranked.sum()), int(count[ranked].max())), np.float32)
        full[r, pos] = w[at]
        stay = np.ones(len(row), bool)
        stay[at] = _top(full, keep, least)[r, pos]
        row, col, w = row[stay], col[stay], w[stay]
        first = np.searchsorted(row, np.arange(rows + 1))
    w = w / np.add.reduceat(w, first[:-1])[row]
    return row, col, w, float((np.maximum.reduceat(w, first[:-1]) - np.add.reduceat(w * w, first[:-1])).max())


def _sparse(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, inflation: float, keep: int, least: float, max_rounds: int, still: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flow of one block, given as entries in order of (row, col), as entries."""

    def parts(load: np.ndarray):
        """Ranges of rows of some AT_ONCE / 4 loads, which stay in a core's cache."""
        most = AT_ONCE // 4
        cut = np.searchsorted(np.cumsum(load), np.arange(most, load.sum() + most, most), side="right")
        at = np.unique(np.concatenate([[0], cut, [n]]))
        return zip(at[:-1].tolist(), at[1:].tolist())

    count = np.bincount(row, minlength=n)
    ptr = np.concatenate([[0], np.cumsum(count)])
    done = [_ragged(row[(s := slice(ptr[lo], ptr[hi]))] - lo, col[s], w[s], hi - lo, 1, keep, least) + (lo,) for lo, hi in parts(np.full(n, count.max()))]
    for rounds in range(max_rounds + 1):
        row, col, w = (np.concatenate(x) for x in ([r + lo for r, _, _, _, lo in done], [d[1] for d in done], [d[2] for d in done]))
        if rounds == max_rounds or (rounds and max(d[3] for d in done) < still):
            return row, col, w
        count = np.bincount(row, minlength=n)
        ptr = np.concatenate([[0], np.cumsum(count)])
        load = np.bincount(row, weights=count[col], minlength=n).astype(np.int64)
        # Sums go to whole rows, a few rows at a time, unless rows would be nearly empty.
        wide, done = n * n <= WIDE * load.sum(), []
        for lo, hi in parts(np.maximum(load, n) if wide else load):
            s = slice(ptr[lo], ptr[hi])
            r, k, u = row[s] - lo, col[s], w[s]
            c = count[k]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - ptr[k], c)
            key, v = np.repeat(r * n, c) + col[at], np.repeat(u, c) * w[at]
            if wide:
                full = np.bincount(key, weights=v, minlength=(hi - lo) * n)
                key = np.nonzero(full != 0)[0]
                v = full[key]
            else:
                order = np.argsort(key)
                key, v = key[order], v[order]
                first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
                v, key = np.add.reduceat(v, first), key[first]
            done.append(_ragged(key // n, key % n, v, hi - lo, inflation, keep, least) + (lo,))
    raise AssertionError


def block_flow(
    block: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, *, inflation: float, keep: int, least: float, max_rounds: int, still: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, attractor, flow) of the edges (a, b, w; a != b), whose ends both lie in the edge's ``block``. Nodes get loops of their
    greatest weight. A repeated pair counts once."""
    how = {"inflation": inflation, "keep": keep, "least": least, "max_rounds": max_rounds, "still": still}
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    of = np.zeros(len(node), np.int64)
    of[at] = np.unique(np.concatenate([block, block]), return_inverse=True)[1]
    # Nodes in order of block and number, numbered within their block.
    order = np.lexsort([node, of])
    size = np.bincount(of)
    start = np.concatenate([[0], np.cumsum(size)])
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    j, i = place[at[: len(a)]], place[at[len(a) :]]
    loop = np.zeros(len(node))
    np.maximum.at(loop, j, w)
    np.maximum.at(loop, i, w)
    every = np.arange(len(node))
    row, col, w = np.concatenate([j, i, every]), np.concatenate([i, j, every]), np.concatenate([w, w, loop])
    by = np.lexsort([-w, col, row])
    row, col, w = row[by], col[by], w[by]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
    row, col, w = row[new], col[new], w[new]
    of = of[order]
    ptr = np.searchsorted(row, start)
    out = []
    # Small blocks: those of like size together, padded with nothing.
    small = np.nonzero(size <= DENSE)[0]
    for width in sorted({int(x) for x in -(-size[small] // 4) * 4}):
        those = small[(-(-size[small] // 4) * 4) == width]
        step = max(1, AT_ONCE // (width * width))
        for lo in range(0, len(those), step):
            part = those[lo : lo + step]
            e = np.concatenate([np.arange(ptr[p], ptr[p + 1]) for p in part.tolist()])
            m = np.zeros((len(part), width, width), np.float32)
            which = np.searchsorted(part, of[row[e]])
            m[which, row[e] - start[part][which], col[e] - start[part][which]] = w[e]
            m = _dense(m, **how)
            p, r, c = np.nonzero(m)
            out.append((r + start[part][p], c + start[part][p], m[p, r, c].astype(float)))
    for p in np.nonzero(size > DENSE)[0].tolist():
        s = slice(ptr[p], ptr[p + 1])
        r, c, v = _sparse(row[s] - start[p], col[s] - start[p], w[s], int(size[p]), **how)
        out.append((r + start[p], c + start[p], v))
    r, c, v = (np.concatenate(x) for x in zip(*out))
    names = node[order]
    return names[r], names[c], v
