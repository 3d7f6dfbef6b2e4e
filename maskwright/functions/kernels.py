"""NumPy kernels over stacks of masks, shape (n, h, w): whole batches at a time, no loop over images."""

from __future__ import annotations

import numpy as np

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
#: Offsets of a disk of radius 2.
DISK2 = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if dr * dr + dc * dc <= 4]


def shifted(x: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """y[., r, c] = x[., r + dr, c + dc], ``fill`` outside."""
    out = np.full_like(x, fill)
    h, w = x.shape[1:]
    r, c = slice(max(0, -dr), min(h, h - dr)), slice(max(0, -dc), min(w, w - dc))
    out[:, r, c] = x[:, max(0, dr) : min(h, h + dr), max(0, dc) : min(w, w + dc)]
    return out


def least_labels(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that edges (one, two) connect it to: labels are hooked along the edges and shortened until all agree."""
    label = np.arange(n)
    while len(one):
        x, y = label[one], label[two]
        apart = x != y
        if not apart.any():
            break
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def components(values: np.ndarray, offsets=EIGHT) -> np.ndarray:
    """Label of each pixel: the least flat index (within its image) of the pixels it is connected to by equal values.

    Runs of equal values in a row are the nodes, runs that touch in neighbouring rows
    the edges; least labels are hooked along the edges and shortened until all agree.
    """
    n, h, w = values.shape
    begins = np.ones((n, h, w), bool)
    begins[:, :, 1:] = values[:, :, 1:] != values[:, :, :-1]
    run = (np.cumsum(begins.ravel()) - 1).reshape(n, h, w)
    one, two = [], []
    for d in (-1, 0, 1) if (1, 1) in offsets else (0,):
        a, b = slice(max(0, -d), min(w, w - d)), slice(max(0, d), min(w, w + d))
        same = values[:, :-1, a] == values[:, 1:, b]
        # each pair of runs once; diagonally only where no pixel beside joins them
        turn = begins[:, :, slice(max(0, d, -d), None)] if d else begins
        same &= turn[:, :-1] & turn[:, 1:] if d else turn[:, :-1] | turn[:, 1:]
        one.append(run[:, :-1, a][same])
        two.append(run[:, 1:, b][same])
    label = least_labels(int(run[-1, -1, -1]) + 1 if run.size else 0, np.concatenate(one), np.concatenate(two))
    first = np.flatnonzero(begins.ravel())
    return first[label[run]] - (np.arange(n) * h * w)[:, None, None]


def dilate(mask: np.ndarray, offsets=DISK2) -> np.ndarray:
    mask = mask.astype(bool)
    if offsets is not DISK2:
        out = np.zeros_like(mask)
        for dr, dc in offsets:
            out |= shifted(mask, dr, dc, False)
        return out
    near = mask.copy()  # row by row: 1, 3 and 5 pixels wide
    near[:, :, 1:] |= mask[:, :, :-1]
    near[:, :, :-1] |= mask[:, :, 1:]
    out = near.copy()
    out[:, :, 1:] |= near[:, :, :-1]
    out[:, :, :-1] |= near[:, :, 1:]
    for d, line in ((1, near), (2, mask)):
        out[:, d:] |= line[:, :-d]
        out[:, :-d] |= line[:, d:]
    return out


def _sizes(mask: np.ndarray, offsets) -> np.ndarray:
    """For each pixel, how many pixels its component has."""
    n, h, w = mask.shape
    label = components(mask.astype(np.int8), offsets) + (np.arange(n) * h * w)[:, None, None]
    return np.bincount(label.ravel(), minlength=n * h * w)[label]


def fill_holes(mask: np.ndarray, below: int = 10) -> np.ndarray:
    """Components of the complement (4 neighbours) with fewer pixels are filled."""
    return mask | (~mask & (_sizes(mask, FOUR) < below))


def drop_small(mask: np.ndarray, below: float) -> np.ndarray:
    """Components (8 neighbours) with fewer pixels go."""
    if below <= 1:
        return mask.copy()
    return mask & (_sizes(mask, EIGHT) >= below)


def postprocess(mask: np.ndarray, threshold: float = 0.001) -> np.ndarray:
    """Dilation by a disk of radius 2, holes below 10 pixels filled, components below the share of the image dropped: 0 or 255."""
    h, w = mask.shape[1:]
    return np.where(drop_small(fill_holes(dilate(mask)), threshold * h * w), 255, 0).astype(np.int16)


def postprocess_classes(mask: np.ndarray, threshold: float = 0.001) -> np.ndarray:
    """Each class for itself in ascending order, later ones over earlier ones."""
    out = np.zeros_like(mask)
    for k in np.unique(mask):
        if k > 0:
            some = np.flatnonzero((mask == k).any((1, 2)))
            out[some] = np.where(postprocess(mask[some] == k, threshold) > 0, k, out[some])
    return out


def bilinear(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """(n, h0, w0) to (n, h, w); pixel centres at half integers, edges repeated."""
    n, h0, w0 = image.shape
    y = np.clip((np.arange(h) + 0.5) * h0 / h - 0.5, 0, h0 - 1)
    x = np.clip((np.arange(w) + 0.5) * w0 / w - 0.5, 0, w0 - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h0 - 1), np.minimum(x0 + 1, w0 - 1)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    top = image[:, y0][:, :, x0] * (1 - fx) + image[:, y0][:, :, x1] * fx
    bottom = image[:, y1][:, :, x0] * (1 - fx) + image[:, y1][:, :, x1] * fx
    return top * (1 - fy) + bottom * fy


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Lines (r, c) between the pixels of one binary mask at level 0.5; diagonal pixels are joined; closed lines repeat their first point."""
    m = np.asarray(mask, bool).astype(np.int8)
    codes = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]
    rows, cols = np.nonzero((codes > 0) & (codes < 15))
    follow: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for r, c, code in zip(rows.tolist(), cols.tolist(), codes[rows, cols].tolist(), strict=True):
        up, right, down, left = (float(r), c + 0.5), (r + 0.5, c + 1.0), (r + 1.0, c + 0.5), (r + 0.5, float(c))
        if code == 5:
            pairs = [(up, right), (down, left)]
        elif code == 10:
            pairs = [(up, left), (down, right)]
        else:
            a, b, d, e = code & 1, code >> 1 & 1, code >> 2 & 1, code >> 3
            pairs = [tuple(p for p, cut in ((up, a != b), (right, b != d), (down, d != e), (left, e != a)) if cut)]
        for p, q in pairs:
            follow.setdefault(p, []).append(q)
            follow.setdefault(q, []).append(p)
    lines = []
    ends = sorted(p for p, q in follow.items() if len(q) == 1)
    for start in [*ends, *sorted(follow)]:
        if not follow.get(start):
            continue
        line, at = [start], start
        while follow[at]:
            nxt = min(follow[at])
            follow[at].remove(nxt)
            follow[nxt].remove(at)
            line.append(nxt)
            at = nxt
        lines.append(np.array(line, float))
    return lines


def longest_contour(mask: np.ndarray) -> np.ndarray:
    """The longest line, points rounded, as x, y; without any, the whole image's rectangle."""
    found = sorted(contours(mask), key=len, reverse=True)
    h, w = mask.shape
    line = found[0] if found else np.array([[0, 0], [0, w], [h, w], [h, 0]], float)
    return np.flip(np.round(line), axis=1).astype(np.int32)


def _cuts(code: int) -> list[tuple[int, int]]:
    """Pairs of the sides (up, right, down, left) of four pixels that lines join."""
    if code in (5, 10):
        return [(0, 1), (2, 3)] if code == 5 else [(0, 3), (2, 1)]
    bits = [code >> i & 1 for i in range(4)]
    sides = tuple(i for i in range(4) if bits[i] != bits[(i + 1) % 4])
    return [sides] if sides else []


#: Twice the middles (r, c) of the sides, from twice the first of four pixels.
_SIDES = np.array([(0, 1), (1, 2), (2, 1), (1, 0)])


def longest_contours(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``longest_contour`` of each binary mask (n, h, w): (where each begins, and the end; points x, y one after the other).

    Lines are paths over the middles of pixels' sides. Each is called by its least point;
    their lengths are counted first, and all masks' longest lines walked together.
    """
    n, h, w = stack.shape
    m = stack.astype(bool).astype(np.int8)
    codes = (m[:, :-1, :-1] + 2 * m[:, :-1, 1:] + 4 * m[:, 1:, 1:] + 8 * m[:, 1:, :-1]).ravel()
    tall, wide, p, q = 2 * h, 2 * w, [], []
    for code in range(1, 15):
        at = np.flatnonzero(codes == code)
        if not len(at):
            continue
        image, r, c = at // max(1, (h - 1) * (w - 1)), at // (w - 1) % (h - 1), at % (w - 1)
        for pair in _cuts(code):
            for to, side in zip((p, q), pair, strict=True):
                to.append((image * tall + 2 * r + _SIDES[side, 0]) * wide + 2 * c + _SIDES[side, 1])
    whole = np.array([[0, 0], [w, 0], [w, h], [0, h]], np.int32)
    if not p:
        return np.arange(n + 1) * 4, np.tile(whole, (n, 1))
    p, q = np.concatenate(p), np.concatenate(q)
    points, one = np.unique(np.concatenate([p, q]), return_inverse=True)
    two = np.concatenate([one[len(p) :], one[: len(p)]])
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    begins = np.searchsorted(one, np.arange(len(points)))
    degree = np.diff(np.append(begins, len(one)))
    low, high = two[begins], two[begins + degree - 1]  # the neighbours; an end of a line has one
    label = least_labels(len(points), one, two)
    line, size = np.unique(label, return_counts=True)
    start = np.full(len(points), len(points))
    ends = np.flatnonzero(degree == 1)
    np.minimum.at(start, label[ends], ends)
    start = start[line]
    closed = start == len(points)
    start = np.where(closed, line, start)
    size = size + closed
    image = points[line] // (tall * wide)
    order = np.lexsort((start, closed, -size, image))
    best = order[np.append(True, image[order][1:] != image[order][:-1])]
    best = best[np.argsort(-size[best], kind="stable")]
    long, at = size[best], start[best]
    before, seen, owner = np.full(len(best), -1), [], []
    for t in range(int(long[0])):
        some = int(np.searchsorted(-long, -t))  # lines of more than t points
        at, before = at[:some], before[:some]
        seen.append(at)
        owner.append(np.arange(some))
        at, before = np.where(low[at] != before, low[at], high[at]), at
    seen = points[np.concatenate(seen)[np.argsort(np.concatenate(owner), kind="stable")]]
    own = image[best]
    sizes = np.full(n, 4)
    sizes[own] = long
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty((bounds[-1], 2), np.int32)
    none = np.setdiff1d(np.arange(n), own)
    out[(bounds[none][:, None] + np.arange(4)).ravel()] = np.tile(whole, (len(none), 1))
    place = np.repeat(bounds[own] - np.cumsum(long) + long, long) + np.arange(long.sum())
    out[place] = np.stack([np.round(seen % wide / 2), np.round(seen // wide % tall / 2)], 1)
    return bounds, out


#: The eight neighbours (dr, dc) against the clock, from the right.
_AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def external_contours(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of each outermost component (8 neighbours) of one binary mask, as pixels (x, y).

    A border begins at the component's first pixel and runs against the clock; of
    pixels in a straight line the ends stay. Components inside holes of others have no
    border here. Components come in the order of their first pixels.
    """
    m = np.pad(np.asarray(mask, bool), 1)
    if not m.any():
        return []
    label, back = components(m[None].astype(np.int8))[0], components(m[None].astype(np.int8), FOUR)[0]
    out = []
    for seed in np.unique(label[m]).tolist():
        start = divmod(seed, m.shape[1])
        if back[start[0] - 1, start[1]] != 0:  # what lies above the first pixel is not the outside
            continue
        # clockwise from the left for where the border ends
        last = next((d for d in range(4, -4, -1) if m[start[0] + _AROUND[d % 8][0], start[1] + _AROUND[d % 8][1]]), None)
        if last is None:
            out.append(np.array([[start[1] - 1, start[0] - 1]], np.int32))
            continue
        end = (start[0] + _AROUND[last % 8][0], start[1] + _AROUND[last % 8][1])
        line, at, came, before = [], start, last % 8, None
        while True:
            step = next(d % 8 for d in range(came + 1, came + 9) if m[at[0] + _AROUND[d % 8][0], at[1] + _AROUND[d % 8][1]])
            if step != before:
                line.append((at[1] - 1, at[0] - 1))
            following = (at[0] + _AROUND[step][0], at[1] + _AROUND[step][1])
            if following == start and at == end:
                break
            at, came, before = following, (step + 4) % 8, step
        out.append(np.array(line, np.int32))
    return out


_STEPS = np.array([[next((d % 8 for d in range(came + 1, came + 9) if code >> d % 8 & 1), 0) for came in range(8)] for code in range(256)])
#: By the neighbours that are there: clockwise from the left for where a border ends, -1 for none.
_LAST = np.array([next((d % 8 for d in range(4, -4, -1) if code >> d % 8 & 1), -1) for code in range(256)])
#: Borders that are walked together at least; fewer go one by one.
_TOGETHER = 8


def stack_contours(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``external_contours`` of each binary mask (n, h, w): (each border's mask; where each begins, and the end; points x, y one after the other).

    All borders are walked together, a step at a time.
    """
    m = np.pad(np.asarray(stack, bool), ((0, 0), (1, 1), (1, 1)))
    n, h, w = m.shape
    code = np.zeros(m.shape, np.uint8)
    for d, (dr, dc) in enumerate(_AROUND):
        code |= shifted(m, dr, dc, False).astype(np.uint8) << np.uint8(d)
    one = m.astype(np.int8)
    flat = np.arange(h * w).reshape(h, w)
    seed = np.flatnonzero(m & (components(one) == flat))
    seed = seed[components(one, FOUR).ravel()[seed - w] == 0]  # what lies above the first pixel is the outside
    code, offset = code.ravel(), np.array([dr * w + dc for dr, dc in _AROUND])
    came = _LAST[code[seed]]
    end = seed + np.where(came < 0, 0, offset[came])
    which = np.flatnonzero(came >= 0)
    owner, seen = [np.flatnonzero(came < 0)], [seed[came < 0]]
    at, came, before = seed[which], came[which], np.full(len(which), -1)
    while len(which):
        if len(which) < _TOGETHER:
            for i, x, c, b in zip(which.tolist(), at.tolist(), came.tolist(), before.tolist(), strict=True):
                line, first, last = [], int(seed[i]), int(end[i])
                while True:
                    step = int(_STEPS[code[x], c])
                    if step != b:
                        line.append(x)
                    y = x + int(offset[step])
                    if y == first and x == last:
                        break
                    x, c, b = y, (step + 4) % 8, step
                owner.append(np.full(len(line), i))
                seen.append(np.array(line, np.int64))
            break
        step = _STEPS[code[at], came]
        turned = step != before
        owner.append(which[turned])
        seen.append(at[turned])
        following = at + offset[step]
        on = np.flatnonzero((following != seed[which]) | (at != end[which]))
        which, at, came, before = which[on], following[on], (step[on] + 4) % 8, step[on]
    owner, seen = np.concatenate(owner), np.concatenate(seen)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(seed) + 1))
    seen = seen[order]
    return seed // (h * w), bounds, np.stack([seen % w - 1, seen // w % h - 1], 1).astype(np.int32)


def polygon_crossings(points: np.ndarray, height: int, width: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(first row, first column, crossings, whether on an edge) over the box of one polygon (x, y) within the image.

    A pixel's ray to the right crosses an edge if its row is among ``[y1, y2)`` and the
    edge lies to its right. Whole numbers throughout; a polygon outside gives empty arrays.
    """
    x, y = points[:, 0].astype(np.int64), points[:, 1].astype(np.int64)
    x0, x1, y0, y1 = max(int(x.min()), 0), min(int(x.max()), width - 1), max(int(y.min()), 0), min(int(y.max()), height - 1)
    shape = (max(0, y1 - y0 + 1), max(0, x1 - x0 + 1))
    cross, on = np.zeros(shape, np.int32), np.zeros(shape, bool)
    if not cross.size:
        return y0, x0, cross, on
    c = np.arange(x0, x1 + 1)[None]
    for xa, ya, xb, yb in zip(x.tolist(), y.tolist(), np.roll(x, -1).tolist(), np.roll(y, -1).tolist(), strict=True):
        low, high = max(min(ya, yb), y0), min(max(ya, yb), y1)
        if low > high:
            continue
        r = np.arange(low, high + 1)[:, None]
        side = (xb - xa) * (r - ya) - (c - xa) * (yb - ya)
        rows = slice(low - y0, high - y0 + 1)
        if ya != yb:
            cross[rows] += ((side > 0) if yb > ya else (side < 0)) & ((ya > r) != (yb > r))
        on[rows] |= (side == 0) & (c >= min(xa, xb)) & (c <= max(xa, xb))
    return y0, x0, cross, on
