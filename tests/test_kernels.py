"""Kernels against loops over pixels, and properties that must hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.functions import kernels as K

masks = st.integers(0, 2**32 - 1).map(lambda s: (np.random.default_rng(s).random((2, 9, 11)) < 0.4))


def flood(mask, offsets):
    """Component of each pixel of one mask, by value, as a set of pixels."""
    h, w = mask.shape
    seen, out = {}, []
    for start in np.ndindex(h, w):
        if start in seen:
            continue
        todo, part = [start], {start}
        while todo:
            r, c = todo.pop()
            for dr, dc in offsets:
                q = (r + dr, c + dc)
                if 0 <= q[0] < h and 0 <= q[1] < w and q not in part and mask[q] == mask[start]:
                    part.add(q)
                    todo.append(q)
        for p in part:
            seen[p] = part
        out.append(part)
    return seen


def slow_postprocess(mask, threshold):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for r, c in np.argwhere(mask):
        for dr, dc in K.DISK2:
            if 0 <= r + dr < h and 0 <= c + dc < w:
                out[r + dr, c + dc] = True
    parts = flood(out, K.FOUR)
    filled = np.array([[out[r, c] or len(parts[r, c]) < 10 for c in range(w)] for r in range(h)])
    parts = flood(filled, K.EIGHT)
    return np.array([[255 if filled[r, c] and len(parts[r, c]) >= threshold * h * w else 0 for c in range(w)] for r in range(h)])


@settings(max_examples=40, deadline=None)
@given(masks)
def test_components(stack):
    values = stack.astype(np.int8)
    for offsets in (K.FOUR, K.EIGHT):
        got = K.components(values, offsets)
        for one, label in zip(values, got, strict=True):
            for (r, c), part in flood(one, offsets).items():
                assert label[r, c] == min(a * one.shape[1] + b for a, b in part)


@settings(max_examples=40, deadline=None)
@given(masks, st.sampled_from([0.0, 0.001, 0.3]))
def test_postprocess(stack, threshold):
    got = K.postprocess(stack, threshold)
    assert all((g == slow_postprocess(m, threshold)).all() for g, m in zip(got, stack, strict=True))
    assert (K.dilate(stack) >= stack).all()


def test_later_classes_overwrite():
    mask = np.zeros((1, 12, 12), int)
    mask[0, 2:5, 2:5], mask[0, 5:8, 2:5] = 1, 2
    got = K.postprocess_classes(mask)
    assert got[0, 6, 3] == 2 and got[0, 5, 3] == 2 and got[0, 1, 3] == 1


def test_contours():
    mask = np.zeros((8, 9), bool)
    mask[2:5, 3:7] = True
    lines = K.contours(mask)
    assert len(lines) == 1 and (lines[0][0] == lines[0][-1]).all() and len(lines[0]) == 15
    box = K.longest_contour(mask)
    assert box[:, 0].min() in (2, 3) and box[:, 0].max() in (6, 7) and box[:, 1].min() in (1, 2) and box[:, 1].max() in (4, 5)
    assert K.longest_contour(np.ones((4, 5), bool)).tolist() == [[0, 0], [5, 0], [5, 4], [0, 4]]


@settings(max_examples=30, deadline=None)
@given(masks)
def test_contours_separate(stack):
    """Every point lies halfway between an inner and an outer pixel."""
    m = stack[0]
    points = {tuple(p) for line in K.contours(m) for p in line}
    want = {(r + 0.5, float(c)) for r in range(m.shape[0] - 1) for c in range(m.shape[1]) if m[r, c] != m[r + 1, c]} | {(float(r), c + 0.5) for r in range(m.shape[0]) for c in range(m.shape[1] - 1) if m[r, c] != m[r, c + 1]}
    assert points == want


def test_bilinear():
    image = np.arange(12.0).reshape(1, 3, 4)
    assert np.allclose(K.bilinear(image, 3, 4), image)
    assert K.bilinear(image, 6, 8).mean() == pytest.approx(image.mean())
