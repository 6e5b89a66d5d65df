import heapq

import numpy as np
import pytest

from tessera.model import SENSORS
from tessera.operators import kernels

RNG = np.random.default_rng(1)


def test_distance_is_the_least_over_set_pixels():
    mask = RNG.random((13, 17)) < 0.1
    at = np.argwhere(mask)
    expected = np.array([[np.sqrt(((at - (r, c)) ** 2).sum(axis=1).min()) for c in range(17)] for r in range(13)])
    assert np.allclose(kernels.distance_to(mask), expected)
    assert np.isinf(kernels.distance_to(np.zeros((2, 3), bool))).all()


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_by_flood(diagonal):
    mask = RNG.random((20, 15)) < 0.5
    out, seen = kernels.components(mask, diagonal), np.zeros(mask.shape, int)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    number = 0
    for start in map(tuple, np.argwhere(mask)):
        if not seen[start]:
            number += 1
            stack = [start]
            while stack:
                r, c = stack.pop()
                if 0 <= r < 20 and 0 <= c < 15 and mask[r, c] and not seen[r, c]:
                    seen[r, c] = number
                    stack += [(r + a, c + b) for a, b in steps]
    assert (out == seen).all()


def test_watershed_meets_between_its_markers():
    surface = np.array([[0, 1, 5, 1, 0]] * 3)
    markers = np.zeros((3, 5), int)
    markers[1, 0], markers[1, 4] = 1, 2
    out = kernels.watershed(surface, markers)
    assert (out[:, :2] == 1).all() and (out[:, 3:] == 2).all() and (out > 0).all()


def _pixel_by_pixel(surface, markers):
    """The flood as a heap of single pixels: the lowest next, of equals the one reached first."""
    out = markers.copy()
    heap = [(surface[r, c], k, r, c) for k, (r, c) in enumerate(np.argwhere(markers > 0).tolist())]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        level, _, r, c = heapq.heappop(heap)
        for r2, c2 in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= r2 < surface.shape[0] and 0 <= c2 < surface.shape[1] and not out[r2, c2]:
                out[r2, c2] = out[r, c]
                heapq.heappush(heap, (max(level, surface[r2, c2]), age, r2, c2))
                age += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 7, 200])
def test_watershed_by_frontiers_is_the_flood_by_pixels(levels):
    for rows, cols in ((1, 1), (1, 30), (17, 23), (90, 70)):
        for share in (0.0, 0.02, 0.3):
            surface, markers = RNG.integers(0, levels, (rows, cols)), kernels.components(RNG.random((rows, cols)) < share)
            assert (kernels.watershed(surface, markers) == _pixel_by_pixel(surface, markers)).all()


def test_lower_envelope_is_the_least_parabola():
    heights = np.where(RNG.random((40, 33)) < 0.6, np.inf, RNG.integers(0, 400, (40, 33)).astype(float))
    heights[3] = np.inf
    away = (np.arange(33)[:, None] - np.arange(33)) ** 2.0
    assert (kernels.lower_envelope(heights) == (heights[:, None, :] + away).min(axis=2)).all()


def test_maxima_and_edges():
    image = np.zeros((9, 9))
    image[4, 4] = 3
    assert np.argwhere(kernels.maxima(image, 2)).tolist() == [[4, 4]]
    step = np.zeros((20, 20))
    step[:, 10:] = 255
    found = kernels.edges(step, 1.0, 10, 40)
    assert found[5].any() and set(np.argwhere(found)[:, 1]) <= {9, 10}
    assert not kernels.edges(np.full((8, 8), 7.0), 1.0, 10, 40).any()


def test_quality_compares_complex_numbers_in_order():
    band = RNG.integers(0, 255, (16, 16)).astype(float)
    spectrum = np.fft.fft2(band)
    assert kernels.quality_score(band) == np.sum(spectrum > np.max(np.abs(spectrum)) / 100000) / 256


def test_segments_of_a_block_without_data():
    assert not kernels.segment([np.zeros((4, 4))] * 3, SENSORS["srgb"]).any()
    out = kernels.segment([RNG.integers(0, 255, (40, 40)).astype(float) for _ in range(3)], SENSORS["srgb"])
    assert out.min() >= 1


def test_gradient_is_flat_on_flat_ground():
    assert not kernels.gradient(np.full((10, 10), 50.0), 2.0).any()
