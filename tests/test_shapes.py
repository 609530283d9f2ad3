"""Chart shapes on drawn series: each is found where it was drawn, and no longer once one of its rules is broken."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators import patterns


def drawn(*points, half=1.0, volume=(200, 100), flip=False):
    """Straight legs between (bar, price) points, each bar `half` to either side of its close; flip draws it upside down."""
    x, y = zip(*points, strict=True)
    c = np.interp(np.arange(x[-1] + 1), x, y)
    c = 300 - c if flip else c
    return patterns.Series.of(c + half, c - half, c, np.linspace(*volume, len(c)), 5, 5)


def found(series):
    return {name: points for name, _, _, points in patterns.detect(series)}


BOTTOM = [(0, 110), (20, 100), (30, 104), (40, 100.5), (47, 102)]
HEAD = [(0, 90), (10, 104), (20, 98), (30, 112), (40, 98.5), (50, 104.5), (58, 99.5)]
COIL = [(0, 90), (15, 120), (25, 100), (35, 119), (45, 108), (52, 112)]
RISING = [(0, 100), (10, 120.5), (20, 100), (30, 120), (40, 106), (50, 119.5), (58, 114)]
FALLING = [(0, 100), (10, 130), (20, 100), (30, 124), (40, 100.4), (50, 117), (58, 108)]
CLOSING = [(0, 100), (10, 130), (20, 100), (30, 124), (40, 106), (50, 119), (58, 114)]


@pytest.mark.parametrize(("points", "half", "up", "down"), [(BOTTOM, 2.0, "DBOT", "DTOP"), (HEAD, 1.0, "HNSD", "HNSU"), (COIL, 1.0, "VCPU", "VCPD")])
def test_shape_and_its_mirror(points, half, up, down):
    a, b = found(drawn(*points, half=half)), found(drawn(*points, half=half, flip=True))
    assert up in a and down not in a and down in b and up not in b
    assert {k: bar for k, (bar, _) in a[up].items()} == {k: bar for k, (bar, _) in b[down].items()}
    assert all(price + b[down][k][1] == pytest.approx(300) for k, (_, price) in a[up].items())  # with the prices of its own series


def test_bars_of_the_shapes():
    bars = lambda name, points, half: [bar for bar, _ in found(drawn(*points, half=half))[name].values()]
    assert bars("DBOT", BOTTOM, 2.0) == [20, 30, 40, 47]
    assert bars("HNSD", HEAD, 1.0) == [10, 20, 30, 40, 50, 58]
    assert bars("VCPU", COIL, 1.0) == [15, 25, 35, 45, 52]
    assert bars("TRNG_Ascending", RISING, 1.0) == [10, 20, 30, 40, 50, 58]


def moved(points, k, price):
    return [*points[:k], (points[k][0], price), *points[k + 1 :]]


@pytest.mark.parametrize(
    ("name", "points", "half"),
    [
        ("DBOT", moved(BOTTOM, 3, 95.0), 2.0), ("DBOT", moved(BOTTOM, 4, 107.0), 2.0), ("DBOT", moved(BOTTOM, 2, 118.0), 0.5),  # levels apart; above the top; too deep for its ranges
        ("HNSD", moved(HEAD, 3, 104.6), 1.0), ("HNSD", moved(HEAD, 4, 102.5), 1.0), ("HNSD", moved(HEAD, 6, 103.5), 1.0), ("HNSD", moved(HEAD, 6, 90.0), 1.0),  # no lead; slanted neckline; far above it; fallen through
        ("VCPU", moved(COIL, 4, 101.0), 1.0), ("VCPU", moved(COIL, 3, 113.0), 1.0), ("VCPU", moved(COIL, 5, 121.0), 1.0), ("VCPU", moved(COIL, 3, 122.5), 1.0),  # lows level; highs apart; above the last high; the second high clearly higher
    ],
)
def test_broken_rules(name, points, half):
    assert name not in found(drawn(*points, half=half))


def test_a_bottom_on_more_volume_is_none():
    assert "DBOT" not in found(drawn(*BOTTOM, half=2.0, volume=(100, 200)))


def test_triangles_and_breakouts():
    shape = lambda points: {(n, d, b) for n, d, b, _ in patterns.detect(drawn(*points)) if n.startswith("TRNG")}
    assert shape(RISING) == {("TRNG_Ascending", "neutral", "inside")}
    assert shape(FALLING) == {("TRNG_Descending", "neutral", "inside")}
    assert shape(CLOSING) == {("TRNG_Symmetric", "neutral", "inside")}
    assert shape([*RISING[:-1], (54, 116), (58, 124)]) == {("TRNG_Ascending", "bullish", "up")}
    assert shape([*CLOSING[:-1], (54, 115), (58, 122)]) == {("TRNG_Symmetric", "bullish", "up")}
    assert shape([*FALLING[:-1], (58, 98.5)]) == {("TRNG_breakdown", "bearish", "down")}


def test_short_series_have_no_shapes():
    assert found(drawn((0, 100), (10, 90), (20, 100), (28, 95))) == {}
    assert found(drawn((0, 100), (60, 160))) == {}
