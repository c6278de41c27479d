"""Offsets on lattices: shifts come back, with numbers that a plain loop over chips gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from scarp.operators import raster, tracking


def smooth(x, times=6):
    for _ in range(times):
        x = (x + np.roll(x, 1, 0) + np.roll(x, -1, 0) + np.roll(x, 1, 1) + np.roll(x, -1, 1)) / 5
    return x


def shifted(img, dr, dc):
    ky, kx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None]
    return np.real(np.fft.ifft2(np.fft.fft2(img) * np.exp(-2j * np.pi * (ky * dr + kx * dc))))


def rows_of(spark, ref, sec, scene="a"):
    r, c = np.indices(ref.shape)
    frame = pd.DataFrame({"scene": scene, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "ref": ref.ravel(), "sec": sec.ravel()})
    return spark.createDataFrame(frame).replace(float("nan"), None)


def test_a_shift_comes_back_at_every_node(spark):
    rng = np.random.default_rng(0)
    base = smooth(rng.normal(size=(480, 480)))
    moved = shifted(base, 0.8, -1.3) + 0.05 * base.std() * rng.normal(size=base.shape)
    got = tracking.offset_field(rows_of(spark, base, moved), ["scene"]).toPandas()
    assert len(got) == 26 * 26 and set(got["row"]) == set(range(32, 448, 16))
    inner = got[got["row"].between(48, 420) & got["col"].between(48, 420)]
    assert got["dx"].notna().all() and (abs(inner["dx"] + 1.3) < 0.1).all() and (abs(inner["dy"] + 0.8) < 0.1).all(), got.describe()


def test_nodes_against_single_chips(spark):
    rng = np.random.default_rng(5)
    a, b = (smooth(rng.normal(size=(70, 300))) for _ in range(2))
    b[:, 100:] = np.roll(a, (1, 2), (0, 1))[:, 100:]
    a[20:60, 200:240] = np.nan
    pair = rows_of(spark, a, b)
    high = tracking.highpassed(pair, ["scene"], 32 / 6).toPandas()
    x, y = (np.zeros(a.shape) for _ in range(2))
    x[high["row"], high["col"]], y[high["row"], high["col"]] = high["a"], high["b"]
    got = {(r.row, r.col): r for r in tracking.chip_lattice(pair, ["scene"], 32, 8).toPandas().itertuples()}
    expected = 0
    for r in range(16, 70 - 16, 8):
        for c in range(16, 300 - 16, 8):
            box = np.s_[r - 16 : r + 16, c - 16 : c + 16]
            if not np.mean(~np.isnan(a[box]) & ~np.isnan(b[box])) > 0.9:
                assert (r, c) not in got
                continue
            expected += 1
            one = [float(v[0]) for v in raster.peak_offsets(x[box][None], y[box][None])]
            assert [got[r, c].dr, got[r, c].dc, got[r, c].corr, got[r, c].snr] == pytest.approx(one)
    assert len(got) == expected > 100


def test_outliers_and_masks(spark):
    rng = np.random.default_rng(7)
    base = smooth(rng.normal(size=(160, 160)))
    moved = np.roll(base, (2, -3), (0, 1))
    moved[64:96, 64:96] = np.roll(base, (-4, 4), (0, 1))[64:96, 64:96]
    pair = rows_of(spark, base, moved)
    field = tracking.offset_field(pair, ["scene"], 32, 16).toPandas()
    kept = field[field["dx"].notna()]
    assert len(kept) < len(field) and (abs(kept["dx"] + 3) < 1).all() and (abs(kept["dy"] + 2) < 1).all()
    mask = pair.where("row < 60").select("scene", "row", "col")
    assert set(tracking.offset_field(pair, ["scene"], 32, 16, where=mask).toPandas()["row"]) == {16, 32, 48}
    assert {r["row"] for r in tracking.at_nodes(mask, ["scene"], 32, 16).collect()} == {16, 32, 48}
    assert tracking.offset_field(pair.limit(0), ["scene"], 32, 16).count() == 0
