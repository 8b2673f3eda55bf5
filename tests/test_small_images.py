"""Images that a blur's mask reaches beyond: mirrored once at each border, 0 beyond."""

import numpy as np
import pytest

from weftline.functions.kernels import gauss_mask
from weftline.operators import images, reconstruction

from tests.test_operators import plane


@pytest.mark.parametrize("h,w,tile", [(16, 64, 256), (16, 20, 7), (1, 40, 256), (9, 3, 4)])
def test_blur_of_a_small_image(spark, h, w, tile):
    a = np.random.default_rng(h).integers(0, 50, (h, w)).astype("float64")
    m = gauss_mask(0, 9.0)
    once = lambda at, n: -at if at < 0 else 2 * (n - 1) - at if at >= n else at

    def across(z):
        out = np.zeros_like(z)
        for y in range(len(z)):
            for j, f in enumerate(m):
                at = once(y + j - len(m) // 2, len(z))
                if 0 <= at < len(z):
                    out[y] += f * z[at]
        return out

    got = np.zeros((h, w))
    for r in images.gauss_blur(plane(spark, a), 9.0, tile=tile).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, across(across(a).T).T)


def test_a_small_image_has_a_reconstruction_error(spark):
    a = np.random.default_rng(3).integers(0, 50, (16, 30)).astype("float64")
    flat = images.without_background(plane(spark, a))
    line = spark.createDataFrame([(1, 1, k, float(3 * k), 8.0) for k in range(1, 9)], "frame int, contour int, point int, x double, y double")
    assert reconstruction.reconstruction_error(line, flat).first().error > 0
