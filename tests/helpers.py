"""Small images and brute-force answers in numpy."""

import numpy as np


def image_rows(images):
    """{image_id: H x W x C array} to (image_id, h, w, y, x, v) rows."""
    return [
        (int(i), a.shape[0], a.shape[1], y, x, [int(e) for e in a[y, x]])
        for i, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])
    ]


PIXELS = "image_id BIGINT, h INT, w INT, y INT, x INT, v ARRAY<INT>"
PAIRS = "pair_id BIGINT, a_img BIGINT, aa_img BIGINT, b_img BIGINT, bb_img BIGINT, h INT, w INT, c INT"


def random_images(count, height, width, channels=1, seed=7):
    draw = np.random.default_rng(seed)
    return {i: draw.integers(0, 256, (height, width, channels)) for i in range(count)}


def brute_distance(layers, ay, ax, by, bx, patch_size):
    """Sum of squares over the window clipped to both images, by its number of pixels.

    ``layers`` is a list of (A, B) arrays compared together."""
    r, total, count = patch_size // 2, 0, 0
    h, w = layers[0][0].shape[:2]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            inside = all(0 <= p < n for p, n in ((ay + dy, h), (by + dy, h), (ax + dx, w), (bx + dx, w)))
            if inside:
                count += 1
                for a, b in layers:
                    total += int(((a[ay + dy, ax + dx] - b[by + dy, bx + dx]) ** 2).sum())
    return total / count
