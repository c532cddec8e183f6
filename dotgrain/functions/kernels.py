"""Error-diffusion kernels: (dx, dy, weight) triples and the sums that divide them."""

# Fixed values.
KERNELS = {
    "floydsteinberg": ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)),
    "falsefloydsteinberg": ((1, 0, 3), (0, 1, 3), (1, 1, 2)),
    "jarvis": ((1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1)),
    "stucki": ((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)),
    "atkinson": ((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)),
    "burkes": ((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)),
    "sierra3": ((1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2)),
    "sierra2": ((1, 0, 4), (2, 0, 3), (-2, 1, 1), (-1, 1, 2), (0, 1, 3), (1, 1, 2), (2, 1, 1)),
    "sierralite": ((1, 0, 2), (-1, 1, 1), (0, 1, 1)),
    "stevensonarce": ((2, 0, 32), (-3, 1, 12), (-1, 1, 26), (1, 1, 30), (3, 1, 16), (-2, 2, 12), (0, 2, 26), (2, 2, 12), (-3, 3, 5), (-1, 3, 12), (1, 3, 12), (3, 3, 5)),
}
TOTALS = {name: 8 if name == "atkinson" else sum(w for _, _, w in k) for name, k in KERNELS.items()}
