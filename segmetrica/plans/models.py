"""Small models made by a fixed rule, as stand-ins for exports that are not distributed."""

from __future__ import annotations


def tree_model(n_features: int, seed: int, n_trees: int = 64) -> dict:
    """Depth-two trees; every fifth tree has a leaf as its right child."""
    feature = lambda t, n: (t * 7 + n * 5 + seed) % n_features
    threshold = lambda t, n: ((t * 37 + n * 11 + seed * 3) % 41 - 20) / 10 + 0.037
    value = lambda t, n: ((t * 13 + n * 29 + seed * 17) % 21 - 10) / 20
    trees = []
    for t in range(n_trees):
        short = t % 5 == 4
        left = [1, 2, -1, -1, -1] if short else [1, 2, -1, -1, 5, -1, -1]
        right = [4, 3, -1, -1, -1] if short else [4, 3, -1, -1, 6, -1, -1]
        inner = [c != -1 for c in left]
        nodes = range(len(left))
        trees.append(dict(
            children_left=left, children_right=right,
            feature=[feature(t, n) if inner[n] else -2 for n in nodes],
            threshold=[threshold(t, n) if inner[n] else -2.0 for n in nodes],
            value=[value(t, n) for n in nodes],
        ))
    return dict(initial_log_odds=0.25, learning_rate=0.05, trees=trees)


def sql_tree(features: str, n_features: int, seed: int) -> str:
    """The same rule in SQL over a FLOAT list, one expression per row."""
    x = lambda n: f"{features}[1+(t*7+{n}*5+{seed})%{n_features}]::DOUBLE"
    th = lambda n: f"(((t*37+{n}*11+{seed}*3)%41-20)/10e0+0.037e0)"
    v = lambda n: f"(((t*13+{n}*29+{seed}*17)%21-10)/20e0)"
    body = (
        f"CASE WHEN {x(0)}<={th(0)} THEN CASE WHEN {x(1)}<={th(1)} THEN {v(2)} ELSE {v(3)} END "
        f"WHEN t%5=4 THEN {v(4)} WHEN {x(4)}<={th(4)} THEN {v(5)} ELSE {v(6)} END"
    )
    z = f"(0.25e0+0.05e0*list_sum(list_transform(range(64), lambda t: {body})))"
    return f"(1e0/(1e0+exp(-{z})))"


def linear_model(n: int) -> dict:
    return dict(
        mean=[((i * 7) % 11 - 5) / 10 for i in range(n)],
        scale=[(i % 5 + 2) / 2 for i in range(n)],
        coef=[((i * 13) % 17 - 8) / 20 for i in range(n)],
        intercept=-0.125,
    )
