"""Double-array tries over integer sequences of one length, walked by numpy for many positions at once."""

import numpy as np


class NoRoom(Exception):
    """No free place for a node's children in a table of this size."""


def _digits(codes: np.ndarray, bits: int, per_code: int) -> np.ndarray:
    """Every code (one column each) as `per_code` digits of `bits` bits, highest first."""
    shifts = np.arange(per_code - 1, -1, -1) * bits
    return (codes[..., None] >> shifts & (1 << bits) - 1).reshape(len(codes), -1)


def _placed(parent: np.ndarray, digit: np.ndarray, nodes: int, size: int, chance) -> tuple[np.ndarray, np.ndarray]:
    """Base of every node and slot of every edge, such that no two edges share a slot and slot 0 stays the root's.

    Edges are grouped by parent. Nodes with many children come first; all open nodes of a class propose a random base at
    once, those whose slots are all free and proposed by no node before them are placed, and the others try again.
    """
    mask = size - 1
    base, slot_of = np.zeros(nodes, np.int64), np.zeros(len(parent), np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    owners, first, fan = np.unique(parent, return_index=True, return_counts=True)
    classes = np.where(fan == 1, 0, np.ceil(np.log2(fan)).astype(np.int64))
    for c in sorted(set(classes[classes > 0].tolist()), reverse=True):
        open_, tries = np.flatnonzero(classes == c), 0
        while len(open_):
            tries += 1
            if tries > 400:
                raise NoRoom
            now = open_[:max(1, size // (16 << c))]
            counts = fan[now]
            edges = np.repeat(first[now] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            bases = chance.integers(0, size, len(now))
            slots = np.repeat(bases, counts) + digit[edges] & mask
            single = np.zeros(len(slots), bool)
            single[np.unique(slots, return_index=True)[1]] = True
            good = np.logical_and.reduceat(single & ~used[slots], np.cumsum(counts) - counts)
            of_edge = np.repeat(good, counts)
            used[slots[of_edge]] = True
            base[owners[now[good]]], slot_of[edges[of_edge]] = bases[good], slots[of_edge]
            open_ = np.concatenate([open_[len(now):], now[~good]])
    single = first[classes == 0]
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        raise NoRoom
    slot_of[single] = free[:len(single)]
    base[parent[single]] = slot_of[single] - digit[single] & mask
    return base, slot_of


def build_trie(phrases: np.ndarray, bits: int, per_code: int) -> dict[str, np.ndarray]:
    """Double array of some distinct, sorted sequences of codes (one a row).

    A node is a slot: the child by digit x of node s is slot t = base[s] + x (wrapped), if check[t] = s. The base of a leaf is
    the row of its sequence. Codes are walked by digits, so that a node has at most 2^bits children.
    """
    digits = _digits(phrases.astype(np.int64), bits, per_code)
    m, depth = digits.shape
    new = np.zeros(m, bool)
    new[0] = True
    above, start, parents, edges, leaves = np.zeros(m, np.int64), 1, [], [], None
    for level in range(depth):
        new[1:] |= digits[1:, level] != digits[:-1, level]
        node = start + np.cumsum(new) - 1
        parents.append(above[new])
        edges.append(digits[new, level])
        start, above, leaves = start + int(new.sum()), node, node
    parent, digit = np.concatenate(parents), np.concatenate(edges)
    size = 1 << int(max(2 * start, 4 << bits) - 1).bit_length()
    chance = np.random.default_rng(start)
    while True:
        try:
            base, slot_of = _placed(parent, digit, start, size, chance)
            break
        except NoRoom:
            size *= 2
    slots = np.concatenate([[0], slot_of])  # of nodes; edge e leads to node e + 1
    out_base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    out_base[slots] = base
    check[slot_of] = slots[parent]
    out_base[slots[leaves]] = np.arange(m)
    return {"base": out_base, "check": check, "phrases": phrases.astype(np.int32), "shape": np.array([bits, per_code])}


def walk(trie: dict[str, np.ndarray], codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `at` where a sequence of the trie begins, and which one; all positions advance together, level by level.

    `codes` must go on for the length of a sequence behind every position; negative codes belong to none.
    """
    base, check, (bits, per_code) = trie["base"], trie["check"], trie["shape"].tolist()
    mask = len(base) - 1
    state = np.zeros(len(at), np.int64)
    for level in range(trie["phrases"].shape[1]):
        code = codes[at + level]
        keep = code >= 0
        if not keep.all():
            at, state, code = at[keep], state[keep], code[keep]
        for k in range(per_code - 1, -1, -1):
            slot = base[state] + (code >> k * bits & (1 << bits) - 1) & mask
            keep = check[slot] == state
            at, state, code = at[keep], slot[keep], code[keep]
    return at, base[state]
