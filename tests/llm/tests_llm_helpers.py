"""Brute-force versions that several tests use."""

import re

import xxhash


def fingerprint_brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected_brute(prints):
    """Smallest id reachable from each id."""
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if root[j] < root[i] and (a ^ b).bit_count() <= 2:
                    root[i], changed = root[j], True
    return root
