"""Composite similarity of short names: character, word-order, word-set and best-window ratios.

All ratios are 0..100 and rest on the longest common subsequence: ``ratio(a, b)`` is
``200 * lcs / (len(a) + len(b))``. Words are compared once each, sorted.

* names of similar length (longer / shorter < 1.5): the greater of ``ratio`` and 0.95 times the greater
  of the sorted-words and word-set ratios
* else, with scale 0.9 (0.6 if one is more than 8 times as long): the greater of ``ratio``, scale times
  the best-window ratio, and 0.95 times scale times the best-window ratio of the sorted words, which is
  100 where the names share a word
"""

from __future__ import annotations

# --- fixed values (must equal the reference's behaviour) --------------------------------------
WORDS_SCALE = 0.95
SIMILAR_LENGTH, FAR_LENGTH = 1.5, 8.0
PARTIAL_SCALE, FAR_SCALE = 0.9, 0.6


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & place.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter name with a stretch of the longer one that is as long, or cut off at
    an end."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    ends = [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    return max((ratio(short, w) for w in [long[i : i + n] for i in range(len(long) - n + 1)] + ends), default=0.0)


def composite(a: str, b: str) -> float:
    """Similarity of two normalised names (lower case, words parted by spaces), to six decimals so that
    equal scores are equal; 0 if one is empty."""
    return 100.0 if a == b and a else round(_composite(a, b), 6) if a and b else 0.0


def _composite(a: str, b: str) -> float:
    wa, wb = set(a.split()), set(b.split())
    both = wa & wb
    sa, sb = " ".join(sorted(wa)), " ".join(sorted(wb))
    best = ratio(a, b)
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < SIMILAR_LENGTH:
        words = ratio(sa, sb)
        if both:
            words = 100.0 if wa == both or wb == both else max(words, shared_words_ratio(wa, wb, both))
        return max(best, WORDS_SCALE * words)
    scale = PARTIAL_SCALE if far <= FAR_LENGTH else FAR_SCALE
    words = 100.0 if both else window_ratio(sa, sb)
    return max(best, scale * window_ratio(a, b), WORDS_SCALE * scale * words)


def shared_words_ratio(wa: set[str], wb: set[str], both: set[str]) -> float:
    """Best ratio among the shared words, those with the rest of one name, and with that of the other."""
    shared = len(" ".join(sorted(both)))
    ra, rb = " ".join(sorted(wa - both)), " ".join(sorted(wb - both))
    la, lb = shared + 1 + len(ra), shared + 1 + len(rb)
    apart = len(ra) + len(rb) - 2 * lcs(ra, rb)
    return max(100 * (1 - apart / (la + lb)), 200 * shared / (shared + la), 200 * shared / (shared + lb))
