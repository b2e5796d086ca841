"""Plain versions of the operators, to hold them against."""

import hashlib
import heapq
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, distance=2):
    """items: (id, fingerprint) -> id: smallest id reachable."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in items:
        for b, y in items:
            if (x ^ y).bit_count() <= distance:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in items}


def repair_cost(roles, merge=1, insert=2, relabel=3):
    follows = {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
    queue, done = [(0, 0, "")], set()
    while queue:
        cost, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and state in ("", "assistant"):
            return cost
        for t in follows[state]:
            if t != "system":
                heapq.heappush(queue, (cost + insert, i, t))
        if i < len(roles):
            for t in follows[state]:
                heapq.heappush(queue, (cost + relabel * (t != roles[i]), i + 1, t))
            if state:
                heapq.heappush(queue, (cost + merge + relabel * (state != roles[i]), i + 1, state))


def greedy(word, opening, going_on):
    i = n = 0
    while i < len(word):
        j = len(word)
        while j > i and word[i:j] not in (going_on if i else opening):
            j -= 1
        if j == i:
            return None
        n, i = n + 1, j
    return n


def base_spans(text):
    """Spans of the fixed kinds by walking the text, as (start, end, kind)."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j

    def assign(i):
        for name in names:
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            for quotes, separators in (("\"'", None), ("", ":="), ("\"'", None)):
                if separators:
                    j = run(j, " ")
                    if j >= len(text) or text[j] not in separators:
                        break
                    j = run(j + 1, " ")
                elif j < len(text) and text[j] in quotes:
                    j += 1
            else:
                end = run(j, value)
                if end > j:
                    return j, end
        return None

    i = 0
    while i < len(text):
        found = assign(i)
        if found:
            if found[1] - found[0] >= 8:
                out.append((i, found[1], 0))
            i = found[1]
        else:
            i += 1
    i = 0
    while i < len(text):
        end = run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", i) else i
        if end > i + 4:
            out += [(i, end, 1)] * (end - i >= 16)
        i = max(end, i + 1) if end > i + 4 else i + 1
    i = 0
    while i < len(text):
        end = run(i, set("0123456789abcdef"))
        out += [(i, end, 2)] * (end - i >= 32)
        i = max(end, i + 1)
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def best_stretch(gains):
    """(sum, start, end) of the run of numbers with the largest sum, the shortest and earliest of equal ones last."""
    return max(((sum(gains[i:j]), i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), key=lambda x: x[0])


def lm_scores(texts, order, min_count, backoff):
    """(words, steps back, words whose longest n-gram is alone, score) of each text."""
    words = [[w.encode() for w in WORD.findall(t)] for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        steps = once = score = 0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            once += counts[tuple(w[i + 1 - n : i + 1])] == 1
            while n > 1 and counts[tuple(w[i + 1 - n : i + 1])] < min_count:
                n, factor, steps = n - 1, factor * backoff, steps + 1
            gram = tuple(w[i + 1 - n : i + 1])
            score += round(1e6 * math.log(factor * counts[gram] / (counts[gram[:-1]] if n > 1 else total)))
        out.append((len(w), steps, once, score))
    return out
